"""Centroid clustering in exact integers with Elkan's bounds.

A vector keeps an upper bound of the distance to its centroid and a lower bound of that to each
centroid, and both move with the centroids. A centroid is left out where a bound, or half the distance
between two centroids, says that it is strictly farther; bounds are rounded away from the truth, so
a centroid at the same distance is always compared. Comparisons themselves are of exact integer squared
distances, ties to the smaller number. Vectors never move: a round reads the state of the one before
from files, assigns inside its tasks, writes the next state, and the sums of each centroid (at most k
rows) come to the driver.

Defined results: vectors with another number of components, with a null or non-finite one, and null
vectors are left out; rows that repeat an id are vectors of their own; a null id counts as the empty
text where seeds are drawn, and rows that draw alike are ordered by their components; with fewer vectors
than k there are fewer centroids; equal centroids leave the larger number empty, and an empty centroid
stays where it is; without vectors there are no rows. A component beyond 2**27 after scaling is an error, as
squared distances might not fit 64 bits. Only the id and the vector are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchlift.llm.common import as_data, drop_staged, materialise, staged, table

LARGEST = 2**27


def quantised(vectors: DataFrame, dim: int = 64, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v): the kept vectors with floor(scale * component) as integers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = F.col(vec_col)
    kept = vectors.where((F.size(v) == dim) & ~F.exists(v, bad)).select(F.col(id_col).alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    fits = F.when(F.exists("v", lambda x: F.abs(x) > LARGEST), F.raise_error(F.lit(f"a component beyond {LARGEST}: scale the vectors down")).cast("array<int>"))
    return kept.select("id", F.coalesce(fits, F.col("v").cast("array<int>")).alias("v"))


def seeds(rows: DataFrame, k: int) -> np.ndarray:
    """The k vectors whose ids have the smallest sha256 of '1:<id>'."""
    drawn = rows.select("v", F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256).alias("draw"))
    return np.array([r.v for r in drawn.orderBy("draw", "v").limit(k).collect()], np.int64)


def squared(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    return ((x - centroid) ** 2).sum(axis=-1)


def above(squares) -> np.ndarray:
    """Square roots, rounded up past any error of conversion and root."""
    return np.nextafter(np.nextafter(np.sqrt(np.asarray(squares, np.float64)), np.inf), np.inf)


def below(squares) -> np.ndarray:
    return np.maximum(0.0, np.nextafter(np.nextafter(np.sqrt(np.asarray(squares, np.float64)), -np.inf), -np.inf))


def start(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """cluster, upper and lower bounds of vectors that have none yet: all distances are computed."""
    d = np.stack([squared(x, c) for c in centroids], axis=1)
    near = d.argmin(axis=1)
    return near, above(d[np.arange(len(x)), near]), below(d)


def step(x: np.ndarray, near: np.ndarray, upper: np.ndarray, lower: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """cluster and bounds after the centroids moved from `before`, and how many distances were computed."""
    moved = above(squared(before, centroids))
    near, upper = near.copy(), np.nextafter(upper + moved[near], np.inf)
    lower = np.maximum(0.0, np.nextafter(lower - moved, -np.inf))
    half = 0.5 * below([squared(centroids, c) for c in centroids])
    apart = half.copy()
    np.fill_diagonal(apart, np.inf)
    # Strictly nearer than half the way to any other centroid: nothing can change.
    open_ = np.flatnonzero(~(upper < apart.min(axis=1)[near]))
    best, known, computed = np.zeros(len(x), np.int64), np.zeros(len(x), bool), 0
    for c in range(len(centroids)):
        may = lambda i: i[(near[i] != c) & ~(upper[i] < lower[i, c]) & ~(upper[i] < half[near[i], c])]
        rows = may(open_)
        loose = rows[~known[rows]]
        best[loose] = squared(x[loose], centroids[near[loose]])
        upper[loose], known[loose] = above(best[loose]), True
        lower[loose, near[loose]] = below(best[loose])
        computed += len(loose)
        rows = may(rows)
        d = squared(x[rows], centroids[c])
        computed += len(rows)
        lower[rows, c] = below(d)
        wins = (d < best[rows]) | ((d == best[rows]) & (c < near[rows]))
        rows, d = rows[wins], d[wins]
        near[rows], best[rows], upper[rows] = c, d, above(d)
    return near, upper, lower, computed


def _assigned(rows: DataFrame, before: np.ndarray | None, centroids: np.ndarray, last: bool) -> DataFrame:
    """The state after one assignment; the last one has the exact distances in place of bounds."""
    kind = rows.schema["id"].dataType.simpleString()
    k, dim = centroids.shape

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = lambda b, name, width, t: b.column(name).flatten().to_numpy(zero_copy_only=False).astype(t).reshape(b.num_rows, width)
        for b in batches:
            if not b.num_rows:
                continue
            x = flat(b, "v", dim, np.int64)
            if before is None:
                near, upper, lower = start(x, centroids)
            else:
                near, upper, lower, _ = step(x, b.column("cluster").to_numpy(), b.column("upper").to_numpy(), flat(b, "lower", k, np.float64), before, centroids)
            out = [b.column("id"), pa.array(near, pa.int32())]
            if last:
                yield pa.RecordBatch.from_arrays([*out, pa.array(squared(x, centroids[near]), pa.int64())], ["id", "cluster", "distance"])
            else:
                bounds = pa.ListArray.from_arrays(pa.array(np.arange(0, k * b.num_rows + 1, k), pa.int32()), pa.array(lower.ravel()))
                yield pa.RecordBatch.from_arrays([*out, b.column("v"), pa.array(upper), bounds], ["id", "cluster", "v", "upper", "lower"])

    return rows.mapInArrow(assign, f"id {kind}, cluster int, " + ("distance bigint" if last else "v array<int>, upper double, lower array<double>"))


def centroids_after(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor of the mean of each centroid's vectors; at most k rows come to the driver."""
    sums = [F.sum(F.get("v", i).cast("bigint")).alias(f"c{i}") for i in range(centroids.shape[1])]
    out = centroids.copy()
    for r in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        out[r.cluster] = [r[f"c{i}"] // r.n for i in range(centroids.shape[1])]
    return out


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) after `rounds` rounds and one more assignment, and the centroids. States are dropped once the next is written."""
    spark = vectors.sparkSession
    state = quantised(vectors, dim, scale, id_col, vec_col)
    centroids, before = seeds(state, k), None
    if not len(centroids):
        return state.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")).where("false"), np.zeros((0, dim), np.int64)
    for _ in range(rounds):
        mark = staged()
        state = materialise(_assigned(state, before, centroids, False), "elkan")
        drop_staged(spark, mark - (before is not None), keep=1)
        before, centroids = centroids, centroids_after(state, centroids)
    mark = staged()
    out = materialise(_assigned(state, before, centroids, True), "elkan-assigned")
    drop_staged(spark, mark - (before is not None), keep=1)
    return out, centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """assigned with the distance summed over its cluster and over all, and the digest of its centroid; one row for each cluster passes the driver."""
    sums = {r.cluster: r.d for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    at: Column = F.col("cluster")
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    return assigned.withColumns({"cluster_inertia": F.get(as_data([sums.get(c, 0) for c in range(len(centroids))], "bigint"), at), "inertia": F.lit(sum(sums.values())).cast("bigint"), "centroid_sha256": F.get(as_data(digests, "string"), at)})


def op12(spark, sf_dir):
    return with_inertia(*cluster(table(spark, sf_dir, "embeddings"))).withColumnRenamed("id", "vec_id")


def _oracle(k: int = 16, rounds: int = 3, dim: int = 64) -> str:
    mean = "(s - ((s % n) + n) % n) // n"
    parts = [
        f"kept AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY draw, v) - 1 AS c, v AS m FROM (SELECT v, sha256(concat('1:', vec_id)) AS draw FROM kept ORDER BY draw, v LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        parts.append(f"d{i} AS (SELECT r, c, CAST(list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM kept, c{i})")
        parts.append(f"a{i} AS (SELECT r, c, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if i < rounds:
            parts.append(f"s{i} AS (SELECT c, j, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i} JOIN kept USING (r)) GROUP BY c, j)")
            parts.append(f"c{i + 1} AS (SELECT c, coalesce(q.m, c{i}.m) AS m FROM c{i} LEFT JOIN (SELECT c, list(CAST({mean} AS BIGINT) ORDER BY j) AS m FROM s{i} GROUP BY c) q USING (c))")
    return f"WITH {', '.join(parts)} SELECT vec_id, CAST(c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} USING (c)"


ORACLE_OP12 = _oracle()
