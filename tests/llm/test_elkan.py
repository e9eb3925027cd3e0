"""Elkan's bounds against plain k-means in Python integers."""

from __future__ import annotations

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchlift.llm import elkan
from searchlift.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("Cluster", T.StringType())])


def plain(rows, k=16, rounds=3, dim=64):
    """(id, components) -> rows (id, cluster, distance, cluster inertia, inertia, digest)."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    cents = [v for _, v in sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    assign = lambda: [min((far(v, c), n) for n, c in enumerate(cents)) for _, v in kept]
    for _ in range(rounds):
        found = assign()
        for n in range(len(cents)):
            mine = [v for (_, v), (_, c) in zip(kept, found) if c == n]
            if mine:
                cents[n] = [sum(xs) // len(mine) for xs in zip(*mine)]
    found = assign()
    total = sum(d for d, _ in found)
    per = {n: sum(d for d, c in found if c == n) for n in range(len(cents))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, c, d, per[c], total, digest[c]) for (i, _), (d, c) in zip(kept, found)), key=str)


def run(df, **options):
    out = elkan.with_inertia(*elkan.cluster(df, **options))
    return sorted((tuple(r) for r in out.select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def test_the_query_over_all_vectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = queries()["op12_elkan_clusters"](spark, SF)
    assert sorted((tuple(r) for r in got.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str) == plain(rows)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS FROM '{SF}/embeddings.parquet'")
    sql = c.execute(f"SELECT vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 FROM ({oracle_sql()['op12_elkan_clusters']})").fetchall()
    assert sorted(sql, key=str) == plain(rows)


@pytest.mark.parametrize("seed", range(4))
def test_ties_and_repeated_vectors(spark, seed):
    """A coarse grid: many vectors lie as near to one centroid as to another."""
    draw = random.Random(seed)
    rows = [(i, [draw.choice((-1, 0, 1)) / 64 for _ in range(3)], "x") for i in range(300)] + [(1, [0.0, 0.0, 0.0], "y")] * 5
    got = run(spark.createDataFrame(rows, VECTORS), dim=3, k=9)
    assert got == plain([r[:2] for r in rows], dim=3, k=9)


def test_bounds_hold_and_prune():
    draw = np.random.default_rng(7)
    centres = draw.integers(-3000, 3000, (16, 8))
    x = (centres[draw.integers(0, 16, 4000)] + draw.integers(-200, 200, (4000, 8))).astype(np.int64)
    cents = x[:16].copy()
    near, upper, lower = elkan.start(x, cents)
    spent = 0
    for _ in range(6):
        after = np.array([x[near == c].sum(axis=0) // max(1, (near == c).sum()) if (near == c).any() else cents[c] for c in range(16)])
        near, upper, lower, computed = elkan.step(x, near, upper, lower, cents, after)
        cents, spent = after, spent + computed
        d = np.stack([elkan.squared(x, c) for c in cents], axis=1)
        assert (near == d.argmin(axis=1)).all()
        assert (upper >= np.sqrt(d[np.arange(len(x)), near])).all() and (lower <= np.sqrt(d)).all()
    assert spent < 0.5 * 6 * len(x) * 16


def test_edges(spark):
    full = [0.5] * 64
    rows = [(1, full, None), (1, full, None), (None, [-0.01] * 64, "a"), (2, None, None), (3, [], None), (4, [1.0] * 63, None), (5, [None] + [1.0] * 63, None), (6, [float("nan")] + [1.0] * 63, None), (7, [float("-inf")] + [1.0] * 63, None), (8, [1e-30, -1e-30] * 32, None)]
    df = spark.createDataFrame(rows, VECTORS)
    assert run(df) == plain([r[:2] for r in rows]) and len(run(df)) == 4
    assert run(df.where("false")) == []
    with pytest.raises(Exception, match="scale the vectors down"):
        run(spark.createDataFrame([(1, [3e30] * 64, None)], VECTORS))


def test_states_are_dropped(spark):
    from searchlift.llm import common

    before = len(common._STAGED)
    elkan.cluster(spark.range(50).select(F.col("id").alias("vec_id"), F.array_repeat(F.rand(3), 64).alias("embedding")))
    assert len(common._STAGED) == before + 1
