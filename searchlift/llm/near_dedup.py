"""Near-duplicates by MinHash with tensored banding.

A text's set holds its distinct five-word shingles. Two collections of half-keys, each of PAIR
minhashes, stand for a set; the tables take their keys from all pairs of one half-key of either
collection, so the hashing grows with the square root of the tables. Two sets of similarity s share
a table with probability (1 - (1 - s**PAIR)**halves)**2; `halves` follows from the threshold, so
that all but 5e-5 of the pairs at the threshold share one.

Documents with equal sets collapse to one class first. In each table key the smallest class is the
centre; members are checked against it, on full sets, and links make components. Members that are
not in their centre's component may still be linked with each other. Of those, only documents that
share enough shingles with other components at all go on, and meet by the rarest of these shingles:
two sets that are similar enough share one of the few rarest (a prefix filter, which is exact).
Candidates far below the threshold by their signatures are dropped before their texts move; links
are only made on full sets.

Defined results: null and wordless texts have the empty set and are components of their own;
texts of fewer than five words have one shingle, the whole sequence; very long texts are hashed
whole, in steps; rows of one id are one document, and its component joins what any of its texts is
linked with; rows with a null id join no links, have no component and are kept; ties go to the
smallest id; empty tables give no rows; other columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from searchlift.llm.common import drop_staged, join_groups, materialise, staged, table

WORDS = 5
PAIR = 2
#: Lower thresholds would need more tables than pay: they are refused.
LEAST_THRESHOLD = 70
#: So many classes (20 bytes each) are broadcast to pick the texts to compare; with more, the texts are shuffled.
BROADCAST_IDS = 1_000_000
#: Shingles per step of hashing.
STEP = 1 << 16
FEATURES = "n_shingles long, set_key binary, sig array<int>"


@dataclass(frozen=True)
class Plan:
    """What follows from the threshold (in percent).

    halves: half-keys of either collection; a half misses a pair at the threshold with probability 2e-5 at most.
    least_agreed: minhashes that a pair at the threshold agrees on, but for a chance of 2e-6.
    alone: sets of so many shingles and fewer are linked with their equals alone.
    """

    threshold: int
    halves: int
    n_hashes: int
    least_agreed: int
    alone: int

    @classmethod
    def of(cls, threshold: int) -> Plan:
        if not LEAST_THRESHOLD <= threshold <= 100:
            raise ValueError(f"threshold {threshold} is not in {LEAST_THRESHOLD} to 100: links would be lost")
        s = min(threshold / 100, 0.99)
        halves = max(2, math.ceil(math.log(2e-5) / math.log(1 - s**PAIR)))
        n, below, k = 2 * PAIR * halves, 0.0, 0
        while (below := below + math.comb(n, k) * s**k * (1 - s) ** (n - k)) < 2e-6:
            k += 1
        # A set of n shingles has n of n + 1 in common with another set at best.
        alone = -(-threshold // (100 - threshold)) - 1 if threshold < 100 else 1 << 62
        return cls(threshold, halves, n, k, alone)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles.

    Words are hashed by xxhash; a shingle's hash mixes its words' hashes in order.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    seen: dict[bytes, int] = {}
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter([seen[w] if w in seen else seen.setdefault(w, digest(w)) for w in words], np.uint64, len(words))
    if len(h) < WORDS:
        return np.array([digest(b" ".join(words), 1)], np.uint64)
    n = len(h) - WORDS + 1
    x = np.zeros(n, np.uint64)
    for i in range(WORDS):
        x = _mixed(x ^ h[i : n + i])
    return np.unique(x)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)


#: One odd factor for each minhash that any threshold may need.
_SEEDS = np.random.default_rng(20240613).integers(1, 2**63, 128, dtype=np.uint64) | np.uint64(1)


def signature(s: np.ndarray, n_hashes: int) -> np.ndarray:
    low = np.full(n_hashes, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), STEP):
        part = s[at : at + STEP]
        for k in range(n_hashes):
            low[k] = min(low[k], (part * _SEEDS[k]).min())
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _features(text: Column, plan: Plan) -> Column:
    """struct(n_shingles, set_key, sig) of a text; the ids, which may be null, stay outside of pandas."""

    @F.pandas_udf(FEATURES)
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch:
                s = shingles(text)
                rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), signature(s, plan.n_hashes) if len(s) > plan.alone else None))
            yield pd.DataFrame(rows, columns=["n_shingles", "set_key", "sig"])

    return features(text)


def _sides(pairs: DataFrame, of: DataFrame, *columns: str) -> DataFrame:
    """pairs (x, y) with the columns of either side, as x_... and y_..."""
    for side in "xy":
        pairs = pairs.join(of.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns]), side)
    return pairs


def _texts_of(texts: DataFrame, wanted: DataFrame, reps: DataFrame, *columns: str) -> DataFrame:
    """node, text and the columns of wanted (node, ...), one row each: the text that stands for the class.

    A bounded number of classes is broadcast, so that no other text moves. Rows that repeat the text are combined before they move.
    """
    wanted = materialise(wanted.join(reps.select("node", "id", "text_key"), "node"), "near-wanted")
    found = texts.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, ["id", "text_key"])
    return found.groupBy("node", *columns).agg(F.any_value("text").alias("text"))


def _near_enough(plan: Plan):
    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pairs whose signatures agree often enough."""
        for b in batches:
            if len(b):
                agreed = (np.vstack(b["x_sig"].to_numpy()) == np.vstack(b["y_sig"].to_numpy())).sum(axis=1)
                yield b.loc[agreed >= plan.least_agreed, ["x", "y"]]

    return near


def _linked(threshold: int):
    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets: dict[int, np.ndarray] = {}
            keep = []
            for x, y, tx, ty in zip(b["x"], b["y"], b["x_text"], b["y_text"], strict=True):
                for i, t in ((x, tx), (y, ty)):
                    if i not in sets:
                        sets[i] = shingles(t)
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                keep.append(100 * both >= threshold * (len(sets[x]) + len(sets[y]) - both))
            yield b.loc[keep, ["x", "y"]]

    return check


def _links(near: DataFrame, texts: DataFrame, reps: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (distinct, by class) that are linked on full sets."""
    near = materialise(near, "near-candidates")
    # Each text of a candidate pair moves once for each side.
    used = materialise(_texts_of(texts, near.select(F.explode(F.array("x", "y")).alias("node")).distinct(), reps), "near-texts")
    return materialise(_sides(near, used, "text").mapInPandas(_linked(plan.threshold), "x long, y long"), "near-links")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable, for all ids in links (x, y).

    Each round takes the smallest label among the neighbours and then follows that label one
    step; labels only fall, and the rounds grow with the logarithm of a component's diameter.
    """
    spark, mark = links.sparkSession, staged()
    edges = materialise(links.select("x", "y").union(links.select("y", "x")).distinct().toDF("id", "other"), "edges")
    labels = materialise(edges.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("component")), "labels")
    for _ in range(rounds):
        seen = edges.join(labels.select(F.col("id").alias("other"), "component"), "other").groupBy("id").agg(F.min("component").alias("seen"))
        # Hooking: a root takes the smallest label that any of its members has seen.
        own = labels.join(seen, "id").select("id", "component", F.least("component", "seen").alias("low"))
        root = own.groupBy(F.col("component").alias("root")).agg(F.min("low").alias("root_low"))
        new = own.join(root, F.col("low") == F.col("root"), "left").select("id", "component", F.least("low", F.coalesce("root_low", "low")).alias("new"))
        new = materialise(new, "labels")
        drop_staged(spark, mark + 1, keep=1)
        if new.where("new < component").isEmpty():
            return new.select("id", "component")
        labels = new.select("id", F.col("new").alias("component"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_duplicates(docs: DataFrame, threshold: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept."""
    plan = Plan.of(threshold)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("text_key", F.xxhash64("text"))
    found = materialise(texts.select("id", "text_key", _features(F.col("text"), plan).alias("f")).select("id", "text_key", "f.*"), "near-features")
    live = found.where("n_shingles > 0 AND id IS NOT NULL")
    classes = live.groupBy("set_key").agg(F.min(F.struct("id", "text_key")).alias("rep"), F.count("*").alias("members"), F.any_value("n_shingles").cast("int").alias("n"), F.any_value("sig").alias("sig"))
    classes = materialise(classes.select("set_key", "rep.id", "rep.text_key", "members", "n", "sig", F.monotonically_increasing_id().alias("node")), "near-classes")
    reps = classes.where("sig IS NOT NULL")
    one, other = f"slice(sig, {PAIR} * (ij div {plan.halves}) + 1, {PAIR})", f"slice(sig, {PAIR * plan.halves} + {PAIR} * (ij % {plan.halves}) + 1, {PAIR})"
    rows = reps.withColumn("ij", F.explode(F.sequence(F.lit(0), F.lit(plan.halves**2 - 1)))).select(F.xxhash64("ij", F.expr(one), F.expr(other)).alias("key"), "id")
    # The smallest id is the centre: where copies are edited from one text, that text tends to come first, and is near to all of them.
    centres = materialise(rows.groupBy("key").agg(F.min("id").alias("centre"), F.count("*").alias("members")).where("members > 1"), "near-keys")
    # The keys are as many as the documents at any size: never broadcast.
    members = materialise(rows.join(centres.hint("merge"), "key").where("id <> centre"), "near-members")
    near = members.select(F.col("id").alias("x_id"), F.col("centre").alias("y_id")).distinct()
    for side in "xy":
        near = near.join(reps.select(F.col("id").alias(f"{side}_id"), F.col("node").alias(side), F.col("n").alias(f"{side}_n"), F.col("sig").alias(f"{side}_sig")), f"{side}_id")
    first = _links(near.where(_sized(plan)).select("x", "y", "x_sig", "y_sig").mapInPandas(_near_enough(plan), "x long, y long"), texts, reps, plan)
    as_ids = lambda links: _sides(links, reps, "id").select(F.col("x_id").alias("x"), F.col("y_id").alias("y"))
    same = _same_id(live, classes)
    labels = components(as_ids(first).union(same))
    second = _links(_unsettled(members, centres, labels, reps, texts, plan), texts, reps, plan)
    labels = components(as_ids(first.union(second)).union(same))
    every = classes.join(labels, "id", "left").select("set_key", F.coalesce("component", "id").alias("component_id"), "members")
    out = join_groups(live.select("id", "n_shingles", "set_key"), every, "set_key", "members", found.count())
    rest = found.where("n_shingles = 0 OR id IS NULL").select("id", "n_shingles", F.col("id").alias("component_id"))
    return out.select("id", "n_shingles", "component_id").unionByName(rest).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def _sized(plan: Plan) -> str:
    return f"100 * least(x_n, y_n) >= {plan.threshold} * greatest(x_n, y_n)"


def _same_id(live: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (x, y) between the ids that stand for the classes of one id: its texts are one document's."""
    several = live.groupBy("id").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high")).where("low <> high").select("id")
    of = live.join(several, "id", "left_semi").select("id", "set_key").distinct().join(classes.select("set_key", F.col("id").alias("rep")), "set_key")
    return of.where("id <> rep").select(F.col("rep").alias("x"), F.col("id").alias("y"))


def _shingle_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for node, c, text in zip(batch["node"], batch["component"], batch["text"], strict=True):
            s = shingles(text)
            for at in range(0, len(s), STEP):
                yield pd.DataFrame({"shingle": s[at : at + STEP].view(np.int64), "node": node, "component": c})


def _common(docs: DataFrame, rows: DataFrame, plan: Plan, rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """docs (node, n, component) -> those that may be linked, with how many of their shingles a document of another component has too; and these shingles.

    Documents that have too few drop out, and the next round counts among the rest alone.
    """
    left = docs
    for k in range(rounds):
        if k:
            rows = rows.join(left.select("node"), "node", "left_semi")
        shared = rows.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("shingle")
        rows = materialise(rows.join(shared, "shingle", "left_semi"), "near-shared")
        counts = rows.groupBy("node").agg(F.count("*").cast("int").alias("common"))
        left = materialise(left.select("node", "n", "component").join(counts, "node").where(f"100 * common >= {plan.threshold} * n"), "near-common")
    return left, rows.join(left.select("node"), "node", "left_semi")


def _unsettled(members: DataFrame, centres: DataFrame, labels: DataFrame, reps: DataFrame, texts: DataFrame, plan: Plan) -> DataFrame:
    """Pairs of different components that no centre settles.

    They lie in keys where some member is outside the centre's component. Two documents of different
    components share no more shingles than either has in common with other components at all; most
    documents outside are kept apart by shingles of their own, so this bound drops them first. The
    rest pair by shingles: ordered by how few of the rest have them, two linked sets share one of the
    first n - ceil(threshold * n) + 1 of either, of which the shingles of their own take the first
    places; and where they meet, no later than what their two sizes ask for in common allows. In each shingle the members of its largest component are not paired with each other.
    """
    of_id = reps.select("id").distinct().join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    # Keys of one centre are as many as the tables at most; its members may be a third of all documents, so the home comes by key.
    homes = centres.where("members > 2").join(of_id.select(F.col("id").alias("centre"), F.col("component").alias("home")), "centre").select("key", "home")
    m = members.where("members > 2").select("key", "id").join(of_id, "id").join(homes, "key")
    m = materialise(m.select("key", "id", "component", (F.col("component") != F.col("home")).alias("outside")), "near-unsettled")
    m = m.join(m.where("outside").select("key").distinct(), "key", "left_semi").select("id", "component").distinct()
    docs = materialise(reps.select("node", "id", "n").join(m, "id").select("node", "n", "component"), "near-apart")
    said = _texts_of(texts, docs.select("node", "component"), reps, "component")
    rows = materialise(said.mapInPandas(_shingle_rows, "shingle long, node long, component long"), "near-shingles")
    left, rows = _common(docs, rows, plan)
    by_shingle = rows.groupBy("shingle", "component").agg(F.count("*").alias("k")).groupBy("shingle").agg(F.sum("k").alias("df"), F.max_by("component", "k").alias("home"))
    placed = rows.join(by_shingle, "shingle").withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("df", "shingle")))
    least = f"CAST(ceil({plan.threshold} * n / 100D) AS INT)"
    first = placed.join(left.select("node", "n", "common"), "node").where(f"place <= common - {least} + 1")
    first = first.join(reps.select("node", "sig"), "node")
    first = materialise(first.select("shingle", "node", "n", "common", "place", "component", "sig", (F.col("component") != F.col("home")).alias("outside")), "near-prefixes")
    side = lambda df, s: df.select("shingle", *[F.col(c).alias(f"{s}_{c}") for c in ("node", "n", "common", "place", "component", "sig", "outside")])
    # What the two must share at least, by their sizes: with it either side's prefix is shorter still.
    both = f"CAST(ceil({plan.threshold} * (x_n + y_n) / {100 + plan.threshold}D - 1e-9) AS INT)"
    pairs = side(first.where("outside"), "x").join(side(first, "y"), "shingle").where(
        f"x_component <> y_component AND (NOT y_outside OR x_node < y_node) AND {_sized(plan)}"
        f" AND {100 + plan.threshold} * least(x_common, y_common) >= {plan.threshold} * (x_n + y_n)"
        f" AND x_place <= x_common - {both} + 1 AND y_place <= y_common - {both} + 1"
        f" AND size(filter(zip_with(x_sig, y_sig, (a, b) -> a = b), e -> e)) >= {plan.least_agreed}"
    )
    return pairs.select(F.least("x_node", "y_node").alias("x"), F.greatest("x_node", "y_node").alias("y")).distinct()


def one_of_each(docs: DataFrame, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows of near-duplicates but the smallest id's; rows that repeat an id stay or go together, rows with a null id stay."""
    keep = near_duplicates(docs, threshold, id_col, text_col).where("kept AND id IS NOT NULL").select(F.col("id").alias("__id")).distinct()
    kept = docs.join(keep, F.col(id_col).cast("long") == F.col("__id"), "left_semi")
    return kept.unionByName(docs.where(F.col(id_col).isNull())).select(docs.columns)


def op2(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")
