"""Whole results of the training-data operators: every row, every column, on either side of each bound."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from searchlift.llm import decontamination, mixing, near_dedup, sharding, toxicity
from test_native import BENCH, TEXTS, check_shards, expected_targets
from test_text_operators import components_by_hand

SF = "/root/testdata/sf0.001"


def test_shards_in_many_slices(spark):
    """Slices follow the bytes: thousands of splitters, hot texts among them, and the order inside a shard is that of the keys."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    out = sharding.shard_documents(docs, n_shards=5, slice_bytes=200).collect()
    sizes = check_shards(out, 5)
    assert len(out) == 4000 and max(sizes) - min(sizes) <= 0.01 * sum(sizes) / 5 + 60
    one = sharding.shard_documents(docs, n_shards=5).collect()
    place = lambda rows: {r.doc_id: (r.shard, r.slot) for r in rows}
    other = place(one)
    near = [abs(slot - other[i][1]) for i, (shard, slot) in place(out).items() if shard == other[i][0]]
    assert len(near) >= 0.98 * 4000 and max(near) <= 0.02 * 4000


STEP, CIRCLE = 1327217885, 2**31


def taken_by_hand(docs, block, cap=3):
    """docs: (id, text, source) -> words taken of each, read word by word: those before the target, to the word.

    The slots, dealt one by one, come to the target within a few blocks; the last blocks make up the rest.
    """
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += count(t)
    target = expected_targets(sizes)
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    total, upto, edges = sum(sizes.values()), 0.0, []
    for s in names:
        upto += target[s]
        edges.append(upto)
    blocks = defaultdict(set)
    for k in range(-(-total // block)):
        at = ((k % CIRCLE * STEP) % CIRCLE + 0.5) / CIRCLE * total
        s = names[min(sum(e <= at for e in edges[:-1]), len(names) - 1)]
        blocks[s].add(len(blocks[s]))
    taken = {}
    assert all(abs(len(blocks[s]) * block - target[s]) <= 4 * block for s in names)
    for s in names:
        mine = sorted((d for d in docs if d[2] == s), key=lambda d: (hashlib.md5(str(d[0]).encode()).hexdigest(), d[0]))
        place = 0
        for turn in range(cap):
            for i, t, _ in mine:
                n = count(t)
                taken[i] = taken.get(i, 0) + sum(place + w < math.floor(target[s] + 0.5) for w in range(n))
                place += n
    return taken


def test_taken_of_each_document(spark):
    rng = random.Random(4)
    docs = [(i, " ".join("w" for _ in range(rng.randrange(0, 60))), rng.choice(["a", "b", "b", "b", "c", None])) for i in range(300)]
    out = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string"), block_words=16).collect()
    assert {r.id: r.taken for r in out} == taken_by_hand(docs, 16)


def test_rows_of_one_id_and_text_keep_their_own_columns(spark):
    rows = [(1, "w " * 400, "s1", "en"), (1, "w " * 400, "s2", "de"), (1, "w " * 400, "s2", "de"), (2, "v " * 300, "s1", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    words, langs = Counter(), set()
    for r in mixing.mixed_documents(docs, block_words=8).collect():
        words[r.source] += len(r.text.split())
        langs.add((r.source, r.lang, r.doc_id))
    want = expected_targets({"s1": 700, "s2": 800})
    assert all(abs(words[s] - want[s]) <= 8 * 4 for s in want) and langs <= {("s1", "en", 1), ("s2", "de", 1), ("s1", "fr", 2)}


@pytest.mark.parametrize("threshold", [80, 85, 90])
@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_near_duplicates_at_every_threshold_on_either_side_of_the_bound(spark, monkeypatch, threshold, broadcast):
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", broadcast)
    rng = random.Random(threshold)
    passages = [" ".join(f"p{k}x{i}" for i in range(40)) for k in range(8)]
    docs = []
    for family in range(5):
        base = [f"w{rng.randrange(300)}" for _ in range(150)]
        for _ in range(10):
            copy = list(base)
            for _ in range(rng.randrange(7)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            docs.append(" ".join(copy))
    # Documents of passages that others have too: covered by the others, few of them linked.
    docs += [" ".join(rng.sample(passages, 5)) for _ in range(60)]
    docs += ["a b c d e f", "a b c d e f g", "a b c", None, "a b c d e f", "a b c d e"]
    docs = list(enumerate(docs))
    out = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), threshold).collect()
    assert {r.id: (r.n_shingles, r.component_id) for r in out} == components_by_hand(docs, threshold)


def test_texts_of_one_id_are_one_document(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, b), (1, b), (2, b + " end"), (3, a), (4, "other words that no one has in this order"), (5, b), (5, "own text of five with some more words")]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.id, r.component_id) for r in out) == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (5, 1), (5, 1)]
    kept = near_dedup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == [1, 1, 1, 4]


def test_large_ids_beside_null_ones(spark):
    """Ids beyond 2**53 stay what they are, in a batch with null ids too."""
    a = "one two three four five six seven eight"
    rows = [(2**53 + 1, a), (2**53 + 2, a), (None, a), (None, "x"), (-(2**60) - 1, "other words of a text that stands alone")]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.id or 0, r.component_id or 0, r.kept) for r in out) == sorted([(2**53 + 1, 2**53 + 1, True), (2**53 + 2, 2**53 + 1, False), (0, 0, True), (0, 0, True), (-(2**60) - 1, -(2**60) - 1, True)])


def test_hot_classes_join_whole(spark):
    """A third of all rows are copies of one text, another third are empty."""
    docs = spark.range(1500).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "one two three four five six seven eight").when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.concat(F.lit("own words of number "), F.col("id").cast("string"))).alias("text"))
    out = near_dedup.near_duplicates(docs)
    assert out.count() == 1500 and out.where("component_id = 0").count() == 500 and out.where("kept").count() == 1001


def items_by_hand(text, bench):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    w, found = words(text), set()
    for item, t in bench:
        b = words(t)
        windows = {tuple(b[i : i + 13]) for i in range(max(1, len(b) - 12))} if b else set()
        if any(tuple(w[i : i + len(x)]) == x for x in windows for i in range(len(w) - len(x) + 1)):
            found.add(str(item))
    return len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


@pytest.mark.parametrize("bound", [200_000, 2])
def test_items_of_each_document(spark, monkeypatch, bound):
    monkeypatch.setattr(decontamination, "MAX_WINDOWS", bound)
    texts = [*TEXTS, "ΟΔΟΣ.ΑΒΓ", "a b c­d", "kurz und gut, élan élan élan"]
    bench = [*BENCH, (10, "ΟΔΟΣ.ΑΒΓ"), (11, "A B C­D"), (12, "KURZ und GUT")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = decontamination.with_items(decontamination.scan(docs, spark.createDataFrame(bench, "item_id long, text string"))).orderBy("doc_id").collect()
    assert [(r.n_items, r.items_sha256) for r in out] == [items_by_hand(t, bench) for t in texts]


def test_items_of_the_table(spark):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = decontamination.op9(spark, SF).collect()
    assert {r.doc_id: (r.n_items, r.items_sha256) for r in out} == {i: items_by_hand(t, bench) for i, t in text.items()}


@pytest.mark.parametrize("same_id", [None, 7])
def test_shards_cut_rows_that_repeat_id_and_text(spark, same_id):
    """A third of all rows are one text with one id, or without any."""
    rows = [(i, f"text {i:06d}") for i in range(2000)] + [(same_id, "the same text of every row" * 3)] * 2000
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    out = sharding.shard_documents(df, n_shards=8).collect()
    sizes = [sum(r.size for r in out if r.shard == s) for s in range(8)]
    assert len(out) == 4000 and max(sizes) - min(sizes) <= 0.02 * sum(sizes) / 8, sizes
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def test_toxicity_learns_from_one_text_of_a_repeated_id(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2]
    docs = spark.createDataFrame([(i, f"you {'idiot' if n % 2 else 'friend'} number {n} {c}") for n, i in enumerate(ids) for c in ("b", "a", "a")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, n % 2) for n, i in enumerate(ids)], "doc_id long, toxic int")
    once = docs.groupBy("doc_id").agg(F.min("text").alias("text"))
    a, b = (toxicity.train(d, labels) for d in (docs, once))
    for text in ("you idiot", "you friend", ""):
        assert a.score(text) == b.score(text)


def test_mix_meets_the_targets_of_small_sources(spark):
    """Sources under a block: two of 30 words, and two thousand of forty."""
    two = spark.createDataFrame([(i, "one two three", "ab"[i % 2]) for i in range(20)], "doc_id long, text string, source string")
    got = mixing.mix(two).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w")).collect()
    assert {r.source: (r.t, r.w) for r in got} == {"a": (20, 20.0), "b": (40, 40.0)}
    many = spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), F.lit(40)).alias("text"), F.format_string("s%05d", "id").alias("source"))
    got = mixing.mix(many).collect()
    assert all(abs(r.taken - r.target) <= 0.5 and r.taken <= 3 * r.size for r in got) and len(got) == 2000


def test_a_much_repeated_id_is_shuffled_by_places(spark, monkeypatch):
    monkeypatch.setattr(mixing, "HOT_ID_ROWS", 50)
    rows = [(None, f"w{i} " * 5, "a") for i in range(300)] + [(i, "x y z", "b") for i in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    taken = {s: sum(r.taken for r in got if r.source == s) for s in "ab"}
    assert len(got) == 600 and taken["a"] + taken["b"] == 2400 and all(r.taken <= 3 * r.size for r in got)
    assert {s: abs(t - next(r.target for r in got if r.source == s)) <= 0.5 for s, t in taken.items()} == {"a": True, "b": True}
