"""Sharding, mixing, exact dedup and decontamination against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from searchlift.llm import decontamination, exact_dedup, mixing, sharding

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


def check_shards(rows, n):
    size, slots = Counter(), defaultdict(list)
    for r in rows:
        size[r.shard] += int(r["size"])
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return [size[k] for k in range(n)]


def test_shards_are_near_equal_and_whole(docs, rows):
    out = sharding.shard_documents(docs, n_shards=6).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in rows)
    assert all(r["size"] == len((r.text or "").encode()) + 8 and r.text_crc32 == zlib.crc32((r.text or "").encode()) for r in out)
    sizes = check_shards(out, 6)
    longest = max(len(r.text.encode()) for r in rows)
    assert max(sizes) - min(sizes) <= longest + 0.02 * sum(sizes) / 6


def test_hot_group_is_split(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.concat(F.lit("text "), F.lpad(F.col("id").cast("string"), 8, "0"))).alias("text"))
    out = sharding.shard_documents(docs, n_shards=24)
    sizes = check_shards(out.collect(), 24)
    assert max(sizes) <= 1.02 * sum(sizes) / 24 + 30
    assert out.where("text = 'the same text'").select("shard").distinct().count() <= 10


def test_shards_agree_on_reruns(docs):
    cols = ["doc_id", "shard", "slot"]
    assert sorted(map(tuple, sharding.shard_documents(docs).select(cols).collect())) == sorted(map(tuple, sharding.shard_documents(docs.repartition(7)).select(cols).collect()))


def test_shard_edges(edge_docs, no_docs):
    out = sharding.shard_documents(edge_docs, n_shards=3)
    assert [c.lower() for c in out.columns].count("shard") == 1 and [c.lower() for c in out.columns].count("size") == 1
    got = out.collect()
    assert len(got) == 11 and all(r["size"] == 8 and r.text_crc32 == 0 for r in got if not r.text)
    check_shards(got, 3)
    assert sharding.shard_documents(no_docs).count() == 0


def expected_targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in stopped)
        open_ = [s for s in names if s not in stopped]
        share = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            return {s: float(cap * sizes[s]) if s in stopped else share[s] for s in names}
        stopped |= over


def test_mix(docs, rows):
    out = mixing.mix(docs, block_words=16).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        sizes[r.source] += count(r.text)
    assert sorted(r.id for r in out) == sorted(r.doc_id for r in rows)
    for r in out:
        assert r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    want = expected_targets(sizes)
    assert all(abs(target[s] - want[s]) < 1e-6 for s in want)
    assert all(abs(taken[s] - want[s]) <= 16 * 4 for s in want)


def test_mix_small_sources_stop_at_the_cap(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 9 + 1).cast("int")).alias("text"), F.when(F.col("id") < 4, "tiny").when(F.col("id") < 8, F.lit(None)).otherwise("big").alias("source"))
    out = mixing.mix(docs, block_words=4).collect()
    sizes = Counter()
    for r in out:
        sizes[r.source] += r["size"]
    want = expected_targets(sizes)
    got = Counter()
    for r in out:
        assert abs(r.target - want[r.source]) < 1e-6 and r.taken <= 3 * r["size"]
        got[r.source] += r.taken
    assert all(abs(got[s] - want[s]) <= 16 for s in want)


def test_mixed_documents_hold_the_taken_words(docs):
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r.source] += count(r.text)
        assert r.n_chars == len(r.text)
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += count(r.text)
    want = expected_targets(sizes)
    assert all(abs(words[s] - want[s]) <= 64 * 4 for s in want)


def test_mix_edges(edge_docs, no_docs):
    out = mixing.mix(edge_docs).collect()
    assert len(out) == 11 and all(r.taken == 0 for r in out if r["size"] == 0)
    assert mixing.mixed_documents(edge_docs).columns == edge_docs.columns
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0


def test_slots_are_low_discrepancy(spark, docs):
    sized = docs.select("source", F.lit(50).cast("long").alias("size"))
    targets = mixing.source_targets(sized).cache()
    slots = mixing.schedule(targets, 8, chunk=64).collect()
    total = sum(r.target for r in targets.collect())
    for r in targets.collect():
        mine = sorted((s.rank, s.slot) for s in slots if s.source_id == r.source_id)
        assert [k for k, _ in mine] == list(range(len(mine)))
        assert abs(len(mine) - r.target / total * len(slots)) <= 3


def duplicates_of(rows):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in enumerate(r[1] for r in rows)}
    by = defaultdict(list)
    for i, r in enumerate(rows):
        by[norm[i]].append(r[0])
    low = {n: min((x for x in ids if x is not None), default=None) for n, ids in by.items()}
    return sorted(((r[0] is None, r[0] or 0), low[norm[i]], len(by[norm[i]]), hashlib.sha256(norm[i].encode()).hexdigest()) for i, r in enumerate(rows))


def keyed(out):
    return sorted(((r.id is None, r.id or 0), r.keep_id, r.group_size, r.text_sha256) for r in out)


@pytest.mark.parametrize("files", [None, 1])
def test_exact_dedup(spark, edge_docs, tmp_path, files):
    path = f"file://{tmp_path}/docs"
    edge_docs.repartition(3).write.parquet(path)
    out = exact_dedup.duplicates(spark, path, files_per_batch=files).collect()
    assert keyed(out) == duplicates_of([(r.doc_id, r.text) for r in edge_docs.collect()])
    assert all(r.kept == (r.id == r.keep_id) for r in out)


def test_exact_dedup_tells_colliding_digests_apart(spark, edge_docs, tmp_path):
    path = f"file://{tmp_path}/docs"
    edge_docs.write.parquet(path)
    weak = lambda t: F.substring(exact_dedup.sha256(t), 1, 0)
    out = exact_dedup.duplicates(spark, path, digest=weak).collect()
    assert keyed(out) == duplicates_of([(r.doc_id, r.text) for r in edge_docs.collect()])


def test_exact_dedup_goes_on_from_its_state(spark, edge_docs, tmp_path):
    path, state = f"file://{tmp_path}/docs", f"file://{tmp_path}/state"
    edge_docs.where("doc_id > 2").write.parquet(path)
    exact_dedup.duplicates(spark, path, state_dir=state).collect()
    edge_docs.where("doc_id <= 2 OR doc_id IS NULL").write.mode("append").parquet(path)
    out = exact_dedup.duplicates(spark, path, state_dir=state).collect()
    assert keyed(out) == duplicates_of([(r.doc_id, r.text) for r in edge_docs.collect()])


def test_exact_dedup_of_nothing(spark, no_docs, tmp_path):
    no_docs.write.parquet(f"file://{tmp_path}/docs")
    assert exact_dedup.duplicates(spark, f"file://{tmp_path}/docs").count() == 0


def contaminated_by_hand(docs, bench):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {tuple(w[i : i + 13]) for b in bench for w in [words(b)] if w for i in range(max(1, len(w) - 12))}
    out = []
    for t in docs:
        w, hit = words(t), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
        out.append((len(w), len(hit), bool(hit) and 20 * len(hit) >= len(w)))
    return out


BENCH = [(1, "The quick brown fox jumps over the lazy dog again and again until night"), (2, "Kurz UND gut"), (3, None), (4, "..."), (5, "KURZ und GUT"), (6, "Élan ÉLAN élan")]
TEXTS = ["x the QUICK brown fox, jumps over the lazy dog again and again until y", "kurz und gut", "kurz und " + "wort " * 100 + " kurz, und gut", None, "", "the quick brown fox", "élan élan élan", "Élan élan élan", "Élan Élan Élan", "Élan ÉLAN élan"]


@pytest.mark.parametrize("bound", [200_000, 2])
def test_decontamination(spark, monkeypatch, bound):
    monkeypatch.setattr(decontamination, "MAX_WINDOWS", bound)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    out = decontamination.scan(docs, bench).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in out] == contaminated_by_hand(TEXTS, [b for _, b in BENCH])
    kept = decontamination.decontaminate(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, x in enumerate(contaminated_by_hand(TEXTS, [b for _, b in BENCH])) if not x[2]]
    spans = {r.doc_id: r.text for r in decontamination.decontaminate(docs, bench, mode="spans").collect()}
    assert "und gut" not in spans[2] and spans[2].startswith("kurz und wort") and spans[3] is None and spans[5] == TEXTS[5]


def test_decontamination_of_the_table(spark, docs, rows):
    out = {r.doc_id: (r.n_words, r.n_hit, r.contaminated) for r in decontamination.op9(spark, SF).collect()}
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert [out[r.doc_id] for r in rows] == contaminated_by_hand([r.text for r in rows], bench)


def test_decontamination_edges(spark, edge_docs, no_docs):
    bench = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    out = decontamination.scan(edge_docs, bench)
    assert sorted(r.doc_id for r in out.where("contaminated").collect()) == [1, 1, 2, 8]
    assert decontamination.scan(edge_docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontamination.scan(no_docs, bench).count() == 0


def test_exact_dedup_folds_its_updates(spark, edge_docs, tmp_path, monkeypatch):
    """Many small runs on one state: the folders of updates stay few, and session settings are as before."""
    monkeypatch.setattr(exact_dedup, "MOST_UPDATES", 2)
    path, state = f"file://{tmp_path}/docs", f"file://{tmp_path}/state"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for part in range(5):
        edge_docs.where(f"pmod(coalesce(doc_id, 0), 5) = {part}").coalesce(1).write.mode("append").parquet(path)
        out = exact_dedup.duplicates(spark, path, state_dir=state).collect()
        assert keyed(out) == duplicates_of([(r.doc_id, r.text) for r in spark.read.parquet(path).collect()])
    assert len(list((tmp_path / "state/updates").glob("batch=*"))) <= 3
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


@pytest.mark.parametrize("bound", [0, 500_000])
def test_exact_dedup_with_hits_shuffled_and_hot_groups(spark, tmp_path, monkeypatch, bound):
    monkeypatch.setattr(exact_dedup, "BROADCAST_HITS", bound)
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "copy  of one").when(F.col("id") % 5 == 0, F.concat(F.lit("few "), (F.col("id") % 7).cast("string"))).otherwise(F.concat(F.lit("own\t"), F.col("id").cast("string"))).alias("text"))
    path = f"file://{tmp_path}/docs"
    docs.write.parquet(path)
    out = exact_dedup.duplicates(spark, path).collect()
    assert keyed(out) == duplicates_of([(r.doc_id, r.text) for r in docs.collect()])
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in out:
        # The locator leads to the content of the row that stays.
        assert text[r.id].split() == text[r.keep_id].split() and r.locator.file and r.locator.row >= 0
