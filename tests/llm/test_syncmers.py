"""Closed syncmers and edited texts against plain Python over all rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from searchlift.llm import syncmers
from searchlift.llm.queries import queries

SF = "/root/testdata/sf0.001"


def plain_edits(rows):
    """(doc_id, text) -> doc_id: edited text, for distinct ids."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for i, (key, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        m = len(text) // 3
        out[key] = text[: len(text) - m] + following[:m]
    return out


def units(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[一-鿿぀-ヿ]|[^\x20\x09-\x0D一-鿿぀-ヿ]{1,32}", lower)


def shared(a, b):
    hashes = lambda f: {int(x) & syncmers.LOW for x in f.split(",") if x}
    a, b = hashes(a), hashes(b)
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def test_the_query_over_whole_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries()["op11_syncmer_fingerprints"](spark, SF).collect()}
    edits, order = plain_edits(list(docs.items())), sorted(docs, reverse=True)
    assert got.keys() == docs.keys()
    for i, key in enumerate(order):
        r = got[key]
        assert r.n_chars == len(docs[key] or "")
        assert r.edited_sha256 == hashlib.sha256(edits[key].encode()).hexdigest()
        assert r.near_edited == pytest.approx(shared(r.fingerprint, r.edited_fingerprint))
        assert r.near_next == pytest.approx(shared(r.fingerprint, got[order[(i + 1) % len(order)]].fingerprint))
    texts = {}
    for key, r in got.items():
        assert texts.setdefault(docs[key], r.fingerprint) == r.fingerprint
    long = [r for r in got.values() if r.n_chars > 400]
    assert sum(r.near_edited > r.near_next or r.near_next > 0.9 for r in long) > 0.95 * len(long)


def test_anchors_are_the_closed_syncmers(spark):
    """The runs of five units whose least run of two, by Spark's own hash, is their first or last one."""
    rows = [(i, t) for i, t in enumerate(["the quick brown fox jumps over the lazy dog " * 5, "a b", "", None, "雨が 降る日は家で本を読む", "x" * 100, "A b C d E f"])]
    df = spark.createDataFrame(rows, "i int, text string")
    runs = lambda n: F.expr(f"transform(sequence(0, greatest(0, size(w) - {n})), i -> xxhash64(get(w, i), get(w, i + 1)))")
    hashed = df.select("i", F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(syncmers.UNITS), F.lit(0)).alias("w")).select("i", "w", runs(2).alias("h"), F.xxhash64("w").alias("all"))
    hashed = hashed.withColumn("five", F.expr("transform(sequence(0, greatest(0, size(h) - 4)), i -> xxhash64(get(h, i), get(h, i + 2), get(h, i + 3)))"))
    got = {r.i: r.f for r in df.select("i", syncmers.shown(syncmers.anchors(F.col("text"))).alias("f")).collect()}
    for r in hashed.collect():
        assert r.w == units(rows[r.i][1])
        if len(r.w) < 5:
            want = [r["all"] & syncmers.LOW] if r.w else []
        else:
            want = [(i << 32) + (r.five[i] & syncmers.LOW) for i in range(len(r.w) - 4) if min(r.h[i : i + 4]) in (r.h[i], r.h[i + 3])]
        assert got[r.i] == ",".join(map(str, want))


def test_an_edit_leaves_the_anchors_beside_it(spark):
    before, after = " ".join(f"w{i}" for i in range(400)), " ".join("new" if i == 200 else f"w{i}" for i in range(400))
    a, b = (x.f.split(",") for x in spark.createDataFrame([(before,), (after,)], "t string").select(syncmers.shown(syncmers.anchors(F.col("t"))).alias("f")).collect())
    assert all(abs((int(x) >> 32) - 198) <= 5 for x in set(a) ^ set(b)) and len(set(a) & set(b)) > 150


@pytest.mark.parametrize("cell_rows", [1, 3, 1000])
def test_cells_do_not_show(spark, cell_rows):
    rows = [(i * i % 1009, f"text number {i} " * (i % 7)) for i in range(1, 60)] + [(-(2**62), "low"), (2**62, None), (None, "no id at all")]
    got = syncmers.edited(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), cell_rows=cell_rows).collect()
    assert {r.doc_id: r.edited_text for r in got} == plain_edits(rows) and len(got) == len(rows)


def test_a_hot_id_is_cut_and_loses_no_row(spark):
    df = spark.range(0, 3000, 1, 4).select(F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    cells = syncmers.with_next(df, cell_rows=100).where("__copy = 0").groupBy("__cell").count().collect()
    assert len(cells) > 20 and max(r["count"] for r in cells) < 300 and sum(r["count"] for r in cells) == 3000
    got = syncmers.edited(df, cell_rows=100).select("text", "edited_text", "next_hashes").collect()
    assert len(got) == 3000
    following = Counter(tuple(r.next_hashes) for r in got)
    assert max(following.values()) == 1  # each row follows one other row


def test_edges(spark, edge_docs, no_docs):
    got = syncmers.edited(edge_docs.withColumn("Anchors", F.lit(1)))
    assert got.count() == edge_docs.count() and set(got.columns) == set(edge_docs.columns) | set(syncmers.ADDED)
    assert syncmers.edited(no_docs).count() == 0
    one = syncmers.edited(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert one.edited_text == "abcdab"
