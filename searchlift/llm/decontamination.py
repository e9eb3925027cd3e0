"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

The 13-word windows of all benchmark items (an item of fewer words is one window) go to every
task as a hash set: a constant array of buckets inside the plan, so that looking a window up costs
the same however many there are. Each document is scanned in its row, and nothing is shuffled: a
window of the document whose 64-bit hash is in the set is a candidate, and is a hit only if its
words equal a benchmark window's. Beyond MAX_WINDOWS windows only those that occur in the documents
at all (a join on distinct hashes tells) go into sets, one after the other if they are still too many.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z alone. Candidates are sought
on fully lower-cased words with one small sigma (lower-casing picks it by what follows), which can
only add some; the exact rule decides on them.

Defined results: null and wordless texts have no words and no hits and are clean; very long texts
are scanned whole, in their row; rows that repeat id and text get the same figures each; a null id
is an id of its own; an empty benchmark hits nothing, and no documents give no rows; of items with
equal text each counts; input columns with the names of added columns are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchlift.llm.common import as_data, free_name, materialise, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: WORDS before lower-casing.
WORDS_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: About 20 MB of hashes and words: the bound of what is broadcast (pairs of a window and an item).
MAX_WINDOWS = 200_000
ADDED = ("n_words", "hits", "items", "n_hit", "contaminated")
HIT = "struct<start: int, len: int, words: string, items: array<string>>"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def windows(benchmark: DataFrame, n: int = 13, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows: words (joined by spaces), len, loose (hash of the fully lower-cased words), items (sorted strings)."""
    w = benchmark.select(F.col(item_col).cast("string").alias("item"), _words(ascii_lower(F.coalesce(F.col(text_col), F.lit("")))).alias("w")).where("size(w) > 0")
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))))
    w = w.withColumn("at", at).select("item", F.slice("w", F.col("at"), F.least(F.lit(n), F.size("w"))).alias("w"))
    w = w.groupBy(F.array_join("w", " ").alias("words"), F.size("w").alias("len")).agg(F.sort_array(F.collect_set("item")).alias("items"))
    return w.withColumn("loose", F.xxhash64(F.split(F.expr("replace(lower(words), 'ς', 'σ')"), " ")))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once however often body and the filters above name it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def loose_words(text: Column) -> Column:
    return F.regexp_extract_all(F.replace(F.lower(text), F.lit("ς"), F.lit("σ")), F.lit(WORDS), F.lit(0))


def _hashed(w: Column, n: int) -> Column:
    """The hashes of the windows of n words, in order."""
    starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, n)))


def _candidates(hashes: Column, n: int, known: Callable[[Column], Column]) -> Column:
    """start, len and hash of the windows whose hash is known; most texts have none and get no further than the look at each."""
    placed = lambda hs: F.filter(F.transform(hs, lambda h, i: F.struct((i + 1).alias("start"), F.lit(n).alias("len"), h.alias("hash"))), lambda x: known(x.hash))
    return _let(hashes, lambda hs: F.when(F.exists(hs, known), placed(hs)).otherwise(F.array().cast("array<struct<start: int, len: int, hash: bigint>>")))


def _hits(text: Column, rows: list) -> Callable[[Column], Column]:
    """loose words of the text -> the hits of the windows (len, loose, words, items) in rows."""
    size = 1 << max(1, len(rows) - 1).bit_length()
    hashes, exact = [set() for _ in range(size)], [[] for _ in range(size)]
    for r in rows:
        hashes[r.loose & (size - 1)].add(r.loose)
        exact[r.loose & (size - 1)].append({"words": r.words, "items": r["items"]})
    hash_set, word_set = as_data([sorted(x) for x in hashes], "array<bigint>"), as_data(exact, "array<struct<words: string, items: array<string>>>")
    bucket = lambda h: h.bitwiseAND(F.lit(size - 1)).cast("int")
    words = F.regexp_extract_all(ascii_lower(text), F.lit(WORDS), F.lit(0))

    def verified(a: Column, e: Column) -> Column:
        said = F.transform(a, lambda x: F.struct(x.start.alias("start"), x.len.alias("len"), F.array_join(F.slice(e, x.start, x.len), " ").alias("words"), x.hash.alias("hash")))
        known = F.transform(said, lambda x: F.struct(x.start.alias("start"), x.len.alias("len"), x.words.alias("words"), F.get(F.filter(F.get(word_set, bucket(x.hash)), lambda y: y.words == x.words), F.lit(0)).items.alias("items")))
        return F.filter(known, lambda x: x.items.isNotNull())

    def hits(w: Column) -> Column:
        none = F.array().cast(f"array<{HIT}>")
        if not rows:
            return none
        known = lambda h: F.array_contains(F.get(hash_set, bucket(h)), h)
        at = F.concat(*[_candidates(_hashed(w, n), n, known) for n in sorted({r.len for r in rows})])
        # The text is split again by the exact rule only if some window is in the set.
        return _let(at, lambda a: F.when(F.size(a) > 0, _let(words, lambda e: verified(a, e))).otherwise(none))

    return hits


def _judged(n_words: Column, hits: Column, share: int) -> Column:
    places = F.array_distinct(F.flatten(F.transform(hits, lambda x: F.sequence(x.start, x.start + x.len - 1))))
    n_hit = F.when(F.size(hits) > 0, F.size(places)).otherwise(0).cast("long")
    items = F.array_distinct(F.flatten(F.transform(hits, lambda x: x.items)))
    slim = F.transform(hits, lambda x: F.struct(x.start.alias("start"), x.len.alias("len"), x.words.alias("words")))
    return _let(n_hit, lambda n: F.struct(n_words.cast("long").alias("n_words"), slim.alias("hits"), items.alias("items"), n.alias("n_hit"), ((n > 0) & (n * share >= n_words)).alias("contaminated")))


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 13, text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text", share: int = 20) -> DataFrame:
    """docs with n_words, hits (array of start, len, words), items (whose windows occur), n_hit and contaminated (share * n_hit >= n_words)."""
    docs = free_name(docs, *ADDED)
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = materialise(windows(benchmark, n, item_col, bench_text_col), "windows")
    size = lambda: found.agg(F.coalesce(F.sum(F.size("items")), F.lit(0))).first()[0]
    if size() > MAX_WINDOWS:
        lengths = [r[0] for r in found.select("len").distinct().collect()]  # at most n
        every = docs.select(loose_words(text).alias("w")).select(F.explode(F.concat(*[_hashed(F.col("w"), k) for k in lengths])).alias("loose"))
        found = materialise(found.join(every.distinct(), "loose", "left_semi"), "windows")
    parts = -(-size() // max(1, MAX_WINDOWS))
    if parts <= 1:
        hits = _hits(text, found.collect())
        whole = _let(loose_words(text), lambda w: _let(hits(w), lambda h: _judged(F.size(w), h, share)))
        return docs.withColumn("__s", whole).select(*docs.columns, "__s.*")
    out = docs.withColumn("__h", F.array().cast(f"array<{HIT}>"))
    for k in range(parts):
        hits = _hits(text, found.where(F.pmod(F.xxhash64("words"), F.lit(parts)) == k).collect())
        out = materialise(out.withColumn("__h", F.concat("__h", _let(loose_words(text), hits))), "windows-part")
    return out.withColumn("__s", _judged(F.size(loose_words(text)), F.col("__h"), share)).select(*docs.columns, "__s.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", text_col: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated; or, in mode 'spans', all of them with the words of hits cut out."""
    scanned = scan(docs, benchmark, text_col=text_col, **options)
    if mode == "documents":
        return scanned.where(~F.col("contaminated")).select(docs.columns)
    # Splitting around words gives the text before, between and after them: piece i stands before word i.
    gaps = F.split(F.col(text_col), WORDS_ANY_CASE, -1)
    words = F.regexp_extract_all(F.col(text_col), F.lit(WORDS_ANY_CASE), F.lit(0))
    gone = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h.start, h.start + h.len - 1))))
    cut = scanned.withColumns({"__gone": gone, "__gaps": gaps, "__words": words})
    kept = F.expr("array_join(transform(__gaps, (g, i) -> CASE WHEN array_contains(__gone, i + 1) THEN CASE WHEN array_contains(__gone, i) THEN '' ELSE g END ELSE CASE WHEN array_contains(__gone, i) THEN concat(' ', coalesce(try_element_at(__words, i + 1), '')) ELSE concat(g, coalesce(try_element_at(__words, i + 1), '')) END END), '')")
    return cut.withColumn(text_col, F.when(F.size("hits") > 0, kept).otherwise(F.col(text_col))).select(docs.columns)


def with_items(scanned: DataFrame) -> DataFrame:
    """The figures of every scanned row with the number and the digest of the items it hits."""
    digest = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return scanned.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op9(spark, sf_dir):
    return with_items(scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")))
