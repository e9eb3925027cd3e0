"""Document fingerprints by closed syncmers.

The units of a text are its words (A-Z lower-cased); a word is cut into pieces of 32 characters, and a
letter of a script that is written without spaces is a unit of its own. Every run of k = 5 units whose
smallest run of s = 2 units, by hash, lies at its front or its back is an anchor: its place times 2**32 plus a 32-bit
hash. Whether a run is an anchor depends on nothing around it, so an edit touches only the anchors that
overlap it, and equal passages have equal anchors wherever they stand. The likeness of two fingerprints
is Dice's over the distinct hashes, or over the anchors, which then count at the same place only.

Defined results: a null text counts as empty; without units a fingerprint is empty, and two empty ones
are alike (1.0); fewer than k units are one anchor; very long texts are read whole. The document after
another is the one with the next smaller id, null ids last, and the first follows the last (the only one
follows itself). Rows that repeat an id follow each other in an order drawn by hash from their place in
the input, if the id holds the rows of several cells, so that these are sorted in many tasks; an input that
comes from a shuffle should then be written first, as its places may change, which is an error. An empty table gives no rows; input columns
with the names of added columns are replaced.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from searchlift.llm.common import as_data, free_name, table
from searchlift.llm.decontamination import ascii_lower
from searchlift.llm.sharding import KEY, key_place

#: Blocks of scripts that are written without spaces: Thai and Lao, Burmese, Khmer, and the Han and Kana ones. Ranges cost a tenth of script classes.
UNSPACED = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u2E80-\u2FDF\u3005-\u30FF\u31F0-\u31FF\u3400-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
UNITS = rf"[{UNSPACED}]|[^\x20\x09-\x0D{UNSPACED}]{{1,32}}"
LOW = 0xFFFFFFFF
#: Rows that a cell of the order should hold, and how many cells there are at most: 100 TB make cells of about 1.5 GB, sorted on disk.
CELL_ROWS, MOST_CELLS = 1_000, 1 << 16
TOP = 2**62
ADDED = ("n_chars", "edited_text", "anchors", "edited_anchors", "hashes", "edited_hashes", "next_hashes")


def let(value: Column, body) -> Column:
    """body of the value, which is computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def anchors(text: Column, k: int = 5, s: int = 2) -> Column:
    """The anchors of a text in order: the unit's place in the upper, the hash in the lower 32 bits."""
    wide = k - s + 1
    none = F.array().cast("array<bigint>")
    place = lambda i, units: F.shiftleft(i.cast("bigint"), 32).bitwiseOR(units.bitwiseAND(F.lit(LOW)))

    def closed(h: Column) -> Column:
        # Runs of s units at 0, s, 2s, ... and at the end cover the k units; their hashes stand for them.
        units = lambda i: F.xxhash64(*[F.get(h, i + j) for j in sorted({*range(0, wide, s), wide - 1})])
        inner = lambda i: [F.get(h, i + j) for j in range(1, wide - 1)]
        least = lambda xs: F.least(*xs) if len(xs) > 1 else xs[0]
        edge = lambda x, i: (F.least(x, F.get(h, i + (wide - 1))) <= least(inner(i))) if wide > 2 else F.lit(True)
        return F.filter(F.transform(h, lambda x, i: F.when(F.get(h, i + (wide - 1)).isNotNull() & edge(x, i), place(i, units(i)))), lambda x: x.isNotNull())

    def of(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(w) - s))
        hashed = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(s)]))
        return F.when(F.size(w) >= k, let(hashed, closed)).when(F.size(w) > 0, F.array(place(F.lit(0), F.xxhash64(w)))).otherwise(none)

    return let(F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(UNITS), F.lit(0)), of)


def shown(a: Column) -> Column:
    """Anchors as text: decimal numbers, comma-joined."""
    return F.array_join(a.cast("array<string>"), ",")


def hashes(a: Column) -> Column:
    """The distinct hashes of anchors."""
    return F.array_distinct(F.transform(a, lambda x: x.bitwiseAND(F.lit(LOW))))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: Dice's coefficient of two lists of distinct numbers: of hashes, wherever they stand, or of anchors, so that only what stands at the same place counts."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cell_rows: int = CELL_ROWS) -> DataFrame:
    """docs (id, text) with __cell and __seq, ordered inside a cell by __copy and __seq; the first row of each cell stands at the end of the cell before, too, as a copy.

    Three jobs: quantiles of the ids, the first key of each cell (one row for each cell comes to the
    driver), and the exchange, in which every text moves once.
    """
    order = F.bitwise_not(F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(2**63))))
    keyed = docs.select("*", order.alias("__u"))
    n = min(MOST_CELLS, max(1, docs.select(id_col).count() // cell_rows))
    found = keyed.select(F.percentile_approx("__u", [i / n for i in range(1, n)], max(10_000, 20 * n))).first()[0] if n > 1 else None
    splits, hot = [], []
    for u, m in sorted(Counter(found or []).items()):
        # An id that holds m quantiles is cut in m by its draw; the place of other rows plays no part in their cell.
        splits += [{"u": u, "v": TOP * j // m} for j in range(1, m + 1)]
        hot += [u] if m > 1 else []
    draw = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 2)
    keyed = keyed.select("*", F.when(F.col("__u").isin(hot), draw).otherwise(F.lit(0)).alias("__v") if hot else F.lit(0).cast("bigint").alias("__v"))
    near = key_place(as_data(splits, KEY), len(splits)) if splits else F.lit(0)
    firsts = keyed.groupBy(near.alias("cell")).agg(F.min(F.struct(F.col("__u").alias("u"), F.col("__v").alias("v"))).alias("key")).collect()
    heads = sorted((r.key.u, r.key.v) for r in firsts)
    if not heads:
        return keyed.select("*", F.lit(0).alias("__cell"), F.lit(0).alias("__copy"))
    known = as_data([{"u": u, "v": v} for u, v in heads], KEY)
    at = key_place(known, len(heads)) - 1
    placed = keyed.withColumn("__at", at).withColumn("__head", F.get(known, F.col("__at")) == F.struct(F.col("__u").alias("u"), F.col("__v").alias("v")))
    cell = lambda c, copy: F.struct(c.cast("int").alias("__cell"), F.lit(copy).alias("__copy"))
    own, before = cell(F.col("__at"), 0), cell(F.pmod(F.col("__at") - 1, F.lit(len(heads))), 1)
    return placed.withColumn("__c", F.explode(F.when(F.col("__head"), F.array(own, before)).otherwise(F.array(own)))).select("*", "__c.*").drop("__c", "__at", "__head")


def edited(docs: DataFrame, k: int = 5, s: int = 2, id_col: str = "doc_id", text_col: str = "text", cell_rows: int = CELL_ROWS) -> DataFrame:
    """docs with n_chars, edited_text, the anchors of the text and of the edited text, and the hashes of both and of the next document.

    The edited text has the last third of its code points replaced by as many first ones of the next document.
    """
    docs = free_name(docs, *ADDED)
    kept = docs.columns
    in_order = Window.partitionBy("__cell").orderBy("__copy", "__u", "__v")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = with_next(docs, id_col, text_col, cell_rows).withColumn("__text", text).withColumns({"__next": F.lead("__text").over(in_order), "n_chars": F.length("__text").cast("bigint")})
    third = F.expr("CAST(n_chars div 3 AS INT)")
    rows = rows.withColumn("anchors", anchors(F.col("__text"), k, s)).withColumn("hashes", hashes(F.col("anchors"))).withColumn("next_hashes", F.lead("hashes").over(in_order)).where("__copy = 0")
    following = F.coalesce("__next", F.raise_error(F.lit("the rows of a much repeated id changed their places: write the input first")).cast("string"))
    rows = rows.withColumn("edited_text", F.concat(F.substring("__text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring(following, F.lit(1), third)))
    return rows.withColumn("edited_anchors", anchors(F.col("edited_text"), k, s)).withColumn("edited_hashes", hashes(F.col("edited_anchors"))).select(*kept, *ADDED)


def op11(spark, sf_dir):
    rows = edited(table(spark, sf_dir, "documents").select("doc_id", "text"))
    near = lambda a, b: likeness(F.col(a), F.col(b))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), shown(F.col("anchors")).alias("fingerprint"), shown(F.col("edited_anchors")).alias("edited_fingerprint"),
        near("hashes", "edited_hashes").alias("near_edited"), near("hashes", "next_hashes").alias("near_next"), near("anchors", "edited_anchors").alias("aligned_edited"),
    )
