"""Mixing sources to target weights by a low-discrepancy schedule.

Slot k of the mix has the golden-ratio point frac(k * 0.618...), kept as a 31-bit fixed-point
number so that every engine computes the same one. The point falls into the cumulative target
shares and so names the slot's source; the slot's rank among its source's slots is the number of
the block that it takes. A source's blocks cut the stream of its documents, shuffled by md5 of
the id and repeated up to the cap, into equal numbers of words. What is taken of a source is its
target to the word: the last block is cut there, slots beyond it take nothing, and blocks that the
schedule has not reached by its end follow it.

Defined results: a null text has size 0; a null source is a source of its own, last in order;
documents without words are taken 0 times, and the mix itself leaves them out; very long texts span
as many blocks as they need; an empty table gives no rows; rows that repeat an id are separate
documents, each with its own columns (an id that holds a thousandth of all rows and a thousand
rows at least is shuffled by the rows' places, too, so that no range holds it whole); rows that are equal in all columns are taken as often as all
of them are; input columns with the names of added columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from searchlift.llm.common import WORD, as_data, free_name, materialise, table

#: 2**31 divided by the golden ratio, made odd; and 2**31.
STEP, CIRCLE = 1327217885, 2**31
ADDED = ("size", "source_size", "target", "taken")
#: Rows that one range of a source's shuffled stream should hold.
RANGE_ROWS = 1_000
#: Rows from which on an id counts as much repeated.
HOT_ID_ROWS = 1_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """sizes (source, size) -> one row per source: source_id, source_size, target, upto (cumulative target).

    Targets share the total by weight; at cap times its source's size a target stops and the
    excess is shared again by weight. In order of cap * size / weight the stopped sources come
    first, so one pass over the sources finds the level of the rest.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    wave = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("source_id") % len(weights)) + 1).cast("int"))
    s = by_source.withColumn("source_id", F.row_number().over(ordered) - 1).withColumn("weight", wave.cast("long"))
    every = Window.partitionBy()
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), "source_id")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({"total": F.sum("source_size").over(every), "stopped": F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0)), "open": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))})
    level = (F.col("total") - F.col("stopped")).cast("double") / F.col("open")
    s = s.withColumn("level", F.when(level * F.col("weight") <= F.col("source_size") * cap, level))
    s = s.withColumn("level", F.max("level").over(every))
    # The first level that its own source can hold is the one that holds; later ones are equal or lower.
    s = s.withColumn("target", F.least(F.col("level") * F.col("weight"), (F.col("source_size") * cap).cast("double")))
    upto = F.sum("target").over(Window.orderBy("source_id").rowsBetween(Window.unboundedPreceding, 0))
    return s.withColumn("upto", upto).select("source", "source_id", "source_size", "target", "upto", "total")


def _reached(edges: Column, n: int, at: Column) -> Column:
    """How many of the n sorted edges are at most `at`: a binary search."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))]).cast("array<int>")
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when((low + step <= n) & (F.get(edges, low + step - 1) <= at), low + step).otherwise(low))


def schedule(targets: DataFrame, block_words: int = 64, chunk: int = 1 << 16) -> DataFrame:
    """(slot, source_id, rank): rank counts the slots of the source before this one.

    Ranks come in two steps, inside chunks of slots and over the chunks' counts, so that no
    task gathers all slots of a source.
    """
    spark = targets.sparkSession
    rows = targets.orderBy("source_id").collect()  # one row for each source
    total = rows[0].total if rows else 0
    if not total:
        return spark.createDataFrame([], "slot long, source_id int, rank long")
    edges = as_data([r.upto for r in rows[:-1]], "double")
    n = -(-total // block_words)
    point = ((F.col("slot") % CIRCLE) * STEP) % CIRCLE
    at = (point.cast("double") + 0.5) / CIRCLE * float(total)
    slots = spark.range(n).select(F.col("id").alias("slot")).withColumns({"source_id": _reached(edges, len(rows) - 1, at), "chunk": F.expr(f"slot div {chunk}")})
    counts = slots.groupBy("source_id", "chunk").count()
    first = counts.select("source_id", "chunk", (F.sum("count").over(Window.partitionBy("source_id").orderBy("chunk")) - F.col("count")).alias("first"))
    in_chunk = F.row_number().over(Window.partitionBy("chunk", "source_id").orderBy("slot")) - 1
    return slots.withColumn("in_chunk", in_chunk).join(first, ["source_id", "chunk"]).select("slot", "source_id", (F.col("first") + F.col("in_chunk")).alias("rank"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, block_words: int = 64, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, size, source_size, target, taken (words, repeats counted)."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), name.alias("name"), F.monotonically_increasing_id().alias("row"))
    sized = materialise(sized, "mix-sizes")
    # Ids that hold many rows: a thousand of them at most.
    hot = [r[0] for r in sized.groupBy("name").count().where(F.col("count") >= max(HOT_ID_ROWS, sized.count() // 1_000)).select("name").collect()]
    drawn = F.when(F.col("name").isin(hot), F.concat("name", F.lit(":"), F.col("row").cast("string"))).otherwise(F.col("name")) if hot else F.col("name")
    sized = sized.withColumn("draw", F.md5(drawn.cast("binary"))).drop("name")
    targets = materialise(source_targets(sized, weights, cap), "mix-targets")
    return _taken(sized, targets, cap, block_words)


#: Words that are taken of a source: its target, to the word.
EXACT = "CAST(floor(target + 0.5) AS BIGINT)"


def _used(slots: DataFrame, targets: DataFrame, block_words: int) -> DataFrame:
    """(source_id, block): what the schedule takes up to each source's target, and the blocks before the target that it has not reached."""
    need = targets.select("source_id", F.expr(f"CAST(ceil({EXACT} / {block_words}D) AS BIGINT)").alias("need"))
    reached = slots.groupBy("source_id").agg(F.count("*").alias("have"))
    rest = need.join(reached, "source_id", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < need").select("source_id", F.explode(F.expr("sequence(have, need - 1)")).alias("block"))
    return slots.join(need, "source_id").where("rank < need").select("source_id", F.col("rank").alias("block")).unionByName(rest)


def _taken(sized: DataFrame, targets: DataFrame, cap: int, block_words: int) -> DataFrame:
    slots = schedule(targets, block_words)
    # Places in the shuffled stream of the source: prefix sums inside ranges of the draw, and over the ranges.
    # The ranges follow the rows, so that none holds more than about RANGE_ROWS of them.
    n_rows, digits = sized.count(), 1
    while 16**digits * RANGE_ROWS < n_rows:
        digits += 1
    known = sized.join(targets.select("source", "source_id", "source_size", "target"), sized["source"].eqNullSafe(targets["source"])).select("id", "row", sized["source"], "size", "draw", "source_id", "source_size", "target", F.substring("draw", 1, digits).alias("part"))
    parts = known.groupBy("source_id", "part").agg(F.sum("size").alias("part_size"))
    parts = parts.select("source_id", "part", (F.sum("part_size").over(Window.partitionBy("source_id").orderBy("part")) - F.col("part_size")).alias("part_start"))
    inside = F.sum("size").over(Window.partitionBy("source_id", "part").orderBy("draw", "id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = known.withColumn("inside", inside).join(parts, ["source_id", "part"]).withColumn("start", F.col("part_start") + F.col("inside")).drop("part", "inside", "part_start")
    placed = materialise(placed, "mix-places")
    # Block b of the repeated stream has the words b * block_words and on; it ends at cap times the source.
    block = F.explode(F.sequence(F.expr(f"(start + turn * source_size) div {block_words}"), F.expr(f"(start + turn * source_size + size - 1) div {block_words}")))
    turns = F.expr(f"sequence(0, CAST(least({cap - 1}, floor(target / source_size)) AS INT))")
    pieces = (
        placed.where("size > 0").withColumn("turn", F.explode(turns)).where(F.expr(f"start + turn * source_size < {EXACT}"))
        .withColumn("block", block)
        .withColumn("words", F.expr(f"least((block + 1) * {block_words}, start + turn * source_size + size, {EXACT}) - greatest(block * {block_words}, start + turn * source_size)"))
        .where("words > 0")
        .select("row", "source_id", "block", "words")
    )
    used = _used(slots, targets, block_words)
    taken = pieces.join(used, ["source_id", "block"]).groupBy("row").agg(F.sum("words").alias("taken"))
    return placed.join(taken, "row", "left").select("id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken whole, and its first words where the last turn takes a part.

    The taken words of a source are a run of its repeated stream from the start, so only the
    document at the run's end gives a part.
    """
    id_col, text_col, source_col = options.get("id_col", "doc_id"), options.get("text_col", "text"), options.get("source_col", "source")
    every = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumns({"__k1": F.xxhash64(*every), "__k2": F.xxhash64(F.lit(1), *every)})
    slim = keyed.select(F.struct(id_col, "__k1", "__k2").alias("__doc"), text_col, source_col)
    found = mix(slim, **(options | {"id_col": "__doc"})).where("taken > 0")
    # Rows that are equal in all columns are interchangeable: whole turns add up, and a source's run ends in one part at most.
    times = found.groupBy("id.__k1", "id.__k2").agg(F.first("size").alias("__size"), F.sum(F.expr("taken div size")).alias("__whole"), F.collect_list(F.expr("CASE WHEN taken % size > 0 THEN taken % size END")).alias("__parts"))
    # Of equal rows one goes on; the rank is cut before the shuffle, so that a much repeated row stays small.
    one = keyed.withColumn("__n", F.row_number().over(Window.partitionBy("__k1", "__k2").orderBy("__k1"))).where("__n = 1").drop("__n")
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)), F.lit(1), F.col("__part").cast("int")), " ")
    out = one.join(times, ["__k1", "__k2"]).withColumn("__part", F.explode(F.expr("concat(array_repeat(0L, CAST(__whole AS INT)), __parts)")))
    out = out.withColumn(text_col, F.when(F.col("__part") > 0, cut).otherwise(F.col(text_col)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def op3(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
