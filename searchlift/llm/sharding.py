"""Sharding by histogram sort.

Every document has the ordering key (u, v, w): 63 bits of a hash of the text, then 63 bits of a
hash of the id, then 63 bits of a hash of the row's place in the input, so equal texts lie side by side. The splitters of the shards are found
by counting: each round sums the exact bytes between probe keys inside the intervals that
still hold an undecided splitter, and narrows those intervals, until every splitter is within
the tolerance of its byte target (or lies between two neighbouring rows). Only then do the
rows move, once, to their slice.

Defined results: a null text counts as empty (size 8, crc32 0); a null id sorts first;
rows that repeat id and text, null ids too, are cut by their places if they are more than
a shard's tolerance (their rows are written first, so that places hold); an empty table gives no rows;
a group of equal texts is cut only where keeping it whole would break the tolerance; very long
texts count with all their bytes, and a shard exceeds its share by one text at most; input columns
with the names of added columns are replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from searchlift.llm.common import as_data, free_name, materialise

TOP = 2**63 - 1
#: Slices of a shard at least.
LEAST_SLICES = 4
ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


@dataclass(frozen=True)
class Interval:
    """Keys that may hold a splitter: those that agree with `prefix` and then lie in [lo, hi]. below: exact bytes of all rows before it."""

    prefix: tuple[int, ...]
    lo: int
    hi: int
    below: int

    @property
    def first(self) -> tuple[int, int, int]:
        return (*self.prefix, self.lo, 0, 0)[:3]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return free_name(docs, *ADDED).withColumns(
        {
            "size": (F.octet_length(text) + F.lit(8)).cast("long"),
            "text_crc32": F.crc32(text),
            "__u": F.shiftrightunsigned(F.xxhash64(text), 1),
            "__v": F.when(F.col(id_col).isNull(), F.lit(0).cast("long")).otherwise(F.shiftrightunsigned(F.xxhash64(F.col(id_col)), 1)),
            "__w": F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 1),
        }
    )


KEY, KEY3 = "struct<u: bigint, v: bigint>", "struct<u: bigint, v: bigint, w: bigint>"


def key_place(keys: Column, n: int, parts: str = "uv") -> Column:
    """How many of the n sorted keys are at most (__u, __v), or (__u, __v, __w): a binary search, so that the cost for a row grows with log n."""
    key = F.struct(*[F.col(f"__{p}").alias(p) for p in parts])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when((low + step <= n) & (F.get(keys, low + step - 1) <= key), low + step).otherwise(low))


def _as_keys(keys: list[tuple[int, int, int]]) -> Column:
    return as_data([dict(zip("uvw", k, strict=True)) for k in keys], KEY3)


def _histogram(keys: DataFrame, intervals: list[Interval], probes: int) -> dict[int, list]:
    """Exact bytes, rows and key bounds between the probes of each interval. At most `probes` + 1 rows, or 9 for each interval, come back."""
    each = max(8, probes // len(intervals))
    order = sorted(range(len(intervals)), key=lambda i: intervals[i].first)
    by_key = [intervals[i] for i in order]
    if len(intervals) == 1 and not intervals[0].prefix:
        keys = keys.where((F.col("__u") >= intervals[0].lo) & (F.col("__u") <= intervals[0].hi))
    parts = [{"i": i, "level": len(x.prefix), "u": x.first[0], "v": x.first[1], "lo": x.lo, "hi": x.hi, "step": -(-(x.hi - x.lo + 1) // each)} for i, x in zip(order, by_key, strict=True)]
    parts = as_data(parts, "struct<i: int, level: int, u: bigint, v: bigint, lo: bigint, hi: bigint, step: bigint>")
    at = key_place(_as_keys([x.first for x in by_key]), len(by_key), "uvw") - 1
    value = "(CASE s.level WHEN 0 THEN __u WHEN 1 THEN __v ELSE __w END)"
    rows = (
        keys.select("*", F.get(parts, at).alias("s"))
        .where(f"{value} BETWEEN s.lo AND s.hi AND (s.level = 0 OR __u = s.u) AND (s.level < 2 OR __v = s.v)")
        .groupBy(F.col("s.i").alias("i"), F.expr(f"({value} - s.lo) div s.step").alias("b"))
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), *[f(f"__{p}").alias(f"{p}{i}") for p in "uvw" for i, f in enumerate((F.min, F.max))])
        .collect()
    )
    out: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r.i, r.b)):
        out.setdefault(r.i, []).append(r)
    return out


def find_splitters(keys: DataFrame, targets: list[float], tolerances: list[float], probes: int = 4096) -> list[tuple[int, int, int]]:
    """One key for each byte target: the rows before it hold about that many bytes."""
    found: dict[int, tuple[int, int, int]] = {}
    open_: dict[Interval, list[int]] = {Interval((), 0, TOP, 0): list(range(len(targets)))}
    while open_:
        intervals = list(open_)
        counted = _histogram(keys, intervals, probes)
        after: dict[Interval, list[int]] = {}
        for i, x in enumerate(intervals):
            buckets = counted.get(i, [])
            ends, total, level = [], x.below, len(x.prefix)
            for b in buckets:
                total += b.bytes
                ends.append(total)
            for k in open_[x]:
                if not buckets:
                    found[k] = x.first
                    continue
                j = min(bisect_left(ends, targets[k]), len(buckets) - 1)
                b, low = buckets[j], ends[j] - buckets[j].bytes
                least, most = b[f"{'uvw'[level]}0"], b[f"{'uvw'[level]}1"]
                key = lambda value: (*x.prefix, value, 0, 0)[:3]  # noqa: B023, E731
                behind = key(most + 1) if most < TOP else (*x.prefix, TOP, TOP, TOP)[:3]
                near, gap = min(((abs(targets[k] - low), key(least)), (abs(ends[j] - targets[k]), behind)))[::-1]
                if gap <= tolerances[k] or b.n == 1 or (least == most and level == 2):
                    found[k] = near
                elif least == most:
                    # One value here: the next part of the key tells the rows apart.
                    after.setdefault(Interval((*x.prefix, least), b[f"{'uvw'[level + 1]}0"], b[f"{'uvw'[level + 1]}1"], low), []).append(k)
                else:
                    after.setdefault(Interval(x.prefix, least, most, low), []).append(k)
        open_ = after
    return [found[k] for k in range(len(targets))]


def shard_documents(docs: DataFrame, n_shards: int = 24, tolerance: float = 0.002, slice_bytes: int = 64 << 20, probes: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with size, text_crc32, law ('bytes'), shard, slot and grown_shard (null under this law).

    tolerance: of a shard's bytes, for each splitter. slice_bytes: a shard is sorted in slices of
    about so many bytes (four at least), a task each, so their number follows the input. The driver
    holds one splitter, one count and at most nine counted ranges for each slice: 100 TB in slices of
    64 MB are 1.6 million; larger slices make fewer.
    """
    spark = docs.sparkSession
    keyed = _keyed(docs, id_col, text_col)
    keys = materialise(keyed.select("__u", "__v", "__w", "size"), "shard-keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    slices = max(LEAST_SLICES, -(-total // (n_shards * slice_bytes)))
    p = n_shards * slices
    splitters = []
    if total:
        share = total / n_shards
        wanted = [total * k / p for k in range(1, p)], [share * (tolerance if k % slices == 0 else 0.25 / slices) for k in range(1, p)], probes
        splitters = sorted(find_splitters(keys, *wanted))
        if any(w for *_, w in splitters):
            # A place must be the same whenever the rows are read.
            keyed = materialise(keyed, "shard-rows")
            keys = keyed.select("__u", "__v", "__w", "size")
            splitters = sorted(find_splitters(keys, *wanted))
    part = key_place(_as_keys(splitters), len(splitters), "uvw") if splitters else F.lit(0)
    counts = {r[0]: r[1] for r in keys.groupBy(part.alias("slice")).count().collect()} if total else {}
    starts = []
    for k in range(p):
        starts.append(0 if k % slices == 0 else starts[-1] + counts.get(k - 1, 0))
    sliced = keyed.withColumn("__slice", part)
    if p > int(spark.conf.get("spark.sql.shuffle.partitions")):
        sliced = sliced.repartition(p, "__slice")
    in_order = Window.partitionBy("__slice").orderBy("__u", "__v", id_col, "__w")
    return (
        sliced.withColumns(
            {
                "law": F.lit("bytes"),
                "shard": F.expr(f"CAST(__slice div {slices} AS INT)"),
                "slot": F.get(as_data(starts, "bigint"), F.col("__slice")) + F.row_number().over(in_order) - F.lit(1),
                "grown_shard": F.lit(None).cast("int"),
            }
        )
        .drop("__u", "__v", "__w", "__slice")
    )


def op1(spark, sf_dir):
    from searchlift.llm.common import table

    return shard_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
