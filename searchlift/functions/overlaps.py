"""Sets that overlap: every pair of sets of a group with the number of members that both have.

Sets are packed in blocks, a row for each block with its members numbered, and each two blocks of a group meet in one task, which
reads them from where they lie: what is shuffled and stored is each block once or twice, however many blocks it meets. In a task
members that many sets have are counted by a product of 0/1 matrices, the others by the lists of sets that have them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchlift.sources.staging import staged

#: Sets of a block, of these how many are counted at once, and blocks that a task holds of either side.
BLOCK, TILE, TOGETHER = 8_000, 500, 4
#: A member is counted in the product if so large a share of a task's pairs of sets has it.
COMMON = 1 / 150


def overlaps(sets: DataFrame, shared: int, least: float, block: int = BLOCK) -> DataFrame:
    """sets (site, page_id, terms: distinct) -> page_id, other_id (larger), shared, either for pairs of a site with that many shared terms and that Jaccard similarity."""
    known = sets.select("site", "page_id", "terms").where("site IS NOT NULL AND page_id IS NOT NULL")
    large = known.groupBy("site").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1")
    # One row for each `block` sets at most.
    dealt = known.join(F.broadcast(large), "site", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.hash("page_id"), F.col("blocks"))).select("site", "block", "page_id", "terms")
    packed = T.StructType([T.StructField("site", sets.schema["site"].dataType), T.StructField("block", T.IntegerType()), T.StructField("sets", T.BinaryType())])
    blocks = staged(dealt.groupBy("site", "block").applyInArrow(_packed, packed), "blocks")
    parts = max(1, math.ceil(blocks.count() / TOGETHER))
    # Each two parts of the blocks are a task; no block is copied for the others that it meets.
    side = lambda name: blocks.repartition(parts).select(F.col("site").alias(f"{name}_site"), F.col("block").alias(name), F.col("sets").alias(f"{name}_sets"))
    met = side("low").hint("shuffle_replicate_nl").join(side("high"), F.expr("low_site = high_site AND low <= high"))
    kind = T.StructType([T.StructField(c, sets.schema["page_id"].dataType) for c in ("page_id", "other_id")] + [T.StructField(c, T.LongType()) for c in ("shared", "either")])
    pairs = met.select("low", "high", "low_sets", "high_sets").mapInArrow(lambda batches: _met(batches, shared, least), kind)
    return pairs.select(F.least("page_id", "other_id").alias("page_id"), F.greatest("page_id", "other_id").alias("other_id"), "shared", "either").where("page_id < other_id")


def _packed(group: pa.Table) -> pa.Table:
    """A block as one row: ids, sizes, the members in order and, for each set, their places in these."""
    group = group.combine_chunks()
    lists = group["terms"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    coded = lists.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    place = np.empty(len(order), np.int32)
    place[np.asarray(order)] = np.arange(len(order), dtype=np.int32)
    codes = place[np.asarray(coded.indices)]
    sink = pa.BufferOutputStream()
    parts = (group["page_id"].combine_chunks(), lists.value_lengths(), pa.array(codes), coded.dictionary.take(order))
    for part in parts:
        table = pa.table({"": part})
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
    return pa.table({"site": group["site"].slice(0, 1), "block": group["block"].slice(0, 1), "sets": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def _unpacked(sets: pa.Scalar) -> list[pa.Array]:
    source = pa.BufferReader(sets.as_buffer())
    found = (pa.ipc.open_stream(source).read_all()[0].combine_chunks() for _ in range(4))
    return [(x.chunk(0) if x.num_chunks else pa.array([], x.type)) if isinstance(x, pa.ChunkedArray) else x for x in found]


def _met(batches: Iterator[pa.RecordBatch], shared: int, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, left, right in zip(*(batch[c] for c in ("low", "high", "low_sets", "high_sets")), strict=True):
            ids, size, code, members = _unpacked(left)
            others, other_size, other_code, other_members = (ids, size, code, members) if low == high else _unpacked(right)
            # The other block's members by their places in this one's; those that this one lacks are left out.
            place = np.asarray(pc.fill_null(pc.index_in(other_members, value_set=members), -1))
            for a, b, n, either in _pairs(np.asarray(size), np.asarray(code), np.asarray(other_size), place[np.asarray(other_code)], len(members), low == high, shared, least):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), others.take(pa.array(b)), pa.array(n), pa.array(either)], ["page_id", "other_id", "shared", "either"])


def _pairs(size: np.ndarray, code: np.ndarray, other_size: np.ndarray, other_code: np.ndarray, terms: int, same: bool, shared: int, least: float) -> Iterator[tuple]:
    """Sets of the one and of the other block that are alike enough, what they share and what either has, a tile of the one at a time."""
    size, other_size = size.astype(np.int64), other_size.astype(np.int64)
    row, other_row = np.repeat(np.arange(len(size)), size), np.repeat(np.arange(len(other_size)), other_size)
    other_row, other_code = other_row[other_code >= 0], other_code[other_code >= 0]
    have, others_have = np.bincount(code, minlength=terms), np.bincount(other_code, minlength=terms)
    common = have * others_have > COMMON * len(size) * len(other_size)
    place = np.cumsum(common) - 1
    many = np.zeros((int(common.sum()), len(other_size)), np.float32)
    of = common[other_code]
    many[place[other_code[of]], other_row[of]] = 1
    # The other members: for each the sets of the other block that have it, one list after the other.
    lists = other_row[~of][np.argsort(other_code[~of], kind="stable")]
    length = np.where(common, 0, others_have)
    begin = np.cumsum(length) - length
    of, rare = common[code], length[code] > 0
    in_many, many_row = place[code[of]], row[of]
    low, high = begin[code[rare]], (begin + length)[code[rare]]
    tiles, starts = np.searchsorted(many_row, np.arange(len(size) + 1)), np.searchsorted(row[rare], np.arange(len(size) + 1))
    # Enough are shared from least * (sizes of both) / (1 + least) on; what floats may miss is looked at exactly.
    need, other_need = ((1 - 1e-5) * least / (1 + least) * x for x in (size, other_size))
    need, other_need = (need - 0.01).astype(np.float32), other_need.astype(np.float32)
    for t in range(0, len(size), TILE):
        end = min(t + TILE, len(size))
        tile = np.zeros((end - t, len(many)), np.float32)
        tile[many_row[tiles[t] : tiles[end]] - t, in_many[tiles[t] : tiles[end]]] = 1
        counts = tile @ many
        for r in range(t, end):
            i, j = starts[r], starts[r + 1]
            if i < j:
                has = np.concatenate([lists[x:y] for x, y in zip(low[i:j].tolist(), high[i:j].tolist(), strict=True)])
                counts[r - t] += np.bincount(has, minlength=len(other_size))
        good = counts >= np.maximum(need[t:end, None] + other_need[None, :], shared)
        if same:
            good &= np.arange(t, end)[:, None] < np.arange(len(other_size))[None, :]
        x, y = np.nonzero(good)
        n = counts[x, y].astype(np.int64)
        sizes = size[t + x] + other_size[y]
        sure = (1 + least) * n >= least * sizes - 1e-6
        x, y, n = x[sure], y[sure], n[sure]
        yield t + x, y, n, sizes[sure] - n
