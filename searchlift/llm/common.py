"""Helpers shared by the training-data operators."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from searchlift.sources.staging import shared_dir

#: Characters that separate words in the contracts: space and \x09 to \x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: A group of equal keys counts as hot from this share of all rows and this size on, so that hot groups number 10,000 at most.
HOT_SHARE, HOT_ROWS = 10_000, 100
#: Folders that this process has staged and not yet dropped.
_STAGED: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: later jobs start from the files, also after an executor is lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def staged() -> int:
    """A mark for drop_staged: what is staged up to here stays."""
    return len(_STAGED)


def drop_staged(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete what was staged after the mark, but for the newest `keep` folders; nothing may read the rest any more."""
    last = len(_STAGED) - keep
    for path in _STAGED[since:last]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    del _STAGED[since:last]


def as_data(rows: list, of: str) -> Column:
    """A list held by the driver as a constant array: one string that is parsed once, whatever the list's length."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<{of}>")


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int) -> DataFrame:
    """rows with the columns of their key's group (size aside); rows without a group have nulls there.

    A key may hold a third of all rows, so hot groups (at most HOT_SHARE of them, by the bound on
    their size) are broadcast and their rows stay where they are; the other rows meet their groups
    in a shuffle.
    """
    least = max(HOT_ROWS, n_rows // HOT_SHARE)
    hot = F.broadcast(groups.where(F.col(size) >= least).drop(size))
    cold = groups.where(F.col(size) < least).drop(size)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key, "left"))


def free_name(df: DataFrame, *names: str) -> DataFrame:
    """Without the columns that an operator is about to add: a clashing column of the input is replaced."""
    lower = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in lower])


def held_out(id_col: Column, mod: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves `part`; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % mod) == part
