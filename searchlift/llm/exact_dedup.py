"""Exact deduplication as a stateful stream.

The documents run through a streaming aggregation keyed by the digest of their normalised
text. Its state (RocksDB on the executors' disks, logged to the shared checkpoint folder) never
expires and keeps, per digest, the smallest id seen, the locator of that row's content (its file and
its place in the file), and the number of rows. A stored table of documents is one available-now
run; new files continue from the kept state. Hits (digests of two rows and more) are checked on
their full bytes against the content at the locator; texts that share a digest but differ are told
apart by the text itself.

Defined results: null counts as the empty text; empty texts are equal to each other; very long
texts are compared whole; a null id is never the one that stays unless all ids of the group are
null; rows that repeat id and text are all reported, and all marked as the id that stays; an empty
table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from searchlift.llm.common import join_groups, materialise
from searchlift.sources.staging import shared_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: So many hit digests (32 bytes each) are broadcast to pick the rows to check; with more, all rows are checked.
BROADCAST_HITS = 500_000
#: Folders of updates that are folded into one when there are more.
MOST_UPDATES = 16
#: Of the stream alone: many small stores, so no preallocated logs, and only what changed goes to the checkpoint.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def normalised(text: Column) -> Column:
    """Each run of white space as one space; single spaces need no replacing, which saves most matches."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def update_state(spark: SparkSession, path: str, state_dir: str, id_col: str = "doc_id", text_col: str = "text", digest=sha256, files_per_batch: int | None = None) -> DataFrame:
    """Run what is new under path through the stream; return the state: digest, keep_id, locator, group_size."""
    schema = spark.read.parquet(path).select(id_col, text_col).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # A pattern that matches the path alone: a stream reads one file only by a pattern.
    path = path.rstrip("/")
    rows = reader.parquet(f"{path[:-1]}[{path[-1]}]").select(
        digest(normalised(F.col(text_col))).alias("digest"), F.col(id_col).alias("id"), F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at")
    )
    # The locator is that of the row that stays: the smallest id, nulls last, then the first place.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "at"))
    state = rows.groupBy("digest").agg(first.alias("first"), F.count("*").alias("group_size")).select("digest", F.col("first.id").alias("keep_id"), F.col("first.at").alias("locator"), "group_size")

    def keep(batch: DataFrame, number: int) -> None:
        # One folder per batch, overwritten if the batch is run again.
        batch.write.mode("overwrite").parquet(f"{state_dir}/updates/batch={number}")

    before = {k: spark.conf.get(k, None) for k in STORE}
    try:
        for k, v in STORE.items():
            spark.conf.set(k, v)
        # The stream copies the session's settings when it starts; after that they are what they were.
        query = state.writeStream.outputMode("update").option("checkpointLocation", f"{state_dir}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    query.awaitTermination()
    return _state(spark, state_dir, state.schema)


def _state(spark: SparkSession, state_dir: str, schema) -> DataFrame:
    """The newest row of each digest: ids only fall and counts only grow, so the largest count is the newest.

    Many folders of updates are folded into one first, so that their number stays bounded over the runs.
    """
    read = lambda: spark.read.schema(schema).parquet(f"{state_dir}/updates").groupBy("digest").agg(F.max_by(F.struct("keep_id", "locator", "group_size"), "group_size").alias("s")).select("digest", "s.*")
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{state_dir}/updates")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    batches = sorted(int(x.getPath().getName().split("=")[1]) for x in fs.listStatus(folder) if "=" in x.getPath().getName())
    if len(batches) > MOST_UPDATES:
        # The fold is moved in before the folders go: a crash between leaves rows twice, which changes nothing.
        read().write.mode("overwrite").parquet(f"{state_dir}/folded")
        name = spark._jvm.org.apache.hadoop.fs.Path
        fs.rename(name(f"{state_dir}/folded"), name(f"{state_dir}/updates/batch={-1 - batches[-1]}"))
        for k in batches:
            fs.delete(name(f"{state_dir}/updates/batch={k}"), True)
    return read()


def duplicates(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", digest=sha256, state_dir: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """One row per row under path: id, keep_id, group_size, kept, text_sha256, locator."""
    state_dir = state_dir or f"{shared_dir(spark)}/exact-dedup-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).select(id_col, text_col).schema
    if spark.read.parquet(path).select(id_col).isEmpty():
        state = spark.createDataFrame([], f"digest binary, keep_id {schema[id_col].dataType.simpleString()}, locator struct<file: string, row: bigint>, group_size long")
    else:
        state = materialise(update_state(spark, path, state_dir, id_col, text_col, digest, files_per_batch), "exact-state")
    rows = spark.read.schema(schema).parquet(path)
    norm = normalised(F.col(text_col))
    docs = rows.select(F.col(id_col).alias("id"), norm.alias("norm"), F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at")).withColumn("digest", digest(F.col("norm")))
    clashing = _clashing(docs, state)
    n_clashing = clashing.count()
    hexed = F.lower(F.hex("digest")) if digest is sha256 else F.sha2("norm", 256)
    whole = materialise(docs.select("id", "digest", hexed.alias("text_sha256")), "exact-digests")
    groups = state.join(clashing, "digest", "left_anti") if n_clashing else state
    found = whole.join(clashing, "digest", "left_anti") if n_clashing else whole
    found = join_groups(found, groups.withColumn("n", F.col("group_size")), "digest", "n", whole.count())
    if n_clashing:
        # Different texts under one digest: the text itself is the key there.
        own = docs.join(clashing, "digest", "left_semi")
        first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "at"))
        apart = own.groupBy("digest", "norm").agg(first.alias("first"), F.count("*").alias("group_size"))
        mixed = own.select("id", "digest", "norm").join(apart, ["digest", "norm"])
        found = found.unionByName(mixed.select("digest", "id", F.sha2("norm", 256).alias("text_sha256"), F.col("first.id").alias("keep_id"), F.col("first.at").alias("locator"), "group_size"))
    return found.select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "locator")


def _clashing(docs: DataFrame, state: DataFrame) -> DataFrame:
    """Digests under which the full bytes of a row differ from those at the locator.

    Equal texts are combined before the shuffle, so that a large group of copies sends one row per
    task; the text at the locator is among them.
    """
    hits = state.where("group_size > 1").select("digest", "locator")
    n = hits.count()
    if n == 0:
        return hits.select("digest")
    wanted = F.broadcast(hits.select("digest")) if n <= BROADCAST_HITS else hits.select("digest")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "at"))
    texts = docs.join(wanted, "digest", "left_semi").groupBy("digest", "norm").agg(first.alias("first"))
    # The text whose first row is the locator's is the one that stays; any other text under its digest is a clash.
    met = texts.join(hits, "digest").withColumn("located", F.col("first.at").eqNullSafe(F.col("locator")))
    return met.groupBy("digest").agg(F.count("*").alias("texts"), F.max("located").alias("located")).where("texts > 1 OR NOT located").select("digest")


def op7(spark, sf_dir):
    return duplicates(spark, f"{sf_dir}/documents.parquet").select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


ORACLE_OP7 = r"""
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
"""
