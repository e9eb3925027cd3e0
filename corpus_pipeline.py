"""The corpus pipeline: documents to shards of training data, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from searchlift.llm import decontamination, language_id, mixing, near_dedup, sharding
from searchlift.llm.common import drop_staged, materialise, staged, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a letter, and rows that two languages claim alike, go.

    Null and empty texts have no letter. Repeated rows go or stay together. Without any labelled row
    no language is known and every row goes; an empty table stays empty.
    """
    return language_id.known_language(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked from similarity 0.8 on, the smallest doc_id stays.

    Rows that repeat an id stay or go together; null and empty texts are groups of their own; rows
    with a null id stay. An empty table stays empty.
    """
    return near_dedup.one_of_each(docs, threshold=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make up a twentieth or more go.

    Null and empty texts are clean; repeated rows go or stay together; an empty benchmark removes
    nothing, and an empty table stays empty.
    """
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's share takes it; a part where the share ends.

    A null source is a source of its own; documents without words are in no mix. Repeated rows count
    as documents each. An empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with size, text_crc32, law, shard, slot and grown_shard.

    Null texts count as empty, null ids sort first, repeated rows have a slot each. Columns of these
    names are replaced. An empty table stays empty.
    """
    return sharding.shard_documents(docs)


STAGES = [
    ("language ID", known_language),
    ("near-duplicates", near_dedup_stage),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: The stages train, hash and link; SQL can't state them. tests/llm/test_pipeline.py runs them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        mark = staged()
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        # What the stage staged has gone into its result.
        drop_staged(spark, mark, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
