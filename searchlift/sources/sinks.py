"""Sinks: partitioned fact loads, exports and append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The columns of an export, in order.
EXPORT_COLUMNS = ("url", "path", "title", "description", "h1_count", "status_code", "response_time_ms", "word_count", "canonical", "robots", "lang")


def replace_days(facts: DataFrame, path: str, day: str = "metric_date") -> None:
    """Replace whole days of a fact table: late rows of a day overwrite it, other days stay."""
    facts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def export_rows(pages: DataFrame) -> DataFrame:
    """The export's columns; missing texts are empty and missing numbers 0."""
    return pages.select(*[F.coalesce(F.col(c), F.lit(0 if dict(pages.dtypes)[c] == "int" else "")).alias(c) for c in EXPORT_COLUMNS])


def export_csv(pages: DataFrame, path: str) -> None:
    export_rows(pages).orderBy("path", "url").write.mode("overwrite").csv(path, header=True)


def export_json(pages: DataFrame, path: str) -> None:
    export_rows(pages).orderBy("path", "url").write.mode("overwrite").json(path)


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)
