"""Late data as a stream: rows that arrive after their day was loaded replace the whole day."""

from __future__ import annotations

from pyspark.sql import DataFrame

from searchlift.sources.tables import FACTS_SQL
from searchlift.sources.versions import VersionedTable


def follow(arrivals: DataFrame, target: VersionedTable, checkpoint: str, name: str = "late-days") -> None:
    """Run all that has arrived (rows with `load`, the number of the load that brought them) through a stream into a table of whole days.

    A day is what its newest load brought, whatever the order of arrival and the cut of the
    micro-batches. A micro-batch is one commit of the table, which remembers its number: one that
    is run again after a restart changes nothing, and one that dies half-way leaves the version before.
    """
    if not arrivals.isStreaming:
        raise ValueError("arrivals must be a stream")

    def one(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            target.commit(kept, newest=True, batch=(name, number))
        finally:
            kept.unpersist()

    arrivals.writeStream.option("checkpointLocation", checkpoint).foreachBatch(one).trigger(availableNow=True).start().awaitTermination()


LATE_SQL = f"""WITH {FACTS_SQL}, t AS (SELECT *, day(metric_date) % 5 = 0 AS late, CAST(regexp_extract(page_url, '([0-9]+)$', 1) AS BIGINT) % 2 = 0 AS even FROM facts)
SELECT metric_date, query, page_url, CASE WHEN late THEN clicks + 1 ELSE clicks END AS clicks, impressions, position FROM t WHERE NOT late OR even"""
