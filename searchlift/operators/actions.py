"""The draft action queue that follows the active opportunities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchlift.operators.facts import OPPORTUNITY_CTE


def follow(queue: DataFrame, active: DataFrame) -> DataFrame:
    """queue (key, priority, confidence, status, version) and active (key, priority, confidence) -> the next queue, with what happened.

    New opportunities become drafts; drafts take changed scores; cancelled actions whose
    opportunity is back become drafts again; drafts without an opportunity are cancelled. Each
    such change raises the version. Actions past the draft stay as they are. One row of a
    repeated key counts: the highest priority, then confidence.
    """
    best = active.groupBy("key").agg(F.max(F.struct("priority", "confidence")).alias("o"))
    both = queue.withColumnsRenamed({c: f"own_{c}" for c in ("priority", "confidence")}).join(best, "key", "full")
    changed = ~(F.col("o.priority").eqNullSafe(F.col("own_priority")) & F.col("o.confidence").eqNullSafe(F.col("own_confidence")))
    event = (
        F.when(F.col("status").isNull(), "created").when(F.col("o").isNotNull() & (F.col("status") == "draft") & changed, "refreshed")
        .when(F.col("o").isNotNull() & (F.col("status") == "cancelled"), "reactivated").when(F.col("o").isNull() & (F.col("status") == "draft"), "cancelled").otherwise("kept")
    )
    new = both.withColumn("event", event)
    takes = F.col("event").isin("created", "refreshed", "reactivated")
    status = F.when(takes, "draft").when(F.col("event") == "cancelled", "cancelled").otherwise(F.col("status"))
    scores = [F.when(takes, F.col(f"o.{c}")).otherwise(F.col(f"own_{c}")).alias(c) for c in ("priority", "confidence")]
    return new.select("key", *scores, status.alias("status"), (F.coalesce("version", F.lit(0)) + (F.col("event") != "kept").cast("int")).alias("version"), "event")


ACTION_QUEUE_SQL = f"""WITH {OPPORTUNITY_CTE}, d AS (SELECT opportunity_key AS key, priority, confidence, substring(opportunity_key, 1, 1) AS a, substring(opportunity_key, 2, 1) AS b, substring(opportunity_key, 3, 1) AS c FROM opps),
s AS (SELECT *, CASE WHEN c < 'a' THEN CASE WHEN b < '4' THEN 'cancelled' WHEN b < '8' THEN 'approved' ELSE 'draft' END END AS was, priority - CASE WHEN a < '8' THEN 0 ELSE 5 END AS old, priority >= 60 AS active FROM d),
e AS (SELECT *, CASE WHEN was IS NULL THEN 'created' WHEN active AND was = 'draft' AND old <> priority THEN 'refreshed' WHEN active AND was = 'cancelled' THEN 'reactivated' WHEN NOT active AND was = 'draft' THEN 'cancelled' ELSE 'kept' END AS event FROM s WHERE active OR was IS NOT NULL)
SELECT key, CAST(CASE WHEN event IN ('created', 'refreshed', 'reactivated') THEN priority ELSE old END AS INT) AS priority, confidence,
 CASE WHEN event IN ('created', 'refreshed', 'reactivated') THEN 'draft' WHEN event = 'cancelled' THEN 'cancelled' ELSE was END AS status, CASE WHEN was IS NULL THEN 1 WHEN event = 'kept' THEN 1 ELSE 2 END AS version, event FROM e"""
