"""Event streams: windows, sessions, cool-downs and lifecycle state.

Every function takes a batch or a streaming DataFrame of (event_id, ts, user_id, event_type, value).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchlift.functions.folds import line, on_line
from searchlift.operators import pacing
from searchlift.sources.staging import shared_dir

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the events under path; a pattern that matches the path alone lets one file be a stream too."""
    path = path.rstrip("/")
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def _marked(events: DataFrame, late: str) -> DataFrame:
    """A stream with its watermark; event time needs a time zone, which the session's stands in for."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, size: str = "1 day", late: str = "3 days") -> DataFrame:
    e = _marked(events, late)
    g = e.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(18,6)")), 4).cast("double").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


TUMBLING_SQL = "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, CAST(round(sum(CAST(value AS DECIMAL(18,6))), 4) AS DOUBLE) AS total FROM events GROUP BY ALL"


def sliding(events: DataFrame, size: str = "14 days", step: str = "1 day", late: str = "3 days") -> DataFrame:
    e = _marked(events, late)
    return e.groupBy(F.window("ts", size, step).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


SLIDING_SQL = "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) - to_days(CAST(d AS INT)) AS start, event_type, count(*) AS n FROM events, range(14) r(d) GROUP BY ALL"


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "3 days") -> DataFrame:
    e = _marked(events, late)
    g = e.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("ended"), "n")


SESSIONS_SQL = """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 12 HOURS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOURS AS ended, count(*) AS n FROM s GROUP BY user_id, k"""


def cooled_down(events: DataFrame, within: str = "24 hours") -> DataFrame:
    """One event per user and type inside the cool-down; a stream forgets a key when the watermark passes it."""
    return _marked(events, within).dropDuplicatesWithinWatermark(["user_id", "event_type"])


def run(stream: DataFrame, mode: str = "append", name: str = "stream", root: str | None = None) -> DataFrame:
    """Drive all that is available through a stream into a table of the shared folder, and read it.

    Each micro-batch has a folder of its own that is overwritten if the batch is run again, so a
    restart writes nothing twice; with a root of its own a stream goes on where it stopped. In mode complete the newest batch is the table.
    """
    spark = stream.sparkSession
    root = root or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{root}/out")
    if mode == "complete":
        out = out.where(F.col("batch") == (out.agg(F.max("batch")).first()[0] or 0))
    return out.drop("batch")


#: Windows that the watermark has closed once all events are read.
CLOSED_SQL = f"SELECT * FROM ({TUMBLING_SQL}) WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 3 DAYS FROM events)"
CLOSED_SESSIONS_SQL = f"SELECT * FROM ({SESSIONS_SQL}) WHERE ended <= (SELECT max(ts) - INTERVAL 3 DAYS FROM events)"


def folded(events: DataFrame) -> DataFrame:
    """The state of each user after its events: kept by the stream, never forgotten."""
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("changed_at"), F.count("*").alias("events"))


def paced(answers: DataFrame, root: str, base: float = 0.15, top: float = 30.0) -> DataFrame:
    """Crawl pacing of a stream of answers: the state of each host after all that is available, kept under root.

    A micro-batch folds its own answers to one step for each host, in pieces, and applies it to the
    states of the batch before; its states have a folder of their own that is overwritten if the batch is
    run again. Inside a batch answers count in order of time and id.
    """
    spark = answers.sparkSession
    state = lambda number: f"{root}/state/batch={number}"

    def one(batch: DataFrame, number: int) -> None:
        steps = pacing.host_steps(batch, base, top)
        if number:
            before = spark.read.parquet(state(number - 1))
            joined = before.join(steps, before["host"].eqNullSafe(steps["host"]), "full").select(F.coalesce(before["host"], steps["host"]).alias("host"), "delay", "scale", "throttled", "step")
        else:
            joined = steps.select("host", *[F.lit(None).cast(t).alias(c) for c, t in (("delay", "double"), ("scale", "double"), ("throttled", "bigint"))], "step")
        old = {"delay": F.coalesce("delay", F.lit(float(base))), "scale": F.coalesce("scale", F.lit(1.0)), "throttled": F.coalesce("throttled", F.lit(0).cast("bigint"))}
        s = F.coalesce(F.col("step"), F.struct(line().alias("delay"), line().alias("scale"), F.lit(0).cast("bigint").alias("throttled")))
        after = joined.select("host", on_line(s.delay, old["delay"]).alias("delay"), on_line(s.scale, old["scale"]).alias("scale"), (old["throttled"] + s.throttled).alias("throttled"))
        after.write.mode("overwrite").parquet(state(number))
        spark.createDataFrame([(number,)], "last long").write.mode("overwrite").parquet(f"{root}/newest")

    answers.writeStream.option("checkpointLocation", f"{root}/checkpoint").foreachBatch(one).trigger(availableNow=True).start().awaitTermination()
    return pacing.shown(spark.read.parquet(state(spark.read.parquet(f"{root}/newest").first()[0])))
