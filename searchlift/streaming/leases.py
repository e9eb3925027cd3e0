"""Leases of running jobs as a stream with timers: a lease that is not renewed ends by itself.

An event (job_id, ts, event_id, kind, attempt) claims a job, renews its lease, asks for its cancellation or
completes it. While a job is leased the state holds its attempt, the end of its lease and whether it
is to be cancelled, and an event-time timer stands at that end. A lease ends once, in one row, and its
state goes with it: completed by its event; or run out, at the first event at or after its end or when the watermark
passes, and then cancelled if that was asked, failed after the last attempt, else waiting for a retry.

Events of a micro-batch count in order of time and id; a job's events must not come a micro-batch too
late. Claims of a leased job, and renewals, cancellations and completions of one that is not, change
nothing. Events without a job or time, and kinds that are not known, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from searchlift.sources.staging import session_settings

KINDS = ("claim", "renew", "cancel", "complete")
LEASE, ATTEMPTS, FIRST_DELAY, DOUBLINGS = timedelta(hours=12), 3, 30, 6
STATE = "attempt int, until long, cancel boolean"
ENDED = "job_id {id}, status string, ended_ms long, attempt int, delay_seconds int"
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Leases(StatefulProcessor):
    def __init__(self, lease: timedelta, attempts: int):
        self.lease, self.attempts = round(lease.total_seconds() * 1000), attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("lease", STATE)

    def _ended(self, key, status: str, at: int, attempt: int) -> Row:
        delay = FIRST_DELAY * 2 ** min(attempt, DOUBLINGS) if status == "retry_wait" else None
        return Row(job_id=key[0], status=status, ended_ms=at, attempt=attempt, delay_seconds=delay)

    def _run_out(self, key, attempt: int, until: int, cancel: bool) -> Row:
        return self._ended(key, "cancelled" if cancel else "failed" if attempt >= self.attempts else "retry_wait", until, attempt)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        before = now = self.held.get() if self.held.exists() else None
        for at, _, kind, attempt in sorted((r.at, r.event_id, r.kind, r.attempt) for r in rows):
            if now and at >= now[1]:
                yield self._run_out(key, *now)
                now = None
            if kind == "claim":
                now = now or (attempt, at + self.lease, False)
            elif now and kind == "complete":
                yield self._ended(key, "completed", at, now[0])
                now = None
            elif now:
                now = (now[0], at + self.lease, now[2]) if kind == "renew" else (now[0], now[1], True)
        if before and (not now or now[1] != before[1]):
            self.handle.deleteTimer(before[1])
        if not now:
            self.held.clear()
            return
        self.held.update(tuple(now))
        if not before or now[1] != before[1]:
            self.handle.registerTimer(now[1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.held.exists():
            yield self._run_out(key, *self.held.get())
            self.held.clear()

    def close(self) -> None:
        pass


def ended(events: DataFrame, late: str = "3 days", lease: timedelta = LEASE, attempts: int = ATTEMPTS) -> DataFrame:
    """A stream of events -> a stream of the leases that ended: job_id, status, ended_at, attempt, delay_seconds."""
    kind = events.schema["job_id"].dataType.simpleString()
    known = events.where(F.col("job_id").isNotNull() & F.col("ts").isNotNull() & F.col("kind").isin(*KINDS)).select("job_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "kind", F.coalesce("attempt", F.lit(0)).cast("int").alias("attempt"))
    known = known.withColumn("at", F.unix_millis("ts"))
    out = known.withWatermark("ts", late).groupBy("job_id").transformWithState(Leases(lease, attempts), ENDED.format(id=kind), "Append", "EventTime")
    return out.select("job_id", "status", F.timestamp_millis("ended_ms").alias("ended_at"), "attempt", "delay_seconds")


def run(events: DataFrame, name: str = "leases", root: str | None = None, **options) -> DataFrame:
    """Drive all available events through the leases; the state needs the RocksDB store, whose setting is put back afterwards."""
    from searchlift.streaming import events as streams

    with session_settings(events.sparkSession, STORE):
        return streams.run(ended(events, **options), name=name, root=root)


LEASES_SQL = f"""WITH RECURSIVE e AS (SELECT user_id AS job_id, ts, CASE event_type WHEN 'view' THEN 'claim' WHEN 'click' THEN 'renew' WHEN 'signup' THEN 'renew' WHEN 'error' THEN 'cancel' ELSE 'complete' END AS kind, CAST(event_id % 5 AS INT) AS attempt, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
-- held: the lease after event i; gone: the one that event i ended, and how.
walk AS (SELECT DISTINCT job_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS INT) AS attempt, CAST(NULL AS TIMESTAMP) AS until, false AS cancel, CAST(NULL AS INT) AS gone, CAST(NULL AS TIMESTAMP) AS gone_at, false AS gone_cancel, CAST(NULL AS INT) AS done, CAST(NULL AS TIMESTAMP) AS done_at FROM e
UNION ALL SELECT job_id, i, CASE WHEN kind = 'claim' THEN coalesce(held, event_attempt) WHEN kind <> 'complete' THEN held END, CASE WHEN kind = 'claim' THEN coalesce(held_until, ts + INTERVAL {LEASE.seconds // 3600} HOURS) WHEN kind = 'complete' OR held IS NULL THEN NULL WHEN kind = 'renew' THEN ts + INTERVAL {LEASE.seconds // 3600} HOURS ELSE held_until END,
 CASE WHEN held IS NULL THEN false WHEN kind = 'cancel' THEN true WHEN kind = 'complete' THEN false ELSE cancel END, CASE WHEN out THEN attempt END, CASE WHEN out THEN until END, cancel, CASE WHEN kind = 'complete' THEN held END, CASE WHEN kind = 'complete' AND held IS NOT NULL THEN ts END
 FROM (SELECT *, CASE WHEN NOT out THEN attempt END AS held, CASE WHEN NOT out THEN until END AS held_until FROM (SELECT w.job_id, e.i, e.ts, e.kind, e.attempt AS event_attempt, w.attempt, w.until, w.cancel, coalesce(e.ts >= w.until, false) AS out FROM walk w JOIN e ON e.job_id = w.job_id AND e.i = w.i + 1))),
last AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY i DESC) = 1),
run_out AS (SELECT job_id, gone AS attempt, gone_at AS ended_at, gone_cancel AS cancel FROM walk WHERE gone IS NOT NULL UNION ALL SELECT job_id, attempt, until, cancel FROM last WHERE until <= (SELECT max(ts) - INTERVAL 3 DAYS FROM events)),
r AS (SELECT job_id, CASE WHEN cancel THEN 'cancelled' WHEN attempt >= {ATTEMPTS} THEN 'failed' ELSE 'retry_wait' END AS status, date_trunc('milliseconds', ended_at) AS ended_at, attempt FROM run_out UNION ALL SELECT job_id, 'completed', date_trunc('milliseconds', done_at), done FROM walk WHERE done IS NOT NULL)
SELECT *, CASE WHEN status = 'retry_wait' THEN CAST({FIRST_DELAY} * pow(2, least(attempt, {DOUBLINGS})) AS INT) END AS delay_seconds FROM r"""
