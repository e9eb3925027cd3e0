"""Leases as a stream with timers, against one event at a time."""

from __future__ import annotations

import datetime
import random
from collections import Counter

import pytest

from searchlift.streaming import leases

SCHEMA = "job_id long, ts timestamp, event_id long, kind string, attempt int"
AT = datetime.datetime(2024, 1, 1)
HOUR = datetime.timedelta(hours=1)


def by_hand(events, late=3 * 24 * HOUR, lease=12 * HOUR):
    out, held = [], {}

    def run_out(job):
        attempt, until, cancel = held.pop(job)
        status = "cancelled" if cancel else "failed" if attempt >= 3 else "retry_wait"
        out.append((job, status, until, attempt, 30 * 2 ** min(attempt, 6) if status == "retry_wait" else None))

    for job, ts, _, kind, attempt in sorted((e for e in events if e[0] is not None and e[1] is not None), key=lambda e: (e[1], e[2])):
        if job in held and ts >= held[job][1]:
            run_out(job)
        if kind == "claim" and job not in held:
            held[job] = (attempt or 0, ts + lease, False)
        elif kind == "complete" and job in held:
            out.append((job, "completed", ts, held.pop(job)[0], None))
        elif kind == "renew" and job in held:
            held[job] = (held[job][0], ts + lease, held[job][2])
        elif kind == "cancel" and job in held:
            held[job] = (*held[job][:2], True)
    mark = max((e[1] for e in events if e[0] is not None and e[1] is not None), default=AT) - late
    for job in [j for j, h in held.items() if h[1] <= mark]:
        run_out(job)
    return Counter(out)


def drawn(seed, n=400, jobs=12):
    draw = random.Random(seed)
    kinds = ["claim", "claim", "renew", "renew", "cancel", "complete", "unknown"]
    return [(draw.randrange(jobs), AT + draw.randrange(30 * 24 * 60) * HOUR / 60, i, draw.choice(kinds), draw.choice((0, 1, 2, 3, 4, None))) for i in range(n)]


def stream(spark, folder, parts):
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def found(df):
    return Counter((r.job_id, r.status, r.ended_at, r.attempt, r.delay_seconds) for r in df.collect())


@pytest.mark.parametrize("batches", [1, 3])
def test_leases_do_not_depend_on_the_batches(spark, tmp_path, batches):
    events = sorted(drawn(batches), key=lambda e: e[1])
    size = -(-len(events) // batches)
    parts = [random.Random(1).sample(events[i : i + size], len(events[i : i + size])) for i in range(0, len(events), size)]
    parts[0] += [(None, AT, 1000, "claim", 1), (3, None, 1001, "claim", 1)]
    got = found(leases.run(stream(spark, f"file://{tmp_path}/in", parts)))
    assert got == by_hand(events) and {k[1] for k in got} == {"completed", "cancelled", "failed", "retry_wait"}


def test_a_restart_goes_on_and_ends_nothing_twice(spark, tmp_path):
    events = sorted(drawn(9), key=lambda e: e[1])
    read = stream(spark, f"file://{tmp_path}/in", [events[:250]])
    root = f"file://{tmp_path}/run"
    leases.run(read, root=root)
    read = stream(spark, f"file://{tmp_path}/in", [events[250:]])
    assert found(leases.run(read, root=root)) == by_hand(events)
    assert found(leases.run(read, root=root)) == by_hand(events)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").find("RocksDB") < 0


def test_state_goes_with_its_lease(spark, tmp_path):
    """Leases that ran out or were completed leave nothing in the state store."""
    events = [(j, AT + j * HOUR, j, "claim", 1) for j in range(5)] + [(0, AT + HOUR, 10, "complete", 1), (99, AT + 24 * 30 * HOUR, 11, "claim", 1)]
    root = f"file://{tmp_path}/run"
    got = found(leases.run(stream(spark, f"file://{tmp_path}/in", [events]), root=root))
    assert Counter(k[1] for k in got) == {"completed": 1, "retry_wait": 4}
    left = spark.read.format("statestore").option("stateVarName", "lease").load(f"{root}/checkpoint")
    assert [r.key.job_id for r in left.collect()] == [99]
