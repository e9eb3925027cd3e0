"""Ordered folds in pieces against one step at a time."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from searchlift.functions import folds
from searchlift.operators import governance, pacing
from searchlift.streaming import events as streams

AT = datetime.datetime(2024, 1, 1)
ANSWER = "host string, ts timestamp, event_id long, status_code int, bot_blocked boolean, retry_after string"


class Pacer:
    """Delay, scale and throttled answers of one host, one answer at a time."""

    def __init__(self, base=0.15, top=30.0):
        self.base, self.top, self.delay, self.scale, self.throttled = base, top, base, 1.0, 0

    def record(self, status, bot, after):
        if bot or status in (429, 503):
            self.throttled += 1
            self.delay = min(self.top, 2 * max(self.delay, self.base, 0.25))
            self.scale = max(0.25, self.scale / 2)
        elif status is not None and status < 400:
            self.delay = max(self.base, 0.8 * self.delay)
            self.scale = min(1.0, self.scale + 0.1)
        try:
            self.delay = min(self.top, max(self.delay, float(after)))
        except (TypeError, ValueError):
            pass


def by_hand(answers):
    hosts = {}
    for host, _, _, status, bot, after in sorted(answers, key=lambda a: (a[1], a[2])):
        hosts.setdefault(host, Pacer()).record(status, bot, after)
    return {h: (pytest.approx(p.delay, abs=1e-6), pytest.approx(p.scale, abs=1e-6), p.throttled, max(1, int(round(8 * p.scale, 6)))) for h, p in hosts.items()}


def drawn(seed, n, hosts):
    draw = random.Random(seed)
    bad = lambda: draw.random() < 0.3
    return [(draw.choice(hosts), AT + datetime.timedelta(seconds=draw.randrange(n)), i, draw.choice((429, 503)) if bad() else draw.choice((200, 200, 301, 404, 500, None)), draw.random() < 0.05, draw.choice((None, None, None, "", " 7 ", "0.5", "soon", "120", "-3", "1e"))) for i in range(n)]


def found(df):
    return {r.host: (r.delay, r.scale, r.throttled, r.concurrency) for r in df.collect()}


@pytest.mark.parametrize("piece", [2, 7, 1000])
def test_pieces_do_not_show(spark, monkeypatch, piece):
    monkeypatch.setattr(folds, "PIECE", piece)
    monkeypatch.setattr(folds.ordered_fold, "__defaults__", (piece,))
    answers = drawn(piece, 1500, ["hot"] * 20 + ["a", "b", None])
    assert found(pacing.paced(spark.createDataFrame(answers, ANSWER).repartition(5))) == by_hand(answers)


def test_long_runs_of_one_kind_overflow_nothing(spark):
    codes = [429] * 1500 + [200] * 4000 + [429] * 3
    answers = [("h", AT, i, c, None, None) for i, c in enumerate(codes)] + [("never", AT, i, 200, False, None) for i in range(5000)]
    assert found(pacing.paced(spark.createDataFrame(answers, ANSWER))) == by_hand(answers)


def test_a_hot_host_is_cut(spark):
    answers = spark.range(0, 40_000, 1, 8).select(F.lit("h").alias("host"), F.lit(AT).alias("ts"), F.col("id").alias("event_id"), F.lit(200).alias("status_code"), F.lit(False).alias("bot_blocked"), F.lit(None).cast("string").alias("retry_after"))
    pieces = folds._pieces(answers.repartitionByRange("host", "ts", "event_id").select("host", F.monotonically_increasing_id().alias("__at"), pacing.answer_step(0.15, 30.0).alias("step")), ["host"], pacing.both, 1000)
    assert 40 <= pieces.count() <= 44
    assert found(pacing.paced(answers)) == {"h": (0.15, 1.0, 0, 8)}


def test_no_answers(spark):
    assert pacing.paced(spark.createDataFrame([], ANSWER)).count() == 0


def test_a_stream_of_answers_carries_its_states(spark, tmp_path):
    """Batches in order of time give what one fold over all gives; hosts without new answers stay; a second run adds nothing."""
    answers = sorted(drawn(5, 300, ["a", "b", "c"]), key=lambda a: (a[1], a[2]))
    answers = [a for a in answers[:200]] + [a for a in answers[200:] if a[0] != "c"]
    root, read = f"file://{tmp_path}/run", lambda: spark.readStream.schema(ANSWER).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    for i in range(0, len(answers), 100):
        spark.createDataFrame(answers[i : i + 100], ANSWER).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    assert found(streams.paced(read(), root)) == by_hand(answers)
    assert found(streams.paced(read(), root)) == by_hand(answers)


def history(action, events):
    status, version = action
    for event, expected in events:
        to = next((to for e, froms, to in governance.MOVES if e == event and status in froms), None)
        if to and expected == version:
            status, version = to, version + 1
    return status, version, version - action[1]


@pytest.mark.parametrize("seed", range(3))
def test_histories_of_any_length(spark, seed):
    draw = random.Random(seed)
    names = [m[0] for m in governance.MOVES] + ["unknown"]
    events = [(draw.choice((1, 1, 1, 2, 3, None)), i, draw.choice(names), draw.choice((1, 2, 2, 3, 4, 5, 6, None))) for i in range(900)]
    life = [(4, 10 * i, e, i + 1) for i, e in enumerate(("propose", "approve", "queue", "start", "validate", "succeed", "queue_rollback", "roll_back", "rolled_back", "cancel"))]
    log = spark.createDataFrame(draw.sample(events + life, 910), "action_id long, seq long, event string, expected_version int").repartition(3)
    actions = {1: ("draft", 1), 2: ("draft", 2), 3: ("executing", 3), 4: ("draft", 1), 9: ("approved", 7)}
    df = spark.createDataFrame([(k, *v) for k, v in actions.items()], "action_id long, status string, version int")
    want = {k: history(v, [(e, x) for a, _, e, x in sorted(events + life, key=lambda e: e[1]) if a == k]) for k, v in actions.items()}
    got = {r.action_id: (r.status, r.version, r.moves) for r in governance.histories(df, log).collect()}
    assert got == want and got[4] == ("rolled_back", 10, 9)
    assert {r.action_id: r.status for r in governance.histories(df, log.where("false")).collect()} == {k: v[0] for k, v in actions.items()}


def test_short_and_long_histories_are_one(spark):
    """Logs at and beyond the bound of one row give what one event at a time gives; short ones shuffle events, no tables of moves."""
    draw = random.Random(7)
    names = [m[0] for m in governance.MOVES] + ["unknown", None]
    events = [(a, i, draw.choice(names), draw.choice((1, 2, 3, 4, None))) for a, n in ((1, 40), (2, 41), (3, 300), (4, 3), (None, 60), (8, 50)) for i in range(n)]
    log = spark.createDataFrame(draw.sample(events, len(events)), "action_id long, seq long, event string, expected_version int").repartition(3)
    actions = {1: ("draft", 1), 2: ("draft", 1), 3: ("draft", 2), 4: ("draft", 1), 5: ("approved", 7)}
    df = spark.createDataFrame([(k, *v) for k, v in actions.items()] + [(None, "draft", 1)], "action_id long, status string, version int")
    want = {k: history(v, [(e, x) for a, _, e, x in sorted((e for e in events if e[0] == k), key=lambda e: e[1])]) for k, v in actions.items()} | {None: ("draft", 1, 0)}
    for long in (0, 40, 1000):
        assert {r.action_id: (r.status, r.version, r.moves) for r in governance.histories(df, log, long).collect()} == want
    assert "to_version" not in governance.histories(df, log)._jdf.queryExecution().toString()
