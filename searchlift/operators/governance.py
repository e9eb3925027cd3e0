"""Governed actions: what they touch, what a plan allows, how they move from state to state, and which are due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from searchlift.functions.folds import ordered_fold
from searchlift.operators.content import PAGE_TEXTS_SQL, RECOMMEND_SQL, decay_sql, gain_sql
from searchlift.operators.measurement import OUTCOMES_SQL
from searchlift.operators.policy import LIMITS, PLANS
from searchlift.sources.staging import staged
from searchlift.sources.tables import PAGE_QUERIES_SQL

#: Keys of a target and of a diff that name paths.
TARGET_KEYS, DIFF_KEYS = ("path", "paths", "target_path", "protected_paths"), ("path", "paths", "files_changed", "files_deleted")
#: States that an action does not leave by itself, and what each event makes of an action in which state.
FINAL = ("succeeded", "failed", "rejected", "cancelled", "blocked", "rolled_back")
MOVES = (
    ("propose", ("draft",), "needs_approval"), ("block", ("draft",), "blocked"), ("auto_approve", ("draft",), "approved"), ("approve", ("needs_approval",), "approved"), ("reject", ("needs_approval",), "rejected"),
    ("queue", ("approved",), "execution_queued"), ("start", ("execution_queued",), "executing"), ("validate", ("executing",), "validating"), ("succeed", ("validating",), "succeeded"), ("fail", ("executing", "validating", "rolling_back"), "failed"),
    ("queue_rollback", ("succeeded",), "rollback_queued"), ("roll_back", ("rollback_queued",), "rolling_back"), ("rolled_back", ("rolling_back",), "rolled_back"), ("cancel", ("draft", "needs_approval", "approved", "execution_queued"), "cancelled"),
)

#: Events of one action that are walked in one row; a longer log is folded in pieces.
LONG = 1_000


def target_paths(target: Column, diff: Column) -> Column:
    """The paths (trimmed, lower case) that a target and a diff name as JSON objects, under keys that hold a text, a list of texts, or files with a path."""

    def values(json: Column, key: str) -> Column:
        raw = F.get_json_object(json, f"$.{key}")
        listed = F.from_json(raw, "array<string>")
        return F.when(raw.isNull(), F.array().cast("array<string>")).when(F.startswith(F.trim(raw), F.lit("[")), F.coalesce(listed, F.array().cast("array<string>"))).when(F.startswith(F.trim(raw), F.lit("{")), F.array().cast("array<string>")).otherwise(F.array(raw))

    files = F.coalesce(F.transform(F.from_json(F.get_json_object(diff, "$.files"), "array<struct<path: string>>"), lambda f: f.path), F.array().cast("array<string>"))
    every = F.concat(*[values(target, k) for k in TARGET_KEYS], *[values(diff, k) for k in DIFF_KEYS], files)
    return F.filter(F.transform(every, lambda v: F.lower(F.trim(v))), lambda v: v.isNotNull() & (v != ""))


def measurement_target(plan: Column, action_plan: Column, diff: Column, evidence: Column) -> Column:
    """The URL that an action is measured by: the measurement plan's, else the first target or affected URL of plan, action plan and diff, else the first URL of its evidence."""
    first = lambda json: F.coalesce(*[F.get(F.from_json(F.get_json_object(json, f"$.{k}"), "array<string>"), F.lit(0)) for k in ("target_urls", "affected_urls")])
    seen = F.get(F.filter(F.transform(F.from_json(evidence, "array<struct<url: string>>"), lambda e: e.url), lambda u: u.isNotNull()), F.lit(0))
    return F.coalesce(F.get_json_object(plan, "$.target_url"), first(plan), first(action_plan), first(diff), seen)


def named_targets(plans: DataFrame) -> DataFrame:
    return plans.select("action_id", F.array_join(target_paths(F.col("target"), F.col("diff")), "|").alias("paths"), measurement_target(F.col("plan"), F.lit("{}"), F.col("diff"), F.col("evidence")).alias("measured_url"))


TARGETS_SQL = """WITH o AS (SELECT o_orderkey AS k, concat('https://shop.example.com/o/', o_orderkey) AS url FROM orders),
p AS (SELECT *, CASE k % 3 WHEN 0 THEN [concat('public/', k, '.txt')] WHEN 1 THEN ['a', concat('b/', k)] ELSE [] END AS a, CASE k % 4 WHEN 0 THEN [concat('src/', k)] WHEN 1 THEN ['old.md'] ELSE [] END AS b FROM o)
SELECT k AS action_id, array_to_string(list_concat(a, b), '|') AS paths, CASE WHEN k % 5 = 0 THEN url WHEN k % 5 = 1 THEN concat(url, '/t') WHEN k % 4 = 1 THEN concat(url, '/d') WHEN k % 7 < 5 THEN concat(url, '/e') END AS measured_url FROM p"""


def entitlements(subscriptions: DataFrame) -> DataFrame:
    """workspace, plan, overrides (map of texts) -> each limit of the plan, or what a whole number among the overrides puts in its place; other keys count nothing."""
    limit = lambda i: F.element_at(F.create_map(*[x for k, v in PLANS.items() for x in (F.lit(k), F.lit(v[i]))]), F.col("plan"))
    own = lambda name: F.when(F.rlike(F.try_element_at("overrides", F.lit(name)), F.lit("^-?[0-9]+$")), F.try_element_at("overrides", F.lit(name)).cast("int"))
    return subscriptions.select("workspace", "plan", *[F.coalesce(own(name), limit(i)).alias(name) for i, name in enumerate(LIMITS)])


def _plan_sql(i: int) -> str:
    return f"CASE plan {' '.join(f"WHEN '{k}' THEN {v[i]}" for k, v in PLANS.items())} END"


ENTITLEMENTS_SQL = f"""WITH s AS (SELECT c_custkey AS workspace, CASE c_custkey % 3 WHEN 0 THEN 'audit' WHEN 1 THEN 'growth' ELSE 'scale' END AS plan FROM customer)
SELECT workspace, plan, CASE WHEN workspace % 4 = 0 THEN workspace % 50 ELSE {_plan_sql(0)} END AS sites, {', '.join(f'{_plan_sql(i)} AS {name}' for i, name in enumerate(LIMITS) if i)} FROM s"""


def sandbox(checks: DataFrame) -> DataFrame:
    """checks (run_id, name, passed) -> whether all of a run passed, and those that failed by name."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("name"))))
    return checks.groupBy("run_id").agg(F.every("passed").alias("passed"), F.array_join(failed, ",").alias("failed"), F.count("*").alias("checks"))


SANDBOX_SQL = "SELECT l_orderkey AS run_id, bool_and(l_quantity >= 10) AS passed, coalesce(string_agg(concat('check_', l_linenumber, '_', l_partkey), ',' ORDER BY concat('check_', l_linenumber, '_', l_partkey)) FILTER (l_quantity < 10), '') AS failed, count(*) AS checks FROM lineitem GROUP BY 1"


def transitions(actions: DataFrame, events: DataFrame) -> DataFrame:
    """actions (action_id, status, version) and one event each (action_id, event, expected_version) -> the state after it.

    An event of another version than the action's, or one that its state does not allow, is refused and changes nothing.
    """
    moved = F.coalesce(*[F.when((F.col("event") == e) & F.col("status").isin(*states), F.lit(to)) for e, states, to in MOVES])
    j = actions.join(events, "action_id").withColumn("to", F.when(F.col("version") == F.col("expected_version"), moved))
    ok = F.col("to").isNotNull()
    return j.select("action_id", "event", F.col("status").alias("from_status"), F.coalesce("to", "status").alias("status"), (F.col("version") + ok.cast("int")).alias("version"), F.when(ok, "moved").when(F.col("version") != F.col("expected_version"), "stale").otherwise("refused").alias("outcome"))


def moves_sql() -> str:
    states = sorted({s for _, froms, to in MOVES for s in (*froms, to)})
    listed = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    moved = " ".join(f"WHEN event = '{e}' AND from_status IN ({', '.join(f"'{x}'" for x in froms)}) THEN '{to}'" for e, froms, to in MOVES)
    return f"""WITH a AS (SELECT o_orderkey AS action_id, list_extract({listed(states)}, CAST(o_orderkey % {len(states)} AS INT) + 1) AS from_status, CAST(1 + o_orderkey % 3 AS INT) AS v, list_extract({listed([m[0] for m in MOVES])}, CAST((o_orderkey // 3) % {len(MOVES)} AS INT) + 1) AS event, CASE WHEN o_orderkey % 11 = 0 THEN 9 ELSE 1 + o_orderkey % 3 END AS e FROM orders),
m AS (SELECT *, CASE WHEN v = e THEN CASE {moved} END END AS t FROM a)
SELECT action_id, event, from_status, coalesce(t, from_status) AS status, v + CAST(t IS NOT NULL AS INT) AS version, CASE WHEN t IS NOT NULL THEN 'moved' WHEN v <> e THEN 'stale' ELSE 'refused' END AS outcome FROM m"""


def event_moves() -> Column:
    """event, expected_version -> the moves that the event makes: from a status and version to the ones after it."""
    move = lambda frm, to: F.struct(F.lit(frm).alias("status"), F.col("expected_version").cast("bigint").alias("version"), F.lit(to).alias("to_status"), (F.col("expected_version") + 1).cast("bigint").alias("to_version"))
    none = F.array().cast("array<struct<status: string, version: bigint, to_status: string, to_version: bigint>>")
    return F.when(F.col("expected_version").isNull(), none).otherwise(F.coalesce(*[F.when(F.col("event") == e, F.array(*[move(s, to) for s in states])) for e, states, to in MOVES], none))


def all_moves(first: Column, then: Column) -> Column:
    """The table of both tables' moves, one after the other; what neither names stays as it is."""
    after = lambda e: F.get(F.filter(then, lambda t: (t.status == e.to_status) & (t.version == e.to_version)), 0)
    moved = lambda e, t: F.struct(e.status.alias("status"), e.version.alias("version"), F.coalesce(t.to_status, e.to_status).alias("to_status"), F.coalesce(t.to_version, e.to_version).alias("to_version"))
    went_on = F.transform(first, lambda e: F.get(F.transform(F.array(after(e)), lambda t: moved(e, t)), 0))
    return F.concat(went_on, F.filter(then, lambda t: ~F.exists(first, lambda e: (e.status == t.status) & (e.version == t.version))))


def histories(actions: DataFrame, log: DataFrame, long: int = LONG) -> DataFrame:
    """actions (action_id, status, version) after a log of events (action_id, seq, event, expected_version) of any length, in order of seq.

    The events of an action that has no more than `long` are walked in a row of their own; longer logs are folded in pieces.
    An event of another version than the action's, without one, or that its status does not
    allow moves nothing; equal places of a log count in any order; events of unknown actions are left out.
    """
    log = log.where("action_id IS NOT NULL")
    many = staged(log.groupBy("action_id").agg(F.count("*").alias("n")).where(F.col("n") > long).select("action_id"), "long-logs")
    if many.isEmpty():
        return _walked(actions, log)
    short = _walked(actions.join(many, "action_id", "left_anti"), log.join(many, "action_id", "left_anti"))
    return short.unionByName(_folded(actions.join(many, "action_id", "left_semi"), log.join(many, "action_id", "left_semi")))


def _walked(actions: DataFrame, log: DataFrame) -> DataFrame:
    """Histories of actions with few events each: one row holds an action's events by their numbers in MOVES."""
    number = F.coalesce(*[F.when(F.col("event") == e, F.lit(i)) for i, (e, _, _) in enumerate(MOVES)]).cast("byte")
    slim = log.select("action_id", "seq", number.alias("event"), "expected_version").where("event IS NOT NULL AND expected_version IS NOT NULL")
    # Dealt by action first, so that rows of four numbers are shuffled and not arrays of them.
    events = slim.repartition("action_id").groupBy("action_id").agg(F.array_sort(F.collect_list(F.struct("seq", "event", "expected_version"))).alias("events"))

    def moved(now: Column, e: Column) -> Column:
        to = F.coalesce(*[F.when((e.event == i) & now.status.isin(*froms), F.lit(to)) for i, (_, froms, to) in enumerate(MOVES)])
        return F.when(now.version == e.expected_version, F.struct(F.coalesce(to, now.status).alias("status"), (now.version + to.isNotNull().cast("bigint")).alias("version"))).otherwise(now)

    start = F.struct(F.col("status").alias("status"), F.col("version").cast("bigint").alias("version"))
    last = F.when(F.col("events").isNull(), start).otherwise(F.reduce("events", start, moved))
    j = actions.join(events, "action_id", "left").withColumn("last", last)
    return j.select("action_id", "last.status", "last.version", (F.col("last.version") - F.col("version")).alias("moves"))


def _folded(actions: DataFrame, log: DataFrame) -> DataFrame:
    """Histories of logs of any length: an event is a table of moves, and tables compose, so a log is folded in pieces of 64 events (functions.folds)."""
    tables = ordered_fold(log, ["action_id"], ["seq"], event_moves(), all_moves, piece=64)
    found = F.get(F.filter("step", lambda m: (m.status == F.col("status")) & (m.version == F.col("version"))), 0)
    j = actions.join(tables, "action_id", "left").withColumn("to", found)
    after = F.coalesce(F.col("to.to_version"), F.col("version").cast("bigint"))
    return j.select("action_id", F.coalesce("to.to_status", "status").alias("status"), after.alias("version"), (after - F.col("version")).alias("moves"))


#: The events of a sample action's life, in order.
LIFE = ("propose", "approve", "queue", "start", "validate", "succeed", "queue_rollback")


def histories_sql() -> str:
    moved = " ".join(f"WHEN event = '{e}' AND status IN ({', '.join(f"'{x}'" for x in froms)}) THEN '{to}'" for e, froms, to in MOVES)
    life = ", ".join(f"'{e}'" for e in LIFE)
    return f"""WITH RECURSIVE e AS (SELECT l_orderkey AS action_id, CASE WHEN l_partkey % 19 = 0 THEN 'cancel' WHEN l_partkey % 17 = 0 THEN 'fail' ELSE list_extract([{life}], CAST((l_linenumber - 1) % {len(LIFE)} AS INT) + 1) END AS event,
 CASE WHEN l_partkey % 13 = 0 THEN l_linenumber - 1 WHEN l_partkey % 11 = 0 THEN l_linenumber + 1 ELSE l_linenumber END AS expected, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i FROM lineitem),
walk AS (SELECT o_orderkey AS action_id, CAST(0 AS BIGINT) AS i, 'draft' AS status, CAST(1 AS BIGINT) AS version FROM orders
UNION ALL SELECT action_id, i, coalesce(t, status), version + CAST(t IS NOT NULL AS BIGINT) FROM (SELECT w.action_id, e.i, w.status, w.version, CASE WHEN e.expected = w.version THEN CASE {moved} END END AS t FROM walk w JOIN e ON e.action_id = w.action_id AND e.i = w.i + 1))
SELECT action_id, status, version, version - 1 AS moves FROM walk QUALIFY row_number() OVER (PARTITION BY action_id ORDER BY i DESC) = 1"""


def due(measured: DataFrame, actions: DataFrame, most: int = 50) -> DataFrame:
    """Actions with measurements that are still open, those not checked for longest first (never checked ones before all)."""
    open_ = measured.where(F.col("status").isin("baseline_pending", "waiting")).groupBy("action_id").agg(F.count("*").alias("open"))
    checked = actions.select("action_id", "last_checked")
    return actions.join(open_, "action_id", "left_semi").select("action_id").join(open_, "action_id").join(checked, "action_id").orderBy(F.asc_nulls_first("last_checked"), "action_id").limit(most).select("action_id", "open", "last_checked")


DUE_SQL = f"""WITH m AS ({OUTCOMES_SQL}), o AS (SELECT action_id, count(*) AS open FROM m WHERE status IN ('baseline_pending', 'waiting') GROUP BY 1)
SELECT action_id, open, CASE WHEN action_id % 3 > 0 THEN DATE '2024-02-20' + CAST(action_id % 7 AS INT) END AS last_checked FROM o ORDER BY last_checked NULLS FIRST, action_id LIMIT 50"""


def newest_connections(connections: DataFrame) -> DataFrame:
    """Of the connections of a workspace (workspace, connection_id, updated_at) the one that stays: the newest, then the largest id."""
    w = Window.partitionBy("workspace").orderBy(F.desc_nulls_last("updated_at"), F.desc("connection_id"))
    return connections.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


CONNECTIONS_SQL = "SELECT o_custkey AS workspace, o_orderkey AS connection_id, o_orderdate AS updated_at FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) = 1"


def backfilled(actions: DataFrame, jobs: DataFrame) -> DataFrame:
    """actions (action_id, payload JSON) with what their job (action_id, status, attempts) tells, where the payload lacks it."""
    j = actions.join(jobs, "action_id", "left")
    known = F.get_json_object("payload", "$.status")
    return j.select("action_id", F.coalesce(known, F.col("job_status"), F.lit("unknown")).alias("status"), F.to_json(F.struct(F.coalesce(known, F.col("job_status"), F.lit("unknown")).alias("status"), F.coalesce("attempts", F.lit(0)).alias("attempts"))).alias("payload"))


BACKFILL_SQL = """WITH a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'done' WHEN o_orderkey % 5 > 0 THEN lower(o_orderstatus) ELSE 'unknown' END AS status, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 4 ELSE 0 END AS attempts FROM orders)
SELECT k AS action_id, status, concat('{"status":"', status, '","attempts":', attempts, '}') AS payload FROM a"""


def content_actions(insights: DataFrame, links: DataFrame) -> DataFrame:
    """Actions on content: a refresh of each page that has decayed by 50 and more, and the thirty best links of each site.

    insights: page_id, decay, gain. links: site, source_id, target_id, priority, confidence, rank.
    """
    refresh = insights.where("decay >= 50").select(F.concat(F.lit("refresh:"), F.col("page_id").cast("string")).alias("action_key"), F.lit("content_refresh_recommendation").alias("action_type"), F.least(F.lit(100), F.col("decay") + 20).cast("int").alias("impact"), F.least(F.lit(100), 60 + F.floor(F.col("gain") / 4)).cast("int").alias("confidence"))
    linked = links.where("rank <= 30").select(F.concat_ws(":", F.lit("link"), F.col("source_id").cast("string"), F.col("target_id").cast("string")).alias("action_key"), F.lit("internal_link_recommendation").alias("action_type"), F.col("priority").alias("impact"), "confidence")
    return refresh.unionByName(linked).withColumns({"effort": F.lit(35), "risk": F.lit(20)})


CONTENT_ACTIONS_SQL = f"""WITH d AS ({decay_sql()}), g AS ({gain_sql(PAGE_TEXTS_SQL, PAGE_QUERIES_SQL)}), r AS ({RECOMMEND_SQL}), i AS (SELECT CAST(regexp_extract(page_url, '([0-9]+)$', 1) AS BIGINT) AS page_id, decay FROM d)
SELECT concat('refresh:', i.page_id) AS action_key, 'content_refresh_recommendation' AS action_type, CAST(least(100, decay + 20) AS INT) AS impact, CAST(least(100, 60 + floor(gain / 4)) AS INT) AS confidence, 35 AS effort, 20 AS risk FROM i JOIN g USING (page_id) WHERE decay >= 50
UNION ALL SELECT concat('link:', source_id, ':', target_id), 'internal_link_recommendation', priority, confidence, 35, 20 FROM r WHERE rank <= 30"""
