"""Outcomes of actions: windows before and after, whether the facts cover them, and what became of each measurement.

A measurement is one (action, window). Its baseline ends the day before the action, its comparison
starts the day after; facts are summed by page and day and meet the windows by page and month-long
buckets, so that no action meets more of a page's days than its windows touch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from searchlift.functions.urls import absolute_target
from searchlift.sources.samples import ACTIONS_CTE, SITE, SYNCED, TODAY
from searchlift.sources.tables import FACTS_SQL

WINDOWS = (7, 14, 30, 60, 90)
#: Days after which facts count as final.
LAG = 3
#: Statuses of actions that are measured, and of those that ended without an effect.
MEASURABLE = ("execution_queued", "executing", "validating", "succeeded", "rollback_queued", "rolling_back", "rolled_back", "failed")
ENDED = ("cancelled", "failed", "rejected", "blocked", "rolled_back")
BUCKET = 30


def outcome(before_clicks: Column, before_imp: Column, after_clicks: Column, after_imp: Column) -> Column:
    """positive, negative, neutral, or insufficient_data below 20 impressions on either side; with the changes and the confidence."""
    ctr = lambda c, i: F.when(i > 0, F.round(c / i, 6)).otherwise(0.0)
    b, a = ctr(before_clicks, before_imp), ctr(after_clicks, after_imp)
    dc = (after_clicks - before_clicks) / F.greatest(before_clicks, F.lit(1.0))
    dt = (a - b) / F.greatest(b, F.lit(0.001))
    di = F.when(before_imp > 0, (after_imp - before_imp) / before_imp).otherwise(0.0)
    best, worst = F.greatest(dc, dt), F.least(dc, dt)
    enough = F.least(before_imp, after_imp) >= 20
    kind = (
        F.when(~enough, "insufficient_data")
        .when((best >= 0.1) & (worst > -0.1) & (di > -0.2), "positive")
        .when((worst <= -0.1) & (best < 0.1) & (di < 0.2), "negative")
        .otherwise("neutral")
    )
    confidence = F.when(enough, F.least(F.lit(95), 40 + F.floor(3 * F.sqrt(F.least(before_imp, after_imp))))).otherwise(0).cast("int")
    change = lambda c, name: F.when(enough, F.round(c, 4)).alias(name)
    return F.struct(kind.alias("outcome"), confidence.alias("confidence"), change(dc, "clicks_change"), change(dt, "ctr_change"), change(di, "impressions_change"))


def merged_ranges(ranges: DataFrame, *keys: str) -> DataFrame:
    """Ranges (first_day, last_day) that overlap or touch, as one: a running end of all ranges before tells where a new one starts."""
    w = Window.partitionBy(*keys).orderBy("first_day", "last_day")
    before = F.max("last_day").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = ranges.withColumn("fresh", (before.isNull() | (F.col("first_day") > F.date_add(before, 1))).cast("int"))
    return starts.withColumn("island", F.sum("fresh").over(w)).groupBy(*keys, "island").agg(F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day")).drop("island")


def covered(windows: DataFrame, ranges: DataFrame, start: str, end: str) -> DataFrame:
    """windows with `synced`: whether one merged range of its site holds the window whole."""
    islands = merged_ranges(ranges, "site").withColumnsRenamed({"first_day": "__from", "last_day": "__to"})
    # Islands are a handful for each site; a site's windows meet those that hold them.
    hit = windows.join(islands, "site").where(f"__from <= {start} AND __to >= {end}").select("action_id", "window_days", F.lit(True).alias("synced")).distinct()
    return windows.join(hit, ["action_id", "window_days"], "left").withColumn("synced", F.coalesce("synced", F.lit(False)))


def window_sums(windows: DataFrame, facts: DataFrame, start: str, end: str, prefix: str) -> DataFrame:
    """windows (action_id, window_days, page_url, start, end) with clicks, impressions and position inside, under the prefix."""
    daily = facts.groupBy("page_url", "metric_date").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.sum(F.col("position") * F.col("impressions")).alias("w"))
    bucket = lambda d: F.floor(F.datediff(d, F.lit("2000-01-01").cast("date")) / BUCKET)
    touched = windows.select("action_id", "window_days", "page_url", start, end, F.explode(F.sequence(bucket(F.col(start)), bucket(F.col(end)))).alias("bucket"))
    inside = touched.join(daily.withColumn("bucket", bucket(F.col("metric_date"))), ["page_url", "bucket"]).where(F.col("metric_date").between(F.col(start), F.col(end)))
    sums = inside.groupBy("action_id", "window_days").agg(*[F.sum(c).alias(f"{prefix}_{c}") for c in ("clicks", "impressions")], F.sum("w").alias("__w"), F.count("*").alias(f"{prefix}_days"))
    zero = lambda c: F.coalesce(f"{prefix}_{c}", F.lit(0.0)).alias(f"{prefix}_{c}")
    position = F.when(F.col(f"{prefix}_impressions") > 0, F.round(F.col("__w") / F.col(f"{prefix}_impressions"), 3)).otherwise(0.0)
    return windows.join(sums, ["action_id", "window_days"], "left").select(*windows.columns, zero("clicks"), zero("impressions"), position.alias(f"{prefix}_position"), F.coalesce(f"{prefix}_days", F.lit(0)).alias(f"{prefix}_days"))


def baselines(actions: DataFrame, facts: DataFrame, ranges: DataFrame, anchor: str = "created_on") -> DataFrame:
    """The windows before each mutating action (before `anchor`, or before today without one): waiting where the facts cover them, else baseline_pending."""
    end = F.date_sub(F.coalesce(anchor, F.lit(TODAY).cast("date")), 1)
    w = actions.where("adapter <> 'simulation'").withColumn("page_url", absolute_target(F.lit(SITE), F.col("target"))).withColumn("window_days", F.explode(F.array(*[F.lit(d) for d in WINDOWS])))
    w = w.withColumn("baseline_end", end).withColumn("baseline_start", F.date_sub("baseline_end", F.col("window_days") - 1))
    w = covered(window_sums(w, facts, "baseline_start", "baseline_end", "before"), ranges, "baseline_start", "baseline_end")
    return w.withColumn("status", F.when(F.col("synced"), "waiting").otherwise("baseline_pending"))


BASELINE_COLUMNS = ("action_id", "window_days", "page_url", "baseline_start", "baseline_end", "before_clicks", "before_impressions", "before_position", "before_days", "synced", "status")


def refreeze(actions: DataFrame, facts: DataFrame, ranges: DataFrame) -> DataFrame:
    """The baselines anew, of actions whose execution has started, from the day before its start."""
    return baselines(actions.where("started_on IS NOT NULL"), facts, ranges, "started_on")


def measurements(actions: DataFrame, facts: DataFrame, ranges: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """What became of each measurement, in the order of the tests: no mutation, no effect, rolled back inside the window, not final yet, not covered, measured."""
    b = baselines(actions.where(F.col("action_status").isin(*MEASURABLE) & (F.col("adapter") != "simulation")), facts, ranges, "started_on").where(F.col("window_days").isin(*windows))
    anchor = F.coalesce("completed_on", "executed_on")
    b = b.withColumn("comparison_start", F.date_add(anchor, 1)).withColumn("comparison_end", F.date_add("comparison_start", F.col("window_days") - 1))
    b = b.withColumnRenamed("synced", "before_synced")
    both = covered(window_sums(b.where("comparison_start IS NOT NULL"), facts, "comparison_start", "comparison_end", "after"), ranges, "comparison_start", "comparison_end")
    none = b.where("comparison_start IS NULL").select("*", F.lit(0.0).alias("after_clicks"), F.lit(0.0).alias("after_impressions"), F.lit(0.0).alias("after_position"), F.lit(0).cast("long").alias("after_days"), F.lit(False).alias("synced"))
    m = both.unionByName(none)
    rolled = (F.col("action_status") == "rolled_back") & (F.col("comparison_end") >= F.col("rolled_back_on"))
    status = (
        F.when(F.col("executed_on").isNotNull() & ~F.col("mutation_applied"), "not_applicable")
        .when(F.col("comparison_start").isNull(), F.when(F.col("action_status").isin(*ENDED), "not_applicable").otherwise(F.col("status")))
        .when(rolled, "censored")
        .when(F.col("comparison_end") > F.date_sub(F.lit(TODAY).cast("date"), LAG), "waiting")
        .when(~F.col("before_synced"), "baseline_pending")
        .when(~F.col("synced"), "waiting")
        .otherwise("measured")
    )
    res = outcome(*[F.col(c) for c in ("before_clicks", "before_impressions", "after_clicks", "after_impressions")])
    m = m.withColumn("status", status).withColumn("r", F.when(F.col("status") == "measured", res))
    return m.select(
        "action_id", "window_days", "status", F.coalesce("r.outcome", F.lit("insufficient_data")).alias("outcome"), F.coalesce("r.confidence", F.lit(0)).alias("confidence"),
        "r.clicks_change", "r.ctr_change", "r.impressions_change", F.when(F.col("status") == "measured", F.col("before_impressions")).alias("before_impressions"), F.when(F.col("status") == "measured", F.col("after_impressions")).alias("after_impressions"),
        F.when(F.col("status") == "censored", F.least("comparison_end", "rolled_back_on")).when(F.col("status") == "measured", F.col("comparison_end")).alias("comparison_end"),
    )


def mark_applied(measured: DataFrame, applied: DataFrame) -> DataFrame:
    """measured (action_id, window_days, status) after the executor has told whether it changed anything: without a change nothing is measured."""
    m = measured.select("action_id", "window_days", "status").join(applied.select("action_id", "mutation_applied"), "action_id")
    return m.select("action_id", "window_days", "mutation_applied", F.when(F.col("mutation_applied"), F.col("status")).otherwise("not_applicable").alias("status"))


def _sums_sql(windows: str, start: str, end: str, prefix: str) -> str:
    return f"""SELECT w.action_id, w.window_days, coalesce(sum(clicks), 0) AS {prefix}_clicks, coalesce(sum(impressions), 0) AS {prefix}_impressions, CASE WHEN sum(impressions) > 0 THEN round(sum(position * impressions) / sum(impressions), 3) ELSE 0 END AS {prefix}_position, count(DISTINCT metric_date) AS {prefix}_days
 FROM {windows} w LEFT JOIN facts f ON f.page_url = w.page_url AND metric_date BETWEEN {start} AND {end} GROUP BY ALL"""


def _baseline_cte(anchor: str, where: str = "true") -> str:
    ok = " OR ".join(f"(baseline_start >= DATE '{a}' AND baseline_end <= DATE '{b}')" for a, b in ((SYNCED[0][0], SYNCED[-1][1]),))
    return f"""{FACTS_SQL}, {ACTIONS_CTE}, wins AS (SELECT unnest([{', '.join(map(str, WINDOWS))}]) AS window_days),
bw AS (SELECT *, coalesce({anchor}, DATE '{TODAY}') - 1 AS baseline_end, coalesce({anchor}, DATE '{TODAY}') - window_days AS baseline_start FROM acts CROSS JOIN wins WHERE adapter <> 'simulation' AND {where}),
bs AS ({_sums_sql('bw', 'baseline_start', 'baseline_end', 'before')}),
base AS (SELECT bw.*, before_clicks, before_impressions, before_position, before_days, {ok} AS synced, CASE WHEN {ok} THEN 'waiting' ELSE 'baseline_pending' END AS status FROM bw JOIN bs USING (action_id, window_days))"""


BASELINES_SQL = f"WITH {_baseline_cte('created_on')} SELECT {', '.join(BASELINE_COLUMNS)} FROM base"
REFREEZE_SQL = f"WITH {_baseline_cte('started_on', 'started_on IS NOT NULL')} SELECT {', '.join(BASELINE_COLUMNS)} FROM base"
MEASURED_CTE = f"""{_baseline_cte('started_on', f"action_status IN {MEASURABLE}")},
cw AS (SELECT *, coalesce(completed_on, executed_on) + 1 AS comparison_start, coalesce(completed_on, executed_on) + window_days AS comparison_end FROM base),
cs AS ({_sums_sql('cw', 'comparison_start', 'comparison_end', 'after')}),
st AS (SELECT cw.*, after_clicks, after_impressions,
  CASE WHEN executed_on IS NOT NULL AND NOT mutation_applied THEN 'not_applicable' WHEN comparison_start IS NULL THEN CASE WHEN action_status IN {ENDED} THEN 'not_applicable' ELSE status END
   WHEN action_status = 'rolled_back' AND comparison_end >= rolled_back_on THEN 'censored' WHEN comparison_end > DATE '{TODAY}' - {LAG} THEN 'waiting' WHEN NOT synced THEN 'baseline_pending'
   WHEN NOT (comparison_start >= DATE '{SYNCED[0][0]}' AND comparison_end <= DATE '{SYNCED[-1][1]}') THEN 'waiting' ELSE 'measured' END AS state FROM cw JOIN cs USING (action_id, window_days)),
ct AS (SELECT *, CASE WHEN before_impressions > 0 THEN round(before_clicks / before_impressions, 6) ELSE 0 END AS b, CASE WHEN after_impressions > 0 THEN round(after_clicks / after_impressions, 6) ELSE 0 END AS a, state = 'measured' AND least(before_impressions, after_impressions) >= 20 AS enough FROM st),
de AS (SELECT *, (after_clicks - before_clicks) / greatest(before_clicks, 1) AS dc, (a - b) / greatest(b, 0.001::DOUBLE) AS dt, CASE WHEN before_impressions > 0 THEN (after_impressions - before_impressions) / before_impressions ELSE 0 END AS di FROM ct),
measured AS (SELECT action_id, window_days, state AS status,
  CASE WHEN NOT enough THEN 'insufficient_data' WHEN greatest(dc, dt) >= 0.1::DOUBLE AND least(dc, dt) > -0.1::DOUBLE AND di > -0.2::DOUBLE THEN 'positive' WHEN least(dc, dt) <= -0.1::DOUBLE AND greatest(dc, dt) < 0.1::DOUBLE AND di < 0.2::DOUBLE THEN 'negative' ELSE 'neutral' END AS outcome,
  CASE WHEN enough THEN CAST(least(95, 40 + floor(3 * sqrt(least(before_impressions, after_impressions)))) AS INT) ELSE 0 END AS confidence,
  CASE WHEN enough THEN round(dc, 4) END AS clicks_change, CASE WHEN enough THEN round(dt, 4) END AS ctr_change, CASE WHEN enough THEN round(di, 4) END AS impressions_change,
  CASE WHEN state = 'measured' THEN before_impressions END AS before_impressions, CASE WHEN state = 'measured' THEN after_impressions END AS after_impressions,
  CASE state WHEN 'censored' THEN least(comparison_end, rolled_back_on) WHEN 'measured' THEN comparison_end END AS comparison_end FROM de)"""
OUTCOMES_SQL = f"WITH {MEASURED_CTE} SELECT * FROM measured"
MARKS_SQL = f"WITH {_baseline_cte('created_on')} SELECT action_id, window_days, mutation_applied, CASE WHEN mutation_applied THEN status ELSE 'not_applicable' END AS status FROM base"


def longest_window(measured: DataFrame) -> DataFrame:
    """Of each action the longest window that was measured with an outcome."""
    return measured.where("status = 'measured' AND outcome <> 'insufficient_data'").groupBy("action_id").agg(F.max("window_days").alias("window_days"), F.max_by("outcome", "window_days").alias("outcome"))


LONGEST_CTE = f"{MEASURED_CTE}, longest AS (SELECT action_id, max(window_days) AS window_days, arg_max(outcome, window_days) AS outcome FROM measured WHERE status = 'measured' AND outcome <> 'insufficient_data' GROUP BY action_id)"
LONGEST_SQL = f"WITH {LONGEST_CTE} SELECT * FROM longest"


def history_adjustment(longest: DataFrame) -> DataFrame:
    """One row: how far past outcomes move a priority, at most 10 either way, from 3 measured actions on."""
    n = longest.agg(F.count_if(F.col("outcome") == "positive").alias("positives"), F.count_if(F.col("outcome") == "negative").alias("negatives"), F.count("*").alias("n"))
    step = F.bround(10 * (F.col("positives") - F.col("negatives")) / F.greatest("n", F.lit(1)), 0)
    return n.withColumn("adjustment", F.when(F.col("n") >= 3, F.greatest(F.lit(-10), F.least(F.lit(10), step))).otherwise(0).cast("int"))


ADJUSTMENT_CTE = f"""{LONGEST_CTE}, adjustment AS (SELECT count(*) FILTER (outcome = 'positive') AS positives, count(*) FILTER (outcome = 'negative') AS negatives, count(*) AS n,
 CAST(CASE WHEN count(*) >= 3 THEN greatest(-10, least(10, round_even(10 * (count(*) FILTER (outcome = 'positive') - count(*) FILTER (outcome = 'negative')) / count(*), 0))) ELSE 0 END AS INT) AS adjustment FROM longest)"""
ADJUSTMENT_SQL = f"WITH {ADJUSTMENT_CTE} SELECT * FROM adjustment"


def adjusted(opportunities: DataFrame, adjustment: DataFrame) -> DataFrame:
    """Opportunities with their priority moved by what past actions came to."""
    by = F.coalesce(adjustment.select("adjustment").scalar(), F.lit(0))
    return opportunities.withColumn("priority", F.greatest(F.lit(0), F.least(F.lit(100), F.col("priority") + by)).cast("int"))
