"""Decision tables: action policy, fix risk, plans and quotas, draft quality."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

#: Action types and path markers of the policy.
HIGH_RISK = ("domain_migration", "sitewide_redirect", "robots_update", "bulk_noindex", "delete_content", "canonical_bulk", "template_rewrite")
AUTO = ("recommendation", "metadata_update", "internal_link_add", "schema_add", "content_refresh_draft")
PROTECTED = (".github/workflows/", "robots.txt", "next.config", "middleware.", "wp-config.php", ".env")
TYPES = ("metadata_update", "robots_update", "schema_add", "redirect_update", "delete_content", "internal_link_add", "canonical_update")
PATHS = ("app/page.tsx", "public/robots.txt", "next.config.js", "content/post.md")


def _pick_sql(xs, by: str) -> str:
    return f"list_extract([{', '.join(f"'{x}'" for x in xs)}], CAST({by} % {len(xs)} AS INT) + 1)"


ACTIONS_SQL = f"""actions AS (SELECT o_orderkey AS action_id, {_pick_sql(TYPES, 'o_orderkey')} AS action_type, CAST(o_orderkey % 60 AS INT) AS submitted_risk, CASE WHEN o_orderkey % 3 = 0 THEN 'github' ELSE 'cms' END AS adapter,
 {_pick_sql(PATHS, '(o_orderkey // 7)')} AS path, CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS delete_count, CAST(floor(o_totalprice / 4000) AS INT) AS affected_pages FROM orders)"""


def decided(actions: DataFrame) -> DataFrame:
    """Risk score, level, mode and who may approve."""
    floor_ = lambda on, n: F.when(on, n).otherwise(0)
    protected = F.greatest(*[F.contains("path", F.lit(m)) for m in PROTECTED])
    pages = F.col("affected_pages")
    score = F.greatest(F.least(F.greatest(F.col("submitted_risk"), F.lit(0)), F.lit(100)), floor_(F.col("adapter") == "github", 30), floor_(F.col("action_type").isin(*HIGH_RISK), 80), floor_(protected, 90), floor_(F.col("delete_count") > 0, 75), F.when(pages >= 100, 70).when(pages >= 20, 45).otherwise(0))
    a = actions.withColumn("risk_score", score.cast("int"))
    s, auto = F.col("risk_score"), F.col("action_type").isin(*AUTO)
    return a.select(
        "action_id", "action_type", "risk_score", F.when(s >= 70, "high").when(s >= 30, "medium").otherwise("low").alias("risk_level"),
        F.when(s >= 90, "blocked").when((s >= 30) | ~auto, "manual_approval").otherwise("auto_approve").alias("mode"),
        F.when(s >= 70, "owner").when((s >= 30) | ~auto, "owner,admin").otherwise("system").alias("allowed_roles"),
    )


DECIDED_CTE = f"""{ACTIONS_SQL}, s AS (SELECT *, CAST(greatest(least(greatest(submitted_risk, 0), 100), CASE WHEN adapter = 'github' THEN 30 ELSE 0 END,
 CASE WHEN action_type IN ({', '.join(f"'{x}'" for x in HIGH_RISK)}) THEN 80 ELSE 0 END, CASE WHEN {' OR '.join(f"contains(path, '{m}')" for m in PROTECTED)} THEN 90 ELSE 0 END,
 CASE WHEN delete_count > 0 THEN 75 ELSE 0 END, CASE WHEN affected_pages >= 100 THEN 70 WHEN affected_pages >= 20 THEN 45 ELSE 0 END) AS INT) AS risk_score, action_type IN ({', '.join(f"'{x}'" for x in AUTO)}) AS auto FROM actions),
decided AS (SELECT action_id, action_type, risk_score, CASE WHEN risk_score >= 70 THEN 'high' WHEN risk_score >= 30 THEN 'medium' ELSE 'low' END AS risk_level,
 CASE WHEN risk_score >= 90 THEN 'blocked' WHEN risk_score >= 30 OR NOT auto THEN 'manual_approval' ELSE 'auto_approve' END AS mode,
 CASE WHEN risk_score >= 70 THEN 'owner' WHEN risk_score >= 30 OR NOT auto THEN 'owner,admin' ELSE 'system' END AS allowed_roles FROM s)"""
DECIDED_SQL = f"WITH {DECIDED_CTE} SELECT * FROM decided"


def decision_counts(found: DataFrame) -> DataFrame:
    return found.groupingSets([["mode"], ["risk_level"]], "mode", "risk_level").agg(F.count("*").alias("n"))


DECISION_COUNTS_SQL = f"WITH {DECIDED_CTE} SELECT mode, risk_level, count(*) AS n FROM decided GROUP BY GROUPING SETS ((mode), (risk_level))"


def fix_risk(severity: Column, path: Column, changed_files: Column, action_type: Column, sensitive: tuple[str, ...] = ("auth", "billing", "config", "middleware", "security", ".env")) -> Column:
    s = F.lower(F.coalesce(severity, F.lit("medium")))
    hot = F.greatest(*[F.contains(F.lower(F.coalesce(path, F.lit(""))), F.lit(m)) for m in sensitive])
    return (
        F.when(s == "critical", 4).when(s == "high", 3).when(s == "low", 1).otherwise(2)
        + F.when(changed_files >= 5, 3).when(changed_files >= 2, 1).otherwise(0)
        + F.when(hot, 4).otherwise(0)
        + F.when(action_type.isin("github_pr", "wordpress_update"), 0).otherwise(2)
    )


def execution_mode(passed: Column, risk: Column, autonomous: Column) -> Column:
    return F.when(~passed, "blocked").when(~autonomous | (risk >= 8), "needs_approval").otherwise("auto_execute")


def fixes(actions: DataFrame) -> DataFrame:
    """Sample fixes with risk and mode."""
    sev = F.element_at(F.array(*[F.lit(x) for x in ("critical", "high", "medium", "low")]), (F.col("action_id") % 4 + 1).cast("int"))
    files = (F.col("action_id") % 7).cast("int")
    kind = F.when(F.col("adapter") == "github", "github_pr").otherwise(F.col("action_type"))
    a = actions.select("action_id", fix_risk(sev, F.col("path"), files, kind).cast("int").alias("risk"), (F.col("action_id") % 10 != 0).alias("passed"), (F.col("action_id") % 2 == 0).alias("auto"))
    return a.select("action_id", "risk", F.when(F.col("risk") >= 8, "high").when(F.col("risk") >= 5, "medium").otherwise("low").alias("level"), execution_mode(F.col("passed"), F.col("risk"), F.col("auto")).alias("mode"))


FIXES_SQL = f"""WITH {ACTIONS_SQL}, r AS (SELECT action_id, CAST(CASE action_id % 4 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 1 END + CASE WHEN action_id % 7 >= 5 THEN 3 WHEN action_id % 7 >= 2 THEN 1 ELSE 0 END
 + CASE WHEN regexp_matches(lower(path), 'auth|billing|config|middleware|security|\\.env') THEN 4 ELSE 0 END + CASE WHEN adapter = 'github' THEN 0 ELSE 2 END AS INT) AS risk FROM actions)
SELECT action_id, risk, CASE WHEN risk >= 8 THEN 'high' WHEN risk >= 5 THEN 'medium' ELSE 'low' END AS level,
 CASE WHEN action_id % 10 = 0 THEN 'blocked' WHEN action_id % 2 <> 0 OR risk >= 8 THEN 'needs_approval' ELSE 'auto_execute' END AS mode FROM r"""

#: Monthly limits of the plans.
PLANS = {"audit": (1, 500, 25, 100_000, 50, 1), "growth": (5, 10_000, 500, 2_000_000, 1_000, 5), "scale": (25, 100_000, 5_000, 20_000_000, 10_000, 25)}
LIMITS = ("sites", "monthly_crawl_pages", "ai_requests", "ai_tokens", "serp_queries", "team_members")


def usage(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Crawled pages per workspace and calendar month against the plan's limit."""
    plan = F.when(F.col("c_custkey") % 3 == 0, "audit").when(F.col("c_custkey") % 3 == 1, "growth").otherwise("scale")
    limit = F.element_at(F.create_map(*[x for k, v in PLANS.items() for x in (F.lit(k), F.lit(v[1]))]), F.col("plan"))
    used = orders.groupBy(F.col("o_custkey").alias("c_custkey"), F.date_trunc("month", "o_orderdate").cast("date").alias("period")).agg(F.sum(F.floor(F.col("o_totalprice") / 100)).alias("used"))
    return used.join(customers.select("c_custkey", plan.alias("plan")), "c_custkey").select("c_custkey", "period", "plan", "used", limit.alias("quota"), (F.col("used") > limit).alias("over"))


USAGE_SQL = """WITH u AS (SELECT o_custkey AS c_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, CAST(sum(floor(o_totalprice / 100)) AS BIGINT) AS used FROM orders GROUP BY ALL),
p AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'audit' WHEN 1 THEN 'growth' ELSE 'scale' END AS plan FROM customer), q AS (SELECT *, CASE plan WHEN 'audit' THEN 500 WHEN 'growth' THEN 10000 ELSE 100000 END AS quota FROM u JOIN p USING (c_custkey))
SELECT c_custkey, period, plan, used, quota, used > quota AS over FROM q"""


def rate_limited(events: DataFrame, most: int = 5) -> DataFrame:
    """Requests per user and day, and whether the user is over the daily limit."""
    return events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).withColumn("rejected", F.col("n") >= most)


RATE_SQL = "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, count(*) >= 5 AS rejected FROM events GROUP BY ALL"


DAY, SIX_HOURS = 24 * 3600 * 10**6, 6 * 3600 * 10**6


def audit_requests(requests: DataFrame, most: int = 5) -> DataFrame:
    """requests (request_id, requester, email, domain, ts) -> recent, limited and duplicate_of.

    recent: requests of the same requester in the 24 hours before; limited from `most` on, never without a requester. duplicate_of:
    the last request for the same address and domain in the six hours before. Requests of one moment
    do not see each other, and those without a time see none. Windows hold one day of a requester with the day before, however many there are;
    their frames begin at the window's first row, so that each row is added once: a frame that slides is read anew for every row.
    """
    at = requests.withColumn("__at", F.unix_micros(F.col("ts").cast("timestamp")))

    def before(rows: DataFrame, keys: list[str], span: int, of: dict[str, Callable[[WindowSpec], Column]]) -> DataFrame:
        # Each row is in the window of its own span and, to be seen, in that of the span after.
        cell = F.floor(F.col("__at") / span)
        place = lambda c, own: F.struct(c.alias("__cell"), F.lit(own).alias("__own"))
        spread = rows.select("*", F.inline(F.array(place(cell, True), place(cell + 1, False))))
        w = Window.partitionBy(*keys, "__cell").orderBy("__at")
        return spread.withColumns({name: f(w) for name, f in of.items()}).where("__own").drop("__cell", "__own")

    until = lambda w, micros: w.rangeBetween(Window.unboundedPreceding, micros)
    counted = before(at, ["requester"], DAY, {"recent": lambda w: F.count("*").over(until(w, -1)) - F.count("*").over(until(w, -DAY - 1))})
    seen = before(counted, ["email", "domain"], SIX_HOURS, {"__last": lambda w: F.max(F.struct("__at", "request_id")).over(until(w, -1))})
    known = F.col("__at").isNotNull() & (F.col("__last.__at") >= F.col("__at") - SIX_HOURS)
    recent = F.when(F.col("requester").isNull() | F.col("__at").isNull(), 0).otherwise(F.col("recent"))
    return seen.select("request_id", "requester", "ts", recent.alias("recent"), (recent >= most).alias("limited"), F.when(known, F.col("__last.request_id")).alias("duplicate_of"))


REQUESTS_SQL = """WITH r AS (SELECT event_id AS request_id, CASE WHEN user_id % 7 > 0 THEN user_id END AS requester, user_id % 15 AS email, event_type AS domain, ts FROM events),
w AS (SELECT *, CASE WHEN requester IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY requester ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) END AS recent,
 arg_max(request_id, (ts, request_id)) OVER (PARTITION BY email, domain ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS duplicate_of FROM r)
SELECT request_id, requester, ts, recent, recent >= 5 AS limited, duplicate_of FROM w"""


METERED = ("monthly_crawl_pages", "ai_requests", "ai_tokens", "serp_queries")


def recorded(counters: DataFrame, uses: DataFrame) -> DataFrame:
    """Counters (workspace, metric, period, quantity) after uses of the same columns: each adds to its counter, or begins one.

    Uses of unknown metrics and of less than one are refused. Uses are summed before they meet a counter.
    """
    good = uses.where(F.col("metric").isin(*METERED) & (F.col("quantity") >= 1)).select("workspace", "metric", "period", "quantity")
    return counters.select("workspace", "metric", "period", "quantity").unionByName(good).groupBy("workspace", "metric", "period").agg(F.sum("quantity").alias("quantity"))


def usage_snapshot(counters: DataFrame, limits: DataFrame, period: str) -> DataFrame:
    """For each workspace and metric what is used in the period, and the limit (limits: one row for each workspace, as entitlements gives them)."""
    metrics = limits.select("workspace", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("bigint").alias("quota")) for m in METERED])).alias("m")).select("workspace", "m.*")
    used = counters.where(F.col("period") == F.lit(period).cast("date")).select("workspace", "metric", F.col("quantity").alias("used"))
    return metrics.join(used, ["workspace", "metric"], "left").select("workspace", "metric", F.coalesce("used", F.lit(0)).alias("used"), "quota")


def state_counts(actions: DataFrame) -> DataFrame:
    """Actions by status and by level of risk, in one pass of grouping sets."""
    return actions.groupingSets([["status"], ["risk_level"]], "status", "risk_level").agg(F.count("*").alias("n"))
