"""From findings to the actions that resolve them: states, queue, planning order, projection and the pipeline's step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchlift.operators.findings import FINDINGS_CTE

ACTIVE, CANCELLABLE = ("open", "regressed"), ("draft", "needs_approval", "approved")
#: Reasons for which a repository patch may be planned again.
DEFERRED = ("planning_not_attempted", "github_planning_budget_exhausted")


def digit(i: int) -> Column:
    return F.substring("fingerprint", i, 1)


STATES_CTE = f"""{FINDINGS_CTE}, states AS (SELECT fingerprint, finding_type, severity, impact, confidence, effort, action_type, risk, url,
 CASE WHEN fingerprint < '3' THEN 'resolved' WHEN fingerprint < '5' THEN 'dismissed' WHEN fingerprint < '8' THEN 'regressed' ELSE 'open' END AS status, DATE '2024-01-01' + CAST(ascii(substring(fingerprint, 2, 1)) % 10 AS INT) AS last_seen, CAST(ascii(substring(fingerprint, 3, 1)) % 3 AS INT) AS regressions,
 CASE WHEN substring(fingerprint, 5, 1) < 'c' THEN CASE WHEN substring(fingerprint, 6, 1) < '4' THEN 'draft' WHEN substring(fingerprint, 6, 1) < '8' THEN 'approved' ELSE 'succeeded' END END AS action_status,
 CASE WHEN substring(fingerprint, 5, 1) < 'c' THEN CASE WHEN substring(fingerprint, 4, 1) < '4' THEN '{DEFERRED[0]}' WHEN substring(fingerprint, 4, 1) < '6' THEN NULL WHEN substring(fingerprint, 4, 1) < '8' THEN '{DEFERRED[1]}' ELSE 'patch_ready' END END AS reason_code FROM findings)"""


def queue(states: DataFrame, limit: int = 500) -> DataFrame:
    """The first active findings: what has come back, then by severity, impact and how lately it was seen; ties by fingerprint."""
    rank = F.when(F.col("status") == "regressed", 0).when(F.col("severity") == "critical", 1).when(F.col("severity") == "high", 2).when(F.col("severity") == "medium", 3).otherwise(4)
    return states.where(F.col("status").isin(*ACTIVE)).orderBy(rank, F.desc("impact"), F.desc("last_seen"), "fingerprint").limit(limit).select("fingerprint", "finding_type", "status", "severity", "impact", "last_seen", "url")


QUEUE_SQL = f"""WITH {STATES_CTE} SELECT fingerprint, finding_type, status, severity, impact, last_seen, url FROM states WHERE status IN {ACTIVE}
ORDER BY CASE WHEN status = 'regressed' THEN 0 WHEN severity = 'critical' THEN 1 WHEN severity = 'high' THEN 2 WHEN severity = 'medium' THEN 3 ELSE 4 END, impact DESC, last_seen DESC, fingerprint LIMIT 500"""


def planning_order(states: DataFrame, limit: int = 200) -> DataFrame:
    """The next active findings to plan a patch for: those without a plan first, then by how long they have not been seen, then by fingerprint."""
    deferred = F.col("action_status").isNull() | F.col("reason_code").isNull() | F.col("reason_code").isin(*DEFERRED)
    s = states.where(F.col("status").isin(*ACTIVE)).withColumn("deferred", deferred)
    return s.orderBy(F.when(F.col("deferred"), 0).otherwise(1), F.asc_nulls_first("last_seen"), "fingerprint").limit(limit).select("fingerprint", "deferred", "last_seen", "reason_code")


PLANNING_SQL = f"""WITH {STATES_CTE}, d AS (SELECT *, action_status IS NULL OR reason_code IS NULL OR reason_code IN {DEFERRED} AS deferred FROM states WHERE status IN {ACTIVE})
SELECT fingerprint, deferred, last_seen, reason_code FROM d ORDER BY NOT deferred, last_seen NULLS FIRST, fingerprint LIMIT 200"""


def actions(states: DataFrame) -> DataFrame:
    """The action that each finding with an action type asks for.

    Its idempotency key names the finding and how often it has come back, so that a regression asks
    anew; with a patch at hand, the patch's place in the repository as well.
    """
    key = F.concat(F.lit("finding:"), F.col("fingerprint"), F.lit(":r"), F.col("regressions").cast("string"))
    ready = F.coalesce(F.col("reason_code") == "patch_ready", F.lit(False))
    scope = F.substring(F.sha2(F.concat_ws("|", F.lit("main"), "url"), 256), 1, 20)
    return states.where("action_type <> ''").select(
        F.when(ready, F.concat(key, F.lit(":github:"), scope)).otherwise(key).alias("idempotency_key"), "fingerprint", "action_type", F.concat(F.lit("Resolve: "), F.replace("finding_type", F.lit("_"), F.lit(" "))).alias("title"),
        "impact", "confidence", "effort", "risk", F.when(ready, "github").otherwise("simulation").alias("adapter"), F.greatest(F.lit(0), F.least(F.lit(100), F.col("impact") - F.col("effort"))).alias("job_priority"),
    )


ACTIONS_CTE = f"""{STATES_CTE}, projected AS (SELECT concat('finding:', fingerprint, ':r', regressions, CASE WHEN reason_code = 'patch_ready' THEN concat(':github:', substring(sha256(concat('main|', url)), 1, 20)) ELSE '' END) AS idempotency_key, fingerprint, action_type, concat('Resolve: ', replace(finding_type, '_', ' ')) AS title,
 impact, confidence, effort, risk, CASE WHEN reason_code = 'patch_ready' THEN 'github' ELSE 'simulation' END AS adapter, greatest(0, least(100, impact - effort)) AS job_priority FROM states WHERE action_type <> '')"""
ACTIONS_SQL = f"WITH {ACTIONS_CTE} SELECT * FROM projected"


def step(states: DataFrame) -> DataFrame:
    """What a run does to the actions: of resolved findings those not yet executed are cancelled; active ones keep a ready patch or an action of the same key, and get one if they have none."""
    active, has = F.col("status").isin(*ACTIVE), F.col("action_status").isNotNull()
    event = F.when((F.col("status") == "resolved") & F.col("action_status").isin(*CANCELLABLE), "cancelled").when(active & has & (F.coalesce("reason_code", F.lit("")) == "patch_ready"), "ready").when(active & has, "kept").when(active & (F.col("action_type") != ""), "created")
    return states.select("fingerprint", "status", event.alias("event")).where("event IS NOT NULL")


STEP_CTE = f"""{STATES_CTE}, steps AS (SELECT fingerprint, status, CASE WHEN status = 'resolved' AND action_status IN {CANCELLABLE} THEN 'cancelled' WHEN status IN {ACTIVE} AND action_status IS NOT NULL THEN CASE WHEN reason_code = 'patch_ready' THEN 'ready' ELSE 'kept' END
 WHEN status IN {ACTIVE} AND action_type <> '' THEN 'created' END AS event FROM states)"""
STEP_SQL = f"WITH {STEP_CTE} SELECT * FROM steps WHERE event IS NOT NULL"


def step_counts(steps: DataFrame) -> DataFrame:
    return steps.groupBy("event").agg(F.count("*").alias("n"))


STEP_COUNTS_SQL = f"WITH {STEP_CTE} SELECT event, count(*) AS n FROM steps WHERE event IS NOT NULL GROUP BY event"


def fix_metrics(states: DataFrame) -> DataFrame:
    """Of all actions how many are in which state, and the shares that failed or were executed without approval."""
    s = states.where("action_status IS NOT NULL").withColumn("auto", F.col("risk") < 30)
    n = F.greatest(F.count("*"), F.lit(1))
    return s.agg(F.count("*").alias("total"), *[F.count_if(F.col("action_status") == k).alias(k) for k in ("draft", "approved", "succeeded")], F.round(F.count_if(F.col("auto") & (F.col("action_status") == "succeeded")) / n, 4).alias("approval_bypass_rate"), F.round(F.count_if(F.col("status") == "regressed") / n, 4).alias("failure_rate"))


FIX_METRICS_SQL = f"""WITH {STATES_CTE} SELECT count(*) AS total, count(*) FILTER (action_status = 'draft') AS draft, count(*) FILTER (action_status = 'approved') AS approved, count(*) FILTER (action_status = 'succeeded') AS succeeded,
 round(count(*) FILTER (risk < 30 AND action_status = 'succeeded') / greatest(count(*), 1), 4) AS approval_bypass_rate, round(count(*) FILTER (status = 'regressed') / greatest(count(*), 1), 4) AS failure_rate FROM states WHERE action_status IS NOT NULL"""


def health(sites: DataFrame, states: DataFrame, pages: DataFrame, weights: dict[str, int]) -> DataFrame:
    """Per site the health of its active findings; sites without pages have none."""
    from searchlift.operators.findings import grade, weight

    site = F.regexp_replace(F.regexp_extract(F.lower("url"), r"^https?://([^/?#:]+)", 1), r"^www\.", "")
    w = states.where(F.col("status").isin(*ACTIVE)).groupBy(site.alias("site")).agg(F.sum(weight(weights)).alias("w"))
    n = pages.groupBy("site").agg(F.count("*").alias("pages"))
    j = sites.join(n, "site", "left").join(w, "site", "left")
    score = F.when(F.col("pages").isNotNull(), F.greatest(F.lit(0), 100 - F.coalesce("w", F.lit(0)))).cast("int")
    return j.select("site", F.coalesce("pages", F.lit(0)).alias("pages"), score.alias("score"), F.when(score.isNotNull(), grade(score)).alias("grade"))


def health_sql() -> str:
    from searchlift.operators.findings import HEALTH_WEIGHTS, weight_sql

    return f"""WITH {STATES_CTE}, w AS (SELECT f.site, sum({weight_sql(HEALTH_WEIGHTS).replace('CASE severity', 'CASE s.severity')}) AS w FROM states s JOIN findings f USING (fingerprint) WHERE status IN {ACTIVE} GROUP BY f.site),
n AS (SELECT site, count(*) AS pages FROM crawled GROUP BY site UNION ALL SELECT 'empty.example.org', NULL), t AS (SELECT site, coalesce(pages, 0) AS pages, CASE WHEN pages IS NOT NULL THEN CAST(greatest(0, 100 - coalesce(w, 0)) AS INT) END AS score FROM n LEFT JOIN w USING (site))
SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' WHEN score IS NOT NULL THEN 'F' END AS grade FROM t"""


def state_counts(states: DataFrame) -> DataFrame:
    """Findings by status, and those that are active by severity, in one pass."""
    active = F.col("status").isin(*ACTIVE)
    each = states.select(F.inline(F.array(F.struct(F.lit("status").alias("by"), F.col("status").alias("value")), F.struct(F.lit("severity").alias("by"), F.when(active, F.col("severity")).alias("value")))))
    return each.where("value IS NOT NULL").groupBy("by", "value").agg(F.count("*").alias("n"))


STATE_COUNTS_SQL = f"""WITH {STATES_CTE} SELECT 'status' AS by, status AS value, count(*) AS n FROM states GROUP BY status UNION ALL SELECT 'severity', severity, count(*) FROM states WHERE status IN {ACTIVE} GROUP BY severity"""
SITE_COUNTS_SQL = f"""WITH {STATES_CTE}, i AS (SELECT f.site, count(*) AS issues FROM findings f JOIN states s USING (fingerprint) WHERE s.status IN ('open', 'regressed') GROUP BY f.site)
SELECT site, count(*) AS pages, coalesce(any_value(issues), 0) AS issues FROM crawled LEFT JOIN i USING (site) GROUP BY site"""
