"""Queues as tables: claims, leases, retries, reservations and frontiers as state transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from searchlift.sources.tables import JOBS_SQL, PAGES_SQL


def claim(jobs: DataFrame, n: int = 20) -> DataFrame:
    """The next queued jobs: highest priority, then oldest, then smallest id."""
    return jobs.where("status = 'queued'").orderBy(F.desc("priority"), "created_at", "job_id").limit(n).select("job_id", "site_id", "priority", "created_at")


CLAIM_SQL = f"WITH {JOBS_SQL} SELECT job_id, site_id, priority, created_at FROM jobs WHERE status = 'queued' ORDER BY priority DESC, created_at, job_id LIMIT 20"


def recover(jobs: DataFrame, now: str = "1998-01-01") -> DataFrame:
    """Running jobs whose lease has run out: failed after the last attempt, else waiting again with a doubled delay."""
    gone = (F.col("status") == "running") & (F.col("lease_expires_at") < F.lit(now).cast("timestamp"))
    delay = (30 * F.pow(F.lit(2.0), F.least("attempt_count", F.lit(6)))).cast("int")
    new = F.when(gone & (F.col("attempt_count") >= F.col("max_attempts")), "failed").when(gone, "retry_wait").otherwise(F.col("status"))
    return jobs.select("job_id", new.alias("status"), F.when(new == "retry_wait", delay).alias("delay_seconds"))


RECOVER_SQL = f"""WITH {JOBS_SQL}, n AS (SELECT *, CASE WHEN status = 'running' AND lease_expires_at < TIMESTAMP '1998-01-01' THEN CASE WHEN attempt_count >= max_attempts THEN 'failed' ELSE 'retry_wait' END ELSE status END AS new FROM jobs)
SELECT job_id, new AS status, CASE WHEN new = 'retry_wait' THEN CAST(30 * pow(2.0, least(attempt_count, 6)) AS INT) END AS delay_seconds FROM n"""


def latest_per_site(jobs: DataFrame) -> DataFrame:
    """The newest job of each site."""
    w = Window.partitionBy("site_id").orderBy(F.desc("created_at"), F.desc("job_id"))
    return jobs.withColumn("rank", F.row_number().over(w)).where("rank = 1").select("site_id", "job_id", "status", "created_at")


LATEST_SQL = f"WITH {JOBS_SQL} SELECT site_id, job_id, status, created_at FROM jobs QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY created_at DESC, job_id DESC) = 1"


def reservations(jobs: DataFrame, sites: DataFrame) -> DataFrame:
    """Pages that open jobs hold, per market segment of their site."""
    open_ = jobs.where("status IN ('queued', 'running')")
    return open_.join(sites.select(F.col("c_custkey").alias("site_id"), F.col("c_mktsegment").alias("segment")), "site_id").groupBy("segment").agg(F.count("*").alias("jobs"), F.sum("pages").alias("reserved"))


RESERVATIONS_SQL = f"WITH {JOBS_SQL} SELECT c_mktsegment AS segment, count(*) AS jobs, CAST(sum(pages) AS BIGINT) AS reserved FROM jobs JOIN customer ON site_id = c_custkey WHERE status IN ('queued', 'running') GROUP BY 1"


def retry(jobs: DataFrame) -> DataFrame:
    """Failed and waiting work goes back to the queue; completed rows stay."""
    r = recover(jobs)
    again = F.col("status").isin("failed", "retry_wait")
    return r.select("job_id", F.when(again, "queued").otherwise(F.col("status")).alias("status"), again.alias("retried"))


RETRY_SQL = f"WITH r AS ({RECOVER_SQL}) SELECT job_id, CASE WHEN status IN ('failed', 'retry_wait') THEN 'queued' ELSE status END AS status, status IN ('failed', 'retry_wait') AS retried FROM r"


OPEN, TERMINAL, ATTEMPTS = ("queued", "running", "retry_wait"), ("completed", "failed", "cancelled"), 3


def enqueue(requests: DataFrame, jobs: DataFrame, limits: DataFrame) -> DataFrame:
    """Crawl requests (request_id, workspace, site_id, max_pages) -> what each gets, in order of request_id.

    A site with an open job is given that job. Otherwise its pages are cut to what is left of its
    workspace's limit (workspace, quota, used) after the reservations of open jobs (workspace,
    site_id, job_id, status, pages) and the requests before it; nothing left is quota_exceeded.
    """
    open_ = jobs.where(F.col("status").isin(*OPEN))
    active = open_.groupBy("site_id").agg(F.max_by("job_id", F.struct("created_at", "job_id")).alias("active_job"))
    reserved = open_.groupBy("workspace").agg(F.sum(F.greatest("pages", F.lit(0))).alias("reserved"))
    r = requests.join(active, "site_id", "left").join(limits, "workspace", "left").join(reserved, "workspace", "left")
    left = F.greatest(F.lit(0), F.coalesce("quota", F.lit(0)) - F.coalesce("used", F.lit(0)) - F.coalesce("reserved", F.lit(0)))
    asked = F.when(F.col("active_job").isNull(), F.greatest(F.lit(1), "max_pages")).otherwise(0)
    upto = F.sum("asked").over(Window.partitionBy("workspace").orderBy("request_id").rowsBetween(Window.unboundedPreceding, 0))
    r = r.withColumns({"left": left, "asked": asked}).withColumn("upto", upto)
    granted = F.least("upto", "left") - F.least(F.col("upto") - F.col("asked"), F.col("left"))
    event = F.when(F.col("active_job").isNotNull(), "reused").when(granted >= 1, "queued").otherwise("quota_exceeded")
    return r.select("request_id", "workspace", "site_id", "active_job", granted.cast("long").alias("granted"), event.alias("event"))


ENQUEUE_SQL = f"""WITH {JOBS_SQL}, j AS (SELECT jobs.*, c_nationkey AS workspace FROM jobs JOIN customer ON site_id = c_custkey WHERE status IN {OPEN}), active AS (SELECT site_id, arg_max(job_id, (created_at, job_id)) AS active_job FROM j GROUP BY site_id),
reserved AS (SELECT workspace, sum(greatest(pages, 0)) AS reserved FROM j GROUP BY workspace), q AS (SELECT c_custkey AS request_id, c_nationkey AS workspace, c_custkey AS site_id, CAST(floor(c_acctbal / 50) AS INT) AS max_pages FROM customer),
r AS (SELECT q.*, active_job, greatest(0, 30000 - n_regionkey * 1000 - coalesce(reserved, 0)) AS left_, CASE WHEN active_job IS NULL THEN greatest(1, max_pages) ELSE 0 END AS asked FROM q LEFT JOIN active USING (site_id) LEFT JOIN reserved USING (workspace) JOIN nation ON n_nationkey = workspace),
u AS (SELECT *, sum(asked) OVER (PARTITION BY workspace ORDER BY request_id) AS upto FROM r), g AS (SELECT *, CAST(least(upto, left_) - least(upto - asked, left_) AS BIGINT) AS granted FROM u)
SELECT request_id, workspace, site_id, active_job, granted, CASE WHEN active_job IS NOT NULL THEN 'reused' WHEN granted >= 1 THEN 'queued' ELSE 'quota_exceeded' END AS event FROM g"""


def cancelled(jobs: DataFrame) -> DataFrame:
    """Jobs after a request to cancel them: finished ones stay, waiting ones are cancelled at once, running ones are told."""
    waits = F.col("status").isin("queued", "retry_wait")
    return jobs.select("job_id", F.when(waits, "cancelled").otherwise(F.col("status")).alias("status"), (~F.col("status").isin(*TERMINAL)).alias("cancellation_requested"), F.when(waits, F.lit(None)).otherwise(F.col("lease_expires_at")).alias("lease_expires_at"))


CANCEL_SQL = f"WITH {JOBS_SQL} SELECT job_id, CASE WHEN status IN ('queued', 'retry_wait') THEN 'cancelled' ELSE status END AS status, status NOT IN {TERMINAL} AS cancellation_requested, CASE WHEN status NOT IN ('queued', 'retry_wait') THEN lease_expires_at END AS lease_expires_at FROM jobs"


def resumed(jobs: DataFrame) -> DataFrame:
    """Failed and cancelled jobs after a request to resume them: queued again with new attempts, their history kept; others are refused."""
    may = F.col("status").isin("failed", "cancelled")
    return jobs.select("job_id", F.when(may, "queued").otherwise(F.col("status")).alias("status"), F.when(may, F.greatest("max_attempts", F.col("attempt_count") + ATTEMPTS)).otherwise(F.col("max_attempts")).alias("max_attempts"), (~may).alias("refused"))


RESUME_SQL = f"""WITH r AS ({RECOVER_SQL}), j AS (SELECT r.job_id, r.status, CAST(r.job_id % 5 AS INT) AS attempt_count, 3 AS max_attempts FROM r)
SELECT job_id, CASE WHEN status = 'failed' THEN 'queued' ELSE status END AS status, CASE WHEN status = 'failed' THEN greatest(max_attempts, attempt_count + {ATTEMPTS}) ELSE max_attempts END AS max_attempts, status <> 'failed' AS refused FROM j"""


def executions(actions: DataFrame) -> DataFrame:
    """actions (action_id, version, status, impact, effort, snapshot_id) -> the job that each may have: approved ones are executed, succeeded ones with a snapshot rolled back.

    The key names action and version, so that a job is made once.
    """
    a = actions.withColumn("job_type", F.when(F.col("status") == "approved", "execute").when((F.col("status") == "succeeded") & F.col("snapshot_id").isNotNull(), "rollback")).where("job_type IS NOT NULL")
    text = lambda c: F.col(c).cast("string")
    key = F.when(F.col("job_type") == "execute", F.concat_ws(":", F.lit("execute"), text("action_id"), text("version"))).otherwise(F.concat_ws(":", F.lit("rollback"), text("action_id"), text("version"), text("snapshot_id")))
    priority = F.when(F.col("job_type") == "execute", F.greatest(F.lit(0), F.least(F.lit(100), F.col("impact") - F.col("effort")))).otherwise(100)
    return a.select("action_id", "job_type", key.alias("idempotency_key"), priority.cast("int").alias("priority"), F.when(F.col("job_type") == "execute", "execution_queued").otherwise("rollback_queued").alias("status"), (F.col("version") + 1).alias("version"))


EXECUTIONS_SQL = """WITH a AS (SELECT o_orderkey AS action_id, 1 + o_orderkey % 3 AS version, CASE o_orderstatus WHEN 'O' THEN 'approved' WHEN 'F' THEN 'succeeded' ELSE 'draft' END AS status, o_orderkey % 101 AS impact, o_orderkey % 47 AS effort, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey * 10 END AS snapshot_id FROM orders)
SELECT action_id, CASE status WHEN 'approved' THEN 'execute' ELSE 'rollback' END AS job_type, CASE status WHEN 'approved' THEN concat('execute:', action_id, ':', version) ELSE concat('rollback:', action_id, ':', version, ':', snapshot_id) END AS idempotency_key,
 CAST(CASE status WHEN 'approved' THEN greatest(0, least(100, impact - effort)) ELSE 100 END AS INT) AS priority, CASE status WHEN 'approved' THEN 'execution_queued' ELSE 'rollback_queued' END AS status, version + 1 AS version FROM a WHERE status = 'approved' OR (status = 'succeeded' AND snapshot_id IS NOT NULL)"""


def waiting_runs(runs: DataFrame, jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """Agent runs (run_id, site_id, crawl_job_id, status) after their crawls: failed if the crawl is another site's, did not complete or left no page; running if it did; else waiting on."""
    j = jobs.select(F.col("job_id").alias("crawl_job_id"), F.col("site_id").alias("job_site"), F.col("status").alias("job_status"))
    n = pages.groupBy("site_id").agg(F.count("*").alias("pages"))
    r = runs.where("status = 'crawling'").join(j, "crawl_job_id", "left").join(n, "site_id", "left")
    done = F.col("job_status").isin(*TERMINAL)
    status = F.when(~F.coalesce(done, F.lit(False)), "crawling").when((F.col("job_site") != F.col("site_id")) | (F.col("job_status") != "completed") | (F.coalesce("pages", F.lit(0)) < 1), "failed").otherwise("running")
    reason = F.when(status != "failed", F.lit(None)).when(F.col("job_site") != F.col("site_id"), "other_site").when(F.col("job_status") != "completed", "crawl_failed").otherwise("no_pages")
    return r.select("run_id", "site_id", status.alias("status"), reason.alias("reason"))


WAITING_SQL = f"""WITH {JOBS_SQL}, runs AS (SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 6 = 0 THEN o_custkey + 1 ELSE o_custkey END AS site_id, o_orderkey AS crawl_job_id FROM orders WHERE o_orderkey % 2 = 0),
n AS (SELECT l_suppkey AS site_id, count(*) AS pages FROM lineitem GROUP BY 1), r AS (SELECT run_id, runs.site_id, j.site_id AS job_site, j.status AS job_status, coalesce(n.pages, 0) AS pages FROM runs LEFT JOIN jobs j ON crawl_job_id = job_id LEFT JOIN n ON n.site_id = runs.site_id)
SELECT run_id, site_id, CASE WHEN coalesce(job_status, '') NOT IN {TERMINAL} THEN 'crawling' WHEN job_site <> site_id OR job_status <> 'completed' OR pages < 1 THEN 'failed' ELSE 'running' END AS status,
 CASE WHEN coalesce(job_status, '') NOT IN {TERMINAL} THEN NULL WHEN job_site <> site_id THEN 'other_site' WHEN job_status <> 'completed' THEN 'crawl_failed' WHEN pages < 1 THEN 'no_pages' END AS reason FROM r"""


def frontier_pop(frontier: DataFrame, n: int = 50) -> DataFrame:
    """The oldest queued URLs of a frontier, as they are once they are being fetched."""
    first = frontier.where("status = 'queued'").orderBy("created_at", "url_hash").limit(n)
    return first.select("url_hash", "url", F.lit("fetching").alias("status"), (F.col("attempt_count") + 1).alias("attempt_count"))


FRONTIER_POP_SQL = "SELECT sha256(url) AS url_hash, url, 'fetching' AS status, CAST(page_id % 3 + 1 AS INT) AS attempt_count FROM pages WHERE page_id % 4 <> 1 ORDER BY page_id // 10, sha256(url) LIMIT 50"


def frontier_add(found: DataFrame, known: DataFrame, room: int) -> DataFrame:
    """New URLs for the frontier: distinct, not known, and at most as many as there is room for, in order of their hashes.

    Two URLs of one hash, among those found or against those known (where these name their url), are an error.
    """
    clash = lambda a, b: F.when(a != b, F.raise_error(F.lit("two URLs have one hash")).cast("string")).otherwise(a)
    new = found.select(F.sha2("url", 256).alias("url_hash"), "url").groupBy("url_hash").agg(F.min("url").alias("url"), F.max("url").alias("other")).select("url_hash", clash(F.col("url"), F.col("other")).alias("url"))
    if "url" in known.columns:
        before = known.groupBy("url_hash").agg(F.min("url").alias("known"))
        # The check comes first: it must not be skipped for the rows that it refuses.
        checked = new.join(before, "url_hash", "left").select("url_hash", F.when(F.col("known").isNull(), F.col("url")).when(F.col("known") != F.col("url"), F.raise_error(F.lit("two URLs have one hash")).cast("string")).alias("url"))
        new = checked.where("url IS NOT NULL")
    else:
        new = new.join(known.select("url_hash"), "url_hash", "left_anti")
    return new.orderBy("url_hash").limit(room)


FRONTIER_SQL = f"""WITH {PAGES_SQL}, f AS (SELECT DISTINCT concat('https://', site, link) AS url FROM (SELECT site, unnest(links) AS link FROM crawled) WHERE link LIKE '/%')
SELECT sha256(url) AS url_hash, url FROM f WHERE sha256(url) NOT IN (SELECT sha256(url) FROM crawled) ORDER BY url_hash LIMIT 200"""


def folded(events: DataFrame) -> DataFrame:
    """The state of each user after its event log: last type, by time and then id, and how many events led there."""
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("changed_at"), F.count("*").alias("events"))


FOLD_SQL = "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS changed_at, count(*) AS events FROM events GROUP BY user_id"
