"""All queries of the engine by name, and the SQL that states each."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchlift.functions import html, urls
from searchlift.operators import actions, captures, citations, content, drafts, facts, finding_actions, findings, governance, inspection, loading, measurement, pacing, policy, queueing, reconcile, reports, targets
from searchlift.plans import inputs, site_run
from searchlift.sources import samples, tables
from searchlift.sources.staging import shared_dir, staged
from searchlift.sources.tables import load
from searchlift.sources.versions import VersionedTable
from searchlift.streaming import events as streams
from searchlift.streaming import late, leases


def _facts(s, d):
    return tables.search_facts(s, d)


def _pages(s, d):
    return tables.crawled_pages(s, d)


def _edges(s, d):
    return tables.link_edges(_pages(s, d))


def _linked(s, d):
    p = _pages(s, d)
    return findings.with_in_links(p, tables.link_edges(p))


def _found(s, d):
    return findings.page_findings(_linked(s, d))


def _texts(s, d):
    return content.page_texts(_pages(s, d))


def _recommended(s, d):
    p = _pages(s, d)
    return content.recommendations(content.page_texts(p), tables.link_edges(p))


def _whole_recommended(s, d):
    """Documents as the pages of their source, none of which links to another."""
    texts = _whole(s, d).withColumn("path", F.concat(F.lit("/"), F.col("page_id").cast("string")))
    return content.recommendations(texts, s.createDataFrame([], "site string, src string, dst string"))


def _graph(texts):
    found = staged(content.topics(texts), "topics")
    return content.graph_edges(texts, found, content.first_similar(content.texts_with_room(texts, found), content.RELATED_UNTIL))


def _whole(s, d):
    return content.whole_texts(load(s, d, "documents"))


def _answers(s, d):
    return citations.analysed(citations.with_prompts(samples.answers(load(s, d, "conversations"))))


def _results(s, d):
    return citations.results(_answers(s, d))


def _inspected(s, d):
    """The latest event of each URL is picked before its sample payload of some hundred URLs is made."""
    return inspection.flattened(samples.payloads(inspection.latest(samples.inspected_urls(load(s, d, "events"))))).drop("event_id")


def _measuring(s, d):
    return samples.measured_actions(load(s, d, "supplier")), _facts(s, d), samples.synced_ranges(s)


def _measured(s, d):
    return measurement.measurements(*_measuring(s, d))


def _adjustment(s, d):
    return measurement.history_adjustment(measurement.longest_window(_measured(s, d)))


def _actions(s, d):
    return inputs.proposed_actions(load(s, d, "orders"))


def _states(s, d):
    return inputs.finding_states(_found(s, d))


def _health(s, d):
    p = _pages(s, d)
    states = inputs.finding_states(findings.page_findings(findings.with_in_links(p, tables.link_edges(p))))
    sites = p.select("site").distinct().unionByName(s.createDataFrame([("empty.example.org",)], "site string"))
    return finding_actions.health(sites, states, p, findings.HEALTH_WEIGHTS)


def _briefs(s, d):
    p = _pages(s, d)
    texts = content.page_texts(p)
    return drafts.briefs(p, content.topics(texts), content.recommendations(texts, tables.link_edges(p)))


def _shown_briefs(b):
    joined = lambda c: F.array_join(c, "|").alias(c)
    return b.select("page_id", "site", "title", "query", joined("topics"), joined("outline"), joined("questions"), F.array_join("targets.path", "|").alias("targets"))


def _drafts(s, d):
    """Drafts of the pages; documents of odd number stand for what editors wrote, and every third page has evidence."""
    written = load(s, d, "documents").where("doc_id % 2 = 1").select(F.col("doc_id").alias("page_id"), F.col("text").alias("body"))
    return drafts.drafts(_briefs(s, d), written).withColumn("has_evidence", F.col("page_id") % 3 == 0)


def url_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return load(spark, sf_dir, "pages").select("page_id", urls.host_key(u).alias("host"), urls.path_of(u).alias("path"), urls.path_key(u).alias("path_key"), urls.page_url_key(u).alias("url_key"), urls.citation_url(u).alias("citation_url"))


URL_KEYS_SQL = r"""WITH p AS (SELECT page_id, url, regexp_replace(regexp_extract(lower(url), '^https?://([^/?#:]+)', 1), '^www\.', '') AS host, coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), ''), '/') AS path, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages)
SELECT page_id, host, path, concat(path, CASE WHEN q <> '' THEN concat('?', q) ELSE '' END) AS path_key,
 concat(host, CASE WHEN regexp_replace(path, '/+$', '') = '' THEN '/' ELSE regexp_replace(path, '/+$', '') END, CASE WHEN q <> '' THEN concat('?', q) ELSE '' END) AS url_key,
 concat(lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)), regexp_extract(url, '^https?://[^/?#]+([^#]*)', 1)) AS citation_url FROM p"""


def html_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", html.extract(F.col("html")).alias("p")).select("page_id", "p.title", F.size("p.h1").alias("h1_count"), "p.description", "p.canonical", "p.lang", F.size("p.links").alias("links"), "p.images", "p.json_ld_count", "p.word_count")


HTML_FIELDS_SQL = f"""WITH {tables.PAGES_SQL} SELECT page_id, nullif(title, '') AS title, h1_count, nullif(description, '') AS description, nullif(canonical, '') AS canonical, nullif(lang, '') AS lang, CAST(len(links) AS INT) AS links, CAST(len(regexp_extract_all(html, '<img ')) AS INT) AS images, json_ld_count, word_count FROM crawled JOIN pages USING (page_id, url)"""


def normal_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir).select("page_id", "url", "site", "links")
    return p.select("page_id", F.explode(urls.normalise_links("links", "url", "site")).alias("link")).where("link IS NOT NULL").distinct()


NORMAL_LINKS_SQL = f"""WITH {tables.PAGES_SQL} SELECT DISTINCT page_id, concat(lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)), link) AS link FROM (SELECT page_id, url, unnest(links) AS link FROM crawled) WHERE link LIKE '/%'"""


def _stream(s, d):
    return streams.read(s, f"{d}/events.parquet")


def stream_pacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.paced(inputs.paced_answers(_stream(spark, sf_dir)), f"{shared_dir(spark)}/pacing-{uuid.uuid4().hex}")


def frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir)
    found = p.select("site", F.explode("links").alias("link")).where(F.startswith("link", F.lit("/"))).select(F.concat(F.lit("https://"), "site", "link").alias("url"))
    return queueing.frontier_add(found, p.select(F.sha2("url", 256).alias("url_hash"), "url"), 200)


def three_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the pages over three runs: all, those of even pages, all again."""
    found = _found(spark, sf_dir).select(F.col("fingerprint").alias("key"), F.col("finding_type").alias("kind"), "page_id")
    some = found.where("page_id % 2 = 0")
    return reconcile.runs([found, some, found], reconcile.FINDINGS, ["2024-01-01", "2024-01-02", "2024-01-03"])


THREE_RUNS_SQL = f"""WITH {findings.FINDINGS_CTE}
SELECT fingerprint AS key, min(finding_type) AS kind, CASE WHEN min(page_id % 2) = 0 THEN 'open' ELSE 'regressed' END AS status, TIMESTAMP '2024-01-01' AS first_seen, TIMESTAMP '2024-01-03' AS last_seen, CAST(NULL AS TIMESTAMP) AS resolved_at,
 CASE WHEN min(page_id % 2) = 0 THEN 3 ELSE 2 END AS occurrences, CASE WHEN min(page_id % 2) = 0 THEN 0 ELSE 1 END AS regressions FROM findings GROUP BY fingerprint"""


def opportunity_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opportunities over two runs: all, then those of priority 70 and more."""
    o = facts.opportunities(_facts(spark, sf_dir)).select(F.col("opportunity_key").alias("key"), F.col("opportunity_type").alias("kind"), "priority")
    return reconcile.runs([o, o.where("priority >= 70")], reconcile.OPPORTUNITIES, ["2024-02-26", "2024-02-27"])


OPPORTUNITY_RUNS_SQL = f"""WITH {facts.OPPORTUNITY_CTE}
SELECT opportunity_key AS key, opportunity_type AS kind, CASE WHEN priority >= 70 THEN 'active' ELSE 'resolved' END AS status, TIMESTAMP '2024-02-26' AS first_seen, CASE WHEN priority >= 70 THEN TIMESTAMP '2024-02-27' ELSE TIMESTAMP '2024-02-26' END AS last_seen,
 CASE WHEN priority < 70 THEN TIMESTAMP '2024-02-27' END AS resolved_at, 0 AS occurrences, 0 AS regressions FROM opps"""


OPPORTUNITIES_ADJUSTED_SQL = f"""WITH {measurement.ADJUSTMENT_CTE}, {facts.OPPORTUNITY_CTE.split(', win AS (', 1)[1].join(['win AS (', ''])} SELECT o.* REPLACE (CAST(greatest(0, least(100, priority + adjustment)) AS INT) AS priority) FROM opps o CROSS JOIN adjustment"""


def gap_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation gaps over two runs: all, then those of priority 76 and more."""
    g = citations.gaps(_results(spark, sf_dir)).select(F.col("gap_key").alias("key"), F.col("gap").alias("kind"), "priority")
    return reconcile.runs([g, g.where("priority >= 76")], reconcile.GAPS, ["2024-02-26", "2024-02-27"])


def _runs_sql(with_: str, key: str, kind: str, table: str, stays: str) -> str:
    return f"""WITH {with_} SELECT {key} AS key, {kind} AS kind, CASE WHEN {stays} THEN 'active' ELSE 'resolved' END AS status, TIMESTAMP '2024-02-26' AS first_seen, CASE WHEN {stays} THEN TIMESTAMP '2024-02-27' ELSE TIMESTAMP '2024-02-26' END AS last_seen,
 CASE WHEN NOT ({stays}) THEN TIMESTAMP '2024-02-27' END AS resolved_at, 0 AS occurrences, 0 AS regressions FROM {table}"""


GAP_RUNS_SQL = _runs_sql(citations.GAPS_CTE, "gap_key", "gap", "gaps", "priority >= 76")


def inspection_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inspection opportunities over two runs: all, then those of priority 82 and more."""
    o = inspection.opportunities(_inspected(spark, sf_dir)).select(F.sha2(F.concat_ws("|", "opportunity_type", "inspection_url"), 256).alias("key"), F.col("opportunity_type").alias("kind"), "priority")
    return reconcile.runs([o, o.where("priority >= 82")], reconcile.INSPECTIONS, ["2024-02-26", "2024-02-27"])


INSPECTION_RUNS_SQL = _runs_sql(f"o AS ({inspection.INSPECTION_OPPS_SQL})", "sha256(concat(opportunity_type, '|', inspection_url))", "opportunity_type", "o", "priority >= 82")


def content_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refreshes of decaying pages, the fifty best search opportunities that are content work, and the 25 best citation gaps; of all these the best hundred."""
    best = lambda df, n: df.orderBy(F.desc("priority"), "candidate_key").limit(n)
    part = lambda df, key, source, effort: df.select(key.alias("candidate_key"), source.alias("source"), "priority", "confidence", F.lit(effort).alias("effort"))
    d = content.decay(samples.with_ages(facts.period_change(_facts(spark, sf_dir)))).where("decay >= 25").withColumns({"priority": F.least(F.lit(100), F.col("decay") + 20).cast("int"), "confidence": F.least(F.lit(100), 60 + F.floor(F.col("decay") / 3)).cast("int")})
    refresh = part(d, F.concat(F.lit("refresh:"), "page_url"), F.lit("refresh_existing_page"), 45)
    o = facts.opportunities(_facts(spark, sf_dir)).withColumn("candidate_key", F.concat(F.lit("search:"), "opportunity_key"))
    target = targets.target_of(F.col("opportunity_type"), targets.site_path(F.col("page_url"), F.lit(samples.SITE)))
    search = part(best(o, 50).withColumn("target", target).where(~F.col("target").isin("technical_fix", "excluded")), F.col("candidate_key"), F.col("target"), 55)
    g = citations.gaps(_results(spark, sf_dir)).withColumn("candidate_key", F.concat(F.lit("citation:"), "gap_key"))
    authority = part(best(g, 25), F.col("candidate_key"), F.lit("authority"), 60)
    every = refresh.unionByName(search).unionByName(authority)
    return every.orderBy(F.desc("priority"), F.desc("confidence"), "candidate_key").limit(100)


CONTENT_CANDIDATES_SQL = f"""WITH d AS ({content.decay_sql()}), o AS ({facts.OPPORTUNITIES_SQL}), g AS ({citations.GAPS_SQL}), c AS (
 SELECT concat('refresh:', page_url) AS candidate_key, 'refresh_existing_page' AS source, CAST(least(100, decay + 20) AS INT) AS priority, CAST(least(100, 60 + floor(decay / 3)) AS INT) AS confidence, 45 AS effort FROM d WHERE decay >= 25
 UNION ALL (SELECT concat('search:', opportunity_key), CASE WHEN page_url IS NULL THEN 'new_page' ELSE 'refresh_existing_page' END, priority, confidence, 55 FROM o ORDER BY priority DESC, opportunity_key LIMIT 50)
 UNION ALL (SELECT concat('citation:', gap_key), 'authority', priority, confidence, 60 FROM g ORDER BY priority DESC, gap_key LIMIT 25))
SELECT * FROM c ORDER BY priority DESC, confidence DESC, candidate_key LIMIT 100"""


def search_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = targets.mixed_opportunities(facts.opportunities(_facts(spark, sf_dir)), inspection.opportunities(_inspected(spark, sf_dir)))
    return targets.search_targets(found, _pages(spark, sf_dir), "shop.example.com")


def inspection_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    searched = _facts(spark, sf_dir).groupBy("page_url").agg(F.sum("impressions").alias("impressions"))
    return targets.inspection_urls(searched, _pages(spark, sf_dir).select("url", "status_code"))


def latest_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as findings, their orders as the actions on them."""
    jobs = tables.jobs(spark, sf_dir).select(F.col("site_id").alias("finding_id"), F.col("job_id").alias("action_id"), "status", "created_at")
    return targets.latest_actions(load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("finding_id")), jobs)


def action_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earlier queue after opportunities of priority 60 and more stay active."""
    o = facts.opportunities(_facts(spark, sf_dir))
    return actions.follow(inputs.earlier_queue(o), o.where("priority >= 60").select(F.col("opportunity_key").alias("key"), "priority", "confidence"))


def job_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request for each customer's site; nations are the workspaces."""
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("site_id"), F.col("c_nationkey").alias("workspace"), "c_acctbal")
    requests = c.select(F.col("site_id").alias("request_id"), "workspace", "site_id", F.floor(F.col("c_acctbal") / 50).cast("int").alias("max_pages"))
    limits = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("workspace"), F.lit(30000).alias("quota"), (F.col("n_regionkey") * 1000).alias("used"))
    return queueing.enqueue(requests, tables.jobs(spark, sf_dir).join(c.select("site_id", "workspace"), "site_id"), limits)


def job_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs whose lost leases were recovered, then resumed."""
    jobs = tables.jobs(spark, sf_dir)
    return queueing.resumed(jobs.drop("status").join(queueing.recover(jobs).select("job_id", "status"), "job_id"))


def execution_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "O", "approved").when(F.col("o_orderstatus") == "F", "succeeded").otherwise("draft")
    return queueing.executions(load(spark, sf_dir, "orders").select(k.alias("action_id"), (1 + k % 3).alias("version"), status.alias("status"), (k % 101).alias("impact"), (k % 47).alias("effort"), F.when(k % 4 > 0, k * 10).alias("snapshot_id")))


def agent_runs_waiting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of even number as agent runs that wait for the job of the same number; suppliers' lines stand for a site's pages."""
    k = F.col("o_orderkey")
    runs = load(spark, sf_dir, "orders").where(k % 2 == 0).select(k.alias("run_id"), F.when(k % 6 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("site_id"), k.alias("crawl_job_id"), F.lit("crawling").alias("status"))
    return queueing.waiting_runs(runs, tables.jobs(spark, sf_dir), load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("site_id")))


def frontier_pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    known = load(spark, sf_dir, "pages").select(F.sha2("url", 256).alias("url_hash"), "url", F.when(i % 4 == 1, "completed").otherwise("queued").alias("status"), F.floor(i / 10).alias("created_at"), (i % 3).cast("int").alias("attempt_count"))
    return queueing.frontier_pop(known)


def fact_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a day after the recent window of an older table was loaded anew."""
    old = spark.range(60).select(F.date_add(F.lit("2023-12-31").cast("date"), F.col("id").cast("int")).alias("metric_date"), F.lit(1.0).alias("clicks"), F.lit(2.0).alias("impressions"))
    new = loading.parsed(samples.raw_facts(_facts(spark, sf_dir))).select("metric_date", "clicks", "impressions")
    return loading.day_totals(loading.loaded(old, new, tables.RECENT_FROM, tables.PERIOD_END))


def fact_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same load as a commit to a table of versions; no cap, as the stored lines are no provider's answer that may be cut off."""
    table = VersionedTable(spark, f"{shared_dir(spark)}/facts-{uuid.uuid4().hex}")
    old = spark.range(60).select(F.date_add(F.lit("2023-12-31").cast("date"), F.col("id").cast("int")).alias("metric_date"), F.lit(1.0).alias("clicks"), F.lit(2.0).alias("impressions"))
    table.commit(old)
    loading.load_days(loading.parsed(samples.raw_facts(_facts(spark, sf_dir))).select("metric_date", "clicks", "impressions"), table, tables.RECENT_FROM, tables.PERIOD_END, cap=None)
    return loading.day_totals(table.read())


def stream_late_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three loads that arrive as files, the newest of a day's before an older one, followed into a table of versions."""
    root = f"{shared_dir(spark)}/late-{uuid.uuid4().hex}"
    for load_ in inputs.arrivals(_facts(spark, sf_dir)):
        load_.write.mode("append").parquet(f"{root}/arrivals")
    table = VersionedTable(spark, f"{root}/facts")
    arrivals = spark.readStream.schema(load_.schema).option("maxFilesPerTrigger", 4).parquet(f"{root}/arrivals")
    late.follow(arrivals, table, f"{root}/checkpoint")
    return table.read()


def page_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl of the pages of even number over a table of those whose number three divides."""
    p = _pages(spark, sf_dir).select("site", "path", F.col("page_id").alias("place"), "word_count")
    first = loading.imported(p)
    old = first.where("place % 3 = 0").select("site", "path", F.lit(0).alias("word_count"), F.lit("2023-01-01").cast("date").alias("created_on"))
    new = first.where("place % 2 = 0").select("site", "path", "word_count", F.lit("2024-01-01").cast("date").alias("created_on"))
    return loading.upserted(old, new)


PAGE_UPSERT_SQL = f"""WITH {tables.PAGES_SQL}, f AS (SELECT site, path, page_id AS place, word_count FROM crawled QUALIFY row_number() OVER (PARTITION BY site, path ORDER BY page_id) = 1)
SELECT site, path, CASE WHEN place % 2 = 0 THEN word_count ELSE 0 END AS word_count, CASE WHEN place % 3 = 0 THEN DATE '2023-01-01' ELSE DATE '2024-01-01' END AS created_on, CASE WHEN place % 2 <> 0 THEN 'kept' WHEN place % 3 = 0 THEN 'updated' ELSE 'created' END AS event FROM f WHERE place % 2 = 0 OR place % 3 = 0"""


def inspection_url_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' URLs in several spellings, as URLs to inspect of their site."""
    i, site = F.col("page_id"), F.regexp_extract(F.lower("url"), r"^https?://([^/?#:]+)", 1)
    bare = F.regexp_extract("url", "^([^#]*)", 1)
    value = F.when(i % 7 == 0, F.lit("  ")).when(i % 7 == 1, F.concat(F.lit("ftp://"), site, F.lit("/x"))).when(i % 7 == 2, F.concat(F.lit("https://me:pw@"), site, F.lit("/x"))).when(i % 7 == 3, F.lit("https://elsewhere.invalid/x")).when(i % 7 == 4, F.concat(F.lit("/p?id="), i.cast("string"), F.lit("#top"))).when(i % 7 == 5, F.concat(F.lit("HTTPS://WWW."), F.upper(site), F.lit("?q=1"))).otherwise(bare)
    return load(spark, sf_dir, "pages").select("page_id", urls.inspection_url(site, value).alias("u")).select("page_id", "u.url", "u.error")


INSPECTION_URL_SQL = r"""WITH p AS (SELECT page_id, regexp_extract(lower(url), '^https?://([^/?#:]+)', 1) AS site, regexp_extract(url, '^([^#]*)', 1) AS bare FROM pages)
SELECT page_id, CASE page_id % 7 WHEN 4 THEN concat('https://', site, '/p?id=', page_id) WHEN 5 THEN CASE WHEN site NOT LIKE 'www.%' THEN concat('https://www.', site, '/?q=1') END WHEN 6 THEN concat(lower(regexp_extract(bare, '^(https?://[^/?]+)', 1)), regexp_extract(bare, '^https?://[^/?]+(.*)$', 1)) END AS url,
 CASE page_id % 7 WHEN 0 THEN 'empty' WHEN 1 THEN 'not_http' WHEN 2 THEN 'credentials' WHEN 3 THEN 'other_site' WHEN 5 THEN CASE WHEN site LIKE 'www.%' THEN 'other_site' END END AS error FROM p"""


def actions_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("action_id")
    checked = F.when(k % 3 > 0, F.date_add(F.lit("2024-02-20").cast("date"), (k % 7).cast("int")))
    acts, facts_, ranges = _measuring(spark, sf_dir)
    return governance.due(measurement.measurements(acts, facts_, ranges), acts.select("action_id", checked.alias("last_checked")))


def action_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, orders = F.col("o_orderkey"), load(spark, sf_dir, "orders")
    acts = orders.select(k.alias("action_id"), F.when(k % 3 == 0, '{"status":"done"}').otherwise("{}").alias("payload"))
    return governance.backfilled(acts, orders.where(k % 5 > 0).select(k.alias("action_id"), F.lower("o_orderstatus").alias("job_status"), (k % 4).alias("attempts")))


def site_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir)
    found = findings.page_findings(findings.with_in_links(p, tables.link_edges(p)))
    return reports.site_counts(p, inputs.finding_states(found).select("fingerprint", "status").join(found.select("fingerprint", "site"), "fingerprint"))


def action_state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The actions after their histories, with the risk that the policy sees in them."""
    after = governance.histories(*inputs.action_log(load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")))
    return policy.state_counts(policy.decided(_actions(spark, sf_dir)).select("action_id", "risk_level").join(after.select("action_id", "status"), "action_id"))


ACTION_STATE_COUNTS_SQL = f"WITH h AS ({governance.histories_sql()}), d AS ({policy.DECIDED_SQL}) SELECT status, risk_level, count(*) AS n FROM h JOIN d USING (action_id) GROUP BY GROUPING SETS ((status), (risk_level))"
#: The month of the sample snapshot; counters begin with ten uses of each metric for the even workspaces.
USAGE_MONTH = "1998-03-01"


def usage_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = governance.entitlements(inputs.subscriptions(load(spark, sf_dir, "customer").where("c_custkey < 50")))
    begun = plans.where("workspace % 2 = 0").select("workspace", F.explode(F.array(*[F.lit(m) for m in policy.METERED])).alias("metric"), F.lit(USAGE_MONTH).cast("date").alias("period"), F.lit(10).cast("bigint").alias("quantity"))
    return policy.usage_snapshot(policy.recorded(begun, samples.usage_events(load(spark, sf_dir, "lineitem"))), plans, USAGE_MONTH)


USAGE_SNAPSHOT_SQL = f"""WITH {samples.USAGE_CTE}, p AS (SELECT * FROM ({governance.ENTITLEMENTS_SQL}) WHERE workspace < 50), m AS ({" UNION ALL ".join(f"SELECT workspace, '{m}' AS metric, CAST({m} AS BIGINT) AS quota FROM p" for m in policy.METERED)}),
u AS (SELECT workspace, metric, sum(quantity) AS n FROM uses WHERE quantity >= 1 AND period = DATE '{USAGE_MONTH}' GROUP BY ALL)
SELECT workspace, metric, CAST(coalesce(n, 0) + CASE WHEN workspace % 2 = 0 THEN 10 ELSE 0 END AS BIGINT) AS used, quota FROM m LEFT JOIN u USING (workspace, metric)"""
CONTENT_METRICS_SQL = facts.WEIGHTED_SQL.replace("query", "page_url").replace("p_brand AS page_url", "p_brand AS query").replace(", 6)", ", 4)").replace(", 3)", ", 2)")


def content_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decay of the suppliers' pages and gain of the crawled pages of the same number."""
    p = _pages(spark, sf_dir)
    texts = content.page_texts(p)
    d = content.decay(samples.with_ages(facts.period_change(_facts(spark, sf_dir)))).select(F.regexp_extract("page_url", "([0-9]+)$", 1).cast("long").alias("page_id"), "decay")
    return governance.content_actions(d.join(content.information_gain(texts, tables.page_queries(spark, sf_dir)), "page_id"), content.recommendations(texts, tables.link_edges(p)))


def sandbox_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.concat(F.lit("check_"), F.col("l_linenumber").cast("string"), F.lit("_"), F.col("l_partkey").cast("string")).alias("name"), (F.col("l_quantity") >= 10).alias("passed"))
    return governance.sandbox(checks)


def link_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link recommendations over two runs: all, then those of priority 80 and more."""
    r = _recommended(spark, sf_dir).select(F.sha2(F.concat_ws("|", F.col("source_id").cast("string"), F.col("target_id").cast("string")), 256).alias("key"), F.lit("link").alias("kind"), "priority")
    return reconcile.runs([r, r.where("priority >= 80")], reconcile.LINKS, ["2024-02-26", "2024-02-27"])


LINK_RUNS_SQL = _runs_sql(f"r AS ({content.RECOMMEND_SQL})", "sha256(concat(source_id, '|', target_id))", "'link'", "r", "priority >= 80")


def content_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content opportunities over two runs; what the second has not seen stays as it was."""
    c = content_candidates(spark, sf_dir).select(F.col("candidate_key").alias("key"), F.col("source").alias("kind"), "priority")
    return reconcile.runs([c, c.where("priority >= 80")], reconcile.CONTENT, ["2024-02-26", "2024-02-27"])


CONTENT_RUNS_SQL = f"""WITH c AS ({CONTENT_CANDIDATES_SQL}) SELECT candidate_key AS key, source AS kind, 'open' AS status, TIMESTAMP '2024-02-26' AS first_seen, CASE WHEN priority >= 80 THEN TIMESTAMP '2024-02-27' ELSE TIMESTAMP '2024-02-26' END AS last_seen, CAST(NULL AS TIMESTAMP) AS resolved_at, 0 AS occurrences, 0 AS regressions FROM c"""


#: name -> (query, the SQL that states it or None).
QUERIES = {
    "opportunities_all": (lambda s, d: facts.opportunities(_facts(s, d)), facts.OPPORTUNITIES_SQL),
    "opportunities_actionable": (lambda s, d: facts.actionable(facts.opportunities(_facts(s, d))), facts.ACTIONABLE_SQL),
    "opportunity_runs": (opportunity_runs, OPPORTUNITY_RUNS_SQL),
    "weighted_metrics": (lambda s, d: facts.weighted_metrics(_facts(s, d), "query"), facts.WEIGHTED_SQL),
    "content_metrics": (lambda s, d: facts.weighted_metrics(_facts(s, d), "page_url", places=(4, 2)), CONTENT_METRICS_SQL),
    "metric_window": (lambda s, d: facts.metric_window(_facts(s, d), tables.RECENT_FROM, tables.PERIOD_END), facts.METRIC_WINDOW_SQL),
    "period_change": (lambda s, d: facts.period_change(_facts(s, d)), facts.CHANGE_SQL),
    "cannibal_pages": (lambda s, d: facts.cannibal_pages(_facts(s, d)), facts.CANNIBAL_SQL),
    "top_pages": (lambda s, d: facts.top_pages(_facts(s, d)), facts.TOP_PAGES_SQL),
    "query_owners": (lambda s, d: facts.query_owners(_facts(s, d)), facts.OWNERS_SQL),
    "covered_ranges": (lambda s, d: facts.covered_ranges(_facts(s, d).withColumnRenamed("metric_date", "day"), "page_url"), facts.COVERED_SQL),
    "measurement_baselines": (lambda s, d: measurement.baselines(*_measuring(s, d)).select(*measurement.BASELINE_COLUMNS), measurement.BASELINES_SQL),
    "measurement_refreeze": (lambda s, d: measurement.refreeze(*_measuring(s, d)).select(*measurement.BASELINE_COLUMNS), measurement.REFREEZE_SQL),
    "measurement_marks": (lambda s, d: measurement.mark_applied(measurement.baselines(*_measuring(s, d)).drop("mutation_applied"), _measuring(s, d)[0]), measurement.MARKS_SQL),
    "action_outcomes": (_measured, measurement.OUTCOMES_SQL),
    "outcome_longest_window": (lambda s, d: measurement.longest_window(_measured(s, d)), measurement.LONGEST_SQL),
    "outcome_adjustment": (_adjustment, measurement.ADJUSTMENT_SQL),
    "opportunities_adjusted": (lambda s, d: measurement.adjusted(facts.opportunities(_facts(s, d)), _adjustment(s, d)), OPPORTUNITIES_ADJUSTED_SQL),
    "page_findings": (_found, findings.PAGE_FINDINGS_SQL),
    "legacy_checks": (lambda s, d: findings.rule_hits(_linked(s, d), findings.LEGACY_RULES), findings.rule_hits_sql(findings.LEGACY_RULES)),
    "export_checks": (lambda s, d: findings.rule_hits(_linked(s, d), findings.EXPORT_RULES), findings.rule_hits_sql(findings.EXPORT_RULES)),
    "export_duplicates": (lambda s, d: findings.export_duplicates(_pages(s, d)), findings.EXPORT_DUPLICATES_SQL),
    "legacy_duplicates": (lambda s, d: findings.legacy_duplicates(_pages(s, d)), findings.LEGACY_DUPLICATES_SQL),
    "legacy_summary": (lambda s, d: findings.legacy_summary(_linked(s, d)), findings.legacy_summary_sql()),
    "audit_scores": (lambda s, d: findings.audit_scores(_linked(s, d)), findings.AUDIT_SQL),
    "duplicate_descriptions": (lambda s, d: findings.duplicates(_pages(s, d), "description", "duplicate_meta_description"), findings.duplicates_sql("description", "duplicate_meta_description")),
    "shared_descriptions": (lambda s, d: findings.duplicates(samples.described_pages(samples.one_site(_pages(s, d))), "description", "duplicate_meta_description"), findings.duplicates_sql("description", "duplicate_meta_description", f"(SELECT * REPLACE (concat('site', page_id % 3) AS site, {samples.DESCRIBED_SQL} AS description) FROM crawled)")),
    "duplicate_titles": (lambda s, d: findings.duplicates(_pages(s, d), "title", "duplicate_title"), findings.duplicates_sql("title", "duplicate_title")),
    "site_health": (lambda s, d: findings.health(_pages(s, d), _found(s, d)), findings.HEALTH_SQL),
    "finding_counts": (lambda s, d: findings.counts(_found(s, d)), findings.COUNTS_SQL),
    "findings_queue": (lambda s, d: finding_actions.queue(_states(s, d)), finding_actions.QUEUE_SQL),
    "findings_planning_order": (lambda s, d: finding_actions.planning_order(_states(s, d)), finding_actions.PLANNING_SQL),
    "finding_actions": (lambda s, d: finding_actions.actions(_states(s, d)), finding_actions.ACTIONS_SQL),
    "finding_steps": (lambda s, d: finding_actions.step(_states(s, d)), finding_actions.STEP_SQL),
    "finding_step_counts": (lambda s, d: finding_actions.step_counts(finding_actions.step(_states(s, d))), finding_actions.STEP_COUNTS_SQL),
    "fix_metrics": (lambda s, d: finding_actions.fix_metrics(_states(s, d)), finding_actions.FIX_METRICS_SQL),
    "finding_state_counts": (lambda s, d: finding_actions.state_counts(_states(s, d)), finding_actions.STATE_COUNTS_SQL),
    "site_counts": (site_counts, finding_actions.SITE_COUNTS_SQL),
    "site_health_active": (_health, finding_actions.health_sql()),
    "findings_summary": (lambda s, d: findings.summary(_found(s, d)), findings.SUMMARY_SQL),
    "finding_runs": (three_runs, THREE_RUNS_SQL),
    "status_histogram": (lambda s, d: reports.status_histogram(_pages(s, d)), reports.STATUS_SQL),
    "site_trust": (lambda s, d: reports.trust(_pages(s, d)), reports.TRUST_SQL),
    "in_links": (lambda s, d: reports.in_links(_edges(s, d)), reports.IN_LINKS_SQL),
    "link_graph": (lambda s, d: reports.link_graph(_pages(s, d), _edges(s, d)), reports.LINK_GRAPH_SQL),
    "woven_link_graph": (lambda s, d: (lambda p: reports.link_graph(samples.one_site(p), samples.woven_edges(p)))(_pages(s, d)), reports.WOVEN_GRAPH_SQL),
    "link_totals": (lambda s, d: reports.link_totals(_pages(s, d), _edges(s, d)), reports.LINK_TOTALS_SQL),
    "tech_stack": (lambda s, d: reports.tech_scores(_pages(s, d)), reports.tech_sql()),
    "site_stacks": (lambda s, d: reports.stacks(samples.marked_paths(_pages(s, d))), reports.stacks_sql()),
    "pages_for_review": (lambda s, d: reports.pages_for_review(_pages(s, d)), reports.REVIEW_SQL),
    "page_listing": (lambda s, d: reports.page_of_rows(_pages(s, d)), reports.PAGINATION_SQL),
    "js_shells": (lambda s, d: reports.js_shells(_pages(s, d).select("page_id", "word_count").join(load(s, d, "pages").select("page_id", "html"), "page_id")), reports.JS_SHELL_SQL),
    "bot_blocks": (lambda s, d: captures.bot_blocks(inputs.walled_answers(load(s, d, "pages"))), captures.BOT_BLOCKS_SQL),
    "rendered_better": (lambda s, d: captures.rendered_better(*inputs.rendered_captures(_pages(s, d))), captures.RENDERED_SQL),
    "device_changes": (lambda s, d: captures.device_changes(*inputs.rendered_captures(_pages(s, d))), captures.DEVICES_SQL),
    "search_targets": (search_targets, targets.SEARCH_TARGETS_SQL),
    "inspection_urls": (inspection_urls, targets.INSPECTION_URLS_SQL),
    "content_dates": (lambda s, d: targets.content_dates(inputs.dated_pages(load(s, d, "pages"))), targets.CONTENT_DATES_SQL),
    "crawl_findings": (lambda s, d: targets.crawl_findings(inputs.job_snapshots(tables.jobs(s, d))), targets.CRAWL_FINDINGS_SQL),
    "action_queue": (action_queue, actions.ACTION_QUEUE_SQL),
    "latest_actions": (latest_actions, targets.LATEST_ACTIONS_SQL),
    "serp_summary": (lambda s, d: targets.serp_summary(inputs.serps(_pages(s, d))), targets.SERP_SQL),
    "url_keys": (url_keys, URL_KEYS_SQL),
    "html_fields": (html_fields, HTML_FIELDS_SQL),
    "normal_links": (normal_links, NORMAL_LINKS_SQL),
    "link_split": (lambda s, d: reports.link_split_rows(reports.link_split(samples.linking_pages(_pages(s, d)))), reports.LINK_SPLIT_SQL),
    "canonical_targets": (lambda s, d: reports.canonicals(samples.canonical_pages(load(s, d, "pages"))), reports.CANONICALS_SQL),
    "frontier_add": (frontier, queueing.FRONTIER_SQL),
    "crawl_quality": (lambda s, d: reports.crawl_quality(tables.jobs(s, d)), reports.QUALITY_SQL),
    "job_status_totals": (lambda s, d: reports.status_totals(tables.jobs(s, d)), reports.STATUS_TOTALS_SQL),
    "job_claim": (lambda s, d: queueing.claim(tables.jobs(s, d)), queueing.CLAIM_SQL),
    "job_recovery": (lambda s, d: queueing.recover(tables.jobs(s, d)), queueing.RECOVER_SQL),
    "job_retry": (lambda s, d: queueing.retry(tables.jobs(s, d)), queueing.RETRY_SQL),
    "job_latest": (lambda s, d: queueing.latest_per_site(tables.jobs(s, d)), queueing.LATEST_SQL),
    "job_enqueue": (job_enqueue, queueing.ENQUEUE_SQL),
    "job_cancel": (lambda s, d: queueing.cancelled(tables.jobs(s, d)), queueing.CANCEL_SQL),
    "job_resume": (job_resume, queueing.RESUME_SQL),
    "execution_jobs": (execution_jobs, queueing.EXECUTIONS_SQL),
    "agent_runs_waiting": (agent_runs_waiting, queueing.WAITING_SQL),
    "frontier_pop": (frontier_pop, queueing.FRONTIER_POP_SQL),
    "fact_day_caps": (lambda s, d: loading.capped_days(samples.raw_facts(_facts(s, d)), 1200), loading.CAPPED_SQL),
    "fact_parse": (lambda s, d: loading.parsed(samples.raw_facts(_facts(s, d))), loading.PARSED_SQL),
    "fact_load": (fact_load, loading.LOADED_SQL),
    "fact_pages": (lambda s, d: loading.assembled(inputs.paged_captures(_facts(s, d)), loading.SAMPLE_CAP)[0], loading.ASSEMBLED_SQL),
    "fact_commit": (fact_commit, loading.LOADED_SQL),
    "source_baseline": (lambda s, d: loading.baseline(_facts(s, d), load(s, d, "events")), loading.BASELINE_SQL),
    "page_upsert": (page_upsert, PAGE_UPSERT_SQL),
    "inspection_url_errors": (inspection_url_errors, INSPECTION_URL_SQL),
    "job_reservations": (lambda s, d: queueing.reservations(tables.jobs(s, d), load(s, d, "customer")), queueing.RESERVATIONS_SQL),
    "event_fold": (lambda s, d: queueing.folded(load(s, d, "events")), queueing.FOLD_SQL),
    "crawl_pacing": (lambda s, d: pacing.paced(inputs.paced_answers(load(s, d, "events"))), pacing.PACED_SQL),
    "term_counts": (lambda s, d: content.term_counts(_texts(s, d)), content.term_counts_sql(content.PAGE_TEXTS_SQL)),
    "page_topics": (lambda s, d: content.topics(_texts(s, d)), content.topics_sql(content.PAGE_TEXTS_SQL)),
    "page_entities": (lambda s, d: content.page_entities(content.page_names(_pages(s, d))), content.ENTITIES_SQL),
    "page_classes": (lambda s, d: content.page_classes(_texts(s, d)), content.classes_sql(content.PAGE_TEXTS_SQL)),
    "similar_pages": (lambda s, d: content.similar_pages(_texts(s, d)), content.similar_sql(content.PAGE_TEXTS_SQL)),
    "page_neighbours": (lambda s, d: content.neighbours(_texts(s, d)), content.neighbours_sql(content.PAGE_TEXTS_SQL)),
    "topic_clusters": (lambda s, d: content.clusters(content.topics(_texts(s, d))), content.clusters_sql(content.PAGE_TEXTS_SQL)),
    "link_recommendations": (_recommended, content.RECOMMEND_SQL),
    "semantic_graph": (lambda s, d: _graph(_texts(s, d)), content.graph_sql(content.PAGE_TEXTS_SQL)),
    "information_gain": (lambda s, d: content.information_gain(_texts(s, d), tables.page_queries(s, d)), content.gain_sql(content.PAGE_TEXTS_SQL, tables.PAGE_QUERIES_SQL)),
    # The same over whole documents, in the place of pages.
    "whole_term_counts": (lambda s, d: content.term_counts(_whole(s, d)), content.term_counts_sql(content.WHOLE_TEXTS_SQL)),
    "whole_page_topics": (lambda s, d: content.topics(_whole(s, d)), content.topics_sql(content.WHOLE_TEXTS_SQL)),
    "whole_page_entities": (lambda s, d: content.page_entities(_whole(s, d)), None),
    "whole_similar_pages": (lambda s, d: content.similar_pages(_whole(s, d)), content.similar_sql(content.WHOLE_TEXTS_SQL)),
    "whole_topic_clusters": (lambda s, d: content.clusters(content.topics(_whole(s, d))), content.clusters_sql(content.WHOLE_TEXTS_SQL)),
    "whole_link_recommendations": (_whole_recommended, None),
    "whole_semantic_graph": (lambda s, d: _graph(_whole(s, d)), content.graph_sql(content.WHOLE_TEXTS_SQL)),
    "whole_information_gain": (lambda s, d: content.information_gain(_whole(s, d)), content.gain_sql(content.WHOLE_TEXTS_SQL)),
    "site_run": (lambda s, d: site_run.run(s, d, f"{shared_dir(s)}/run-{uuid.uuid4().hex}").read("summary"), site_run.SUMMARY_SQL),
    "content_decay": (lambda s, d: content.decay(samples.with_ages(facts.period_change(_facts(s, d)))), content.decay_sql()),
    "content_candidates": (content_candidates, CONTENT_CANDIDATES_SQL),
    "content_briefs": (lambda s, d: _shown_briefs(_briefs(s, d)), drafts.BRIEFS_SQL),
    "content_drafts": (lambda s, d: _drafts(s, d).select("page_id", "slug", "meta_title", "meta_description", F.sha2("body", 256).alias("body_sha256"), "word_count", "version", "mode"), drafts.DRAFTS_SQL),
    "draft_quality": (lambda s, d: drafts.quality(_drafts(s, d)), drafts.QUALITY_SQL),
    "answer_analysis": (_answers, citations.ANALYSED_SQL),
    "citation_results": (_results, citations.RESULTS_SQL),
    "citation_scan": (lambda s, d: citations.scan_totals(_results(s, d)), citations.SCAN_SQL),
    "citation_competitors": (lambda s, d: citations.competitor_counts(_results(s, d)), citations.COMPETITORS_SQL),
    "citation_gaps": (lambda s, d: citations.gaps(_results(s, d)), citations.GAPS_SQL),
    "citation_gap_actions": (lambda s, d: citations.gap_actions(citations.gaps(_results(s, d))), citations.GAP_ACTIONS_SQL),
    "citation_gap_runs": (gap_runs, GAP_RUNS_SQL),
    "prompt_upsert": (lambda s, d: citations.prompts(load(s, d, "benchmark")), citations.PROMPTS_SQL),
    "inspection_latest": (lambda s, d: inspection.inspected_rows(_inspected(s, d)), inspection.INSPECTED_SQL),
    "inspection_opportunities": (lambda s, d: inspection.opportunities(_inspected(s, d)), inspection.INSPECTION_OPPS_SQL),
    "inspection_runs": (inspection_runs, INSPECTION_RUNS_SQL),
    "action_policy": (lambda s, d: policy.decided(_actions(s, d)), policy.DECIDED_SQL),
    "action_policy_counts": (lambda s, d: policy.decision_counts(policy.decided(_actions(s, d))), policy.DECISION_COUNTS_SQL),
    "fix_governance": (lambda s, d: policy.fixes(_actions(s, d)), policy.FIXES_SQL),
    "action_targets": (lambda s, d: governance.named_targets(inputs.action_plans(load(s, d, "orders"))), governance.TARGETS_SQL),
    "action_transitions": (lambda s, d: governance.transitions(*inputs.action_moves(load(s, d, "orders"))), governance.moves_sql()),
    "action_histories": (lambda s, d: governance.histories(*inputs.action_log(load(s, d, "orders"), load(s, d, "lineitem"))), governance.histories_sql()),
    "actions_due": (actions_due, governance.DUE_SQL),
    "action_backfill": (action_backfill, governance.BACKFILL_SQL),
    "content_actions": (content_actions, governance.CONTENT_ACTIONS_SQL),
    "connections_newest": (lambda s, d: governance.newest_connections(load(s, d, "orders").select(F.col("o_custkey").alias("workspace"), F.col("o_orderkey").alias("connection_id"), F.col("o_orderdate").alias("updated_at"))), governance.CONNECTIONS_SQL),
    "sandbox_reports": (sandbox_reports, governance.SANDBOX_SQL),
    "plan_entitlements": (lambda s, d: governance.entitlements(inputs.subscriptions(load(s, d, "customer"))), governance.ENTITLEMENTS_SQL),
    "link_runs": (link_runs, LINK_RUNS_SQL),
    "content_runs": (content_runs, CONTENT_RUNS_SQL),
    "action_state_counts": (action_state_counts, ACTION_STATE_COUNTS_SQL),
    "usage_snapshot": (usage_snapshot, USAGE_SNAPSHOT_SQL),
    "usage_quota": (lambda s, d: policy.usage(load(s, d, "orders"), load(s, d, "customer")), policy.USAGE_SQL),
    "audit_rate_limit": (lambda s, d: policy.rate_limited(load(s, d, "events")), policy.RATE_SQL),
    "audit_requests": (lambda s, d: policy.audit_requests(inputs.audit_requests(load(s, d, "events"))), policy.REQUESTS_SQL),
    "stream_closed_days": (lambda s, d: streams.run(streams.tumbling(_stream(s, d)), name="days"), streams.CLOSED_SQL),
    "stream_closed_sessions": (lambda s, d: streams.run(streams.sessions(_stream(s, d)), name="sessions"), streams.CLOSED_SESSIONS_SQL),
    "stream_fold": (lambda s, d: streams.run(streams.folded(_stream(s, d)), "complete", "fold"), queueing.FOLD_SQL),
    "stream_pacing": (stream_pacing, pacing.PACED_SQL),
    "stream_leases": (lambda s, d: leases.run(inputs.lease_events(_stream(s, d))), leases.LEASES_SQL),
    "stream_late_days": (stream_late_days, late.LATE_SQL),
    "stream_tumbling": (lambda s, d: streams.tumbling(load(s, d, "events")), streams.TUMBLING_SQL),
    "stream_sliding": (lambda s, d: streams.sliding(load(s, d, "events")), streams.SLIDING_SQL),
    "stream_sessions": (lambda s, d: streams.sessions(load(s, d, "events")), streams.SESSIONS_SQL),
}


def queries() -> dict:
    return {name: query for name, (query, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
