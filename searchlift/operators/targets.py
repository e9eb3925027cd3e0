"""Where opportunities lead: paths, what to do about them, URLs to inspect, the dates of content and the crawl's own artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from searchlift.functions.text import date_in
from searchlift.functions.urls import host_key, path_of
from searchlift.operators.facts import OPPORTUNITY_CTE
from searchlift.operators.inspection import INSPECTION_OPPS_SQL
from searchlift.sources.tables import JOBS_SQL, PAGES_SQL

#: Paths that get no content work, and opportunity types that are technical fixes.
EXCLUDED = ("/privacy", "/privacy-policy", "/terms", "/terms-of-service", "/cookies", "/cookie-policy")
EXCLUDED_UNDER = ("/admin", "/api", "/auth", "/login", "/logout", "/register", "/signup", "/_next")
TECHNICAL = ("indexation_blocked", "not_indexed", "canonical_mismatch")


def site_path(url: Column, site: Column) -> Column:
    """The decoded path of a URL or path on the site, without a trailing slash; null off the site or without a value."""
    u = F.trim(url)
    whole = F.contains(u, F.lit("://"))
    path = F.when(whole, path_of(u)).otherwise(F.concat(F.lit("/"), F.regexp_replace(F.regexp_extract(u, "^([^?#]*)", 1), "^/+", "")))
    # A plus sign in a path is a plus sign.
    path = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    path = F.coalesce(F.nullif(F.regexp_replace(path, "/+$", ""), F.lit("")), F.lit("/"))
    return F.when((u != "") & (~whole | (host_key(u) == F.regexp_replace(F.lower(site), r"^www\.", ""))), path)


def excluded(path: Column) -> Column:
    p = F.lower(path)
    under = F.exists(F.array(*[F.lit(x) for x in EXCLUDED_UNDER]), lambda x: (p == x) | F.startswith(p, F.concat(x, F.lit("/"))))
    return F.coalesce(p.isin(*EXCLUDED) | under, F.lit(False))


def target_of(kind: Column, path: Column) -> Column:
    return F.when(excluded(path), "excluded").when(kind.isin(*TECHNICAL), "technical_fix").when(path.isNotNull(), "refresh_existing_page").otherwise("new_page")


def search_targets(opportunities: DataFrame, pages: DataFrame, site: str) -> DataFrame:
    """opportunity_type, page_url, ... with path, target and page_id.

    Excluded paths come first, then technical types; what has a path refreshes its page, the rest is a new page.
    """
    path = site_path(F.col("page_url"), F.lit(site))
    o = opportunities.withColumn("path", path)
    target = target_of(F.col("opportunity_type"), F.col("path"))
    ids = pages.where(F.col("site") == site).groupBy("path").agg(F.min("page_id").alias("page_id"))
    return o.withColumn("target", target).join(ids, "path", "left")


def mixed_opportunities(searched: DataFrame, inspected: DataFrame) -> DataFrame:
    """Search and inspection opportunities in one table; of the latter every ninth URL is moved under an excluded path."""
    a = searched.select("opportunity_type", "query", "page_url")
    user = F.regexp_extract("inspection_url", "([0-9]+)$", 1).cast("int")
    url = F.when(user % 9 == 0, F.concat(F.lit("https://www.shop.example.com/Login/"), user.cast("string"))).otherwise(F.concat("inspection_url", F.lit("/?a=1")))
    return a.unionByName(inspected.select("opportunity_type", F.lit(None).cast("string").alias("query"), url.alias("page_url")))


SEARCH_TARGETS_SQL = f"""WITH {OPPORTUNITY_CTE}, i AS ({INSPECTION_OPPS_SQL}), m AS (SELECT *, CAST(regexp_extract(inspection_url, '([0-9]+)$', 1) AS INT) AS u FROM i),
every AS (SELECT opportunity_type, query, page_url, regexp_extract(page_url, '(/s/.*)$', 1) AS path FROM opps
 UNION ALL SELECT opportunity_type, NULL, CASE WHEN u % 9 = 0 THEN concat('https://www.shop.example.com/Login/', u) ELSE concat(inspection_url, '/?a=1') END, CASE WHEN u % 9 = 0 THEN concat('/Login/', u) ELSE concat('/u/', u) END FROM m)
SELECT opportunity_type, query, page_url, path, CASE WHEN path LIKE '/Login/%' THEN 'excluded' WHEN opportunity_type IN {TECHNICAL} THEN 'technical_fix' WHEN path IS NOT NULL THEN 'refresh_existing_page' ELSE 'new_page' END AS target, CAST(NULL AS BIGINT) AS page_id FROM every"""


#: Each page's facts as the structured data that a publisher embeds; where the month is past 12, the second date is none.
JSON_LD = """'{"@graph":[{"datePublished":"2023-' || lpad(CAST(1 + page_id % 12 AS STRING), 2, '0') || '-05"},{"dateModified":"2024/' || CAST(1 + page_id % 14 AS STRING) || '/9"}]}'"""


def content_dates(pages: DataFrame) -> DataFrame:
    """page_id, json_ld, created_on -> the newest date in the structured data, else the first crawl's day; and which it is."""
    stated = F.regexp_extract_all("json_ld", F.lit(r'(?i)"date(?:published|modified|created)"\s*:\s*"([^"]*)"'), F.lit(1))
    newest = F.array_max(F.transform(stated, date_in))
    basis = F.when(newest.isNotNull(), "json_ld").when(F.col("created_on").isNotNull(), "first_crawl").otherwise("unknown")
    return pages.select("page_id", F.coalesce(newest, "created_on").alias("content_date"), basis.alias("basis"))


CONTENT_DATES_SQL = """WITH p AS (SELECT page_id, 1 + page_id % 12 AS m, 1 + page_id % 14 AS n, page_id % 5 AS k FROM pages),
d AS (SELECT page_id, CASE WHEN k < 3 THEN CASE WHEN n <= 12 THEN make_date(2024, n, 9) ELSE make_date(2023, m, 5) END END AS stated, CASE WHEN k < 4 THEN DATE '2024-01-01' + CAST(page_id % 50 AS INT) END AS created FROM p)
SELECT page_id, coalesce(stated, created) AS content_date, CASE WHEN stated IS NOT NULL THEN 'json_ld' WHEN created IS NOT NULL THEN 'first_crawl' ELSE 'unknown' END AS basis FROM d"""


def crawl_findings(snapshots: DataFrame) -> DataFrame:
    """Findings of a site's newest completed crawl: no robots.txt, no usable sitemap."""
    last = snapshots.where("status = 'completed'").groupBy("site_id").agg(F.max_by(F.struct("robots_status", "sitemap_errors", "urls_discovered"), F.struct("created_at", "job_id")).alias("s"))
    kinds = F.array(
        F.when(F.col("s.robots_status") >= 400, F.struct(F.lit("missing_robots_txt").alias("finding_type"), F.lit("robots_update").alias("action_type"), F.lit(100).alias("confidence"), F.lit(25).alias("effort"), F.lit(85).alias("risk"))),
        F.when((F.col("s.sitemap_errors") > 0) & (F.coalesce("s.urls_discovered", F.lit(0)) == 0), F.struct(F.lit("missing_or_invalid_sitemap").alias("finding_type"), F.lit("sitemap_update").alias("action_type"), F.lit(95).alias("confidence"), F.lit(35).alias("effort"), F.lit(45).alias("risk"))),
    )
    return last.select("site_id", F.explode(F.array_compact(kinds)).alias("f")).select("site_id", "f.*", F.lit("high").alias("severity"), F.lit(70).alias("impact"))


CRAWL_FINDINGS_SQL = f"""WITH {JOBS_SQL}, l AS (SELECT site_id, job_id AS j FROM jobs WHERE status = 'completed' QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY created_at DESC, job_id DESC) = 1)
SELECT site_id, 'missing_robots_txt' AS finding_type, 'robots_update' AS action_type, 100 AS confidence, 25 AS effort, 85 AS risk, 'high' AS severity, 70 AS impact FROM l WHERE j % 5 IN (1, 2)
UNION ALL SELECT site_id, 'missing_or_invalid_sitemap', 'sitemap_update', 95, 35, 45, 'high', 70 FROM l WHERE j % 3 > 0 AND j % 4 = 0"""


def latest_actions(findings: DataFrame, actions: DataFrame, current: tuple[str, ...] = ("queued", "running")) -> DataFrame:
    """Each finding with its newest action that is still current; findings without one stay, with nulls."""
    newest = actions.where(F.col("status").isin(*current)).groupBy("finding_id").agg(F.max_by(F.struct("action_id", "status", "created_at"), F.struct("created_at", "action_id")).alias("a"))
    return findings.join(newest, "finding_id", "left").select("finding_id", "a.action_id", "a.status", "a.created_at")


LATEST_ACTIONS_SQL = f"""WITH {JOBS_SQL}, n AS (SELECT site_id, job_id, status, created_at FROM jobs WHERE status IN ('queued', 'running') QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY created_at DESC, job_id DESC) = 1)
SELECT c_custkey AS finding_id, job_id AS action_id, status, created_at FROM customer LEFT JOIN n ON c_custkey = site_id"""


SERP = "query string, organic array<struct<position: int, title: string, link: string, snippet: string>>, peopleAlsoAsk array<struct<question: string>>, relatedSearches array<struct<query: string>>"


def serp_summary(answers: DataFrame, results: int = 10) -> DataFrame:
    """keyword, payload (the provider's JSON) -> what ranks: average title length, top titles, snippets, questions and searches.

    Answers that are null or no JSON give available = false and nothing else; missing titles count as empty.
    """
    a = answers.select("keyword", F.from_json("payload", SERP).alias("s"))
    known = F.col("s").isNotNull() & (F.coalesce(F.size("s.organic"), F.lit(-1)) >= 0)
    organic = F.slice("s.organic", 1, results)
    titles = F.transform(organic, lambda r: F.coalesce(r.title, F.lit("")))
    length = F.aggregate(titles, F.lit(0), lambda n, t: n + F.length(t)) / F.greatest(F.size(titles), F.lit(1))
    listed = lambda xs, n: F.when(known, F.array_join(F.slice(xs, 1, n), "|", ""))
    none = F.array().cast("array<string>")
    return a.select(
        "keyword", known.alias("available"), F.when(known, F.size(organic)).alias("results"), F.when(known, F.bround(length, 0).cast("int")).alias("avg_title_length"), listed(titles, 5).alias("top_titles"),
        listed(F.transform(organic, lambda r: F.coalesce(r.snippet, F.lit(""))), 3).alias("top_snippets"), listed(F.coalesce("s.peopleAlsoAsk.question", none), 5).alias("questions"), listed(F.coalesce("s.relatedSearches.query", none), 5).alias("searches"),
    )


SERP_SQL = f"""WITH {PAGES_SQL}, r AS (SELECT site, title, path, row_number() OVER (PARTITION BY site ORDER BY page_id) AS k FROM crawled)
SELECT site AS keyword, true AS available, CAST(count(*) FILTER (k <= 10) AS INT) AS results, CAST(round_even(avg(length(title)) FILTER (k <= 10), 0) AS INT) AS avg_title_length, string_agg(title, '|' ORDER BY k) FILTER (k <= 5) AS top_titles,
 string_agg(path, '|' ORDER BY k) FILTER (k <= 3) AS top_snippets, string_agg(concat('What is ', path), '|' ORDER BY k) FILTER (k <= 5) AS questions, '' AS searches FROM r GROUP BY site"""


def inspection_urls(searched: DataFrame, crawled: DataFrame, limit: int = 50) -> DataFrame:
    """URLs to inspect next: searched pages by impressions, crawled ones by URL, each once, up to the limit.

    Either side is cut to twice the limit before its places are counted, so that no task ranks a whole table.
    """
    top = [
        searched.orderBy(F.desc("impressions"), "page_url").limit(2 * limit).select(F.lit(0).alias("source"), (-F.col("impressions")).alias("by"), F.col("page_url").alias("url")),
        crawled.where("status_code = 200").select("url").distinct().orderBy("url").limit(2 * limit).select(F.lit(1).alias("source"), F.lit(0.0).alias("by"), "url"),
    ]
    first = top[0].unionByName(top[1]).groupBy("url").agg(F.min(F.struct("source", "by")).alias("at")).select("url", "at.source", "at.by")
    return first.withColumn("place", F.row_number().over(Window.orderBy("source", "by", "url"))).where(F.col("place") <= limit).select("url", "source", "place")


INSPECTION_URLS_SQL = f"""WITH {OPPORTUNITY_CTE}, {PAGES_SQL}, a AS (SELECT 0 AS source, -sum(impressions) AS rate, page_url AS url FROM facts GROUP BY page_url), b AS (SELECT DISTINCT 1 AS source, 0.0 AS rate, url FROM crawled WHERE status_code = 200)
SELECT url, source, CAST(row_number() OVER (ORDER BY source, rate, url) AS INT) AS place FROM (FROM a UNION ALL FROM b) QUALIFY place <= 50"""
