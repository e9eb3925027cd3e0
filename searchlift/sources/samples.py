"""Inputs that the stored tables lack, derived from their keys, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchlift.sources.tables import FACTS_SQL

#: Terms of the sample scans; words that occur in the answers.
BRAND, COMPETITORS = ("the", "die"), ("les", "que", "ing")


def answers(conversations: DataFrame) -> DataFrame:
    """Turns with a provider and cited URLs: none, one that is no web address, or one URL in two spellings."""
    page = F.concat(F.lit("/p"), F.col("turn").cast("string"))
    n = (F.col("conv_id") + F.col("turn")) % 3
    urls = F.when(n == 0, F.array().cast("array<string>")).when(n == 1, F.array(F.lit("ftp://example.com/x"))).otherwise(F.array(F.concat(F.lit("https://Example.com"), page), F.concat(F.lit("https://example.com"), page, F.lit("#top"))))
    return conversations.withColumns({"cited_urls": urls, "provider": F.when(F.col("turn") % 2 == 0, " ChatGPT").otherwise("perplexity")})


#: Verdict, coverage, robots, indexing and fetch states of the sample payloads by k % 6.
INSPECTED_STATES = (
    ("PASS", "Submitted and indexed", "ALLOWED", "INDEXING_ALLOWED", "SUCCESSFUL"),
    ("NEUTRAL", "Crawled - currently not indexed", "ALLOWED", "INDEXING_ALLOWED", "SUCCESSFUL"),
    ("FAIL", "Blocked by robots.txt", "DISALLOWED", "INDEXING_ALLOWED", "SUCCESSFUL"),
    ("FAIL", "Excluded by noindex tag", "ALLOWED", "BLOCKED_BY_META_TAG", "SUCCESSFUL"),
    ("FAIL", "Server error", "ALLOWED", "INDEXING_ALLOWED", "SERVER_ERROR"),
    (None, "Excluded for another reason", None, None, None),
)
_NAMES = ("verdict", "coverageState", "robotsTxtState", "indexingState", "pageFetchState")


def inspected_urls(events: DataFrame) -> DataFrame:
    """Events with the URL that each inspects, one for each user, but without a payload yet."""
    return events.select("ts", "event_id", "user_id", "props", F.concat(F.lit("https://shop.example.com/u/"), F.col("user_id").cast("string")).alias("inspection_url"))


def payloads(events: DataFrame) -> DataFrame:
    """Events as inspection payloads of a URL for each user."""
    k = F.get_json_object("props", "$.k").cast("int")
    state = lambda i: F.element_at(F.array(*[F.lit(s[i]) for s in INSPECTED_STATES]), k % 6 + 1).alias(_NAMES[i])
    url = F.concat(F.lit("https://shop.example.com/u/"), F.col("user_id").cast("string"))
    google = F.when(F.col("user_id") % 4 == 0, F.concat(url, F.lit("/other"))).when(F.col("user_id") % 4 == 1, F.concat(url, F.lit("/"))).when(F.col("user_id") % 4 == 2, url)
    lists = [F.transform(F.sequence(F.lit(1), 90 + k % 6 * 4), lambda i: F.concat(url, F.lit("/from/"), i.cast("string"))).alias("referringUrls"), F.when(k % 2 == 0, F.array(F.lit("https://shop.example.com/sitemap.xml"))).alias("sitemap")]
    index = F.struct(*[state(i) for i in range(5)], google.alias("googleCanonical"), url.alias("userCanonical"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("lastCrawlTime"), *lists)
    return events.select(url.alias("inspection_url"), "ts", "event_id", F.to_json(F.struct(index.alias("indexStatusResult"))).alias("payload"))


def _state_sql(i: int, name: str) -> str:
    value = lambda v: "NULL" if v is None else f"'{v}'"
    return f"CASE k % 6 {' '.join(f'WHEN {j} THEN {value(s[i])}' for j, s in enumerate(INSPECTED_STATES))} END AS {name}"


PAYLOADS_CTE = f"""e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k, concat('https://shop.example.com/u/', user_id) AS url FROM events),
raw AS (SELECT *, {', '.join(_state_sql(i, n) for i, n in enumerate(('v', 'coverage_state', 'robots_txt_state', 'indexing_state', 'page_fetch_state')))} FROM e),
states AS (SELECT url AS inspection_url, ts, event_id, coalesce(v, 'VERDICT_UNSPECIFIED') AS verdict, coverage_state, robots_txt_state, indexing_state, page_fetch_state, CAST(NULL AS VARCHAR) AS crawled_as,
 CASE user_id % 4 WHEN 0 THEN concat(url, '/other') WHEN 1 THEN concat(url, '/') WHEN 2 THEN url END AS google_canonical, url AS user_canonical, date_trunc('second', ts) AS last_crawl_time,
 CAST(least(100, 90 + k % 6 * 4) AS INT) AS referring_urls, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS sitemap_urls FROM raw)"""


#: The site of the sample actions, the day of reading, and the days that its sync jobs have loaded.
SITE, TODAY = "shop.example.com", "2024-02-28"
SYNCED = (("2024-01-01", "2024-01-20"), ("2024-01-15", "2024-02-10"), ("2024-02-11", "2024-02-25"))


def synced_ranges(spark) -> DataFrame:
    rows = spark.createDataFrame([(SITE, *x) for x in SYNCED], "site string, first string, last string")
    return rows.select("site", F.to_date("first").alias("first_day"), F.to_date("last").alias("last_day"))


def measured_actions(suppliers: DataFrame) -> DataFrame:
    """One action per supplier's page with its days and states; the target is a path or a URL."""
    k = F.col("s_suppkey")
    path = F.concat(F.lit("/s/"), k.cast("string"))
    day = F.date_add(F.lit("2024-01-10").cast("date"), (k % 40).cast("int"))
    ran = k % 8 != 7
    status = F.when(~ran, F.when(k % 2 == 0, "cancelled").when(k % 3 == 0, "failed").otherwise("execution_queued")).when(k % 7 == 0, "rolled_back").when(k % 7 == 1, "failed").when(k % 7 == 2, "executing").otherwise("succeeded")
    return suppliers.select(
        k.alias("action_id"), F.lit(SITE).alias("site"), F.when(k % 3 == 0, path).otherwise(F.concat(F.lit(f"https://{SITE}"), path, F.lit("#top"))).alias("target"), F.when(k % 10 == 0, "simulation").otherwise("github").alias("adapter"),
        status.alias("action_status"), F.date_sub(day, 5).alias("created_on"), F.when(ran, day).alias("started_on"), F.when(ran, day).alias("executed_on"), F.when(ran & (k % 7 > 2), F.date_add(day, 1)).alias("completed_on"),
        F.when(ran & (k % 7 == 0), F.date_add(day, (k % 20).cast("int"))).alias("rolled_back_on"), (k % 9 != 4).alias("mutation_applied"),
    )


ACTIONS_CTE = f"""acts AS (SELECT s_suppkey AS action_id, concat('https://{SITE}/s/', s_suppkey) AS page_url, CASE WHEN s_suppkey % 10 = 0 THEN 'simulation' ELSE 'github' END AS adapter,
 CASE WHEN s_suppkey % 8 = 7 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'cancelled' WHEN s_suppkey % 3 = 0 THEN 'failed' ELSE 'execution_queued' END ELSE CASE s_suppkey % 7 WHEN 0 THEN 'rolled_back' WHEN 1 THEN 'failed' WHEN 2 THEN 'executing' ELSE 'succeeded' END END AS action_status,
 d - 5 AS created_on, CASE WHEN s_suppkey % 8 <> 7 THEN d END AS started_on, CASE WHEN s_suppkey % 8 <> 7 THEN d END AS executed_on, CASE WHEN s_suppkey % 8 <> 7 AND s_suppkey % 7 > 2 THEN d + 1 END AS completed_on,
 CASE WHEN s_suppkey % 8 <> 7 AND s_suppkey % 7 = 0 THEN d + CAST(s_suppkey % 20 AS INT) END AS rolled_back_on, s_suppkey % 9 <> 4 AS mutation_applied FROM (SELECT *, DATE '2024-01-10' + CAST(s_suppkey % 40 AS INT) AS d FROM supplier))"""


def raw_facts(facts: DataFrame) -> DataFrame:
    """Facts as a provider's rows, keys and numbers as texts; by the position and clicks some are short, undated, off the site or without a number."""
    day, n = F.date_format("metric_date", "yyyy-MM-dd"), F.col("impressions").cast("int")
    keys = F.when(n == 7, F.array(day, "query")).when(n == 11, F.array(F.lit("2024-13-45"), F.col("query"), F.col("page_url"))).when(n == 13, F.array(day, F.col("query"), F.lit("https://other.example.org/x"))).otherwise(F.array(day, F.col("query"), F.when(n == 17, F.replace("page_url", F.lit("https://"), F.lit("http://www."))).otherwise(F.col("page_url"))))
    text = lambda c: F.when(n == 19, F.lit(None)).otherwise(F.format_string("%.1f", c)).alias(c)
    return facts.select(keys.alias("keys"), text("clicks"), F.format_string("%.1f", "impressions").alias("impressions"), F.format_string("%.1f", "position").alias("position"))


RAW_CTE = f"""{FACTS_SQL}, raw AS (SELECT CASE WHEN CAST(impressions AS INT) = 11 THEN '2024-13-45' ELSE strftime(metric_date, '%Y-%m-%d') END AS day, query, regexp_extract(page_url, '(/s/.*)$', 1) AS path,
 CASE CAST(impressions AS INT) WHEN 13 THEN 'https://other.example.org/x' WHEN 17 THEN replace(page_url, 'https://', 'http://www.') ELSE page_url END AS url, CASE WHEN CAST(impressions AS INT) IN (7, 11, 13) THEN 'bad' ELSE 'good' END AS kind,
 CASE WHEN CAST(impressions AS INT) <> 19 THEN CAST(clicks AS VARCHAR) END AS clicks, CAST(impressions AS VARCHAR) AS impressions, CAST(position AS VARCHAR) AS position FROM facts)"""


def linking_pages(pages: DataFrame) -> DataFrame:
    """Captured pages (page_id, url, site) with links of every kind: off the site, without a scheme, relative, of another spelling, a file, a query alone; every eleventh says nofollow."""
    i, host = F.col("page_id"), F.upper(F.regexp_extract("url", "^[a-zA-Z]+://([^/?#]+)", 1))
    links = F.array(
        F.lit("https://other.example.org/x"), F.lit(" https://other.example.org/x "), F.lit("//cdn.example.net/lib"), F.concat(F.lit("/p/"), (i % 10).cast("string"), F.lit("?utm_source=a&b=2&a=1#top")),
        F.lit("../up/./x"), F.lit("mailto:me@example.com"), F.concat(F.lit("HTTPS://"), host, F.lit("/P")), F.lit("/files/list.pdf"), F.lit("?page=2"), F.lit("#top"), F.lit(""),
    )
    return pages.select("page_id", "url", "site", F.when(i % 11 == 3, "noindex, NoFollow").otherwise("index").alias("robots"), links.alias("links"))


def canonical_pages(pages: DataFrame) -> DataFrame:
    """Captured pages with a canonical: none, a rooted or relative path, one without a scheme, or a query alone."""
    i = F.col("page_id")
    canonical = F.when(i % 6 == 0, F.regexp_extract("url", "^([^#]*)", 1)).when(i % 6 == 1, F.concat(F.lit("/c/"), i.cast("string"))).when(i % 6 == 2, "../c").when(i % 6 == 3, "//other.example.org/c").when(i % 6 == 4, " ?v=2")
    return pages.select("page_id", "url", canonical.alias("canonical"))


def described_pages(pages: DataFrame) -> DataFrame:
    """Captured pages with a description: every third has none, the others share theirs, in two spellings, by the last digit of their number."""
    i = F.col("page_id")
    return pages.withColumn("description", F.when(i % 3 == 0, "").when(i % 2 == 0, F.concat(F.lit(" ABOUT "), (i % 10).cast("string"))).otherwise(F.concat(F.lit("About "), (i % 10).cast("string"))))


DESCRIBED_SQL = "CASE WHEN page_id % 3 = 0 THEN '' WHEN page_id % 2 = 0 THEN concat(' ABOUT ', page_id % 10) ELSE concat('About ', page_id % 10) END"


def one_site(pages: DataFrame) -> DataFrame:
    """Captured pages as those of three sites, by their number, so that sites have more than a page or two."""
    return pages.withColumn("site", F.concat(F.lit("site"), (F.col("page_id") % 3).cast("string")))


def woven_edges(pages: DataFrame) -> DataFrame:
    """Edges (site, src, dst) from each page to the page of its site whose number is three more, to itself, and to a path that no page has."""
    p = one_site(pages).select("site", "path", "page_id")
    following = p.select("site", F.col("path").alias("dst"), (F.col("page_id") - 3).alias("page_id"))
    real = p.join(following, ["site", "page_id"]).select("site", F.col("path").alias("src"), "dst")
    return real.unionByName(p.select("site", F.col("path").alias("src"), F.explode(F.array("path", F.lit("/nowhere"))).alias("dst")))


WOVEN_CTE = """woven AS (SELECT page_id, concat('site', page_id % 3) AS site, path FROM crawled),
edges AS (SELECT a.site, a.path AS src, b.path AS dst FROM woven a JOIN woven b ON a.site = b.site AND b.page_id = a.page_id + 3 UNION ALL SELECT site, path, unnest([path, '/nowhere']) FROM woven)"""


#: Ends of paths that show what a site is made of, by the page's number.
MARKS = ("/_next/data", "/wp-content/x", "/Ghost/api/", "/blog", "/wp-json/v2", "/static/app", "/about")
MARKED_PATH_SQL = f"concat(path, CASE page_id % 3 WHEN 2 THEN '' ELSE list_extract([{', '.join(f"'{m}'" for m in MARKS)}], CAST((page_id // 3) % {len(MARKS)} AS INT) + 1) END)"


def marked_paths(pages: DataFrame) -> DataFrame:
    """Captured pages of three sites with such ends; the third site shows nothing."""
    end = F.element_at(F.array(*[F.lit(m) for m in MARKS]), (F.floor(F.col("page_id") / 3) % len(MARKS) + 1).cast("int"))
    return one_site(pages).withColumn("path", F.concat("path", F.when(F.col("page_id") % 3 == 2, "").otherwise(end)))


def with_ages(change: DataFrame) -> DataFrame:
    """Pages with an age in days, by the number of their URL."""
    return change.withColumn("age_days", (F.regexp_extract("page_url", "([0-9]+)$", 1).cast("int") * 37) % 900)


USED_METRICS = ("monthly_crawl_pages", "ai_requests", "ai_tokens", "serp_queries")


def usage_events(lines: DataFrame) -> DataFrame:
    """Order lines as uses of a metric by fifty workspaces; some quantities are no use at all."""
    metric = F.element_at(F.array(*[F.lit(m) for m in (*USED_METRICS, "unknown")]), (F.col("l_partkey") % 5 + 1).cast("int"))
    return lines.select((F.col("l_suppkey") % 50).alias("workspace"), metric.alias("metric"), F.floor(F.col("l_quantity") - 3).cast("bigint").alias("quantity"), F.date_trunc("month", "l_shipdate").cast("date").alias("period"))


USAGE_CTE = f"""uses AS (SELECT l_suppkey % 50 AS workspace, list_extract([{', '.join(f"'{m}'" for m in (*USED_METRICS, "unknown"))}], CAST(l_partkey % 5 AS INT) + 1) AS metric, CAST(floor(l_quantity - 3) AS BIGINT) AS quantity, CAST(date_trunc('month', l_shipdate) AS DATE) AS period FROM lineitem)"""
