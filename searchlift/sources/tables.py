"""Tables of the engine as projections of stored Parquet tables.

Each projection comes with its DuckDB twin (an SQL text that stands as a common table
expression), so that every query over it can be stated in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchlift.functions import html
from searchlift.functions.urls import resolved
from searchlift.sources.staging import staged

#: Letters, digits and underscores, joined inside by apostrophes and hyphens: one word in either engine.
WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_'-]*[\p{L}\p{N}_])?"
#: The last day of the search facts, and the windows that end there.
PERIOD_END, RECENT_FROM, PREVIOUS_TO, CURRENT_FROM = "2024-02-25", "2024-01-29", "2024-02-11", "2024-02-12"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def search_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """metric_date, query, page_url, clicks, impressions, position: one row per order line."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_brand")
    day = F.col("l_orderkey") % 56
    clicks = F.when(F.col("l_suppkey") % 3 == 0, 0.0).when(day < 42, F.floor(F.col("l_quantity") * 0.2)).otherwise(F.floor(F.col("l_quantity") * 0.02 * (F.col("l_suppkey") % 6)))
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.date_add(F.lit("2024-01-01").cast("date"), day.cast("int")).alias("metric_date"),
        F.col("p_brand").alias("query"),
        F.concat(F.lit("https://shop.example.com/s/"), F.col("l_suppkey").cast("string")).alias("page_url"),
        clicks.cast("double").alias("clicks"),
        F.col("l_quantity").alias("impressions"),
        (1 + (F.col("l_suppkey") * 5 + F.col("l_partkey") % 4) % 22).cast("double").alias("position"),
    )


FACTS_SQL = """facts AS (
  SELECT DATE '2024-01-01' + CAST(l_orderkey % 56 AS INT) AS metric_date, p_brand AS query,
         concat('https://shop.example.com/s/', CAST(l_suppkey AS VARCHAR)) AS page_url,
         CASE WHEN l_suppkey % 3 = 0 THEN 0.0 WHEN l_orderkey % 56 < 42 THEN floor(l_quantity * 0.2)
              ELSE floor(l_quantity * 0.02 * (l_suppkey % 6)) END AS clicks,
         l_quantity AS impressions, CAST(1 + (l_suppkey * 5 + l_partkey % 4) % 22 AS DOUBLE) AS position
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def crawled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the fields of the findings, read once by the tolerant parser and staged for all that use them.

    What an answer has beside its page, which captured pages lack, follows from page_id: status_code,
    response_time_ms, redirects, content_type, and the statuses of the site's robots.txt and sitemap.
    Missing texts are empty.
    """
    text = lambda name: F.coalesce(F.trim(F.col(f"p.{name}")), F.lit("")).alias(name)
    i = F.col("page_id")
    parsed = load(spark, sf_dir, "pages").select(
        "page_id",
        "url",
        F.regexp_replace(F.regexp_extract(F.lower("url"), r"^https?://([^/?#:]+)", 1), r"^www\.", "").alias("site"),
        F.coalesce(F.nullif(F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1), F.lit("")), F.lit("/")).alias("path"),
        F.regexp_extract("url", r"\?([^#]*)", 1).alias("query_string"),
        F.when(i % 25 == 7, 404).when(i % 25 == 13, 500).when(i % 25 == 19, 301).otherwise(200).cast("int").alias("status_code"),
        ((i * 131) % 4000).cast("int").alias("response_time_ms"),
        F.when(i % 20 == 3, 2).when(i % 20 == 9, 1).otherwise(0).cast("int").alias("redirects"),
        F.when(i % 17 == 5, "application/pdf").otherwise("text/html; charset=utf-8").alias("content_type"),
        F.when(i % 9 == 4, 404).when(i % 9 != 5, 200).cast("int").alias("robots_status"),
        F.when(i % 13 == 6, 500).when(i % 13 != 7, 200).cast("int").alias("sitemap_status"),
        html.extract(F.col("html")).alias("p"),
    )
    fields = parsed.select(
        *[c for c in parsed.columns if c != "p"],
        *map(text, ("title", "description", "viewport", "robots", "lang")),
        F.when(F.trim(F.coalesce("p.canonical", F.lit(""))) == "", "").otherwise(resolved(F.col("url"), F.col("p.canonical"))).alias("canonical"),
        F.size("p.h1").alias("h1_count"),
        F.coalesce(F.get("p.h1", 0), F.lit("")).alias("h1"),
        F.concat("p.h2", "p.h3").alias("headings"),
        "p.json_ld_count",
        "p.images_without_alt",
        "p.images_empty_alt",
        F.map_contains_key("p.og", F.lit("og:title")).alias("og_title"),
        "p.word_count",
        "p.links",
    )
    return staged(fields, "crawled")


def _decoded_sql(c: str) -> str:
    for entity, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        c = f"replace({c}, '{entity}', '{char}')"
    return c


#: The same in SQL, for pages as regular as the stored ones.
PAGES_SQL = rf"""crawled AS (
  SELECT page_id, url,
         regexp_replace(regexp_extract(lower(url), '^https?://([^/?#:]+)', 1), '^www\.', '') AS site,
         coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), ''), '/') AS path,
         regexp_extract(url, '\?([^#]*)', 1) AS query_string,
         CAST(CASE page_id % 25 WHEN 7 THEN 404 WHEN 13 THEN 500 WHEN 19 THEN 301 ELSE 200 END AS INT) AS status_code,
         CAST((page_id * 131) % 4000 AS INT) AS response_time_ms,
         CAST(CASE page_id % 20 WHEN 3 THEN 2 WHEN 9 THEN 1 ELSE 0 END AS INT) AS redirects,
         CASE WHEN page_id % 17 = 5 THEN 'application/pdf' ELSE 'text/html; charset=utf-8' END AS content_type,
         CAST(CASE WHEN page_id % 9 = 4 THEN 404 WHEN page_id % 9 <> 5 THEN 200 END AS INT) AS robots_status,
         CAST(CASE WHEN page_id % 13 = 6 THEN 500 WHEN page_id % 13 <> 7 THEN 200 END AS INT) AS sitemap_status,
         trim({_decoded_sql("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}) AS title,
         trim({_decoded_sql("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")}) AS h1,
         regexp_extract(html, '<meta name="description" content="([^"]*)"', 1) AS description,
         regexp_extract(html, '<link rel="canonical" href="([^"]*)"', 1) AS canonical,
         regexp_extract(html, '<meta name="viewport" content="([^"]*)"', 1) AS viewport,
         regexp_extract(html, '<meta name="robots" content="([^"]*)"', 1) AS robots,
         regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
         CAST(len(regexp_extract_all(html, '<h1[ >]')) AS INT) AS h1_count,
         CAST(len(regexp_extract_all(html, 'application/ld\+json')) AS INT) AS json_ld_count,
         CAST(len(regexp_extract_all(html, '<img ')) - len(regexp_extract_all(html, '<img [^>]*alt=')) AS INT) AS images_without_alt,
         CAST(len(regexp_extract_all(html, '<img ')) - len(regexp_extract_all(html, '<img [^>]*alt="[^"]')) AS INT) AS images_empty_alt,
         contains(html, 'property="og:title"') AS og_title,
         CAST(len(regexp_extract_all({_decoded_sql("regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g')")}, '{WORD.replace("'", "''")}')) AS INT) AS word_count,
         regexp_extract_all(html, '<a href="([^"]+)"', 1) AS links
  FROM pages)"""


def page_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, query) of the current window: the suppliers' lines as searches that found the page of the same number."""
    lines = load(spark, sf_dir, "lineitem").where(f"l_orderkey % 56 >= {CURRENT_DAY}").select(F.col("l_suppkey").alias("page_id"), F.col("l_partkey").alias("p_partkey"))
    parts = load(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(" part-"), F.col("p_partkey").cast("string")).alias("query"))
    return lines.join(parts, "p_partkey").select("page_id", "query").distinct()


#: Days from the first to the start of the current window.
CURRENT_DAY = 42
PAGE_QUERIES_SQL = f"page_queries AS (SELECT DISTINCT l_suppkey AS page_id, concat(p_name, ' part-', p_partkey) AS query FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey % 56 >= {CURRENT_DAY})"


def link_edges(pages: DataFrame) -> DataFrame:
    """(site, src, dst): distinct internal links between paths, self-links included; pages that say nofollow have none."""
    target = F.regexp_extract("link", r"^([^?#]*)", 1)
    followed = pages.where(~F.contains(F.lower("robots"), F.lit("nofollow")))
    links = followed.select("site", F.col("path").alias("src"), F.explode("links").alias("link")).where(F.col("link").startswith("/"))
    return links.select("site", "src", target.alias("dst")).distinct()


EDGES_SQL = r"""edges AS (
  SELECT DISTINCT site, path AS src, regexp_extract(link, '^([^?#]*)', 1) AS dst
  FROM (SELECT site, path, unnest(links) AS link FROM crawled WHERE lower(robots) NOT LIKE '%nofollow%') WHERE link LIKE '/%')"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as queued jobs of their customer's site."""
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("completed")
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_custkey").alias("site_id"),
        status.alias("status"),
        F.regexp_extract("o_orderpriority", "^([0-9])", 1).cast("int").alias("priority"),
        F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderkey") % 5).cast("int").alias("attempt_count"),
        F.lit(3).alias("max_attempts"),
        (F.col("o_orderdate") + F.expr("INTERVAL 30 MINUTES")).alias("lease_expires_at"),
        F.floor(F.col("o_totalprice") / 1000).cast("int").alias("pages"),
    )


JOBS_SQL = """jobs AS (
  SELECT o_orderkey AS job_id, o_custkey AS site_id,
         CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'completed' END AS status,
         try_cast(regexp_extract(o_orderpriority, '^([0-9])', 1) AS INT) AS priority, o_orderdate AS created_at,
         CAST(o_orderkey % 5 AS INT) AS attempt_count, 3 AS max_attempts,
         o_orderdate + INTERVAL 30 MINUTES AS lease_expires_at, CAST(floor(o_totalprice / 1000) AS INT) AS pages
  FROM orders)"""
