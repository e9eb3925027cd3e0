"""URL inspection: raw payloads to typed rows, the latest of each URL, and the opportunities they show."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from searchlift.sources.samples import PAYLOADS_CTE

TEXTS = {"verdict": ("verdict", 64), "coverage_state": ("coverageState", 255), "robots_txt_state": ("robotsTxtState", 64), "indexing_state": ("indexingState", 64), "page_fetch_state": ("pageFetchState", 64), "crawled_as": ("crawledAs", 64), "google_canonical": ("googleCanonical", 2048), "user_canonical": ("userCanonical", 2048)}
LISTED = 100


def flattened(payloads: DataFrame) -> DataFrame:
    """inspection_url, ts, event_id, payload (the provider's JSON) -> typed columns.

    Missing and empty values are null (the verdict VERDICT_UNSPECIFIED), long ones are cut to their
    column, lists to their first hundred; what is no list counts as an empty one, what is no object as nothing.
    """
    v = F.col("__v")
    at = lambda name, kind="string": F.try_variant_get(v, f"$.indexStatusResult.{name}", kind)
    texts = [F.substring(F.nullif(at(source), F.lit("")), 1, size).alias(name) for name, (source, size) in TEXTS.items()]
    listed = lambda source, name: F.transform(F.slice(F.coalesce(at(source, "array<string>"), F.array().cast("array<string>")), 1, LISTED), lambda u: F.substring(u, 1, 2048)).alias(name)
    out = payloads.withColumn("__v", F.try_parse_json("payload")).select("inspection_url", "ts", "event_id", *texts, F.try_to_timestamp(F.replace(at("lastCrawlTime"), F.lit("Z"), F.lit("+00:00"))).alias("last_crawl_time"), listed("referringUrls", "referring_urls"), listed("sitemap", "sitemap_urls"))
    return out.withColumn("verdict", F.coalesce("verdict", F.lit("VERDICT_UNSPECIFIED")))


def latest(results: DataFrame) -> DataFrame:
    """The latest row of each URL."""
    w = Window.partitionBy("inspection_url").orderBy(F.desc("ts"), F.desc("event_id"))
    return results.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def inspected(payloads: DataFrame) -> DataFrame:
    """The latest result per URL: ranked first, so that only the payloads that stay are parsed, each once."""
    return flattened(latest(payloads)).drop("event_id")


def inspected_rows(results: DataFrame) -> DataFrame:
    """Results with their lists as numbers of URLs."""
    return results.withColumns({"referring_urls": F.size("referring_urls"), "sitemap_urls": F.size("sitemap_urls")})


INSPECTED_CTE = f"""{PAYLOADS_CTE},
inspected AS (SELECT inspection_url, ts, {', '.join(f"{name}" for name in TEXTS)}, last_crawl_time, referring_urls, sitemap_urls FROM states QUALIFY row_number() OVER (PARTITION BY inspection_url ORDER BY ts DESC, event_id DESC) = 1)"""
INSPECTED_SQL = f"WITH {INSPECTED_CTE} SELECT * FROM inspected"

BLOCKED = "(coalesce(robots_txt_state, '') = 'DISALLOWED' OR coalesce(indexing_state, '') IN ('BLOCKED_BY_META_TAG', 'BLOCKED_BY_HTTP_HEADER') OR coalesce(page_fetch_state, 'SUCCESSFUL') NOT IN ('PAGE_FETCH_STATE_UNSPECIFIED', 'SUCCESSFUL'))"
UNINDEXED = "(verdict IN ('FAIL', 'NEUTRAL') OR lower(coalesce(coverage_state, '')) LIKE '%not indexed%' OR lower(coalesce(coverage_state, '')) LIKE '%excluded%')"
CONFIDENCE = "CASE WHEN verdict = 'VERDICT_UNSPECIFIED' THEN 60 ELSE 95 END"


def opportunities(results: DataFrame) -> DataFrame:
    """indexation_blocked (90) or not_indexed (82), and canonical_mismatch (75) beside either."""
    kind = F.when(F.expr(BLOCKED), "indexation_blocked").when(F.expr(UNINDEXED), "not_indexed")
    differ = F.regexp_replace("google_canonical", "/+$", "") != F.regexp_replace("user_canonical", "/+$", "")
    kinds = F.array_compact(F.array(kind, F.when(differ, "canonical_mismatch")))
    out = results.select("inspection_url", F.expr(CONFIDENCE).alias("confidence"), F.explode(kinds).alias("opportunity_type"))
    return out.withColumn("priority", F.when(F.col("opportunity_type") == "indexation_blocked", 90).when(F.col("opportunity_type") == "not_indexed", 82).otherwise(75))


INSPECTION_OPPS_SQL = f"""WITH {INSPECTED_CTE}, k AS (SELECT inspection_url, {CONFIDENCE} AS confidence, CASE WHEN {BLOCKED} THEN 'indexation_blocked' WHEN {UNINDEXED} THEN 'not_indexed' END AS opportunity_type FROM inspected
 UNION ALL SELECT inspection_url, {CONFIDENCE}, 'canonical_mismatch' FROM inspected WHERE google_canonical IS NOT NULL AND user_canonical IS NOT NULL AND rtrim(google_canonical, '/') <> rtrim(user_canonical, '/'))
SELECT *, CASE opportunity_type WHEN 'indexation_blocked' THEN 90 WHEN 'not_indexed' THEN 82 ELSE 75 END AS priority FROM k WHERE opportunity_type IS NOT NULL"""
