"""Page and cross-page findings: one rule table, one pass over the pages.

A rule is a predicate in SQL both engines read, so the table gives the DataFrame's array of
structs and the SQL statement of the query alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from searchlift.sources.tables import EDGES_SQL, PAGES_SQL


@dataclass(frozen=True)
class Rule:
    kind: str
    predicate: str
    severity: str
    impact: int
    confidence: int
    effort: int
    action: str
    risk: int


OK = "status_code = 200"
#: Thresholds, severities and scores of the technical findings.
RULES = (
    Rule("missing_title", f"{OK} AND trim(title) = ''", "critical", 95, 100, 15, "metadata_update", 10),
    Rule("title_too_long", "length(trim(title)) > 60", "medium", 55, 99, 15, "metadata_update", 10),
    Rule("title_too_short", "trim(title) <> '' AND length(trim(title)) < 20", "low", 30, 95, 15, "metadata_update", 10),
    Rule("missing_meta_description", f"{OK} AND trim(description) = ''", "high", 75, 100, 20, "metadata_update", 10),
    Rule("meta_description_too_long", "length(trim(description)) > 160", "low", 35, 99, 15, "metadata_update", 10),
    Rule("missing_h1", f"{OK} AND h1_count = 0", "high", 70, 99, 25, "content_refresh_draft", 20),
    Rule("multiple_h1", f"{OK} AND h1_count > 1", "medium", 45, 99, 25, "content_refresh_draft", 20),
    Rule("noindex_directive", f"{OK} AND lower(robots) LIKE '%noindex%'", "critical", 95, 100, 20, "indexability_update", 75),
    Rule("missing_canonical", f"{OK} AND trim(canonical) = ''", "medium", 55, 100, 20, "canonical_update", 40),
    Rule("missing_viewport", f"{OK} AND trim(viewport) = ''", "high", 70, 100, 10, "metadata_update", 15),
    Rule("internal_404", "status_code = 404", "high", 80, 100, 40, "redirect_update", 45),
    Rule("redirect_chain", "redirects > 1", "medium", 50, 100, 30, "redirect_update", 45),
    Rule("orphan_page", f"{OK} AND path <> '/' AND in_links = 0", "medium", 60, 90, 30, "internal_link_add", 20),
    Rule("missing_homepage_structured_data", f"{OK} AND path = '/' AND json_ld_count = 0", "low", 35, 95, 30, "schema_add", 15),
    Rule("images_missing_alt", f"{OK} AND images_without_alt > 0", "medium", 45, 100, 30, "content_refresh_draft", 15),
    Rule("thin_content", f"{OK} AND word_count < 200", "medium", 55, 85, 65, "content_refresh_draft", 20),
    Rule("slow_initial_response", "response_time_ms > 3000", "high", 70, 80, 70, "recommendation", 35),
)
#: The older agent's checks have thresholds of their own.
LEGACY_RULES = tuple(
    Rule(kind, predicate, severity, 0, 0, 0, "", 0)
    for kind, predicate, severity in (
        ("missing_title", "trim(title) = ''", "critical"),
        ("title_too_long", "length(title) > 60", "medium"),
        ("title_too_short", "title <> '' AND length(title) < 20", "low"),
        ("missing_description", "trim(description) = ''", "high"),
        ("description_too_long", "length(description) > 160", "low"),
        ("missing_h1", f"{OK} AND trim(h1) = ''", "high"),
        ("thin_content", f"{OK} AND word_count < 300", "high"),
        ("very_slow", "response_time_ms > 3000", "high"),
        ("slow", "response_time_ms > 1500 AND response_time_ms <= 3000", "medium"),
        ("broken_404", "status_code = 404", "high"),
    )
)
#: The path of a canonical, absolute or relative.
CANONICAL_PATH = "(CASE WHEN canonical LIKE '%://%' THEN regexp_extract(canonical, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) ELSE regexp_extract(canonical, '^([^?#]*)', 1) END)"
#: Checks of a connector's export.
EXPORT_RULES = tuple(
    Rule(kind, predicate, severity, 0, 0, 0, "", 0)
    for kind, predicate, severity in (
        ("title_missing", "title = ''", "critical"),
        ("title_long", "length(title) > 60", "medium"),
        ("title_short", "title <> '' AND length(title) < 30", "medium"),
        ("description_missing", "description = ''", "high"),
        ("description_long", "length(description) > 160", "medium"),
        ("description_short", "description <> '' AND length(description) < 70", "medium"),
        ("h1_missing", "h1 = ''", "high"),
        ("thin", "word_count > 0 AND word_count < 300", "medium"),
        ("canonical_elsewhere", f"canonical <> '' AND canonical <> url AND {CANONICAL_PATH} <> regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1)", "medium"),
        ("images_without_alt", "images_empty_alt > 0", "medium"),
        ("orphan", "in_links = 0", "medium"),
        ("slow", "response_time_ms > 3000", "high"),
        ("client_error", "status_code >= 400 AND status_code < 500", "critical"),
        ("server_error", "status_code >= 500 AND status_code < 600", "critical"),
        ("uppercase_path", "path <> lower(path)", "low"),
    )
)
HOST = "lower(regexp_extract({}, '^[a-zA-Z]+://([^/?#:]+)', 1))"
#: The one-page audit's codes; weights by severity below.
AUDIT_RULES = tuple(
    Rule(kind, predicate, severity, 0, 0, 0, "", 0)
    for kind, predicate, severity in (
        ("http_5xx", "status_code >= 500", "critical"),
        ("http_4xx", "status_code >= 400 AND status_code < 500", "critical"),
        ("http_redirect", "status_code >= 300 AND status_code < 400", "high"),
        ("non_html", "content_type NOT LIKE '%text/html%' AND content_type NOT LIKE '%application/xhtml+xml%'", "high"),
        ("https_missing", "lower(url) NOT LIKE 'https://%'", "high"),
        ("title_missing", "title = ''", "high"),
        ("title_length", "title <> '' AND (length(title) < 30 OR length(title) > 65)", "low"),
        ("description_missing", "description = ''", "medium"),
        ("description_length", "description <> '' AND (length(description) < 100 OR length(description) > 170)", "low"),
        ("h1_missing", "h1_count = 0", "medium"),
        ("h1_multiple", "h1_count > 1", "low"),
        ("canonical_missing", "canonical = ''", "medium"),
        ("canonical_external", f"canonical LIKE '%://%' AND {HOST.format('canonical')} <> {HOST.format('url')}", "high"),
        ("noindex", "lower(robots) LIKE '%noindex%'", "critical"),
        ("viewport_missing", "viewport = ''", "low"),
        ("lang_missing", "lang = ''", "low"),
        ("structured_data_missing", "json_ld_count = 0", "low"),
        ("og_title_missing", "NOT og_title", "low"),
        ("robots_txt_missing", "coalesce(robots_status, 599) >= 400", "low"),
        ("sitemap_missing", "coalesce(sitemap_status, 599) >= 400", "medium"),
        ("slow_response", "response_time_ms > 3000", "medium"),
        ("response_time", "response_time_ms > 1500 AND response_time_ms <= 3000", "low"),
    )
)
AUDIT_WEIGHTS = {"critical": 25, "high": 15, "medium": 8, "low": 3}
HEALTH_WEIGHTS = {"critical": 15, "high": 8, "medium": 3, "low": 1}


def with_in_links(pages: DataFrame, edges: DataFrame) -> DataFrame:
    counts = edges.groupBy("site", F.col("dst").alias("path")).agg(F.countDistinct("src").cast("int").alias("in_links"))
    return pages.join(counts, ["site", "path"], "left").withColumn("in_links", F.coalesce("in_links", F.lit(0)))


LINKED_CTE = f"""{PAGES_SQL}, {EDGES_SQL},
linked AS (SELECT c.*, coalesce(n, 0) AS in_links FROM crawled c LEFT JOIN (SELECT site, dst, CAST(count(DISTINCT src) AS INT) AS n FROM edges GROUP BY ALL) e ON c.site = e.site AND c.path = e.dst)"""


def matched(pages: DataFrame, rules: tuple[Rule, ...], *keep: str) -> DataFrame:
    """One row for each page and rule that holds, in one pass: an array of what holds is exploded."""
    hit = F.array(*[F.when(F.expr(r.predicate), F.struct(F.lit(r.kind).alias("finding_type"), F.lit(r.severity).alias("severity"), F.lit(r.impact).alias("impact"), F.lit(r.confidence).alias("confidence"), F.lit(r.effort).alias("effort"), F.lit(r.action).alias("action_type"), F.lit(r.risk).alias("risk"))) for r in rules])
    return pages.select(*keep, F.explode(F.filter(hit, lambda x: x.isNotNull())).alias("f")).select(*keep, "f.*")


def matched_sql(rules: tuple[Rule, ...], keep: str) -> str:
    return " UNION ALL ".join(f"SELECT {keep}, '{r.kind}' AS finding_type, '{r.severity}' AS severity, {r.impact} AS impact, {r.confidence} AS confidence, {r.effort} AS effort, '{r.action}' AS action_type, {r.risk} AS risk FROM linked WHERE {r.predicate}" for r in rules)


def fingerprint(kind: Column, identity: Column, urls: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit("first-party-v1"), kind, F.coalesce(identity, F.lit("")), F.array_join(F.array_sort(urls), "|")), 256)


def page_findings(pages: DataFrame) -> DataFrame:
    """pages with in_links -> findings with their fingerprint."""
    found = matched(pages, RULES, "page_id", "url", "site", "path")
    return found.withColumn("fingerprint", fingerprint(F.col("finding_type"), F.col("path"), F.array("url")))


FINDINGS_CTE = f"{LINKED_CTE}, findings AS (SELECT *, sha256(concat('first-party-v1|', finding_type, '|', path, '|', url)) AS fingerprint FROM ({matched_sql(RULES, 'page_id, url, site, path')}))"
PAGE_FINDINGS_SQL = f"WITH {FINDINGS_CTE} SELECT * FROM findings"


def rule_hits(pages: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    return matched(pages, rules, "page_id").select("page_id", "finding_type", "severity")


def rule_hits_sql(rules: tuple[Rule, ...]) -> str:
    return f"WITH {LINKED_CTE} SELECT page_id, finding_type, severity FROM ({matched_sql(rules, 'page_id')})"


def duplicates(pages: DataFrame, column: str, kind: str) -> DataFrame:
    """Answered pages of a site that share a text with others, case aside: one row for each, with the size of its group."""
    key = F.lower(F.trim(F.col(column)))
    p = pages.where((F.col("status_code") == 200) & (key != "")).select("site", key.alias("value"), "url")
    g = p.groupBy("site", "value").agg(F.count("*").alias("n")).where("n >= 2")
    return p.join(g, ["site", "value"]).select("site", F.lit(kind).alias("finding_type"), "value", "n", "url", F.least(F.lit(80), 15 + 5 * F.col("n")).cast("int").alias("effort"))


def duplicates_sql(column: str, kind: str, source: str = "crawled") -> str:
    return f"""WITH {PAGES_SQL}
SELECT site, '{kind}' AS finding_type, lower(trim({column})) AS value, count(*) OVER g AS n, url, CAST(least(80, 15 + 5 * count(*) OVER g) AS INT) AS effort
FROM {source} WHERE status_code = 200 AND trim({column}) <> '' WINDOW g AS (PARTITION BY site, lower(trim({column}))) QUALIFY count(*) OVER g >= 2"""


def export_duplicates(pages: DataFrame) -> DataFrame:
    """The export's findings across pages: texts of a site that are equal to the letter, with the first path and the number of pages."""
    texts = F.explode(F.array(*[F.struct(F.lit(k).alias("finding_type"), F.col(c).alias("value")) for c, k in (("title", "duplicate_title"), ("description", "duplicate_description"))])).alias("t")
    p = pages.select("site", "page_id", "path", texts).where("t.value <> ''")
    g = p.groupBy("site", "t.finding_type", "t.value").agg(F.count("*").alias("pages"), F.min(F.struct("page_id", "path")).alias("first")).where("pages > 1")
    return g.select("site", "finding_type", "value", "pages", F.col("first.path").alias("path"), F.lit("high").alias("severity"))


EXPORT_DUPLICATES_SQL = f"""WITH {PAGES_SQL}, t AS (SELECT site, page_id, path, 'duplicate_title' AS finding_type, title AS value FROM crawled UNION ALL SELECT site, page_id, path, 'duplicate_description', description FROM crawled)
SELECT site, finding_type, value, count(*) AS pages, arg_min(path, page_id) AS path, 'high' AS severity FROM t WHERE value <> '' GROUP BY site, finding_type, value HAVING count(*) > 1"""


def legacy_duplicates(pages: DataFrame) -> DataFrame:
    """The older agent's finding across pages: titles of answered pages, case aside; the first path of each group stands as its title."""
    g = pages.where("title <> '' AND status_code = 200").groupBy("site", F.lower("title").alias("value")).agg(F.count("*").alias("pages"), F.min(F.struct("page_id", "path")).alias("first")).where("pages > 1")
    return g.select("site", F.lit("duplicate_title").alias("finding_type"), F.col("first.path").alias("title"), "pages", F.lit("high").alias("severity"))


LEGACY_DUPLICATES_SQL = f"WITH {PAGES_SQL} SELECT site, 'duplicate_title' AS finding_type, arg_min(path, page_id) AS title, count(*) AS pages, 'high' AS severity FROM crawled WHERE title <> '' AND status_code = 200 GROUP BY site, lower(title) HAVING count(*) > 1"


def legacy_summary(pages: DataFrame) -> DataFrame:
    """One line for each site: how many pages and issues, and the issues by severity."""
    page_hits = matched(pages, LEGACY_RULES, "site").select("site", "severity")
    n = page_hits.unionByName(legacy_duplicates(pages).select("site", "severity")).groupBy("site").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in HEALTH_WEIGHTS], F.count("*").alias("issues"))
    parts = F.concat_ws(", ", *[F.when(F.col(s) > 0, F.concat(F.col(s).cast("string"), F.lit(f" {s}"))) for s in HEALTH_WEIGHTS])
    both = pages.groupBy("site").agg(F.count("*").alias("pages")).join(n, "site", "left")
    text = F.concat(F.lit("Analyzed "), F.col("pages").cast("string"), F.lit(" pages. Found "), F.coalesce("issues", F.lit(0)).cast("string"), F.lit(" issues: "), F.coalesce(parts, F.lit("")), F.lit("."))
    return both.select("site", "pages", F.coalesce("issues", F.lit(0)).alias("issues"), text.alias("summary"))


def legacy_summary_sql() -> str:
    parts = ", ".join(f"CASE WHEN {s} > 0 THEN concat({s}, ' {s}') END" for s in HEALTH_WEIGHTS)
    return f"""WITH {LINKED_CTE}, h AS ({matched_sql(LEGACY_RULES, 'site')}), d AS ({LEGACY_DUPLICATES_SQL}), every AS (SELECT site, severity FROM h UNION ALL SELECT site, severity FROM d),
n AS (SELECT site, {', '.join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in HEALTH_WEIGHTS)}, count(*) AS issues FROM every GROUP BY site), p AS (SELECT site, count(*) AS pages FROM crawled GROUP BY site)
SELECT site, pages, coalesce(issues, 0) AS issues, concat('Analyzed ', pages, ' pages. Found ', coalesce(issues, 0), ' issues: ', concat_ws(', ', {parts}), '.') AS summary FROM p LEFT JOIN n USING (site)"""


def weight(weights: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("severity"))


def weight_sql(weights: dict[str, int]) -> str:
    return f"CASE severity {' '.join(f"WHEN '{k}' THEN {v}" for k, v in weights.items())} END"


def audit_scores(pages: DataFrame) -> DataFrame:
    """Per page 100 less the weights of what the one-page audit finds, and the findings by name."""
    hits = matched(pages, AUDIT_RULES, "page_id").groupBy("page_id").agg(F.sum(weight(AUDIT_WEIGHTS)).alias("w"), F.count("*").alias("issues"), F.array_join(F.array_sort(F.collect_list("finding_type")), ",").alias("codes"))
    out = pages.select("page_id").join(hits, "page_id", "left")
    return out.select("page_id", F.greatest(F.lit(0), 100 - F.coalesce("w", F.lit(0))).cast("int").alias("score"), F.coalesce("issues", F.lit(0)).alias("issues"), F.coalesce("codes", F.lit("")).alias("codes"))


AUDIT_SQL = f"""WITH {LINKED_CTE}, hits AS ({matched_sql(AUDIT_RULES, 'page_id')})
SELECT c.page_id, CAST(greatest(0, 100 - coalesce(sum({weight_sql(AUDIT_WEIGHTS)}), 0)) AS INT) AS score, count(finding_type) AS issues, coalesce(array_to_string(list_sort(list(finding_type) FILTER (finding_type IS NOT NULL)), ','), '') AS codes
FROM crawled c LEFT JOIN hits USING (page_id) GROUP BY c.page_id"""


def health(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Per site: 100 less the weighted findings per page, floored at 0, with a grade."""
    w = found.groupBy("site").agg(F.sum(weight(HEALTH_WEIGHTS)).alias("w"), F.count("*").alias("findings"))
    s = pages.groupBy("site").agg(F.count("*").alias("pages")).join(w, "site", "left")
    score = F.greatest(F.lit(0), 100 - F.coalesce("w", F.lit(0))).cast("int")
    return s.select("site", "pages", F.coalesce("findings", F.lit(0)).alias("findings"), score.alias("score"), grade(score).alias("grade"))


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 40, "D").otherwise("F")


HEALTH_SQL = f"""WITH {FINDINGS_CTE}, w AS (SELECT site, sum({weight_sql(HEALTH_WEIGHTS)}) AS w, count(*) AS findings FROM findings GROUP BY site),
s AS (SELECT site, count(*) AS pages FROM crawled GROUP BY site), t AS (SELECT site, pages, coalesce(findings, 0) AS findings, CAST(greatest(0, 100 - coalesce(w, 0)) AS INT) AS score FROM s LEFT JOIN w USING (site))
SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade FROM t"""


def counts(found: DataFrame) -> DataFrame:
    """By severity, by type, and in all: one pass of grouping sets."""
    return found.groupingSets([["severity"], ["finding_type"], []], "severity", "finding_type").agg(F.count("*").alias("n"))


COUNTS_SQL = f"WITH {FINDINGS_CTE} SELECT severity, finding_type, count(*) AS n FROM findings GROUP BY GROUPING SETS ((severity), (finding_type), ())"


def summary(found: DataFrame, each: int = 5) -> DataFrame:
    """Per severity the first few findings and how many more there are.

    The rank is cut where the findings are read, and the counts are four rows, so no task holds a severity's findings.
    """
    by_rank = F.row_number().over(Window.partitionBy("severity").orderBy(F.desc("impact"), "fingerprint"))
    first = found.withColumn("rank", by_rank).where(F.col("rank") <= each)
    return first.join(F.broadcast(found.groupBy("severity").agg(F.count("*").alias("n"))), "severity").select("severity", "finding_type", "url", "rank", F.greatest(F.lit(0), F.col("n") - each).alias("more"))


SUMMARY_SQL = f"""WITH {FINDINGS_CTE} SELECT severity, finding_type, url, CAST(row_number() OVER (PARTITION BY severity ORDER BY impact DESC, fingerprint) AS INT) AS rank,
  greatest(0, count(*) OVER (PARTITION BY severity) - 5) AS more FROM findings QUALIFY rank <= 5"""
