"""Site reports over crawled pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from searchlift.functions import urls
from searchlift.sources.samples import MARKED_PATH_SQL, WOVEN_CTE
from searchlift.sources.tables import EDGES_SQL, JOBS_SQL, PAGES_SQL


def status_histogram(pages: DataFrame) -> DataFrame:
    n = pages.where("status_code IS NOT NULL").groupBy("site", "status_code").agg(F.count("*").alias("n"))
    return n.withColumn("percentage", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("site")), 1))


STATUS_SQL = f"WITH {PAGES_SQL} SELECT site, status_code, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY site), 1) AS percentage FROM crawled GROUP BY site, status_code"

#: The weights of the six trust signals.
SIGNALS = {"descriptions": 0.20, "titles": 0.20, "h1": 0.15, "structured": 0.15, "depth": 0.15, "https": 0.15}


def trust(pages: DataFrame) -> DataFrame:
    """Share of pages with each trust signal, and their weighted sum; https counts as given."""
    on = {"descriptions": "description <> ''", "titles": "title <> ''", "h1": "h1_count > 0", "structured": "json_ld_count > 0", "depth": "word_count >= 300"}
    pct = pages.groupBy("site").agg(*[F.bround(100.0 * F.count_if(F.expr(p)) / F.count("*"), 0).cast("int").alias(k) for k, p in on.items()], F.lit(100).alias("https"))
    total = sum((F.col(k) * w for k, w in SIGNALS.items()), F.lit(0.0))
    return pct.withColumn("score", F.bround(F.round(total, 6), 0).cast("int"))


TRUST_SQL = f"""WITH {PAGES_SQL}, p AS (SELECT site,
  CAST(round_even(100.0 * count(*) FILTER (description <> '') / count(*), 0) AS INT) AS descriptions, CAST(round_even(100.0 * count(*) FILTER (title <> '') / count(*), 0) AS INT) AS titles,
  CAST(round_even(100.0 * count(*) FILTER (h1_count > 0) / count(*), 0) AS INT) AS h1, CAST(round_even(100.0 * count(*) FILTER (json_ld_count > 0) / count(*), 0) AS INT) AS structured,
  CAST(round_even(100.0 * count(*) FILTER (word_count >= 300) / count(*), 0) AS INT) AS depth, 100 AS https FROM crawled GROUP BY site)
SELECT *, CAST(round_even(round(0.20::DOUBLE * descriptions + 0.20::DOUBLE * titles + 0.15::DOUBLE * h1 + 0.15::DOUBLE * structured + 0.15::DOUBLE * depth + 0.15::DOUBLE * https, 6), 0) AS INT) AS score FROM p"""


def in_links(edges: DataFrame) -> DataFrame:
    """The paths that link to a path, one row for each, beside their number; self-links count."""
    n = edges.groupBy("site", F.col("dst").alias("path")).agg(F.count("*").alias("n"))
    return edges.select("site", F.col("dst").alias("path"), F.col("src").alias("linked_from")).join(n, ["site", "path"])


IN_LINKS_SQL = f"WITH {PAGES_SQL}, {EDGES_SQL} SELECT site, dst AS path, src AS linked_from, count(*) OVER (PARTITION BY site, dst) AS n FROM edges"


def link_graph(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between crawled pages, by page id, without self edges."""
    ids = pages.groupBy("site", "path").agg(F.min("page_id").alias("id"))
    src, dst = ids.select("site", F.col("path").alias("src"), F.col("id").alias("src_id")), ids.select("site", F.col("path").alias("dst"), F.col("id").alias("dst_id"))
    return edges.where("src <> dst").join(src, ["site", "src"]).join(dst, ["site", "dst"]).select("site", "src_id", "dst_id")


LINK_GRAPH_SQL = f"""WITH {PAGES_SQL}, {EDGES_SQL}, ids AS (SELECT site, path, min(page_id) AS id FROM crawled GROUP BY ALL)
SELECT e.site, s.id AS src_id, d.id AS dst_id FROM edges e JOIN ids s ON e.site = s.site AND e.src = s.path JOIN ids d ON e.site = d.site AND e.dst = d.path WHERE src <> dst"""


WOVEN_GRAPH_SQL = f"""WITH {PAGES_SQL}, {WOVEN_CTE}, ids AS (SELECT site, path, min(page_id) AS id FROM woven GROUP BY ALL)
SELECT e.site, s.id AS src_id, d.id AS dst_id FROM edges e JOIN ids s ON e.site = s.site AND e.src = s.path JOIN ids d ON e.site = d.site AND e.dst = d.path WHERE src <> dst"""


def link_totals(pages: DataFrame, edges: DataFrame) -> DataFrame:
    out = edges.groupBy("site").agg(F.count("*").alias("links"))
    inn = edges.select("site", F.col("dst").alias("path")).distinct()
    orphans = pages.where("path <> '/'").join(inn, ["site", "path"], "left_anti").groupBy("site").agg(F.count("*").alias("orphans"))
    n = pages.groupBy("site").agg(F.count("*").alias("pages")).join(out, "site", "left").join(orphans, "site", "left")
    return n.select("site", "pages", F.coalesce("links", F.lit(0)).alias("links"), F.round(F.coalesce("links", F.lit(0)) / F.col("pages"), 2).alias("average"), F.coalesce("orphans", F.lit(0)).alias("orphans"))


LINK_TOTALS_SQL = f"""WITH {PAGES_SQL}, {EDGES_SQL}, p AS (SELECT site, count(*) AS pages FROM crawled GROUP BY site), l AS (SELECT site, count(*) AS links FROM edges GROUP BY site),
o AS (SELECT site, count(*) AS orphans FROM crawled c WHERE path <> '/' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.site = c.site AND e.dst = c.path) GROUP BY site)
SELECT site, pages, coalesce(links, 0) AS links, round(coalesce(links, 0) / pages, 2) AS average, coalesce(orphans, 0) AS orphans FROM p LEFT JOIN l USING (site) LEFT JOIN o USING (site)"""

#: Substrings of page paths that name a technology, in order of declaration.
TECH = (("nextjs", ("/_next/", "__next", "next/image", "__NEXT_DATA__")), ("nuxt", ("/_nuxt/", "__nuxt")), ("gatsby", ("/static/", "gatsby")), ("react", ("react", "__REACT")), ("wordpress", ("/wp-content/", "/wp-includes/", "/wp-json/", "wp-block")), ("shopify", ("cdn.shopify.com", "shopify")), ("wix", ("wix.com", "_wix")))


def tech_scores(pages: DataFrame, tech=TECH) -> DataFrame:
    """Per site and technology the hits of its signals in page paths; the best of a site by score, then by declaration."""
    hits = F.array(*[F.struct(F.lit(t).alias("tech"), F.lit(i).alias("place"), sum((F.contains("path", F.lit(s)).cast("int") for s in signals), F.lit(0)).alias("hits")) for i, (t, signals) in enumerate(tech)])
    s = pages.select("site", F.explode(hits).alias("h")).groupBy("site", "h.tech", "h.place").agg(F.sum("h.hits").alias("score"))
    best = F.row_number().over(Window.partitionBy("site").orderBy(F.desc("score"), "place")) == 1
    return s.select("site", "tech", "score", (best & (F.col("score") > 0)).alias("best"))


def tech_sql() -> str:
    each = " UNION ALL ".join(f"SELECT site, '{t}' AS tech, {i} AS place, {' + '.join(f"CAST(contains(path, '{s}') AS INT)" for s in signals)} AS hits FROM crawled" for i, (t, signals) in enumerate(TECH))
    return f"WITH {PAGES_SQL}, h AS ({each}), s AS (SELECT site, tech, place, sum(hits) AS score FROM h GROUP BY ALL) SELECT site, tech, CAST(score AS BIGINT) AS score, row_number() OVER (PARTITION BY site ORDER BY score DESC, place) = 1 AND score > 0 AS best FROM s"


#: Substrings of page paths that name a content system, in order of declaration; and how many signals are told of.
CMS = (("sanity", ("cdn.sanity.io", "sanity", "sanity.io")), ("wordpress", ("/wp-json/", "/wp-admin/", "/wp-content/", "/xmlrpc.php")), ("ghost", ("/ghost/api/", "ghost")), ("strapi", ("/api/", "strapi")))
TOLD = 10


def stacks(pages: DataFrame) -> DataFrame:
    """Per site its technology and content system by the signals in page paths, case aside (unknown and none without any), and the first ten technology signals that were found, with their pages.

    Hits are counted in one aggregation, a column for each signal, so that nothing of a site is gathered.
    """
    path = F.lower("path")
    names = [(kind, name, signal) for kind, declared in (("tech", TECH), ("cms", CMS)) for name, signals in declared for signal in signals]
    hits = [F.count_if(F.contains(path, F.lit(signal.lower()))).alias(f"h{i}") for i, (*_, signal) in enumerate(names)]
    n = pages.groupBy("site").agg(*hits)

    def best(kind: str, declared: tuple, otherwise: str):
        scores = [F.struct(sum((F.col(f"h{i}") for i, (k, name, _) in enumerate(names) if (k, name) == (kind, t)), F.lit(0)).alias("score"), F.lit(-j).alias("place"), F.lit(t).alias("name")) for j, (t, _) in enumerate(declared)]
        top = F.array_max(F.array(*scores))
        return F.when(top.score > 0, top["name"]).otherwise(otherwise).alias(kind)

    told = [F.when(F.col(f"h{i}") > 0, F.concat(F.lit(f"{signal} found in "), F.col(f"h{i}").cast("string"), F.lit(" pages"))) for i, (kind, _, signal) in enumerate(names) if kind == "tech"]
    signals = F.array_join(F.slice(F.array_compact(F.array(*told)), 1, TOLD), "|").alias("signals")
    return n.select("site", best("tech", TECH, "unknown"), best("cms", CMS, "none"), signals)


def stacks_sql() -> str:
    def scored(declared: tuple) -> str:
        return " UNION ALL ".join(f"SELECT '{name}' AS name, {j} AS place, '{signal}' AS signal, {i} AS k" for i, (j, name, signal) in enumerate((j, n, x) for j, (n, xs) in enumerate(declared) for x in xs))

    hits = lambda of: f"SELECT site, name, place, signal, k, count(*) FILTER (contains(lower(path), lower(signal))) AS n FROM marked CROSS JOIN ({of}) GROUP BY ALL"
    best = lambda of: f"SELECT site, name FROM (SELECT site, name, place, sum(n) AS score FROM {of} GROUP BY ALL) WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY site ORDER BY score DESC, place) = 1"
    return f"""WITH {PAGES_SQL}, marked AS (SELECT concat('site', page_id % 3) AS site, {MARKED_PATH_SQL} AS path FROM crawled), t AS ({hits(scored(TECH))}), c AS ({hits(scored(CMS))}), bt AS ({best('t')}), bc AS ({best('c')}),
g AS (SELECT site, string_agg(concat(signal, ' found in ', n, ' pages'), '|' ORDER BY k) AS signals FROM (SELECT * FROM t WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY site ORDER BY k) <= {TOLD}) GROUP BY site)
SELECT site, coalesce(bt.name, 'unknown') AS tech, coalesce(bc.name, 'none') AS cms, coalesce(signals, '') AS signals FROM (SELECT DISTINCT site FROM marked) LEFT JOIN bt USING (site) LEFT JOIN bc USING (site) LEFT JOIN g USING (site)"""


def site_counts(pages: DataFrame, findings: DataFrame) -> DataFrame:
    """Per site its pages and its findings that are open or have come back (site, status)."""
    open_ = findings.where(F.col("status").isin("open", "regressed")).groupBy("site").agg(F.count("*").alias("issues"))
    n = pages.groupBy("site").agg(F.count("*").alias("pages")).join(open_, "site", "left")
    return n.select("site", "pages", F.coalesce("issues", F.lit(0)).alias("issues"))


def pages_for_review(pages: DataFrame, each: int = 10) -> DataFrame:
    """Per site the home page first, then the answered pages with the most words."""
    w = Window.partitionBy("site").orderBy((F.col("path") != "/"), F.desc("word_count"), "page_id")
    return pages.where("status_code = 200").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= each).select("site", "page_id", "word_count", "rank")


REVIEW_SQL = f"WITH {PAGES_SQL} SELECT site, page_id, word_count, CAST(row_number() OVER (PARTITION BY site ORDER BY path <> '/', word_count DESC, page_id) AS INT) AS rank FROM crawled WHERE status_code = 200 QUALIFY rank <= 10"


#: Marks of a root that scripts fill. Characters of a page that are searched.
ROOT_MARKS = ('id="__next"', "id='__next'", 'id="root"', "id='root'", 'id="app"', "id='app'", "data-reactroot", "ng-version=")
SEARCHED = 500_000


def js_shells(pages: DataFrame) -> DataFrame:
    """Pages that need a browser: a warning, or a root marker with scripts and hardly any words."""
    html = F.lower(F.substring("html", 1, SEARCHED))
    warned = F.contains(html, F.lit("enable javascript")) | F.contains(html, F.lit("requires javascript"))
    root = F.greatest(*[F.contains(html, F.lit(m)) for m in ROOT_MARKS])
    scripts = F.regexp_count(html, F.lit(r"<script\b"))
    return pages.select("page_id", scripts.cast("long").alias("scripts"), (warned | (root & (scripts >= 1) & (F.col("word_count") < 80))).alias("needs_render"))


_ROOT_SQL = " OR ".join("contains(html, '" + m.replace("'", "''") + "')" for m in ROOT_MARKS)
JS_SHELL_SQL = rf"""WITH {PAGES_SQL}, h AS (SELECT page_id, lower(substring(html, 1, {SEARCHED})) AS html, word_count FROM pages JOIN crawled USING (page_id, url)), s AS (SELECT *, len(regexp_extract_all(html, '<script\b')) AS scripts FROM h)
SELECT page_id, scripts, contains(html, 'enable javascript') OR contains(html, 'requires javascript') OR (scripts >= 1 AND word_count < 80 AND ({_ROOT_SQL})) AS needs_render FROM s"""


def crawl_quality(jobs: DataFrame) -> DataFrame:
    """Counts per status with the total, and rates over at least 1."""
    g = jobs.groupBy("site_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("queued", "running", "completed")])
    return g.withColumn("success_rate", F.round(F.col("completed") / F.greatest("total", F.lit(1)), 4))


QUALITY_SQL = f"WITH {JOBS_SQL} SELECT site_id, count(*) AS total, count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'completed') AS completed, round(count(*) FILTER (status = 'completed') / greatest(count(*), 1), 4) AS success_rate FROM jobs GROUP BY site_id"


def status_totals(jobs: DataFrame) -> DataFrame:
    """Jobs per status, and in all, by one rollup."""
    return jobs.rollup("status").agg(F.count("*").alias("n"), F.sum("pages").alias("pages"))


STATUS_TOTALS_SQL = f"WITH {JOBS_SQL} SELECT status, count(*) AS n, CAST(sum(pages) AS BIGINT) AS pages FROM jobs GROUP BY ROLLUP (status)"


def page_of_rows(pages: DataFrame, number: int = 2, size: int = 25) -> DataFrame:
    """One page of a sorted listing, with a unique tie-break."""
    return pages.orderBy(F.desc("word_count"), "page_id").offset((number - 1) * size).limit(size).select("page_id", "url", "word_count")


PAGINATION_SQL = f"WITH {PAGES_SQL} SELECT page_id, url, word_count FROM crawled ORDER BY word_count DESC, page_id LIMIT 25 OFFSET 25"


def link_split(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, site, robots, links) -> the distinct pages of the site that a page links to, and how often it links elsewhere.

    What can't be spelled as a page of the site but is a web address counts as external, each time, files and
    mere fragments of the page itself too; a page
    whose robots say nofollow has neither. Links are resolved against the page's URL by expressions.
    """
    follow = ~F.contains(F.lower(F.coalesce("robots", F.lit(""))), F.lit("nofollow"))
    spelled = F.transform(F.coalesce("links", F.array().cast("array<string>")), lambda x: F.struct(urls.page_link(F.col("url"), x, F.col("site")).alias("page"), urls.external(F.col("url"), x).alias("web")))
    p = pages.select("page_id", F.when(follow, spelled).otherwise(F.array().cast("array<struct<page: string, web: boolean>>")).alias("s"))
    inside = F.array_sort(F.array_distinct(F.transform(F.filter("s", lambda x: x.page.isNotNull()), lambda x: x.page)))
    return p.select("page_id", inside.alias("internal"), F.size(F.filter("s", lambda x: x.page.isNull() & x.web)).alias("external"))


def link_split_rows(split: DataFrame) -> DataFrame:
    return split.select("page_id", F.size("internal").alias("internal"), "external", F.sha2(F.array_join("internal", "|"), 256).alias("internal_sha256"))


#: Pages as far as links and canonicals go: scheme and host, folder of the path, and the path.
_PLACES_CTE = r"places AS (SELECT page_id, url, lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) AS root, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '^(.*/)', 1) AS dir FROM pages)"
LINK_SPLIT_SQL = rf"""WITH {_PLACES_CTE}, l AS (SELECT page_id, page_id % 11 <> 3 AS follow, [concat(root, '/p/', page_id % 10, '?a=1&b=2'), concat(root, CASE WHEN dir IN ('', '/') THEN '/' ELSE regexp_replace(dir, '[^/]+/$', '') END, 'up/x'), concat('https://', regexp_extract(root, '//(.*)$', 1), '/P'), concat(root, CASE WHEN path = '' THEN '/' ELSE path END, '?page=2')] AS x FROM places)
SELECT page_id, CASE WHEN follow THEN CAST(len(list_distinct(x)) AS INT) ELSE 0 END AS internal, CASE WHEN follow THEN 6 ELSE 0 END AS external, sha256(CASE WHEN follow THEN array_to_string(list_sort(list_distinct(x)), '|') ELSE '' END) AS internal_sha256 FROM l"""


def canonicals(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, canonical) -> the canonical against the URL that the page was read from, and whether it is the page itself, another of its host, or elsewhere."""
    whole = F.when(F.trim("canonical") != "", urls.resolved(F.col("url"), F.col("canonical")))
    p = pages.select("page_id", "url", whole.alias("canonical"))
    kind = F.when(F.col("canonical").isNull(), "none").when(urls.page_url_key(F.col("canonical")) == urls.page_url_key(F.col("url")), "self").when(urls.host_key(F.col("canonical")) == urls.host_key(F.col("url")), "other_page").otherwise("external")
    return p.select("page_id", "canonical", kind.alias("kind"))


CANONICALS_SQL = rf"""WITH {_PLACES_CTE}, r AS (SELECT *, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS head, regexp_extract(url, '^([^#]*)', 1) AS bare FROM places)
SELECT page_id, CASE page_id % 6 WHEN 0 THEN bare WHEN 1 THEN concat(head, '/c/', page_id) WHEN 2 THEN concat(head, CASE WHEN dir IN ('', '/') THEN '/' ELSE regexp_replace(dir, '[^/]+/$', '') END, 'c') WHEN 3 THEN concat(regexp_extract(head, '^(https?:)', 1), '//other.example.org/c') WHEN 4 THEN concat(head, CASE WHEN path = '' THEN '/' ELSE path END, '?v=2') END AS canonical,
 CASE page_id % 6 WHEN 0 THEN 'self' WHEN 3 THEN 'external' WHEN 5 THEN 'none' ELSE 'other_page' END AS kind FROM r"""
