"""The content run of all sites: shared tables once, every output under one version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchlift.operators import content, facts, governance
from searchlift.sources import samples, tables
from searchlift.sources.tables import EDGES_SQL, PAGES_SQL
from searchlift.sources.versions import TableSet

OUTPUTS = ("insights", "topics", "clusters", "recommendations", "graph", "actions", "summary")


def run(spark: SparkSession, sf_dir: str, root: str) -> TableSet:
    """Insights, topics, clusters, recommendations, graph, actions and a summary of each site, as one version of the tables under root.

    Pages are parsed once, their texts and topics written once and read by all that follow; an output that is made from
    others reads those that were written. A run that fails leaves the version before; of two runs at once one is refused.
    """
    out = TableSet(spark, root)
    new = out.begin()
    pages = tables.crawled_pages(spark, sf_dir)
    edges, texts = tables.link_edges(pages), content.page_texts(pages)
    topics = new.add("topics", content.topics(texts))
    new.add("clusters", content.clusters(topics))
    recommended = new.add("recommendations", content.recommendations(texts, edges))
    graph = new.add("graph", content.graph_edges(texts, topics, content.first_similar(content.texts_with_room(texts, topics), content.RELATED_UNTIL)))
    insights = new.add("insights", _insights(spark, sf_dir, pages, texts, topics))
    # A page without terms has no gain, and no action.
    actions = new.add("actions", governance.content_actions(insights.where("decay IS NOT NULL AND gain IS NOT NULL"), recommended))
    new.add("summary", _summary(pages, edges, insights, recommended, graph, actions))
    new.commit()
    return out


def _insights(spark: SparkSession, sf_dir: str, pages: DataFrame, texts: DataFrame, topics: DataFrame) -> DataFrame:
    """page_id, site, terms, gain, topics, and decay and freshness of the searched page of the same number (null where there is none)."""
    decay = content.decay(samples.with_ages(facts.period_change(tables.search_facts(spark, sf_dir))))
    numbered = decay.select(F.regexp_extract("page_url", "([0-9]+)$", 1).cast("long").alias("page_id"), "decay", "freshness")
    gain = content.information_gain(texts, tables.page_queries(spark, sf_dir)).select("page_id", "terms", "gain")
    n = topics.groupBy("page_id").agg(F.count("*").alias("topics"))
    return pages.select("page_id", "site").join(gain, "page_id", "left").join(n, "page_id", "left").join(numbered, "page_id", "left")


def _summary(pages: DataFrame, edges: DataFrame, insights: DataFrame, recommended: DataFrame, graph: DataFrame, actions: DataFrame) -> DataFrame:
    """Per site: pages, decaying and orphan pages, recommendations, edges of either kind, and actions."""
    linked = edges.select("site", F.col("dst").alias("path")).distinct()
    orphans = pages.where("path <> '/'").join(linked, ["site", "path"], "left_anti")
    # refresh:<page> and link:<source>:<target> both name a page second.
    page_of = F.element_at(F.split("action_key", ":"), 2).cast("long")
    acts = actions.select(page_of.alias("page_id")).join(pages.select("page_id", "site"), "page_id")
    count = lambda df, name: df.groupBy("site").agg(F.count("*").alias(name))
    out = count(pages, "pages")
    for df, name in ((insights.where("decay >= 50"), "decaying"), (orphans, "orphans"), (recommended, "links"), (graph.where("kind = 'covers'"), "covers"), (graph.where("kind = 'related'"), "related"), (acts, "actions")):
        out = out.join(count(df, name), "site", "left")
    return out.select("site", "pages", *[F.coalesce(c, F.lit(0)).alias(c) for c in out.columns[2:]])


SUMMARY_SQL = f"""WITH {PAGES_SQL}, {EDGES_SQL}, d AS ({content.decay_sql()}), r AS ({content.RECOMMEND_SQL}), g AS ({content.graph_sql(content.PAGE_TEXTS_SQL)}), a AS ({governance.CONTENT_ACTIONS_SQL}),
i AS (SELECT page_id, site, decay FROM crawled LEFT JOIN (SELECT CAST(regexp_extract(page_url, '([0-9]+)$', 1) AS BIGINT) AS page_id, decay FROM d) USING (page_id)),
o AS (SELECT site, page_id FROM crawled c WHERE path <> '/' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.site = c.site AND e.dst = c.path))
SELECT site, count(*) AS pages, (SELECT count(*) FROM i WHERE i.site = c.site AND decay >= 50) AS decaying, (SELECT count(*) FROM o WHERE o.site = c.site) AS orphans, (SELECT count(*) FROM r WHERE r.site = c.site) AS links,
 (SELECT count(*) FROM g WHERE g.site = c.site AND kind = 'covers') AS covers, (SELECT count(*) FROM g WHERE g.site = c.site AND kind = 'related') AS related,
 (SELECT count(*) FROM a JOIN i ON i.page_id = CAST(split_part(action_key, ':', 2) AS BIGINT) WHERE i.site = c.site) AS actions FROM crawled c GROUP BY site"""
