"""Content intelligence over crawled pages: terms, topics, entities, similar pages, link recommendations and scores.

A page's text is its path, title, first heading, description and further headings; the functions
take any texts, so whole documents run through the same code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from searchlift.functions.overlaps import overlaps
from searchlift.functions.text import bigrams, common_terms, common_topics, entities, tokens, tokens_sql
from searchlift.sources.staging import staged
from searchlift.sources.tables import EDGES_SQL, PAGES_SQL

#: Pages of a site that the first round of a bounded search looks at, and how much wider each next round is.
FIRST_ROUND, WIDER = 64, 8
#: Sources of links that are broadcast with their terms.
BROADCAST_SOURCES = 2_000
#: Bigrams and terms that may be topics of a page, and topics in all.
BIGRAMS, TERMS, TOPICS = 3, 6, 8


def page_texts(pages: DataFrame) -> DataFrame:
    """(page_id, site, path, text) of crawled pages."""
    return pages.select("page_id", "site", "path", F.concat_ws(" ", "path", "title", "h1", "description", "headings").alias("text"))


def page_names(pages: DataFrame) -> DataFrame:
    """(page_id, text): title and heading, where a page names things."""
    return pages.select("page_id", F.concat("title", F.lit(". "), "h1", F.lit(".")).alias("text"))


def whole_texts(documents: DataFrame) -> DataFrame:
    """(page_id, site, text) of whole documents."""
    return documents.select(F.col("doc_id").alias("page_id"), F.col("source").alias("site"), F.coalesce("text", F.lit("")).alias("text"))


PAGE_TEXTS_SQL = f"{PAGES_SQL}, texts AS (SELECT page_id, site, path, concat_ws(' ', path, title, h1, description) AS text FROM crawled)"
WHOLE_TEXTS_SQL = "texts AS (SELECT doc_id AS page_id, source AS site, coalesce(text, '') AS text FROM documents)"


def by_row(texts: DataFrame, row: Callable[[DataFrame], DataFrame], several: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """row(texts), as each id has one text; ids that have more, which the ids alone tell, are looked at by several(their texts)."""
    ids = texts.groupBy(F.col("page_id").alias("__id")).agg(F.count("*").alias("__n")).where("__n > 1").select("__id")
    ids = staged(ids, "repeated")
    if ids.isEmpty():
        return row(texts)
    same = texts["page_id"].eqNullSafe(ids["__id"])
    return row(texts.join(ids, same, "left_anti")).unionByName(several(texts.join(ids, same, "left_semi")))


def term_counts(texts: DataFrame, most: int = TERMS) -> DataFrame:
    """Per page its commonest terms; ties go to the one that comes first."""

    def several(some: DataFrame) -> DataFrame:
        t = some.select("page_id", F.posexplode(tokens(F.col("text"))).alias("pos", "term")).groupBy("page_id", "term").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
        w = Window.partitionBy("page_id").orderBy(F.desc("n"), "first")
        return t.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("page_id", "term", "n", "rank")

    def row(some: DataFrame) -> DataFrame:
        each = some.select("page_id", F.posexplode(common_terms(F.col("text"), most)).alias("pos", "t"))
        return each.select("page_id", "t.term", "t.n", (F.col("pos") + 1).alias("rank"))

    return by_row(texts, row, several)


def term_counts_sql(texts: str) -> str:
    return f"""WITH {texts}, t AS (SELECT page_id, {tokens_sql('text')} AS ts FROM texts), e AS (SELECT page_id, unnest(ts) AS term, generate_subscripts(ts, 1) AS pos FROM t),
g AS (SELECT page_id, term, count(*) AS n, min(pos) AS first FROM e GROUP BY ALL)
SELECT page_id, term, n, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n DESC, first) AS INT) AS rank FROM g QUALIFY rank <= 6"""


def topics(texts: DataFrame) -> DataFrame:
    """Per page up to three bigrams and six terms, in that order, distinct; eight in all."""

    def several(some: DataFrame) -> DataFrame:
        two = some.select("page_id", F.posexplode(bigrams(tokens(F.col("text")))).alias("pos", "topic")).groupBy("page_id", "topic").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
        w = Window.partitionBy("page_id").orderBy(F.desc("n"), "first")
        two = two.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= BIGRAMS).select("page_id", "topic", "rank")
        one = term_counts(some).select("page_id", F.col("term").alias("topic"), (F.col("rank") + BIGRAMS).alias("rank"))
        return two.unionByName(one).withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy("rank"))).where(F.col("rank") <= TOPICS)

    def row(some: DataFrame) -> DataFrame:
        each = some.select("page_id", F.posexplode(F.slice(common_topics(F.col("text"), BIGRAMS, TERMS), 1, TOPICS)).alias("pos", "topic"))
        return each.select("page_id", "topic", (F.col("pos") + 1).alias("rank"))

    return by_row(texts, row, several)


def topics_sql(texts: str) -> str:
    return f"""WITH {texts}, t AS (SELECT page_id, {tokens_sql('text')} AS ts FROM texts), e AS (SELECT page_id, unnest(ts) AS term, generate_subscripts(ts, 1) AS pos FROM t),
g1 AS (SELECT page_id, term, count(*) AS n, min(pos) AS first FROM e GROUP BY ALL), one AS (SELECT page_id, term AS topic, 3 + row_number() OVER (PARTITION BY page_id ORDER BY n DESC, first) AS rank FROM g1 QUALIFY rank <= 9),
b AS (SELECT page_id, term AS a, lead(term) OVER (PARTITION BY page_id ORDER BY pos) AS b, pos FROM e), g2 AS (SELECT page_id, concat(a, ' ', b) AS topic, count(*) AS n, min(pos) AS first FROM b WHERE b IS NOT NULL AND a <> b GROUP BY ALL),
two AS (SELECT page_id, topic, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, first) AS rank FROM g2 QUALIFY rank <= 3)
SELECT page_id, topic, CAST(row_number() OVER (PARTITION BY page_id ORDER BY rank) AS INT) AS rank FROM (FROM two UNION ALL FROM one) QUALIFY rank <= 8"""


def terms_and_topics(pages: DataFrame) -> DataFrame:
    """page_id, site, orphan, terms and topics, both in a page's own row."""

    def several(some: DataFrame) -> DataFrame:
        named = topics(some).groupBy("page_id").agg(F.collect_list("topic").alias("topics"))
        each = some.select("page_id", "site", "orphan", F.array_distinct(tokens(F.col("text"))).alias("terms"))
        return each.join(named, "page_id", "left").withColumn("topics", F.coalesce("topics", F.array().cast("array<string>")))

    def row(some: DataFrame) -> DataFrame:
        return some.select("page_id", "site", "orphan", F.array_distinct(tokens(F.col("text"))).alias("terms"), F.slice(common_topics(F.col("text"), BIGRAMS, TERMS), 1, TOPICS).alias("topics"))

    return by_row(pages, row, several)


def page_entities(texts: DataFrame) -> DataFrame:
    return texts.select("page_id", F.posexplode(entities(F.col("text"))).alias("pos", "entity")).select("page_id", "entity", (F.col("pos") + 1).alias("rank"))


ENTITIES_SQL = rf"""WITH {PAGES_SQL}, e AS (SELECT page_id, regexp_extract_all(regexp_replace(concat(title, '. ', h1, '.'), '[^\x00-\x7F\p{{P}}\p{{S}}\p{{Z}}]', '_', 'g'), '\b[A-Z][A-Za-z0-9-]*(?:\s+[A-Z][A-Za-z0-9-]*){{0,2}}\b') AS es FROM crawled), x AS (SELECT page_id, unnest(es) AS entity, generate_subscripts(es, 1) AS pos FROM e),
f AS (SELECT page_id, entity, min(pos) AS pos FROM x WHERE length(entity) >= 3 GROUP BY ALL)
SELECT page_id, entity, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) AS INT) AS rank FROM f QUALIFY rank <= 8"""


def terms(texts: DataFrame) -> DataFrame:
    return texts.select("page_id", "site", F.array_distinct(tokens(F.col("text"))).alias("terms")).withColumn("size", F.size("terms"))


def page_classes(texts: DataFrame) -> DataFrame:
    """(page_id, class_id): pages of a site with the same set of terms are one class, named by its smallest page; pages without terms have none."""
    t = terms(texts).where("size > 0").select("site", "page_id", F.array_sort("terms").alias("terms"))
    named = t.groupBy("site", "terms").agg(F.min("page_id").alias("class_id"))
    return t.join(named, ["site", "terms"]).select("page_id", "class_id")


def class_terms(texts: DataFrame) -> DataFrame:
    """site, page_id (the class), size, terms and pages: each set of terms once."""
    t = terms(texts).where("size > 0").withColumn("terms", F.array_sort("terms"))
    return t.groupBy("site", "terms", "size").agg(F.min("page_id").alias("page_id"), F.count("*").alias("pages"))


def similar_pages(texts: DataFrame, shared: int = 2, least: float = 0.18) -> DataFrame:
    """Pairs of classes of a site's pages with shared terms and Jaccard similarity.

    Pages with the same terms are one class (see page_classes), so a template's pages make no pairs
    of their own. A site's classes meet in pairs of blocks (functions.overlaps): most pages of a language share some
    of their terms, so pairs that meet by a term are nearly all of them and are counted, not shuffled.
    """
    met = overlaps(staged(class_terms(texts).select("site", "page_id", "terms"), "classes"), shared, least)
    alike = met.where((F.col("shared") >= shared) & (F.col("shared") >= least * F.col("either")))
    return alike.select("page_id", "other_id", "shared", F.round(F.col("shared") / F.col("either"), 4).alias("similarity"))


def _prefixes(texts: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Classes with their terms, and the terms of their prefixes with their places."""
    t = class_terms(texts)
    df = t.select("site", F.explode("terms").alias("term")).groupBy("site", "term").agg(F.count("*").alias("df"))
    ranked = t.select("site", "page_id", "size", F.explode("terms").alias("term")).join(df, ["site", "term"])
    w = Window.partitionBy("site", "page_id").orderBy("df", "term")
    return t, ranked.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= F.col("size") - F.ceil(F.col("size") * least) + 1).select("site", "term", "page_id", "size", "pos")


def _similar(t: DataFrame, prefix: DataFrame, lefts: DataFrame, shared: int, least: float) -> DataFrame:
    """The pairs of similar_pages whose smaller page is among lefts, by an equi-join on the terms of prefixes.

    Prefix filter: sorted by how rare a term is on the site, two classes that are
    similar enough share one of their first size - ceil(least * size) + 1 terms, so frequent terms join nothing;
    and where they meet first, what is left of either after that place must still reach the least they have to share.
    """
    left = prefix.join(lefts.select("page_id"), "page_id", "left_semi")
    other = prefix.select("site", "term", F.col("page_id").alias("other_id"), F.col("size").alias("other_size"), F.col("pos").alias("other_pos"))
    # Positional filter: at the first shared term the two share at most one and what follows in the shorter rest.
    met = left.join(other, ["site", "term"]).where(f"page_id < other_id AND least(size, other_size) >= {least} * greatest(size, other_size)")
    first = met.groupBy("page_id", "other_id").agg(F.min(F.struct("pos", "other_pos")).alias("at"), F.first("size").alias("size"), F.first("other_size").alias("other_size"))
    pairs = first.where(f"(1 + {least}) * (1 + least(size - at.pos, other_size - at.other_pos)) >= {least} * (size + other_size) - 1e-6").select("page_id", "other_id")
    both = pairs.join(t.select("page_id", F.col("terms").alias("a")), "page_id").join(t.select(F.col("page_id").alias("other_id"), F.col("terms").alias("b")), "other_id")
    sized = both.withColumns({"shared": F.size(F.array_intersect("a", "b")), "either": F.size(F.array_union("a", "b"))})
    return sized.where((F.col("shared") >= shared) & (F.col("shared") >= least * F.col("either"))).select("page_id", "other_id", F.col("shared").cast("long").alias("shared"), F.round(F.col("shared") / F.col("either"), 4).alias("similarity"))


def first_similar(texts: DataFrame, most: int, shared: int = 2, least: float = 0.18, first: int = FIRST_ROUND) -> DataFrame:
    """Of similar_pages the first `most` of each site, in order of ids: later pages are not looked at once a site has them."""
    t, prefix = _prefixes(texts, least)
    t, prefix = staged(t, "classes"), staged(prefix, "prefixes")
    sites = t.select("page_id", "site")

    def look(lefts: DataFrame) -> DataFrame:
        return _similar(t, prefix, lefts, shared, least).join(sites, "page_id").select("site", "page_id", "other_id", "shared", "similarity")

    def keep(pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy("page_id", "other_id"))).where(F.col("place") <= most).drop("place")

    return in_rounds(sites, look, keep, F.lit(True), most, first)


def neighbours(texts: DataFrame, most: int = 12) -> DataFrame:
    """For each class of pages how many others are similar to it (exactly), and the nearest of them: by similarity, then id."""
    pairs = similar_pages(texts)
    either = pairs.unionByName(pairs.select(F.col("other_id").alias("page_id"), F.col("page_id").alias("other_id"), "shared", "similarity"))
    n = either.groupBy("page_id").agg(F.count("*").alias("similar"))
    near = either.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("similarity"), "other_id"))).where(F.col("rank") <= most)
    return near.join(n, "page_id").select("page_id", "other_id", "similarity", "rank", "similar")


def neighbours_sql(texts: str) -> str:
    return f"""WITH {similar_cte(texts)}, either AS (SELECT page_id, other_id, similarity FROM similar_pages UNION ALL SELECT other_id, page_id, similarity FROM similar_pages)
SELECT page_id, other_id, similarity, CAST(row_number() OVER (PARTITION BY page_id ORDER BY similarity DESC, other_id) AS INT) AS rank, count(*) OVER (PARTITION BY page_id) AS similar FROM either QUALIFY rank <= 12"""


def classes_cte(texts: str) -> str:
    return f"""{texts}, sets AS (SELECT page_id, site, list_sort(list_distinct({tokens_sql('text')})) AS ts FROM texts), t AS (SELECT site, ts, min(page_id) AS page_id FROM sets WHERE len(ts) > 0 GROUP BY site, ts)"""


def classes_sql(texts: str) -> str:
    return f"WITH {classes_cte(texts)} SELECT sets.page_id, t.page_id AS class_id FROM sets JOIN t ON sets.site IS NOT DISTINCT FROM t.site AND sets.ts = t.ts"


def similar_cte(texts: str) -> str:
    return f"""{classes_cte(texts)}, e AS (SELECT page_id, site, unnest(ts) AS term, len(ts) AS size FROM t),
p AS (SELECT a.page_id, b.page_id AS other_id, count(*) AS shared, any_value(a.size) + any_value(b.size) - count(*) AS either FROM e a JOIN e b ON a.site = b.site AND a.term = b.term AND a.page_id < b.page_id GROUP BY ALL),
similar_pages AS (SELECT page_id, other_id, shared, round(shared / either, 4) AS similarity FROM p WHERE shared >= 2 AND shared >= 0.18::DOUBLE * either)"""


def similar_sql(texts: str) -> str:
    return f"WITH {similar_cte(texts)} SELECT * FROM similar_pages"


def clusters(page_topics: DataFrame, most: int = 50, members: int = 25) -> DataFrame:
    """Topics of two pages and more, the largest first."""
    each = page_topics.where("page_id IS NOT NULL").select("topic", "page_id").distinct()
    best = each.groupBy("topic").agg(F.count("*").alias("n")).where("n >= 2").orderBy(F.desc("n"), "topic").limit(most)
    # The smallest ids are picked before they are gathered, already where they are read.
    first = each.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy("page_id"))).where(F.col("rank") <= members)
    named = first.join(F.broadcast(best), "topic").groupBy("topic", "n").agg(F.array_join(F.array_sort(F.collect_list("page_id")).cast("array<string>"), ",").alias("members"))
    return named.orderBy(F.desc("n"), "topic")


def clusters_sql(texts: str) -> str:
    return f"WITH topics AS ({topics_sql(texts)}) SELECT topic, count(DISTINCT page_id) AS n, array_to_string(list_slice(list_sort(list(DISTINCT page_id)), 1, 25), ',') AS members FROM topics GROUP BY topic HAVING count(DISTINCT page_id) >= 2 ORDER BY n DESC, topic LIMIT 50"


def in_rounds(pages: DataFrame, look: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame], DataFrame], enough: Column, most: int, first: int = FIRST_ROUND) -> DataFrame:
    """The best of each site, looked for from its smallest pages on until no later page can change them.

    pages: (site, page_id), the pages a pair may begin with. look(some of them) gives their pairs with
    `site`, keep cuts pairs to the best of each site, and a site is settled once `most` of its
    kept pairs are `enough`: pairs that none of a later page may pass. Each round looks at the next
    pages of the sites that are open, eight times as many as the one before, so a site without enough pairs is looked at
    whole, and one whose pages are alike after a number of pairs that grows with its pages, not their square.
    """
    best, low, high, open_ = None, 0, first, None
    while True:
        # Only the smallest pages of a site are ranked: the limit prunes them where they are read.
        ranked = pages if open_ is None else pages.join(open_, ["site"], "left_semi")
        ranked = ranked.withColumn("__rank", F.row_number().over(Window.partitionBy("site").orderBy("page_id"))).where(F.col("__rank") <= high + 1)
        found = look(ranked.where((F.col("__rank") > low) & (F.col("__rank") <= high)).select("site", "page_id"))
        best = staged(keep(found if best is None else best.unionByName(found)), "best")
        more = ranked.where(F.col("__rank") == high + 1).select("site")
        settled = best.where(enough).groupBy("site").count().where(F.col("count") >= most).select("site")
        open_ = staged(more.join(settled, ["site"], "left_anti"), "open")
        if open_.isEmpty():
            return best
        low, high = high, high * WIDER


def recommendations(pages: DataFrame, edges: DataFrame, most: int = 100, first: int = FIRST_ROUND) -> DataFrame:
    """Links to a site's orphans (pages but the home page that nothing links to) from its pages that share two terms or a topic with them.

    pages: page_id, site, path, title and text. Per site the best by priority, confidence, source and target.
    Candidates come from joins on terms and topics of the orphans with the sources of a round (in_rounds), which are broadcast
    while they are few: once a site has enough links of full priority and confidence, those of later sources all rank behind them.
    """
    linked = edges.select("site", F.col("dst").alias("path")).distinct().withColumn("linked", F.lit(True))
    every = staged(terms_and_topics(pages.join(linked, ["site", "path"], "left").withColumn("orphan", F.col("linked").isNull() & (F.col("path") != "/"))), "terms-and-topics")
    t = every.where(F.size("terms") > 0)

    def by_term(some: DataFrame, name: str) -> DataFrame:
        slim = some.select("site", F.col("page_id").alias(f"{name}_id"), F.size("terms").alias(f"{name}_size"), "terms", "topics")
        one = slim.select("site", f"{name}_id", f"{name}_size", F.explode("terms").alias("by"), F.lit(1).alias("term"), F.lit(0).alias("topic"))
        return one.unionByName(slim.select("site", f"{name}_id", f"{name}_size", F.explode("topics").alias("by"), F.lit(0).alias("term"), F.lit(1).alias("topic")))

    def look(sources: DataFrame) -> DataFrame:
        some, targets = staged(sources.select("page_id"), "sources"), by_term(t.where("orphan"), "target")
        if some.count() <= BROADCAST_SOURCES:
            # The terms of a round's sources are broadcast, so that pairs are counted where the orphans are read and terms are not shuffled.
            mine = by_term(t.join(F.broadcast(some), "page_id", "left_semi"), "source")
            named = staged(mine.groupBy("site", "by", "term", "topic").agg(F.collect_list(F.struct("source_id", "source_size")).alias("sources")), "round")
            met = targets.join(F.broadcast(named), ["site", "by", "term", "topic"]).select("site", "target_id", "target_size", "term", "topic", F.inline("sources"))
        else:
            met = targets.join(by_term(t.join(some, "page_id", "left_semi"), "source"), ["site", "by", "term", "topic"])
        pairs = met.where("source_id <> target_id").groupBy("site", "source_id", "target_id").agg(F.sum("term").alias("shared"), F.sum("topic").alias("topics"), F.first("source_size").alias("source_size"), F.first("target_size").alias("target_size"))
        pairs = pairs.where("shared >= 2 OR topics > 0")
        sim = F.col("shared") / (F.col("source_size") + F.col("target_size") - F.col("shared"))
        score = F.least(F.lit(100), 55 + 7 * F.col("shared") + 8 * F.col("topics") + F.bround(20 * sim, 0)).cast("int")
        sure = F.least(F.lit(100), 50 + 8 * F.col("shared") + F.bround(30 * sim, 0)).cast("int")
        # Nothing links to an orphan, so no pair is linked already.
        return pairs.select("site", "source_id", "target_id", "shared", "topics", F.round(sim, 4).alias("similarity"), score.alias("priority"), sure.alias("confidence"))

    def keep(scored: DataFrame) -> DataFrame:
        best = Window.partitionBy("site").orderBy(F.desc("priority"), F.desc("confidence"), "source_id", "target_id")
        return scored.drop("rank").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)

    sites = every.where("orphan").select("site").distinct()
    sources = t.select("site", "page_id").join(sites, ["site"], "left_semi")
    return in_rounds(sources, lambda s: look(s).withColumn("rank", F.lit(0)), keep, F.expr("priority = 100 AND confidence = 100"), most, first)


RECOMMEND_SQL = f"""WITH {PAGE_TEXTS_SQL}, {EDGES_SQL}, topics AS ({topics_sql(PAGE_TEXTS_SQL)}), e AS (SELECT page_id, site, unnest(list_distinct({tokens_sql('text')})) AS term FROM texts), n AS (SELECT page_id, count(*) AS size FROM e GROUP BY page_id),
o AS (SELECT page_id, site, path FROM crawled c WHERE path <> '/' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.site = c.site AND e.dst = c.path)),
s AS (SELECT c.site, c.page_id AS source_id, o.page_id AS target_id FROM crawled c JOIN o ON c.site = o.site AND c.page_id <> o.page_id WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.site = c.site AND e.src = c.path AND e.dst = o.path)),
p AS (SELECT s.*, (SELECT count(*) FROM e a JOIN e b ON a.term = b.term WHERE a.page_id = source_id AND b.page_id = target_id) AS shared, (SELECT count(*) FROM topics a JOIN topics b ON a.topic = b.topic WHERE a.page_id = source_id AND b.page_id = target_id) AS topics FROM s),
q AS (SELECT p.*, shared / (a.size + b.size - shared) AS sim FROM p JOIN n a ON a.page_id = source_id JOIN n b ON b.page_id = target_id WHERE shared >= 2 OR topics > 0),
r AS (SELECT site, source_id, target_id, shared, topics, round(sim, 4) AS similarity, CAST(least(100, 55 + 7 * shared + 8 * topics + round_even(20 * sim, 0)) AS INT) AS priority, CAST(least(100, 50 + 8 * shared + round_even(30 * sim, 0)) AS INT) AS confidence FROM q)
SELECT *, CAST(row_number() OVER (PARTITION BY site ORDER BY priority DESC, confidence DESC, source_id, target_id) AS INT) AS rank FROM r QUALIFY rank <= 100"""


def query_terms(queries: DataFrame) -> DataFrame:
    """(page_id, term): the terms of the queries that one page alone is found by."""
    t = queries.select("page_id", F.explode(tokens(F.col("query"))).alias("term")).distinct()
    return t.groupBy("term").agg(F.count("*").alias("pages"), F.min("page_id").alias("page_id")).where("pages = 1").select("page_id", "term")


def information_gain(texts: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """70 points for the share of a page's terms that occur once in it (forty of them at most), 30 for eight query terms that it alone is found by."""
    t = texts.select("page_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("page_id", "term").count().groupBy("page_id").agg(F.count("*").alias("terms"), F.least(F.count_if(F.col("count") == 1), F.lit(40)).alias("once"))
    if queries is None:
        own = t.withColumn("own_queries", F.lit(0).cast("long"))
    else:
        n = query_terms(queries).groupBy("page_id").agg(F.least(F.count("*"), F.lit(30)).alias("own_queries"))
        own = t.join(n, "page_id", "left").withColumn("own_queries", F.coalesce("own_queries", F.lit(0)))
    points = 70.0 * F.col("once") / F.col("terms") + 30.0 * F.least(F.lit(1.0), F.col("own_queries") / 8)
    return own.withColumn("gain", F.least(F.lit(100), F.bround(points, 0)).cast("int"))


def gain_sql(texts: str, queries: str = "") -> str:
    own = f"{queries}, qt AS (SELECT DISTINCT page_id, unnest({tokens_sql('query')}) AS term FROM page_queries), o AS (SELECT min(page_id) AS page_id FROM qt GROUP BY term HAVING count(*) = 1), own AS (SELECT page_id, least(count(*), 30) AS own_queries FROM o GROUP BY page_id)" if queries else "own AS (SELECT 0::BIGINT AS page_id, 0::BIGINT AS own_queries WHERE false)"
    return f"""WITH {texts}, {own}, e AS (SELECT page_id, unnest({tokens_sql('text')}) AS term FROM texts), g AS (SELECT page_id, term, count(*) AS n FROM e GROUP BY ALL), s AS (SELECT page_id, count(*) AS terms, least(count(*) FILTER (n = 1), 40) AS once FROM g GROUP BY page_id)
SELECT page_id, terms, once, coalesce(own_queries, 0) AS own_queries, CAST(least(100, round_even(70.0::DOUBLE * once / terms + 30.0::DOUBLE * least(1.0::DOUBLE, coalesce(own_queries, 0) / 8), 0)) AS INT) AS gain FROM s LEFT JOIN own USING (page_id)"""


def decay(change: DataFrame) -> DataFrame:
    """Decay and freshness of pages from their change between periods and their age (age_days; unknown counts as new)."""
    clicks = F.when((F.col("prev_impressions") >= 30) & (F.col("clicks_delta") <= -0.3), F.least(F.lit(60), F.bround(100 * F.abs("clicks_delta"), 0))).otherwise(0)
    imp = F.when((F.col("prev_impressions") >= 30) & (F.col("impressions_delta") <= -0.25), F.least(F.lit(40), F.bround(100 * F.abs("impressions_delta"), 0))).otherwise(0)
    old = F.when(F.col("age_days") >= 365, F.least(F.lit(25), F.floor((F.col("age_days") - 365) / 90) + 10)).otherwise(0)
    d = change.withColumn("age_days", F.coalesce("age_days", F.lit(0)))
    return d.select("page_url", "age_days", F.greatest(F.lit(0), 100 - F.least(F.lit(100), F.bround(F.col("age_days") / 3, 0))).cast("int").alias("freshness"), F.least(F.lit(100), clicks + imp + old).cast("int").alias("decay"))


def decay_sql() -> str:
    from searchlift.operators.facts import CHANGE_SQL

    return f"""WITH c AS ({CHANGE_SQL}), a AS (SELECT *, (CAST(regexp_extract(page_url, '([0-9]+)$', 1) AS INT) * 37) % 900 AS age_days FROM c)
SELECT page_url, CAST(age_days AS INT) AS age_days, CAST(greatest(0, 100 - least(100, round_even(age_days / 3, 0))) AS INT) AS freshness,
 CAST(least(100, CASE WHEN prev_impressions >= 30 AND clicks_delta <= -0.3::DOUBLE THEN least(60, round_even(100 * abs(clicks_delta), 0)) ELSE 0 END
  + CASE WHEN prev_impressions >= 30 AND impressions_delta <= -0.25::DOUBLE THEN least(40, round_even(100 * abs(impressions_delta), 0)) ELSE 0 END
  + CASE WHEN age_days >= 365 THEN least(25, floor((age_days - 365) / 90) + 10) ELSE 0 END) AS INT) AS decay FROM a"""


#: Topics that a page is linked to, edges of a site from which on no related pages are added, and edges of a site.
COVERED, RELATED_UNTIL, EDGES = 6, 500, 1500


def texts_with_room(texts: DataFrame, page_topics: DataFrame) -> DataFrame:
    """Texts of the sites whose graph takes related pages: those with fewer than 500 edges to topics, so with few pages that have terms."""
    taken = page_topics.where(F.col("rank") <= COVERED).join(texts.select("page_id", "site"), "page_id").groupBy("site").count()
    full = staged(taken.where(F.col("count") >= RELATED_UNTIL).select("site"), "full")
    # full has one row for each site. Staged, as a filter on terms would else be pushed to the texts of all sites.
    return staged(texts.join(F.broadcast(full), ["site"], "left_anti"), "with-room")


def graph_edges(texts: DataFrame, page_topics: DataFrame, similar: DataFrame) -> DataFrame:
    """Edges of each site's semantic graph (site, kind, source, target, weight): pages to their topics in order of page and rank, then similar pages in order of ids.

    A site's topics count first: similar pages are added while it has fewer than 500 edges, and 1,500 edges stay.
    """
    sites = texts.select("page_id", "site")
    covers = page_topics.where(F.col("rank") <= COVERED).join(sites, "page_id")
    order = Window.partitionBy("site").orderBy("page_id", "rank")
    first = covers.withColumn("place", F.row_number().over(order)).where(F.col("place") <= EDGES).select("site", F.lit("covers").alias("kind"), F.col("page_id").cast("string").alias("source"), F.col("topic").alias("target"), F.lit(1.0).alias("weight"))
    # Ranked by their ids alone, so that the first five hundred of a site are picked where the pairs are made.
    pairs = similar.select("page_id", "other_id", "similarity").join(sites, "page_id").withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy("page_id", "other_id"))).where(F.col("place") <= RELATED_UNTIL)
    taken = covers.groupBy("site").agg(F.count("*").alias("taken"))
    room = pairs.join(taken, pairs["site"].eqNullSafe(taken["site"]), "left").where(F.col("place") <= RELATED_UNTIL - F.coalesce("taken", F.lit(0)))
    related = room.select(pairs["site"], F.lit("related").alias("kind"), F.col("page_id").cast("string").alias("source"), F.col("other_id").cast("string").alias("target"), F.round("similarity", 3).alias("weight"))
    return first.unionByName(related)


def graph_sql(texts: str) -> str:
    return f"""WITH {texts}, topics AS ({topics_sql(texts)}), sim AS ({similar_sql(texts)}), c AS (SELECT site, page_id, topic, rank, row_number() OVER (PARTITION BY site ORDER BY page_id, rank) AS place, count(*) OVER (PARTITION BY site) AS taken FROM topics JOIN texts USING (page_id) WHERE rank <= {COVERED}),
n AS (SELECT DISTINCT site, taken FROM c), r AS (SELECT site, page_id, other_id, similarity, row_number() OVER (PARTITION BY site ORDER BY page_id, other_id) AS place FROM sim JOIN texts USING (page_id))
SELECT site, 'covers' AS kind, CAST(page_id AS VARCHAR) AS source, topic AS target, CAST(1 AS DOUBLE) AS weight FROM c WHERE place <= {EDGES}
UNION ALL SELECT r.site, 'related', CAST(page_id AS VARCHAR), CAST(other_id AS VARCHAR), round(similarity, 3) FROM r LEFT JOIN n ON r.site IS NOT DISTINCT FROM n.site WHERE place <= {RELATED_UNTIL} - coalesce(taken, 0)"""
