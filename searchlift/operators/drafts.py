"""Content briefs, the drafts that are scaffolded from them, and the checks that a draft must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from searchlift.functions.text import slug
from searchlift.operators.content import PAGE_TEXTS_SQL, RECOMMEND_SQL, topics_sql
from searchlift.sources.tables import WORD

#: The headings of a brief's outline after the title (%s stands for the query), and the questions.
HEADINGS = ("What to know about %s", "How to evaluate the right approach", "A practical workflow", "Common mistakes and edge cases")
QUESTIONS = ("What is %s?", "How should someone evaluate %s?", "What mistakes should be avoided?")
#: What a section is for, and what its writer is asked for.
PURPOSE, ASK, ANSWER = "Explain it with one concrete case and what follows from it.", "Add evidence of your own, and the decision that this section helps with.", "Answer in two to four sentences."
NOTE = "> Drafted from search evidence for **%s**. Check the claims and fill the placeholders before publishing."
#: Words that show information beyond the ordinary, and bounds of the checks.
MARKERS = ("example", "trade-off", "mistake", "workflow")
TITLE, DESCRIPTION, LEAST_WORDS, SUBMIT = (20, 60), (80, 160), 450, 50


def distinct_terms(values: Column, most: int = 20) -> Column:
    """Trimmed values, without empty ones and repeats, in order, the first twenty."""
    return F.slice(F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != "")), 1, most)


def briefs(pages: DataFrame, topics: DataFrame, links: DataFrame) -> DataFrame:
    """One brief per page: title, query (its first topic, else the title), topics, outline, questions and the best eight link targets of its site.

    topics: page_id, topic, rank. links: site, target_id, priority (recommendations).
    """
    of_page = topics.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "topic"))), lambda x: x.topic).alias("topics"))
    best = F.row_number().over(Window.partitionBy("site").orderBy(F.desc("priority"), "target_id"))
    targets = links.groupBy("site", "target_id").agg(F.max("priority").alias("priority")).withColumn("rank", best).where(F.col("rank") <= 8)
    targets = targets.join(pages.select(F.col("page_id").alias("target_id"), F.col("path").alias("target_path"), F.col("title").alias("target_title")), "target_id")
    of_site = targets.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("target_path").alias("path"), F.when(F.col("target_title") == "", F.col("target_path")).otherwise(F.col("target_title")).alias("anchor")))).alias("targets"))
    b = pages.select("page_id", "site", F.when(F.col("title") == "", F.col("path")).otherwise(F.col("title")).alias("title")).join(of_page, "page_id", "left").join(of_site, "site", "left")
    none = F.array().cast("array<string>")
    b = b.withColumn("topics", F.coalesce("topics", none)).withColumn("query", F.coalesce(F.get("topics", F.lit(0)), "title"))
    named = lambda texts: F.array(*[F.replace(F.lit(t), F.lit("%s"), F.col("query")) for t in texts])
    return b.select("page_id", "site", "title", "query", distinct_terms(F.concat("topics", F.array("query"))).alias("topics"), F.concat(F.array("title"), named(HEADINGS)).alias("outline"), named(QUESTIONS).alias("questions"), F.coalesce("targets", F.array().cast("array<struct<rank:int,path:string,anchor:string>>")).alias("targets"))


def scaffold() -> Column:
    """A brief's outline, link targets and questions as Markdown."""
    line = lambda *xs: F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs])
    head = line(F.concat(F.lit("# "), F.col("title")), "", F.replace(F.lit(NOTE), F.lit("%s"), F.col("query")), "")
    sections = F.flatten(F.transform(F.filter("outline", lambda h: (h != "") & (h != F.col("title"))), lambda h: line(F.concat(F.lit("## "), h), "", PURPOSE, "", ASK, "")))
    links = F.transform(F.slice("targets", 1, 5), lambda t: F.concat(F.lit("- ["), t.anchor, F.lit("]("), t.path, F.lit(")")))
    more = F.when(F.size("targets") > 0, F.concat(line("## Continue exploring", ""), links, line(""))).otherwise(F.array().cast("array<string>"))
    asked = F.concat(line("## Frequently asked questions", ""), F.transform("questions", lambda q: F.concat(F.lit("### "), q, F.lit(f"\n\n{ANSWER}"))), line(""))
    return F.array_join(F.concat(head, sections, more, asked), "\n")


def next_version(current: Column, is_new: Column, stored: Column) -> Column:
    """A draft's version after a save: one more where a stored draft has a new text, and 1 at least."""
    n = F.coalesce(current, F.lit(0))
    return F.greatest(F.lit(1), F.when(is_new & stored, n + 1).otherwise(n))


def drafts(found: DataFrame, written: DataFrame) -> DataFrame:
    """briefs -> drafts: the scaffold, or what an editor has written in its place (page_id, body), with title, slug and description."""
    d = found.join(written, "page_id", "left").withColumn("scaffold", scaffold())
    body = F.coalesce("body", "scaffold")
    new = F.col("body").isNotNull() & (F.col("body") != F.col("scaffold"))
    text = F.concat(F.lit("A practical, evidence-backed guide to "), F.col("query"), F.lit(". Learn the trade-offs, workflow, and next steps."))
    return d.select(
        "page_id", "title", "query", "outline", "targets", slug(F.col("title")).alias("slug"), F.substring("title", 1, 60).alias("meta_title"), F.substring(text, 1, 155).alias("meta_description"), body.alias("body"),
        F.regexp_count(body, F.lit(WORD)).cast("int").alias("word_count"), next_version(F.lit(1), new, F.lit(True)).alias("version"), F.when(F.col("body").isNull(), "scaffold").otherwise("manual").alias("mode"),
    )


def checks() -> dict[str, Column]:
    low = F.lower("body")
    covered = F.size(F.filter("outline", lambda h: F.contains(low, F.lower(h))))
    length = lambda c, bounds: F.length(c).between(*bounds)
    return {
        "title_length": length("meta_title", TITLE),
        "meta_description": length("meta_description", DESCRIPTION),
        "word_count": F.col("word_count") >= LEAST_WORDS,
        "outline_coverage": covered >= F.greatest(F.lit(1), F.floor(F.size("outline") / 2)),
        "information_gain": F.rlike(low, F.lit("|".join(MARKERS))),
        "internal_links": (F.size("targets") == 0) | F.exists("targets", lambda t: F.contains(F.col("body"), t.path)),
        "evidence_boundary": F.contains(low, F.lit("placeholder")) | F.col("has_evidence"),
    }


def quality(found: DataFrame) -> DataFrame:
    """drafts with has_evidence -> the checks passed by name, their share as a score, whether all passed, and whether the draft may be submitted."""
    named = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in checks().items()]), lambda x: x.isNotNull())
    q = found.select("page_id", "version", named.alias("ok"))
    score = F.bround(100 * F.size("ok") / len(checks()), 0).cast("int")
    return q.select("page_id", "version", F.array_join("ok", ",").alias("passed"), score.alias("score"), (F.size("ok") == len(checks())).alias("all_passed"), (score >= SUBMIT).alias("may_submit"))


def _named_sql(texts) -> str:
    return "[" + ", ".join(f"replace('{t}', '%s', query)" for t in texts) + "]"


BRIEFS_CTE = f"""{PAGE_TEXTS_SQL}, tp AS ({topics_sql(PAGE_TEXTS_SQL)}), rec AS ({RECOMMEND_SQL}),
ofp AS (SELECT page_id, list(topic ORDER BY rank) AS topics FROM tp GROUP BY page_id),
tg AS (SELECT site, target_id, max(priority) AS priority FROM rec GROUP BY site, target_id QUALIFY row_number() OVER (PARTITION BY site ORDER BY max(priority) DESC, target_id) <= 8),
ofs AS (SELECT tg.site, list({{'path': c.path, 'anchor': CASE WHEN c.title = '' THEN c.path ELSE c.title END}} ORDER BY tg.priority DESC, target_id) AS targets FROM tg JOIN crawled c ON c.page_id = target_id GROUP BY tg.site),
b0 AS (SELECT c.page_id, c.site, CASE WHEN c.title = '' THEN c.path ELSE c.title END AS title, coalesce(topics, []) AS topics, coalesce(targets, []) AS targets FROM crawled c LEFT JOIN ofp USING (page_id) LEFT JOIN ofs ON c.site = ofs.site),
b1 AS (SELECT *, coalesce(topics[1], title) AS query FROM b0),
briefs AS (SELECT page_id, site, title, query, CASE WHEN list_contains(topics, query) THEN topics ELSE list_append(topics, trim(query)) END AS topics, list_prepend(title, {_named_sql(HEADINGS)}) AS outline, {_named_sql(QUESTIONS)} AS questions, targets FROM b1)"""
BRIEFS_SQL = f"WITH {BRIEFS_CTE} SELECT page_id, site, title, query, array_to_string(topics, '|') AS topics, array_to_string(outline, '|') AS outline, array_to_string(questions, '|') AS questions, array_to_string(list_transform(targets, lambda t: t.path), '|') AS targets FROM briefs"
DRAFTS_CTE = f"""{BRIEFS_CTE}, sc AS (SELECT *, array_to_string(list_concat(['# ' || title, '', replace('{NOTE}', '%s', query), ''],
  flatten(list_transform(list_filter(outline, lambda h: h <> '' AND h <> title), lambda h: ['## ' || h, '', '{PURPOSE}', '', '{ASK}', ''])),
  CASE WHEN len(targets) > 0 THEN list_concat(['## Continue exploring', ''], list_transform(list_slice(targets, 1, 5), lambda t: '- [' || t.anchor || '](' || t.path || ')'), ['']) ELSE [] END,
  list_concat(['## Frequently asked questions', ''], list_transform(questions, lambda q: '### ' || q || chr(10) || chr(10) || '{ANSWER}'), [''])), chr(10)) AS scaffold FROM briefs),
dr AS (SELECT s.*, d.body IS NOT NULL AS manual, coalesce(d.body, scaffold) AS body FROM sc s LEFT JOIN (SELECT doc_id AS page_id, text AS body FROM documents WHERE doc_id % 2 = 1) d USING (page_id)),
drafts AS (SELECT *, substring(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 120) AS slug, substring(title, 1, 60) AS meta_title,
  substring(concat('A practical, evidence-backed guide to ', query, '. Learn the trade-offs, workflow, and next steps.'), 1, 155) AS meta_description, CAST(len(regexp_extract_all(body, '{WORD.replace("'", "''")}')) AS INT) AS word_count,
  CASE WHEN manual AND body <> scaffold THEN 2 ELSE 1 END AS version, CASE WHEN manual THEN 'manual' ELSE 'scaffold' END AS mode FROM dr)"""
DRAFTS_SQL = f"WITH {DRAFTS_CTE} SELECT page_id, slug, meta_title, meta_description, sha256(body) AS body_sha256, word_count, version, mode FROM drafts"
QUALITY_SQL = f"""WITH {DRAFTS_CTE}, ch AS (SELECT page_id, version, list_filter([
  CASE WHEN length(meta_title) BETWEEN {TITLE[0]} AND {TITLE[1]} THEN 'title_length' END, CASE WHEN length(meta_description) BETWEEN {DESCRIPTION[0]} AND {DESCRIPTION[1]} THEN 'meta_description' END, CASE WHEN word_count >= {LEAST_WORDS} THEN 'word_count' END,
  CASE WHEN len(list_filter(outline, lambda h: contains(lower(body), lower(h)))) >= greatest(1, len(outline) // 2) THEN 'outline_coverage' END, CASE WHEN regexp_matches(lower(body), '{"|".join(MARKERS)}') THEN 'information_gain' END,
  CASE WHEN len(targets) = 0 OR len(list_filter(targets, lambda t: contains(body, t.path))) > 0 THEN 'internal_links' END, CASE WHEN contains(lower(body), 'placeholder') OR page_id % 3 = 0 THEN 'evidence_boundary' END], lambda x: x IS NOT NULL) AS ok FROM drafts)
SELECT page_id, version, array_to_string(ok, ',') AS passed, CAST(round_even(100 * len(ok) / 7, 0) AS INT) AS score, len(ok) = 7 AS all_passed, round_even(100 * len(ok) / 7, 0) >= {SUBMIT} AS may_submit FROM ch"""
