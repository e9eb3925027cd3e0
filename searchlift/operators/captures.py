"""Captures of a page by different readers: challenges instead of pages, rendering that is worth it, devices that differ."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchlift.sources.tables import PAGES_SQL

#: Texts of challenge pages, those of them that tell even under status 200, headers by provider, and the statuses of a challenge.
SIGNATURES = ("attention required! | cloudflare", "cf-chl-", "checking your browser", "cloudflare ray id", "incapsula incident id", "access denied | akamai", "request unsuccessful. incapsula", "datadome", "perimeterx", "px-captcha")
STRONG = ("cf-chl-", "checking your browser", "px-captcha", "request unsuccessful. incapsula")
PROVIDERS = {"cf-ray": "cloudflare", "x-sucuri-id": "sucuri", "x-iinfo": "imperva", "x-akamai-transformed": "akamai"}
CHALLENGED = (401, 403, 409, 429, 503)
#: Characters of a body that are searched.
SEARCHED = 250_000


def any_of(text: Column, marks: tuple[str, ...]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(m)) for m in marks])


def any_of_sql(text: str, marks: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{m}')" for m in marks) + ")"


def bot_blocks(answers: DataFrame) -> DataFrame:
    """Answers that are a challenge to automated readers, and whose.

    A status of refusal tells with a known text or header, status 200 with a strong text alone.
    Null bodies, headers and statuses tell nothing.
    """
    text = F.lower(F.substring(F.coalesce("body", F.lit("")), 1, SEARCHED))
    names = F.coalesce(F.transform(F.map_keys("headers"), F.lower), F.array().cast("array<string>"))
    provider = F.coalesce(*[F.when(F.array_contains(names, h), p) for h, p in PROVIDERS.items()])
    status = F.coalesce("status_code", F.lit(0))
    refused = status.isin(*CHALLENGED) & (any_of(text, SIGNATURES) | provider.isNotNull())
    found = answers.select("page_id", "status_code", (refused | ((status == 200) & any_of(text, STRONG))).alias("detected"), provider.alias("provider"))
    return found.withColumn("provider", F.when(F.col("detected"), F.coalesce("provider", F.lit("unknown"))))


BOT_BLOCKS_SQL = f"""WITH answers AS (SELECT page_id, CAST(CASE page_id % 10 WHEN 3 THEN 403 WHEN 6 THEN 429 ELSE 200 END AS INT) AS status_code, CASE page_id % 4 WHEN 1 THEN 'cloudflare' WHEN 2 THEN 'imperva' END AS provider,
 lower(substring(concat(CASE page_id % 6 WHEN 0 THEN '<title>Checking your browser</title>' WHEN 1 THEN '<p>Cloudflare Ray ID</p>' ELSE '' END, coalesce(html, '')), 1, {SEARCHED})) AS text FROM pages),
d AS (SELECT *, (status_code IN {CHALLENGED} AND ({any_of_sql('text', SIGNATURES)} OR provider IS NOT NULL)) OR (status_code = 200 AND {any_of_sql('text', STRONG)}) AS detected FROM answers)
SELECT page_id, status_code, detected, CASE WHEN detected THEN coalesce(provider, 'unknown') END AS provider FROM d"""


FIELDS = ("status_code", "title", "h1_count", "word_count", "n_links", "canonical", "description", "robots")


CAPTURES_CTE = f"""{PAGES_SQL},
sent AS (SELECT page_id, status_code, CASE WHEN page_id % 7 = 0 THEN '' ELSE title END AS title, CASE WHEN page_id % 8 = 0 THEN 0 ELSE h1_count END AS h1_count, word_count, len(links) AS n_links, canonical, description, robots FROM crawled),
seen AS (SELECT page_id, status_code, CASE WHEN page_id % 9 = 0 THEN '' ELSE title END AS title, h1_count, word_count + (page_id * 17) % 60 - 10 AS word_count, len(links) // (1 + page_id % 3) AS n_links, canonical, description, CASE WHEN page_id % 11 = 0 THEN 'noindex' ELSE robots END AS robots FROM crawled)"""

#: What rendering must bring (one of these), and what it must not lose (all of these); s is the page as sent, r as rendered.
GAINS = ("r.word_count >= greatest(s.word_count + 20, floor(s.word_count * 1.25))", "(s.title = '' AND r.title <> '')", "(s.h1_count = 0 AND r.h1_count > 0)")
KEEPS = ("r.word_count >= s.word_count", "(s.title = '' OR r.title <> '')", "(s.h1_count = 0 OR r.h1_count > 0)", "(s.canonical = '' OR r.canonical <> '')", "(s.n_links = 0 OR r.n_links >= greatest(1, floor(s.n_links / 2)))")
BETTER = f"({' OR '.join(GAINS)}) AND {' AND '.join(KEEPS)}"


def rendered_better(sent: DataFrame, rendered: DataFrame, key: str = "page_id") -> DataFrame:
    """Whether the rendered page holds materially more than the page as sent, and loses nothing; null texts count as empty, null numbers as 0."""
    texts = {c: "" for c in ("title", "canonical")} | {c: 0 for c in ("word_count", "h1_count", "n_links")}
    s, r = sent.fillna(texts).alias("s"), rendered.fillna(texts).alias("r")
    return s.join(r, F.col(f"s.{key}") == F.col(f"r.{key}")).select(F.col(f"s.{key}").alias(key), F.col("s.word_count").alias("sent_words"), F.col("r.word_count").alias("rendered_words"), F.expr(BETTER).alias("better"))


RENDERED_SQL = f"WITH {CAPTURES_CTE} SELECT s.page_id, s.word_count AS sent_words, CAST(r.word_count AS INT) AS rendered_words, {BETTER} AS better FROM sent s JOIN seen r USING (page_id)"


def device_changes(desktop: DataFrame, mobile: DataFrame, key: str = "page_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Per page that both devices captured: the fields that differ (null equals null), in their order."""
    d, m = desktop.alias("d"), mobile.alias("m")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"d.{f}").eqNullSafe(F.col(f"m.{f}")), F.lit(f)) for f in fields]))
    both = d.join(m, F.col(f"d.{key}") == F.col(f"m.{key}")).select(F.col(f"d.{key}").alias(key), changed.alias("c"))
    return both.select(key, F.array_join("c", ",").alias("changed"), (F.size("c") > 0).alias("different"))


DEVICES_SQL = f"""WITH {CAPTURES_CTE}, c AS (SELECT d.page_id, list_filter([{', '.join(f"CASE WHEN d.{f} IS DISTINCT FROM m.{f} THEN '{f}' END" for f in FIELDS)}], lambda x: x IS NOT NULL) AS c FROM sent d JOIN seen m USING (page_id))
SELECT page_id, coalesce(array_to_string(c, ','), '') AS changed, len(c) > 0 AS different FROM c"""
