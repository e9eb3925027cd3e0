"""Citations in AI answers: who is named, what is cited, and where the brand is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from searchlift.functions.urls import citation_url
from searchlift.sources.samples import BRAND, COMPETITORS

#: Priority and confidence of a gap.
GAPS = {"brand_mention_gap": (85, 82), "citation_gap": (70, 78), "competitor_gap": (76, 70)}
EXCERPT = 2000


def named(answer: Column, words: tuple[str, ...]) -> Column:
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(answer), F.lower(w)))


def cited(urls: Column) -> Column:
    """The distinct normalised URLs of an array, in order; a host alone has the path /."""
    normal = lambda u: F.regexp_replace(citation_url(F.trim(u)), r"^(https?://[^/?]+)(?=\?|$)", "$1/")
    return F.array_distinct(F.array_compact(F.transform(F.coalesce(urls, F.array().cast("array<string>")), normal)))


def prompt_hash(prompt: Column) -> Column:
    return F.sha2(F.lower(F.trim(prompt)), 256)


def with_prompts(turns: DataFrame) -> DataFrame:
    """The assistant's turns with the user's turn before, which they answer; empty where there is none."""
    asked = turns.where("role = 'user'").groupBy("conv_id", (F.col("turn") + 1).alias("turn")).agg(F.min("text").alias("prompt"))
    return turns.where("role = 'assistant'").join(asked, ["conv_id", "turn"], "left").withColumn("prompt", F.coalesce("prompt", F.lit("")))


def analysed(answers: DataFrame, brand=BRAND, competitors=COMPETITORS) -> DataFrame:
    """conv_id, turn, provider, prompt, text, cited_urls -> who is named, what is cited, and the gap.

    The gap is competitor_gap where a competitor is named and the brand is not, then
    brand_mention_gap, then citation_gap where nothing is cited; none otherwise.
    """
    text = F.coalesce("text", F.lit(""))
    a = answers.select("conv_id", "turn", F.lower(F.trim("provider")).alias("provider"), prompt_hash(F.col("prompt")).alias("prompt_hash"), text.alias("text"), cited(F.col("cited_urls")).alias("urls"))
    a = a.withColumns({"brand_mentioned": F.size(named(F.col("text"), brand)) > 0, "rivals": named(F.col("text"), competitors)})
    gap = F.when(~F.col("brand_mentioned") & (F.size("rivals") > 0), "competitor_gap").when(~F.col("brand_mentioned"), "brand_mention_gap").when(F.size("urls") == 0, "citation_gap").otherwise("none")
    return a.select("conv_id", "turn", "provider", "prompt_hash", "brand_mentioned", F.array_join("rivals", ",").alias("competitors"), F.array_join("urls", " ").alias("cited_urls"), F.size("urls").alias("citations"), gap.alias("gap"), F.substring(F.trim("text"), 1, EXCERPT).alias("excerpt"))


def _named_sql(words) -> str:
    return f"list_filter([{', '.join(f"'{w}'" for w in words)}], lambda w: contains(lower(text), w))"


ANALYSED_CTE = f"""asked AS (SELECT conv_id, turn + 1 AS turn, min(text) AS prompt FROM conversations WHERE role = 'user' GROUP BY ALL),
a AS (SELECT c.conv_id, c.turn, CASE WHEN c.turn % 2 = 0 THEN 'chatgpt' ELSE 'perplexity' END AS provider, sha256(lower(trim(coalesce(prompt, '')))) AS prompt_hash, coalesce(c.text, '') AS text, CASE WHEN (c.conv_id + c.turn) % 3 = 2 THEN concat('https://example.com/p', c.turn) ELSE '' END AS cited_urls
 FROM conversations c LEFT JOIN asked q ON c.conv_id = q.conv_id AND c.turn = q.turn WHERE c.role = 'assistant'),
b AS (SELECT *, len({_named_sql(BRAND)}) > 0 AS brand_mentioned, {_named_sql(COMPETITORS)} AS rivals FROM a),
analysed AS (SELECT conv_id, turn, provider, prompt_hash, brand_mentioned, array_to_string(rivals, ',') AS competitors, cited_urls, CAST(cited_urls <> '' AS INT) AS citations,
 CASE WHEN NOT brand_mentioned AND len(rivals) > 0 THEN 'competitor_gap' WHEN NOT brand_mentioned THEN 'brand_mention_gap' WHEN cited_urls = '' THEN 'citation_gap' ELSE 'none' END AS gap, substring(trim(text), 1, {EXCERPT}) AS excerpt FROM b),
results AS (SELECT * FROM analysed QUALIFY row_number() OVER (PARTITION BY conv_id, provider, prompt_hash ORDER BY turn DESC) = 1)"""
ANALYSED_SQL = f"WITH {ANALYSED_CTE} SELECT * FROM analysed"


def results(found: DataFrame) -> DataFrame:
    """One result for each scan (a conversation), provider and prompt: the newest answer takes the place of older ones."""
    newest = F.row_number().over(Window.partitionBy("conv_id", "provider", "prompt_hash").orderBy(F.desc("turn")))
    return found.withColumn("rank", newest).where("rank = 1").drop("rank")


RESULTS_SQL = f"WITH {ANALYSED_CTE} SELECT * FROM results"


def scan_totals(found: DataFrame) -> DataFrame:
    """Per scan the mention and citation rates, and the visibility: 70 points for the one, 30 for the other."""
    rate = lambda c, name: F.round(F.avg(c.cast("int")), 4).alias(name)
    g = found.groupBy("conv_id").agg(F.count("*").alias("answers"), rate(F.col("brand_mentioned"), "mention_rate"), rate(F.col("citations") > 0, "citation_rate"))
    points = F.round(70 * F.col("mention_rate") + 30 * F.col("citation_rate"), 6)
    return g.withColumn("visibility", F.least(F.lit(100), F.bround(points, 0)).cast("int"))


SCAN_SQL = f"""WITH {ANALYSED_CTE}, g AS (SELECT conv_id, count(*) AS answers, round(avg(CAST(brand_mentioned AS INT)), 4) AS mention_rate, round(avg(CAST(citations > 0 AS INT)), 4) AS citation_rate FROM results GROUP BY conv_id)
SELECT *, CAST(least(100, round_even(round(70 * mention_rate + 30 * citation_rate, 6), 0)) AS INT) AS visibility FROM g"""


def competitor_counts(found: DataFrame, competitors=COMPETITORS) -> DataFrame:
    """Answers per competitor; those never named count 0."""
    spark = found.sparkSession
    every = spark.createDataFrame([(c,) for c in competitors], "competitor string")
    n = found.where("competitors <> ''").select(F.explode(F.split("competitors", ",")).alias("competitor")).groupBy("competitor").agg(F.count("*").alias("answers"))
    return every.join(n, "competitor", "left").select("competitor", F.coalesce("answers", F.lit(0)).alias("answers"))


COMPETITORS_SQL = f"WITH {ANALYSED_CTE}, n AS (SELECT unnest(string_split(competitors, ',')) AS competitor FROM results WHERE competitors <> ''), e AS (SELECT unnest([{', '.join(f"'{c}'" for c in COMPETITORS)}]) AS competitor) SELECT e.competitor, count(n.competitor) AS answers FROM e LEFT JOIN n ON e.competitor = n.competitor GROUP BY 1"


def gaps(found: DataFrame) -> DataFrame:
    """The gaps that results show, one for each gap, prompt and first competitor, with priority and confidence."""
    pick = lambda i: F.element_at(F.create_map(*[x for k, v in GAPS.items() for x in (F.lit(k), F.lit(v[i]))]), F.col("gap"))
    rival = F.regexp_extract("competitors", "^([^,]*)", 1)
    key = F.sha2(F.concat_ws("|", "gap", "prompt_hash", rival), 256)
    g = found.where("gap <> 'none'").groupBy("gap", "prompt_hash", rival.alias("competitor"), key.alias("gap_key")).agg(F.count("*").alias("results"), F.max("conv_id").alias("last_scan"))
    return g.select("gap_key", "gap", "competitor", "results", "last_scan", pick(0).alias("priority"), pick(1).alias("confidence"))


def _gap_sql(i: int) -> str:
    return f"CASE gap {' '.join(f"WHEN '{k}' THEN {v[i]}" for k, v in GAPS.items())} END"


GAPS_CTE = f"""{ANALYSED_CTE}, keyed AS (SELECT gap, conv_id, regexp_extract(competitors, '^([^,]*)', 1) AS competitor, sha256(concat(gap, '|', prompt_hash, '|', regexp_extract(competitors, '^([^,]*)', 1))) AS gap_key FROM results WHERE gap <> 'none'),
gaps AS (SELECT gap_key, gap, competitor, count(*) AS results, max(conv_id) AS last_scan, {_gap_sql(0)} AS priority, {_gap_sql(1)} AS confidence FROM keyed GROUP BY gap_key, gap, competitor)"""
GAPS_SQL = f"WITH {GAPS_CTE} SELECT * FROM gaps"


def gap_actions(found: DataFrame) -> DataFrame:
    """The action that each gap asks for, by its idempotency key."""
    return found.select(F.concat(F.lit("citation-gap:"), "gap_key").alias("idempotency_key"), F.lit("citation_gap").alias("action_type"), F.col("priority").alias("impact"), "confidence", F.lit(55).alias("effort"), F.lit(20).alias("risk"))


GAP_ACTIONS_SQL = f"WITH {GAPS_CTE} SELECT concat('citation-gap:', gap_key) AS idempotency_key, 'citation_gap' AS action_type, priority AS impact, confidence, 55 AS effort, 20 AS risk FROM gaps"


def prompts(items: DataFrame) -> DataFrame:
    """Prompts by the hash of their trimmed lower-case text; the smallest id stands for equals."""
    return items.groupBy(prompt_hash(F.col("text")).alias("prompt_hash")).agg(F.min("item_id").alias("item_id"), F.count("*").alias("n"))


PROMPTS_SQL = "SELECT sha256(lower(trim(text))) AS prompt_hash, min(item_id) AS item_id, count(*) AS n FROM benchmark GROUP BY 1"
