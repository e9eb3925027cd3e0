"""Search facts over date windows, the opportunities they show, and outcome windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from searchlift.sources.tables import CURRENT_FROM, FACTS_SQL, PERIOD_END, PREVIOUS_TO, RECENT_FROM


def ratio(a: Column, b: Column, places: int) -> Column:
    return F.when(b > 0, F.round(a / b, places)).otherwise(F.lit(0.0))


def weighted_metrics(facts: DataFrame, *keys: str, places: tuple[int, int] = (6, 3)) -> DataFrame:
    """Clicks, impressions, ctr and impression-weighted position per key."""
    sums = facts.groupBy(*keys).agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.sum(F.col("position") * F.col("impressions")).alias("w"))
    return sums.select(*keys, "clicks", "impressions", ratio(F.col("clicks"), F.col("impressions"), places[0]).alias("ctr"), ratio(F.col("w"), F.col("impressions"), places[1]).alias("position"))


WEIGHTED_SQL = f"""WITH {FACTS_SQL}
SELECT query, sum(clicks) AS clicks, sum(impressions) AS impressions,
       CASE WHEN sum(impressions) > 0 THEN round(sum(clicks) / sum(impressions), 6) ELSE 0 END AS ctr,
       CASE WHEN sum(impressions) > 0 THEN round(sum(position * impressions) / sum(impressions), 3) ELSE 0 END AS position
FROM facts GROUP BY query"""


def metric_window(facts: DataFrame, start: str, end: str) -> DataFrame:
    """Per page inside [start, end]: sums, weighted position and the days covered."""
    inside = facts.where(F.col("metric_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return inside.groupBy("page_url").agg(
        F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.round(F.sum(F.col("position") * F.col("impressions")) / F.sum("impressions"), 3).alias("position"),
        F.countDistinct("metric_date").alias("days"), F.min("metric_date").alias("first_day"), F.max("metric_date").alias("last_day"),
    )


METRIC_WINDOW_SQL = f"""WITH {FACTS_SQL}
SELECT page_url, sum(clicks) AS clicks, sum(impressions) AS impressions,
       round(sum(position * impressions) / sum(impressions), 3) AS position,
       count(DISTINCT metric_date) AS days, min(metric_date) AS first_day, max(metric_date) AS last_day
FROM facts WHERE metric_date BETWEEN DATE '{RECENT_FROM}' AND DATE '{PERIOD_END}' GROUP BY page_url"""


def pct_delta(cur: Column, prev: Column) -> Column:
    return F.when(prev > 0, F.round((cur - prev) / prev, 4))


def period_change(facts: DataFrame) -> DataFrame:
    """Per page, the last two weeks against the rest of the last four."""
    recent = facts.where(F.col("metric_date").between(F.lit(RECENT_FROM).cast("date"), F.lit(PERIOD_END).cast("date")))
    cur = F.col("metric_date") >= F.lit(CURRENT_FROM).cast("date")
    total = lambda side, c: F.coalesce(F.sum(F.when(side, F.col(c))), F.lit(0.0))
    sums = recent.groupBy("page_url").agg(*[total(side, c).alias(f"{name}_{c}") for name, side in (("cur", cur), ("prev", ~cur)) for c in ("clicks", "impressions")])
    return sums.withColumns({"clicks_delta": pct_delta(F.col("cur_clicks"), F.col("prev_clicks")), "impressions_delta": pct_delta(F.col("cur_impressions"), F.col("prev_impressions"))})


CHANGE_CTE = f"""{FACTS_SQL}, change AS (
  SELECT page_url, coalesce(sum(clicks) FILTER (metric_date >= DATE '{CURRENT_FROM}'), 0.0) AS cur_clicks,
         coalesce(sum(impressions) FILTER (metric_date >= DATE '{CURRENT_FROM}'), 0.0) AS cur_impressions,
         coalesce(sum(clicks) FILTER (metric_date < DATE '{CURRENT_FROM}'), 0.0) AS prev_clicks,
         coalesce(sum(impressions) FILTER (metric_date < DATE '{CURRENT_FROM}'), 0.0) AS prev_impressions
  FROM facts WHERE metric_date BETWEEN DATE '{RECENT_FROM}' AND DATE '{PERIOD_END}' GROUP BY page_url)"""
CHANGE_SQL = f"""WITH {CHANGE_CTE}
SELECT *, CASE WHEN prev_clicks > 0 THEN round((cur_clicks - prev_clicks) / prev_clicks, 4) END AS clicks_delta,
       CASE WHEN prev_impressions > 0 THEN round((cur_impressions - prev_impressions) / prev_impressions, 4) END AS impressions_delta FROM change"""


def windows(facts: DataFrame) -> DataFrame:
    """Per (query, page): sums of the recent four weeks, and clicks of the two halves. One pass, one shuffle."""
    day = F.col("metric_date")
    edge = lambda d: F.lit(d).cast("date")
    w = facts.where(day.between(edge(RECENT_FROM), edge(PERIOD_END))).groupBy("query", "page_url").agg(
        F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.sum(F.col("position") * F.col("impressions")).alias("w"),
        F.coalesce(F.sum(F.when(day <= edge(PREVIOUS_TO), F.col("clicks"))), F.lit(0.0)).alias("prev_clicks"),
        F.coalesce(F.sum(F.when(day >= edge(CURRENT_FROM), F.col("clicks"))), F.lit(0.0)).alias("cur_clicks"),
    )
    w = w.where("impressions >= 20 OR prev_clicks >= 10")
    return w.select("query", "page_url", "clicks", "impressions", "prev_clicks", "cur_clicks", ratio(F.col("clicks"), F.col("impressions"), 6).alias("ctr"), ratio(F.col("w"), F.col("impressions"), 3).alias("position"))


def opportunities(facts: DataFrame) -> DataFrame:
    """low_ctr, striking_distance and traffic_decay per (query, page), cannibalization per query."""
    w = windows(facts)
    imp, pos, prev, cur = F.col("impressions"), F.col("position"), F.col("prev_clicks"), F.col("cur_clicks")
    delta = F.round((cur - prev) / prev, 4)
    as_int = lambda c: c.cast("int")
    rules = [
        (( imp >= 100) & pos.between(1, 10) & (F.col("ctr") < 0.02), "low_ctr", F.least(F.lit(100), 55 + F.floor(imp / 100)), F.least(F.lit(95), 60 + F.floor(F.sqrt(imp)))),
        ((imp >= 50) & pos.between(11, 20), "striking_distance", F.least(F.lit(100), 50 + F.floor(imp / 75)), F.least(F.lit(95), 55 + F.floor(F.sqrt(imp)))),
        ((prev >= 10) & (cur <= prev * 0.7), "traffic_decay", F.least(F.lit(100), 65 + F.floor(F.abs(delta) * 30)), F.least(F.lit(95), 65 + F.floor(F.sqrt(prev)))),
    ]
    found = F.filter(F.array(*[F.when(on, F.struct(F.lit(kind).alias("opportunity_type"), as_int(p).alias("priority"), as_int(c).alias("confidence"))) for on, kind, p, c in rules]), lambda x: x.isNotNull())
    per_page = w.select("query", "page_url", F.explode(found).alias("o")).select("o.opportunity_type", "query", "page_url", "o.priority", "o.confidence")
    split = w.where("query <> '' AND impressions >= 20").groupBy("query").agg(F.count("*").alias("n"), F.sum("impressions").alias("total")).where("n >= 2")
    split = split.select(F.lit("cannibalization").alias("opportunity_type"), "query", F.lit(None).cast("string").alias("page_url"), as_int(F.least(F.lit(100), 60 + 5 * F.col("n"))).alias("priority"), as_int(F.least(F.lit(95), 60 + F.floor(F.sqrt("total")))).alias("confidence"))
    return per_page.unionByName(split).withColumn("opportunity_key", opportunity_key())


def opportunity_key() -> Column:
    return F.sha2(F.concat_ws("|", "opportunity_type", F.coalesce("query", F.lit("")), F.coalesce("page_url", F.lit(""))), 256)


OPPORTUNITY_CTE = f"""{FACTS_SQL}, win AS (
  SELECT query, page_url, sum(clicks) AS clicks, sum(impressions) AS impressions,
         CASE WHEN sum(impressions) > 0 THEN round(sum(clicks) / sum(impressions), 6) ELSE 0 END AS ctr,
         CASE WHEN sum(impressions) > 0 THEN round(sum(position * impressions) / sum(impressions), 3) ELSE 0 END AS position,
         coalesce(sum(clicks) FILTER (metric_date <= DATE '{PREVIOUS_TO}'), 0) AS prev_clicks,
         coalesce(sum(clicks) FILTER (metric_date >= DATE '{CURRENT_FROM}'), 0) AS cur_clicks
  FROM facts WHERE metric_date BETWEEN DATE '{RECENT_FROM}' AND DATE '{PERIOD_END}' GROUP BY query, page_url
  HAVING sum(impressions) >= 20 OR coalesce(sum(clicks) FILTER (metric_date <= DATE '{PREVIOUS_TO}'), 0) >= 10),
found AS (
  SELECT 'low_ctr' AS opportunity_type, query, page_url, CAST(least(100, 55 + floor(impressions / 100)) AS INT) AS priority, CAST(least(95, 60 + floor(sqrt(impressions))) AS INT) AS confidence
  FROM win WHERE impressions >= 100 AND position BETWEEN 1 AND 10 AND ctr < 0.02
  UNION ALL SELECT 'striking_distance', query, page_url, CAST(least(100, 50 + floor(impressions / 75)) AS INT), CAST(least(95, 55 + floor(sqrt(impressions))) AS INT)
  FROM win WHERE impressions >= 50 AND position BETWEEN 11 AND 20
  UNION ALL SELECT 'traffic_decay', query, page_url, CAST(least(100, 65 + floor(abs(round((cur_clicks - prev_clicks) / prev_clicks, 4)) * 30)) AS INT), CAST(least(95, 65 + floor(sqrt(prev_clicks))) AS INT)
  FROM win WHERE prev_clicks >= 10 AND cur_clicks <= prev_clicks * 0.7
  UNION ALL SELECT 'cannibalization', query, NULL, CAST(least(100, 60 + 5 * count(*)) AS INT), CAST(least(95, 60 + floor(sqrt(sum(impressions)))) AS INT)
  FROM win WHERE query <> '' AND impressions >= 20 GROUP BY query HAVING count(*) >= 2),
opps AS (SELECT *, sha256(concat(opportunity_type, '|', coalesce(query, ''), '|', coalesce(page_url, ''))) AS opportunity_key FROM found)"""
OPPORTUNITIES_SQL = f"WITH {OPPORTUNITY_CTE} SELECT * FROM opps"


def actionable(opps: DataFrame, limit: int = 100) -> DataFrame:
    return opps.orderBy(F.desc("priority"), F.desc("confidence"), "opportunity_key").limit(limit)


ACTIONABLE_SQL = f"WITH {OPPORTUNITY_CTE} SELECT * FROM opps ORDER BY priority DESC, confidence DESC, opportunity_key LIMIT 100"


def cannibal_pages(facts: DataFrame, most: int = 10) -> DataFrame:
    """Per query, its pages by impressions, the first ten of them."""
    w = windows(facts).where("query <> '' AND impressions >= 20")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("impressions"), "page_url"))
    return w.withColumn("rank", rank).where(F.col("rank") <= most).select("query", "page_url", "impressions", "rank")


CANNIBAL_SQL = f"""WITH {OPPORTUNITY_CTE}
SELECT query, page_url, impressions, CAST(row_number() OVER (PARTITION BY query ORDER BY impressions DESC, page_url) AS INT) AS rank
FROM win WHERE query <> '' AND impressions >= 20 QUALIFY rank <= 10"""


def top_pages(facts: DataFrame, limit: int = 50) -> DataFrame:
    return facts.groupBy("page_url").agg(F.sum("impressions").alias("impressions")).orderBy(F.desc("impressions"), "page_url").limit(limit)


TOP_PAGES_SQL = f"WITH {FACTS_SQL} SELECT page_url, sum(impressions) AS impressions FROM facts GROUP BY page_url ORDER BY impressions DESC, page_url LIMIT 50"


def query_owners(facts: DataFrame) -> DataFrame:
    """Queries' terms that exactly one page earns in the current window, with that page."""
    cur = facts.where(F.col("metric_date") >= F.lit(CURRENT_FROM).cast("date")).select("page_url", F.explode(F.split(F.lower("query"), "[^a-z0-9]+")).alias("term")).where("term <> ''")
    return cur.groupBy("term").agg(F.countDistinct("page_url").alias("pages"), F.min("page_url").alias("page_url")).withColumn("page_url", F.when(F.col("pages") == 1, F.col("page_url")))


OWNERS_SQL = f"""WITH {FACTS_SQL}, terms AS (SELECT page_url, unnest(string_split_regex(lower(query), '[^a-z0-9]+')) AS term FROM facts WHERE metric_date >= DATE '{CURRENT_FROM}')
SELECT term, count(DISTINCT page_url) AS pages, CASE WHEN count(DISTINCT page_url) = 1 THEN min(page_url) END AS page_url FROM terms WHERE term <> '' GROUP BY term"""


def covered_ranges(days: DataFrame, *keys: str, day: str = "day") -> DataFrame:
    """Gaps and islands: maximal runs of consecutive days per key."""
    w = Window.partitionBy(*keys).orderBy(day)
    d = days.select(*keys, day).distinct().withColumn("island", F.date_sub(F.col(day), F.row_number().over(w)))
    return d.groupBy(*keys, "island").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("days")).drop("island")


COVERED_SQL = f"""WITH {FACTS_SQL}, d AS (SELECT DISTINCT page_url, metric_date AS day FROM facts),
i AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY page_url ORDER BY day) AS INT) AS island FROM d)
SELECT page_url, min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM i GROUP BY page_url, island"""
