"""Loading search facts: the cap of a day, the last final day, parsing, hashes, and the replacement of whole days.

Also the 28-day baseline of a site's sources, and imported pages that take the place of older ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from searchlift.functions.urls import host_key, page_url_key
from searchlift.sources.samples import RAW_CTE, SITE
from searchlift.sources.tables import FACTS_SQL, PERIOD_END, RECENT_FROM
from searchlift.sources.versions import VersionedTable

#: Rows that a day may bring before its load counts as cut off, and characters that are stored of a query and a URL.
DAY_CAP, QUERY, URL = 100_000, 10_000, 2048


def capped_days(raw: DataFrame, cap: int = DAY_CAP) -> DataFrame:
    """Days whose answers reached the cap and had more rows: a load that holds one must not replace anything."""
    return raw.groupBy(F.get("keys", 0).alias("day")).agg(F.count("*").alias("rows")).withColumn("over", F.col("rows") > cap)


CAPPED_SQL = f"WITH {RAW_CTE} SELECT day, count(*) AS rows, count(*) > 1200 AS over FROM raw GROUP BY day"


def assembled(captures: DataFrame, cap: int = DAY_CAP) -> tuple[DataFrame, DataFrame]:
    """Captured answers of a provider that pages its rows -> the state of each day, and the rows of days that are whole.

    captures: metric_date, start_row, requested, rows (array); read oldest first by start_row, each answer must
    begin where those before it end. A day ends with an answer of fewer rows than were requested. A day that reaches
    the cap with a full answer is whole only if the probe after it, one row from the cap on, is empty: that tells
    an exactly full day from one that is cut. gap: an answer is missing; open: the last one was full and nothing follows.
    """
    rows = F.coalesce("rows", F.array().cast(captures.schema["rows"].dataType))
    # Of answers from the same row on, captured twice, the one with more rows counts.
    captures = captures.groupBy("metric_date", "start_row").agg(F.max(F.struct(F.size(rows).alias("n"), "requested", rows.alias("rows"))).alias("a")).select("metric_date", "start_row", "a.*")
    c = captures.drop("rows")
    w = Window.partitionBy("metric_date").orderBy("start_row")
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = c.withColumns({"before": before, "last": F.lead("start_row").over(w).isNull(), "full": F.col("n") >= F.col("requested")})
    probe = (F.col("start_row") >= cap) & (F.col("requested") == 1)
    day = c.groupBy("metric_date").agg(
        F.sum(F.when(~probe, F.col("n")).otherwise(0)).alias("rows"), F.bool_or(F.col("start_row") != F.col("before")).alias("gap"), F.bool_or(probe & (F.col("n") > 0)).alias("over"), F.bool_or(probe).alias("probed"),
        F.bool_or(F.col("last") & F.col("full") & ~probe).alias("unended"),
    )
    state = F.when(F.col("gap"), "gap").when(F.col("over"), "cut").when(F.col("unended"), "open").otherwise("whole")
    states = day.select("metric_date", "rows", state.alias("state"))
    whole = captures.join(states.where("state = 'whole'").select("metric_date"), "metric_date", "left_semi").where(~probe)
    return states, whole.select("metric_date", F.explode("rows").alias("row")).select("metric_date", "row.*")


PAGE_ROWS, SAMPLE_CAP = 15, 45


ASSEMBLED_SQL = f"""WITH {FACTS_SQL}, n AS (SELECT metric_date, count(*) AS n, dayofyear(metric_date) AS d FROM facts GROUP BY 1), k AS (SELECT metric_date, d, n, CASE WHEN d % 3 = 0 THEN least(n, {SAMPLE_CAP}) ELSE n END AS given FROM n),
s AS (SELECT metric_date, least(given, {SAMPLE_CAP}) - CASE WHEN d % 7 = 0 THEN greatest(0, least(given, {2 * PAGE_ROWS}) - {PAGE_ROWS}) ELSE 0 END AS rows, CASE WHEN d % 7 = 0 AND given > {PAGE_ROWS} OR given < {SAMPLE_CAP} AND d % 11 <> 0 THEN 'gap' WHEN d % 11 = 0 AND given >= {SAMPLE_CAP} THEN 'open' WHEN given > {SAMPLE_CAP} THEN 'cut' ELSE 'whole' END AS state FROM k)
SELECT metric_date, rows, state FROM s"""


def final_end(proposed: Column, first_incomplete: Column) -> Column:
    """The last day that may be loaded: the day before the first that the provider calls incomplete, if that comes earlier."""
    return F.least(proposed, F.coalesce(F.date_sub(F.try_to_timestamp(first_incomplete, F.lit("yyyy-MM-dd")).cast("date"), 1), proposed))


def parsed(raw: DataFrame, site: str = SITE) -> DataFrame:
    """keys = [date, query, page] and numbers -> fact rows with their hashes.

    Rows with fewer than three keys, no valid date or a page off the site are left out; missing
    and unreadable numbers are 0; hashes are those of the whole values, the stored ones are cut.
    """
    # Generated, so that a filter below does not make the keys anew for each of its conditions.
    raw = raw.select(F.inline(F.array(F.struct(F.size("keys").alias("n"), F.get("keys", 0).alias("day"), F.get("keys", 1).alias("query"), F.get("keys", 2).alias("url"), "clicks", "impressions", "position")))).where("n >= 3")
    query, url = F.col("query"), F.col("url")
    number = lambda c: F.coalesce(F.try_to_number(F.col(c), F.lit("9999999999.999999")).cast("double"), F.lit(0.0)).alias(c)
    day = F.try_to_timestamp("day", F.lit("yyyy-MM-dd")).cast("date")
    rows = raw.select(
        day.alias("metric_date"), F.substring(query, 1, QUERY).alias("query"), F.sha2(query, 256).alias("query_hash"), F.substring(url, 1, URL).alias("page_url"), F.sha2(url, 256).alias("page_url_hash"),
        F.sha2(page_url_key(url), 256).alias("page_url_key_hash"), host_key(url).alias("host"), *map(number, ("clicks", "impressions", "position")),
    )
    return rows.where((F.col("host") == F.regexp_replace(F.lower(F.lit(site)), r"^www\.", "")) & F.col("metric_date").isNotNull()).drop("host")


PARSED_CTE = f"""{RAW_CTE}, parsed AS (SELECT CAST(day AS DATE) AS metric_date, query, sha256(query) AS query_hash, url AS page_url, sha256(url) AS page_url_hash, sha256(concat('{SITE}', path)) AS page_url_key_hash,
 coalesce(try_cast(clicks AS DOUBLE), 0) AS clicks, coalesce(try_cast(impressions AS DOUBLE), 0) AS impressions, coalesce(try_cast(position AS DOUBLE), 0) AS position FROM raw WHERE kind = 'good')"""
PARSED_SQL = f"WITH {PARSED_CTE} SELECT * FROM parsed"


def loaded(existing: DataFrame, new: DataFrame, start: str, end: str) -> DataFrame:
    """The fact table after a load of [start, end]: whole days of the range are the new rows', other days stay."""
    inside = F.col("metric_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return existing.where(~inside).unionByName(new.where(inside))


def load_days(new: DataFrame, target: VersionedTable, start: str, end: str, cap: int | None = DAY_CAP, held: Callable[[], bool] = lambda: True) -> int:
    """Commit a load of [start, end]: its days take the place of all the target's days of that range, in one move of the pointer.

    cap: rows that a provider's answers give of a day at most; None where the rows come from a table that has them all.
    A day over the cap, a lease that is lost while the load is written (held) and another load that was
    first refuse the commit; the version before stays as it was. Returns the rows written.
    """
    before = target.manifest()
    inside = new.where(F.col("metric_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    after = target.commit(inside, start=start, end=end, based_on=before, most=cap, held=held)
    return sum(d.rows for day, d in after.days.items() if start <= day <= end)


def day_totals(facts: DataFrame) -> DataFrame:
    return facts.groupBy("metric_date").agg(F.count("*").alias("rows"), F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))


LOADED_SQL = f"""WITH {PARSED_CTE}, old AS (SELECT DATE '2023-12-31' + CAST(k AS INT) AS metric_date, 1.0 AS clicks, 2.0 AS impressions FROM range(60) r(k)),
t AS (SELECT metric_date, clicks, impressions FROM old WHERE metric_date NOT BETWEEN DATE '{RECENT_FROM}' AND DATE '{PERIOD_END}' UNION ALL SELECT metric_date, clicks, impressions FROM parsed WHERE metric_date BETWEEN DATE '{RECENT_FROM}' AND DATE '{PERIOD_END}')
SELECT metric_date, count(*) AS rows, sum(clicks) AS clicks, sum(impressions) AS impressions FROM t GROUP BY metric_date"""


def baseline(facts: DataFrame, events: DataFrame, requested: tuple[str, ...] = ("search", "visits")) -> DataFrame:
    """One row: the totals of the last 28 days of either source, and ready, partial or failed by how many of those asked for have answered."""
    f = facts.where(F.col("metric_date").between(F.lit(RECENT_FROM).cast("date"), F.lit(PERIOD_END).cast("date"))).agg(
        F.count("*").alias("search_rows"), F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.round(F.sum(F.col("position") * F.col("impressions")) / F.sum("impressions"), 3).alias("position")
    )
    e = events.where("event_type <> 'error'").agg(F.count("*").alias("visit_rows"), F.count_distinct("user_id").alias("active_users"), F.count_if(F.col("event_type") == "purchase").alias("key_events"))
    got = lambda name: F.col({"search": "search_rows", "visits": "visit_rows"}[name]) > 0
    n = sum((got(r).cast("int") for r in requested), F.lit(0))
    status = F.when(n == len(requested), "ready").when(n > 0, "partial").otherwise("failed")
    return f.crossJoin(e).select("clicks", "impressions", "position", F.col("visit_rows").alias("visits"), "active_users", "key_events", status.alias("status"))  # one row each


BASELINE_SQL = f"""WITH {FACTS_SQL}, f AS (SELECT count(*) AS n, sum(clicks) AS clicks, sum(impressions) AS impressions, round(sum(position * impressions) / sum(impressions), 3) AS position FROM facts WHERE metric_date BETWEEN DATE '{RECENT_FROM}' AND DATE '{PERIOD_END}'),
e AS (SELECT count(*) AS visits, count(DISTINCT user_id) AS active_users, count(*) FILTER (event_type = 'purchase') AS key_events FROM events WHERE event_type <> 'error')
SELECT clicks, impressions, position, visits, active_users, key_events, CASE WHEN n > 0 AND visits > 0 THEN 'ready' WHEN n > 0 OR visits > 0 THEN 'partial' ELSE 'failed' END AS status FROM f, e"""


def imported(found: DataFrame) -> DataFrame:
    """A connector's pages (site, path, place, ...): the first of each path in the order of the export."""
    first = F.row_number().over(Window.partitionBy("site", "path").orderBy("place"))
    return found.withColumn("rank", first).where("rank = 1").drop("rank")


def upserted(existing: DataFrame, found: DataFrame, keys: tuple[str, ...] = ("site", "path"), created: str = "created_on") -> DataFrame:
    """Pages after a crawl: those seen take the new values and keep when they were first seen; the rest stay."""
    old = existing.select(*keys, F.col(created).alias("__created"), F.lit(True).alias("__old"))
    seen = found.join(old, list(keys), "left").withColumn(created, F.coalesce("__created", created)).withColumn("event", F.when(F.col("__old"), "updated").otherwise("created")).drop("__created", "__old")
    return seen.unionByName(existing.join(found.select(*keys), list(keys), "left_anti").withColumn("event", F.lit("kept")))
