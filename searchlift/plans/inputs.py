"""Inputs that the stored tables lack, made from their keys for the registered queries; the SQL beside each operator makes the same.

Operators know nothing of these; `sources.samples` holds those whose SQL several operators share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from searchlift.operators import captures, finding_actions, governance, loading, policy, targets


def finding_states(found: DataFrame) -> DataFrame:
    """Findings as they stand after some runs, with the latest action on each; the digits of the fingerprint decide."""
    d = finding_actions.digit
    number = lambda i, n: (F.ascii(d(i)) % n).cast("int")
    has = d(5) < "c"
    return found.select(
        "fingerprint", "finding_type", "severity", "impact", "confidence", "effort", "action_type", "risk", "url",
        F.when(d(1) < "3", "resolved").when(d(1) < "5", "dismissed").when(d(1) < "8", "regressed").otherwise("open").alias("status"),
        F.date_add(F.lit("2024-01-01").cast("date"), number(2, 10)).alias("last_seen"), number(3, 3).alias("regressions"),
        F.when(has, F.when(d(6) < "4", "draft").when(d(6) < "8", "approved").otherwise("succeeded")).alias("action_status"),
        F.when(has, F.when(d(4) < "4", finding_actions.DEFERRED[0]).when(d(4) < "6", F.lit(None)).when(d(4) < "8", finding_actions.DEFERRED[1]).otherwise("patch_ready")).alias("reason_code"),
    )


def paced_answers(events: DataFrame) -> DataFrame:
    """The events as answers; a third of the values of Retry-After are dates, which count nothing."""
    k = F.col("event_id") % 17
    status = F.when(F.col("event_type") == "error", 429).when(F.col("event_type") == "signup", 404).otherwise(200)
    after = F.when(k == 0, F.concat(F.lit(" "), (F.col("event_id") % 45).cast("string"))).when(k == 1, "Wed, 21 Oct 2015 07:28:00 GMT").when(k == 2, "1.5 ")
    return events.select((F.col("user_id") % 40).alias("host"), "ts", "event_id", status.alias("status_code"), (F.col("event_id") % 31 == 0).alias("bot_blocked"), after.alias("retry_after"))


def dated_pages(pages: DataFrame) -> DataFrame:
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 50).cast("int"))
    return pages.select("page_id", F.when(F.col("page_id") % 5 < 3, F.expr(targets.JSON_LD)).otherwise("{}").alias("json_ld"), F.when(F.col("page_id") % 5 < 4, day).alias("created_on"))


def job_snapshots(jobs: DataFrame) -> DataFrame:
    j = F.col("job_id")
    return jobs.select("site_id", "job_id", "status", "created_at", F.when(j % 5 == 1, 404).when(j % 5 == 2, 503).otherwise(200).alias("robots_status"), (j % 3).cast("int").alias("sitemap_errors"), (j % 4).cast("int").alias("urls_discovered"))


def serps(pages: DataFrame) -> DataFrame:
    """Per site a provider's answer that lists its pages by id."""
    rank = F.row_number().over(Window.partitionBy("site").orderBy("page_id"))
    first = pages.select("site", "page_id", "title", "url", "path", rank.alias("rank")).where("rank <= 20")
    rows = F.sort_array(F.collect_list(F.struct(F.col("rank").alias("position"), "title", F.col("url").alias("link"), F.col("path").alias("snippet"))))
    g = first.groupBy("site").agg(rows.alias("organic"))
    ask = F.transform("organic", lambda r: F.struct(F.concat(F.lit("What is "), r.snippet).alias("question")))
    return g.select(F.col("site").alias("keyword"), F.to_json(F.struct(F.col("site").alias("query"), "organic", ask.alias("peopleAlsoAsk"))).alias("payload"))


def earlier_queue(opportunities: DataFrame) -> DataFrame:
    """An earlier queue of some of the opportunities; the digits of a key decide which, and in what state."""
    digit = lambda i: F.substring("opportunity_key", i, 1)
    status = F.when(digit(2) < "4", "cancelled").when(digit(2) < "8", "approved").otherwise("draft")
    return opportunities.where(digit(3) < "a").select(F.col("opportunity_key").alias("key"), (F.col("priority") - F.when(digit(1) < "8", 0).otherwise(5)).alias("priority"), "confidence", status.alias("status"), F.lit(1).alias("version"))


def action_plans(orders: DataFrame) -> DataFrame:
    """Orders as actions with their target, diff, plans and evidence as JSON; the kind of naming goes by the number."""
    k = F.col("o_orderkey")
    n = k.cast("string")
    url = F.concat(F.lit("https://shop.example.com/o/"), n)
    none = F.lit(None).cast("string")
    j = lambda **xs: F.to_json(F.struct(*[v.alias(c) for c, v in xs.items()]))
    target = F.when(k % 3 == 0, j(path=F.concat(F.lit(" Public/"), n, F.lit(".TXT ")))).when(k % 3 == 1, j(paths=F.array(F.lit("A"), F.lit(" "), F.concat(F.lit("b/"), n)))).otherwise(F.lit("{}"))
    diff = F.when(k % 4 == 0, j(files=F.array(F.struct(F.concat(F.lit("src/"), n).alias("path")), F.struct(none.alias("path"))))).when(k % 4 == 1, j(files_deleted=F.array(F.lit("Old.md")), affected_urls=F.array(F.concat(url, F.lit("/d"))))).otherwise(F.lit("{}"))
    plan = F.when(k % 5 == 0, j(target_url=url)).when(k % 5 == 1, j(target_urls=F.array(F.concat(url, F.lit("/t"))))).otherwise(F.lit("{}"))
    evidence = F.when(k % 7 < 5, F.to_json(F.array(F.struct(none.alias("url")), F.struct(F.concat(url, F.lit("/e")).alias("url"))))).otherwise(F.lit("[]"))
    return orders.select(k.alias("action_id"), target.alias("target"), diff.alias("diff"), plan.alias("plan"), evidence.alias("evidence"))


def subscriptions(customers: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    overrides = F.when(k % 4 == 0, F.create_map(F.lit("sites"), (k % 50).cast("string"), F.lit("unknown"), F.lit("9"))).when(k % 4 == 1, F.create_map(F.lit("ai_tokens"), F.lit("many"))).otherwise(F.create_map().cast("map<string,string>"))
    return customers.select(k.alias("workspace"), F.when(k % 3 == 0, "audit").when(k % 3 == 1, "growth").otherwise("scale").alias("plan"), overrides.alias("overrides"))


def action_moves(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    states = sorted({s for _, froms, to in governance.MOVES for s in (*froms, to)})
    pick = lambda xs, by: F.element_at(F.array(*[F.lit(x) for x in xs]), (by % len(xs) + 1).cast("int"))
    return orders.select(k.alias("action_id"), pick(states, k).alias("status"), (1 + k % 3).cast("int").alias("version")), orders.select(k.alias("action_id"), pick([m[0] for m in governance.MOVES], F.floor(k / 3)).alias("event"), F.when(k % 11 == 0, 9).otherwise(1 + k % 3).cast("int").alias("expected_version"))


def action_log(orders: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Orders as drafts, their lines as the events of a life; some lines cancel or fail instead, some name an older or newer version."""
    i, part = F.col("l_linenumber"), F.col("l_partkey")
    event = F.when(part % 19 == 0, "cancel").when(part % 17 == 0, "fail").otherwise(F.element_at(F.array(*[F.lit(e) for e in governance.LIFE]), ((i - 1) % len(governance.LIFE) + 1).cast("int")))
    version = F.when(part % 13 == 0, i - 1).when(part % 11 == 0, i + 1).otherwise(i)
    log = lines.select(F.col("l_orderkey").alias("action_id"), (i * 10**10 + part).alias("seq"), event.alias("event"), version.alias("expected_version"))
    return orders.select(F.col("o_orderkey").alias("action_id"), F.lit("draft").alias("status"), F.lit(1).alias("version")), log


def proposed_actions(orders: DataFrame) -> DataFrame:
    """Orders as proposed actions."""
    k = F.col("o_orderkey")
    pick = lambda xs, by: F.element_at(F.array(*[F.lit(x) for x in xs]), (by % len(xs) + 1).cast("int"))
    return orders.select(
        k.alias("action_id"), pick(policy.TYPES, k).alias("action_type"), (k % 60).cast("int").alias("submitted_risk"), F.when(k % 3 == 0, "github").otherwise("cms").alias("adapter"),
        pick(policy.PATHS, F.floor(k / 7)).alias("path"), F.when(k % 11 == 0, 1).otherwise(0).alias("delete_count"), F.floor(F.col("o_totalprice") / 4000).cast("int").alias("affected_pages"),
    )


def audit_requests(events: DataFrame) -> DataFrame:
    """Events as requests: ten users share an address book, an event's type is the domain; every seventh user hides who asks."""
    return events.select(F.col("event_id").alias("request_id"), F.when(F.col("user_id") % 7 > 0, F.col("user_id")).alias("requester"), (F.col("user_id") % 15).alias("email"), F.col("event_type").alias("domain"), "ts")


def walled_answers(pages: DataFrame) -> DataFrame:
    """Captured pages as answers with a status and headers; every sixth is a challenge."""
    i = F.col("page_id")
    header = F.when(i % 4 == 1, "CF-Ray").when(i % 4 == 2, "X-Iinfo").otherwise("Server")
    body = F.concat(F.when(i % 6 == 0, "<title>Checking your browser</title>").when(i % 6 == 1, "<p>Cloudflare Ray ID</p>").otherwise(""), F.coalesce("html", F.lit("")))
    return pages.select("page_id", F.when(i % 10 == 3, 403).when(i % 10 == 6, 429).otherwise(200).alias("status_code"), F.create_map(header, F.lit("1")).alias("headers"), body.alias("body"))


def rendered_captures(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Crawled pages as two captures: as sent, and as another reader sees them."""
    i = F.col("page_id")
    sent = pages.withColumns({"n_links": F.size("links"), "title": F.when(i % 7 == 0, "").otherwise(F.col("title")), "h1_count": F.when(i % 8 == 0, 0).otherwise(F.col("h1_count"))}).select("page_id", *captures.FIELDS)
    seen = pages.withColumns({"n_links": F.floor(F.size("links") / (1 + i % 3)).cast("int"), "title": F.when(i % 9 == 0, "").otherwise(F.col("title")), "word_count": (F.col("word_count") + (i * 17) % 60 - 10).cast("int"), "robots": F.when(i % 11 == 0, "noindex").otherwise(F.col("robots"))}).select("page_id", *captures.FIELDS)
    return sent, seen


def paged_captures(facts: DataFrame) -> DataFrame:
    """The facts of a day as answers of fifteen rows, up to the cap of 45 and a probe; every third day has just as many rows as the cap, every seventh lacks its second answer, and every eleventh was not probed."""
    day = F.dayofyear("metric_date")
    numbered = facts.withColumn("at", F.row_number().over(Window.partitionBy("metric_date").orderBy("query", "page_url", "position", "impressions", "clicks")) - 1)
    there = numbered.where(((day % 3 != 0) | (F.col("at") < loading.SAMPLE_CAP)) & (F.col("at") <= loading.SAMPLE_CAP))
    start = F.when(F.col("at") >= loading.SAMPLE_CAP, loading.SAMPLE_CAP).otherwise(F.floor(F.col("at") / loading.PAGE_ROWS) * loading.PAGE_ROWS).cast("int")
    answers = there.groupBy("metric_date", start.alias("start_row")).agg(F.collect_list(F.struct("query", "page_url", "clicks", "impressions", "position")).alias("rows"))
    empty = facts.select("metric_date").distinct().select("metric_date", F.lit(loading.SAMPLE_CAP).alias("start_row"), F.array().cast(answers.schema["rows"].dataType).alias("rows"))
    every = answers.unionByName(empty.join(answers.where(F.col("start_row") == loading.SAMPLE_CAP), ["metric_date"], "left_anti"))
    kept = every.where(~((day % 7 == 0) & (F.col("start_row") == loading.PAGE_ROWS)) & ~((day % 11 == 0) & (F.col("start_row") == loading.SAMPLE_CAP)))
    return kept.select("metric_date", "start_row", F.when(F.col("start_row") == loading.SAMPLE_CAP, 1).otherwise(loading.PAGE_ROWS).alias("requested"), "rows")


def lease_events(events: DataFrame) -> DataFrame:
    """Users as jobs: views claim, clicks and sign-ups renew, errors ask for cancellation, purchases complete."""
    kind = F.when(F.col("event_type") == "view", "claim").when(F.col("event_type").isin("click", "signup"), "renew").when(F.col("event_type") == "error", "cancel").otherwise("complete")
    return events.select(F.col("user_id").alias("job_id"), "ts", "event_id", kind.alias("kind"), (F.col("event_id") % 5).cast("int").alias("attempt"))


def arrivals(facts: DataFrame) -> list[DataFrame]:
    """Three loads: all days; every fifth day anew with one click more, without pages of odd number; and the same days as an older load that comes last."""
    late = F.dayofmonth("metric_date") % 5 == 0
    again = facts.where(late & (F.regexp_extract("page_url", "([0-9]+)$", 1).cast("long") % 2 == 0)).withColumn("clicks", F.col("clicks") + 1)
    return [facts.withColumn("load", F.lit(1)), again.withColumn("load", F.lit(3)), facts.where(late).withColumn("load", F.lit(2))]
