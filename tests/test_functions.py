"""Functions, sinks and streams against values by hand, round trips and brute force."""

from __future__ import annotations

import csv
import datetime
import glob
import json
import random

import pytest
from pyspark.sql import functions as F

from searchlift.functions import html, text, urls
from searchlift.operators import drafts, findings, loading, measurement, policy
from searchlift.sources import sinks, staging
from searchlift.streaming import events as streams

PAGE = """<!doctype html><HTML LANG='de-DE'><head><TITLE>
 A &amp; B  – shop </TITLE><meta content='Text with "quotes" &amp; more' name=Description><META property="og:title" content="OG">
<link href='/kanonisch?x=1' rel="alternate canonical"><meta name='viewport' content='width=device-width'>
<meta content="noindex, nofollow" name="robots"><script type='application/ld+json'>{"@type":"Thing"}</script></head>
<body><h1 class=big>First <em>head</em></h1><H2>Second</H2><h3> </h3><img src=a><img alt="" src=b><img alt='Ein Bild' src=c>
<noscript>hidden words</noscript><p>Ñandú isn't well-known</p><a href=/eins>1</a><a class="x" href='zwei.html#top'>2</a></body></HTML>"""


def test_pages_as_they_are_written(spark):
    p = spark.createDataFrame([(PAGE,), (None,), ("",)], "html string").select(html.extract(F.col("html")).alias("p")).select("p.*").collect()
    r = p[0]
    assert (r.title, r.h1, r.h2, r.h3) == ("A & B – shop", ["First head"], ["Second"], [])
    assert (r.description, r.canonical, r.robots, r.lang, r.viewport) == ('Text with "quotes" & more', "/kanonisch?x=1", "noindex, nofollow", "de-DE", "width=device-width")
    assert (r.images, r.images_without_alt, r.images_empty_alt, r.json_ld_count, r.og) == (3, 1, 2, 1, {"og:title": "OG"})
    assert r.links == ["/eins", "zwei.html#top"] and r.word_count == 11
    assert p[1].title is None and p[2].word_count == 0


def test_rules_read_what_the_parser_found(spark, tmp_path):
    from searchlift.sources import tables

    spark.createDataFrame([(1, "https://www.a.example/Pfad?q=1", PAGE), (3, "https://a.example/", "<title>T</title>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    pages = tables.crawled_pages(spark, str(tmp_path))
    linked = findings.with_in_links(pages, tables.link_edges(pages))
    found = {(r.page_id, r.finding_type) for r in findings.page_findings(linked).select("page_id", "finding_type").collect()}
    assert {(1, "noindex_directive"), (1, "images_missing_alt"), (1, "orphan_page"), (3, "redirect_chain"), (3, "missing_homepage_structured_data"), (3, "missing_canonical")} <= found
    assert not {(1, "missing_title"), (1, "missing_canonical"), (1, "missing_meta_description"), (1, "missing_viewport"), (1, "missing_h1")} & found
    export = {(r.page_id, r.finding_type) for r in findings.rule_hits(linked, findings.EXPORT_RULES).collect()}
    assert {(1, "canonical_elsewhere"), (1, "images_without_alt"), (1, "description_short"), (1, "uppercase_path")} <= export
    audit = {(r.page_id, r.finding_type) for r in findings.rule_hits(linked, findings.AUDIT_RULES).collect()}
    assert {(1, "noindex"), (1, "title_length"), (1, "description_length"), (3, "og_title_missing"), (3, "lang_missing")} <= audit and not {(1, "og_title_missing"), (1, "lang_missing")} & audit


def test_references_count_with_their_semicolon(spark):
    page = "<title>A &amp; B &amp</title><h1>x &#65; &#x42; &copy &ampy; &unknown; & &euro;</h1><p>AT&amp</p><a href='/p?a=1&copy=2&amp;b=3'>1</a>"
    r = spark.createDataFrame([(page,)], "html string").select(html.extract(F.col("html")).alias("p")).select("p.*").first()
    assert r.title == "A & B &amp" and r.h1 == ["x A B &copy &ampy; &unknown; & €"]
    assert r.links == ["/p?a=1&copy=2&b=3"] and r.word_count == 3 + 6 + 2 + 1


def test_terms_are_trimmed_of_blanks_alone(spark):
    df = spark.createDataFrame([(["a 0", " b1", "", "2c2 ", "a 0", "x5", "5-5"], "Sitemap: https://a.example/s0\nsitemap: https://a.example/1")], "v array<string>, robots string")
    r = df.select(drafts.distinct_terms(F.col("v")).alias("v"), html.robots_sitemaps(F.col("robots")).alias("maps")).first()
    assert r.v == ["a 0", "b1", "2c2", "x5", "5-5"] and r.maps == ["https://a.example/s0", "https://a.example/1"]


def test_robots_and_sitemaps(spark):
    robots = "User-agent: *\nDisallow: /private\nCrawl-delay: 9\nSitemap: https://a.example/s.xml\nsitemap: https://a.example/s.xml\n"
    df = spark.createDataFrame([(200, robots, "https://a.example/private/x"), (200, robots, "https://a.example/open"), (404, robots, "https://a.example/private"), (None, None, "https://a.example/private")], "status int, robots string, url string")
    out = df.select(html.robots_rules("status", "robots").alias("r"), html.robots_allowed(F.when(F.col("status") < 400, F.col("robots")), F.col("url")).alias("ok"), html.robots_sitemaps(F.col("robots")).alias("maps")).collect()
    assert [(r.r.delay, r.r.sitemaps) for r in out] == [(5.0, ["https://a.example/s.xml"]), (5.0, ["https://a.example/s.xml"]), (0.0, []), (0.0, [])]
    assert [r.ok for r in out] == [False, True, True, True]
    index = "<sitemapindex><sitemap><loc>https://a.example/1.xml</loc></sitemap><sitemap><loc> https://a.example/2.xml </loc></sitemap></sitemapindex>"
    files = [("a", "https://a.example/s.xml", index), ("a", "https://a.example/1.xml", "<ns:urlset><ns:url><ns:loc>https://a.example/p?a=1&amp;b=2</ns:loc></ns:url></ns:urlset>"), ("a", "https://a.example/2.xml", "<urlset><url><loc>https://a.example/q</loc></url><url><loc>https://a.example/p?a=1&amp;b=2</loc></url></urlset>")]
    found = html.sitemap_pages(spark.createDataFrame(files, "site string, url string, xml string"), spark.createDataFrame(files[:1], "site string, url string, xml string").select("site", "url"))
    assert sorted(r.url for r in found.collect()) == ["https://a.example/p?a=1&b=2", "https://a.example/q"]


def test_small_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(text.slug(F.lit("--Ein Täst & more!--"))) == "ein-t-st-more"
    assert get(text.collapsed(F.lit(" a \n b\t c "))) == "a b c"
    assert get(text.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")))) == pytest.approx(1 / 3)
    assert get(text.backoff(F.lit(9))) == 30 * 64
    assert get(urls.covers(F.lit("sc-domain:a.example"), F.lit("x.a.example"))) and not get(urls.covers(F.lit("sc-domain:a.example"), F.lit("ba.example")))
    assert get(urls.covers(F.lit("https://www.a.example/"), F.lit("a.example"))) and not get(urls.covers(F.lit("https://a.example/x"), F.lit("a.example")))
    assert get(urls.origin(F.lit("HTTPS://A.Example:8080/x?y"))) == "https://a.example:8080"
    assert get(html.robots_directives(F.lit("noindex"), F.lit(" "))) == "noindex" and get(html.robots_directives(F.lit("noindex"), F.lit("nofollow"))) == "noindex, nofollow"
    assert get(html.content_hash(F.lit("x"), F.lit(b"y"))) == get(F.sha2(F.lit("x"), 256)) and get(html.content_hash(F.lit(None), F.lit(b"y"))) == get(F.sha2(F.lit("y"), 256))
    assert get(loading.final_end(F.lit("2024-02-25").cast("date"), F.lit("2024-02-20"))) == datetime.date(2024, 2, 19) and get(loading.final_end(F.lit("2024-02-25").cast("date"), F.lit(None).cast("string"))) == datetime.date(2024, 2, 25)


@pytest.mark.parametrize(
    "raw, want",
    [("../b//c/?utm_source=x&b=2&a=1#f", "https://www.a.example/b/c/?a=1&b=2"), ("mailto:x@y.z", None), ("https://other.example/", None), ("/x.PDF", None), ("https://A.example:443/x", "https://a.example/x"), ("http://u:p@a.example/", None), ("#top", None), ("x?fbclid=1", "https://www.a.example/d/x")],
)
def test_links_in_one_spelling(raw, want):
    assert urls.normalised(raw, "https://www.a.example/d/e", "a.example") == want


def test_exports_and_appends(spark, tmp_path):
    pages = spark.createDataFrame([("https://a/2", "/2", "T, \"x\"", None, 1, 200, None), ("https://a/1", "/1", None, "d", 0, 404, 7)], "url string, path string, title string, description string, h1_count int, status_code int, response_time_ms int")
    pages = pages.withColumns({"word_count": F.lit(3), "canonical": F.lit(None).cast("string"), "robots": F.lit(""), "lang": F.lit("de")})
    sinks.export_csv(pages, f"file://{tmp_path}/csv")
    rows = [r for f in sorted(glob.glob(f"{tmp_path}/csv/*.csv")) for r in csv.DictReader(open(f), escapechar="\\")]
    assert [r["path"] for r in rows] == ["/1", "/2"] and rows[0]["response_time_ms"] == "7" and rows[1]["response_time_ms"] == "0" and list(rows[0]) == list(sinks.EXPORT_COLUMNS)
    sinks.export_json(pages, f"file://{tmp_path}/json")
    assert [json.loads(x)["path"] for f in sorted(glob.glob(f"{tmp_path}/json/*.json")) for x in open(f)] == ["/1", "/2"]
    for _ in range(2):
        sinks.append_events(spark.range(3), f"file://{tmp_path}/log")
    assert spark.read.parquet(f"file://{tmp_path}/log").count() == 6


def test_whole_days_are_replaced_once_they_are_complete(spark, tmp_path):
    day = lambda i: datetime.date(2024, 1, 1) + datetime.timedelta(days=i)
    old = spark.createDataFrame([(day(i), float(i)) for i in range(4)], "metric_date date, clicks double")
    path = f"file://{tmp_path}/facts"
    sinks.replace_days(old, path)
    sinks.replace_days(spark.createDataFrame([(day(1), 10.0), (day(1), 11.0)], "metric_date date, clicks double"), path)
    assert sorted((r.metric_date, r.clicks) for r in spark.read.parquet(path).collect()) == [(day(0), 0.0), (day(1), 10.0), (day(1), 11.0), (day(2), 2.0), (day(3), 3.0)]


def test_outcomes_by_hand(spark):
    rng = random.Random(2)
    rows = [(float(rng.choice([0, 1, 3, 20, 50])), float(rng.choice([0, 19, 20, 100, 1750, 2000])), float(rng.choice([0, 1, 3, 18, 22, 60])), float(rng.choice([0, 20, 90, 130, 2000]))) for _ in range(400)] + [(1.0, 2000.0, 1.0, 1750.0)]
    cols = ["bc", "bi", "ac", "ai"]
    out = spark.createDataFrame(rows, "bc double, bi double, ac double, ai double").select(*cols, measurement.outcome(*[F.col(c) for c in cols]).alias("o")).collect()
    for r in out:
        if min(r.bi, r.ai) < 20:
            assert (r.o.outcome, r.o.confidence) == ("insufficient_data", 0)
            continue
        b, a = round(r.bc / r.bi, 6), round(r.ac / r.ai, 6)
        dc, dt, di = (r.ac - r.bc) / max(r.bc, 1), (a - b) / max(b, 0.001), (r.ai - r.bi) / r.bi
        kind = "positive" if max(dc, dt) >= 0.1 and min(dc, dt) > -0.1 and di > -0.2 else "negative" if min(dc, dt) <= -0.1 and max(dc, dt) < 0.1 and di < 0.2 else "neutral"
        assert r.o.outcome == kind and r.o.confidence == min(95, 40 + int(min(r.bi, r.ai) ** 0.5 * 3))
    assert out[-1].o.outcome == "neutral"


def test_ranges_that_overlap_or_touch_are_one(spark):
    rng = random.Random(9)
    start = datetime.date(2024, 1, 1)
    rows = [(f"s{rng.randrange(3)}", start + datetime.timedelta(days=a), start + datetime.timedelta(days=a + rng.randrange(6))) for a in (rng.randrange(60) for _ in range(40))]
    out = measurement.merged_ranges(spark.createDataFrame(rows, "site string, first_day date, last_day date"), "site").collect()
    for site in {r[0] for r in rows}:
        days = {a + datetime.timedelta(days=i) for s, a, b in rows if s == site for i in range((b - a).days + 1)}
        got = sorted((r.first_day, r.last_day) for r in out if r.site == site)
        assert {a + datetime.timedelta(days=i) for a, b in got for i in range((b - a).days + 1)} == days
        assert all((c - b).days > 1 for (_, b), (c, _) in zip(got, got[1:]))


def test_a_stream_goes_on_and_writes_nothing_twice(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, at + datetime.timedelta(hours=i), i % 3, "click", 1.0) for i in range(48)]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    path = f"file://{tmp_path}/events"
    spark.createDataFrame(rows[:30], schema).coalesce(1).write.parquet(path)
    first = streams.run(streams.folded(streams.read(spark, path)), "complete", "fold")
    assert sorted(r.events for r in first.collect()) == [10, 10, 10]
    spark.createDataFrame(rows[30:], schema).coalesce(1).write.mode("append").parquet(path)
    assert sorted(r.events for r in streams.run(streams.folded(streams.read(spark, path)), "complete", "fold").collect()) == [16, 16, 16]


def test_stream_pacing_is_the_batch_pacing(spark):
    from searchlift.plans import catalog

    sf = "/root/testdata/sf0.001"
    rounded = lambda r: (r.host, round(r.delay, 6), round(r.scale, 6), r.throttled)
    assert sorted(map(rounded, catalog.queries()["stream_pacing"](spark, sf).collect())) == sorted(map(rounded, catalog.queries()["crawl_pacing"](spark, sf).collect()))


def test_cool_down_keeps_one_event_per_key(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, at + datetime.timedelta(hours=i % 10), i % 2, "click", 1.0) for i in range(20)]
    path = f"file://{tmp_path}/events"
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.parquet(path)
    assert sorted(r.user_id for r in streams.run(streams.cooled_down(streams.read(spark, path))).collect()) == [0, 1]


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda k, d=None: d)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        staging.shared_dir(Session)


def test_moving_limits_at_the_borders_of_days(spark):
    at = datetime.datetime(2024, 1, 1, 20)
    hour = datetime.timedelta(hours=1)
    rng = random.Random(4)
    rows = [(i, rng.choice(("a", "b", None)), rng.choice(("x", "y")), "d", at + rng.randrange(0, 80) * hour) for i in range(120)]
    rows += [(900, "edge", "e", "d", at), (901, "edge", "e", "d", at + 6 * hour), (902, "edge", "e", "d", at + 24 * hour), (903, "edge", "e", "d", None)]
    got = {r.request_id: r for r in policy.audit_requests(spark.createDataFrame(rows, "request_id long, requester string, email string, domain string, ts timestamp")).collect()}
    assert len(got) == len(rows)
    for i, who, email, _, ts in rows:
        if ts is None:
            assert (got[i].recent, got[i].duplicate_of) == (0, None)
            continue
        recent = 0 if who is None else sum(w == who and t is not None and ts - 24 * hour <= t < ts for _, w, _, _, t in rows)
        same = [(t, j) for j, _, e, _, t in rows if e == email and t is not None and ts - 6 * hour <= t < ts]
        assert (got[i].recent, got[i].limited, got[i].duplicate_of) == (recent, recent >= 5, max(same)[1] if same else None)
