"""What the plans of large loads do once for each row, and what they no longer do for each."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from searchlift.functions import html
from searchlift.operators import loading, policy
from searchlift.plans import catalog, inputs
from searchlift.sources import samples, tables

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_keys_are_made_once_for_a_row(spark):
    assert plan(loading.parsed(samples.raw_facts(tables.search_facts(spark, SF)))).count("date_format(") == 3


def test_frames_of_audit_requests_do_not_slide(spark):
    frames = re.findall(r"specifiedwindowframe\(RangeFrame, ([^,]+),", plan(policy.audit_requests(inputs.audit_requests(tables.load(spark, SF, "events")))))
    assert frames and set(frames) == {"unboundedpreceding$()"}


def test_payloads_are_made_of_the_latest_events_alone(spark):
    text = catalog.queries()["inspection_latest"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "lastCrawlTime" in text and "lastCrawlTime" not in text[text.index("Window ") :]


def test_pages_are_answered_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(html, "PIECE", 2)
    df = spark.range(7).repartition(1).select("id", html.extract(F.concat(F.lit("<title>"), F.col("id").cast("string"), F.lit("</title>"))).alias("p"))
    assert all(r.title == str(r.id) for r in df.select("id", "p.title").collect()) and df.count() == 7
