"""The summary of a site run where searched pages have no terms, against its SQL."""

from __future__ import annotations

import os

import duckdb

from searchlift.plans import site_run

SF = "/root/testdata/sf0.001"


def test_pages_without_terms_have_no_actions(spark, tmp_path):
    """Pages 1 to 8 are found by searches, most of them decay; half of them have no term in path, title or heading."""
    page = "<!DOCTYPE html><html><head><title>{0}</title></head><body><h1>{0}</h1><p>Some text.</p></body></html>"
    rows = [(i, f"https://s{i % 3}.example.org/de/{i}", page.format("In In" if i % 2 else f"Garden tools {i}")) for i in range(1, 13)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    for t in ("lineitem", "part"):
        os.symlink(f"{SF}/{t}.parquet", f"{tmp_path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    out = site_run.run(spark, str(tmp_path), f"file://{tmp_path}/run")
    got = out.read("summary")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({site_run.SUMMARY_SQL})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    without = out.read("insights").where("decay >= 50 AND gain IS NULL").count()
    assert without > 0 and sum(r.decaying for r in got.collect()) > without
