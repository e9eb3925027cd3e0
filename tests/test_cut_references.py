"""Findings of pages whose titles end within a character reference, against the SQL."""

from __future__ import annotations

import duckdb
import pytest

from searchlift.plans import catalog

#: Sixty characters of an escaped title, as the pages cut them.
TITLES = ["&amp;" * 11 + "&amp", "Prices &amp; plans &am", "Prices &amp; plans &am", "Say &quot;hello&quot; &quo", "A&amp;&amp;&amp;&amp;&amp;&amp;&amp;&amp;&amp;&amp;&amp;&amp", "x" * 17 + "&amp", "x" * 27 + "&amp", "End &", "&amp;copy; of &amp;amp"]
NAMES = ["duplicate_titles", "export_checks", "export_duplicates", "finding_actions", "finding_counts", "finding_runs", "finding_state_counts", "finding_step_counts", "finding_steps", "findings_summary"]


@pytest.fixture(scope="module")
def cut(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("cut")
    page = '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{0}</title></head><body><nav><ul><li><a href="/a">a</a></li></ul></nav><article><h1>{0}</h1><p>Some text &amp; more.</p></article><footer>&copy; us</footer></body></html>'
    rows = [(i, f"https://www.s{i % 2}.example.org/en/{i}", page.format(TITLES[i % len(TITLES)])) for i in range(72)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{root}/pages.parquet")
    return str(root), catalog._pages(spark, str(root))


@pytest.mark.parametrize("name", NAMES)
def test_findings_equal_their_sql(spark, cut, monkeypatch, name):
    root, pages = cut
    monkeypatch.setattr(catalog, "_pages", lambda s, d: pages)
    query, sql = catalog.QUERIES[name]
    got = query(spark, root)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{root}/pages.parquet/*.parquet')")
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    text = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    rows = text(got.select(*names).collect())
    assert rows and rows == text(want.fetchall())
