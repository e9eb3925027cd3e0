"""Findings of pages with long titles and many links against their SQL: titles and links are read whole."""

from __future__ import annotations

import duckdb
import pytest

from searchlift.plans import catalog

NAMES = ["duplicate_titles", "export_checks", "export_duplicates", "finding_counts", "finding_state_counts"]


@pytest.fixture(scope="module")
def long(spark, tmp_path_factory):
    """Titles that differ after 660 characters only, and home pages that link to each page of their site after 1,000 other links."""
    root = tmp_path_factory.mktemp("long")
    far = "".join(f'<a href="/far/{i}">x</a>' for i in range(1000))
    near = ["".join(f'<a href="/en/{i}">y</a>' for i in range(site, 96, 2)) for site in (0, 1)]
    page = '<!DOCTYPE html><html lang="en"><head><title>{0}</title></head><body><nav>{1}</nav><article><h1>Heading</h1><p>Some text.</p></article></body></html>'
    rows = [(i, f"https://s{i % 2}.example.org/en/{i}", page.format("Long title " * 60 + f"end {i // 2 % 5}", far + near[i % 2] if i < 2 else "")) for i in range(96)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{root}/pages.parquet")
    return str(root), catalog._pages(spark, str(root))


@pytest.mark.parametrize("name", NAMES)
def test_findings_equal_their_sql(spark, long, monkeypatch, name):
    root, pages = long
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
