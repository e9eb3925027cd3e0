"""Every field of the crawled pages against its SQL, under titles that are made as the stored pages make theirs."""

from __future__ import annotations

import html

import duckdb

from searchlift.sources import tables

SF = "/root/testdata/sf0.01"
FIELDS = "page_id, url, site, path, title, h1, description, canonical, viewport, robots, lang, h1_count, json_ld_count, images_without_alt, images_empty_alt, og_title, word_count, links"


def test_fields_of_pages_with_cut_titles_equal_their_sql(spark, tmp_path):
    """A title is the first line of a document, escaped and cut, here at 40 to 60 characters so that many references are cut."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    lines = [html.escape((d.text or "").split("\n")[0], quote=True) for d in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    rows = []
    for i, line in enumerate(lines):
        p, title = pages[i % len(pages)], line[: 40 + i % 21]
        head, rest = p.html.split("<title>", 1)
        between, body = rest.split("</title>", 1)[1].split("<h1>", 1)
        rows.append((i, p.url, f"{head}<title>{title}</title>{between}<h1>{title}</h1>{body.split('</h1>', 1)[1]}"))
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = tables.crawled_pages(spark, str(tmp_path)).select(*FIELDS.split(", ")).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = con.execute(f"WITH {tables.PAGES_SQL} SELECT {FIELDS} FROM crawled").fetchall()
    assert any(t.endswith(("&", "&a", "&am", "&amp")) for t in (r[4] for r in want))
    assert sorted(map(tuple, got)) == sorted(want)
