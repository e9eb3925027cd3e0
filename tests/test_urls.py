"""URL expressions against the library's plain functions, over drawn references."""

from __future__ import annotations

import random
import re
from urllib.parse import urljoin

from pyspark.sql import functions as F

from searchlift.functions import urls

BASES = ["https://www.Example.com", "https://www.example.com/", "http://example.com/a/b/c?x=1", "https://shop.example.com/d/e.html#f", "https://example.com:8080/a/"]
HOSTS = ["www.example.com", "Example.COM:443", "other.org", "example.com.", "u:p@example.com", "shop.example.com:80", "example.com:8080", "example.com:99999"]
ODD = ["mailto:a@b.c", "javascript:void(0)", "tel:1", "data:x", "ftp://example.com/x", "https:rel/x", " /sp ", "http:", "https://", "//", "", " ", "#", "?"]


def drawn(n):
    d = random.Random(11)
    path = lambda: "/".join(d.choice(("a", "b.html", "..", ".", "", "c d", "x.PDF", "é", "...", "list.tar.gz")) for _ in range(d.randrange(6)))
    query = lambda: d.choice(("", "", "?a=1&utm_source=x", "?b=2&a=%20z&a=1", "?FBCLID=1", "?q=a+b*c~d&&e", "?x=%zz", "?é=ü"))
    for i in range(n):
        kind, fragment = d.randrange(7), d.choice(("", "#top"))
        head = {0: d.choice(("https://", "HTTP://", "//")) + d.choice(HOSTS) + "/", 1: d.choice(("https://", "//")) + d.choice(HOSTS), 2: "/", 3: "", 4: "../" * d.randrange(4), 5: "", 6: ""}[kind]
        ref = d.choice(ODD) if kind == 6 else head + (path() if kind in (0, 2, 3, 4) else "") + query() + fragment
        yield i, d.choice(BASES), ref, d.choice(("example.com", "www.example.com", "shop.example.com"))


def test_links_and_references(spark):
    rows = list(drawn(5000))
    df = spark.createDataFrame(rows, "i int, base string, ref string, site string")
    got = {r.i: r for r in df.select("i", urls.page_link(F.col("base"), F.col("ref"), F.col("site")).alias("page"), urls.resolved(F.col("base"), F.col("ref")).alias("whole")).collect()}
    for i, base, ref, site in rows:
        assert got[i].page == urls.normalised(ref, base, site), (base, ref, site)
        # An empty reference has no fragment here, where the plain function keeps the base's; empty segments stay behind dots.
        plain = lambda u: re.sub("(?<!:)/{2,}", "/", u.lower()).rstrip("#").removesuffix("?")
        assert not ref.strip() or plain(got[i].whole) == plain(urljoin(base, ref.strip())), (base, ref)


def test_nulls(spark):
    df = spark.createDataFrame([(None, "/x"), ("https://a.example/", None)], "base string, ref string")
    assert [r[0] for r in df.select(urls.page_link(F.col("base"), F.col("ref"), F.lit("a.example"))).collect()] == [None, None]
