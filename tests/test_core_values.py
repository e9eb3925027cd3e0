"""What the engine's operators once left out, against brute force."""

from __future__ import annotations

import re
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from searchlift.functions.text import STOPWORDS
from searchlift.operators import citations, content, reconcile
from searchlift.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text").collect()


def terms_of(text):
    return [t for t in re.findall("[a-z0-9][a-z0-9-]{2,}", (text or "").lower()) if t not in STOPWORDS and not re.fullmatch("[0-9]+", t)]


def commonest(items, n):
    """The n commonest; ties go to the one that comes first."""
    return Counter(items).most_common(n)


def test_terms_and_gain_of_whole_texts(spark, documents):
    run = lambda name: catalog.queries()[name](spark, SF).collect()
    want = {(d.doc_id, t, n, i + 1) for d in documents for i, (t, n) in enumerate(commonest(terms_of(d.text), 6))}
    assert {(r.page_id, r.term, r.n, r["rank"]) for r in run("whole_term_counts")} == want
    counts = {d.doc_id: Counter(terms_of(d.text)) for d in documents}
    want = {(i, len(c), min(40, sum(n == 1 for n in c.values()))) for i, c in counts.items() if c}
    assert {(r.page_id, r.terms, r.once) for r in run("whole_information_gain")} == want


def test_topics_of_whole_texts(spark, documents):
    want = set()
    for d in documents:
        t = terms_of(d.text)
        two = [f"{a} {b}" for a, b in zip(t, t[1:]) if a != b]
        best = [x for x, _ in commonest(two, 3)] + [x for x, _ in commonest(t, 6)]
        want |= {(d.doc_id, x, i + 1) for i, x in enumerate(best[:8])}
    out = catalog.queries()["whole_page_topics"](spark, SF).collect()
    assert {(r.page_id, r.topic, r["rank"]) for r in out} == want


def test_entities_of_whole_texts(spark, documents):
    find = re.compile(r"\b[A-Z][A-Za-z0-9-]*(?:[ \t-\r]+[A-Z][A-Za-z0-9-]*){0,2}\b")
    want = {(d.doc_id, e, i + 1) for d in documents for i, e in enumerate(list(dict.fromkeys(x for x in find.findall(d.text or "") if len(x) >= 3))[:8])}
    assert {(r.page_id, r.entity, r["rank"]) for r in catalog.queries()["whole_page_entities"](spark, SF).collect()} == want


def test_similar_whole_pages(spark, documents):
    sets, seen = {}, set()
    for d in sorted(documents, key=lambda d: d.doc_id):
        # Documents of a source with the same terms are one class, named by the smallest.
        key = (d.source, frozenset(terms_of(d.text)))
        if key[1] and key not in seen:
            seen.add(key)
            sets[d.doc_id] = (d.source, set(key[1]))
    want = set()
    for a, b in combinations(sorted(sets), 2):
        (sa, ta), (sb, tb) = sets[a], sets[b]
        if sa == sb and len(ta & tb) >= 2 and len(ta & tb) >= 0.18 * len(ta | tb):
            want.add((a, b, len(ta & tb)))
    assert {(r.page_id, r.other_id, r.shared) for r in catalog.queries()["whole_similar_pages"](spark, SF).collect()} == want


def links_by_hand(pages, edges, most):
    """Per site the best links to its orphans, one pair at a time."""
    sets = {i: (site, path, set(terms_of(text)), topics_of(text)) for i, site, path, text in pages}
    linked, found = {(s, d) for s, _, d in edges}, {}
    for a, (site, path, ta, pa) in sets.items():
        for b, (other, target, tb, pb) in sets.items():
            if a == b or site != other or target == "/" or (other, target) in linked or (site, path, target) in edges:
                continue
            n, shared_topics = len(ta & tb), len(pa & pb)
            if n >= 2 or shared_topics:
                sim = n / len(ta | tb)
                found.setdefault(site, []).append((-min(100, 55 + 7 * n + 8 * shared_topics + round(20 * sim)), -min(100, 50 + 8 * n + round(30 * sim)), a, b, n, shared_topics))
    return sorted(x for rows in found.values() for x in sorted(rows)[:most])


def topics_of(text):
    t = terms_of(text)
    two = [f"{a} {b}" for a, b in zip(t, t[1:]) if a != b]
    return set(([x for x, _ in commonest(two, 3)] + [x for x, _ in commonest(t, 6)])[:8])


def test_links_to_orphans_by_terms_or_topics(spark):
    own = lambda k: " ".join(f"only{k}x{i}" for i in range(30))
    # 1 and 2 share a topic and one term, 1 and 3 two rare terms, 4 and 5 a term that is no topic of 5; 6 is of another site; 3 is no orphan, 7 the home page.
    texts = {1: f"seo seo {own(1)} rare last", 2: f"seo seo {own(2)}", 3: f"{own(3)} rare last", 4: f"{own(4)} gone", 5: f"{own(5)} gone", 6: f"seo seo {own(6)}", 7: "seo seo rare last", 8: f"{own(3)} {own(2)}"}
    pages = [(i, "b" if i == 6 else "a", "/" if i == 7 else f"/{i}", t) for i, t in texts.items()]
    edges = [("a", "/1", "/3"), ("b", "/1", "/2"), ("a", "/9", "/8")]
    for most in (100, 3):
        out = content.recommendations(spark.createDataFrame(pages, "page_id long, site string, path string, text string"), spark.createDataFrame(edges, "site string, src string, dst string"), most).collect()
        assert sorted((-r.priority, -r.confidence, r.source_id, r.target_id, r.shared, r.topics) for r in out) == links_by_hand(pages, edges, most)


def test_cited_urls_decide_and_count(spark):
    urls = ["HTTPS://A.com", "https://a.com/#x", "https://a.com/p?q=1#y", " https://a.com?q=1", "ftp://b.com/", "no url"]
    rows = [(1, 1, "p", "the Acme", urls), (1, 2, "p", "the acme", ["ftp://b.com/"]), (1, 3, "p", "Rival", urls), (1, 4, "p", "nobody", None), (2, 1, "p", "acme", None), (2, 2, "p", "acme rival", ["http://c.com/"])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, provider string, text string, cited_urls array<string>").withColumn("prompt", F.col("turn").cast("string"))
    out = citations.analysed(df, ("acme",), ("rival",))
    assert {(r.conv_id, r.turn): r.gap for r in out.collect()} == {(1, 1): "none", (1, 2): "citation_gap", (1, 3): "competitor_gap", (1, 4): "brand_mention_gap", (2, 1): "citation_gap", (2, 2): "none"}
    assert out.where("conv_id = 1 AND turn = 1").first().cited_urls == "https://a.com/ https://a.com/p?q=1 https://a.com/?q=1"
    assert {r.conv_id: (r.mention_rate, r.citation_rate, r.visibility) for r in citations.scan_totals(out).collect()} == {1: (0.5, 0.5, 50), 2: (1.0, 0.5, 85)}
    # A prompt asked again of the same provider takes the place of the older answer; equal gaps are one.
    assert citations.results(out.withColumn("prompt_hash", F.lit("x"))).count() == 2
    assert {(r.gap, r.results, r.priority, r.confidence) for r in citations.gaps(out.withColumn("prompt_hash", F.lit("x"))).collect()} == {("citation_gap", 2, 70, 78), ("competitor_gap", 1, 76, 70), ("brand_mention_gap", 1, 85, 82)}


def test_a_scan_without_gaps_resolves_none(spark):
    g = spark.createDataFrame([("k1", "citation_gap"), ("k2", "brand_mention_gap")], "key string, kind string")
    out = reconcile.runs([g, g.limit(0)], reconcile.GAPS, ["2024-01-01", "2024-01-02"]).collect()
    assert [r.status for r in out] == ["active", "active"]
    out = reconcile.runs([g, g.where("key = 'k1'")], reconcile.GAPS, ["2024-01-01", "2024-01-02"]).collect()
    assert {r.key: r.status for r in out} == {"k1": "active", "k2": "resolved"}


def test_clusters_gather_no_more_than_they_keep(spark, capsys):
    rows = [(i % 400, t) for i in range(800) for t in ("all", f"odd{i % 2}", f"own{i % 400}")]
    out = content.clusters(spark.createDataFrame(rows, "page_id long, topic string"))
    ids = lambda *a: ",".join(map(str, list(range(*a))[:25]))
    assert [tuple(r) for r in out.select("topic", "n", "members").collect()] == [("all", 400, ids(400)), ("odd0", 200, ids(0, 400, 2)), ("odd1", 200, ids(1, 400, 2))]
    capsys.readouterr()
    out.explain()
    assert "WindowGroupLimit" in capsys.readouterr().out
