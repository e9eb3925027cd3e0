"""The semantic graph's bounds are those of a site."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from searchlift.functions import overlaps
from searchlift.operators import content


def test_bounds_of_a_site(spark):
    texts = spark.createDataFrame([(i, "small" if i < 5 else "large") for i in range(400)], "page_id long, site string")
    topics = spark.createDataFrame([(i, f"t{i}-{r}", r) for i in range(400) for r in range(1, 9)], "page_id long, topic string, rank int")
    pairs = [(a, b, 2, 0.5) for a in range(4) for b in range(a + 1, 5)] + [(a, b, 2, 0.25) for a in range(5, 45) for b in range(a + 1, 45)]
    similar = spark.createDataFrame(pairs, "page_id long, other_id long, shared long, similarity double")
    n = Counter((r.site, r.kind) for r in content.graph_edges(texts, topics, similar).collect())
    assert n == {("small", "covers"): 30, ("small", "related"): 10, ("large", "covers"): 1500}
    few = content.graph_edges(texts, topics.where("page_id < 65"), similar).collect()
    assert Counter((r.site, r.kind) for r in few) == {("small", "covers"): 30, ("small", "related"): 10, ("large", "covers"): 360, ("large", "related"): 140}
    related = sorted((int(r.source), int(r.target)) for r in few if r.site == "large" and r.kind == "related")
    assert related == sorted((a, b) for a, b, *_ in pairs if a >= 5)[:140]


TEXTS = "page_id long, site string, path string, text string"
NO_EDGES = "site string, src string, dst string"


def drawn(seed, n):
    draw = random.Random(seed)
    words = [f"word{chr(97 + i)}" for i in range(14)]
    return [(i, draw.choice("xy"), f"/{i}", " ".join(draw.sample(words, draw.randrange(1, 11)))) for i in range(n)]


def test_rounds_do_not_show(spark):
    """Whatever the first round looks at, the best links and the first similar pages are those of one look at all."""
    texts, edges = spark.createDataFrame(drawn(1, 60), TEXTS), spark.createDataFrame([("x", "/1", "/2")], NO_EDGES)
    rows = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()))
    whole = rows(content.recommendations(texts, edges, most=20, first=1000))
    assert len(whole) == 40 and rows(content.recommendations(texts, edges, most=20, first=2)) == whole
    pairs = content.similar_pages(texts).join(texts.select("page_id", "site"), "page_id").collect()
    want = sorted(p for s in "xy" for p in sorted((r.page_id, r.other_id) for r in pairs if r.site == s)[:30])
    assert sorted((r.page_id, r.other_id) for r in content.first_similar(texts, 30, first=2).collect()) == want


def test_a_site_of_like_pages_looks_at_few_pairs(spark, monkeypatch):
    """Pages of one template that differ in one term each: the first round settles the site, with 64 pairs for each page."""
    looked = []
    in_rounds = content.in_rounds

    def counted(pages, look, *rest, **options):
        return in_rounds(pages, lambda some: (lambda found: looked.append(found.count()) or found)(look(some)), *rest, **options)

    monkeypatch.setattr(content, "in_rounds", counted)
    n = 1500
    same = " ".join(f"common{c}" for c in "abcdefghijkl")
    texts = spark.range(n).select(F.col("id").alias("page_id"), F.lit("s").alias("site"), F.format_string("/%d", "id").alias("path"), F.concat(F.lit(same + " own"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("text"))
    best = content.recommendations(texts, spark.createDataFrame([], NO_EDGES)).collect()
    assert [(r.source_id, r.target_id) for r in sorted(best, key=lambda r: r.rank)] == [(0, i) for i in range(1, 101)]
    assert looked == [64 * (n - 1)]
    looked.clear()
    assert sorted((r.page_id, r.other_id) for r in content.first_similar(texts, 500).collect()) == [(0, i) for i in range(1, 501)] and len(looked) == 1


def test_sites_full_of_topics_are_not_searched_for_similar_pages(spark):
    rows = [(i, "full", f"alpha beta gamma delta{i} epsilon zeta") for i in range(84)] + [(i, "small", "alpha beta gamma delta epsilon") for i in (100, 101)] + [(102, "small", "alpha beta gamma delta omega")]
    texts = spark.createDataFrame(rows, "page_id long, site string, text string")
    topics = content.topics(texts)
    room = content.texts_with_room(texts, topics)
    assert {r.site for r in room.select("site").distinct().collect()} == {"small"}
    want = content.graph_edges(texts, topics, content.similar_pages(texts)).collect()
    got = content.graph_edges(texts, topics, content.first_similar(room, content.RELATED_UNTIL)).collect()
    assert sorted(got) == sorted(want) and sum(r.kind == "related" for r in got) == 1


def test_terms_of_a_row_and_of_repeated_ids(spark):
    once = [(1, "Beta alpha beta 123 alpha gamma the x9 alpha-beta Beta"), (2, None), (3, ""), (None, "beta beta alpha")]
    again = [(4, "beta alpha"), (4, "alpha gamma gamma beta")]
    frame = lambda rows: spark.createDataFrame([(i, "a", t) for i, t in rows], "page_id long, site string, text string")
    out = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    both = content.term_counts(frame(once + again))
    assert [r[1:] for r in out(both) if r[0] == 1] == [("alpha", 2, 2), ("alpha-beta", 1, 4), ("beta", 3, 1), ("gamma", 1, 3)] and [r[1] for r in out(both) if r[0] == 4] == ["alpha", "beta", "gamma"]
    # Without ids that repeat nothing is shuffled by terms, and the rows are the same.
    alone = content.term_counts(frame(once))
    assert "Window" not in alone._jdf.queryExecution().toString() and out(alone) == [r for r in out(both) if r[0] != 4]
    assert out(content.topics(frame(once))) == [r for r in out(content.topics(frame(once + again))) if r[0] != 4]


def test_blocks_do_not_show(spark):
    """Pairs of any blocks are those of one pair of sets at a time; terms that many and few pages have count alike, and no term is shuffled."""
    draw = random.Random(3)
    pick = lambda i: [f"c{x}" for x in range(12) if draw.random() < 0.7] + [f"r{draw.randrange(40)}" for _ in range(i % 9)] + [f"own{i}x{x}" for x in range(draw.randrange(30))]
    rows = [(i, draw.choice("xxxxy") if i % 31 else None, list(dict.fromkeys(pick(i)))) for i in range(240)] + [(None, "x", ["c1", "c2"]), (900, "z", ["c1"]), (901, "y", [])]
    sets = spark.createDataFrame(rows, "page_id long, site string, terms array<string>").repartition(4)
    known = [(i, s, set(t)) for i, s, t in rows if i is not None and s]
    want = sorted((a, b, len(ta & tb), len(ta | tb)) for a, sa, ta in known for b, sb, tb in known if a < b and sa == sb and len(ta & tb) >= 2 and len(ta & tb) >= 0.3 * len(ta | tb))
    assert 100 < len(want) < 20_000
    for block in (17, 90, 8000):
        assert sorted(map(tuple, overlaps.overlaps(sets, 2, 0.3, block).collect())) == want
    texts = spark.createDataFrame(drawn(1, 60), TEXTS)
    assert "Generate explode(terms" not in content.similar_pages(texts)._jdf.queryExecution().toString()


def test_few_sources_are_broadcast(spark, monkeypatch):
    """Broadcast or met by shuffled terms, the links are the same; with few sources no exchange deals terms."""
    texts, edges = spark.createDataFrame(drawn(5, 80), TEXTS), spark.createDataFrame([("x", "/1", "/2"), ("y", "/3", "/4")], NO_EDGES)
    seen = []
    in_rounds = content.in_rounds

    def watched(pages, look, *rest, **options):
        return in_rounds(pages, lambda some: (lambda found: seen.append(found._jdf.queryExecution().executedPlan().toString()) or found)(look(some)), *rest, **options)

    monkeypatch.setattr(content, "in_rounds", watched)
    rows = lambda: sorted(map(tuple, content.recommendations(texts, edges, most=20, first=3).collect()))
    few = rows()
    assert len(few) == 40 and not any("hashpartitioning(site#" in line and ", by#" in line for plan in seen for line in plan.splitlines())
    seen.clear()
    monkeypatch.setattr(content, "BROADCAST_SOURCES", 0)
    assert rows() == few and seen
