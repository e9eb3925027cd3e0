"""Pairs of sets in blocks: whole, and without a copy of a block for each block that it meets."""

from __future__ import annotations

import random

import pytest

from searchlift.functions import overlaps

SETS = "page_id string, site string, terms array<string>"


def drawn(n, seed=5):
    draw = random.Random(seed)
    pick = lambda i: [f"c{x}" for x in range(9) if draw.random() < 0.6] + [f"r{draw.randrange(30)}" for _ in range(i % 12)] + [f"own{i}x{x}" for x in range(draw.randrange(9))]
    return [(f"p{i}", draw.choice("xxxy"), list(dict.fromkeys(pick(i)))) for i in range(n)]


@pytest.mark.parametrize(("block", "together", "tile"), [(11, 1, 3), (11, 4, 500), (40, 2, 7), (8000, 4, 500)])
def test_pairs_are_whole(spark, monkeypatch, block, together, tile):
    monkeypatch.setattr(overlaps, "TOGETHER", together)
    rows = drawn(90)
    known = [(i, s, set(t)) for i, s, t in rows]
    want = sorted((a, b, len(ta & tb), len(ta | tb)) for a, sa, ta in known for b, sb, tb in known if a < b and sa == sb and len(ta & tb) >= 3 and len(ta & tb) >= 0.2 * len(ta | tb))
    assert len(want) > 100
    assert sorted(map(tuple, overlaps.overlaps(spark.createDataFrame(rows, SETS), 3, 0.2, block).collect())) == want
    a, b = (overlaps._packed(overlaps.pa.table({"site": ["x"] * len(k), "block": overlaps.pa.array([n] * len(k), overlaps.pa.int32()), "page_id": [r[0] for r in k], "terms": [sorted(r[2]) for r in k]})) for n, k in enumerate((known[:50], known[50:])))
    monkeypatch.setattr(overlaps, "TILE", tile)
    batch = overlaps.pa.RecordBatch.from_pydict({"low": [0, 0], "high": [1, 0], "low_sets": [a["sets"][0].as_py()] * 2, "high_sets": [b["sets"][0].as_py(), a["sets"][0].as_py()]})
    got = sorted(tuple(r.values()) for out in overlaps._met(iter([batch]), 3, 0.2) for r in out.to_pylist())
    both = [(i, j) for i in range(50) for j in range(50, 90)] + [(i, j) for i in range(50) for j in range(i + 1, 50)]
    pairs = [(known[i][0], known[j][0], len(known[i][2] & known[j][2]), len(known[i][2] | known[j][2])) for i, j in both]
    assert got == sorted(p for p in pairs if p[2] >= 3 and p[2] >= 0.2 * p[3])


def test_no_block_is_copied_for_those_it_meets(spark):
    """Sixteen blocks and more: what is dealt out is a row for each, where the copies of their sets would be sixteen times the sets."""
    pairs = overlaps.overlaps(spark.createDataFrame(drawn(90), SETS), 3, 0.2, 5)
    pairs.collect()
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "explode(sequence" not in plan and "terms" not in plan


def test_large_sets_at_the_threshold(spark):
    """Sets so large that their sizes have more digits than a float of four bytes are neither lost nor added at the edge."""
    n, shared = 150_000, 45_763
    rows = [("a", "x", [f"t{i}" for i in range(n)]), ("b", "x", [f"t{i}" for i in range(n - shared, 2 * n - shared)]), ("c", "x", [f"t{i}" for i in range(n - shared + 1, 2 * n - shared + 1)])]
    want = [(a[0], b[0]) for k, a in enumerate(rows) for b in rows[k + 1 :] if len(set(a[2]) & set(b[2])) >= 0.18 * len(set(a[2]) | set(b[2]))]
    assert want == [("a", "b"), ("b", "c")]
    packed = overlaps._packed(overlaps.pa.table({"site": ["x"] * 3, "block": overlaps.pa.array([0] * 3, overlaps.pa.int32()), "page_id": [r[0] for r in rows], "terms": [sorted(r[2]) for r in rows]}))["sets"][0].as_py()
    batch = overlaps.pa.RecordBatch.from_pydict({"low": [0], "high": [0], "low_sets": [packed], "high_sets": [packed]})
    assert [(r["page_id"], r["other_id"]) for out in overlaps._met(iter([batch]), 2, 0.18) for r in out.to_pylist()] == want
