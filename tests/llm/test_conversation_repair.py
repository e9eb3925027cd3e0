"""Conversation repair against a plain search that carries whole audits, and against every audit of short conversations."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from searchlift.llm import conversation_repair as cr
from searchlift.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        deal = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if deal == 1:
            text = ""
        if deal == 2:
            text = re.sub("[.!?]", "", text)
        if deal == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if deal == 0 else 2 if deal == 3 else 1)
    return out


def faults(rows):
    """rows of a conversation in order -> fault of each: B, Q, T or -."""
    seen, out = set(), []
    for _, _, role, text in rows:
        said = text.strip(BLANK)
        out.append("B" if not said else "Q" if (role, text) in seen else "T" if said[-1] not in ".!?" else "-")
        seen.add((role, text))
    return out


STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows, fault):
    """(cost, audit) by letters: best (cost, audit) of each state after each row, inserts tried one at a time."""

    def inserted(best):
        for _ in range(3):
            for q, (cost, audit) in list(best.items()):
                to = STEP[q, "a" if q == "u" else "u"]
                best[to] = min(best.get(to, (1 << 60, "")), (cost + 5, audit + "I"))
        return best

    best = {"": (0, "")}
    for (_, _, role, _), f in zip(rows, fault):
        after = {}
        for q, (cost, audit) in inserted(dict(best)).items():
            found = [(q, cost + 2, audit + "D")]
            if f in "T-":
                more = 5 * (f == "T")
                found += [(STEP[q, role[:1]], cost + more, audit + "K")] if (q, role[:1]) in STEP else []
                found += [(STEP[q, "a" if q == "u" else "u"], cost + 1 + more, audit + "R")]
            for to, c, a in found:
                after[to] = min(after.get(to, (1 << 60, "")), (c, a))
        best = after
    return min(v for q, v in inserted(best).items() if q in ("", "a"))


def replay(rows, audit):
    """The lines that an audit leaves."""
    out, q, left = [], "", list(rows)
    for edit in audit:
        want = "a" if q == "u" else "u"
        if edit == "I":
            out.append({"u": "user:", "a": "assistant:"}[want])
        else:
            _, _, role, text = left.pop(0)
            if edit == "D":
                continue
            want = role[:1] if edit == "K" else want
            out.append((role if edit == "K" else {"u": "user", "a": "assistant"}[want]) + ":" + text)
        q = STEP[q, want]
    assert not left and q in ("", "a")
    return out


def plain(rows, conv):
    rows = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    f = faults(rows)
    cost, audit = cheapest(rows, f)
    turns = {r[1] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (conv, gaps, f.count("B"), f.count("Q"), f.count("T"), illegal, cost, audit, hashlib.sha256("\n".join(replay(rows, audit)).encode()).hexdigest())


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_the_query_over_all_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    hurt = damage(rows)
    got = sorted(tuple(r) for r in queries()["op13_conversation_repair"](spark, SF).select(*COLUMNS).collect())
    assert got == sorted(plain(hurt, c) for c in {r[0] for r in rows})
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS FROM '{SF}/conversations.parquet'")
    assert got == sorted(c.execute(f"SELECT {', '.join(COLUMNS)} FROM ({oracle_sql()['op13_conversation_repair']})").fetchall())


def drawn(seed, conversations, most):
    draw = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "cut  ", " \t", "", "Well. ", "a", "b."]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", ""]
    return [(c, draw.choice((None, *range(most))), draw.choice(roles), draw.choice(texts)) for c in range(conversations) for _ in range(draw.randrange(most + 1))]


@pytest.mark.parametrize("block", [1, 2, 5, 1024])
def test_blocks_do_not_show(spark, monkeypatch, block):
    monkeypatch.setattr(cr, "BLOCK", block)
    rows = drawn(block, 60, 14)
    out, lines = cr.repair(spark.createDataFrame(rows, SCHEMA))
    assert sorted(tuple(r) for r in out.select(*COLUMNS).collect()) == sorted(plain(rows, c) for c in {r[0] for r in rows})
    said = {}
    for r in lines.orderBy("conv_id", "place").collect():
        said.setdefault(r.conv_id, []).append(r.line)
    assert {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in said.items()} == {r.conv_id: r.repaired_sha256 for r in out.collect() if r.conv_id in said}


def test_every_audit_of_short_conversations():
    """No audit of up to five letters is cheaper, or as cheap and less, and legal."""
    draw = random.Random(3)
    for _ in range(150):
        turns = [(draw.choice("suax"), draw.choice("-T-BQ"), 1) for _ in range(draw.randrange(4))]
        rows = [(0, i, initial, "") for i, (initial, _, _) in enumerate(turns)]
        found = []
        for n in range(len(turns), 6):
            for letters in itertools.product("DIKR", repeat=n):
                edits = [e for e in letters if e != "I"]
                if len(edits) != len(turns) or any(t[1] in "BQ" and e != "D" for e, t in zip(edits, turns)):
                    continue
                try:
                    replay(rows, letters)
                except (KeyError, AssertionError):
                    continue
                cost = sum({"K": 0, "R": 1, "D": 2, "I": 5}[e] for e in letters) + sum(5 for e, t in zip(edits, turns) if e != "D" and t[1] == "T")
                found.append((cost, "".join(letters)))
        assert cheapest(rows, [t[1] for t in turns]) == min(found)
        ends = cr.solve(turns, (cr.START,))[-1].ends
        cost, _, q = min((c + 5 * cr.TAIL[q], r, q) for (_, q), (c, r) in ends.items())
        way = cr.trace(cr.solve(turns, (cr.START,)), cr.START, q)
        assert (cost, "".join(cr.spelled(code, t[1], t[2]) for (_, code), t in zip(way, turns)) + "I" * cr.TAIL[q]) == min(found)


def test_codes_are_prefix_free_and_in_order():
    assert list(cr.CODES) == sorted(cr.CODES)
    assert not any(a != b and b.startswith(a) for a in cr.CODES for b in cr.CODES)


def test_edges(spark):
    rows = [(None, None, None, None), (None, None, None, None), (None, 1, "user", "Hi."), (1, 5, "user", "Hello. " * 40_000), (1, 9, "assistant", "Fine."), (2, 1, "assistant", "x."), (2, 1, "assistant", "x."), (2, 1, "assistant", "x.")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"audit": F.lit("x"), "Place": F.lit(1)})
    clean = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    got = sorted((tuple(r) for r in cr.repair(df)[0].select(*COLUMNS).collect()), key=str)
    assert got == sorted((plain(clean, c) for c in (None, 1, 2)), key=str)
    assert cr.repair(df.where("false"))[0].count() == 0


def test_conversations_without_a_row_left(spark, tmp_path):
    gone = [(c, t, "user", "Hi.") for c in range(40) for t in range(40) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:3]
    spark.createDataFrame(gone + [(None, 3, "user", "Hi."), (None, 4, "assistant", "Ho.")], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in cr.op13(spark, str(tmp_path)).collect()}
    none = hashlib.sha256(b"").hexdigest()
    assert set(got) == {r[0] for r in gone} | {None}
    assert all(tuple(got[r[0]])[1:] == (0, 0, 0, 0, 0, 0, "", none) for r in gone)
    hurt = damage([(None, 3, "user", "Hi."), (None, 4, "assistant", "Ho.")])
    assert tuple(got[None].asDict()[c] for c in COLUMNS) == plain(hurt, None)
