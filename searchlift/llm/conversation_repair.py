"""Repair of conversation structure by a rank-compressed dynamic programme.

A repaired conversation has the role initials (s?(ua)+)?, which an automaton of four states reads. The
edits of a turn are macros, a run of inserts and then the turn's own edit; they are prefix-free codes
whose order is that of their letters, so audits of as many turns compare macro by macro. A state of a
layer therefore keeps its cost, the rank of its audit among those of the layer, and a pointer to its
parent; no audit is spelled until the cheapest end is known.

A conversation may hold a third of all rows, so it is cut in blocks of 1,024 rows of the sorted table.
A block is solved from all four states at once, with one ranking over all its ends (16 at most); blocks
are then composed in order, four states and four pointers for each, and each block spells its own audit
once its two ends are known. What stays in one task for a conversation is one line of output by
definition: the composition of its blocks (about 300 bytes each) and the digest of its repaired text,
which are streamed in order and never held.

Defined results: null roles and texts count as one space; a null conversation is a conversation of its
own; null turns come first; rows of one turn are ordered by role and text; equal rows of one turn are one
row with a count in the programme; empty and very long texts need nothing special; other columns aren't
read, so none can clash; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from searchlift.llm.common import join_groups, materialise, table

#: Characters of white space in the contracts, and costs of the edits.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Start, after a system turn, after a user turn, after an assistant turn; and where each initial leads.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ROLES = {"u": "user", "a": "assistant"}
#: Inserts that complete what ends in a state.
TAIL = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
#: Macros in order of their letters. Two inserts lead from any state to any other that inserts reach, and an insert before a deleted turn is never least.
CODES = tuple(sorted("I" * n + edit for n in range(3) for edit in "DKR" if not (n and edit == "D")))
BLOCK = 1024


def wanted(state: int) -> str:
    """The initial that an inserted or reroled turn takes."""
    return "a" if state == USER else "u"


def _moves(initial: str, truncated: bool) -> list[list[tuple[int, int, int]]]:
    """For each state the (code, cost, state after) of a turn that need not be deleted."""
    out = []
    for state in STATES:
        moves = []
        for code, letters in enumerate(CODES):
            at = state
            for _ in letters[:-1]:
                at = NEXT[at, wanted(at)]
            cost = INSERT * (len(letters) - 1)
            if letters[-1] == "D":
                moves.append((code, DELETE, at))
            else:
                after = NEXT.get((at, initial if letters[-1] == "K" else wanted(at)))
                if after is not None:
                    moves.append((code, cost + (letters[-1] == "R") * REROLE + truncated * TRUNCATED, after))
        out.append(moves)
    return out


MOVES = {(i, t): _moves(i, t) for i in "suax" for t in (False, True)}


@dataclass
class Layer:
    """Ends of audits: (state at the block's start, state now) -> cost and rank; and how each came about."""

    ends: dict[tuple[int, int], tuple[int, int]]
    parents: dict[tuple[int, int], tuple[int, int]] = field(default_factory=dict)  # (state before, code)


def solve(turns: list[tuple[str, str, int]], starts=STATES) -> list[Layer]:
    """Layers over turns (initial, fault, copies), the first of them before any turn.

    fault: B and Q are deleted, T is truncated; copies after the first are repetitions, deleted too.
    """
    layers = [Layer({(p, p): (0, 0) for p in starts})]
    for initial, fault, copies in turns:
        old = layers[-1].ends
        if fault in "BQ":
            # One code alone: states and ranks stay.
            layers.append(Layer({e: (cost + DELETE * copies, rank) for e, (cost, rank) in old.items()}, {e: (e[1], 0) for e in old}))
            continue
        moves, best = MOVES[initial, fault == "T"], {}
        for (start, state), (cost, rank) in old.items():
            for code, price, after in moves[state]:
                key = (cost + price, rank, code)
                if (start, after) not in best or key < best[start, after][0]:
                    best[start, after] = (key, state)
        ranks = {pair: n for n, pair in enumerate(sorted({key[1:] for key, _ in best.values()}))}
        more = DELETE * (copies - 1)
        layers.append(Layer({e: (key[0] + more, ranks[key[1:]]) for e, (key, _) in best.items()}, {e: (state, key[2]) for e, (key, state) in best.items()}))
    return layers


def trace(layers: list[Layer], start: int, end: int) -> list[tuple[int, int]]:
    """(state before, code) of each turn on the least of the cheapest ways from start to end."""
    out = []
    for layer in reversed(layers[1:]):
        state, code = layer.parents[start, end]
        out.append((state, code))
        end = state
    return out[::-1]


def spelled(code: int, fault: str, copies: int) -> str:
    return "D" * copies if fault in "BQ" else CODES[code] + "D" * (copies - 1)


def written(state: int, code: int, fault: str) -> tuple[list[str], str | None]:
    """Roles inserted before a turn, and the turn's own role: None if it is deleted, '' if it keeps its own."""
    letters = "D" if fault in "BQ" else CODES[code]
    before = []
    for _ in letters[:-1]:
        before.append(ROLES[wanted(state)])
        state = NEXT[state, wanted(state)]
    return before, {"D": None, "K": "", "R": ROLES[wanted(state)]}[letters[-1]]


def compose(ends: dict[int, tuple[int, int]], block: dict[tuple[int, int], tuple[int, int]]) -> tuple[dict[int, tuple[int, int]], bytes]:
    """The states after one more block, (cost, rank) each, and the parent of each state (9: none)."""
    best = {}
    for (p, q), (price, place) in block.items():
        if p in ends:
            key = (ends[p][0] + price, ends[p][1], place)
            if q not in best or key < best[q][0]:
                best[q] = (key, p)
    ranks = {pair: n for n, pair in enumerate(sorted({key[1:] for key, _ in best.values()}))}
    return {q: (key[0], ranks[key[1:]]) for q, (key, _) in best.items()}, bytes(best[q][1] if q in best else 9 for q in STATES)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) with the faults that the digest of conversation and turn deals out."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    deal = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    dealt = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), deal.alias("deal")).where("deal <> 0")
    text = F.when(F.col("deal") == 1, "").when(F.col("deal") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    again = F.explode(F.when(F.col("deal") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return dealt.select("conv_id", "turn", F.when(F.col("deal") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), again.alias("again")).drop("again")


def placed(rows: DataFrame) -> DataFrame:
    """Distinct rows with copies, initial, fault (B, Q, T or -) and their place in the order of conversations and turns, written once."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    one = rows.select("conv_id", "turn", space("role"), space("text")).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    said = F.sha2(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.col("conv_id").isNull().cast("string"), F.length("role").cast("string"), "role", "text"), 256)
    one = materialise(one.withColumn("said", said), "turns")
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = one.groupBy("said").agg(F.count("*").alias("size"), F.min(order).alias("first"))
    repeated = join_groups(one, firsts, "said", "size", one.count()).withColumn("repeated", order != F.col("first"))
    blank = F.length(F.ltrim("text", F.lit(BLANKS))) == 0
    fault = F.when(blank, "B").when(F.col("repeated"), "Q").when(~F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1)).isin(".", "!", "?"), "T").otherwise("-")
    first = F.left("role", F.lit(1))
    known = repeated.select("conv_id", "turn", "role", "text", "copies", first.alias("letter"), F.when(first.isin("s", "u", "a"), first).otherwise("x").alias("initial"), fault.alias("fault"))
    in_order = known.repartitionByRange("conv_id", "turn", "role", F.left("text", F.lit(64))).sortWithinPartitions("conv_id", "turn", "role", "text")
    return materialise(in_order.withColumn("place", F.monotonically_increasing_id()), "turns-in-order")


BLOCK_ROW = "conv_id {conv}, block bigint, ends array<struct<p:int,q:int,cost:bigint,rank:int>>, rows bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_letter string, last_letter string, first_turn bigint, last_turn bigint, turns bigint"


def _summary(turns: list[dict]) -> dict:
    """What composition needs of a block of turns (turn, letter, initial, fault, copies) in order."""
    ends = solve([(t["initial"], t["fault"], t["copies"]) for t in turns])[-1].ends
    known = [t["turn"] for t in turns if t["turn"] is not None]
    letters = [t["letter"] for t in turns]
    n = {f: sum(t["copies"] for t in turns if t["fault"] == f) for f in "BQ"}
    return {
        "ends": [{"p": p, "q": q, "cost": c, "rank": r} for (p, q), (c, r) in ends.items()],
        "rows": sum(t["copies"] for t in turns),
        "blank": n["B"],
        "duplicate": n["Q"] + sum(t["copies"] - 1 for t in turns if t["fault"] in "-T"),
        "truncated": sum(t["fault"] == "T" for t in turns),
        "illegal": sum(not legal(a, b) for a, b in zip(letters, letters[1:])) + sum(t["copies"] - 1 for t in turns),
        "first_letter": letters[0],
        "last_letter": letters[-1],
        "first_turn": known[0] if known else None,
        "last_turn": known[-1] if known else None,
        "turns": len(set(known)),
    }


def legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 2_000) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for start in range(0, b.num_rows, 1_000):
            yield from b.slice(start, 1_000).to_pylist()


def _by_arrow(df: DataFrame, each, schema: str) -> DataFrame:
    """df through a generator of rows, which sees the rows of its partition in order."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(lambda batches: _batches(each(_rows(batches)), arrow), schema)


def _composed(blocks: Iterator[dict]) -> Iterator[dict]:
    """Blocks of conversations in order -> each with its two ends; the last of a conversation has its figures."""

    def finished(conv, keys, parents, ends, s):
        end = min((cost + INSERT * TAIL[q], rank, q) for q, (cost, rank) in ends.items())
        at, ways = end[2], []
        for i in reversed(range(len(keys))):
            before = parents[4 * i + at]
            ways.append((before, at))
            at = before
        gaps = s["last_turn"] - s["first_turn"] + 1 - s["turns"] if s["turns"] else 0
        figures = {c: s[c] for c in ("blank", "duplicate", "truncated", "illegal")} | {"gaps": gaps, "cost": end[0], "tail": TAIL[end[2]]}
        for i, (key, (p, q)) in enumerate(zip(keys, reversed(ways))):
            yield {"conv_id": conv, "block": key, "p": p, "q": q} | (figures if i == len(keys) - 1 else {})

    state = None
    for b in blocks:
        if state is None or state[0] != b["conv_id"]:
            if state:
                yield from finished(*state)
            state = (b["conv_id"], [], bytearray(), {START: (0, 0)}, None)
        conv, keys, parents, ends, s = state
        ends, above = compose(ends, {(e["p"], e["q"]): (e["cost"], e["rank"]) for e in b["ends"]})
        keys.append(b["block"])
        parents += above
        if s:
            b["illegal"] += s["illegal"] + (not legal(s["last_letter"], b["first_letter"]))
            for c in ("blank", "duplicate", "truncated"):
                b[c] += s[c]
            if s["turns"]:
                b["turns"] += s["turns"] - (s["last_turn"] == b["first_turn"])
                b["first_turn"] = s["first_turn"]
                b["last_turn"] = s["last_turn"] if b["last_turn"] is None else b["last_turn"]
        state = (conv, keys, parents, ends, b)
    if state:
        yield from finished(*state)


def _spelled(blocks: Iterator[dict]) -> Iterator[dict]:
    """Blocks with their ends -> the audit of each and what becomes of each of its rows."""
    for b in blocks:
        turns = [(t["initial"], t["fault"], t["copies"]) for t in b["turns"]]
        way = trace(solve(turns, (b["p"],)), b["p"], b["q"])
        edits = [written(state, code, t[1]) for (state, code), t in zip(way, turns)]
        audit = "".join(spelled(code, t[1], t[2]) for (_, code), t in zip(way, turns))
        yield {"conv_id": b["conv_id"], "block": b["block"], "first": b["turns"][0]["place"], "audit": audit, "edits": [{"before": "".join(r + ":\n" for r in before), "role": role} for before, role in edits]}


def _digests(lines: Iterator[dict]) -> Iterator[dict]:
    """Lines of conversations in order -> the sha256 of each conversation's lines."""
    conv, digest, seen = None, None, False
    for line in lines:
        if digest is None or line["conv_id"] != conv:
            if digest is not None:
                yield {"conv_id": conv, "repaired_sha256": digest.hexdigest()}
            conv, digest, seen = line["conv_id"], hashlib.sha256(), False
        digest.update((("\n" if seen else "") + line["line"]).encode())
        seen = True
    if digest is not None:
        yield {"conv_id": conv, "repaired_sha256": digest.hexdigest()}


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, turn, role, text) -> one row for each with its figures, cost, audit and digest; and the repaired turns (conv_id, place, line), in order of place."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    turns = placed(rows).withColumn("block", F.expr(f"place div {BLOCK}"))
    slim = F.struct("place", F.col("turn").cast("bigint").alias("turn"), "letter", "initial", "fault", "copies")
    blocks = turns.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(slim)).alias("turns"))
    summaries = _by_arrow(blocks, lambda rs: ({"conv_id": r["conv_id"], "block": r["block"]} | _summary(r["turns"]) for r in rs), BLOCK_ROW.format(conv=kind))
    in_order = summaries.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    ways = materialise(_by_arrow(in_order, _composed, f"conv_id {kind}, block bigint, p int, q int, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, tail int"), "ways")
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"]) & (a["block"] == b["block"])
    open_ = blocks.join(ways.select("conv_id", "block", "p", "q"), same(blocks, ways)).select(blocks["conv_id"], blocks["block"], "turns", "p", "q")
    spelt = materialise(_by_arrow(open_, _spelled, f"conv_id {kind}, block bigint, first bigint, audit string, edits array<struct<before:string,role:string>>"), "audits")
    ends = ways.where("tail IS NOT NULL")
    tails = ends.where("tail > 0").select("conv_id", F.lit(2**63 - 1).alias("place"), F.when(F.col("tail") == 2, "user:\nassistant:").otherwise("assistant:").alias("line"))
    edit = F.get(F.col("edits"), (F.col("place") - F.col("first")).cast("int"))
    kept = turns.where("fault NOT IN ('B', 'Q')").select("conv_id", "block", "place", "role", "text")
    met = kept.join(spelt.select("conv_id", "block", "first", "edits"), same(kept, spelt)).select(kept["conv_id"], "place", "text", kept["role"], edit.alias("edit")).where("edit.role IS NOT NULL")
    lines = met.select("conv_id", "place", F.concat("edit.before", F.when(F.col("edit.role") == "", F.col("role")).otherwise(F.col("edit.role")), F.lit(":"), "text").alias("line")).unionByName(tails)
    digests = _by_arrow(lines.repartition("conv_id").sortWithinPartitions("conv_id", "place"), _digests, f"conv_id {kind}, repaired_sha256 string")
    audits = spelt.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda x: x.audit), "").alias("audit"))
    out = ends.join(audits, ends["conv_id"].eqNullSafe(audits["conv_id"])).select(ends["conv_id"], "gaps", "blank", "duplicate", "truncated", "illegal", "cost", F.concat("audit", F.repeat(F.lit("I"), F.col("tail"))).alias("audit"))
    out = out.join(digests, out["conv_id"].eqNullSafe(digests["conv_id"]), "left").select(out["*"], F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
    return out, lines


def op13(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    found, _ = repair(damaged(rows))
    all_ = rows.select("conv_id").distinct()
    figures = [F.coalesce(found[c], F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return all_.join(found, all_["conv_id"].eqNullSafe(found["conv_id"]), "left").select(all_["conv_id"], *figures, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _oracle() -> str:
    """The same by recursion over the turns: each state carries cost (nine digits), audit and lines as one text, so that the least text is the choice."""
    mark = "strpos({s}, chr(1))"

    def add(s: str, price: str, letter: str, line: str) -> str:
        at = mark.format(s=s)
        return f"lpad(CAST(CAST(left({s}, 9) AS INT) + {price} AS VARCHAR), 9, '0') || substr({s}, 10, {at} - 10) || '{letter}' || substr({s}, {at}) || {line}"

    line = "chr(10) || {role} || ':' || text".format
    to_user, to_assistant = line(role="'user'"), line(role="'assistant'")
    empty_user, empty_assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    keep = lambda initial, s: f"CASE WHEN NOT gone AND left(role, 1) = '{initial}' THEN {add(s, 'more', 'K', line(role='role'))} END"
    rerole = lambda s, line: f"CASE WHEN NOT gone THEN {add(s, '1 + more', 'R', line)} END"
    delete = lambda s: add(s, "2", "D", "''")
    inserted = lambda source: (
        f"(SELECT *, least(s3, {add('t2', '5', 'I', empty_assistant)}) AS t3 FROM (SELECT *, least(s2, {', '.join(add(s, '5', 'I', empty_user) for s in ('s0', 's1', 's3'))}) AS t2 FROM {source}))"
    )
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    byte = "list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, _: xor(a >> 1, (a & 1) * 3988292384))"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({key}, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda crc, b: {byte}), 4294967295)"
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""WITH RECURSIVE dealt AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS deal FROM conversations),
hurt AS (SELECT conv_id, turn, CASE WHEN deal = 4 THEN 'user' ELSE role END AS role, CASE deal WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN deal = 3 THEN 2 ELSE 1 END)) AS again FROM dealt WHERE deal <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS i FROM hurt),
seen AS (SELECT *, trim(text, {white}) = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS said, right(rtrim(text, {white}), 1) NOT IN ('.', '!', '?') AS cut, left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair FROM placed),
judged AS (SELECT *, NOT blank AND said AS duplicate, NOT blank AND NOT said AND cut AS truncated, blank OR said AS gone, CASE WHEN cut THEN 5 ELSE 0 END AS more FROM seen),
walk AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, '000000000' || chr(1) AS s0, CAST(NULL AS VARCHAR) AS s1, CAST(NULL AS VARCHAR) AS s2, CAST(NULL AS VARCHAR) AS s3 FROM (SELECT DISTINCT conv_id FROM judged)
UNION ALL SELECT conv_id, i, {delete('s0')}, least({delete('s1')}, {keep('s', 's0')}), least({delete('t2')}, {keep('u', 'before_user')}, {rerole('before_user', to_user)}), least({delete('t3')}, {keep('a', 't2')}, {rerole('t2', to_assistant)})
 FROM (SELECT *, least(s0, s1, t3) AS before_user FROM {inserted("(SELECT j.conv_id, j.i, j.role, j.text, j.gone, j.more, s0, s1, s2, s3 FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1)")})),
best AS (SELECT conv_id, least(s0, t3) AS s FROM {inserted("(SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)")}),
figures AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(CAST(left(s, 9) AS INT), 0) AS BIGINT) AS cost,
 coalesce(substr(s, 10, {mark.format(s='s')} - 10), '') AS audit, sha256(coalesce(substr(s, {mark.format(s='s')} + 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN figures f ON a.conv_id IS NOT DISTINCT FROM f.conv_id LEFT JOIN best b ON a.conv_id IS NOT DISTINCT FROM b.conv_id"""


ORACLE_OP13 = _oracle()
