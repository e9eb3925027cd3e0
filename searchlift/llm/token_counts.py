"""Edit-aware token counts.

A text is cut into pre-tokens (the tokenizer's own pattern), whose token counts add up to the
text's. A document keeps a segment tree over them: each leaf has up to LEAF pre-tokens, each node
the characters and tokens below it. An edit walks the tree to the last pre-token boundary
before it, splits the new text again from there until a boundary of the old text is met again
past the edit, counts those pre-tokens alone, and updates the sums on their leaves' paths.

Defined results: null counts as the empty text with 0 tokens; very long texts keep one tree, in
memory linear in the text; edits out of range are cut to the text; edits of one document apply in
the order given, each to the outcome of those before; empty tables give no rows; repeated rows give
equal rows; columns other than the text are passed over.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import zip_longest

import pandas as pd
import regex
import tiktoken
from pyspark.sql import Column
from pyspark.sql import functions as F

from searchlift.llm import pii
from searchlift.llm.common import table

#: Fixed value: the pre-token pattern of the public byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEAF = 32
#: Counts of so many pre-tokens are remembered.
REMEMBERED = 400_000


class Counter_(dict):
    """Pre-token -> tokens."""

    def __init__(self, ranks_path: str):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(PATTERN).findall

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(piece))
        if len(self) >= REMEMBERED:
            self.clear()
        if len(piece) <= 64:
            self[piece] = n
        return n


@lru_cache(2)
def counter(ranks_path: str) -> Counter_:
    return Counter_(ranks_path)


class TokenTree:
    """Leaves are lists of pre-tokens; sums[level][i] = (characters, tokens) of node i; the last level is the root."""

    def __init__(self, text: str, count: Counter_):
        self.count = count
        pieces = count.split(text)
        self.n_reencoded = 0
        self.leaves = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        self._build()

    def _build(self) -> None:
        count = self.count
        level = [(sum(map(len, leaf)), sum([count[p] for p in leaf])) for leaf in self.leaves]
        self.sums = [level]
        while len(level) > 1:
            level = [(a[0] + b[0], a[1] + b[1]) for a, b in zip_longest(level[::2], level[1::2], fillvalue=(0, 0))]
            self.sums.append(level)

    @property
    def n_tokens(self) -> int:
        return self.sums[-1][0][1]

    @property
    def n_chars(self) -> int:
        return self.sums[-1][0][0]

    @property
    def n_pretokens(self) -> int:
        return sum(map(len, self.leaves))

    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p in leaf)

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character, and the characters before that leaf."""
        i, before = 0, 0
        for level in reversed(self.sums[:-1]):
            i *= 2
            if place >= before + level[i][0] and i + 1 < len(level):
                before += level[i][0]
                i += 1
        return i, before

    def _refresh(self, leaf: int) -> None:
        """New sums on one leaf's path to the root."""
        count = self.count
        self.sums[0][leaf] = (sum(map(len, self.leaves[leaf])), sum([count[p] for p in self.leaves[leaf]]))
        i = leaf
        for low, high in zip(self.sums, self.sums[1:], strict=False):
            i //= 2
            pair = low[2 * i : 2 * i + 2]
            high[i] = (sum(p[0] for p in pair), sum(p[1] for p in pair))

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters [start, end)."""
        start = max(0, min(start, self.n_chars))
        end = max(start, min(end, self.n_chars))
        if start == end and not new:
            return
        # The last boundary before the edit that it cannot move: a pre-token looks two characters past its end at most.
        first, at = self._leaf_at(max(0, start - 2))
        keep = 0
        while keep < len(self.leaves[first]) and at + len(self.leaves[first][keep]) + 2 <= start:
            at += len(self.leaves[first][keep])
            keep += 1
        # Old pre-tokens up to the leaf that holds the edit's end, then twice as many leaves more each time, until the new
        # boundaries meet an old one past the edit: what is split again grows with the edit alone.
        last, more, grown = max(first, self._leaf_at(end)[0]), 1, len(new) - (end - start)
        while True:
            old = self.leaves[first][keep:] + [p for leaf in self.leaves[first + 1 : last + 1] for p in leaf]
            old_text = "".join(old)
            text = old_text[: start - at] + new + old_text[end - at :]
            ends, place = set(), at
            for p in old:
                place += len(p)
                if place >= end:
                    ends.add(place + grown)
            whole, tail = last + 1 == len(self.leaves), at + len(old_text) + grown
            pieces, place, met = [], at, None
            for p in self.count.split(text):
                pieces.append(p)
                place += len(p)
                # The end of what was taken is no proof: more old text may follow there.
                if place in ends and (place + 2 <= tail or whole):
                    met = place
                    break
            if met is not None or whole:
                break
            last, more = min(last + more, len(self.leaves) - 1), 2 * more
        rest, place = [], at + grown
        if met is not None:
            for p in old:
                place += len(p)
                if place > met:
                    rest.append(p)
        self.n_reencoded += len(pieces)
        changed = self.leaves[first][:keep] + pieces + rest
        room = last - first + 1
        each = max(1, -(-len(changed) // room))
        for k in range(room):
            self.leaves[first + k] = changed[k * each : (k + 1) * each]
        if each > 4 * LEAF:
            # A long insertion: cut the leaves anew.
            every = [p for leaf in self.leaves for p in leaf]
            self.leaves = [every[i : i + LEAF] for i in range(0, len(every), LEAF)]
            self._build()
            return
        for k in range(room):
            self._refresh(first + k)


def counted(text: str | None, edits: Iterable[tuple[int, int, str]], count: Counter_) -> tuple[int, int, int, int]:
    """Tokens and pre-tokens of the text, tokens after the edits (each on the outcome of those before), pre-tokens encoded for the edits."""
    tree = TokenTree(text or "", count)
    n, pre = tree.n_tokens, tree.n_pretokens
    for edit in edits:
        tree.edit(*edit)
    return n, pre, tree.n_tokens, tree.n_reencoded


def redactions(text: str) -> list[tuple[int, int, str]]:
    """Redaction of personal data as edits; from the right, so that offsets stay true."""
    return pii.redact(text)[::-1]


def counts_of(text: Column, ranks_path: str = RANKS, edits=redactions) -> Column:
    """struct(n_tokens, n_pretokens, n_edits, n_tokens_edited, n_reencoded)."""

    @F.pandas_udf("n_tokens long, n_pretokens long, n_edits long, n_tokens_edited long, n_reencoded long")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        count = counter(ranks_path)
        for texts in batches:
            rows = []
            for t in texts:
                es = edits(t or "")
                n, pre, after, encoded = counted(t, es, count)
                rows.append((n, pre, len(es), after, encoded))
            yield pd.DataFrame(rows, columns=["n_tokens", "n_pretokens", "n_edits", "n_tokens_edited", "n_reencoded"])

    return counts(text)


def op10(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", counts_of(F.col("text")).alias("p")).select("doc_id", "p.*")
