"""Language identification by error-correcting output codes.

Every learned language has a codeword of +1 and -1. For each bit a binary classifier on
hashed letter trigrams (log-odds of the two halves of the languages, from counts over all
labelled rows) gives a margin; the language whose codeword has the least summed logistic loss
over the margins wins. Where the second codeword is almost as near, the row is ambiguous.

Defined results: null texts and texts without a letter are 'und' with score 0, as is every row
when no labelled row exists, and all of them are ambiguous; with one language every other row gets
it; very long texts are counted whole, in steps; rows that repeat each count in training and get the
same prediction; ties between codewords go to the first language by name; empty tables give no
rows; labelled rows with a null language or text are not learned from; input columns named __p or
__held_out are replaced, all others are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchlift.llm.common import free_name, held_out, table

BUCKETS = 1 << 13
#: Bytes per step over a long text.
STEP = 1 << 20
#: All bytes but ASCII letters and non-ASCII ones become a space.
LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def trigram_counts(text: str) -> np.ndarray:
    raw = b" " + text.lower().encode("utf-8", "replace").translate(LETTERS) + b" "
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(len(raw) - 2, 1), STEP):
        a = np.frombuffer(raw[at : at + STEP + 2], np.uint8).astype(np.uint32)
        h = (a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]
        h = h[h != 0x202020]
        counts += np.bincount((h * np.uint32(2654435761)) >> np.uint32(19), minlength=BUCKETS)
    return counts


def codewords(n: int) -> np.ndarray:
    """n rows of +-1: all distinct splits for up to 5 languages, else 8 * ceil(log2 n) + 7 seeded random splits."""
    if n <= 5:
        cols = [[1] + [1 if (c >> r) & 1 else -1 for r in range(n - 1)] for c in range(2 ** (n - 1) - 1)] if n > 1 else [[1]]
        return np.array(cols, np.float32).T
    width, rng = 8 * int(np.ceil(np.log2(n))) + 7, np.random.default_rng(n)
    while True:
        code = np.array([rng.permutation(np.arange(n) % 2) for _ in range(width)], np.float32).T * 2 - 1
        if len(np.unique(code, axis=0)) == n:
            return code


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, evidence: int = 40):
        self.langs, self.evidence = langs, evidence
        self.code = codewords(len(langs)) if langs else np.zeros((0, 0), np.float32)
        p = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS) if langs else np.zeros((0, BUCKETS))
        # A column of one sign only (one language) tells it from even trigrams.
        other = lambda side: p[side].mean(axis=0) if side.any() else np.full(BUCKETS, 1 / BUCKETS)
        self.weights = np.array([np.log(other(c > 0)) - np.log(other(c < 0)) for c in self.code.T], np.float32).reshape(-1, BUCKETS).T

    def decide(self, text: str | None) -> tuple[str, float, bool]:
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        counts = trigram_counts(text)
        n = int(counts.sum())
        margins = (counts.astype(np.float32) @ self.weights) / n * min(n, self.evidence)
        loss = np.logaddexp(0, -self.code * margins).sum(axis=1)
        odds = np.exp(loss.min() - loss)
        share = np.sort(odds / odds.sum())[::-1]
        return self.langs[int(loss.argmin())], float(share[0]), bool(len(share) > 1 and share[0] - share[1] < 0.1)


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Trigram counts per language over all labelled rows; what reaches the driver is languages x BUCKETS counts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_lang: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                by_lang[lang] = by_lang.get(lang, 0) + trigram_counts(text)
        for lang, counts in by_lang.items():
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": counts[at]})

    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    found = rows.mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    counts = np.zeros((len(langs), BUCKETS))
    counts[found["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int), found["bucket"].to_numpy(int)] = found["n"].to_numpy()
    return Model(langs, counts)


def predicted(model: Model, text: Column) -> Column:
    """struct(lang, score, ambiguous)."""

    @F.pandas_udf("lang string, score double, ambiguous boolean")
    def decide(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([model.decide(t) for t in texts], columns=["lang", "score", "ambiguous"])

    return decide(text)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs (id, text and language alone) with held_out and __p, learned from the rows that aren't held out."""
    docs, out = free_name(docs, "__p", "__held_out"), held_out(F.col(id_col), 3, 1)
    model = train(docs.where(~out), text_col, lang_col)
    return docs.withColumn("__p", predicted(model, F.col(text_col))).withColumn("__held_out", out)


def known_language(docs: DataFrame, **options) -> DataFrame:
    """docs without the rows that have no language: no letter at all, or two codewords equally near."""
    found = identify(docs, **options)
    return found.where(~F.col("__p.ambiguous")).select(docs.columns)


def op8(spark, sf_dir):
    found = identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", F.col("__held_out").alias("held_out"), F.col("__p.lang").alias("lang_pred"), F.col("__p.score").alias("score"), F.col("__p.ambiguous").alias("ambiguous"))
