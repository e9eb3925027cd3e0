"""Toxicity by a support vector machine on a gapped string kernel.

The kernel of two strings sums, over all subsequences of four characters that leave out at
most one character between two of theirs, the product of their weights (DECAY for each
character left out). Nyström landmarks (words told apart by the labels, and the commonest words
of clean text) span the feature space; a linear squared-hinge machine is trained there on
labelled windows of sentences. The trained machine is one number per subsequence, so a text
is scored by adding up its subsequences in sliding windows; the largest window decides and a
logistic curve turns it into a score. A letter inserted into an insult, or set apart by
spaces or dots, leaves most of the weight in place.

Training takes a bounded sample of labelled rows (max_positive, max_negative, of texts up to
max_chars); scoring takes every whole text.

Defined results: null and empty texts score as a text without any weight; without labelled rows
of both classes all texts score the share of toxic labels (0 if none); several labels of one id
count as one, toxic if any is; very long texts are scored whole, in steps; documents that repeat an
id are each scored, and equal texts score alike; labels without a document, nulls among them, count
nothing; empty tables give no rows; columns other than id, text and toxic are passed over.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchlift.llm.common import held_out, table

DIM = 1 << 16
DECAY = 0.7
#: Steps from the first to the three other characters, with at most one skipped between two, and what the skipped ones cost.
SHAPES = tuple((i, i + j, i + j + k, DECAY ** (i + j + k - 3)) for i in (1, 2) for j in (1, 2) for k in (1, 2))
REACH = 6
#: Window lengths in bytes: a word, and a word with a character set between any two of its letters.
WINDOWS = (12, 24)
STEP = 1 << 20


def codes(text: str) -> np.ndarray:
    return np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8).astype(np.uint32)


def subsequences(a: np.ndarray) -> list[tuple[np.ndarray, float]]:
    """For each shape the bucket of the subsequence that starts at each place, and its weight."""
    out = []
    for i, j, k, w in SHAPES:
        if (n := len(a) - k) > 0:
            out.append((((a[:n] << np.uint32(24) | a[i : n + i] << np.uint32(16) | a[j : n + j] << np.uint32(8) | a[k : n + k]) * np.uint32(2654435761)) >> np.uint32(16), w))
    return out


def features(text: str) -> np.ndarray:
    out = np.zeros(DIM, np.float32)
    for at, w in subsequences(codes(text)):
        out += w * np.bincount(at, minlength=DIM)
    return out


def kernel_row(text: str, base_t: np.ndarray) -> np.ndarray:
    """Kernel values of a short text with every landmark, over the root of its length; base_t: DIM x landmarks."""
    out = np.zeros(base_t.shape[1], np.float32)
    for at, w in subsequences(codes(text)):
        out += w * base_t[at].sum(axis=0)
    return out / np.sqrt(max(len(text.encode("utf-8", "replace")), 1))


def window_sums(text: str, beta: np.ndarray) -> tuple[float, int, int]:
    """The largest window, scaled by the root of its length: value, start and length in bytes of codes()."""
    a = codes(text)
    best = (0.0, 0, WINDOWS[0])
    for at in range(0, len(a) - 3, STEP):
        part = a[at : at + STEP + REACH + max(WINDOWS)]
        g = np.zeros(len(part) - 3, np.float32)
        for h, w in subsequences(part):
            g[: len(h)] += beta[h] * np.float32(w)
        c = np.concatenate(([0.0], np.cumsum(g, dtype=np.float64)))
        for length in WINDOWS:
            k = min(length, len(g))
            s = c[k:] - c[:-k]
            i = int(s.argmax())
            best = max(best, (float(s[i]) / np.sqrt(length), at + i, length))
    return best


def piece(text: str, start: int, length: int) -> str:
    return codes(text)[start : start + length + REACH].astype(np.uint8).tobytes().decode("utf-8", "ignore")


class Model:
    """curve: slope, middle, low and high end of the score over the largest window."""

    def __init__(self, beta: np.ndarray, curve: tuple[float, float, float, float], words: list[str]):
        self.beta, self.curve, self.words = beta, curve, words

    def score(self, text: str | None) -> float:
        slope, middle, low, high = self.curve
        m = window_sums(text or "", self.beta)[0] if slope else 0.0
        return float(low + (high - low) / (1 + np.exp(-np.clip(slope * (m - middle), -30, 30))))


def _told_apart(positive: list[str], negative: list[str], n: int) -> tuple[list[str], list[str], dict[str, float]]:
    """At most n words of the positive texts by log-likelihood ratio, the n commonest of the negative ones, and the ratios.

    A word counts once for each pair of neighbours that it stands between, so that a text with many near copies counts as one.
    """

    def contexts(texts: list[str]) -> Counter:
        seen = set()
        for t in texts:
            ws = [w.strip(".,;:!?\"'()") for w in t.lower().split()]
            seen.update(zip(ws, ["", *ws[:-1]], [*ws[1:], ""], strict=True))
        return Counter(w for w, _, _ in seen if len(w) <= 24)

    pos, neg = contexts(positive), contexts(negative)
    n_pos, n_neg, ratio = sum(pos.values()), sum(neg.values()), {}
    for w, k in pos.items():
        p, q = k / n_pos, neg[w] / n_neg
        if len(w) > 2 and k >= 5 and p > 3 * q:
            every = (k + neg[w]) / (n_pos + n_neg)
            ratio[w] = k * np.log(p / every) + (neg[w] * np.log(q / every) if neg[w] else 0)
    best = max(ratio.values(), default=0)
    by_ratio = [w for w in sorted(ratio, key=lambda w: (-ratio[w], w))[:n] if ratio[w] >= 0.1 * best]
    common = [w for w, _ in sorted(neg.items(), key=lambda x: (-x[1], x[0])) if len(w) > 1 and w not in ratio][:n]
    return by_ratio, common, ratio


def variants(word: str) -> list[str]:
    """The word as it is, set apart by dots or spaces, and with one character put in."""
    half = len(word) // 2
    return [word, ".".join(word), " ".join(word), f"{word[:half]}*{word[half:]}"]


def _squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Newton steps on |w|^2 / 2 + c * sum weight * max(0, 1 - y f)^2."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.eye(x1.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x1.shape[1])
    for _ in range(rounds):
        on = y * (x1 @ w) < 1
        xo, s = x1[on], weight[on]
        new = np.linalg.solve(ridge + 2 * c * (xo * s[:, None]).T @ xo, 2 * c * xo.T @ (s * y[on]))
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w[:-1], float(w[-1])


def fit(positive: list[str], negative: list[str], landmarks: int = 48, rounds: int = 3) -> Model:
    """positive and negative: distinct texts of either label."""
    share = len(positive) / max(1, len(positive) + len(negative))
    constant = Model(np.zeros(DIM, np.float32), (0.0, 0.0, share, share), [])
    if not positive or not negative:
        return constant
    told, common, ratio = _told_apart(positive, negative, landmarks)
    if not told:
        return constant
    base = np.array([features(w) for w in told + common])
    norms = np.linalg.norm(base, axis=1)
    base /= norms[:, None]
    k = base @ base.T
    values, vectors = np.linalg.eigh(k.astype(np.float64))
    keep = values > 1e-6 * values[-1]
    root = (vectors[:, keep] / np.sqrt(values[keep])).T
    base_t = np.ascontiguousarray(base.T)
    to_z = lambda xs: np.array([kernel_row(x, base_t) for x in xs]) @ root.T
    # The first witnesses of a toxic text: its words with the largest ratios, as they are and with characters put in.
    rng = np.random.default_rng(7)
    pos, neg = [], []
    for i, t in enumerate(positive):
        ws = sorted({w.strip(".,;:!?\"'()") for w in t.lower().split()} & set(told), key=lambda w: -ratio[w])
        pos += [variants(w)[k] for w in ws[:4] for k in (0, 1 + i % 3)]
    for t in negative:
        ws = t.split()
        for i in rng.integers(0, max(len(ws), 1), 4):
            neg.append(" ".join(ws[i : i + 3])[:24] or " ")
    z_pos, z_neg, model = to_z(pos), to_z(neg), constant
    for _ in range(rounds):
        x = np.vstack([z_pos, z_neg])
        y = np.r_[np.ones(len(z_pos)), -np.ones(len(z_neg))]
        weight = np.where(y > 0, 1 / len(z_pos), 1 / len(z_neg)) * 20_000
        w, _ = _squared_hinge(x, y, weight)
        beta = (base.T @ (root.T @ w)).astype(np.float32)
        mp, mn = [window_sums(t, beta) for t in positive], [window_sums(t, beta) for t in negative]
        model = Model(beta, _curve(np.array([m[0] for m in mp + mn]), np.r_[np.ones(len(mp)), np.zeros(len(mn))]), told)
    # Toxic texts whose best window is likely toxic give new witnesses; clean texts give the windows that come nearest.
        sure = [piece(t, *m[1:]) for t, m in zip(positive, mp, strict=True) if m[0] > model.curve[1]]
        near = [piece(t, *m[1:]) for t, m in zip(negative, mn, strict=True)]
        z_pos, z_neg = np.vstack([z_pos, to_z(sure)]) if sure else z_pos, np.vstack([z_neg, to_z(near)])
    return model


def _curve(m: np.ndarray, y: np.ndarray) -> tuple[float, float, float, float]:
    """Likeliest low + (high - low) * logistic(slope * (m - middle)): labels may be wrong on either side, so the curve has a floor and a top."""
    order = np.argsort(m, kind="stable")
    m, y = m[order], y[order]
    spread, best = float(m.std()) or 1.0, (-np.inf, 0.0, 0.0, 0.0, 1.0)
    rate = float(y.mean())
    for i in np.unique(np.linspace(1, len(m) - 1, 400).astype(int)):
        low = (y[:i].sum() + rate) / (i + 1)
        high = (y[i:].sum() + rate) / (len(m) - i + 1)
        for k in (2.0, 6.0, 20.0):
            middle = (m[i - 1] + m[i]) / 2
            p = np.clip(low + (high - low) / (1 + np.exp(-np.clip(k / spread * (m - middle), -30, 30))), 1e-6, 1 - 1e-6)
            fit_ = float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum())
            if high > low and fit_ > best[0]:
                best = (fit_, k / spread, float(middle), float(low), float(high))
    return best[1:]


def train(docs: DataFrame, labels: DataFrame, max_positive: int = 1500, max_negative: int = 3000, max_chars: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """From the labelled rows whose crc32(id) mod 4 is not 2; of each class those with the smallest hashes."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max("toxic").alias("__toxic"))
    marks = marks.where(~held_out(F.col("__id"), 4, 2)).withColumn("__draw", F.xxhash64(F.lit(11), "__id"))
    drawn = [marks.where(side).orderBy("__draw", "__id").limit(n) for side, n in (("__toxic = 1", max_positive), ("__toxic = 0", max_negative))]
    # The drawn ids are bounded by the two limits, so they are broadcast.
    ids = F.broadcast(drawn[0].unionByName(drawn[1]).select("__id", "__toxic"))
    # An id may be repeated any number of times: one text stands for it, so that at most the two limits come to the driver.
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).where(F.length("text").between(1, max_chars)).join(ids, "__id")
    rows = texts.groupBy("__id", "__toxic").agg(F.min("text").alias("text")).select("text", "__toxic").collect()
    positive = {r.text for r in rows if r["__toxic"] == 1}
    negative = {r.text for r in rows if r["__toxic"] == 0} - positive
    return fit(sorted(positive), sorted(negative))


def scored(model: Model, text: Column) -> Column:
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.score(t) for t in texts], dtype="float64")

    return score(text)


def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    out = docs.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), scored(model, F.col("text")).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))
