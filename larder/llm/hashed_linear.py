"""Logistic regression over hashed n-grams, trained by follow-the-regularised-leader.

Weights live in 2 ** BITS buckets, so a model has one size whatever the corpus. The
training sample is dealt into a fixed number of shards by hash; each shard is learnt in
a task of its own and the shards' weights are averaged.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import Kept, id_type, map_rows, schema_of

BITS = 20
BUCKETS = 1 << BITS
SHARDS = 4
TOKEN = regex.compile(r"\w+|[^\w\s]+")
_BIAS = np.zeros(1, np.int64)
#: Offsets of the features "twice" and "three times", and an odd factor that spreads hashes over the buckets; products fit 64 bits.
TWICE, THRICE, SPREAD = 0x3C6EF372, 0x78DDE6E4, 0x3779B1


class Tokens:
    """32-bit hashes of the words and symbol runs of texts; chunks between white space are split once."""

    def __init__(self, units: Callable[[str], list[str]]):
        self.known = Kept(lambda chunk: tuple(xxhash.xxh32_intdigest(u) for u in units(chunk)))

    def of(self, text: str) -> np.ndarray:
        known = self.known
        return np.fromiter((h for c in text.split() for h in known[c]), np.int64)


def cased_tokens(chunk: str) -> list[str]:
    return TOKEN.findall(chunk)


def words_and_prefixes(chunk: str) -> list[str]:
    """Lower-case words, and the beginnings of long ones, which stand for a word family."""
    low = chunk.lower()
    out = []
    for w in (low,) if low.isalpha() else TOKEN.findall(low):
        out.append(w)
        for k in range(4, min(len(w), 8)):
            out.append(w[:k] + "~")
    return out


def word_ngrams(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of unigrams and bigrams, scaled to unit length, with a bias in bucket 0. All repetitions of a word share one bigram."""
    if len(h):
        a, b = h[:-1], h[1:]
        pairs = np.where(a == b, 77, (a * 0x9E3779B1 + b * 0x85EBCA77) ^ (a >> 7))
        grams, n = np.unique(np.concatenate([h, pairs]) % (BUCKETS - 1) + 1, return_counts=True)
        return np.concatenate([_BIAS, grams]), np.concatenate([[1.0], n / np.sqrt((n * n).sum())])
    return _BIAS, np.ones(1)


def presence(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the units that occur, that occur twice, and three times or more, each counting 1, with a bias in bucket 0."""
    units, n = np.unique(h, return_counts=True)
    found = np.concatenate([units, units[n >= 2] + TWICE, units[n >= 3] + THRICE])
    grams = np.concatenate([_BIAS, np.unique(found * SPREAD % (BUCKETS - 1) + 1)])
    return grams, np.ones(len(grams))


#: (units of a chunk, buckets and values of a text's unit hashes)
FEATURES = {"ngrams": (cased_tokens, word_ngrams), "presence": (words_and_prefixes, presence)}


@lru_cache(maxsize=4)
def tokens(kind: str) -> Tokens:
    """One for each Python worker, kept between tasks."""
    return Tokens(FEATURES[kind][0])


def vector(text: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
    return FEATURES[kind][1](tokens(kind).of(text))


class Leader:
    """FTRL-proximal: per-bucket rates from gradients so far, L1 and L2 penalties."""

    def __init__(self, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.1, l2: float = 0.1):
        self.z, self.n = np.zeros(BUCKETS), np.zeros(BUCKETS)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def at(self, i: np.ndarray) -> np.ndarray:
        z = self.z[i]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[i])) / self.alpha + self.l2))

    def learn(self, i: np.ndarray, x: np.ndarray, y: float, weight: float = 1.0) -> None:
        w = self.at(i)
        g = weight * (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[i] = n + g * g

    def weights(self) -> np.ndarray:
        return self.at(np.arange(BUCKETS)).astype(np.float32)


def train(sample: DataFrame, kind: str, epochs: int = 3, l1: float = 0.1, l1_per_row: float | None = None, **penalties: float) -> np.ndarray:
    """Weights from a bounded sample with columns id, text, y (0 to 1) and w (importance). With `l1_per_row` a shard's L1 penalty grows with its rows up to `l1`."""

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "id", "text"])
        rows = [(*vector(t or "", kind), y, w) for t, y, w in zip(pdf["text"], pdf["y"], pdf["w"])]
        model = Leader(l1=l1 if l1_per_row is None else min(l1, max(0.3, l1_per_row * len(rows))), **penalties)
        for _ in range(epochs):
            for row in rows:
                model.learn(*row)
        return pd.DataFrame({"weights": [model.weights().tobytes()], "rows": [len(rows)]})

    dealt = sample.select("id", "text", "y", "w", F.xxhash64("id", F.lit(1)).alias("order"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(SHARDS)).alias("shard"))
    parts = dealt.groupBy("shard").applyInPandas(learn, "weights binary, rows long").collect()  # SHARDS rows of 4 * BUCKETS bytes
    total = sum(r["rows"] for r in parts)
    if not total:
        return np.zeros(BUCKETS, np.float32)
    return sum(np.frombuffer(r["weights"], np.float32) * np.float32(r["rows"] / total) for r in parts)


class SparseScorer:
    """Scores texts under fixed weights. Of the units of a chunk only those are kept whose buckets have weights that are not zero; for most chunks there are none, so the dot product runs over a handful of units. Only for `presence`, whose values do not depend on the other units."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.split = FEATURES["presence"][0]
        self.known = Kept(self.keep)
        # spread hashes of units with a weight for occurring once, twice or three times
        found = np.flatnonzero(weights[1:])
        self.alive = {int(r) for off in (0, TWICE, THRICE) for r in (found - off * SPREAD) % (BUCKETS - 1)}

    def keep(self, chunk: str) -> tuple[int, ...]:
        return tuple(h for h in map(xxhash.xxh32_intdigest, self.split(chunk)) if h * SPREAD % (BUCKETS - 1) in self.alive)

    def score(self, text: str) -> float:
        known = self.known
        at, x = presence(np.array([h for c in text.split() if (t := known[c]) for h in t], np.int64))
        return float(1 / (1 + np.exp(-np.clip(self.weights[at] @ x, -30, 30))))


_SCORERS: dict[int, SparseScorer] = {}


def scorer(weights: np.ndarray, kind: str) -> Callable[[str], float]:
    """The scoring function of a Python worker, kept between tasks with the same weights."""
    if kind != "presence":

        def dense(text: str) -> float:
            at, x = vector(text, kind)
            return float(1 / (1 + np.exp(-np.clip(weights[at] @ x, -30, 30))))

        return dense
    key = xxhash.xxh3_64_intdigest(weights.tobytes())
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = SparseScorer(weights)
    return _SCORERS[key].score


def score(df: DataFrame, weights: np.ndarray, kind: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row: sparse dot products through the logistic function. No shuffle."""
    sent = df.sparkSession.sparkContext.broadcast(weights)  # 4 * BUCKETS bytes

    def start():
        one = scorer(sent.value, kind)
        return lambda ids, texts: ((i, one(t or "")) for i, t in zip(ids, texts))

    return map_rows(df, [id_col, text_col], schema_of(f"{id_col} {id_type(df, id_col)}, score double"), start)

