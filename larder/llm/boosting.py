"""Gradient-boosted trees as arrays, small enough to send to every task: from rows in memory, or from all rows of a table by histograms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import map_rows, schema_of, staged

BINS = 32
#: Gradients are summed in units of 2^-30, so that a sum is the same in any order; leaves and scores are multiples of 1/1024, so that there are few distinct scores, however many rows.
UNIT, STEPS = 1 << 30, 1024


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 1.0) -> dict:
    """Logistic loss, Newton leaves, splits at quantile cuts. Trees are complete: inner nodes by level, then leaves."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)  # bin > k exactly if value > cut k
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    score = np.full(len(y), bias)
    trees = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), int)
        features, limits = [], []
        for level in range(depth):
            for k in range(2**level):
                rows = np.flatnonzero(node == k)
                best = (1e-9, 0, np.inf, None)
                for j, c in enumerate(cuts):
                    if not len(c) or not len(rows):
                        continue
                    g = np.bincount(binned[rows, j], grad[rows], len(c) + 1)
                    h = np.bincount(binned[rows, j], hess[rows], len(c) + 1)
                    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
                    gr, hr = g.sum() - gl, h.sum() - hl
                    gain = gl**2 / (hl + least) + gr**2 / (hr + least) - g.sum() ** 2 / (h.sum() + least)
                    at = int(np.argmax(gain))
                    if gain[at] > best[0]:
                        best = (float(gain[at]), j, float(c[at]), at)
                features.append(best[1])
                limits.append(best[2])
            first = 2**level - 1
            f, m = np.array(features[first:])[node], np.array(limits[first:])[node]
            node = 2 * node + (x[np.arange(len(y)), f] > m)
        g, h = np.bincount(node, grad, 2**depth), np.bincount(node, hess, 2**depth)
        leaves = rate * g / (h + least)
        score = score + leaves[node]
        trees.append((features, limits, leaves.tolist()))
    return {"bias": bias, "depth": depth, "features": [t[0] for t in trees], "limits": [[min(v, 1e300) for v in t[1]] for t in trees], "leaves": [t[2] for t in trees]}


def binned(rows: DataFrame, width: int, train: str) -> tuple[DataFrame, list[list[float]]]:
    """(the rows with `x`, an array of `width` numbers, as `bins` of a byte each, equal rows once with their `count`; the cuts between each column's bins). The cuts are exact quantiles of all rows where `train` holds."""
    levels = [k / BINS for k in range(1, BINS)]
    got = rows.filter(train).agg(*(F.percentile(F.get("x", F.lit(j)), F.array(*map(F.lit, levels))).alias(f"q{j}") for j in range(width))).first()
    cuts = [sorted(set(q or ())) for q in got]
    others = [c for c in rows.columns if c != "x"]

    def start():
        limits = [np.array(c, float) for c in cuts]

        def handle(xs, *columns):
            x = np.array(xs, float).reshape(-1, width)
            bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(limits)], axis=1).astype(np.uint8)  # bin > k exactly if value > cut k
            return zip((b.tobytes() for b in bins), *columns)

        return handle

    schema = schema_of(", ".join(["bins binary", *(f"{c} {rows.schema[c].dataType.simpleString()}" for c in others)]))
    return staged(map_rows(rows, ["x", *others], schema, start).groupBy(*others, "bins").count(), "boosting-bins"), cuts


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        if b.num_rows:
            yield b, np.frombuffer(b"".join(b.column("bins").to_pylist()), np.uint8).reshape(b.num_rows, -1)


def _histograms(train: DataFrame, model: dict, tree: list[tuple[int, int]], level: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of gradients and of Hessians of all rows by node of a level, column and bin. `tree` has the splits of the levels above."""
    size = 2**level * width * BINS

    def run(batches):
        g, h = np.zeros(size), np.zeros(size)
        for b, bins in _batches(batches):
            n, y = b.column("count").to_numpy(), b.column("label").to_numpy()
            p = 1 / (1 + np.exp(-_score(model, model["places"], bins)))
            grad, hess = np.rint((y - p) * UNIT) * n, np.rint(np.maximum(p * (1 - p), 1e-6) * UNIT) * n
            node = _leaf([t[0] for t in tree], [t[1] for t in tree], level, bins)
            for j in range(width):
                at = (node * width + j) * BINS + bins[:, j]
                g += np.bincount(at, grad, size)
                h += np.bincount(at, hess, size)
        yield pa.RecordBatch.from_arrays([pa.array([v.astype(np.int64).tobytes()]) for v in (g, h)], ["g", "h"])

    got = train.select("label", "count", "bins").mapInArrow(run, "g binary, h binary").collect()  # one row of each task, of a size that no number of rows changes: 86 kB for 42 columns at the third level
    g, h = (sum((np.frombuffer(r[k], np.int64) for r in got), np.zeros(size, np.int64)) / UNIT for k in (0, 1))
    return g.reshape(-1, width, BINS), h.reshape(-1, width, BINS)


def fit_table(train: DataFrame, cuts: list[list[float]], rounds: int = 40, depth: int = 3, rate: float = 0.2, least: float = 1.0) -> dict | None:
    """As `fit`, on all rows of (label 0 or 1, bins, count) as `binned` gives them: a job for each level of each tree, which sums histograms where the rows are; None where one class is missing."""
    width = len(cuts)
    seen = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.sum("count").alias("n")).collect()}
    if not seen.get(0) or not seen.get(1):
        return None
    share = float(np.clip(seen[1] / (seen[0] + seen[1]), 1e-3, 1 - 1e-3))
    model: dict = {"bias": _rounded(np.log(share / (1 - share))), "depth": depth, "features": [], "places": [], "limits": [], "leaves": []}
    for _ in range(rounds):
        tree: list[tuple[int, int]] = []
        for level in range(depth):
            g, h = _histograms(train, model, tree, level, width)
            leaves = []
            for k in range(2**level):
                all_g, all_h = g[k, 0].sum(), h[k, 0].sum()
                best, at, sums = 1e-9, (0, BINS), (all_g, all_h)
                for j, c in enumerate(cuts):
                    if not c:
                        continue
                    gl, hl = np.cumsum(g[k, j])[: len(c)], np.cumsum(h[k, j])[: len(c)]
                    gain = gl**2 / (hl + least) + (all_g - gl) ** 2 / (all_h - hl + least) - all_g**2 / (all_h + least)
                    i = int(np.argmax(gain))
                    if gain[i] > best:
                        best, at, sums = float(gain[i]), (j, i), (gl[i], hl[i])
                tree.append(at)
                leaves += [_rounded(rate * a / (b + least)) for a, b in (sums, (all_g - sums[0], all_h - sums[1]))]
        model["features"].append([j for j, _ in tree])
        model["places"].append([i for _, i in tree])
        model["limits"].append([cuts[j][i] if i < BINS else 1e300 for j, i in tree])
        model["leaves"].append(leaves)
    return model


def score_counts(rows: DataFrame, model: dict, by: str) -> dict[int, list[tuple[float, int, int]]]:
    """Of each value of `by` the distinct scores, from the highest down, each with its number of rows and how many of them have label 1."""

    def run(batches):
        for b, bins in _batches(batches):
            scores = np.rint(_score(model, model["places"], bins) * STEPS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("of"), pa.array(scores), b.column("count"), pa.array(b.column("count").to_numpy() * b.column("label").to_numpy())], ["of", "score", "n", "ones"])

    counted = rows.select(F.col(by).alias("of"), F.col("label").cast("long"), "count", "bins").mapInArrow(run, f"of {rows.schema[by].dataType.simpleString()}, score bigint, n bigint, ones bigint")
    out: dict = {}
    for of, score, n, ones in sorted(counted.groupBy("of", "score").agg(F.sum("n"), F.sum("ones")).collect(), key=lambda r: -r[1]):  # STEPS rows at most for each unit of the scores' range
        out.setdefault(of, []).append((score / STEPS, n, ones))
    return out


def _rounded(v: float) -> float:
    return float(np.rint(v * STEPS) / STEPS)


def _leaf(features: list[int], limits: list[float], depth: int, x: np.ndarray) -> np.ndarray:
    """The node that each row reaches in a complete tree."""
    rows, f, m, node = np.arange(len(x)), np.array(features, int), np.array(limits), np.zeros(len(x), int)
    for level in range(depth):
        at = 2**level - 1 + node
        node = 2 * node + (x[rows, f[at]] > m[at])
    return node


def _score(model: dict, limits: list[list[float]], x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), model["bias"])
    for features, limit, leaves in zip(model["features"], limits, model["leaves"]):
        out += np.array(leaves)[_leaf(features, limit, model["depth"], x)]
    return out


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    """Log-odds of each row."""
    return _score(model, model["limits"], x)


def calibrate(scores: np.ndarray, y: np.ndarray, precision: float = 0.99, n: np.ndarray | None = None) -> float:
    """The least score at and above which held-out precision is still as asked; infinity where none is. With `n`, each score stands for so many rows, `y` of them right."""
    order = np.argsort(-scores, kind="stable")
    right = np.cumsum(y[order]) / (np.arange(1, len(y) + 1) if n is None else np.cumsum(n[order]))
    s = scores[order]
    ends = np.r_[s[1:] != s[:-1], True]  # only whole groups of equal scores
    good = np.flatnonzero(ends & (right >= precision)) if len(y) else []
    return float(s[good[-1]]) if len(good) else float("inf")
