"""Hard negatives for contrastive training: rows of another label that score just below a positive.

Every anchor meets all rows, in blocks: rows and anchors are packed into blocks of
vectors, a pair of blocks is one matrix product. A first pass keeps each anchor's best rows of its own
label, its positives. Their scores are upper limits of overlapping windows, and cut the
scores into disjoint slots: slot j holds what lies above the limit of slot j + 1 and not
above its own. A second pass puts each row of another label into its one slot, if it lies in any window; the
combiners keep the first few of each slot, in the task and again after one shuffle by
anchor. A window is the slots from its own down, so one merge from the lowest slot
upwards answers all windows of an anchor, without a row being kept for each of them.

Scores are exact integer inner products. Products of doubles are exact as long as all
sums stay below 2^53; blocks that could go beyond are computed in Python's integers, and
a score that does not fit a long is an error.

Defined cases: rows without id, label or vector, and those with a null or non-finite
component, take no part, neither as anchors nor as partners; vectors of different
lengths have no score with each other, those of length 0 score 0; repeated ids are rows
of their own (as anchors too); of partners with equal score and id any may come first,
their rows are alike; an anchor without positives, or whose windows are empty, gives no
rows; a positive with a negative score has an empty window; an empty table gives no rows; only the id, label and vector
are read, so further columns may have any names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import map_rows, schema_of, staged

#: Vectors of a block of rows and of anchors; a pair's scores take 8 bytes each.
ROWS, ANCHORS = 4096, 512
#: Blocks of rows that meet one copy of an anchor block, so that no block of anchors is one hot key.
SPREAD = 4
#: Anchors whose best are held in a task before they are passed on.
HELD = 4096
EXACT = 1 << 53
_PACKED = "block long, dim int, ids binary, labels binary, vectors binary, largest double"
_PACKED_ARROW = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary()), ("largest", pa.float64())])


def quantised(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """(vec_id, label, vector): each component x as floor(scale * x), whole numbers in doubles; without the rows that take no part."""
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    usable = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    # floor gives a long, and whole numbers beyond one stay as they are
    floor = lambda x: F.when(F.abs(scale * x) < float(EXACT), F.floor(scale * x).cast("double")).otherwise(scale * x)
    return df.where(usable).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.transform(vector, floor).alias("vector"))


def _packed(rows: DataFrame, size: int, name: str) -> DataFrame:
    """The rows of each task in blocks of at most `size` vectors of one length; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 32
        held: dict[int, list[tuple[int, int, np.ndarray]]] = {}

        def packed(dim):
            nonlocal at
            ids, labels, vectors = zip(*held.pop(dim))
            matrix = np.array(vectors, np.float64).reshape(len(ids), dim)
            at += 1
            cells = [at - 1, dim, np.array(ids, np.int64).tobytes(), np.array(labels, np.int64).tobytes(), matrix.tobytes(), float(np.abs(matrix).max(initial=0))]
            return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, _PACKED_ARROW)], schema=_PACKED_ARROW)

        for batch in batches:
            vectors = batch.column(2)
            flat, offsets = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
            for k, (i, label) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                vector = flat[offsets[k] : offsets[k + 1]]
                mine = held.setdefault(len(vector), [])
                mine.append((i, label, vector))
                if len(mine) == size:
                    yield packed(len(vector))
                elif len(held) > 64:  # vectors of very many lengths: the smaller blocks go on
                    yield packed(next(iter(held)))
        for dim in list(held):
            yield packed(dim)

    return staged(rows.mapInArrow(run, _PACKED), name)


class Block:
    """Ids, labels and vectors of some rows; `keys` tells them apart even where ids repeat."""

    def __init__(self, block, dim, ids, labels, vectors, largest):
        self.dim, self.largest = dim, largest
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.vectors = np.frombuffer(vectors, np.float64).reshape(len(self.ids), dim)
        self.keys = (block << 12) + np.arange(len(self.ids))

    def scores(self, other: Block) -> np.ndarray:
        if self.dim * self.largest * other.largest < EXACT:
            return (self.vectors @ other.vectors.T).astype(np.int64)
        whole = [[int(x) for x in v] for v in other.vectors]
        return np.array([[sum(int(x) * y for x, y in zip(v, w)) for w in whole] for v in self.vectors], dtype=np.int64)


def _anchors(rows: DataFrame, every: int, name: str) -> DataFrame:
    """(key, vec_id, label, vector) of the rows whose id is divisible by `every`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block = Block(*(c[k].as_py() for c in batch.columns))
                at = np.flatnonzero(block.ids % every == 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.keys[at]), pa.array(block.ids[at]), pa.array(block.labels[at]), pa.array(list(block.vectors[at]), pa.list_(pa.float64()))],
                    names=["key", "vec_id", "label", "vector"],
                )

    return staged(rows.mapInArrow(run, "key long, vec_id long, label long, vector array<double>"), name)


def best(scores: np.ndarray, ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Those `k` places of `at` with the highest scores, of equal ones those with the smallest ids."""
    if len(at) > 4 * k:
        limit = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= limit]
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


class Combiner:
    """The first few (score, id) of each (anchor, slot); passed on when many anchors are held."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def add(self, anchor: tuple, slot: int, scores: np.ndarray, ids: np.ndarray) -> None:
        slots = self.held.setdefault(anchor, {})
        slots[slot] = first([*slots.get(slot, ()), *zip(scores.tolist(), ids.tolist())], self.k)

    def passed_on(self) -> Iterator[tuple]:
        for anchor, slots in self.held.items():
            for slot, found in slots.items():
                for score, i in found:
                    yield *anchor, slot, i, score
        self.held = {}


def first(found: Iterable[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    """The first `k` of (score, id) by falling score, then rising id."""
    return heapq.nsmallest(k, found, key=lambda f: (-f[0], f[1]))


def slots_of(limits: list[int]) -> list[int]:
    """The upper limits of the slots, rising: positives of equal score share one."""
    return sorted(set(limits))


def windows(positives: list[tuple[int, int]], slots: dict[int, list[tuple[int, int]]], k: int, low: int, high: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(positive, rank, negative, positive score, negative score): the merge from the lowest slot up has the best `k` below each limit; those above the window's lower limit are its first."""
    limits, upto, below = slots_of([s for s, _ in positives]), [], {}
    for slot, limit in enumerate(limits):
        upto = first([*upto, *slots.get(slot, ())], k)
        below[limit] = upto
    for s, p in positives:
        for rank, (score, i) in enumerate((n for n in below[s] if low * s <= high * n[0]), 1):
            yield p, rank, i, s, score


_FOUND = "anchor long, anchor_id long, slot int, id long, score long"
_FOUND_ARROW = pa.schema([("anchor", pa.int64()), ("anchor_id", pa.int64()), ("slot", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])


def _met(rows: DataFrame, anchors: DataFrame, n_rows: int, collect, k: int) -> DataFrame:
    """`collect(combiner, anchor_block, limits_of_each, row_block)` over all pairs of blocks: (anchor, anchor_id, slot, id, score), pre-combined by task."""
    # the stated query set against all rows, in blocks: a copy of each anchor block for every few row blocks
    spread = max(1, -(-n_rows // SPREAD))
    copies = anchors.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    placed = rows.withColumn("copy", F.pmod(F.xxhash64("block"), F.lit(spread)).cast("int"))
    columns = ["block", "dim", "ids", "labels", "vectors", "largest"]
    paired = placed.select("copy", "dim", *(F.col(c).alias(f"r_{c}") for c in columns if c != "dim")).join(copies.select("copy", "dim", *(F.col(c).alias(f"a_{c}") for c in columns if c != "dim"), "a_keys", "a_limits"), ["copy", "dim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        combiner = Combiner(k)

        def out():
            found = list(combiner.passed_on())
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found) if found else [()] * 5, _FOUND_ARROW)], schema=_FOUND_ARROW)

        for batch in batches:
            for n in range(batch.num_rows):
                row = {name: batch.column(j)[n].as_py() for j, name in enumerate(batch.schema.names)}
                block = Block(row["r_block"], row["dim"], row["r_ids"], row["r_labels"], row["r_vectors"], row["r_largest"])
                mine = Block(row["a_block"], row["dim"], row["a_ids"], row["a_labels"], row["a_vectors"], row["a_largest"])
                mine.keys = np.frombuffer(row["a_keys"], np.int64)
                collect(combiner, mine, row["a_limits"], block)
                if len(combiner.held) > HELD:
                    yield out()
        yield out()

    return paired.mapInArrow(run, _FOUND)


def _positives(combiner: Combiner, anchors: Block, _, rows: Block) -> None:
    scores = anchors.scores(rows)
    for a, key in enumerate(anchors.keys.tolist()):
        at = np.flatnonzero((rows.labels == anchors.labels[a]) & (rows.keys != key))
        if len(at):
            at = best(scores[a], rows.ids, at, combiner.k)
            combiner.add((key, int(anchors.ids[a])), 0, scores[a][at], rows.ids[at])


def _negatives(low: int, high: int):
    def collect(combiner: Combiner, anchors: Block, limits: list[list[int]], rows: Block) -> None:
        scores = anchors.scores(rows)
        for a, (key, uppers) in enumerate(zip(anchors.keys.tolist(), limits)):
            # windows of negative scores are empty; below the lowest window nothing counts
            uppers = [u for u in uppers if u >= 0] and uppers
            if not uppers:
                continue
            least = -(-low * min(u for u in uppers if u >= 0) // high)
            at = np.flatnonzero((rows.labels != anchors.labels[a]) & (scores[a] >= least) & (scores[a] <= uppers[-1]))
            slot = np.searchsorted(uppers, scores[a][at], side="left")
            for s in np.unique(slot).tolist():
                mine = best(scores[a], rows.ids, at[slot == s], combiner.k)
                combiner.add((key, int(anchors.ids[a])), s, scores[a][mine], rows.ids[mine])

    return collect


def _best_of(found: DataFrame, k: int) -> DataFrame:
    """The first `k` of each (anchor, slot): cut in the tasks before the shuffle, and once more after it."""
    order = Window.partitionBy("anchor", "anchor_id", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("_row", F.row_number().over(order)).where(F.col("_row") <= k).drop("_row")


def hard_negatives(df: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors among `df` (vec_id, label, vector of whole numbers).

    Anchors are the rows whose id is divisible by `every`. For each of an anchor's first
    `positives` other rows of its label, the first `negatives` rows of other labels with
    low * positive_score <= high * negative_score <= high * positive_score.
    """
    rows = _packed(df.select("vec_id", "label", "vector"), ROWS, "negatives-rows")
    anchors = _anchors(rows, every, "negatives-anchors")
    n_rows = rows.count()

    def block_of(anchor_rows: DataFrame, name: str) -> DataFrame:
        """The anchors in blocks, with keys and limits beside the vectors."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            at = TaskContext.get().partitionId() << 32
            for batch in batches:
                frame = batch.to_pandas()
                frame["dim"] = frame.vector.map(len)
                for dim, alike in frame.groupby("dim"):
                    for k in range(0, len(alike), ANCHORS):
                        part = alike.iloc[k : k + ANCHORS]
                        matrix = np.array(part.vector.tolist(), np.float64).reshape(len(part), dim)
                        cells = [at, dim, part.vec_id.to_numpy(np.int64).tobytes(), part.label.to_numpy(np.int64).tobytes(), matrix.tobytes(), float(np.abs(matrix).max(initial=0)), part.key.to_numpy(np.int64).tobytes(), [list(map(int, x)) for x in part.limits]]
                        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, arrow)], schema=arrow)
                        at += 1

        arrow = pa.schema([*_PACKED_ARROW, ("a_keys", pa.binary()), ("a_limits", pa.list_(pa.list_(pa.int64())))])
        few = anchor_rows.coalesce(max(1, n_rows // 8 + 1))
        return staged(few.mapInArrow(run, _PACKED + ", a_keys binary, a_limits array<array<bigint>>"), name)

    found = _met(rows, block_of(anchors.withColumn("limits", F.array().cast("array<bigint>")), "negatives-anchor-blocks"), n_rows, _positives, positives)

    by_score = lambda *fields: F.sort_array(F.collect_list(F.struct(*fields)))
    partners = _best_of(found, positives).groupBy("anchor", "anchor_id").agg(by_score((-F.col("score")).alias("key"), "id", "score").alias("partners"))
    partners = staged(partners, "negatives-positives")
    limits = F.array_sort(F.array_distinct(F.col("partners.score"))).alias("limits")
    limited = anchors.join(partners.select(F.col("anchor").alias("key"), limits), "key").select(*anchors.columns, "limits")
    near = _best_of(_met(rows, block_of(limited, "negatives-limited"), n_rows, _negatives(low, high), negatives), negatives)
    slots = near.groupBy("anchor", "anchor_id").agg(F.collect_list(F.struct("slot", "score", "id")).alias("slots"))

    def start():
        def answers(ids, partners, lists):
            for anchor, mine, found in zip(ids, partners, lists):
                slots: dict[int, list[tuple[int, int]]] = {}
                for f in found:
                    slots.setdefault(f["slot"], []).append((f["score"], f["id"]))
                for w in windows([(p["score"], p["id"]) for p in mine], slots, negatives, low, high):
                    yield anchor, *w

        return answers

    schema = schema_of("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return map_rows(partners.join(slots, ["anchor", "anchor_id"]), ["anchor_id", "partners", "slots"], schema, start)
