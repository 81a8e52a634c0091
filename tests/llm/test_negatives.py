"""Hard negatives against the definition, row by row."""

import itertools
import math
import random

import pytest

from larder.llm import hard_negatives
from larder.llm.hard_negatives import Block, Combiner, first, quantised, slots_of, windows

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, every=100):
    """rows: (vec_id, vector, label), as they are given."""
    known = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in rows if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v, c) in enumerate(known):
        if i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j, d) for b, (j, w, d) in enumerate(known) if b != a and len(v) == len(w)]
        for s, p in sorted((s, j) for s, j, d in scored if d == c)[:5]:
            inside = sorted((t, j) for t, j, d in scored if d != c and 80 * -s <= 100 * -t <= 100 * -s)[:5]
            out += [(i, p, k, j, -s, -t) for k, (t, j) in enumerate(inside, 1)]
    return sorted(out)


def found(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema).repartition(3)
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(quantised(df)).collect())


@pytest.mark.parametrize("seed,dim,labels", [(1, 8, 3), (2, 2, 2), (3, 1, 5)])
def test_as_defined(spark, seed, dim, labels):
    rng = random.Random(seed)
    rows = [(rng.choice([k, k, 100 * (k % 9)]), [round(rng.gauss(0.1, 0.3), rng.choice([1, 3])) for _ in range(dim)], rng.randrange(labels)) for k in range(500)]
    want = plain(rows)
    assert len(want) > 30
    assert found(spark, rows) == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(k, [1.0, 0.5], k % 2) for k in range(90, 130)]
    rows += [(100, None, 1), (200, [1.0, None], 1), (300, [nan, 1.0], 0), (400, [inf, 1.0], 0), (None, [1.0, 1.0], 0), (500, [1.0, 1.0], None), (600, [1.0], 1), (601, [1.0], 1), (602, [0.9], 0), (700, [], 1), (701, [], 1), (702, [], 0)]
    rows += [(800, [-1.0, -1.0], 1), (1000, [2.0e6, 3.0e6], 7), (1001, [2.0e6, 3.0e6], 7), (1002, [2.0e6, 2.9e6], 8), (100, [1.0, 0.5], 0)]
    assert found(spark, rows) == plain(rows)
    clashing = [(i, v, c, 0, "k", 1) for i, v, c in rows]
    assert found(spark, clashing, SCHEMA + ", block int, key string, rank int") == plain(rows)
    assert found(spark, []) == []
    assert found(spark, rows[:5]) == []  # no anchor


def test_exact_beyond_doubles():
    big = float((1 << 30) + 1)
    rows = [(0, [big, 3.0], 0), (1, [big, 1.0], 0)]
    ids, labels = (b"".join(int(x).to_bytes(8, "little") for x in v) for v in ([0, 1], [0, 0]))
    import numpy as np

    block = Block(0, 2, ids, labels, np.array([v for _, v, _ in rows]).tobytes(), big)
    assert block.scores(block).tolist() == [[int(a[0]) * int(b[0]) + int(a[1]) * int(b[1]) for _, b, _ in rows] for _, a, _ in rows]


def test_slots_answer_overlapping_windows():
    """All windows of an anchor from the first few of each slot, as from all rows."""
    rng = random.Random(4)
    for _ in range(200):
        positives = sorted(((rng.randrange(-3, 40), i) for i in range(5)), key=lambda p: (-p[0], p[1]))
        rows = [(rng.randrange(-5, 45), 100 + i) for i in range(rng.randrange(60))]
        uppers = slots_of([s for s, _ in positives])
        slots = {}
        for low, (slot, high) in itertools.product([-math.inf], enumerate(uppers)):
            low = uppers[slot - 1] if slot else low
            slots[slot] = first([r for r in rows if low < r[0] <= high], 5)
        want = [(p, k, i, s, t) for s, p in positives for k, (t, i) in enumerate(first([r for r in rows if 80 * s <= 100 * r[0] <= 100 * s], 5), 1)]
        assert list(windows(positives, slots, 5, 80, 100)) == want


def test_combiner_keeps_the_first_of_each_slot():
    import numpy as np

    c = Combiner(2)
    c.add((7, 0), 0, np.array([5, 4]), np.array([1, 2]))
    c.add((7, 0), 0, np.array([5, 9]), np.array([0, 8]))
    c.add((7, 0), 1, np.array([1]), np.array([3]))
    assert list(c.passed_on()) == [(7, 0, 0, 8, 9), (7, 0, 0, 0, 5), (7, 0, 1, 3, 1)] and not c.held
