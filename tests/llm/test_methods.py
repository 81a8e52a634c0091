"""The learner against its update rule written out for one coordinate at a time, and packing under limits that bind."""

import math
import random

import numpy as np
import pytest

from larder.llm import hashed_linear, packing


def test_leader_is_ftrl_proximal_by_coordinate():
    rng = random.Random(3)
    alpha, beta, l1, l2 = 0.3, 0.7, 2.0, 0.2
    model, z, n = hashed_linear.Leader(alpha, beta, l1, l2), {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(400):
        at = sorted(rng.sample(range(30), rng.randrange(1, 8)))
        x = [rng.choice([1.0, 0.5, -0.25]) for _ in at]
        y, importance = float(rng.random() < (0.8 if 3 in at else 0.2)), rng.choice([1.0, 2.5])
        model.learn(np.array(at), np.array(x), y, importance)
        w = [weight(i) for i in at]
        p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x))))
        for i, xi, wi in zip(at, x, w):
            g = importance * (p - y) * xi
            sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
            z[i] = z.get(i, 0.0) + g - sigma * wi
            n[i] = n.get(i, 0.0) + g * g
    learnt = model.weights()
    assert np.allclose(learnt[:30], [weight(i) for i in range(30)], atol=1e-6) and not learnt[30:].any()
    assert learnt[3] > 0 and (learnt[:30] == 0).any()


@pytest.mark.parametrize("documents,attention,rule", [(3, None, "residual_norm"), (None, 900, "residual_norm"), (4, 1500, "dot_product"), (1, None, "residual_norm")])
def test_packing_under_limits_that_bind(spark, documents, attention, rule):
    rng = random.Random(5)
    capacity = 64
    texts = [(k, " ".join(rng.choice(["river", "stone", "a", "the"]) for _ in range(rng.choice([1, 2, 3, 5, 9, 25] + ([] if attention else [150]))))) for k in range(160)]
    pieces = packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), capacity=capacity, max_documents=documents, max_attention=attention, rule=rule).collect()
    bins = {}
    for r in pieces:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= capacity
        assert documents is None or len(own) <= documents
        assert attention is None or sum(n * n for _, n in own) <= attention
    lengths = [r.length for r in pieces]
    assert max(map(len, bins.values())) == (documents or max(map(len, bins.values())))
    least = max(-(-sum(lengths) // capacity), -(-len(lengths) // documents) if documents else 0)
    assert least <= len(bins) <= 2 * least + (len(lengths) if attention else 0)
    if attention:  # no piece may cost more than a sequence
        with pytest.raises(ValueError):
            packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), capacity=capacity, max_attention=100)
    free = packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), capacity=capacity).select("sequence_id").distinct().count()
    assert len(bins) > free  # the limits do bind
