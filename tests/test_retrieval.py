"""Search over hyperplane buckets against the exact scan."""

import numpy as np
import pytest

from larder.operators import retrieval


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 16))
    vectors = centres[rng.integers(0, 60, 3000)] + 0.15 * rng.normal(size=(3000, 16))
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)] + [(3000, [0.0] * 16)], "id long, v array<double>").cache()


def test_few_probes_find_nearly_all_of_clustered_vectors(clustered):
    queries = clustered.filter("id % 50 = 0")
    exact = retrieval.batch_top_k(queries, clustered, "id", "v", "id", "v", 5)
    found = retrieval.probed_top_k(queries, clustered, "id", "v", "id", "v", 5, bits=6, dims=16, n_probes=6)
    assert retrieval.recall(found, exact) >= 0.95
    buckets = retrieval.hyperplane_buckets(clustered, "v", 6, 16)
    pairs = queries.select(retrieval.F.explode(retrieval.probes(retrieval.F.col("v"), 6, 16, 6)).alias("bucket")).join(buckets, "bucket").count()
    assert pairs < 0.35 * queries.count() * clustered.count()


def test_all_buckets_are_exact(clustered):
    queries = clustered.filter("id % 500 = 0")
    exact = retrieval.batch_top_k(queries, clustered, "id", "v", "id", "v", 5)
    found = retrieval.probed_top_k(queries, clustered, "id", "v", "id", "v", 5, bits=3, dims=16, n_probes=8)
    key = lambda r: (r.q, r.place)
    assert [(r.q, r.id) for r in sorted(found.collect(), key=key)] == [(r.q, r.id) for r in sorted(exact.collect(), key=key)]


def test_own_bucket_is_the_first_probe(clustered):
    rows = retrieval.hyperplane_buckets(clustered, "v", 5, 16).select("bucket", retrieval.probes(retrieval.F.col("v"), 5, 16, 32).alias("p")).limit(200).collect()
    assert all(r.p[0] == r.bucket and sorted(r.p) == list(range(32)) for r in rows if r.bucket != 31 or r.p[0] == 31)
    with pytest.raises(ValueError):
        retrieval.probed_top_k(clustered, clustered, "id", "v", "id", "v", 5, 13, 16, 1)
