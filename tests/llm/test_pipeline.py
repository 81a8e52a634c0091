import collections
import os

import pytest

import corpus_pipeline
from larder.llm import queries, secret_scan
from larder.llm.common import staged

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


def test_stages_take_effect(spark):
    from tests.llm.test_corpus import plain_components

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = staged(stage(spark, docs, SF), "test")
        seen[name] = (before, docs)
        if name != "best_fit_packing":
            assert docs.columns == columns
    assert seen["quality_rules"][1].count() < seen["quality_rules"][0].count()
    before, after = seen["near_dedup"]
    rows = before.select("doc_id", "text").collect()
    want, _ = plain_components([r[0] for r in rows], [r[1] for r in rows], 5)
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(i for i, c in want.items() if i == c)
    assert not any(secret_scan.base_spans(r["text"]) for r in seen["secret_scan"][1].collect())
    packed = seen["best_fit_packing"][1].collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in seen["secret_scan"][1].collect()}
    fill = collections.Counter()
    for r in packed:
        fill[r["sequence_id"]] += r["length"]
    key = lambda rows: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert key(corpus_pipeline.run(spark, SF).collect()) == key(packed)
    assert max(fill.values()) <= 1024 and len(fill) <= sum(fill.values()) / 1024 * 1.05 + 1


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_query_covers_its_table(spark, name):
    df = queries.QUERIES[name](spark, SF)
    if name == "op13_hard_negatives":
        anchors = {r["vec_id"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id % 100 = 0").collect()}
        assert {r["anchor_id"] for r in df.collect()} == anchors
        return
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert df.select("doc_id").distinct().count() == n
