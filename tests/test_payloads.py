"""Canonical payloads, keys, rows, and merges of many record types at once."""

import datetime
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from larder.operators import merge, payloads

T = datetime.datetime


def payload(**values):
    names = ["diet_type", "restrictions", "amount", "n", "parts", "more", "status", "observed_at", "location", "wound_type", "source_category"]
    return tuple(values.get(n) for n in names)


SCHEMA = "fact_type string, payload struct<diet_type:string,restrictions:array<string>,amount:double,n:int,parts:array<struct<tag:string,n:int,status:string>>,more:map<string,string>,status:string,observed_at:timestamp,location:string,wound_type:string,source_category:string>"


def test_canonical_text(spark):
    row = payload(diet_type='a "b" \\', restrictions=["y", None, "x"], amount=5.0, n=3, parts=[("t", 1, "active"), None], more={"z": "1", "a": None, "b": "2"}, observed_at=T(2024, 1, 2, 3, 4, 5))
    df = spark.createDataFrame([("diet", row), ("diet", None)], SCHEMA)
    text = payloads.canonical(F.col("payload"), df.schema["payload"].dataType)
    assert [r[0] for r in df.select(text).collect()] == [r'{"amount":5,"diet_type":"a \"b\" \\","more":{"b":"2","z":"1"},"n":3,"observed_at":"2024-01-02T03:04:05","parts":[{"n":1,"status":"active","tag":"t"},null],"restrictions":["y",null,"x"]}', None]


def test_state_keys_ignore_order_case_and_course(spark):
    same = [
        payload(diet_type=" Renal  Diet", restrictions=["B", "a"], parts=[("x", 2, "s"), ("y", 1, None)], amount=2.50, status="active", more={"k": "V", "status": "x"}),
        payload(diet_type="renal diet", restrictions=["A ", "b"], parts=[("Y", 1, "other"), ("x", 2, None)], amount=2.5, status="inactive", observed_at=T(2024, 1, 1), source_category="c", more={"k": "v"}),
    ]
    other = [payload(diet_type="renal diet", restrictions=["a"]), payload(diet_type="renal diet", restrictions=["a", "a"]), payload(diet_type="renaldiet", restrictions=["a"]), payload(restrictions=["renal diet", "a"]), payload(diet_type="", restrictions=["a"]), payload(restrictions=["a"])]
    df = spark.createDataFrame([("diet", p) for p in same + other] + [("allergy", same[0]), ("appetite", same[0]), ("weight", same[0]), ("unheard_of", same[0])], SCHEMA)
    rows = payloads.routed(df).collect()
    assert rows[0].state_key == rows[1].state_key and rows[0].fact_key != rows[1].fact_key
    assert rows[6].state_key == rows[7].state_key  # an empty text is none
    assert len({r.state_key for r in rows[:9]}) == 7  # the type is part of the key
    assert [(r.relation, r.state_key is None, r.observation_key is None) for r in rows[9:]] == [("person_appetite_observation", True, False), ("person_weight", True, True), (None, True, True)]


def test_rows_and_back_fill(spark):
    df = spark.createDataFrame([("wound", payload(wound_type="ulcer", location="", source_category="x")), ("edema", payload(location="Leg")), ("diet", payload(wound_type="w", location=None)), ("diet", None)], SCHEMA)
    kind = df.schema["payload"].dataType
    filled = df.withColumn("payload", payloads.back_filled(F.col("payload"), kind, F.lit("2024-05-06").cast("timestamp")))
    rows = payloads.routed(filled).collect()
    assert [(r.row.location, r.row.type) if r.row else None for r in rows] == [("Unspecified", "ulcer"), ("Leg", None), (None, None), None]
    assert "source_category" not in rows[0].row.asDict() and "wound_type" not in rows[0].row.asDict()
    assert rows[0].observed_at == T(2024, 5, 6) and rows[3].observed_at is None
    known = spark.createDataFrame([("edema", payload(observed_at=T(2020, 1, 1)))], SCHEMA)
    assert known.select(payloads.back_filled(F.col("payload"), kind, F.lit("2024-05-06").cast("timestamp"))["observed_at"]).first()[0] == T(2020, 1, 1)


def test_facts_of_notes(spark):
    df = spark.createDataFrame([(1, 0.5, payload()), (2, 0.7, payload(observed_at=T(2020, 1, 1)))], "note_id long, confidence double, " + SCHEMA.split(", ", 1)[1])
    notes = spark.createDataFrame([(1, 77, "f", datetime.date(1950, 1, 1), 60.0, T(2024, 1, 1)), (2, None, "m", datetime.date(1960, 1, 1), None, T(2024, 1, 2))], "note_id long, person_id long, sex string, date_of_birth date, height_in double, note_date timestamp")
    guessed = {r.note_id: r for r in payloads.note_facts(df, notes, model="m1").collect()}
    assert (guessed[1].sex, guessed[1].payload.observed_at, guessed[1].confidence, guessed[1].extraction_method, guessed[1].model_name) == (None, T(2024, 1, 1), 0.5, "ai", "m1")
    assert (guessed[2].sex, guessed[2].payload.observed_at) == ("m", T(2020, 1, 1))
    assert {(r.confidence, r.confidence_reason) for r in payloads.note_facts(df, notes).collect()} == {(1.0, payloads.DETERMINISTIC_REASON)}


def test_documents_without_facts_are_their_own_source(spark):
    documents = spark.createDataFrame([(1, "sha256:aa"), (2, "sha256:bb")], "document_id long, checksum string")
    facts = spark.createDataFrame([(1, 3, "h", "diet", 2), (1, 3, "h", "weight", 1), (1, None, "h", "diet", 3)], "document_id long, source_page int, evidence_hash string, fact_type string, fact_order int")
    got = sorted(map(tuple, payloads.document_sources(documents, facts).collect()), key=repr)
    assert got == [(1, 3, "h", "weight"), (1, None, "h", "diet"), (2, None, "bb", "document")]


POLICIES = {
    "weight": {"overwrite": ["lb"], "fill": ["note"], "guard": False},
    "edema": {"overwrite": [], "fill": ["severity"], "guard": False},
    "diet": {"overwrite": ["diet", "parts"], "fill": [], "guard": True},
    "allergy": {"overwrite": [], "fill": ["status"], "keep": ["name"], "guard": True},
}
FIELDS = "lb double, note string, severity string, diet string, parts array<int>, status string, name string"


def test_merge_by_type_is_each_single_merge(spark):
    rng = random.Random(3)
    some = lambda *xs: rng.choice([None, *xs])
    rows = []
    for k in range(300):
        at = some(*(T(2024, 1, d) for d in range(1, 6)))
        rows.append((rng.choice(list(POLICIES)), rng.randrange(6), "r", at, k, some(k, k), k >= 150, some(1.5, 2.0), some("a", "b"), some("s", "t"), some("x", "y"), some([1, 2], []), some("on", "off"), some("n", "m")))
    df = spark.createDataFrame(rows, f"kind string, person_id long, record_key string, observed_at timestamp, seq long, fact_id long, incoming boolean, {FIELDS}")
    names = [f.split()[0] for f in FIELDS.split(", ")]
    packed = df.withColumn("payload", F.to_variant_object(F.struct(*names))).drop(*names)
    old, new = (packed.filter(c).drop("incoming") for c in ("NOT incoming", "incoming"))
    merged, detached = merge.merge_by_type(old, new, POLICIES)
    kinds = dict(f.split(" ") for f in FIELDS.split(", "))
    for kind, p in POLICIES.items():
        fields = [*p["overwrite"], *p["fill"]]
        plain = df.filter(F.col("kind") == kind)
        keys = ["person_id", "record_key"]
        single = merge.upsert(*(plain.filter(c).select(*keys, "observed_at", "seq", *fields) for c in ("NOT incoming", "incoming")), keys, "observed_at" if p["guard"] else None, "seq", p["overwrite"], p["fill"])
        mine = merged.filter(F.col("kind") == kind).select("person_id", *(F.try_variant_get("payload", f"$.{f}", kinds[f]).alias(f) for f in fields))
        assert sorted(map(repr, (tuple(r) for r in mine.collect()))) == sorted(map(repr, (tuple(r) for r in single.select("person_id", *fields).collect()))), kind
    held = {(r.kind, r.person_id): r.fact_id for r in merged.collect()}
    gone = {(r.kind, r.person_id, r.fact_id) for r in detached.collect()}
    assert gone == {(r[0], r[1], r[5]) for r in rows if r[5] is not None and held[r[0], r[1]] != r[5]}
    with pytest.raises(PySparkException):
        merge.merge_by_type(old, new, {"weight": POLICIES["weight"]})[0].collect()
