"""Which notes go on, whose they are, and their statuses over batches."""

import pytest
from pyspark.sql import functions as F

from larder.operators import notes


@pytest.mark.parametrize(
    "kind,text,want",
    [
        ("MD Progress Note", "Seen today.", "send"),
        ("nurse  practioner progress note", "Seen today.", "send"),
        ("Order Note", "Weekly weights go on.", "send"),
        ("Orders - Administration Note", "He declined the shake.", "send"),
        ("Order Note", "Pill given.", "filter"),
        ("NURSING notes", "Slept well.", "filter"),
        ("Nursing Note", "po\n intake fell", "send"),
        ("Nursing Note", "He had overweights on the cart; the pegboard fell.", "filter"),
        ("Nursing Note", "Two pressure ulcers seen.", "send"),
        ("Nursing Note", "Passed  away at noon.", "send"),
        ("Nursing Note", "was pronounced by the physician", "send"),
        ("Social Work Note", "Nothing of note.", "send"),
        (None, "Nothing of note.", "send"),
        ("Nursing Note", None, "filter"),
    ],
)
def test_action(one, kind, text, want):
    assert one(a=notes.action(F.lit(kind).cast("string"), F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(
    "kind,text,want",
    [
        ("Nutrition/Dietary Note", "Full review.", "type"),
        ("Skilled Documentation", "Helped at meals.", "type"),
        ("Nursing Note", "checks her blood  sugar alone", "clinical"),
        ("Nursing Note", "refused a pill", "unrelated"),
        ("Social Services", "asked about SNAP", "social"),
        ("Social Services", "asked about her diet and housing", "unrelated"),
        ("Social Services", "family told that he expired", "critical"),
        ("Orders - Administration Note", "he died", "administration"),
        ("NP/PA Progress Note", "Ben Carter Lowe is a n 80-year-old male.", "other_person"),
        ("NP/PA Progress Note", "Mia Jane Stone is a 80 - year-old woman.", "type"),
        ("Nursing Note", "Ben Lowe is a 70-year-old. He died.", "other_person"),
        ("Nursing Note", None, "unrelated"),
    ],
)
def test_assessment_choice(one, kind, text, want):
    assert one(a=notes.assessment_choice(F.lit(kind), F.lit(text).cast("string"), F.lit("Stone, Mia"))) == want


def test_a_header_of_one_name_settles_nothing(one):
    text = F.lit("Ben Lowe is a 70-year-old man")
    assert one(a=notes.names_another(F.lit("Stone"), text)) is False
    assert one(a=notes.names_another(F.lit(None).cast("string"), text)) is False
    assert one(a=notes.names_another(F.lit("Lowe, Ben"), text)) is False


def test_identities_come_from_filtered_notes_too(spark):
    rows = [(1, "7", "Stone, Mia", "Nursing Note", "Slept."), (2, "7", "Stone, Mia", "Order Note", "Slept."), (3, None, None, "Order Note", "x"), (4, None, "Lowe, Ben", "Order Note", "x"), (5, "", "", "a", "b")]
    df = spark.createDataFrame(rows, "n int, identifier string, person_name string, note_type string, note_text string")
    assert [(r.n, r.identifier) for r in notes.header_identities(df, [F.col("n")]).orderBy("n").collect()] == [(1, "7"), (4, None)]
    assert notes.header_identities(df.limit(0), [F.col("n")]).count() == 0


def test_steps_and_statuses(spark):
    rows = [(1, "a", "Order Note", "Pill given.", "2024-01-01"), (2, "b", "MD Progress Note", "x", "2024-01-01"), (3, "b", "MD Progress Note", "x", "2024-01-01"), (4, "c", "MD Progress Note", "y", None), (5, "d", "MD Progress Note", "y", None), (6, "e", "MD Progress Note", "z", "2024-01-01"), (7, "f", "MD Progress Note", "z", "2024-01-01")]
    df = spark.createDataFrame(rows, "n int, note_key string, note_type string, note_text string, note_date string")
    stored = spark.createDataFrame([("d", "failed", 2), ("e", "skipped", 1), ("f", "pending", 1), ("old", "extracted", 1)], "note_key string, status string, attempts int")
    work = notes.steps(df, stored, [F.col("n")])
    assert [r.step for r in work.orderBy("n").collect()] == ["filtered", "extract", "repeated", "undated", "extract", "done", "extract"]
    outcomes = spark.createDataFrame([("b", False), ("b", True), ("d", False)], "note_key string, ok boolean")
    after = {r.note_key: (r.status, r.attempts) for r in notes.settle(stored, work, outcomes).collect()}
    assert after == {"b": ("extracted", 1), "d": ("failed", 3), "e": ("skipped", 1), "f": ("pending", 2), "old": ("extracted", 1)}


def test_stream_gives_failed_notes_again_and_done_ones_never(spark, tmp_path):
    batches = [
        [("a", "na", None), ("b", "nb", None), ("a", "na again", None)],
        [("a", None, True), ("b", None, False), ("a", "na", None), ("b", "nb", None), ("c", "nc", None)],
        [("a", "na", None), ("b", None, True), ("b", "nb", None), ("c", "nc", None)],
    ]
    given, source = [], tmp_path / "in"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "note_key string, note string, ok boolean").coalesce(1).write.mode("append").parquet(str(source))
        stream = notes.work_stream(spark.readStream.schema("note_key string, note string, ok boolean").parquet(str(source)))
        keep = lambda df, _: given.extend((k, r.note_key, r.note, r.attempt) for r in df.collect())  # noqa: E731, B023
        stream.writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(given) == [(0, "a", "na", 1), (0, "b", "nb", 1), (1, "b", "nb", 2), (1, "c", "nc", 1)]


def test_identity_stream_resolves_each_once(spark, tmp_path):
    seen, source = [], tmp_path / "in"
    for rows in ([("7", "Stone, Mia"), ("7", "Stone, Mia"), (None, None)], [("7", "Stone, Mia"), (None, "Lowe, Ben")]):
        spark.createDataFrame(rows, "identifier string, person_name string").coalesce(1).write.mode("append").parquet(str(source))
        stream = notes.identity_stream(spark.readStream.schema("identifier string, person_name string").parquet(str(source)))
        stream.writeStream.foreachBatch(lambda df, _: seen.extend(map(tuple, df.collect()))).outputMode("append").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination()
    assert seen == [("7", "Stone, Mia"), (None, "Lowe, Ben")]
