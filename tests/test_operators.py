import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from larder.operators import facts, labs, chunking, context, extraction, identity, merge, relational, retrieval, temporal

T = dt.datetime


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_ties_are_conflicts(spark):
    df = spark.createDataFrame([(1, "a", T(2026, 1, 1), 10), (1, "a", T(2026, 1, 1), 11), (2, "a", T(2026, 1, 1), 12), (2, "i", T(2026, 2, 1), 13), (3, "a", None, 14), (3, "a", None, 15), (4, "a", None, 16), (4, "a", T(2020, 1, 1), 17)], "p int, status string, t timestamp, id int")
    active = F.col("status") == "a"
    assert rows(temporal.current(df, ["p"], "t", active).select("p", "id")) == [(2, 12), (4, 17)]
    assert rows(temporal.conflicts(df, ["p"], "t", "id", active)) == [(1, 2, "10,11"), (3, 2, "14,15")]  # unknown times tie with each other


def test_latest_against_prior(spark):
    df = spark.createDataFrame([(1, T(2026, 3, 1), 1, 95.0), (1, T(2026, 2, 1), 2, 100.0), (1, T(2026, 2, 15), 3, -1.0), (1, T(2026, 3, 1), 0, 99.0), (2, None, 4, 5.0)], "p int, t timestamp, id int, v double")
    got = temporal.latest_against_prior(df, ["p"], "t", "id", "v").select("id", "change", "percent", "direction", "window_months", "significant", "elapsed").collect()
    assert [tuple(r) for r in got] == [(2, -5.0, -5.0, "loss", 1, True, "1 month")]


def test_carry_forward_restarts(spark):
    df = spark.createDataFrame([(1, 1, "a", "x"), (1, 2, None, None), (1, 3, "b", None), (1, 4, None, None)], "d int, p int, name string, dob string")
    out = temporal.carry_forward(df, ["d"], ["p"], ["name", "dob"], F.coalesce(F.col("name").isNotNull(), F.lit(False)))
    assert rows(out.select("p", "name", "dob")) == [(1, "a", "x"), (2, "a", "x"), (3, "b", None), (4, "b", None)]


def test_caps(spark):
    df = spark.createDataFrame([(1, k) for k in range(7)] + [(2, 1)], "p int, v int")
    out = temporal.capped_lists(df, ["p"], [F.col("v").desc()], ["v"], 3)
    assert rows(out.select("p", F.transform("items", lambda x: x["v"]).alias("v"), "omitted"), "p") == [(1, [6, 5, 4], 4), (2, [1], 0)]


BATCH = [(1, T(2026, 1, 3), 3.0, None, 1), (1, T(2026, 1, 1), 1.0, "old", 2), (1, T(2026, 1, 3), 4.0, "same", 3), (2, None, 7.0, None, 4), (2, T(2026, 1, 1), 8.0, None, 5)]
SCHEMA = "p int, t timestamp, v double, note string, seq int"


def test_upsert_drops_older_keeps_equal(spark):
    table = spark.createDataFrame([(1, T(2026, 1, 2), 2.0, "kept", 0)], SCHEMA)
    out = merge.upsert(table, spark.createDataFrame(BATCH, SCHEMA), ["p"], "t", "seq", ["v"], ["note"])
    assert rows(out.select("p", "v", "note", "t"), "p") == [(1, 4.0, "same", T(2026, 1, 3)), (2, 8.0, None, T(2026, 1, 1))]


def test_upsert_is_independent_of_row_order_and_repeats(spark):
    table = spark.createDataFrame([(1, T(2026, 1, 2), 2.0, "kept", 0)], SCHEMA)
    seen = set()
    for order in itertools.islice(itertools.permutations(BATCH), 0, 120, 40):
        out = merge.upsert(table, spark.createDataFrame(list(order), SCHEMA), ["p"], "t", "seq", ["v"], ["note"]).select("p", "t", "v", "note", "seq")
        again = merge.upsert(out, spark.createDataFrame(list(order), SCHEMA), ["p"], "t", "seq", ["v"], ["note"]).select("p", "v", "note")
        seen.add(tuple(rows(out.select("p", "v", "note"), "p")))
        assert rows(again, "p") == rows(out.select("p", "v", "note"), "p")
    assert len(seen) == 1


def snapshot_case(spark, incoming):
    schema = "person_id int, facility_id int, kind string, status string, observed_at timestamp, value int"
    table = spark.createDataFrame([(1, 1, "A", "active", T(2026, 1, 1), 1), (1, 1, "B", "active", T(2026, 1, 1), 1), (1, 2, "E", "active", T(2026, 1, 1), 1), (2, 1, "A", "active", T(2026, 1, 1), 1)], schema)
    table = table.withColumn("discontinued_at", F.lit(None).cast("timestamp"))
    out = merge.reconcile_snapshot(table, spark.createDataFrame(incoming, schema), "person_id", ["person_id", "facility_id"], ["kind"], ["value"])
    return rows(out.select("person_id", "kind", "status", "value"))


def test_snapshot(spark):
    before = [(1, "A", "active", 1), (1, "B", "active", 1), (1, "E", "active", 1), (2, "A", "active", 1)]
    new = T(2026, 2, 1)
    assert snapshot_case(spark, [(1, 1, "A", "active", new, 9), (1, 1, "C", "active", new, 9)]) == [(1, "A", "active", 9), (1, "B", "inactive", 1), (1, "C", "active", 9), (1, "E", "active", 1), (2, "A", "active", 1)]
    assert snapshot_case(spark, [(1, 1, "D", "active", T(2026, 1, 1), 9)]) == before  # not newer
    assert snapshot_case(spark, [(1, 1, "D", "active", None, 9)]) == before
    assert snapshot_case(spark, [(1, 1, "D", "inactive", new, 9)]) == before
    assert snapshot_case(spark, [(1, 1, "D", "active", new, 9), (1, 1, "F", "active", T(2026, 2, 2), 9)]) == before
    # a match lies in another facility of the person; only the scope's own rows are switched off
    assert snapshot_case(spark, [(1, 1, "E", "active", new, 9)]) == [(1, "A", "inactive", 1), (1, "B", "inactive", 1), (1, "E", "active", 9), (2, "A", "active", 1)]


def test_union_texts(spark):
    df = spark.createDataFrame([(1, 1, "Improving", "x", None), (1, 2, "improving with less drainage", None, "s2"), (1, 3, "Other", None, "s3")], "w int, o int, note string, orders string, stage string")
    assert rows(merge.union_texts(df, ["w"], "o", ["note", "orders"], ["stage"]).select("w", "note", "orders", "stage")) == [(1, "improving with less drainage\nOther", "x", "s2")]


def test_lifecycle(spark):
    table = spark.createDataFrame([(1, "draft", None, "a"), (2, "finalized", T(2026, 1, 1), "a"), (3, "finalized", T(2026, 1, 1), "a")], "id int, status string, finalized_at timestamp, content string")
    changes = spark.createDataFrame([(1, "finalized", None, T(2026, 5, 5)), (2, "draft", " ", T(2026, 5, 5)), (3, "finalized", "b", T(2026, 5, 5))], "id int, status string, content string, at timestamp")
    got = rows(merge.lifecycle(table, changes, "id").select("id", "status", "finalized_at", "content", "needs_embedding"))
    assert got == [(1, "finalized", T(2026, 5, 5), "a", True), (2, "draft", None, "a", False), (3, "finalized", T(2026, 1, 1), "b", True)]


@pytest.mark.parametrize(("length", "n"), [(550, 2), (600, 1), (650, 2), (1050, 3), (1100, 2), (0, 0), (1, 1)])
def test_windows_of_tokens(one, length, n):
    assert len(one(x=chunking.window_starts(F.lit(length), 600, 100))) == n


@pytest.mark.parametrize(("size", "overlap"), [(10, 8), (10, 0), (10, 9), (3, 1), (1, 0)])
def test_windows_of_any_size(one, size, overlap):
    for length in (0, 1, 2, 9, 10, 11, 12, 20, 31):
        starts, at = [], 0
        while at < length:
            starts.append(at)
            if at + size == length:
                break
            at += size - overlap
        assert one(x=chunking.window_starts(F.lit(length), size, overlap)) == starts, length
    with pytest.raises(ValueError):
        chunking.window_starts(F.lit(1), 3, 3)


def test_chunk_titles(spark):
    df = spark.createDataFrame([(1, "Fluids are good", "fluids"), (2, "x", "Title"), (3, None, "T")], "d int, t string, title string")
    got = rows(chunking.chunks(df, ["d"], chunking.word_tokens(F.coalesce("t", F.lit(""))), title=F.col("title")).select("d", "content"))
    assert got == [(1, "Fluids are good"), (2, "Title\n\nx")]


def test_retrieval(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [1.0, 0.0])], "id long, v array<float>")
    assert [r["id"] for r in retrieval.top_k(df, "v", [1.0, 0.0], 2, ["id"]).collect()] == [1, 4]
    with pytest.raises(ValueError):
        retrieval.top_k(df, "v", [1.0, 0.0], 21, ["id"])
    got = retrieval.batch_top_k(df.filter("id < 3"), df, "id", "v", "id", "v", 1, block=1)
    assert rows(got.select("q", "id")) == [(1, 1), (2, 2)]


def test_orders(spark):
    cases = [
        ("Drugaline 40 mg PO BID", "Pharmacy", ["medication"]),
        ("Formula 1.5 @ 80 mL/hr x16 hr with 250 mL FWF q6h", "Enteral Feed", ["enteral_feeding"]),
        ("Provide Free Water Flush @ 45 ml/hr for TV 700 mls", "Enteral - Feed", ["fluid_plan"]),
        ("CCD / Ground / Thin", "Dietary - Diet", ["diet"]),
        ("Fluid restriction 1500 mL per day", "Other", ["fluid_plan"]),
        ("Regular diet, fluid restriction 1200 mL", "Dietary - Diet", ["diet", "fluid_plan"]),
        ("Cardiac rehab evaluation", "Other", ["misc_order"]),
        ("nothing known", None, ["misc_order"]),
    ]
    df = spark.createDataFrame([(i, s, c) for i, (s, c, _) in enumerate(cases)], "i int, summary string, category string")
    got = {}
    for i, kind in rows(extraction.order_facts(df).select("i", "fact_type")):
        got.setdefault(i, []).append(kind)
    assert got == {i: k for i, (_, _, k) in enumerate(cases)}


def test_order_fields(one):
    feed = one(**extraction.enteral_feeding(F.lit("Provide Formula 1.8 @ 65 ml/hr via peg up at 4:00 pm and down until TV of 1100ml infused")))
    assert (feed["formula"], feed["feeding_method"], feed["hours_per_day"], feed["route"], feed["caloric_density_kcal_ml"]) == ("Formula 1.8", "cyclic", 16.92, "PEG", 1.8)
    drug = one(**extraction.medication(F.lit("Drugaline 40 mg PO BID as needed for pain")))
    assert (drug["name"], drug["dose"], drug["dose_unit"], drug["route"], drug["frequency"], drug["indication"]) == ("Drugaline", 40.0, "mg", "PO", "BID PRN", "pain")
    npo = one(**extraction.diet(F.lit("NPO")))
    assert npo["diet_type"] == "npo" and npo["restrictions"] == ["nothing_by_mouth"]
    assert one(**extraction.fluid_plan(F.lit("Encourage fluids 2 L daily"))) == {"target_ml_day": 2000.0, "restriction_ml_day": None}
    assert one(x=extraction.order_frequency(F.lit("daily then q4h"))) == "DAILY"
    pn = one(**extraction.parenteral_order(F.lit("TPN @ 75 mL/hr over 16 hr dextrose 200 g/L AA 50 g/L via PICC lipid 20% 250 mL piggyback")))
    assert (pn["access_route"], pn["rate_ml_hr"], pn["hours_per_day"], pn["lipid_concentration_percent"], pn["lipid_total_volume_ml"], pn["lipid_delivery"]) == ("central", 75, 16, 20, 250, "piggyback")
    sup = one(**extraction.supplement(F.lit("Magic cup 4 oz PO with meals")))
    assert (sup["product_name"], sup["amount"], sup["unit"], sup["frequency"]) == ("Magic cup", 4.0, "oz", "WITH MEALS")


def test_words_reports_and_segments(spark):
    words = spark.createDataFrame([("d", 1, 60.0, 10.0, "b"), ("d", 1, 20.0, 11.5, "a"), ("d", 1, 20.0, 13.0, "c")], "doc string, page_number int, x0 double, y0 double, text string")
    assert rows(extraction.group_words(words, ["doc", "page_number"]).select("line_number", "line")) == [(0, "a b"), (1, "c")]
    pages = spark.createDataFrame([("d", 1, "P1", None), ("d", 2, "P1", "7"), ("d", 3, None, "8"), ("d", 4, "P2", None), ("d", 5, "P3", None)], "doc string, page_number int, person_identifier string, order_number string")
    assert [r[1] for r in rows(extraction.split_reports(pages).select("page_number", "report"))] == [1, 1, 2, 2, 3]
    pages = {1: ["Sample Diet Manual", "Fluid Needs of Adults", "Drink water.", "Selected References: A-Z", "1. A book", "Protein Needs", "Renal Diet Guidance", "Eat."], 2: ["Sample Diet Manual", "Fluids .. 3", "Eggs ...... 4", "Loose words", "Page 2"], 3: ["Subject Index", "Milk, 5", "Milk Needs", "Definition", "Milk is white.", "Copyright of all"]}
    lines = spark.createDataFrame([("d", n, k, x) for n, page in pages.items() for k, x in enumerate(page)], "doc string, page_number int, line_number int, line string")
    got = [tuple(r) for r in extraction.content_segments(lines).orderBy("page_number", "line_number").select("page_number", "line_number", "section_title").collect()]
    assert got == [(1, 1, "Fluid Needs of Adults"), (1, 2, "Fluid Needs of Adults"), (1, 6, "Renal Diet Guidance"), (1, 7, "Renal Diet Guidance"), (3, 2, "Milk Needs"), (3, 3, "Milk Needs"), (3, 4, "Milk Needs")]


def test_notes(spark):
    lines = spark.createDataFrame([("d", k, x) for k, x in enumerate(["head", "Effective Date: 01/02/2026 10:00", "Type: Dietary Note", "Author: A", "Note Text : Eats", "well", "Effective Date: 01/03/2026 10:00", "Note Text: BS: 120"])], "doc string, line_number int, line string")
    notes = extraction.notes_of(lines)
    assert rows(notes.select("note", "note_type", "note_text")) == [(1, "Dietary Note", "Eats\nwell"), (2, None, "BS: 120")]
    values, refused = extraction.administration(notes.withColumn("p", F.lit(1)), "p", "note_date", "note_text")
    assert [r["value"] for r in values.collect()] == [120.0] and refused.count() == 0


def test_split_and_unique(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, -1)], "id int, v int")
    good, bad = relational.split_valid(df, {"positive": F.col("v") > 0})
    assert rows(good.select("id")) == [(1,), (2,)] and rows(bad.select("id", "broken")) == [(3, ["positive"])]


def test_identity(spark):
    schema = "person_id long, first_name string, last_name string, date_of_birth date, identifier string, facility_id long, sex string"
    d = dt.date(1950, 1, 1)
    people = spark.createDataFrame([(1, "Ada", "Sample", d, "Z1", 1, "f"), (2, "Bo", "Twin", None, None, 1, "m"), (3, "Bo", "Twin", None, None, 2, "m")], schema)
    records = spark.createDataFrame([(1, "x", "y", d, "Z1", 1, "f"), (2, "ADA", " sample", d, None, 9, "f"), (3, "Bo", "Twin", None, None, 1, "m"), (4, "New", "One", d, None, 1, "f"), (5, "New", "one", d, None, 2, "f"), (6, "x", "y", dt.date(1960, 1, 1), "Z1", 1, "f")], schema.replace("person_id", "record_id"))
    got = {r["record_id"]: r for r in identity.resolve(records, people).collect()}
    assert [(got[k]["status"], got[k]["person_id"]) for k in range(1, 7)] == [("matched", 1), ("matched", 1), ("ambiguous", None), ("new", None), ("new", None), ("conflict", None)]
    assert got[4]["new_key"] == got[5]["new_key"]


def test_context(spark):
    df = spark.createDataFrame([(1, list(range(8)), ["m" * 9000], " ")], "p int, notes array<int>, matches array<string>, extra string")
    got = context.budget(df, {"notes": 5}, extra="extra", matches="matches").first()
    assert got["notes"] == [0, 1, 2, 3, 4] and got["omitted"] == {"notes": 3} and got["extra"] is None
    assert len(got["matches"][0]) <= 3600 and got["saved_tokens"] == got["raw_tokens"] - got["budgeted_tokens"]


def test_lists_of_different_lengths_fail(spark):
    df = spark.createDataFrame([(1, ["a", "b"], [[1.0]])], "k int, c array<string>, v array<array<double>>")
    with pytest.raises(Exception, match="differ in number"):
        chunking.zip_vectors(df, "c", "v", ["k"]).collect()


def test_lab_lines(one):
    read = lambda line: one(x=labs.result_of_line(F.lit(line)))
    assert read("  Sodium, Serum  140 mmol/L 135 - 145 H Final").asDict() == {"name": "Sodium, Serum", "result": "140", "unit": "mmol/L", "reference_range": "135 - 145"}
    assert read("PSA <0.1 See note < 4.0 Corrected").asDict() == {"name": "PSA", "result": "<0.1", "unit": "See note", "reference_range": "< 4.0"}
    assert read("Ratio 3 Preliminary").asDict() == {"name": "Ratio", "result": "3", "unit": None, "reference_range": None}
    for line in ("Sodium 140 mmol/L Pending", "REDRAW NOTE 1 Final", "Sodium Invalid Final", "Sodium * Final", "140 mmol/L Final", "Final H 3", "", "H Final", "Sodium none Final"):
        assert read(line) is None, line


def test_lab_columns(spark):
    at = lambda x, y, t, w=40: (1, float(x), float(x + w), float(y), t)
    head = [at(x, 50 + k % 2, t) for k, (x, t) in enumerate([(20, "Test"), (180, "Result"), (250, "Unit"), (320, "Ref."), (390, "Flag"), (460, "STATUS:")])]
    early = [at(20, 10, "Old"), at(180, 10, "5"), at(460, 10, "Final")]
    body = [at(20, 70, "Blood"), at(62, 71.5, "Urea"), at(180, 70, "7.1"), at(250, 70, "mmol"), at(320, 70, "3-8"), at(460, 70, "Final"), at(20, 90, "Iron"), at(180, 90, "Pending"), at(460, 90, "Final"), at(20, 110, "Zinc"), at(180, 110, "2"), at(390, 110, "L"), at(460, 110, "Open")]
    words = spark.createDataFrame(early + head + body + [(2, 20.0, 60.0, 5.0, "prose")], "page int, x0 double, x1 double, y0 double, text string")
    assert rows(labs.results_of_words(words, ["page"]).drop("line_number")) == [(1, "Blood Urea", "7.1", "mmol", "3-8", None)]


def test_facts_find_their_relations(spark):
    data = [("wound", {"wound_type": "ulcer", "action": "x"}), ("edema", {"location": ""}), ("weight", {"measured_at": "2026-01-05"}), ("diet", {"diet_type": " Renal  DIET", "status": "active"}), ("diet", {"diet_type": "renal diet", "status": "inactive", "observed_at": "2026-01-01"}), ("appetite", {"level": "good"}), ("other", {"observed_at": "2026-01-01"}), ("lab", None)]
    got = facts.routed(spark.createDataFrame([(i, *d) for i, d in enumerate(data)], "i int, fact_type string, payload map<string,string>")).orderBy("i").collect()
    assert [r["relation"] for r in got] == ["person_wound", "person_edema", "person_weight", "person_diet", "person_diet", "person_appetite_observation", None, "person_lab"]
    assert got[0]["row"] == {"type": "ulcer", "location": "Unspecified"} and got[1]["row"] == {"location": "Unspecified"}
    assert got[2]["observed_at"] == T(2026, 1, 5) and got[6]["observed_at"] is None
    assert got[3]["state_key"] == got[4]["state_key"] is not None and got[2]["state_key"] is None and got[5]["observation_key"]
    twice = spark.createDataFrame([("d", 1, p, k, "diet", {"a": "b"}) for p in (7, 8) for k in (0, 1)], "doc string, source_page int, person int, at int, fact_type string, payload map<string,string>")
    assert rows(facts.once(twice, "doc", ["person"], ["at"]).select("person", "at")) == [(7, 0), (8, 0)]


def test_set_rules(spark, one):
    pair = F.array(F.lit("a"), F.lit("b"), F.lit("b"))
    assert one(x=relational.has_all(pair, ["b", "a"])) and not one(x=relational.has_all(pair, ["c"])) and one(x=relational.same_set(pair, F.array(F.lit("b"), F.lit("a"))))
    assert one(x=relational.of_type(F.lit("7"), "int")) == 7 and one(x=relational.of_type(F.lit(None).cast("string"), "int")) is None
    with pytest.raises(Exception, match="not of type"):
        one(x=relational.of_type(F.lit("x"), "int"))
    df = spark.createDataFrame([("diet", None), ("diet", "own"), ("lab", None)], "kind string, source string")
    assert rows(relational.from_own_source(df, "kind", "diet", "source", ["own"])) == [("diet", "own"), ("lab", None)]
