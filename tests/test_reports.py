"""CSV texts, wounds, windows over a vocabulary, reports of all kinds, imports and manuals."""

import csv
import datetime
import io
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from larder.operators import chunking, merge, reports, wounds
from larder.sources import documents


def test_csv_records_are_those_of_a_csv_reader(spark):
    rng = random.Random(8)
    pieces = ["a", "b c", ",", ",", "\n", "\r\n", '"', '""', '"x, y"', '"two\nlines"', '"say ""hi"""', '""""', " ", "é", '5" tall']
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(30))) for _ in range(300)] + ["", "\n\n", "a", 'x,"open\nto, the end', 'a,"b" c,d', '"a"\n', '"q"",""r",s\nt']
    df = spark.createDataFrame(list(enumerate(texts)), "d int, t string")
    got = {}
    for r in documents.csv_records(df, "d", "t").orderBy("d", "record").collect():
        got.setdefault(r.d, []).append(r.cells)
    for k, t in enumerate(texts):
        want = [r for r in csv.reader(io.StringIO(t.replace("\r\n", "\n"), newline="")) if r not in ([], [""])]
        mine = got.get(k, [])
        for rows in (mine, want):  # a quote left open takes the rest, with or without the text's last line break
            if rows:
                rows[-1][-1] = rows[-1][-1].rstrip("\n")
        assert [r for r in mine if r != [""]] == [r for r in want if r != [""]], t


def test_csv_of_nulls_and_long_cells(spark):
    long = '"' + 'x""y\n' * 100_000 + '"'
    df = spark.createDataFrame([(1, None), (2, f"h,{long},z\n")], "d int, t string")
    rows = documents.csv_records(df, "d", "t").collect()
    assert [(r.d, len(r.cells), len(r.cells[1]), r.cells[2]) for r in rows] == [(2, 3, 400_000, "z")]


HEAD = "Facility: East,x\nReport 1/25/2026 - 1/26/2026\nPatient Number,Name,Wnd #,Wound Type,Wound Location,Weeks In Treatment,Stage,Assessment Note\n"


def wound(spark, text, **how):
    return wounds.wound_report(spark.createDataFrame([("d", text)], "doc string, text string"), **how).orderBy("identifier", "wound_number").collect()


def test_wound_rows_merge(spark):
    text = HEAD + 'Z1,,1,,Heel,x,,"Improving,\nslowly"\nz1,Mia,1,Ulcer,Toe,4,II,"improving,\nSLOWLY now"\nZ1,Mia,2,nan,,,,none\n,Nobody,3,a,b,,,\nZ2,Ben,,t,l\n'
    rows = wound(spark, text)
    assert [(r.identifier, r.wound_number, r.person_name, r.wound_type, r.location, r.weeks_in_treatment, r.stage, r.assessment_note) for r in rows] == [
        ("Z1", "1", "Mia", "Unknown", "Heel", 4, "II", "improving,\nSLOWLY now"), ("Z1", "2", "Mia", "Unknown", "Unknown", None, None, None), ("Z2", None, "Ben", "t", "l", None, None, None),
    ]
    assert {(r.facility_name, r.observed_at) for r in rows} == {("East", datetime.datetime(2026, 1, 26))}
    assert [r.identifier for r in wound(spark, text, identifier=" z2 ")] == ["Z2"]
    assert wound(spark, "no table") == [] and wound(spark, None) == []
    with pytest.raises(PySparkException):
        wound(spark, text.replace("1/25/2026 - 1/26/2026", "soon"))


def test_wound_texts_are_parsed_within_their_rows(spark):
    """No cell or record is shuffled or joined: the only exchanges are those of the two groupings that unite a wound's rows."""
    df = spark.createDataFrame([("d", HEAD + "Z1,,1,,Heel,x,,note\n")], "doc string, text string")
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(documents.csv_records(df, "doc", "text")) and "Exchange" not in plan(wounds.wound_rows(df))
    whole = plan(wounds.wound_report(df))
    assert whole.count("Exchange") == 2 and "Join" not in whole


def test_cells_by_headings(spark):
    """Of equal headings the last counts, headings that are not there and cells of short rows are nulls; records before the header and tables without it give nothing."""
    df = spark.createDataFrame([(1, 'x,y\n\n H , b,a,b\n1,2,"3,\n4",5\n6\n'), (2, "x,y\n1,2\n"), (3, None), (None, "H\n1\n")], "d int, t string")
    assert [tuple(r) for r in documents.after_header(df, "d", "t", "H", ["b", "H", "none"]).orderBy("record").collect()] == [(1, 3, ["5", "1", None]), (1, 4, [None, "6", None])]
    assert [r.cells for r in documents.after_header(df, "d", "t", "H").orderBy("record").collect()] == [["1", "2", "3,\n4", "5"], ["6"]]


def test_texts_of_very_many_rows_unite(spark):
    df = spark.range(30_000).selectExpr("1 as k", "id as o", "concat('Note ', id % 3) as t", "if(id = 7, 'x', null) as f")
    assert merge.union_texts(df, ["k"], "o", ["t"], ["f"]).select("t", "f").first() == ("Note 0\nNote 1\nNote 2", "x")
    nulls = spark.createDataFrame([(None, 1, "a"), (None, 2, "A b"), (2, 1, None)], "k int, o int, t string")
    assert {r.k: r.t for r in merge.union_texts(nulls, ["k"], "o", ["t"], []).collect()} == {None: "A b", 2: None}


@pytest.mark.parametrize("size,overlap", [(600, 100), (600, 25), (5, 4), (3, 0)])
def test_vocabulary_windows_are_the_librarys(spark, size, overlap):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = chunking._vocabulary(path, public_tokenizers.PATTERN)
    assert isinstance(library, tiktoken.Encoding)
    texts = [None, "", "one", "word " * 600, "word " * 601, "word " * 1100, "日本語 😀 " * 400, "<|endoftext|> x"]
    want = []
    for k, t in enumerate(texts):
        ids, start, number = library.encode_ordinary(t or ""), 0, 0
        while start < len(ids):
            part = ids[start : start + size]
            want.append((k, number, len(part), library.decode(part)))
            if start + size == len(ids):
                break
            start, number = start + size - overlap, number + 1
    df = spark.createDataFrame(list(enumerate(texts)), "d int, t string")
    got = chunking.vocabulary_chunks(df, ["d"], "t", path, public_tokenizers.PATTERN, size, overlap).orderBy("d", "chunk_index")
    assert [tuple(r) for r in got.collect()] == want
    headed = chunking.vocabulary_chunks(df.filter("d = 2"), ["d"], "t", path, public_tokenizers.PATTERN, size, overlap, F.lit("Title"))
    assert headed.first().content == "Title\n\none"


PAGES = [
    ("w", 1, "Weights and Vitals Summary\nStone, Mia (ID7)\n01/02/2024 08:30 150 Lbs (Scale)\n01/02/2024 08:30 151 Lbs"), ("w", 2, "01/03/2024 08:30 152 Lbs"),
    ("n", 1, "Progress Notes *NEW*\nEffective Date: 01/02/2024 10:00\nType: Nursing Note\nNote Text: ate"), ("n", 2, "all\nEffective Date: 01/03/2024 10:00\nNote Text: slept"),
    ("l", 1, "Lab Results\nSodium 140 mmol/L 135 - 145 Final"), ("o", 1, "Order Listing Report\nStone, Mia (ID7)\nRenal diet\nDietary - Diet\nActive\n01/02/2024\nN"),
    ("c", 1, 'Wound Type Tabular Report,1/25/2026\nPatient Number,Name,Wnd #\nZ7,"Mia\nStone",1\n'), ("u", 1, "a letter"), ("e", 1, None),
]


def test_reports_of_all_kinds(spark):
    df = spark.createDataFrame(PAGES, "doc string, page int, text string")
    got = sorted((r.doc, r.kind, r.page, r.fact_type) for r in reports.read_reports(df).collect())
    assert got == [("c", "wounds", 1, "wound"), ("l", "labs", 1, "lab"), ("n", "notes", 1, "note"), ("n", "notes", 1, "note"), ("o", "orders", 1, "diet"), ("u", "unknown", 1, "text"), ("w", "weights", 1, "weight"), ("w", "weights", 2, "weight")]
    assert reports.read_reports(df.limit(0)).count() == 0


def test_imports_go_on(spark):
    files = spark.createDataFrame([("n", "a.PDF"), ("x", "b.txt"), ("l", "c.pdf"), ("gone", "d.pdf"), ("m", None)], "doc string, name string")
    pages = spark.createDataFrame(PAGES + [("x", 1, "Progress Notes *NEW*"), ("m", 1, "Progress Notes *NEW*")], "doc string, page int, text string")
    stored = spark.createDataFrame([], "note_key string")
    new, failures = reports.import_notes(files, pages, stored)
    assert sorted(r.note_text for r in new.collect()) == ["ate\nall", "slept"]
    assert {r.doc: r.reason for r in failures.collect()} == {"x": "not a pdf", "l": "not a progress-note report", "gone": "no pages", "m": "not a pdf"}
    assert reports.import_notes(files, pages, new.select("note_key"))[0].count() == 0


def test_manuals_are_taken_in_once(spark):
    text = ["Renal Diet Guidance", "Eat less salt.", "More text.", "Cardiac Diet Therapy", "Walk."]
    lines = spark.createDataFrame([(d, 1 + k // 3, k, t) for d in ("a", "b", "c") for k, t in enumerate(text)], "doc string, page_number int, line_number int, line string")
    manuals = spark.createDataFrame([("a", "manual", "h1"), ("b", "manual", "h1"), ("c", "manual", "h2")], "doc string, knowledge_type string, file_hash string")
    stored = spark.createDataFrame([("manual", "h2")], "knowledge_type string, file_hash string")
    rows = reports.knowledge_chunks(manuals, lines, stored).orderBy("doc", "chunk_index").collect()
    assert [(r.doc, r.chunk_index, r.section_title) for r in rows] == [("a", 0, "Renal Diet Guidance"), ("a", 1, "Cardiac Diet Therapy")]
    assert rows[0].content.startswith("Renal Diet Guidance") and "salt" in rows[0].content and rows[1].content.startswith("Cardiac Diet Therapy")
    again = reports.knowledge_chunks(manuals, lines, stored, overwrite=True)
    assert {r.doc for r in again.collect()} == {"a", "c"}


def test_food_sources(one):
    assert [one(s=reports.food_source(F.lit(t))) for t in ("Branded", " survey  (FNDDS)", "SR Legacy", "other")] == ["usda_branded", "usda_fndds", "usda_sr_legacy", None]
    assert one(s=reports.checkpoint_source(F.lit("usda_branded"))) == "usda_foundation"
