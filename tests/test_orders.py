"""Order reports: places of matches, times, facilities, orders with and without persons; feeding sentences."""

import datetime
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from larder import fixed_values as fixed
from larder.functions import sentences
from larder.operators import orders

PATTERN = r"\bN(\d+)\b"


@pytest.mark.parametrize("text", ["", "N1", "xN1 N2", "N1 and N22, N333", "no", "aN1\nN2\n\nN3 end", "é N4 漢 N5"])
def test_occurrences_are_those_of_a_regex(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(orders.occurrences(F.col("t"), PATTERN).alias("o")).first().o
    want, at = [], 0
    for m in re.finditer(PATTERN, text, re.ASCII):
        want.append((text[at : m.start()], m.group(), m.start(), m.end()))
        at = m.end()
    if "é" not in text:  # what a word is differs beyond ASCII
        assert [tuple(o) for o in got] == want
    assert all(text[o.start : o.end] == o.hit for o in got)
    assert spark.createDataFrame([(None,)], "t string").select(orders.occurrences(F.col("t"), PATTERN).alias("o")).first().o is None


@pytest.mark.parametrize(
    "text,want",
    [
        ("Date: 9/1/2026\nTime: 4:00 PM", datetime.datetime(2026, 9, 1, 16)),
        ("Date: Aug 27, 2026 Time: 10:35:23 ET", datetime.datetime(2026, 8, 27, 14, 35, 23)),
        ("Date: January 5, 2026\nTime: 23:10 PST", datetime.datetime(2026, 1, 6, 7, 10)),
        ("Date: 09/01/2026", datetime.datetime(2026, 9, 1)),
        ("Date: 09/01/2026 Time: 25:00", None),
        ("Date: 09/01/2026 Time: 4:00 PM XYZ", None),
        ("Date: soon", None),
        ("", None),
    ],
)
def test_report_time(one, text, want):
    assert one(t=orders.report_time(F.lit(text))) == want


def test_mode_and_facility(one):
    assert one(m=orders.report_mode(F.lit("x order status :  ACTIVE y"))) == "active_snapshot"
    assert one(m=orders.report_mode(F.lit("Order Status: Activated"))) == "incremental"
    assert one(m=orders.report_mode(F.lit(None).cast("string"))) == "incremental"
    name = lambda t: one(n=orders.facility_name(F.lit(t), "Order Listing Report", "Lab Results"))
    assert name("\n order listing REPORT \n\n North House \nDate: x") == "North House"
    assert name("North House\nLab Results\nTime: 4") == "North House"
    assert name("Facility #: 3\nLab Results\nTime: 4\nOrder Listing Report\nEast") == "East"
    assert name("North House\nOther title") is None and name("") is None


def test_order_parts(one):
    parts = lambda t: one(p=orders.order_parts(F.lit(t)))
    assert parts("Give 1 Pharmacy Active 03/24/2026 04/01/2026 N and more") == ("Give 1 and more", "Pharmacy", "Active", datetime.date(2026, 3, 24))
    assert parts("Shake Dietary - Active 03/24/2026 N Supplements") == ("Shake", "Dietary - Supplements", "Active", datetime.date(2026, 3, 24))
    assert parts("Nepro Enteral  -  Feed\nCompleted 03/24/2026") == ("Nepro", "Enteral - Feed", "Completed", datetime.date(2026, 3, 24))
    assert parts("no category") is None


PAGE = "Order Listing Report\nNorth House\nDate: 09/01/2026\nTime: 4:00 PM\nResident: Stone, Mia (X1) Order Status: {}\n{}\nPage 1 of 2"
ORDER = "Stone, Mia (X1)\n{}\n{}\nActive\n08/01/2026\nN\n"


def facts(spark, pages, **how):
    rows = orders.report_orders(spark.createDataFrame(pages, "doc string, page int, text string"), **how).orderBy("doc", "page", "record").collect()
    return [(r.doc, r.page, r.identifier, r.summary, r.fact_type, r.report_mode) for r in rows]


def test_report_orders(spark):
    first = PAGE.format("Active", ORDER.format("Check for ESSENTIAL\nHYPERTENSION (I10)", "Laboratory") + ORDER.format("Renal diet", "Dietary - Diet") + "Lowe, Ben (B2) Renal diet\nDietary - Diet\nActive\n08/01/2026\nN\n")
    second = PAGE.format("Active", ORDER.format("renal  DIET", "Dietary - Diet") + ORDER.format("No category", "Unknown"))
    want = [("a", 1, "X1", "Check for ESSENTIAL HYPERTENSION (I10)", "misc_order", "active_snapshot"), ("a", 1, "X1", "Renal diet", "diet", "active_snapshot"), ("a", 1, "B2", "Renal diet", "diet", "active_snapshot")]
    assert facts(spark, [("a", 1, first), ("a", 2, second)]) == want
    bare = PAGE.format("All", "Name\nReorder\nCoreg 6.25 mg\nPO BID\nPharmacy\nActive\n08/01/2026\nN\nRenal diet, fluid restriction 1500 ml\nDietary - Diet\nActive\n08/02/2026\nN\n")
    assert facts(spark, [("b", 1, bare)]) == []
    assert facts(spark, [("b", 1, bare)], relaxed=True) == [("b", 1, None, "Coreg 6.25 mg PO BID", "medication", "incremental"), ("b", 1, None, "Renal diet, fluid restriction 1500 ml", "diet", "incremental"), ("b", 1, None, "Renal diet, fluid restriction 1500 ml", "fluid_plan", "incremental")]
    with pytest.raises(PySparkException):
        facts(spark, [("c", 1, first.replace("Date: 09/01/2026", "Date: soon"))])
    assert facts(spark, [("d", 1, None), ("e", 1, "")]) == []


def test_weights_once_and_identity(spark):
    rows = spark.createDataFrame([("d", 1, 0, "p", 5, 100.0), ("d", 1, 1, "p", 5, 101.0), ("d", 2, 0, "p", 6, 1.0), ("d", 2, 1, None, 5, 2.0), ("d", 2, 2, None, 5, 3.0)], "doc string, page int, place int, person_id string, measured_at int, weight_lb double")
    assert sorted(r.weight_lb for r in orders.weight_facts(rows, "doc", "page").collect()) == [1.0, 2.0, 100.0]
    assert orders.with_identity(rows, "person_id", relaxed=True).count() == 5
    with pytest.raises(PySparkException):
        orders.with_identity(rows, "person_id").collect()
    assert orders.with_identity(rows.filter("person_id IS NOT NULL"), "person_id").count() == 3


def test_sentences(one):
    L, none = F.lit, F.lit(None)
    i = none.cast("int")
    assert one(s=sentences.continuous_order(L("NEPRO 1.8"), L(65), L("peg"), L("6pm"), L(1000), i, i, i, i)) == "Rec NEPRO 1.8 @ 65 ml/hr via PEG up at 6pm. AND every day shift document total volume infused in 24 hrs (1000 ml)."
    assert "START AT 20 ML/HR. INCREASE BY 10 ML EVERY HOUR UNTIL 65ML/HR. AND" in one(s=sentences.continuous_order(L("N"), L(65), L("peg"), L("6pm"), L(1000), L(20), L(10), L(30), L(600)))
    assert one(s=sentences.continuous_order(L("N"), L(65), none.cast("string"), L("6pm"), L(1000), i, i, i, i)).startswith("Incomplete continuous")
    assert one(s=sentences.bolus_order(L("N"), L(240), L("peg"), L(4), L(960), L(30), L(240))).endswith(" FWF 30 ml before and after each bolus to provide TV 240 mls.")
    summary = lambda *x: one(s=sentences.nutrition_summary(*map(L, x)))
    assert summary(1947.0, 89.5, 1500.0, True, False) == "TF + FWF are providing res with 1947 kcal, 89.5 g PRO and 1500 mls fluids."
    assert summary(900.0, 40.0, 70.0, False, False) == "TF is providing res with 900 kcal, 40 g PRO and 70 mls fluids."


def test_patterns_have_no_empty_match():
    for pattern in (fixed.ORDER_CATEGORY, fixed.ORDER_PERSON, fixed.REPORT_DATE, fixed.REPORT_TIME):
        assert not re.match(pattern, "")
