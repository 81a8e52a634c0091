"""Whole records of people, components and identities of one batch."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from larder.operators import detail, identity
from larder.operators.components import components

DAY = datetime.datetime


def plain_components(edges):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        top[high] = low
    return {x: find(x) for x in top}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    chain = [(k, k + 1) for k in range(1000, 1040)]
    star = [(500, 500 + k) for k in range(1, 60)]
    edges = chain + star + [(rng.randrange(200), rng.randrange(200)) for _ in range(90)] + [(7, 7), (7, 7)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    assert got == plain_components(edges)
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


PEOPLE = "person_id long, date_of_birth date, sex string, height_in double"


def test_person_detail(spark):
    people = spark.createDataFrame([(1, datetime.date(1950, 6, 2), "Female", 65.0), (2, None, None, None)], PEOPLE)
    diets = spark.createDataFrame([(1, 10, DAY(2024, 1, 1), None, "active", "a"), (1, 11, DAY(2023, 1, 1), DAY(2024, 1, 1), "active", "b"), (1, 12, DAY(2025, 1, 1), None, "inactive", "c"), (2, 13, None, None, "active", "d"), (9, 14, None, None, "active", "x")], "p long, id long, seen timestamp, since timestamp, status string, diet string")
    drugs = spark.createDataFrame([(1, k, DAY(2024, 1, k), "active", "A" if k < 4 else "B") for k in range(1, 6)] + [(1, 6, DAY(2024, 1, 5), "active", "b")], "p long, id long, seen timestamp, status string, name string")
    weights = spark.createDataFrame([(1, 1, DAY(2024, 1, 1), 150.0), (1, 2, DAY(2024, 2, 1), -1.0), (1, 3, None, 160.0)], "p long, id long, at timestamp, lb double")
    weighed = detail.Relation(weights, "p", "id", ["at"], ["lb"])
    relations = {
        "diet": detail.Relation(diets, "p", "id", ["seen", "since"], ["diet"], "status", "single"),
        "medication": detail.Relation(drugs, "p", "id", ["seen"], ["name"], "status", "set", F.lower("name")),
        "weight": weighed,
    }
    rows = {r.person_id: r for r in detail.person_detail(people, relations, F.lit("2024-06-01").cast("date"), 2, {"medication": 4}, weighed).collect()}
    one, two = rows[1], rows[2]
    assert set(rows) == {1, 2}
    assert [(x.kind, [i.id for i in x["items"]], x.omitted) for x in one.lists] == [("diet", [12, 11], 1), ("medication", [6, 5, 4, 3], 2), ("weight", [2, 1], 1)]
    assert [(c.kind, c.key, c.ids) for c in one.conflicts] == [("diet", "", [10, 11])]
    assert [(c.kind, c.key, c.id, c.body) for c in one.current] == [("medication", "a", 3, '{"name":"A"}'), ("medication", "b", 6, '{"name":"b"}')]
    assert (one.weight_lb, one.age, one.ideal_weight_lb, one.missing_inputs) == (150.0, 73, 125.0, [])
    assert [(c.kind, c.id) for c in two.current] == [("diet", 13)] and two.missing_inputs == ["dated_current_weight", "height_in", "normalized_sex", "age"]
    nobody = detail.person_detail(people, {k: detail.Relation(r.rows.limit(0), r.person, r.record_id, r.times, r.columns, r.status, r.state, r.key) for k, r in relations.items()}, F.lit("2024-06-01").cast("date"))
    assert {(len(r.lists), len(r.current), len(r.conflicts)) for r in nobody.collect()} == {(0, 0, 0)}


def test_a_table_of_several_kinds_is_read_once(spark, tmp_path):
    spark.range(100).selectExpr("id % 3 as p", "id", "timestamp'2024-01-01' as at", "concat('k', id % 5) as k").write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    lists = detail.recent_lists(detail.tagged({"t": detail.Relation(rows, "p", "id", ["at"], kind=F.when(F.col("k") != "k4", F.col("k")))}), 3)
    assert all([x.kind for x in r.lists] == ["k0", "k1", "k2", "k3"] and all(len(x["items"]) == 3 for x in r.lists) for r in lists.collect())
    plan = lists._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 2 and "WindowGroupLimit" in plan  # once cut in the tasks, once counted


def test_entry_points(spark):
    people = spark.createDataFrame([(1, "A7", 5), (2, "A7", 6), (3, "B1", 6), (4, "B1", 6)], "person_id long, identifier string, facility_id long")
    places = spark.createDataFrame([(5, "North House"), (6, "South")], "facility_id long, name string")
    assert detail.find_person(people, places, " A7 ", "north  HOUSE").first().person_id == 1
    assert detail.find_person_by_id(people, 3).first().identifier == "B1"
    for wrong in (("A7", "West"), ("C3", "South"), ("B1", "South")):
        with pytest.raises(LookupError):
            detail.find_person(people, places, *wrong)
    with pytest.raises(LookupError):
        detail.find_person_by_id(people, 77)


RECORD = "record_id long, first_name string, last_name string, date_of_birth date, identifier string, facility_id long, sex string"


def test_identities_of_one_batch(spark):
    born, later = datetime.date(1940, 1, 1), datetime.date(1941, 1, 1)
    rows = [
        (1, "Mia", "Stone", born, "7", 1, None), (2, None, None, None, "7", 1, None), (3, " mia ", "STONE", born, None, None, "f"), (4, "Mia", "Stone", None, None, None, None),  # a chain, and its name alone
        (5, "Ben", "Lowe", born, None, 1, None), (6, "Ben", "Lowe", later, None, 2, None), (7, "Ben", "Lowe", None, None, None, None), (8, "Ben", "Lowe", None, None, 2, None),  # two of a name, told apart by facility
        (9, "Ann", "Fox", born, "9", 3, None), (10, "Ann", "Fox", later, "9", 3, None),  # one number, two births
        (11, "Zed", "None", None, None, None, None), (12, None, None, None, None, None, None),
        (13, "Eve", "Hale", born, None, 4, None), (14, "Eve", "Hale", None, "44", None, None),  # a number without birth date joins the dated person
        (15, "Ben", "Lowe", None, "55", None, None),  # which of the two?
    ]
    got = {r.record_id: (r.status, r.person_key) for r in identity.resolve_new(spark.createDataFrame(rows, RECORD)).collect()}
    assert [got[k][0] for k in range(1, 16)] == ["new"] * 6 + ["ambiguous", "new", "conflict", "conflict", "insufficient", "insufficient", "new", "new", "ambiguous"]
    assert len({got[k][1] for k in (1, 2, 3, 4)}) == 1 and got[8][1] == got[6][1] != got[5][1] and got[13][1] == got[14][1]
    people = spark.createDataFrame([(100, "Mia", "Stone", born, "7", 1, None), (101, "Zed", "None", None, None, None, None)], RECORD).withColumnRenamed("record_id", "person_id")
    both = {r.record_id: (r.status, r.person_id) for r in identity.resolve_batch(spark.createDataFrame(rows, RECORD), people).collect()}
    assert both[1] == both[2] == both[3] == both[4] == ("matched", 100) and both[11] == ("matched", 101) and both[5] == ("new", None)
    assert identity.resolve_new(spark.createDataFrame([], RECORD)).count() == 0


def test_ids_that_facts_name_go_first(spark):
    facts = spark.createDataFrame([(1, 7, 70, None), (2, None, None, "north  HOUSE"), (3, None, None, "Twin"), (4, None, None, None)], "record_id long, person_id long, facility_id long, facility_name string")
    people = spark.createDataFrame([(1, 99), (2, 8)], "record_id long, person_id long")
    places = spark.createDataFrame([("North House", 5), ("Twin", 1), ("twin", 2)], "name string, facility_id long")
    got = {r.record_id: (r.person_id, r.facility_id) for r in identity.with_ids(facts, people, places).collect()}
    assert got == {1: (7, 70), 2: (8, 5), 3: (None, None), 4: (None, None)}


def test_only_trusted_sources_add_facilities(spark):
    known = spark.createDataFrame([("F1", "North House"), (None, "South")], "facility_identifier string, name string")
    trusted = spark.createDataFrame([("F9", "north  house"), ("F1", "Other"), ("F2", "East"), ("F3", " EAST "), (None, "West")], "facility_identifier string, name string")
    names = sorted(r.name.strip().lower() for r in identity.register_trusted(known, trusted).collect())
    assert names == ["east", "north house", "south", "west"]
