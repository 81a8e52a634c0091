"""Steps that stay whole and linear on larger tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import extraction, identity, labs


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_of_words_without_python_groups(spark):
    tops = [(1, 0.0), (1, 1.5), (1, 3.0), (1, 4.5), (1, 5.5), (1, 20.0), (1, None), (1, float("nan")), (2, None), (2, None), (3, 7.0)]
    df = spark.createDataFrame([(d, float(k), y, f"w{k}") for k, (d, y) in enumerate(tops)], "d int, x0 double, y0 double, text string")
    got = extraction.lined_words(df, ["d"])
    assert "FlatMapGroupsInPandas" not in plan(got)
    by = {r["text"]: r["line_number"] for r in got.collect()}
    # 0 and 1.5 are a line, 3 and 4.5 the next, 5.5 is 2.5 below 3
    assert [by[f"w{k}"] for k in range(11)] == [0, 0, 1, 1, 2, 3, 3, 3, 0, 0, 0]


def test_lab_page_takes_the_first_full_header(spark):
    page = [(10.0, ("Result", 100), ("Unit", 150), ("Ref", 200), ("Flag", 250)), (20.0, ("Test", 10), ("Result", 100), ("Unit", 150), ("Ref.", 200), ("Flag:", 250), ("Status", 300)), (30.0, ("Sodium", 10), ("140", 100), ("H", 250), ("Final", 300)), (40.0, ("Iron", 10), ("7", 100), ("Pending", 300))]
    df = spark.createDataFrame([(1, float(x), float(x + 30), y, t) for y, *words in page for t, x in words], "d int, x0 double, x1 double, y0 double, text string")
    got = labs.results_of_words(df, ["d"])
    assert "FlatMapGroupsInPandas" not in plan(got) and "Join" not in plan(got)
    assert [tuple(r) for r in got.collect()] == [(1, 2, "Sodium", "140", None, None, "H")]


def test_mifflin_ties_are_rounded_by_the_decimals_in_spark_and_sql(spark, tmp_path):
    import duckdb

    from larder.plans import registry

    folder = str(tmp_path)
    spark.range(1, 20001).select((F.col("id") + 60_000).alias("c_custkey")).write.parquet(f"{folder}/customer.parquet")
    spark.range(1, 20001).select(F.col("id").alias("o_orderkey"), (F.col("id") + 60_000).alias("o_custkey"), F.when(F.col("id") == 13314, 72241.5).otherwise(F.pmod(F.xxhash64("id"), F.lit(30_000_000)) / 100).alias("o_totalprice")).write.parquet(f"{folder}/orders.parquet")
    got = {r["c_custkey"]: r["kcal"] for r in registry.queries()["q_mifflin"](spark, folder).collect()}
    db = duckdb.connect()
    for name in ("customer", "orders"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    assert len(got) == 20000 and dict(db.execute(registry.oracle_sql()["q_mifflin"]).fetchall()) == got


def test_lab_line_is_one_expression_of_its_tokens(one):
    column = labs.result_of_line(F.lit(" Serum iron  7 See note < 9 H Final"))
    assert str(column).count("split(") == 1
    assert one(x=column).asDict() == {"name": "Serum iron", "result": "7", "unit": "See note", "reference_range": "< 9"}


def test_common_names_do_not_pair_all_people_with_all_records(spark):
    who = "id long, first_name string, last_name string, date_of_birth date, identifier string, facility_id long, sex string"
    blank = spark.range(2000).select("id", F.lit("Ann").alias("first_name"), F.lit("Day").alias("last_name"), F.lit(None).cast("date").alias("date_of_birth"), F.lit(None).cast("string").alias("identifier"), F.lit(1).cast("long").alias("facility_id"), F.lit("F").alias("sex"))
    rows = spark.createDataFrame([(9001, "Bo", "Ray", None, " Z1 ", None, "M"), (9002, "Cy", "Low", None, None, 1, "M")], who)
    people = blank.unionByName(rows)
    records = people.withColumnRenamed("id", "record_id")
    got = identity.resolve(records, people.withColumnRenamed("id", "person_id"))
    assert "count(distinct" not in plan(got).lower()
    found = {(r["status"], r["person_id"]): r["n"] for r in got.groupBy("status", "person_id").agg(F.count("*").alias("n")).collect()}
    assert found == {("ambiguous", None): 2000, ("matched", 9001): 1, ("matched", 9002): 1}


def test_segments_pass_from_page_to_page_without_a_group_for_each_document(spark):
    rows = [(1, 1, 0, "References"), (1, 1, 1, "gone"), (1, 2, 0, "still gone"), (1, 2, 1, "Renal Diet Guidance"), (1, 2, 2, "text"), (2, 1, 0, "plain words.")]
    lines = spark.createDataFrame(rows, "doc long, page_number int, line_number int, line string")
    got = extraction.content_segments(lines)
    assert "FlatMapGroupsInPandas" not in plan(got)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 2, 1, "Renal Diet Guidance", "Renal Diet Guidance"), (1, 2, 2, "Renal Diet Guidance", "text"), (2, 1, 0, None, "plain words.")]
