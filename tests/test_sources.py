import datetime as dt
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from larder.sources import documents, foods
from larder.sources.tables import BatchTables
from larder.streaming import incremental


def test_csv_report(spark):
    text = "Report,1/25/2026 - 1/26/2026\r\nFacility: X\r\nPatient Number,Name,Note\r\nZ1,\"Sample, Ada\",\r\nZ2,B\r\n"
    df = spark.createDataFrame([("d", text)], "doc string, text string")
    got = documents.csv_report(df, "doc", "text", "Patient Number", ["number", "name", "note"]).orderBy("line_number").collect()
    assert [(r["number"], r["name"], r["note"]) for r in got] == [("Z1", "Sample, Ada", ""), ("Z2", "B", "")]


def test_files_and_names(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"\xef\xbb\xbfx")
    (tmp_path / "b.exe").write_bytes(b"y")
    (tmp_path / "c.txt").write_bytes(b"z")
    rows = documents.files(spark, str(tmp_path))
    assert [r["suffix"] for r in rows.select("suffix").collect()] == ["pdf", "txt"]
    good, bad = documents.guarded(rows)
    assert good.count() == 1 and [r["reason"] for r in bad.collect()] == ["not a pdf"]
    assert good.select(documents.decoded(F.col("content")).alias("t")).first()["t"] == "x"
    names = spark.createDataFrame([("A.pdf", 1), ("a.pdf", 2), ("b", 3)], "name string, ord int")
    assert [r["stored"] for r in documents.unique_names(names).orderBy("ord").collect()] == ["A.pdf", "a-2.pdf", "b"]


def test_batches_count_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    tables = BatchTables(spark, str(tmp_path / "t"), {"a": "k int, v string", "b": "n long"})
    assert tables.read("a").count() == tables.read("b").count() == 0
    one = {"a": spark.createDataFrame([(1, "x")], "k int, v string"), "b": spark.range(2).withColumnRenamed("id", "n")}
    assert tables.append(one, "q", 0) and not tables.append(one, "q", 0)  # the same batch again
    assert tables.append({"a": one["a"], "b": one["b"].limit(0)}, "other", 0)
    assert sorted(map(tuple, tables.read("a").collect())) == [(1, "x", 0), (1, "x", 1)] and tables.read("b").count() == 2
    # a writer that dies between its tables: nothing of its batch is seen, and its second attempt replaces what it left
    put = BatchTables._put

    def dies(self, name, *rest):
        if name == "b":
            raise OSError("gone")
        put(self, name, *rest)

    monkeypatch.setattr(BatchTables, "_put", dies)
    with pytest.raises(OSError):
        tables.append({"a": spark.createDataFrame([(7, "half")], "k int, v string"), "b": one["b"]}, "q", 1)
    assert tables.read("a").count() == 2
    monkeypatch.setattr(BatchTables, "_put", put)
    assert tables.append({"a": spark.createDataFrame([(8, "whole")], "k int, v string"), "b": one["b"]}, "q", 1)
    assert sorted(r.k for r in tables.read("a").collect()) == [1, 1, 8] and tables.read("b").count() == 4


def test_backoff_and_retries():
    assert [foods.backoff(k) for k in (0, 3, 9)] == [1, 8, 60] and foods.backoff(0, retry_after=7) == 7
    answers, waits = iter([(429, {"Retry-After": "3"}, ""), (200, {}, "ok")]), []
    assert foods.with_retries(lambda: next(answers), waits.append) == "ok" and waits == [3]
    with pytest.raises(OSError):
        foods.with_retries(lambda: (500, {}, ""), waits.append)


class Pages(BaseHTTPRequestHandler):
    def do_GET(self):
        page = int(self.path.split("pageNumber=")[1].split("&")[0])
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps([{"fdcId": page * 10 + k} for k in range(2)] if page < 3 else []).encode())

    def log_message(self, *_):
        pass


def test_paged_source(spark):
    server = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(foods.FoodPages)
    try:
        pages = spark.read.format("food_pages").option("url", f"http://127.0.0.1:{server.server_port}/list").option("max_pages", 3).load()
        assert sorted(r["food_id"] for r in foods.foods(pages)[0].collect()) == [10, 11, 20, 21]
    finally:
        server.shutdown()


def test_food_shapes(spark):
    full = {"fdcId": 1, "description": " Oats ", "publicationDate": "4/1/2019", "foodCategory": {"description": "Grains"}, "foodNutrients": [{"nutrient": {"number": "203", "name": "Protein", "unitName": "G"}, "amount": 1}, {"nutrient": {"number": "203", "name": "Protein", "unitName": "g"}, "amount": 2}]}
    flat = {"fdcId": 2, "description": "Bar", "publicationDate": "2020-02-03", "brandedFoodCategory": "Snacks", "foodNutrients": [{"number": "208", "name": "Energy", "unitName": "KCAL", "amount": 5}, {"number": "999"}]}
    heads, nutrients = foods.foods(spark.createDataFrame([(json.dumps(x),) for x in (full, flat, {"no": "id"})], "body string"))
    assert [tuple(r) for r in heads.select("food_id", "name", "published", "category").orderBy("food_id").collect()] == [(1, "Oats", dt.date(2019, 4, 1), "Grains"), (2, "Bar", dt.date(2020, 2, 3), "Snacks")]
    assert [tuple(r) for r in nutrients.select("food_id", "number", "amount").orderBy("food_id").collect()] == [(1, "203", 2.0), (2, "208", 5.0)]


def test_stream_of_batches(spark, tmp_path):
    source, schema = tmp_path / "in", "p int, t timestamp, v double, seq int"
    tables = BatchTables(spark, str(tmp_path / "tables"), {"seen": schema, "counts": "n long"})
    split = lambda batch: {"seen": batch, "counts": batch.groupBy().count().withColumnRenamed("count", "n")}
    run = lambda path, mark: incremental.append_batches(incremental.read_files(spark, str(path), schema), tables, split, str(tmp_path / mark)).awaitTermination()
    current = lambda: [tuple(r) for r in incremental.current_rows(tables.read("seen"), ["p"], "t", "seq", ["v"], []).select("p", "v").orderBy("p").collect()]
    day = lambda d: dt.datetime(2026, 1, d)
    for batch in ([(1, day(5), 5.0, 1)], [(1, day(3), 3.0, 2), (2, day(1), 1.0, 3)], [(1, day(5), 6.0, 4)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(source))
        run(source, "checkpoint")
    assert current() == [(1, 6.0), (2, 1.0)] and sorted(r.n for r in tables.read("counts").collect()) == [1, 1, 2]
    # another query over the same tables, whose batches count from 0 again, is not taken for a replay
    spark.createDataFrame([(3, day(9), 9.0, 5)], schema).write.parquet(str(tmp_path / "more"))
    run(tmp_path / "more", "other")
    assert current() == [(1, 6.0), (2, 1.0), (3, 9.0)]


def test_documents_once(spark):
    rows = spark.createDataFrame([("c1", "b", 0), ("c1", "a", 0), ("c2", "c", 0), ("c2", "a", 1), ("c3", "d", 1)], "checksum string, path string, batch_order long")
    assert sorted((r.checksum, r.path) for r in incremental.first_documents(rows).collect()) == [("c1", "a"), ("c2", "c"), ("c3", "d")]
