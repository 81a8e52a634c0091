"""Foods: a paged source for Spark's Python data source interface, and one schema from two payload shapes."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

PAGE_SIZE, MAX_PAGE_SIZE, DETAIL_BATCH, MAX_RETRIES, MAX_WAIT = 50, 200, 20, 5, 60.0

FOOD_SCHEMA = """fdcId long, description string, dataType string, publicationDate string, brandedFoodCategory string, foodCategory struct<description: string>,
  foodNutrients array<struct<amount: double, number: string, name: string, unitName: string, nutrient: struct<number: string, name: string, unitName: string, rank: int>>>"""


def backoff(attempt: int, base: float = 1.0, retry_after: float | None = None) -> float:
    """Seconds to wait before a further try: doubling up to a minute, never less than the server asks."""
    return max(min(base * 2**attempt, MAX_WAIT), retry_after or 0.0)


def with_retries(fetch: Callable[[], tuple[int, dict, str]], sleep: Callable[[float], None] = time.sleep) -> str:
    """The body of a response; status 429 is tried again."""
    for attempt in range(MAX_RETRIES + 1):
        status, headers, body = fetch()
        if status == 200:
            return body
        if status != 429 or attempt == MAX_RETRIES:
            raise OSError(f"the food service answered {status}")
        sleep(backoff(attempt, retry_after=float(headers.get("Retry-After") or 0)))
    raise AssertionError


def http_fetch(url: str) -> tuple[int, dict, str]:
    import urllib.error
    import urllib.request

    try:
        with urllib.request.urlopen(url, timeout=30) as r:  # noqa: S310
            return r.status, dict(r.headers), r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), ""


class _Pages:
    def __init__(self, options: dict):
        self.url = options["url"]
        self.size = int(options.get("page_size", PAGE_SIZE))
        if not 1 <= self.size <= MAX_PAGE_SIZE:
            raise ValueError(f"page_size must be from 1 to {MAX_PAGE_SIZE}")

    def page(self, number: int) -> list[str]:
        body = with_retries(lambda: http_fetch(f"{self.url}?pageNumber={number}&pageSize={self.size}"))
        foods = json.loads(body)
        if not isinstance(foods, list):
            raise ValueError("a page must be a list of foods")
        return [json.dumps(f) for f in foods]


class _PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.pages = _Pages(options)
        self.first, self.count = int(options.get("start_page", 1)), int(options.get("max_pages", 1))
        if self.first < 1 or self.count < 1:
            raise ValueError("start_page and max_pages start at 1")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(n) for n in range(self.first, self.first + self.count)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for body in self.pages.page(partition.value):
            yield partition.value, body


class _PageStream(SimpleDataSourceStreamReader):
    """A page number is the offset: it moves on only with the page's rows."""

    def __init__(self, options: dict):
        self.pages, self.first = _Pages(options), int(options.get("start_page", 1))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"page": self.first}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = [(start["page"], b) for b in self.pages.page(start["page"])]
        return iter(rows), {"page": start["page"] + (1 if rows else 0)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter([(n, b) for n in range(start["page"], end["page"]) for b in self.pages.page(n)])


class FoodPages(DataSource):
    """spark.read.format("food_pages").option("url", ...): a task for each page, a row for each food. spark.dataSource.register it first."""

    @classmethod
    def name(cls) -> str:
        return "food_pages"

    def schema(self) -> str:
        return "page int, body string"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _PageStream(dict(self.options))


def foods(pages: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(foods, nutrients) from payloads of either shape; bodies without an id are left out. Of one nutrient number and unit the last entry counts."""
    f = pages.select(F.from_json(body, FOOD_SCHEMA).alias("f")).filter(F.col("f.fdcId").isNotNull())
    trimmed = lambda c: F.nullif(F.trim(c), F.lit(""))
    day = F.coalesce(F.to_date(F.try_to_timestamp("f.publicationDate", F.lit("yyyy-MM-dd"))), F.to_date(F.try_to_timestamp("f.publicationDate", F.lit("M/d/yyyy"))))
    heads = f.select(F.col("f.fdcId").alias("food_id"), trimmed("f.description").alias("name"), trimmed("f.dataType").alias("data_type"), day.alias("published"), F.coalesce(trimmed("f.foodCategory.description"), trimmed("f.brandedFoodCategory")).alias("category"))
    each = f.select(F.col("f.fdcId").alias("food_id"), F.posexplode("f.foodNutrients").alias("place", "n"))
    rows = each.select("food_id", "place", F.coalesce("n.nutrient.number", "n.number").alias("number"), F.coalesce("n.nutrient.unitName", "n.unitName").alias("unit"), F.coalesce("n.nutrient.name", "n.name").alias("nutrient"), F.col("n.amount").alias("amount"))
    rows = rows.filter(F.col("number").isNotNull() & F.col("amount").isNotNull())
    last = rows.groupBy("food_id", "number", F.lower("unit").alias("unit")).agg(F.max_by("nutrient", "place").alias("nutrient"), F.max_by("amount", "place").alias("amount"))
    return heads, last


def detail_batches(ids: DataFrame, column: str = "food_id", size: int = DETAIL_BATCH, groups: int = 64) -> DataFrame:
    """Distinct ids in batches of at most `size` for detail requests, numbered within hash groups so that no task sees them all."""
    from pyspark.sql import Window

    rows = ids.select(column).distinct().withColumn("_g", F.pmod(F.xxhash64(column), F.lit(groups)))
    place = F.row_number().over(Window.partitionBy("_g").orderBy(column)) - 1
    return rows.withColumn("_b", F.floor(place / size)).groupBy("_g", "_b").agg(F.array_sort(F.collect_list(column)).alias("ids")).select("ids")
