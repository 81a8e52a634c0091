"""State over time: newest of, current with ties reported, changes since, carried forward."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions import dates
from larder.functions.text import plain_number


def clinical_time(effective: Column, observed: Column) -> Column:
    """The later of the two; either may be null."""
    return F.greatest(effective, observed)


def record_time(times: list[Column], created: Column) -> Column:
    """The latest of a record's times, or when it was created."""
    return F.coalesce(F.greatest(*times), created)


def top_n_per(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key; Spark drops the others before the shuffle."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_place") <= n).drop("_place")


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_n_per(df, keys, order, 1)


def latest_per_identity(df: DataFrame, person: str, identity: Column, order: list[Column], n: int) -> DataFrame:
    """The newest row of each identity of a person, then the person's first n of those."""
    newest = top_n_per(df.withColumn("_identity", identity), [person, "_identity"], order, 1)
    return top_n_per(newest, [person], order, n).drop("_identity")


def with_ties(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """The rows with the newest time of each key, null times last and equal to each other, with `tied`, their number."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("_rank", F.rank().over(w.orderBy(F.col(time).desc_nulls_last()))).filter(F.col("_rank") == 1)
    return ranked.withColumn("tied", F.count("*").over(w)).drop("_rank")


def current(df: DataFrame, keys: list[str], time: str, active: Column) -> DataFrame:
    """The one newest active row of each key; keys with a tie have none."""
    return with_ties(df.filter(active), keys, time).filter("tied = 1").drop("tied")


def conflicts(df: DataFrame, keys: list[str], time: str, record_id: str, active: Column) -> DataFrame:
    """Keys whose newest active rows tie, with the ids of those rows."""
    tied = with_ties(df.filter(active), keys, time).filter("tied > 1")
    return tied.groupBy(*keys).agg(F.count("*").alias("n_tied"), F.array_join(F.transform(F.array_sort(F.collect_list(record_id)), lambda x: x.cast("string")), ",").alias("ids"))


def active_set(df: DataFrame, keys: list[str], order: list[Column], active: Column) -> DataFrame:
    """The newest active row of each key, without conflicts."""
    return top_n_per(df.filter(active), keys, order, 1)


def cross_key_conflicts(df: DataFrame, person: str, key: str, directional: Column) -> DataFrame:
    """People with more than one kind of directional record at once."""
    return df.filter(directional).groupBy(person).agg(F.countDistinct(key).alias("n_kinds"), F.count("*").alias("n_rows")).filter("n_kinds > 1")


def latest_valid(df: DataFrame, keys: list[str], time: str, record_id: str, value: str) -> DataFrame:
    """The newest dated, positive value of each key; of equal times the largest id."""
    valid = df.filter(F.col(time).isNotNull() & (F.col(value) > 0))
    return valid.groupBy(*keys).agg(F.max_by(F.struct(time, record_id, value), F.struct(time, record_id)).alias("_v")).select(*keys, "_v.*")


def latest_against_prior(df: DataFrame, keys: list[str], time: str, record_id: str, value: str) -> DataFrame:
    """The newest value of each key against every earlier one: change, percent of the earlier value, direction, days, window and significance. Values must be dated and positive; measurements of the newest day itself are left out."""
    w = Window.partitionBy(*keys).orderBy(F.col(time).desc(), F.col(record_id).desc())
    rows = df.filter(F.col(time).isNotNull() & (F.col(value) > 0))
    rows = rows.withColumn("_latest", F.first_value(F.struct(F.col(time).alias("at"), F.col(value).alias("value"), F.col(record_id).alias("id"))).over(w))
    latest_day, day = F.to_date("_latest.at"), F.to_date(time)
    change = F.col("_latest.value") - F.col(value)
    percent = change / F.col(value) * 100
    window = dates.change_window(latest_day, day)
    out = rows.filter(F.col(record_id) != F.col("_latest.id")).withColumns({
        "latest_id": F.col("_latest.id"),
        "latest_value": F.col("_latest.value"),
        "change": change,
        "percent": percent,
        "direction": F.when(change < 0, "loss").when(change > 0, "gain").otherwise("change"),
        "elapsed_days": F.datediff(latest_day, day),
        "window_months": window,
        "significant": dates.significant(window, percent),
        "elapsed": dates.elapsed_label(latest_day, day),
    })
    return out.filter("elapsed_days > 0").drop("_latest")


def change_sentence(day: Column, value: Column, percent: Column, direction: Column, change: Column, elapsed: Column) -> Column:
    return F.concat(
        F.date_format(day, "yyyy-MM-dd"), F.lit(": "), plain_number(value), F.lit(" lbs; "), plain_number(F.abs(percent)), F.lit("% weight "), direction,
        F.lit(", "), plain_number(F.abs(change)), F.lit(" lbs over "), elapsed, F.lit(" to latest weight"),
    )


def carry_forward(df: DataFrame, doc: list[str], order: list[str], columns: list[str], restart: Column | None = None) -> DataFrame:
    """The last known value of each column so far in the document; with `restart`, known since the last row at which that holds."""
    keys = list(doc)
    if restart is not None:
        df = df.withColumn("_run", F.sum(restart.cast("int")).over(Window.partitionBy(*doc).orderBy(*order)))
        keys.append("_run")
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})
    return out.drop("_run") if restart is not None else out


def sessions(df: DataFrame, doc: list[str], order: list[str], starts: Column, name: str = "session") -> DataFrame:
    """Number the runs of rows that begin where `starts` holds; rows before the first start are run 0."""
    return df.withColumn(name, F.coalesce(F.sum(starts.cast("long")).over(Window.partitionBy(*doc).orderBy(*order)), F.lit(0)))


def look_ahead(df: DataFrame, doc: list[str], order: list[str], column: str, name: str) -> DataFrame:
    return df.withColumn(name, F.lead(column).over(Window.partitionBy(*doc).orderBy(*order)))


def first_gap(df: DataFrame, page: list[str], top: str, bottom: str, least: float = 10.0) -> DataFrame:
    """Where a page's body starts: the first line after a vertical gap above `least`."""
    w = Window.partitionBy(*page).orderBy(top)
    return df.withColumn("_gap", F.col(top) - F.lag(bottom).over(w)).filter(F.col("_gap") > least).groupBy(*page).agg(F.min(top).alias("body_top"))


def first_known(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """The first value that is not null of each column, by order; groups of any size, as it is a minimum."""
    return df.groupBy(*keys).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns))


def capped_lists(df: DataFrame, keys: list[str], order: list[Column], columns: list[str], n: int) -> DataFrame:
    """The first n rows of each key as a list, and how many were left out. Rows beyond n never enter a list."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("_n", F.count("*").over(w)).withColumn("_place", F.row_number().over(w.orderBy(*order))).filter(F.col("_place") <= n)
    return ranked.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_place", *columns))), lambda x: F.struct(*(x[c].alias(c) for c in columns))).alias("items"), F.greatest(F.max("_n") - n, F.lit(0)).alias("omitted")
    )


def all_or_null(columns: list[str]) -> Column:
    """The sum of columns, null where one is null."""
    return reduce(lambda a, b: a + b, (F.col(c) for c in columns))


def weight_series_status(df: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """(keys, status, n_dated): whether a series of weights can be compared: ok, no_dated_weight, or not_positive where a dated weight is zero, less or unknown."""
    dated = F.col(time).isNotNull()
    counts = df.groupBy(*keys).agg(F.count_if(dated).alias("n_dated"), F.count_if(dated & ~F.coalesce(F.col(value) > 0, F.lit(False))).alias("_bad"))
    return counts.select(*keys, F.when(F.col("n_dated") == 0, "no_dated_weight").when(F.col("_bad") > 0, "not_positive").otherwise("ok").alias("status"), "n_dated")
