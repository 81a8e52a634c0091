"""Lookups, joins and set operations with the semantics that records need."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def required(test: Column, message: str) -> Column:
    """True where the test holds; elsewhere, also where it is null, the job fails with the message."""
    return F.when(test, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))


def match_all(columns: dict[str, object]) -> Column:
    """Equality on several columns; a null never matches."""
    return reduce(lambda a, b: a & b, (F.col(c) == F.lit(v) for c, v in columns.items()))


def contains_any(columns: list[str], text: str) -> Column:
    """Is the text, without case, in any of the columns? A null column is no match."""
    return reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False)) for c in columns))


def gated(flags: dict[str, bool], column: str) -> Column:
    """Rows of the kinds that are switched on; the switches are constants, so Spark folds them."""
    return reduce(lambda a, b: a | b, (F.lit(on) & (F.col(column).cast("string") == kind) for kind, on in flags.items()), F.lit(False))


def compatible(column: Column, value: Column) -> Column:
    """Equal, or unknown on either side."""
    return column.isNull() | value.isNull() | (column == value)


def is_close(a: Column, b: Column, rel: float = 1e-9, tol: float = 0.01) -> Column:
    return F.abs(a - b) <= F.greatest(rel * F.greatest(F.abs(a), F.abs(b)), F.lit(tol))


def unique_or_status(queries: DataFrame, table: DataFrame, on: Column, query_key: str, choice: Column, found: list[str]) -> DataFrame:
    """For each query its one match; else not_found, or ambiguous with the number of matches and the first choices in order."""
    hits = queries.join(table, on, "left")
    matched = F.col(found[0]).isNotNull()
    out = hits.groupBy(query_key).agg(F.count_if(matched).alias("n_matches"), F.min(F.when(matched, choice)).alias("first_choice"), F.max(F.when(matched, choice)).alias("last_choice"), *(F.min(c).alias(c) for c in found))
    status = F.when(F.col("n_matches") == 0, "not_found").when(F.col("n_matches") == 1, "ok").otherwise("ambiguous")
    return out.withColumns({"status": status, **{c: F.when(F.col("n_matches") == 1, F.col(c)) for c in found}})


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that keep all rules, rows that break some with their names in `broken`). A rule that is null is kept, as in SQL checks."""
    broken = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items())), lambda x: x.isNotNull())
    marked = df.withColumn("broken", broken)
    return marked.filter(F.size("broken") == 0).drop("broken"), marked.filter(F.size("broken") > 0)


def set_differences(requested: DataFrame, received: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has, with `side`: missing or unexpected."""
    a = requested.select(*keys).distinct().withColumn("_a", F.lit(True))
    b = received.select(*keys).distinct().withColumn("_b", F.lit(True))
    both = a.join(b, keys, "full_outer").filter(F.col("_a").isNull() | F.col("_b").isNull())
    return both.select(*keys, F.when(F.col("_b").isNull(), "missing").otherwise("unexpected").alias("side"))


def resolve_alias(df: DataFrame, name: Column, names: DataFrame) -> DataFrame:
    """Join on a normalised name to (alias, canonical) rows. How to join is Spark's choice by the measured size of the names."""
    return df.withColumn("_name", name).join(names.select(F.col("alias").alias("_name"), "canonical"), "_name", "left").drop("_name")


def in_band(df: DataFrame, x: Column, bands: list[tuple[str, float, float]]) -> DataFrame:
    """The band [left, right) that holds x, the first listed where bands overlap; rows outside all bands go."""
    out = F.lit(None).cast("string")
    for name, left, right in reversed(bands):
        out = F.when((x >= left) & (x < right), name).otherwise(out)
    return df.withColumn("band", out).filter(F.col("band").isNotNull())


def repeated_lines(df: DataFrame, page: str, text: str, least: int = 2, boundary: int = 2) -> DataFrame:
    """Normalised first and last lines of pages that stand on several pages: running headers and footers."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    ends = df.select(page, lines.alias("_l")).select(page, F.explode(F.array_distinct(F.concat(F.slice("_l", 1, boundary), F.slice("_l", -1 * F.least(F.lit(boundary), F.size("_l")), boundary)))).alias("line")).filter(F.col("line") != "")
    ends = ends.withColumn("line", F.lower(F.regexp_replace("line", r"\s+", " ")))
    return ends.groupBy("line").agg(F.count_distinct(page).alias("n_pages")).filter(F.col("n_pages") >= least)


def policy_error(df: DataFrame, keys: list[str], ok: Column) -> DataFrame:
    """A group fails only if nothing in it succeeded."""
    return df.groupBy(*keys).agg(F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_failed")).withColumn("status", F.when((F.col("n_ok") == 0) & (F.col("n_failed") > 0), "failed").when(F.col("n_failed") > 0, "partial").otherwise("ok"))


def has_all(have: Column, want: list[str]) -> Column:
    """Does the array hold all of these? The order and further elements do not count."""
    return F.size(F.array_except(F.array(*map(F.lit, want)), have)) == 0


def same_set(a: Column, b: Column) -> Column:
    """Do the arrays hold the same elements, however often?"""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def of_type(column: Column, kind: str) -> Column:
    """The value as the declared type; a value that is not of it fails the job."""
    as_kind = column.try_cast(kind)
    wrong = F.raise_error(F.concat(F.lit(f"not of type {kind}: "), column.cast("string"))).cast(kind)
    return F.when(column.isNull() | as_kind.isNotNull(), as_kind).otherwise(wrong)


def from_own_source(facts: DataFrame, fact_type: str, restricted: str, source: str, owners: list[str]) -> DataFrame:
    """Facts of the restricted type only from sources that own it; all other facts. A null source owns nothing."""
    return facts.filter((F.col(fact_type) != restricted) | F.coalesce(F.col(source).isin(*owners), F.lit(False)))


def without_keys(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The rows but those whose keys are named: deletion of a list of ids, or of single links by both their keys. Nulls are never named."""
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")
