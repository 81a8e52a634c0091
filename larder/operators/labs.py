"""Laboratory results from report lines and from positioned words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder import fixed_values as fixed
from larder.operators.extraction import lined_words


def _counts(name: Column, result: Column) -> Column:
    """Is this a result, not a note about one? Nulls are none."""
    return F.coalesce((name != "") & (result != "") & ~name.isin(*fixed.LAB_IGNORED_NAMES) & ~F.lower(result).isin(*fixed.LAB_IGNORED_RESULTS), F.lit(False))


def result_of_line(line: Column) -> Column:
    """struct(name, result, unit, reference_range) of a line such as `Sodium 140 mmol/L 135 - 145 Final`; null for other lines.

    The last status word ends the line, a flag may stand before it; the first word that
    reads as a value parts the name from unit and range.
    """
    place = lambda xs, test: F.transform(xs, lambda t, i: F.when(test(t), i))

    def of_tokens(tokens: Column) -> Column:
        ended = F.array_max(place(tokens, lambda t: t.isin(*fixed.LAB_STATUSES)))
        return F.when((F.size(tokens) >= 3) & ended.isNotNull(), _bound(ended, lambda at: of_data(tokens, at)))

    def of_data(tokens: Column, ended: Column) -> Column:
        flagged = F.coalesce(F.get(tokens, ended - 1).isin(*fixed.LAB_FLAGS), F.lit(False)) & (ended > 0)
        data = F.slice(tokens, 1, F.greatest(F.when(flagged, ended - 1).otherwise(ended), F.lit(0)))
        return _bound(data, lambda d: _bound(F.array_min(place(d, lambda t: t.rlike(fixed.LAB_VALUE))), lambda value: of_value(d, value)))

    def of_value(data: Column, value: Column) -> Column:
        name, result = F.array_join(F.slice(data, 1, value), " "), F.get(data, value)
        whole = F.struct(name.alias("name"), result.alias("result"), F.slice(data, value + 2, F.size(data)).alias("rest"))
        return F.when(value.isNotNull(), _bound(whole, lambda x: F.when(_counts(x["name"], x["result"]), of_rest(x["name"], x["result"], x["rest"]))))

    def of_rest(name: Column, result: Column, rest: Column) -> Column:
        tail = lambda n: F.nullif(F.array_join(F.slice(rest, n + 1, F.size(rest)), " "), F.lit(""))
        see = F.coalesce((F.get(rest, F.lit(0)) == "See") & (F.get(rest, F.lit(1)) == "note"), F.lit(False))
        unit, span = F.when(see, "See note").otherwise(F.get(rest, F.lit(0))), F.when(see, tail(2)).otherwise(tail(1))
        return F.struct(name.alias("name"), result.alias("result"), unit.alias("unit"), span.alias("reference_range"))

    return _bound(F.filter(F.split(line, r"\s+"), lambda t: t != ""), of_tokens)


def _bound(value: Column, use) -> Column:
    """`use` of a value that is worked out once, however often it is used: a name inside one expression, which Spark does not give otherwise."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def results_of_words(words: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line_number, name, result, unit, reference_range, flag) of pages of positioned words (x0, x1, y0, text).

    The first line of a page whose labels include all of the header's sets the columns,
    parted half way between their labels; a word belongs to the column that holds its middle.
    """
    lines = lined_words(words, keys).groupBy(*keys, "line_number").agg(F.array_sort(F.collect_list(F.struct("x0", "text", "x1"))).alias("_words"))
    at = lambda labels, c: F.array_max(F.zip_with("_words", labels, lambda w, label: F.when(label == c, F.struct(w["x0"].alias("x0"), w["x1"].alias("x1")))))
    every = lambda labels: reduce(lambda a, b: a & b, (F.array_contains(labels, c) for c in fixed.LAB_HEADER))
    labels = F.transform("_words", lambda w: F.rtrim(F.lower(w["text"]), F.lit(".:")))
    head = _bound(labels, lambda x: F.when(every(x), F.struct(*(at(x, c).alias(c) for c in fixed.LAB_HEADER))))
    lines = lines.withColumn("_at", head).withColumn("_head", F.when(F.col("_at").isNotNull(), F.col("line_number")))
    page = Window.partitionBy(*keys)
    lines = lines.withColumn("_h", F.min_by("_at", "_head").over(page)).withColumn("_from", F.min("_head").over(page)).filter(F.col("line_number") > F.col("_from"))
    middle = lambda c: (F.col(f"_h.{c}.x0") + F.col(f"_h.{c}.x1")) / 2
    cuts = [(middle(a) + middle(b)) / 2 for a, b in zip(fixed.LAB_HEADER, fixed.LAB_HEADER[1:])]
    lines = lines.withColumn("_cuts", F.array(F.col("_h.result.x0") - fixed.LAB_NAME_GAP, *cuts))
    columns = ("name", "result", "unit", "reference_range", "flag", "status")
    placed = F.transform("_words", lambda w: F.struct(w["text"].alias("text"), F.size(F.filter("_cuts", lambda c: c <= (w["x0"] + w["x1"]) / 2)).alias("column")))
    cell = lambda words, k: F.array_join(F.transform(F.filter(words, lambda w: w["column"] == k), lambda w: w["text"]), " ")
    cells = _bound(placed, lambda words: F.struct(*(cell(words, k).alias(c) for k, c in enumerate(columns))))
    rows = F.filter(F.array(cells), lambda x: x["status"].isin(*fixed.LAB_STATUSES) & _counts(x["name"], x["result"]))
    return lines.select(*keys, "line_number", F.inline(rows)).select(*keys, "line_number", "name", "result", *(F.nullif(F.col(c), F.lit("")).alias(c) for c in columns[2:5]))


def once(results: DataFrame, person: str, observed: str, order: list[str]) -> DataFrame:
    """Of results of a person with one time, name (without case) and value the first in order."""
    by = Window.partitionBy(person, observed, F.lower("name"), "result").orderBy(*order)
    return results.withColumn("_first", F.row_number().over(by)).filter("_first = 1").drop("_first")
