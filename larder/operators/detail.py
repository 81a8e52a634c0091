"""A person's whole record in one row: lists of each kind, what is current, conflicts, and what follows from them."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions import dates, nutrition
from larder.functions.text import fold, sex_code
from larder.operators.temporal import latest_valid, with_ties


@dataclass(frozen=True)
class Relation:
    """How the rows of one kind enter a detail.

    `times` are the columns of which the latest known orders the rows; without `status`
    all rows are active. `state` says what is current: list (nothing), single (the newest
    active row, none where several tie), keyed (the same for each `key`) or set (the
    newest active row of each key, of ties the last id). Only `columns` are read besides.
    A table that holds several kinds is one relation, read once, with `kind` and `state`
    as columns; rows of a null kind are left out.
    """

    rows: DataFrame
    person: str
    record_id: str
    times: list[str]
    columns: list[str] = field(default_factory=list)
    status: str | None = None
    state: str | Column = "list"
    key: Column | None = None
    kind: Column | None = None


def tagged(relations: dict[str, Relation]) -> DataFrame:
    """All rows under each other: (person_id, kind, state, key, id, at, active, body); body is the row's columns as JSON, without nulls."""
    parts = []
    for name, r in relations.items():
        kind = F.lit(name) if r.kind is None else r.kind
        state = F.lit(r.state) if isinstance(r.state, str) else r.state
        at = F.greatest(*r.times) if len(r.times) > 1 else F.col(r.times[0])
        active = F.coalesce(F.col(r.status) == "active", F.lit(False)) if r.status else F.lit(True)
        key = F.coalesce(r.key.cast("string"), F.lit("")) if r.key is not None else F.lit("")
        body = F.to_json(F.struct(*r.columns)) if r.columns else F.lit("{}")
        rows = r.rows if r.kind is None else r.rows.filter(kind.isNotNull())
        parts.append(rows.select(
            F.col(r.person).alias("person_id"), kind.alias("kind"), state.alias("state"), key.alias("key"), F.col(r.record_id).cast("long").alias("id"),
            at.cast("timestamp").alias("at"), active.alias("active"), body.alias("body"),
        ))
    return reduce(DataFrame.unionByName, parts)


def recent_lists(rows: DataFrame, n: int, caps: dict[str, int] | None = None) -> DataFrame:
    """(person_id, lists): for each kind the newest rows, unknown times last, at most n or the kind's own cap, and how many were left out.

    Tasks cut to the largest cap before anything is shuffled and counts are added up in
    the tasks, so a person of any size costs a shuffle no more than the caps.
    """
    caps = caps or {}
    newest = Window.partitionBy("person_id", "kind").orderBy(F.col("at").desc_nulls_last(), F.col("id").desc())
    cap = F.lit(n)
    for kind, own in caps.items():
        cap = F.when(F.col("kind") == kind, own).otherwise(cap)
    cut = rows.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= max([n, *caps.values()])).filter(F.col("place") <= cap)
    items = cut.groupBy("person_id", "kind").agg(F.array_sort(F.collect_list(F.struct("place", "id", "at", "body"))).alias("items"))
    counts = rows.groupBy("person_id", "kind").agg(F.count("*").alias("total"))
    both = counts.join(items, ["person_id", "kind"], "left")
    kept = F.coalesce(F.transform("items", lambda x: F.struct(x["id"].alias("id"), x["at"].alias("at"), x["body"].alias("body"))), F.array().cast("array<struct<id:bigint,at:timestamp,body:string>>"))
    one = F.struct("kind", kept.alias("items"), (F.col("total") - F.size(kept)).alias("omitted"))
    return both.groupBy("person_id").agg(F.array_sort(F.collect_list(one)).alias("lists"))


def current_states(rows: DataFrame) -> DataFrame:
    """(person_id, current, conflicts): the current row of each kind and key, and those where equally new active rows stand against each other."""
    newest = with_ties(rows.filter(F.col("active") & (F.col("state") != "list")), ["person_id", "kind", "key"], "at")
    tied = newest.groupBy("person_id", "kind", "key").agg(F.first("state").alias("state"), F.max("at").alias("at"), F.max("id").alias("id"), F.max_by("body", "id").alias("body"), F.array_sort(F.collect_list("id")).alias("ids"))
    settled = (F.size("ids") == 1) | (F.col("state") == "set")
    current = F.array_sort(F.collect_list(F.when(settled, F.struct("kind", "key", "id", "at", "body")))).alias("current")
    conflicts = F.array_sort(F.collect_list(F.when(~settled, F.struct("kind", "key", "ids")))).alias("conflicts")
    return tied.groupBy("person_id").agg(current, conflicts)


def person_detail(people: DataFrame, relations: dict[str, Relation], on_date: Column, n: int = 50, caps: dict[str, int] | None = None, weights: Relation | None = None) -> DataFrame:
    """One row for each of `people` (person_id, date_of_birth, sex, height_in and more): lists, current states, conflicts, age, and the anthropometrics of the newest dated positive weight.

    `weights` is the relation of weights, its first column the pounds. People without rows have
    empty lists; rows of unknown people are left out. Several relations are one union, so
    the plan has the same few shuffles for any number of kinds: of rows already cut or
    counted, and of one short row for each kind.
    """
    rows = tagged(relations)
    out = people.join(recent_lists(rows, n, caps), "person_id", "left").join(current_states(rows), "person_id", "left")
    for name in ("lists", "current", "conflicts"):
        out = out.withColumn(name, F.coalesce(name, F.array().cast(out.schema[name].dataType)))
    out = out.withColumn("age", dates.completed_years(F.col("date_of_birth"), on_date))
    if weights:
        taken = {"person_id": weights.person, "weight_at": weights.times[0], "weight_id": weights.record_id, "weight_lb": weights.columns[0]}
        measured = weights.rows.select(*(F.col(c).alias(name) for name, c in taken.items()))
        out = out.join(latest_valid(measured, ["person_id"], "weight_at", "weight_id", "weight_lb"), "person_id", "left")
    else:
        out = out.withColumns({"weight_at": F.lit(None).cast("timestamp"), "weight_id": F.lit(None).cast("long"), "weight_lb": F.lit(None).cast("double")})
    sex = sex_code(F.col("sex"))
    missing = F.filter(F.array(*(F.when(c, name) for name, c in (
        ("dated_current_weight", F.col("weight_lb").isNull()), ("height_in", F.col("height_in").isNull()), ("normalized_sex", sex.isNull()), ("age", F.col("age").isNull()),
    ))), lambda x: x.isNotNull())
    return out.withColumns({
        "bmi": nutrition.bmi(F.col("weight_lb"), F.col("height_in")),
        "ideal_weight_lb": nutrition.ideal_weight(sex, F.col("height_in")),
        "missing_inputs": missing,
    })


def find_person(people: DataFrame, facilities: DataFrame, identifier: str, facility: str) -> DataFrame:
    """The one person with the identifier at a facility of that name; a LookupError where the facility or the person is unknown, or several are found."""
    places = facilities.filter(fold(F.col("name")) == fold(F.lit(facility))).select("facility_id").limit(2).collect()
    if len(places) != 1:
        raise LookupError(f"no facility is named {facility!r}" if not places else f"several facilities are named {facility!r}")
    return _one(people.filter((F.trim("identifier") == identifier.strip()) & (F.col("facility_id") == places[0][0])), f"{identifier!r} at {facility!r}")


def find_person_by_id(people: DataFrame, person_id: int) -> DataFrame:
    return _one(people.filter(F.col("person_id") == person_id), f"id {person_id}")


def _one(found: DataFrame, name: str) -> DataFrame:
    n = found.limit(2).count()
    if n != 1:
        raise LookupError(f"no person with {name}" if n == 0 else f"several persons with {name}")
    return found
