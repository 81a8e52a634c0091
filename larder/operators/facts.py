"""Facts of one kind of payload to the rows of their relations: times, keys and routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder import fixed_values as fixed
from larder.functions.text import fold


def relation_of(fact_type: Column) -> Column:
    """The relation of a fact's type; null for a type that has none."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in fixed.FACT_RELATIONS.items() for x in kv)), fact_type)


def observed_at(fact_type: Column, payload: Column) -> Column:
    """When the source saw it: a weight's measured_at, else observed_at; a date is its midnight."""
    field = F.when(fact_type == "weight", "measured_at").otherwise("observed_at")
    return F.when(relation_of(fact_type).isNotNull(), F.try_to_timestamp(F.try_element_at(payload, field)))


def key_of(fact_type: Column, payload: Column) -> Column:
    """SHA-256 of the type and the payload's fields in order of their names."""
    flat = F.flatten(F.transform(F.array_sort(F.map_entries(payload)), lambda e: F.array(e["key"], e["value"])))
    return F.sha2(F.to_json(F.concat(F.array(fact_type), flat)), 256)


def state_key(fact_type: Column, payload: Column) -> Column:
    """The identity of a state: its normalised fields but those that change with its course."""
    kept = F.map_filter(payload, lambda k, v: ~k.isin(*fixed.STATE_KEY_EXCLUDES))
    return key_of(fact_type, F.transform_values(kept, lambda k, v: F.nullif(fold(v), F.lit(""))))


def routed(facts: DataFrame, fact_type: str = "fact_type", payload: str = "payload") -> DataFrame:
    """Add relation, observed_at, effective_at, state_key (stateful types), observation_key (observations, the time included) and row: the payload without the source's own fields, with a wound's type under `type` and an unknown place as Unspecified. A type without relation keeps a null relation, so that it can be reported."""
    kind, fields = F.col(fact_type), F.col(payload)
    row = F.map_filter(fields, lambda k, v: ~k.isin(*fixed.SOURCE_FIELDS))
    wound = F.transform_keys(row, lambda k, v: F.when(k == "wound_type", "type").otherwise(k))
    placed = F.when(kind == "wound", wound).otherwise(row)
    place = F.coalesce(F.nullif(F.try_element_at(placed, F.lit("location")), F.lit("")), F.lit("Unspecified"))
    located = F.map_concat(F.map_filter(placed, lambda k, v: k != "location"), F.create_map(F.lit("location"), place))
    return facts.withColumns({
        "relation": relation_of(kind),
        "observed_at": observed_at(kind, fields),
        "effective_at": F.try_to_timestamp(F.try_element_at(fields, F.lit("effective_at"))),
        "state_key": F.when(kind.isin(*fixed.STATEFUL_FACTS), state_key(kind, fields)),
        "observation_key": F.when(kind.isin(*fixed.OBSERVATION_FACTS), key_of(kind, fields)),
        "row": F.when(kind.isin("wound", "edema"), located).otherwise(placed),
    })


def evidence_hash(source: list[str], payload: Column) -> Column:
    """SHA-256 of who and where a fact is about, and all its fields."""
    flat = F.flatten(F.transform(F.array_sort(F.map_entries(payload)), lambda e: F.array(e["key"], e["value"])))
    return F.sha2(F.to_json(F.concat(F.array(*(F.col(c).cast("string") for c in source)), flat)), 256)


def once(facts: DataFrame, document: str, source: list[str], order: list[str], fact_type: str = "fact_type", payload: str = "payload") -> DataFrame:
    """A document's facts once for each page, evidence and key, the first in order; equal payloads of different persons both stay."""
    named = facts.withColumns({"evidence_hash": evidence_hash(source, F.col(payload)), "fact_key": key_of(F.col(fact_type), F.col(payload))})
    by = Window.partitionBy(document, "source_page", "evidence_hash", "fact_key").orderBy(*order)
    return named.withColumn("_first", F.row_number().over(by)).filter("_first = 1").drop("_first")
