"""Payloads of facts as typed structs: canonical texts and keys, rows of the relations, times filled in from notes.

A payload is a struct of any depth; the recursion runs over its type while the plan is
built, so all of it stays one expression in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder import fixed_values as fixed
from larder.functions.text import fold
from larder.operators.facts import relation_of

DETERMINISTIC_REASON = "Deterministic report extraction"


def _quoted(x: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(x, r"([\\\"])", r"\\$1"), "\n", r"\\n"), F.lit('"'))


def _number(x: Column, kind: T.DataType) -> Column:
    """Six decimals at most, without closing zeros, so that 5 and 5.0 are one number."""
    if isinstance(kind, T.IntegralType):
        return x.cast("string")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        x = F.round(x.cast("double"), 6)
    return F.regexp_replace(F.regexp_replace(x.cast("decimal(38,6)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def canonical(value: Column, kind: T.DataType, drop: tuple[str, ...] = (), sort_lists: bool = False, text: Callable[[Column], Column] = lambda x: x) -> Column:
    """A value as one text: fields in order of their names, unknown ones and those in `drop` left out at every depth; null where the value is null.

    Lists keep their order, or with `sort_lists` are in order of their members' texts, so
    that permuted lists are the same; unknown members count. `text` is applied to every string.
    """
    deeper = lambda v, k: canonical(v, k, drop, sort_lists, text)
    if isinstance(kind, T.StructType):
        fields = [f for f in sorted(kind.fields, key=lambda f: f.name) if f.name not in drop]
        parts = [F.concat(F.lit(f'"{f.name}":'), deeper(value.getField(f.name), f.dataType)) for f in fields]
        return F.when(value.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))
    if isinstance(kind, T.MapType):
        entries = F.filter(F.map_entries(value), lambda e: e["value"].isNotNull() & ~e["key"].cast("string").isin(*drop) if drop else e["value"].isNotNull())
        shown = F.transform(F.array_sort(F.transform(entries, lambda e: F.struct(e["key"].cast("string").alias("k"), deeper(e["value"], kind.valueType).alias("v")))), lambda e: F.concat(_quoted(e["k"]), F.lit(":"), e["v"]))
        return F.when(value.isNotNull(), F.concat(F.lit("{"), F.array_join(shown, ","), F.lit("}")))
    if isinstance(kind, T.ArrayType):
        members = F.transform(value, lambda x: F.coalesce(deeper(x, kind.elementType), F.lit("null")))
        return F.concat(F.lit("["), F.array_join(F.array_sort(members) if sort_lists else members, ","), F.lit("]"))
    if isinstance(kind, T.NumericType):
        return _number(value, kind)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(value, "'\"'yyyy-MM-dd'T'HH:mm:ss'\"'")
    if isinstance(kind, T.BooleanType):
        return value.cast("string")
    shown = value.cast("string")
    return _quoted(text(shown) if isinstance(kind, T.StringType) else shown)


def _key(fact_type: Column, body: Column) -> Column:
    return F.sha2(F.concat(F.lit("["), _quoted(fact_type), F.lit(","), F.coalesce(body, F.lit("{}")), F.lit("]")), 256)


def state_key(fact_type: Column, payload: Column, kind: T.StructType) -> Column:
    """The identity of a state: its fields but those that change with its course, texts folded and without empty ones, lists in any order."""
    return _key(fact_type, canonical(payload, kind, fixed.STATE_KEY_EXCLUDES, True, lambda x: F.nullif(fold(x), F.lit(""))))


def fact_key(fact_type: Column, payload: Column, kind: T.StructType) -> Column:
    """The identity of a fact or an observation: all fields as they are, its time among them."""
    return _key(fact_type, canonical(payload, kind))


def _has(kind: T.StructType, name: str) -> bool:
    return name in kind.fieldNames()


def back_filled(payload: Column, kind: T.StructType, note_date: Column) -> Column:
    """A payload whose observed_at is unknown takes the note's date; one without such a field stays as it is."""
    if not _has(kind, "observed_at"):
        return payload
    known = F.coalesce(payload.getField("observed_at"), note_date.cast(kind["observed_at"].dataType))
    return F.when(payload.isNotNull(), payload.withField("observed_at", known))


def domain_row(fact_type: Column, payload: Column, kind: T.StructType) -> Column:
    """A payload as the row of its relation: without the source's own fields, a wound's type as `type`, and the unknown place of a wound or an edema as Unspecified."""
    row = payload.dropFields(*[c for c in fixed.SOURCE_FIELDS if _has(kind, c)]) if any(_has(kind, c) for c in fixed.SOURCE_FIELDS) else payload
    if _has(kind, "location"):
        place = payload.getField("location")
        row = row.withField("location", F.when(fact_type.isin("wound", "edema"), F.coalesce(F.nullif(place, F.lit("")), F.lit("Unspecified"))).otherwise(place))
    if _has(kind, "wound_type"):
        row = row.withField("type", F.when(fact_type == "wound", payload.getField("wound_type"))).dropFields("wound_type")
    return F.when(payload.isNotNull(), row)


def observed_at(fact_type: Column, payload: Column, kind: T.StructType) -> Column:
    """When the source saw it: a weight's measured_at, else observed_at."""
    time = lambda name: payload.getField(name).cast("timestamp") if _has(kind, name) else F.lit(None).cast("timestamp")
    return F.when(relation_of(fact_type).isNotNull(), F.when(fact_type == "weight", time("measured_at")).otherwise(time("observed_at")))


def routed(facts: DataFrame, fact_type: str = "fact_type", payload: str = "payload") -> DataFrame:
    """Add relation, observed_at, effective_at, fact_key, state_key (stateful types), observation_key (observations) and row. A type without relation keeps a null relation, to be reported."""
    kind, value, fact = facts.schema[payload].dataType, F.col(payload), F.col(fact_type)
    effective = value.getField("effective_at").cast("timestamp") if _has(kind, "effective_at") else F.lit(None).cast("timestamp")
    return facts.withColumns({
        "relation": relation_of(fact),
        "observed_at": observed_at(fact, value, kind),
        "effective_at": effective,
        "fact_key": fact_key(fact, value, kind),
        "state_key": F.when(fact.isin(*fixed.STATEFUL_FACTS), state_key(fact, value, kind)),
        "observation_key": F.when(fact.isin(*fixed.OBSERVATION_FACTS), fact_key(fact, value, kind)),
        "row": domain_row(fact, value, kind),
    })


def note_facts(facts: DataFrame, notes: DataFrame, note: str = "note_id", payload: str = "payload", model: str | None = None) -> DataFrame:
    """Facts read from notes with what the note tells of them: its person, page and place, and its date where the payload has none.

    With `model` they are its guesses and keep their own confidence; without, they are
    certain. `notes` has the note's id, person_id, identifier, person_name, facility_name,
    date_of_birth, sex, height_in, source_page and note_date; what it knows of the person
    is passed on only while the person is not resolved.
    """
    kind = facts.schema[payload].dataType
    out = facts.join(notes, note, "left").withColumn(payload, back_filled(F.col(payload), kind, F.col("note_date")))
    told = {c: F.when(F.col("person_id").isNull(), F.col(c)) for c in ("date_of_birth", "sex", "height_in")}
    if model:
        return out.withColumns({**told, "extraction_method": F.lit("ai"), "model_name": F.lit(model)})
    return out.withColumns({**told, "extraction_method": F.lit("deterministic"), "confidence": F.lit(1.0), "confidence_reason": F.lit(DETERMINISTIC_REASON)})


def document_sources(documents: DataFrame, facts: DataFrame, document: str = "document_id") -> DataFrame:
    """(document, source_page, evidence_hash, source_section): where the facts of each document were found, once each, under the first fact's type; a document without facts is its own source, under its checksum."""
    found = facts.groupBy(document, "source_page", "evidence_hash").agg(F.min_by("fact_type", "fact_order").alias("source_section"))
    bare = documents.join(facts.select(document).distinct(), document, "left_anti")
    own = bare.select(document, F.lit(None).cast(facts.schema["source_page"].dataType).alias("source_page"), F.regexp_replace("checksum", "^sha256:", "").alias("evidence_hash"), F.lit("document").alias("source_section"))
    return found.unionByName(own)
