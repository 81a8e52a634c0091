"""Who a record belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.text import fold, identity_hash, sex_code


def normalised(df: DataFrame) -> DataFrame:
    """Columns first_key, last_key, sex and identifier as identities compare them."""
    return df.withColumns({"first_key": fold(F.col("first_name")), "last_key": fold(F.col("last_name")), "sex": sex_code(F.col("sex")), "identifier": F.nullif(F.trim("identifier"), F.lit(""))})


def resolve(records: DataFrame, people: DataFrame, record: str = "record_id") -> DataFrame:
    """Match records to people: by identifier and facility, else by name and birth date, else by name alone where the birth date is unknown on a side.

    Each way must give one person, or the record is ambiguous. A match by identifier with
    another birth date is a conflict; one by name and birth date may be at another
    facility. What no way matches is new, under an id made from its identity, so records
    of one new person share it in any order.
    """
    r, p = normalised(records), normalised(people)
    p = p.select("person_id", *(F.col(c).alias(f"p_{c}") for c in ("identifier", "facility_id", "first_key", "last_key", "date_of_birth")))
    ends = lambda way, of=None: [f(F.col("person_id") if of is None else F.when(of, F.col("person_id"))).alias(f"{way}_{e}") for e, f in (("lo", F.min), ("hi", F.max))]
    # the least and the greatest person of each key meet the records, not all that share it: two differ where there are several
    undated = F.col("p_date_of_birth").isNull()
    at = p.filter("p_identifier IS NOT NULL").groupBy("p_identifier", "p_facility_id").agg(*ends("by_id"))
    named = p.filter("p_first_key IS NOT NULL AND p_last_key IS NOT NULL").groupBy("p_first_key", "p_last_key")
    dated = p.filter(~undated).groupBy("p_first_key", "p_last_key", "p_date_of_birth").agg(*ends("by_birth"))
    named = named.agg(*ends("any"), *ends("none", undated))
    keyed = r.select(record, "identifier", "facility_id", "first_key", "last_key", "date_of_birth")
    name = (F.col("first_key") == F.col("p_first_key")) & (F.col("last_key") == F.col("p_last_key"))
    met = keyed.join(at, (F.col("identifier") == F.col("p_identifier")) & F.col("facility_id").eqNullSafe(F.col("p_facility_id")), "left").select(*keyed.columns, "by_id_lo", "by_id_hi")
    met = met.join(dated, name & (F.col("date_of_birth") == F.col("p_date_of_birth")), "left").select(*met.columns, "by_birth_lo", "by_birth_hi")
    met = met.join(named, name, "left")
    own = {f"by_name_{e}": F.when(F.col("date_of_birth").isNull(), F.col(f"any_{e}")).otherwise(F.col(f"none_{e}")) for e in ("lo", "hi")}
    met = met.withColumns(own).groupBy(record).agg(*(f(f"{way}_{e}").alias(f"{way}_{e}") for way in ("by_id", "by_birth", "by_name") for e, f in (("lo", F.min), ("hi", F.max))))
    one = lambda way: F.when(F.col(f"{way}_lo") == F.col(f"{way}_hi"), F.col(f"{way}_lo")).alias(way)
    many_of = lambda way: F.coalesce(F.col(f"{way}_lo") != F.col(f"{way}_hi"), F.lit(False)).alias(f"{way}_many")
    out = r.join(met.select(record, *(f(way) for way in ("by_id", "by_birth", "by_name") for f in (one, many_of))), record, "left")
    births = p.select(F.col("person_id").alias("by_id"), F.col("p_date_of_birth").alias("_born"))
    out = out.join(births, "by_id", "left")
    found = F.coalesce("by_id", "by_birth", "by_name")
    many = F.coalesce("by_id_many", F.lit(False)) | (F.col("by_id").isNull() & F.coalesce("by_birth_many", F.lit(False))) | (F.col("by_id").isNull() & F.col("by_birth").isNull() & F.coalesce("by_name_many", F.lit(False)))
    other = F.col("by_id").isNotNull() & F.col("date_of_birth").isNotNull() & F.col("_born").isNotNull() & (F.col("date_of_birth") != F.col("_born"))
    status = F.when(other, "conflict").when(many, "ambiguous").when(found.isNull(), "new").otherwise("matched")
    key = F.when(F.col("identifier").isNotNull(), identity_hash(F.col("identifier"), F.col("facility_id").cast("string"))).otherwise(identity_hash(F.col("first_key"), F.col("last_key"), F.col("date_of_birth").cast("string")))
    return out.select(record, status.alias("status"), F.when(status == "matched", found).alias("person_id"), F.when(status == "new", key).alias("new_key"))


def assign_identifier(stored: Column, incoming: Column) -> Column:
    """A known identifier stays; another one is a conflict."""
    status = F.when(incoming.isNull() | stored.eqNullSafe(incoming), "unchanged").when(stored.isNull(), "assigned").otherwise("conflict")
    return F.struct(status.alias("status"), F.coalesce(stored, incoming).alias("identifier"))


def document_facility(facts: DataFrame, document: str = "document_id", facility: str = "facility_id") -> DataFrame:
    """A document belongs to a facility only if its facts name exactly one."""
    return facts.groupBy(document).agg(F.when(F.count_distinct(facility) == 1, F.min(facility)).alias(facility))


def new_documents(batch: DataFrame, known: DataFrame, checksum: str = "checksum", order: str = "path") -> DataFrame:
    """Documents not yet known, once each, the first path of equal ones."""
    from larder.operators.temporal import first_wins

    return first_wins(batch, [checksum], [F.col(order)]).join(known.select(checksum).distinct(), checksum, "left_anti")


def valid_keys(keys: DataFrame, permission: str, now: Column) -> DataFrame:
    """API keys that are active, not expired and hold the permission."""
    return keys.filter(F.col("active") & (F.col("expires_at").isNull() | (F.col("expires_at") >= now)) & F.array_contains("permissions", permission))


def _compatible(stats: DataFrame, seekers: DataFrame, key: str) -> DataFrame:
    """(key, lo, hi): the least and greatest root among those that share a name with a seeker, at its facility or where one of the two is unknown. Only two roots for each name and facility meet a seeker, however common the name."""
    name = ["first_key", "last_key"]
    ends = [F.min("root").alias("lo"), F.max("root").alias("hi")]
    everywhere = stats.groupBy(*name).agg(*ends)
    at = stats.groupBy(*name, "facility_id").agg(*ends)
    anywhere = seekers.filter("facility_id IS NULL").join(everywhere, name)
    own = seekers.filter("facility_id IS NOT NULL").join(at, [*name, "facility_id"])
    unknown = seekers.filter("facility_id IS NOT NULL").join(at.filter("facility_id IS NULL").drop("facility_id"), name)
    met = [d.select(key, "lo", "hi") for d in (anywhere, own, unknown)]
    return met[0].unionByName(met[1]).unionByName(met[2]).groupBy(key).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def resolve_new(records: DataFrame, record: str = "record_id") -> DataFrame:
    """(record, status, person_key) for records of people who are not stored yet, in any order.

    A record is known by its identifier and facility, by its names and birth date, or by
    both: then the two are one person, and so on along chains. People so found with more
    than one birth date are a conflict. One without birth date joins the one dated person
    of its name who has no identifier, at the same facility or where one is unknown; a
    record with a name alone joins the one person of that name. Where several would do,
    it is ambiguous; a name alone that nobody has is insufficient. `person_key` is one
    for all records of a person, null unless the status is new.
    """
    from larder.operators.components import components
    from larder.sources.staging import written

    name = ["first_key", "last_key"]
    r = normalised(records)
    full = (F.col("first_key") != "") & (F.col("last_key") != "")
    by_name = F.when(full & F.col("date_of_birth").isNotNull(), identity_hash(F.lit("name"), *map(F.col, name), F.col("date_of_birth").cast("string")))
    by_id = F.when(F.col("identifier").isNotNull(), identity_hash(F.lit("id"), F.col("identifier"), F.col("facility_id").cast("string")))
    r = r.select(record, *(F.when(full, F.col(c)).alias(c) for c in name), "date_of_birth", "identifier", "facility_id", by_name.alias("by_name"), by_id.alias("by_id"))
    r = written(r, "identities")
    roots = components(r.select(F.coalesce("by_name", "by_id").alias("a"), F.coalesce("by_id", "by_name").alias("b")))
    keyed = r.withColumn("node", F.coalesce("by_name", "by_id")).join(roots, "node", "left").drop("node")
    keyed = written(keyed, "identities")
    people = keyed.filter("root IS NOT NULL").groupBy("root").agg(
        F.count_distinct("date_of_birth").alias("births"), F.bool_or(F.col("identifier").isNotNull()).alias("identified"), F.bool_or(F.col("facility_id").isNotNull()).alias("placed")
    )
    # where each person's names are known to be; an unknown facility counts only for people who have no other
    seen = keyed.filter(F.col("root").isNotNull() & F.col("first_key").isNotNull()).select("root", *name).distinct()
    where = keyed.filter("root IS NOT NULL").select("root", "facility_id").distinct().join(people, "root").filter("facility_id IS NOT NULL OR NOT placed")
    places = written(seen.join(where, "root"), "identities")
    undated = places.filter("births = 0 AND identified")
    joined = _compatible(places.filter("births = 1 AND NOT identified"), undated.withColumnRenamed("root", "seeker"), "seeker")
    moved = people.join(joined.withColumnRenamed("seeker", "root"), "root", "left").select(
        "root", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("root")).alias("person"),
        F.when(F.col("births") > 1, "conflict").when(F.col("lo") != F.col("hi"), "ambiguous").otherwise("new").alias("status"),
    )
    moved = written(moved, "identities")
    settled = places.join(moved.filter("status <> 'ambiguous'"), "root").select(*name, "facility_id", F.col("person").alias("root"))
    named = keyed.filter("root IS NULL AND first_key IS NOT NULL")
    found = _compatible(settled, named.select(record, *name, "facility_id"), record)
    alone = keyed.filter("root IS NULL").select(record).join(found, record, "left").join(moved.select(F.col("root").alias("lo"), F.col("status").alias("of")), "lo", "left")
    alone = alone.select(record, F.when(F.col("lo").isNull(), "insufficient").when(F.col("lo") != F.col("hi"), "ambiguous").otherwise(F.col("of")).alias("status"), F.col("lo").alias("person"))
    rest = keyed.filter("root IS NOT NULL").select(record, "root").join(moved, "root").select(record, "status", "person")
    return rest.unionByName(alone).select(record, "status", F.when(F.col("status") == "new", F.col("person")).alias("person_key"))


def resolve_batch(records: DataFrame, people: DataFrame, record: str = "record_id") -> DataFrame:
    """`resolve` against the stored people, then `resolve_new` among what they leave: (record, status, person_id, person_key)."""
    first = resolve(records, people, record)
    new = resolve_new(records.join(first.filter("status = 'new'").select(record), record, "left_semi"), record)
    kept = first.filter("status <> 'new'").select(record, "status", "person_id").withColumn("person_key", F.lit(None).cast("string"))
    return kept.unionByName(new.withColumn("person_id", F.lit(None).cast(first.schema["person_id"].dataType)).select(record, "status", "person_id", "person_key"))


def with_ids(facts: DataFrame, people: DataFrame, facilities: DataFrame, record: str = "record_id") -> DataFrame:
    """Facts with person_id and facility_id: those that a fact names itself, else what its record was resolved to (record, person_id) and what its facility's name stands for (name, facility_id)."""
    found = people.select(record, F.col("person_id").alias("_person"))
    places = facilities.groupBy(fold(F.col("name")).alias("_name")).agg(F.when(F.count_distinct("facility_id") == 1, F.min("facility_id")).alias("_facility"))
    out = facts.withColumn("_name", fold(F.col("facility_name"))).join(found, record, "left").join(places, "_name", "left")
    return out.withColumns({"person_id": F.coalesce("person_id", "_person"), "facility_id": F.coalesce("facility_id", "_facility")}).drop("_name", "_person", "_facility")


def register_trusted(facilities: DataFrame, trusted: DataFrame) -> DataFrame:
    """Facilities (facility_identifier, name) with those of a trusted source that are not known by name or identifier; resolving never adds any."""
    own = trusted.withColumn("_name", fold(F.col("name"))).dropDuplicates(["_name"])
    known = facilities.select(fold(F.col("name")).alias("_name")).distinct()
    numbers = facilities.filter("facility_identifier IS NOT NULL").select("facility_identifier").distinct()
    return facilities.unionByName(own.join(known, "_name", "left_anti").join(numbers, "facility_identifier", "left_anti").select(*facilities.columns))
