"""Merges of new rows into a table: both sides are DataFrames, the result is the new table.

Parquet has no MERGE, so a merged table is written as a new version; see
larder.sources.tables. Every merge is one shuffle by key, whatever the number of batches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.text import text_union
from larder.operators.relational import required


def insert_absent(table: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """The table and the new rows whose key it lacks; of new rows with one key the first."""
    if order:
        new = new.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_place = 1").drop("_place")
    else:
        new = new.dropDuplicates(keys)
    return table.unionByName(new.join(table.select(*keys).distinct(), keys, "left_anti"))


def replace_children(table: DataFrame, new: DataFrame, parent: list[str]) -> DataFrame:
    """All rows of the parents in `new` are replaced."""
    return table.join(new.select(*parent).distinct(), parent, "left_anti").unionByName(new)


def upsert(table: DataFrame, new: DataFrame, keys: list[str], observed: str | None, seq: str, overwrite: list[str], fill: list[str]) -> DataFrame:
    """Fold new rows, in order of `seq`, into the rows of their keys.

    With `observed`, a row older than what its key holds is dropped; an equal or unknown
    time is not older. `overwrite` columns take the last row's value, `fill` columns the
    last value that is not null. Since a dropped row is older than one before it, it is
    enough to know the newest time so far, so the fold is a running maximum and two
    aggregates by order instead of a loop.
    """
    both = table.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = ["_new", seq]
    kept = both
    if observed:
        before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        newest = F.max(observed).over(before)
        kept = both.withColumn("_newest", newest).filter(F.col(observed).isNull() | F.col("_newest").isNull() | (F.col(observed) >= F.col("_newest")))
    place = F.struct(*order)
    aggs = [F.max_by(c, place).alias(c) for c in overwrite if c not in keys]
    aggs += [F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in fill]
    if observed:
        aggs.append(F.max(observed).alias(observed))
    aggs.append(F.max(seq).alias(seq))
    return kept.groupBy(*keys).agg(*aggs)


def merge_by_type(table: DataFrame, new: DataFrame, policies: dict[str, dict], kind: str = "kind", keys: tuple[str, ...] = ("person_id", "record_key"), payload: str = "payload", observed: str = "observed_at", seq: str = "seq", fact: str = "fact_id") -> tuple[DataFrame, DataFrame]:
    """`upsert` for rows of many record types at once, as (merged, detached): one shuffle for all types, each by its own policy.

    The payload is a VARIANT object, so rows of a type carry the fields of that type. A
    policy names the fields that the last row overwrites, those that only a known value
    does, and whether rows older than the newest so far are dropped (`guard`); a field that it does not
    name keeps what the key's first row has. Types without a policy are an error. The fact
    of a guarded type is that of its last row that has one, else the first row's; the
    facts of rows that the merge has used up are `detached` (kind, keys, fact).
    """
    fields = sorted({f for p in policies.values() for f in (*p["overwrite"], *p["fill"], *p.get("keep", ()))})
    is_in = lambda name: {f: [k for k, p in policies.items() if f in p.get(name, ())] for f in fields}
    over, fill = is_in("overwrite"), is_in("fill")
    guarded = [k for k, p in policies.items() if p["guard"]]
    known = required(F.col(kind).isin(*policies), "a record type has no merge policy")
    both = table.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1))).filter(known)
    before = Window.partitionBy(kind, *keys).orderBy("_new", seq).rowsBetween(Window.unboundedPreceding, -1)
    is_guarded = F.col(kind).isin(*guarded)
    newest = F.max(observed).over(before)
    kept = both.withColumn("_newest", newest).withColumn("_stale", is_guarded & F.coalesce(F.col(observed) < F.col("_newest"), F.lit(False)))
    rank = lambda sign: F.struct((F.col("_new") * sign).cast("long").alias("a"), (F.col(seq) * sign).cast("long").alias("b"))
    live, last, first = ~F.col("_stale"), rank(1), rank(-1)
    value = lambda f: F.try_variant_get(payload, f"$.{f}", "variant")
    has = lambda f: value(f).isNotNull() & ~F.is_variant_null(value(f))

    def place(f):
        return F.when(~live, None).when(F.col(kind).isin(*over[f]), last).when(F.col(kind).isin(*fill[f]), F.when(has(f), last)).otherwise(first)

    taken = [F.max_by(F.to_json(F.struct(value(f).alias("v"))), place(f)).alias(f"_f{k}") for k, f in enumerate(fields)]
    own_fact = F.coalesce(F.max_by(fact, F.when(live & is_guarded & F.col(fact).isNotNull(), last)), F.max_by(fact, F.when(live, first)))
    merged = kept.groupBy(kind, *keys).agg(*taken, own_fact.alias(fact), F.max(observed).alias(observed), F.max(seq).alias(seq))
    # each field is a JSON object of one member or none, so that values of any type stay as they are
    inner = [F.when(F.length(f"_f{k}") > 2, F.concat(F.lit(f'"{f}":'), F.expr(f"substring(_f{k}, 6, length(_f{k}) - 6)"))) for k, f in enumerate(fields)]
    whole = F.parse_json(F.concat(F.lit("{"), F.concat_ws(",", *inner), F.lit("}")))
    rows = merged.select(kind, *keys, whole.alias(payload), observed, seq, fact)
    held = rows.select(kind, *keys, F.col(fact).alias("_held"))
    facts = both.filter(F.col(fact).isNotNull()).select(kind, *keys, fact).distinct()
    detached = facts.join(held, [kind, *keys]).filter(~F.col(fact).eqNullSafe(F.col("_held"))).drop("_held")
    return rows, detached


def fill_missing(table: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Only what the table does not know is taken from the new rows, one for each key."""
    got = new.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns))
    out = table.join(got, keys, "left")
    return out.withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop(*(f"_{c}" for c in columns))


def union_texts(df: DataFrame, keys: list[str], order: str, text: list[str], fill: list[str]) -> DataFrame:
    """Rows of one key become one: texts are united in order, other columns keep the first value known.

    A text that comes again, in any case, changes nothing, so each is taken once before a
    key's texts meet: what meets is what the united text is made of, however many rows there are.
    Texts and other columns go through the same two groupings, so rows are read once and nothing is joined.
    """
    # an entry for each text that is not blank, and one at least for the row's other columns
    texts = [F.col(c).cast("string") for c in text] or [F.lit(None).cast("string")]
    entries = F.array(*(F.struct(F.lit(k).alias("k"), F.when(F.trim(c) != "", F.lower(F.trim(c))).alias("same"), c.alias("text")) for k, c in enumerate(texts)))
    each = df.withColumn("_e", F.explode(F.filter(entries, lambda e: (e["k"] == 0) | e["same"].isNotNull())))
    known = [F.min_by(F.struct(F.col(order).alias("at"), F.col(c).alias("value")), F.when((F.col("_e.k") == 0) & F.col(c).isNotNull(), F.col(order))).alias(f"_f{j}") for j, c in enumerate(fill)]
    once = each.groupBy(*keys, F.col("_e.k").alias("_k"), F.col("_e.same").alias("_same")).agg(F.min(order).alias("_at"), F.min_by("_e.text", order).alias("_text"), *known)
    first = [F.min_by(f"_f{j}.value", f"_f{j}.at").alias(c) for j, c in enumerate(fill)]
    lists = [F.collect_list(F.when((F.col("_k") == k) & F.col("_same").isNotNull(), F.struct("_at", "_text"))).alias(f"_t{k}") for k in range(len(text))]
    united = [F.aggregate(F.array_sort(f"_t{k}"), F.lit(None).cast("string"), lambda a, x: text_union(a, x["_text"])).alias(c) for k, c in enumerate(text)]
    return once.groupBy(*keys).agg(*first, *lists).select(*keys, *fill, *united)


def reconcile_snapshot(table: DataFrame, snapshot: DataFrame, person: str, scope: list[str], identity: list[str], payload: list[str]) -> DataFrame:
    """An authoritative list of all that is active for a scope, such as a person at a facility.

    Columns besides those named: status, observed_at, discontinued_at. A scope's snapshot
    is refused, and its table rows stay as they are, unless all its rows are active and
    carry one time, later than every time the table has for the scope. Otherwise rows
    that match by identity, anywhere for the person, become active at the snapshot's
    time with its payload; active rows of the scope that are not in it become inactive
    at that time; the rest of the snapshot is inserted.
    """
    known = table.groupBy(*scope).agg(F.max("observed_at").alias("_known"))
    facts = snapshot.groupBy(*scope).agg(
        F.count("*").alias("_n"), F.count("observed_at").alias("_timed"), F.min("observed_at").alias("_from"), F.max("observed_at").alias("_at"), F.bool_and(F.col("status") == "active").alias("_active")
    )
    good = facts.join(known, scope, "left").filter(
        F.coalesce("_active", F.lit(False)) & (F.col("_n") == F.col("_timed")) & (F.col("_from") == F.col("_at")) & (F.col("_known").isNull() | (F.col("_at") > F.col("_known")))
    )
    good = good.select(*scope, "_at")
    match = [person, *[c for c in identity if c != person]]
    fresh = snapshot.join(good, scope).dropDuplicates(match)
    lookup = fresh.select(*match, F.lit(True).alias("_hit"), F.col("_at").alias("_hit_at"), *(F.col(c).alias(f"_new_{c}") for c in payload))
    old = table.join(lookup, match, "left").join(good, scope, "left")
    hit = F.coalesce("_hit", F.lit(False))
    gone = ~hit & F.col("_at").isNotNull() & (F.col("status") == "active")
    updated = old.withColumns({
        "status": F.when(hit, "active").when(gone, "inactive").otherwise(F.col("status")),
        "observed_at": F.when(hit, F.col("_hit_at")).when(gone, F.col("_at")).otherwise(F.col("observed_at")),
        "discontinued_at": F.when(gone, F.col("_at")).when(~hit, F.col("discontinued_at")),
        **{c: F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)) for c in payload},
    }).select(*table.columns)
    added = fresh.join(table.select(*match).distinct(), match, "left_anti").withColumn("discontinued_at", F.lit(None).cast(table.schema["discontinued_at"].dataType))
    return updated.unionByName(added.select(*table.columns))


def dedupe_then_insert(table: DataFrame, new: DataFrame, batch_key: list[str], store_key: list[str], order: list[Column]) -> DataFrame:
    """Of new rows with one batch key the first; of those the ones whose store key the table lacks."""
    first = new.withColumn("_place", F.row_number().over(Window.partitionBy(*batch_key).orderBy(*order))).filter("_place = 1").drop("_place")
    return first.join(table.select(*store_key).distinct(), store_key, "left_anti")


def patch(table: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Point updates: values that are not null in `changes`, one row for each key, replace the table's."""
    got = changes.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    return table.join(got, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*(f"_{c}" for c in columns))


def lifecycle(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Drafts and finals. `changes` has key, status, content, at, each may be null but the key.

    Blank content changes nothing. Becoming final stamps finalized_at once; becoming a
    draft clears it. `needs_embedding` holds where a final row has new content or no longer was final.
    """
    got = changes.select(key, F.col("status").alias("_status"), F.nullif(F.trim("content"), F.lit("")).alias("_content"), F.col("at").alias("_at"))
    out = table.join(got, key, "left")
    status = F.coalesce("_status", "status")
    changed = F.col("_content").isNotNull() & ~F.col("_content").eqNullSafe(F.col("content"))
    stamped = F.when(status == "draft", None).when((status == "finalized") & F.col("finalized_at").isNull(), F.col("_at")).otherwise(F.col("finalized_at"))
    needs = (status == "finalized") & (changed | (F.col("status") != "finalized"))
    return out.withColumns({"needs_embedding": F.coalesce(needs, F.lit(False)), "finalized_at": stamped, "content": F.coalesce("_content", "content"), "status": status}).drop("_status", "_content", "_at")


def union_all(tables: list[DataFrame]) -> DataFrame:
    """Tables of different columns under each other."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def sync_assessments(notes: DataFrame, assessments: DataFrame) -> DataFrame:
    """Assessments to insert for nutrition notes (id, person_id, note_type, note_text, note_date, author) that have none yet: final ones with the note's text, dated and signed as the note. Blank notes make none."""
    from larder.functions.text import content_hash
    from larder.operators.notes import is_nutrition_note

    own = notes.filter(is_nutrition_note(F.col("note_type")) & (F.trim("note_text") != ""))
    new = own.join(assessments.select(F.col("source_progress_note_id").alias("id")).distinct(), "id", "left_anti")
    return new.select(
        "person_id", F.trim("note_text").alias("content"), content_hash(F.col("note_text")).alias("content_hash"), F.lit("finalized").alias("status"), F.col("note_date").alias("finalized_at"), F.col("author").alias("created_by"), F.col("id").alias("source_progress_note_id")
    )
