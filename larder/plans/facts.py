"""Typed facts from the orders, and merges of several kinds at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder import fixed_values as fixed
from larder.operators import merge, payloads
from larder.plans.records import CUT
from larder.plans.registry import query
from larder.sources.tables import read

KINDS = {"1-URGENT": "diet", "2-HIGH": "wound", "3-MEDIUM": "edema", "4-NOT SPECIFIED": "appetite", "5-LOW": "weight"}

#: An order's line items are its lists, read up or down by the order's number, so equal orders differ in nothing but the lists' order.
_FACTS = """f AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'diet' WHEN '2-HIGH' THEN 'wound' WHEN '3-MEDIUM' THEN 'edema' WHEN '4-NOT SPECIFIED' THEN 'appetite' WHEN '5-LOW' THEN 'weight' END AS fact_type, o_orderdate,
  CASE WHEN o_orderkey % 3 = 0 THEN ' Puree ' WHEN o_orderkey % 3 = 1 THEN 'puree' END AS texture, CASE WHEN o_orderkey % 4 = 0 THEN 'Left  Heel' END AS location, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END AS seen, o_totalprice / 1000 AS amount,
  coalesce(list(l_returnflag ORDER BY CASE WHEN o_orderkey % 2 = 0 THEN -l_linenumber ELSE l_linenumber END, l_returnflag, floor(l_quantity / 10), l_linestatus) FILTER (WHERE l_orderkey IS NOT NULL), []) AS flags,
  coalesce(list({'n': floor(l_quantity / 10)::BIGINT, 'tag': l_linestatus} ORDER BY CASE WHEN o_orderkey % 2 = 0 THEN -l_linenumber ELSE l_linenumber END, l_returnflag, floor(l_quantity / 10), l_linestatus) FILTER (WHERE l_orderkey IS NOT NULL), []) AS items
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"""


def facts(spark, sf):
    key = F.col("o_orderkey")
    orders = read(spark, sf, "orders").filter(F.col("o_orderkey").isNotNull())
    at = F.when(key % 2 == 0, -F.col("l_linenumber")).otherwise(F.col("l_linenumber"))
    item = F.when(F.col("l_orderkey").isNotNull(), F.struct(at.alias("at"), F.col("l_returnflag").alias("flag"), F.struct(F.floor(F.col("l_quantity") / 10).cast("long").alias("n"), F.col("l_linestatus").alias("tag")).alias("item")))
    lists = orders.join(read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity"), F.col("l_orderkey") == key, "left").groupBy(*orders.columns).agg(F.array_sort(F.collect_list(item)).alias("lines"))
    priority = F.col("o_orderpriority")
    fact_type = F.try_element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), priority)
    payload = F.struct(
        F.when(key % 3 == 0, F.lit(" Puree ")).when(key % 3 == 1, F.lit("puree")).alias("texture"), F.when(key % 4 == 0, F.lit("Left  Heel")).alias("location"), F.col("lines.flag").alias("restrictions"), F.col("lines.item").alias("parts"),
        (F.col("o_totalprice") / 1000).alias("amount"), F.col("o_orderstatus").alias("wound_type"), F.lit("active").alias("status"), F.lit("report").alias("source_category"), F.when(key % 2 == 0, F.col("o_orderdate")).alias("observed_at"),
    )
    return lists.select("o_orderkey", fact_type.alias("fact_type"), payload.alias("payload"), F.col("o_orderdate").alias("note_date"))


def _facts_sql() -> str:
    number = lambda x: f"regexp_replace(regexp_replace(round({x}, 6)::DECIMAL(38,6)::VARCHAR, '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"
    quoted = lambda x: f"'\"' || {x} || '\"'"
    folded = lambda x: quoted(f"nullif(trim(regexp_replace(lower({x}), '\\s+', ' ', 'g')), '')")
    part = lambda text: f"list_transform(items, lambda x: '{{' || concat_ws(',', '\"n\":' || x.n::VARCHAR, '\"tag\":' || {text('x.tag')}) || '}}')"
    listed = lambda xs: f"'[' || array_to_string({xs}, ',') || ']'"
    time = "'\"' || strftime(seen, '%Y-%m-%dT%H:%M:%S') || '\"'"
    field = lambda name, value: f"'\"{name}\":' || ({value})"
    state = ", ".join([
        field("amount", number("amount")), field("location", folded("location")), field("parts", listed(f"list_sort({part(folded)})")), field("restrictions", listed("list_sort(list_transform(flags, lambda x: '\"' || lower(x) || '\"'))")),
        field("texture", folded("texture")), field("wound_type", folded("status_")),
    ])
    whole = ", ".join([
        field("amount", number("amount")), field("location", quoted("location")), field("observed_at", time), field("parts", listed(part(quoted))), field("restrictions", listed("list_transform(flags, lambda x: '\"' || x || '\"')")),
        field("source_category", "'\"report\"'"), field("status", "'\"active\"'"), field("texture", quoted("texture")), field("wound_type", quoted("status_")),
    ])
    key = lambda fields: f"sha256('[\"' || fact_type || '\",{{' || concat_ws(',', {fields}) || '}}]')"
    relation = "CASE fact_type " + " ".join(f"WHEN '{k}' THEN '{fixed.FACT_RELATIONS[k]}'" for k in KINDS.values()) + " END"
    row = ", ".join([
        field("amount", number("amount")), field("location", quoted("CASE WHEN fact_type IN ('wound', 'edema') THEN coalesce(location, 'Unspecified') ELSE location END")), field("observed_at", time), field("parts", listed(part(quoted))),
        field("restrictions", listed("list_transform(flags, lambda x: '\"' || x || '\"')")), field("status", "'\"active\"'"), field("texture", quoted("texture")), field("type", quoted("CASE WHEN fact_type = 'wound' THEN status_ END")),
    ])
    filled = _FACTS.replace("CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END AS seen", "o_orderdate AS seen").replace("o_totalprice / 1000 AS amount", "o_totalprice / 1000 AS amount, o_orderstatus AS status_")
    return f"""WITH {filled} SELECT o_orderkey, fact_type, {relation} AS relation, {key(whole)} AS fact_key, CASE WHEN fact_type = 'diet' THEN {key(state)} END AS state_key, CASE WHEN fact_type = 'appetite' THEN {key(whole)} END AS observation_key,
  CASE WHEN fact_type <> 'weight' THEN seen END AS observed_at, '{{' || concat_ws(',', {row}) || '}}' AS row FROM f"""


@query("q_typed_facts", _facts_sql())
def typed_facts(spark, sf):
    given = facts(spark, sf)
    kind = given.schema["payload"].dataType
    filled = given.withColumn("payload", payloads.back_filled(F.col("payload"), kind, F.col("note_date")))
    out = payloads.routed(filled)
    row = payloads.canonical(F.col("row"), out.schema["row"].dataType)
    return out.select("o_orderkey", "fact_type", "relation", "fact_key", "state_key", "observation_key", F.col("observed_at").cast("timestamp_ntz").alias("observed_at"), row.alias("row"))


_PERMUTED = _FACTS.replace("o_totalprice / 1000 AS amount", "NULL AS amount")


@query("q_state_keys", f"WITH {_PERMUTED}, g AS (SELECT o_orderkey, list_sort(flags)::VARCHAR || coalesce(lower(trim(texture)), '') AS same FROM f WHERE fact_type = 'diet') SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY same) AS first_order, count(*) OVER (PARTITION BY same) AS n FROM g")
def state_keys(spark, sf):
    """Orders whose restrictions are the same in any order, and whose textures differ in case and blanks only, are one state."""
    from pyspark.sql import Window

    diets = facts(spark, sf).filter("fact_type = 'diet'").select("o_orderkey", "fact_type", F.struct("payload.texture", "payload.restrictions", "payload.status", "payload.observed_at").alias("payload"))
    same = Window.partitionBy("state_key")
    return payloads.routed(diets).select("o_orderkey", F.min("o_orderkey").over(same).alias("first_order"), F.count("*").over(same).alias("n"))


#: Seven types by an order's number, and how each is merged.
TYPES = ["weight", "lab", "edema", "diet", "medication", "diagnosis", "allergy"]
POLICIES = {
    "weight": {"overwrite": ["weight_lb"], "fill": ["description"], "guard": False},
    "lab": {"overwrite": ["result"], "fill": ["unit", "flag"], "guard": False},
    "edema": {"overwrite": [], "fill": ["severity"], "keep": ["location"], "guard": False},
    "diet": {"overwrite": ["diet_type", "restrictions", "status"], "fill": [], "guard": True},
    **{k: {"overwrite": [], "fill": ["status"], "keep": ["name"], "guard": True} for k in ("medication", "diagnosis", "allergy")},
}
#: The value of each field in terms of an order; a field that the policy does not name is kept from the first row.
_FIELDS = {
    "weight_lb": "o_totalprice", "description": "CASE WHEN o_orderkey % 3 = 0 THEN 'd' || o_orderkey % 10 END", "result": "CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END", "unit": "CASE WHEN o_orderkey % 4 = 0 THEN 'mg' WHEN o_orderkey % 4 = 1 THEN 'g' END",
    "flag": "CASE WHEN o_orderkey % 6 = 0 THEN 'H' END", "severity": "CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END", "location": "o_orderpriority", "diet_type": "CASE WHEN o_orderkey % 4 > 0 THEN 'T' || o_orderkey % 7 END",
    "status": "CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END", "name": "o_orderpriority",
}


def _merge_sql() -> str:
    parts = []
    for k, kind in enumerate(TYPES):
        p = POLICIES[kind]
        fields = sorted({*p["overwrite"], *p["fill"], *p.get("keep", ())})
        rule = lambda f: "list(v ORDER BY new, seq) FILTER (WHERE NOT stale)".replace("v ORDER", f"{f} ORDER") + "[-1]" if f in p["overwrite"] else f"list({f} ORDER BY new, seq) FILTER (WHERE NOT stale AND {f} IS NOT NULL)[-1]" if f in p["fill"] else f"list({f} ORDER BY new, seq)[1]"  # noqa: E731, B023
        shown = lambda f: f"coalesce(array_to_string({f}, '/'), '-')" if f == "restrictions" else f"round({f}, 2)::VARCHAR" if f == "weight_lb" else f
        values = ", ".join(f"{_FIELDS[f]} AS {f}" if f != "restrictions" else "[o_orderstatus, 'r' || o_orderkey % 2] AS restrictions" for f in fields)
        stale = "coalesce(observed_at < max(observed_at) OVER (PARTITION BY person_id ORDER BY new, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE)" if p["guard"] else "FALSE"
        fact = "coalesce(list(fact_id ORDER BY new, seq) FILTER (WHERE NOT stale AND fact_id IS NOT NULL)[-1], list(fact_id ORDER BY new, seq)[1])" if p["guard"] else "list(fact_id ORDER BY new, seq)[1]"
        parts.append(f"""SELECT '{kind}' AS kind, person_id, concat_ws(';', {", ".join(f"'{f}=' || {shown(f)}" for f in fields)}) AS fields, fact_id, observed_at, coalesce(len(list_filter(facts, lambda x: x IS DISTINCT FROM fact_id)), 0) AS detached
FROM (SELECT person_id, {", ".join(f"{rule(f)} AS {f}" for f in fields)}, {fact} AS fact_id, max(observed_at) AS observed_at, list(DISTINCT fact_id) FILTER (WHERE fact_id IS NOT NULL) AS facts FROM (SELECT *, {stale} AS stale FROM (
  SELECT o_custkey AS person_id, {values}, CASE WHEN o_orderkey % 8 > 0 THEN o_orderdate END AS observed_at, o_orderkey AS seq, CASE WHEN o_orderkey % 9 > 0 THEN o_orderkey END AS fact_id, (o_orderdate >= TIMESTAMP '{CUT}')::INT AS new FROM orders WHERE o_orderkey % 7 = {k})) GROUP BY 1)""")
    return "\nUNION ALL\n".join(parts)


@query("q_merge_by_type", _merge_sql())
def merge_by_type(spark, sf):
    key = F.col("o_orderkey")
    values = {f: F.expr(e.replace("'d' || o_orderkey % 10", "concat('d', o_orderkey % 10)").replace("'T' || o_orderkey % 7", "concat('T', o_orderkey % 7)")) for f, e in _FIELDS.items()}
    values["restrictions"] = F.array("o_orderstatus", F.concat(F.lit("r"), (key % 2).cast("string")))
    body = None
    for k, kind in enumerate(TYPES):
        p = POLICIES[kind]
        own = F.to_variant_object(F.struct(*(values[f].alias(f) for f in (*p["overwrite"], *p["fill"], *p.get("keep", ())))))
        body = F.when(key % 7 == k, own) if body is None else body.when(key % 7 == k, own)
    rows = read(spark, sf, "orders").select(
        F.get(F.array(*map(F.lit, TYPES)), (key % 7).cast("int")).alias("kind"), F.col("o_custkey").alias("person_id"), F.lit("").alias("record_key"), body.alias("payload"),
        F.when(key % 8 > 0, F.col("o_orderdate")).alias("observed_at"), key.alias("seq"), F.when(key % 9 > 0, key).alias("fact_id"), F.col("o_orderdate"),
    )
    merged, detached = merge.merge_by_type(rows.filter(F.col("o_orderdate") < CUT).drop("o_orderdate"), rows.filter(F.col("o_orderdate") >= CUT).drop("o_orderdate"), POLICIES)
    gone = detached.groupBy("kind", "person_id").agg(F.count("*").alias("detached"))
    text = lambda f: F.try_variant_get("payload", f"$.{f}", "string")
    shown = {f: text(f) for f in values}
    shown["restrictions"] = F.array_join(F.try_variant_get("payload", "$.restrictions", "array<string>"), "/")
    shown["weight_lb"] = F.round(F.try_variant_get("payload", "$.weight_lb", "double"), 2).cast("string")
    listed = F.concat_ws(";", *(F.concat(F.lit(f"{f}="), shown[f]) for f in sorted(values)))
    return merged.join(gone, ["kind", "person_id"], "left").select("kind", "person_id", listed.alias("fields"), "fact_id", F.col("observed_at").cast("timestamp_ntz").alias("observed_at"), F.coalesce("detached", F.lit(0)).alias("detached"))
