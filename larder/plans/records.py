"""Merges, nutrition, texts, chunks and vectors over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import nutrition, text
from larder.operators import chunking, merge, retrieval
from larder.plans.registry import query
from larder.sources.tables import read

#: Orders before this day are the table; later ones come in.
CUT = "1996-06-01"


def split_orders(spark, sf):
    orders = read(spark, sf, "orders").select(
        F.col("o_custkey").alias("person_id"), F.col("o_orderpriority").alias("kind"), F.col("o_orderdate").alias("observed_at"), F.col("o_totalprice").alias("value"),
        F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")).alias("note"), F.col("o_orderkey").alias("seq"),
    )
    return orders.filter(F.col("observed_at") < CUT), orders.filter(F.col("observed_at") >= CUT)


SPLIT = f"""o AS (SELECT o_custkey AS person_id, o_orderpriority AS kind, o_orderdate AS observed_at, o_totalprice AS value, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS note, o_orderkey AS seq, (o_orderdate >= TIMESTAMP '{CUT}')::INT AS new FROM orders)"""
KEPT = """k AS (SELECT * FROM (SELECT *, max(observed_at) OVER (PARTITION BY person_id, kind ORDER BY new, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM o) WHERE newest IS NULL OR observed_at >= newest)"""


@query("q_upsert_newest", f"WITH {SPLIT}, {KEPT} SELECT person_id, kind, arg_max(value, (new, seq)) AS value, arg_max(note, (new, seq)) FILTER (WHERE note IS NOT NULL) AS note, max(observed_at) AS observed_at FROM k GROUP BY 1, 2".replace("arg_max(value, (new, seq))", "arg_max(value, new * 1000000000000 + seq)").replace("arg_max(note, (new, seq))", "arg_max(note, new * 1000000000000 + seq)"))
def upsert_newest(spark, sf):
    table, new = split_orders(spark, sf)
    return merge.upsert(table, new, ["person_id", "kind"], "observed_at", "seq", ["value"], ["note"]).select("person_id", "kind", "value", "note", F.col("observed_at").cast("timestamp_ntz").alias("observed_at"))


@query("q_upsert_last_loaded", f"WITH {SPLIT} SELECT person_id, kind, arg_max(value, new * 1000000000000 + seq) AS value, arg_max(note, new * 1000000000000 + seq) FILTER (WHERE note IS NOT NULL) AS note FROM o GROUP BY 1, 2")
def upsert_last_loaded(spark, sf):
    table, new = split_orders(spark, sf)
    return merge.upsert(table, new, ["person_id", "kind"], None, "seq", ["value"], ["note"]).select("person_id", "kind", "value", "note")


@query("q_upsert_replace", f"WITH {SPLIT}, {KEPT} SELECT person_id, kind, arg_max(value, new * 1000000000000 + seq) AS value, arg_max(coalesce(note, '-'), new * 1000000000000 + seq) AS note FROM k GROUP BY 1, 2")
def upsert_replace(spark, sf):
    table, new = split_orders(spark, sf)
    out = merge.upsert(table, new, ["person_id", "kind"], "observed_at", "seq", ["value", "note"], [])
    return out.select("person_id", "kind", "value", F.coalesce("note", F.lit("-")).alias("note"))


@query("q_upsert_fillnull", "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), p.priority) AS segment FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderpriority) AS priority FROM orders GROUP BY 1) p ON o_custkey = c_custkey")
def upsert_fillnull(spark, sf):
    known = read(spark, sf, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"))
    new = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderpriority").alias("segment"))
    return merge.fill_missing(known, new, ["c_custkey"], ["segment"])


@query(
    "q_text_union",
    """SELECT a.doc_id, CASE WHEN b.t IS NULL THEN a.t WHEN contains(lower(a.t), lower(b.t)) THEN a.t WHEN contains(lower(b.t), lower(a.t)) THEN b.t ELSE a.t || chr(10) || b.t END AS text
       FROM (SELECT doc_id, trim(text, ' ') AS t FROM documents) a LEFT JOIN (SELECT doc_id - 1 AS doc_id, trim(text, ' ') AS t FROM documents) b ON a.doc_id = b.doc_id""",
)
def text_union(spark, sf):
    docs = read(spark, sf, "documents")
    a = docs.select("doc_id", F.trim("text").alias("a"))
    b = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.trim("text").alias("b"))
    return a.join(b, "doc_id", "left").select("doc_id", text.text_union(F.col("a"), F.col("b")).alias("text"))


@query(
    "q_snapshot_reconcile",
    f"""WITH t AS (SELECT o_custkey AS p, o_custkey % 5 AS f, o_orderpriority AS i, CASE WHEN max(o_orderkey) % 2 = 0 THEN 'active' ELSE 'inactive' END AS status, max(o_orderdate) AS tm, max(o_totalprice) AS value FROM orders WHERE o_orderdate < TIMESTAMP '{CUT}' GROUP BY ALL),
       s AS (SELECT o_custkey AS p, o_custkey % 5 AS f, o_orderpriority AS i, 'active' AS status, CASE WHEN o_custkey % 4 = 0 THEN TIMESTAMP '1990-01-01' ELSE TIMESTAMP '1999-01-01' END AS tm, max(o_totalprice) AS value FROM orders WHERE o_orderdate >= TIMESTAMP '{CUT}' GROUP BY ALL),
       known AS (SELECT p, f, max(tm) AS old FROM t GROUP BY ALL),
       good AS (SELECT s.p, s.f, max(s.tm) AS tm FROM s LEFT JOIN known k ON k.p = s.p AND k.f = s.f GROUP BY s.p, s.f HAVING max(s.tm) > coalesce(max(k.old), TIMESTAMP '1900-01-01')),
       fresh AS (SELECT s.* FROM s JOIN good USING (p, f))
       SELECT t.p AS person_id, t.i AS kind, CASE WHEN fresh.p IS NOT NULL THEN 'active' WHEN good.p IS NOT NULL AND t.status = 'active' THEN 'inactive' ELSE t.status END AS status,
         CASE WHEN fresh.p IS NOT NULL THEN fresh.tm WHEN good.p IS NOT NULL AND t.status = 'active' THEN good.tm ELSE t.tm END AS observed_at, coalesce(fresh.value, t.value) AS value
       FROM t LEFT JOIN fresh ON fresh.p = t.p AND fresh.i = t.i LEFT JOIN good ON good.p = t.p AND good.f = t.f
       UNION ALL SELECT p, i, 'active', tm, value FROM fresh WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.p = fresh.p AND t.i = fresh.i)""",
)
def snapshot_reconcile(spark, sf):
    orders = read(spark, sf, "orders").withColumn("facility_id", F.col("o_custkey") % 5)
    keys = [F.col("o_custkey").alias("person_id"), "facility_id", F.col("o_orderpriority").alias("kind")]
    table = orders.filter(F.col("o_orderdate") < CUT).groupBy(*keys).agg(
        F.when(F.max("o_orderkey") % 2 == 0, "active").otherwise("inactive").alias("status"), F.max("o_orderdate").alias("observed_at"), F.lit(None).cast("timestamp").alias("discontinued_at"), F.max("o_totalprice").alias("value")
    )
    at = F.when(F.col("o_custkey") % 4 == 0, F.lit("1990-01-01").cast("timestamp")).otherwise(F.lit("1999-01-01").cast("timestamp"))
    snapshot = orders.filter(F.col("o_orderdate") >= CUT).groupBy(*keys).agg(F.lit("active").alias("status"), F.max(at).alias("observed_at"), F.max("o_totalprice").alias("value"))
    out = merge.reconcile_snapshot(table, snapshot, "person_id", ["person_id", "facility_id"], ["kind"], ["value"])
    return out.select("person_id", "kind", "status", F.col("observed_at").cast("timestamp_ntz").alias("observed_at"), "value")


@query("q_dedupe_then_anti", "SELECT doc_id FROM (SELECT *, md5(text) AS h FROM documents WHERE doc_id % 2 = 1) n WHERE NOT EXISTS (SELECT 1 FROM documents t WHERE t.doc_id % 2 = 0 AND t.source = n.source AND md5(t.text) = n.h) AND n.doc_id IN (SELECT min(doc_id) FROM documents WHERE doc_id % 2 = 1 GROUP BY md5(text))")
def dedupe_then_anti(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "source", F.md5("text").alias("h"))
    return merge.dedupe_then_insert(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1"), ["h"], ["source", "h"], [F.col("doc_id")]).select("doc_id")


@query("q_replace_children", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 7 <> 0 UNION ALL SELECT l_orderkey, l_linenumber + 100, l_quantity FROM lineitem WHERE l_orderkey % 7 = 0 AND l_returnflag = 'R' UNION ALL SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem l WHERE l_orderkey % 7 = 0 AND NOT EXISTS (SELECT 1 FROM lineitem n WHERE n.l_orderkey = l.l_orderkey AND n.l_returnflag = 'R')")
def replace_children(spark, sf):
    rows = read(spark, sf, "lineitem")
    new = rows.filter("l_orderkey % 7 = 0 AND l_returnflag = 'R'").select("l_orderkey", (F.col("l_linenumber") + 100).alias("l_linenumber"), "l_quantity")
    return merge.replace_children(rows.select("l_orderkey", "l_linenumber", "l_quantity"), new, ["l_orderkey"])


@query("q_insert_absent", "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT o_custkey, min(o_orderstatus) FROM orders WHERE NOT (o_custkey % 2 = 0 AND o_custkey IN (SELECT c_custkey FROM customer)) GROUP BY 1")
def insert_absent(spark, sf):
    table = read(spark, sf, "customer").filter("c_custkey % 2 = 0").select("c_custkey", "c_name")
    new = read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("c_name"))
    return merge.insert_absent(table, new, ["c_custkey"], [F.col("c_name")])


@query(
    "q_lifecycle_patch",
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'finalized' WHEN 1 THEN 'draft' ELSE s END AS status, CASE WHEN o_orderkey % 5 = 0 THEN coalesce(f, TIMESTAMP '2000-01-01') WHEN o_orderkey % 5 = 1 THEN NULL WHEN s = 'draft' THEN NULL ELSE f END AS finalized_at,
       CASE WHEN o_orderkey % 5 = 0 THEN s <> 'finalized' WHEN o_orderkey % 5 = 2 THEN s = 'finalized' AND o_orderpriority <> 'new' ELSE FALSE END AS needs_embedding
       FROM (SELECT *, CASE WHEN o_orderstatus = 'F' THEN 'finalized' ELSE 'draft' END AS s, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS f FROM orders)""",
)
def lifecycle_patch(spark, sf):
    orders = read(spark, sf, "orders")
    final = F.col("o_orderstatus") == "F"
    table = orders.select("o_orderkey", F.when(final, "finalized").otherwise("draft").alias("status"), F.when(final, F.col("o_orderdate")).alias("finalized_at"), F.col("o_orderpriority").alias("content"))
    k = F.col("o_orderkey") % 5
    changes = orders.filter(k <= 3).select("o_orderkey", F.when(k == 0, "finalized").when(k == 1, "draft").alias("status"), F.when(k == 2, "new").when(k == 3, " ").alias("content"), F.lit("2000-01-01").cast("timestamp").alias("at"))
    return merge.lifecycle(table, changes, "o_orderkey").select("o_orderkey", "status", F.col("finalized_at").cast("timestamp_ntz").alias("finalized_at"), "needs_embedding")


def _even(x: str, places: int) -> str:
    """Half to even by a number's decimals, as Spark's bround does it; DuckDB's own rounding of doubles multiplies first and so makes ties of 58.254999999999995."""
    return f"round_even(({x})::VARCHAR::DECIMAL(38, 18), {places})::DOUBLE"


PEOPLE = f"""people AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'f' ELSE 'm' END AS sex, 58 + c_custkey % 20 AS height, 20 + c_custkey * 37 % 70 AS age, w.lb AS lb, CASE c_custkey % 3 WHEN 0 THEN 'lose' WHEN 1 THEN 'maintain' ELSE 'gain' END AS goal, c_custkey % 4 = 0 AS dialysis
  FROM customer JOIN (SELECT o_custkey, 80 + arg_max(o_totalprice, o_orderkey) / 1500 AS lb FROM orders GROUP BY 1) w ON o_custkey = c_custkey),
  b AS (SELECT *, {_even(f"{_even('lb / 2.2', 2)} / ({_even('height * 0.0254', 2)} * {_even('height * 0.0254', 2)})", 2)} AS bmi FROM people),
  c AS (SELECT *, CASE WHEN age >= 65 THEN CASE WHEN bmi < 22 THEN 'UNDERWEIGHT' WHEN bmi < 28 THEN 'NORMAL' WHEN bmi < 30 THEN 'OVERWEIGHT' WHEN bmi < 40 THEN 'OBESE' ELSE 'MORBIDLY_OBESE' END
    ELSE CASE WHEN bmi < 18.5 THEN 'UNDERWEIGHT' WHEN bmi < 25 THEN 'NORMAL' WHEN bmi < 30 THEN 'OVERWEIGHT' WHEN bmi < 40 THEN 'OBESE' ELSE 'MORBIDLY_OBESE' END END AS category,
    CASE WHEN sex = 'f' THEN 100 + 5 * (height - 60) ELSE 106 + 6 * (height - 60) END::DOUBLE AS ibw FROM b),
  n AS (SELECT *, ibw + 0.25 * (lb - ibw) AS aibw, {_even("CASE WHEN category IN ('UNDERWEIGHT', 'NORMAL') THEN lb WHEN category = 'OVERWEIGHT' THEN ibw ELSE ibw + 0.25 * (lb - ibw) END / 2.2", 2)} AS kg FROM c)"""


def people(spark, sf):
    last = read(spark, sf, "orders").groupBy("o_custkey").agg((80 + F.max_by("o_totalprice", "o_orderkey") / 1500).alias("lb"))
    key = F.col("c_custkey")
    return read(spark, sf, "customer").join(last, key == F.col("o_custkey")).select(
        "c_custkey", F.when(key % 2 == 0, "f").otherwise("m").alias("sex"), (58 + key % 20).alias("height"), (20 + key * 37 % 70).alias("age"), "lb",
        F.when(key % 3 == 0, "lose").when(key % 3 == 1, "maintain").otherwise("gain").alias("goal"), (key % 4 == 0).alias("dialysis"),
    )


@query("q_bmi_profile", f"WITH {PEOPLE} SELECT c_custkey, round(bmi, 1) AS bmi, category AS bmi_category, ibw AS ideal_weight_lb, round(aibw, 4) AS adjusted_weight_lb, kg AS calculation_weight_kg FROM n")
def bmi_profile(spark, sf):
    p = nutrition.needs_profile("lb", "height", "sex", "age", F.col("goal"), "dialysis")
    return people(spark, sf).select("c_custkey", F.round(p["bmi"], 1).alias("bmi"), p["bmi_category"].alias("bmi_category"), p["ideal_weight_lb"].cast("double").alias("ideal_weight_lb"), F.round(p["adjusted_weight_lb"], 4).alias("adjusted_weight_lb"), p["calculation_weight_kg"].alias("calculation_weight_kg"))


@query(
    "q_needs",
    f"""WITH {PEOPLE}, f AS (SELECT *, CASE goal WHEN 'lose' THEN 20 WHEN 'gain' THEN 30 ELSE 25 END AS k, CASE WHEN dialysis THEN 1.2 ELSE 1.0 END::DOUBLE AS p1, CASE WHEN dialysis THEN 1.5 ELSE 1.2 END::DOUBLE AS p2 FROM n)
       SELECT c_custkey, trunc(kg * k)::DOUBLE AS kcal_low, trunc(kg * (k + 5))::DOUBLE AS kcal_high, trunc(kg * p1)::DOUBLE AS protein_low, trunc(kg * p2)::DOUBLE AS protein_high FROM f""",
)
def needs(spark, sf):
    p = nutrition.needs_profile("lb", "height", "sex", "age", F.col("goal"), "dialysis")
    kcal, protein = p["calories_kcal_day"], p["protein_g_day"]
    return people(spark, sf).select("c_custkey", kcal["low"].alias("kcal_low"), kcal["high"].alias("kcal_high"), protein["low"].alias("protein_low"), protein["high"].alias("protein_high"))


@query("q_mifflin", f"WITH {PEOPLE} SELECT c_custkey, {_even(_even(f"1.2 * (10 * {_even('lb / 2.2', 2)} + 6.25 * {_even('height * 2.54', 2)} - 5 * age + CASE WHEN sex = 'm' THEN 5 ELSE -161 END)", 2), 0)}::BIGINT AS kcal FROM people")
def mifflin(spark, sf):
    """Two decimals first, as the operator gives them, then whole kilocalories."""
    return people(spark, sf).select("c_custkey", F.bround(nutrition.mifflin("lb", "height", "sex", "age")).cast("long").alias("kcal"))


FORMULAS = """f AS (SELECT p_partkey, 100 + p_size AS kcal, p_size / 2.0 AS protein, 50 + p_size AS water, 100 + p_size * 2 AS serving FROM part),
  t AS (SELECT *, (round_even(floor((1500 + p_partkey % 10 * 100 + 1800) / 2) / (kcal::DOUBLE / serving) / 100, 0) * 100)::BIGINT AS volume FROM f),
  u AS (SELECT *, round_even(kcal * (volume::DOUBLE / serving), 0)::BIGINT AS kcal_day, round_even(protein * (volume::DOUBLE / serving), 1) AS protein_day, round_even(water * (volume::DOUBLE / serving), 1) AS water_day FROM t),
  v AS (SELECT *, (round_even(greatest(kcal_day - water_day, 0) / 100, 0) * 100)::BIGINT AS flush FROM u)"""


def feeds(spark, sf):
    part = read(spark, sf, "part").select("p_partkey", (100 + F.col("p_size")).alias("kcal"), (F.col("p_size") / 2.0).alias("protein"), (50 + F.col("p_size")).alias("water"), (100 + F.col("p_size") * 2).alias("serving"))
    return part.withColumns(nutrition.feed_totals(1500 + F.col("p_partkey") % 10 * 100, 1800, "kcal", "protein", "water", "serving"))


@query("q_tubefeed_cont", f"WITH {FORMULAS} SELECT p_partkey, volume AS total_volume_ml, kcal_day AS kcal_per_day, protein_day AS protein_per_day_g, (5 * round_even(volume / 20.0 / 5, 0))::BIGINT AS rate_ml_per_hr, CASE WHEN flush > 0 THEN (5 * ceil(flush / 20.0 / 5))::BIGINT END AS flush_rate_ml_per_hr FROM v")
def tubefeed_cont(spark, sf):
    out = feeds(spark, sf).withColumns(nutrition.continuous_feed("total_volume_ml", "flush_volume_ml", F.lit(20)))
    return out.select("p_partkey", "total_volume_ml", "kcal_per_day", "protein_per_day_g", "rate_ml_per_hr", "flush_rate_ml_per_hr")


@query("q_tubefeed_bolus", f"WITH {FORMULAS} SELECT p_partkey, round_even(volume / 5.0, 0)::BIGINT AS volume_per_bolus_ml, CASE WHEN flush > 0 THEN (5 * ceil(flush / 10.0 / 5))::BIGINT END AS flush_per_side_ml FROM v")
def tubefeed_bolus(spark, sf):
    return feeds(spark, sf).withColumns(nutrition.bolus_feed("total_volume_ml", "flush_volume_ml", F.lit(5))).select("p_partkey", "volume_per_bolus_ml", "flush_per_side_ml")


@query(
    "q_tubefeed_documented",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 AND l_quantity > 40 THEN 'bolus needs volume and feeds a day' WHEN l_linenumber % 2 = 1 AND l_quantity > 45 THEN 'continuous feeding needs rate and hours a day' WHEN l_linenumber % 2 = 1 AND l_linenumber = 3 THEN 'flush volume without frequency' ELSE 'computed' END AS status,
       CASE WHEN l_linenumber % 2 = 0 AND l_quantity <= 40 THEN l_quantity * 5.0 WHEN l_linenumber % 2 = 1 AND l_quantity <= 45 AND l_linenumber <> 3 THEN l_quantity * 20.0 END AS volume_ml FROM lineitem""",
)
def tubefeed_documented(spark, sf):
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    got = nutrition.documented_feed(F.when(n % 2 == 0, "bolus").otherwise("continuous"), F.when(q <= 45, q), F.lit(20.0), F.when(q <= 40, q), F.lit(5), F.lit(30.0), F.when(n != 3, 6.0))
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", got["status"].alias("status"), got["volume_ml"].alias("volume_ml"))


@query(
    "q_pn",
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity * 50 AS v, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE 12.0 END AS h, CASE WHEN l_linenumber % 3 = 0 THEN l_quantity * 5 END AS r, 150.0 + l_linenumber AS dex, 50.0 AS aa, CASE WHEN l_returnflag = 'R' THEN 'piggyback' WHEN l_returnflag = 'A' THEN 'none' END AS d, CASE WHEN l_linenumber = 2 THEN 15.0 ELSE 20.0 END AS c FROM lineitem),
       y AS (SELECT *, coalesce(h, v / r) AS hours, dex * (v / 1000) AS dg, aa * (v / 1000) AS ag, CASE WHEN d = 'none' THEN 0.0 WHEN c = 20 THEN 250 * 2.0 END AS lk FROM x)
       SELECT l_orderkey, l_linenumber, round_even(hours, 2) AS hours_per_day, round_even(dg, 2) AS dextrose_g_day, round_even(dg * 3.4 + ag * 4.0 + lk, 2) AS total_kcal_day, CASE WHEN d = 'piggyback' THEN v + 250 WHEN d = 'none' THEN v END AS total_fluid_ml_day, round(round_even(dg * 1000 / (60 * hours * 60), 2), 0) AS gir FROM y""",
)
def pn(spark, sf):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    got = nutrition.parenteral_nutrition(
        q * 50, F.when(n % 3 == 0, q * 5), F.when(n % 3 != 0, 12.0), 150.0 + n, F.lit(50.0), F.when(F.col("l_returnflag") == "R", "piggyback").when(F.col("l_returnflag") == "A", "none"), F.when(n == 2, 15.0).otherwise(20.0), F.lit(250.0), F.lit(60.0)
    )
    return read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", got["hours_per_day"].alias("hours_per_day"), got["dextrose_g_day"].alias("dextrose_g_day"), got["total_kcal_day"].alias("total_kcal_day"), got["total_fluid_ml_day"].alias("total_fluid_ml_day"), F.round(got["gir_mg_kg_min"], 0).alias("gir")
    )


@query("q_normalize_text", r"SELECT doc_id, replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')), 'ß', 'ss') AS folded FROM documents")
def normalize_text(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.fold(F.col("text")).alias("folded"))


@query("q_name_parse", "SELECT p_partkey, split_part(p_name, ' ', 1) AS first_name, CASE WHEN contains(p_name, ' ') THEN list_extract(string_split(p_name, ' '), -1) ELSE '' END AS last_name, split_part(p_name, ' ', 2) AS comma_first FROM part")
def name_parse(spark, sf):
    name = F.col("p_name")
    swapped = F.concat(F.get(F.split(name, " "), 0), F.lit(",  "), F.coalesce(F.get(F.split(name, " "), 1), F.lit("")))
    return read(spark, sf, "part").select("p_partkey", text.first_name(name).alias("first_name"), text.last_name(name).alias("last_name"), text.first_name(swapped).alias("comma_first"))


#: How diets are written: every alias of the table, in other cases and with other marks, and words that are none.
_PHRASES = [p for k in text.DIET_ALIASES for p in (k, k.upper().replace(" ", "_"), f"  {k.title()} ")] + ["Soft / Bland", "new-diet"]
_PHRASE_SQL = "[" + ", ".join(f"'{p}'" for p in _PHRASES) + f"][c_custkey % {len(_PHRASES)} + 1]"
_ALIAS_SQL = "CASE p " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.DIET_ALIASES.items()) + " ELSE replace(p, ' ', '_') END"


@query("q_alias_map", f"SELECT c_custkey, {_ALIAS_SQL} AS diet FROM (SELECT c_custkey, trim(regexp_replace(regexp_replace(lower({_PHRASE_SQL}), '[-_/]+', ' ', 'g'), '\\s+', ' ', 'g')) AS p FROM customer)")
def alias_map(spark, sf):
    phrase = F.get(F.array(*(F.lit(p) for p in _PHRASES)), (F.col("c_custkey") % len(_PHRASES)).cast("int"))
    return read(spark, sf, "customer").select("c_custkey", text.alias_or_slug(phrase, text.DIET_ALIASES).alias("diet"))


@query("q_hash_identity", r"SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')) AS content_hash, sha256(text) AS file_hash FROM documents")
def hash_identity(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"), F.sha2("text", 256).alias("file_hash"))


@query("q_first_match_pos", "SELECT doc_id, CASE WHEN p.a = 0 AND p.b = 0 THEN NULL WHEN p.b = 0 OR (p.a > 0 AND p.a <= p.b) THEN 'license' ELSE 'token' END AS term FROM (SELECT doc_id, {'a': strpos(lower(text), 'license'), 'b': strpos(lower(text), 'token')} AS p FROM documents)")
def first_match_pos(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.first_of(F.col("text"), ["license", "token"]).alias("term"))


@query("q_token_counts", "SELECT doc_id, ceil(strlen(text) / 3.0)::BIGINT AS tokens, ceil(strlen(substr(text, 1, 300)) / 3.0)::BIGINT AS kept, round_even((ceil(strlen(text) / 3.0) - ceil(strlen(substr(text, 1, 300)) / 3.0)) / ceil(strlen(text) / 3.0) * 100, 1) AS reduction FROM documents")
def token_counts(spark, sf):
    whole, kept = text.tokens_estimate(F.col("text")), text.tokens_estimate(F.substring("text", 1, 300))
    return read(spark, sf, "documents").select("doc_id", whole.alias("tokens"), kept.alias("kept"), F.bround((whole - kept) / whole * 100, 1).alias("reduction"))


@query(
    "q_chunks",
    """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS t FROM documents), s AS (SELECT doc_id, t, len(t) AS n, unnest(range(0, greatest(len(t), 1), 500)) AS pos FROM w WHERE len(t) > 0)
       SELECT doc_id, CAST(floor(pos / 500) AS INT) AS chunk_index, len(t[pos + 1:pos + 600])::INT AS n_tokens, md5(array_to_string(t[pos + 1:pos + 600], ' ')) AS body FROM s WHERE NOT (pos > 0 AND pos = n - 100)""",
)
def chunks(spark, sf):
    out = chunking.chunks(read(spark, sf, "documents"), ["doc_id"], chunking.word_tokens(F.col("text")), 600, 100)
    return out.select("doc_id", "chunk_index", "n_tokens", F.md5("content").alias("body"))


@query("q_note_routing", "SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 'always' WHEN contains(lower(text), 'token') THEN 'matched' WHEN length(text) > 2000 THEN 'send' ELSE 'skip' END AS route FROM documents")
def note_routing(spark, sf):
    from larder.operators.extraction import route

    body = F.lower("text")
    return read(spark, sf, "documents").select("doc_id", route([("always", body.contains("license")), ("matched", body.contains("token")), ("send", F.length("text") > 2000)], "skip").alias("route"))


def first_vector(spark, sf):
    return list(read(spark, sf, "embeddings").filter("vec_id = 0").select("embedding").first()[0])


COSINE = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@query("q_vector_topk", f"SELECT e.vec_id, round({COSINE}, 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {COSINE} DESC, e.vec_id LIMIT 10")
def vector_topk(spark, sf):
    return retrieval.top_k(read(spark, sf, "embeddings"), "embedding", first_vector(spark, sf), 10, ["vec_id"]).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("q_vector_topk_filtered", f"SELECT e.vec_id, round({COSINE}, 6) AS similarity FROM embeddings e JOIN labels ON vec_id = doc_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE quality = 1 AND label % 2 = 0 ORDER BY {COSINE} DESC, e.vec_id LIMIT 5")
def vector_topk_filtered(spark, sf):
    good = read(spark, sf, "labels").filter("quality = 1")
    rows = read(spark, sf, "embeddings").join(good, F.col("vec_id") == F.col("doc_id"))
    return retrieval.top_k(rows, "embedding", first_vector(spark, sf), 5, ["vec_id"], F.col("label") % 2 == 0).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query(
    "q_vector_batch_topk",
    f"""SELECT q.vec_id AS query_id, e.vec_id, round({COSINE}, 6) AS similarity FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q
       QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round({COSINE}, 12) DESC, e.vec_id) <= 5""",
)
def vector_batch_topk(spark, sf):
    vectors = read(spark, sf, "embeddings")
    out = retrieval.batch_top_k(vectors.filter("vec_id % 100 = 0"), vectors, "vec_id", "embedding", "vec_id", "embedding", 5)
    return out.select(F.col("q").alias("query_id"), F.col("id").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


@query(
    "q_chunk_totals",
    """WITH w AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM documents), s AS (SELECT doc_id, n, unnest(range(0, n, 575)) AS pos FROM w)
       SELECT doc_id, count(*) AS n_chunks, sum(least(600, n - pos))::BIGINT AS n_tokens FROM s WHERE NOT (pos > 0 AND pos = n - 25) GROUP BY doc_id""",
)
def chunk_totals(spark, sf):
    parts = chunking.chunks(read(spark, sf, "documents"), ["doc_id"], chunking.word_tokens(F.col("text")), 600, 25)
    return chunking.chunk_totals(parts, ["doc_id"])


@query(
    "q_weight_series",
    """SELECT user_id, CASE WHEN n = 0 THEN 'no_dated_weight' WHEN bad > 0 THEN 'not_positive' ELSE 'ok' END AS status, n AS n_dated FROM (SELECT user_id, count(*) FILTER (WHERE event_id % 3 > 0) AS n,
       count(*) FILTER (WHERE event_id % 3 > 0 AND coalesce(CASE WHEN event_id % 7 > 0 THEN value - 5 END, 0) <= 0) AS bad FROM events WHERE event_id % 50 <> user_id % 50 GROUP BY 1)""",
)
def weight_series(spark, sf):
    from larder.operators import temporal

    key = F.col("event_id")
    rows = read(spark, sf, "events").filter(key % 50 != F.col("user_id") % 50).select("user_id", F.when(key % 3 > 0, F.col("ts")).alias("at"), F.when(key % 7 > 0, F.col("value") - 5).alias("lb"))
    return temporal.weight_series_status(rows, ["user_id"], "at", "lb")


@query(
    "q_sync_assessments",
    """SELECT o_custkey AS person_id, 'Note ' || o_orderkey AS content, sha256('Note ' || o_orderkey) AS content_hash, 'finalized' AS status, o_orderdate AS finalized_at, o_orderkey AS source_progress_note_id FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderkey % 3 > 0 AND o_orderkey % 5 > 0""",
)
def sync_assessments(spark, sf):
    key = F.col("o_orderkey")
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "Dietitian  note").when(F.col("o_orderpriority") == "2-HIGH", "Nutrition/Dietary Note").otherwise("Nursing Note")
    notes = read(spark, sf, "orders").select(key.alias("id"), F.col("o_custkey").alias("person_id"), kind.alias("note_type"), F.when(key % 5 > 0, F.concat(F.lit(" Note  "), key.cast("string"))).otherwise(" ").alias("note_text"), F.col("o_orderdate").alias("note_date"), F.lit("a").alias("author"))
    stored = read(spark, sf, "orders").filter(key % 3 == 0).select(key.alias("source_progress_note_id"))
    out = merge.sync_assessments(notes, stored)
    return out.select("person_id", text.collapse(F.col("content")).alias("content"), "content_hash", "status", F.col("finalized_at").cast("timestamp_ntz").alias("finalized_at"), "source_progress_note_id")
