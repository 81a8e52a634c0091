"""Order reports written from the orders, every field of every kind of order, and sentences of feedings."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import sentences
from larder.operators import extraction, orders
from larder.plans.registry import query
from larder.sources.tables import read

#: (category, text of an order with its number as {n}, kind of fact, what each of its fields must be, in SQL with n)
TEMPLATES = [
    ("Pharmacy", "Drugaline {n} mg PO BID for pain give with food", "medication", {"name": "'Drugaline'", "dose": "n", "dose_text": "n::INT", "dose_unit": "'mg'", "route": "'PO'", "frequency": "'BID'", "indication": "'pain'"}),
    ("Pharmacy", "Insulin glargine 100 units SC QHS give = {n} units", "medication", {"name": "'Insulin glargine'", "dose": "n", "dose_text": "n::INT", "dose_unit": "'units'", "route": "'SQ'", "frequency": "'QHS'"}),
    ("Pharmacy", "Potassium {n} meq by mouth every 6 hours as needed", "medication", {"name": "'Potassium'", "dose": "n", "dose_text": "n::INT", "dose_unit": "'mEq'", "route": "'PO'", "frequency": "'Q6H PRN'"}),
    ("Enteral Feed", "Glucerna 1.5 @ {n} mL/hr via PEG x16 hr with 250 mL FWF q6h", "enteral_feeding", {"formula": "'Glucerna 1.5'", "route": "'PEG'", "feeding_method": "'continuous'", "rate_ml_hr": "n", "hours_per_day": "16.0", "flush_ml": "250.0", "flush_frequency_hours": "6.0", "flush_instructions": "'250 mL FWF q6h'", "caloric_density_kcal_ml": "1.5"}),
    ("Enteral - Feed", "Enteral Feed Order: Nepro 1.8 @ {n} ml/hr via G tube up at 4:00 pm and down until TV of 1100 ml infused providing kcal", "enteral_feeding", {"formula": "'Nepro 1.8'", "route": "'G-TUBE'", "feeding_method": "'cyclic'", "rate_ml_hr": "n", "hours_per_day": "CASE WHEN 1100 / n <= 24 THEN round_even(1100 / n, 2) END", "feeding_schedule": "'up at 4:00 pm and down until TV of 1100 ml infused'", "caloric_density_kcal_ml": "1.8"}),
    ("Enteral Feed", "Jevity 1.2 at {n} ml bolus 4 times daily via GT", "enteral_feeding", {"formula": "'Jevity 1.2'", "route": "'G-TUBE'", "feeding_method": "'bolus'", "bolus_volume_ml": "n", "boluses_per_day": "4", "caloric_density_kcal_ml": "1.2"}),
    ("Dietary - Diet", "CCD / Ground / Thin, 2 gm Na, ref {n}", "diet", {"diet_type": "'ccd'", "texture": "'ground'", "liquid_consistency": "'thin'", "restrictions": "'2_g_sodium'"}),
    ("Dietary - Diet", "NPO ref {n}", "diet", {"diet_type": "'npo'", "restrictions": "'nothing_by_mouth'"}),
    ("Dietary - Supplements", "Ensure Plus {n} fl oz PO with meals", "supplement", {"product_name": "'Ensure Plus'", "amount": "n", "unit": "'oz'", "frequency": "'WITH MEALS'", "route": "'PO'"}),
    ("Dietary - Supplements", "House shake {n} ml BID", "supplement", {"product_name": "'House shake'", "amount": "n", "unit": "'mL'", "frequency": "'BID'"}),
    ("Other", "Fluid restriction {n} mL per day", "fluid_plan", {"restriction_ml_day": "n"}),
    ("Other", "Encourage oral fluids {n} liters", "fluid_plan", {"target_ml_day": "n * 1000"}),
    ("Other", "PPN @ {n} mL/hr via peripheral line over 12 hr dextrose {n} g/L amino acids 42 g/L lipid 20 % 250 mL piggyback", "parenteral_nutrition", {"access_route": "'peripheral'", "access_description": "'peripheral line'", "rate_ml_hr": "n", "hours_per_day": "12.0", "dextrose_g_per_l": "n", "amino_acid_g_per_l": "42.0", "lipid_delivery": "'piggyback'", "lipid_concentration_percent": "20.0", "lipid_total_volume_ml": "250.0"}),
    ("Other", "TPN total volume {n} mL concentrated 3-in-1 protein {n} g 1800 kcal lipid 10 % at 21 mL/hr over 10 hr", "parenteral_nutrition", {"access_route": "'central'", "formula_type": "'concentrated'", "total_volume_ml": "n", "documented_protein_g": "n", "documented_calories_kcal": "1800.0", "lipid_delivery": "'included'", "lipid_concentration_percent": "10.0", "lipid_total_volume_ml": "21.0", "lipid_rate_ml_hr": "21.0", "lipid_run_time_hours": "10.0", "hours_per_day": "10.0", "rate_ml_hr": "21.0"}),
    ("Enteral Feed", "Elevate head of bed {n}", "misc_order", {}),
    ("Laboratory", "CBC panel {n}", "misc_order", {}),
]
_N = len(TEMPLATES)


def _template(at, part):
    return F.get(F.array(*(F.lit(t[part]) for t in TEMPLATES)), at.cast("int"))


def _summary(at, n):
    return F.replace(_template(at, 1), F.lit("{n}"), n.cast("string"))


def _fields_sql() -> str:
    shown = lambda fields: "concat_ws(';', " + ", ".join(f"'{k}=' || ({v})::VARCHAR" for k, v in sorted(fields.items())) + ")" if fields else "''"
    kind = "CASE k " + " ".join(f"WHEN {i} THEN '{t[2]}'" for i, t in enumerate(TEMPLATES)) + " END"
    return f"SELECT p_partkey, {kind} AS fact_type, CASE k {' '.join(f'WHEN {i} THEN {shown(t[3])}' for i, t in enumerate(TEMPLATES))} END AS fields FROM (SELECT p_partkey, p_partkey % {_N} AS k, (p_size + 10)::DOUBLE AS n FROM part)"


@query("q_order_fields", _fields_sql())
def order_fields(spark, sf):
    """All fields of medications, feedings, parenteral nutrition, diets, supplements and fluid plans."""
    at = F.col("p_partkey") % _N
    rows = read(spark, sf, "part").select("p_partkey", _template(at, 0).alias("category"), _summary(at, F.col("p_size") + 10).alias("summary"))
    s = F.col("summary")
    parts = {"medication": extraction.medication(s), "enteral_feeding": extraction.enteral_feeding(s), "parenteral_nutrition": extraction.parenteral_order(s), "diet": extraction.diet(s), "supplement": extraction.supplement(s), "fluid_plan": extraction.fluid_plan(s)}
    fields = F.lit("")
    for kind, columns in parts.items():
        text = {k: F.nullif(F.array_join(c, "/"), F.lit("")) if k == "restrictions" else c.cast("string") for k, c in columns.items()}
        fields = F.when(F.col("fact_type") == kind, F.concat_ws(";", *(F.concat(F.lit(f"{k}="), text[k]) for k in sorted(text)))).otherwise(fields)
    # an order's first kind; a fluid plan besides is another fact of the same words
    return rows.withColumn("fact_type", extraction.order_type(s, F.col("category"))).select("p_partkey", "fact_type", fields.alias("fields"))


_HEADER = "Order Listing Report\nNorth House\nDate: {date}\nTime: 4:00 PM ET\nResident: Stone, Mia (X1) Order Status: {status}\nName\nReorder\n"


def order_pages(spark, sf):
    """Up to three pages for each customer; every fourth customer's have no persons, some orders stand twice."""
    key, person = F.col("o_orderkey"), F.col("o_custkey")
    at = key % _N
    head = F.when(person % 4 > 0, F.concat(F.lit("Stone, Mia (ID"), person.cast("string"), F.lit(")\n"))).otherwise(F.lit(""))
    block = F.concat(head, _summary(at, key), F.lit("\n"), _template(at, 0), F.lit("\nActive\n"), F.date_format("o_orderdate", "MM/dd/yyyy"), F.lit("\nN\n"))
    twice = F.when(key % 5 == 0, F.concat(block, block)).otherwise(block)
    pages = read(spark, sf, "orders").groupBy(person.alias("doc"), (key % 3 + 1).alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), twice.alias("b")))), lambda x: x["b"]), "").alias("body"))
    header = F.when(F.col("doc") % 5 > 0, _HEADER.format(date="Aug 27, 2026", status="Active")).when(F.col("doc") % 10 == 0, _HEADER.format(date="09/01/2026", status="All")).otherwise(_HEADER.format(date="soon", status="All"))
    return pages.select("doc", "page", F.concat(header, "body", F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit(" of 3"))).alias("text"))


def _reports_sql() -> str:
    of = lambda part: "CASE o_orderkey % " + str(_N) + " " + " ".join(f"WHEN {i} THEN '{t[part]}'" for i, t in enumerate(TEMPLATES)) + " END"
    return f"""SELECT o_custkey AS doc, o_orderkey % 3 + 1 AS page, CASE WHEN o_custkey % 4 > 0 THEN 'ID' || o_custkey END AS identifier, CASE WHEN o_custkey % 4 > 0 THEN 'Stone, Mia' END AS person_name, replace({of(1)}, '{{n}}', o_orderkey::VARCHAR) AS summary, {of(0)} AS category, 'active' AS status,
  o_orderdate::DATE AS revision_date, {of(2)} AS fact_type, 'North House' AS facility_name, CASE WHEN o_custkey % 5 > 0 THEN 'active_snapshot' ELSE 'incremental' END AS report_mode,
  CASE WHEN o_custkey % 5 > 0 THEN TIMESTAMP '2026-08-27 20:00:00' WHEN o_custkey % 10 = 0 THEN TIMESTAMP '2026-09-01 20:00:00' END AS report_at FROM orders"""


@query("q_order_reports", _reports_sql())
def order_reports(spark, sf):
    rows = orders.report_orders(order_pages(spark, sf), relaxed=True)
    return rows.select("doc", "page", "identifier", "person_name", "summary", "category", "status", "revision_date", "fact_type", "facility_name", "report_mode", F.col("report_at").cast("timestamp_ntz").alias("report_at"))


@query("q_weight_facts", "SELECT o_custkey, o_orderdate::DATE + INTERVAL '8 hours 30 minutes' AS measured_at, arg_min(o_orderkey % 200 + 90, (o_orderkey % 200 + 90)::VARCHAR)::DOUBLE AS weight_lb FROM orders GROUP BY 1, 2")
def weight_facts(spark, sf):
    """Weights of one person and time count once, the first row of the report."""
    from larder.plans.documents import weight_pages

    rows = extraction.weight_rows(weight_pages(spark, sf), ["o_custkey"]).withColumns({"page": F.lit(1), "person_id": F.lit(None).cast("long")})
    return orders.weight_facts(rows, "o_custkey", "page").select("o_custkey", F.col("measured_at").cast("timestamp_ntz").alias("measured_at"), "weight_lb")


def _sentences_sql() -> str:
    g = lambda x: f"regexp_replace(({x})::DECIMAL(18,1)::VARCHAR, '\\.0$', '')"
    return f"""WITH f AS (SELECT p_partkey, p_name AS formula, CASE WHEN p_partkey % 11 > 0 THEN 'peg' END AS route, p_size * 5 AS rate, p_size * 80 AS total, CASE WHEN p_partkey % 3 > 0 THEN p_size + 5 END AS flush, CASE WHEN p_partkey % 4 = 0 THEN 40 END AS starting, round(p_retailprice, 1) AS kcal, p_size + 0.5 AS protein, p_size * 100.0 AS fluids, p_partkey % 5 = 0 AS extra FROM part)
SELECT p_partkey, CASE WHEN route IS NULL THEN 'Incomplete continuous tube-feed results.' ELSE 'Rec ' || formula || ' @ ' || rate || ' ml/hr via PEG up at 6pm. ' || coalesce(CASE WHEN starting < rate THEN 'START AT ' || starting || ' ML/HR. INCREASE BY 10 ML EVERY HOUR UNTIL ' || rate || 'ML/HR. ' END, '')
    || 'AND every day shift document total volume infused in 24 hrs (' || total || ' ml).' || coalesce(' FWF @ ' || flush || ' ml/hr to provide TV ' || flush * 16 || ' mls.', '') END AS continuous,
  CASE WHEN route IS NULL THEN 'Incomplete bolus tube-feed results.' ELSE 'Enteral feeding ' || formula || ' ' || rate || ' ml via PEG 4 times daily. AND every day shift document total volume infused in 24 hrs (' || total || ' ml).' || coalesce(' FWF ' || flush || ' ml before and after each bolus to provide TV ' || flush * 8 || ' mls.', '') END AS bolus,
  concat_ws(' + ', 'TF', CASE WHEN flush IS NOT NULL THEN 'FWF' END, CASE WHEN extra THEN 'Protein supplement' END) || CASE WHEN flush IS NOT NULL OR extra THEN ' are' ELSE ' is' END || ' providing res with ' || {g("kcal")} || ' kcal, ' || {g("protein")} || ' g PRO and ' || {g("fluids")} || ' mls fluids.' AS summary FROM f"""


@query("q_feed_sentences", _sentences_sql())
def feed_sentences(spark, sf):
    key, size = F.col("p_partkey"), F.col("p_size")
    route, flush, starting = F.when(key % 11 > 0, "peg"), F.when(key % 3 > 0, size + 5), F.when(key % 4 == 0, F.lit(40))
    rate, total, none = size * 5, size * 80, F.lit(None).cast("int")
    return read(spark, sf, "part").select(
        "p_partkey", sentences.continuous_order(F.col("p_name"), rate, route, F.lit("6pm"), total, starting, F.when(starting.isNotNull(), 10).otherwise(none), flush, flush * 16).alias("continuous"),
        sentences.bolus_order(F.col("p_name"), rate, route, F.lit(4), total, flush, flush * 8).alias("bolus"),
        sentences.nutrition_summary(F.round("p_retailprice", 1), size + 0.5, size * 100.0, flush.isNotNull(), key % 5 == 0).alias("summary"),
    )
