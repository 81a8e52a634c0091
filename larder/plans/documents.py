"""Orders, reports, foods, identities and contexts. Report texts are made from the given tables, so parsing them must give the tables' values back."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder import fixed_values as fixed
from larder.operators import context, extraction, identity
from larder.operators.relational import required
from larder.plans.registry import query
from larder.sources import foods
from larder.sources.documents import document_text, lines_of, report_kind
from larder.sources.tables import read
from larder.streaming import incremental

#: (category, text before the size, text after it, kind of fact)
ORDERS = [
    ("Pharmacy", "Drugaline ", " mg PO BID for pain", "medication"),
    ("Enteral Feed", "Formula 1.5 @ ", " mL/hr x16 hr with 250 mL FWF q6h", "enteral_feeding"),
    ("Enteral - Feed", "Provide Free Water Flush @ ", " ml/hr for TV 700 mls", "fluid_plan"),
    ("Dietary - Diet", "CCD / Ground / Thin ", "", "diet"),
    ("Other", "Fluid restriction ", "00 mL per day", "fluid_plan"),
    ("Dietary - Diet", "Regular diet, fluid restriction ", "00 mL", "diet"),
    ("Other", "TPN over 12 hr dextrose ", " g/L", "parenteral_nutrition"),
    ("Other", "Cardiac rehab evaluation ", "", "misc_order"),
    ("Dietary - Supplements", "Magic cup ", " oz PO with meals", "supplement"),
    ("Enteral Feed", "Elevate head of bed ", "", "misc_order"),
]


def orders(spark, sf):
    k = F.col("p_partkey") % len(ORDERS)
    pick = lambda i: F.element_at(F.array(*(F.lit(o[i]) for o in ORDERS)), (k + 1).cast("int"))
    return read(spark, sf, "part").select("p_partkey", "p_size", pick(0).alias("category"), F.concat(pick(1), (F.col("p_size") + 10).cast("string"), pick(2)).alias("summary"))


KIND = "CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN '{o[3]}'" for i, o in enumerate(ORDERS)) + " END"


@query("q_order_classify", f"SELECT p_partkey, {KIND} AS fact_type FROM part UNION ALL SELECT p_partkey, 'fluid_plan' FROM part WHERE p_partkey % 10 = 5")
def order_classify(spark, sf):
    return extraction.order_facts(orders(spark, sf)).select("p_partkey", "fact_type")


@query(
    "q_extract_fields",
    """SELECT p_partkey, CASE WHEN p_partkey % 10 = 1 THEN p_size + 10.0 WHEN p_partkey % 10 = 2 THEN p_size + 10.0 END AS rate_ml_hr, CASE WHEN p_partkey % 10 = 1 THEN 16.0 WHEN p_partkey % 10 = 6 THEN 12.0 WHEN p_partkey % 10 = 2 AND 700.0 / (p_size + 10) <= 24 THEN round_even(700.0 / (p_size + 10), 2) END AS hours_per_day,
       CASE WHEN p_partkey % 10 = 1 THEN 250.0 END AS flush_ml, CASE WHEN p_partkey % 10 = 0 THEN p_size + 10.0 END AS dose, CASE p_partkey % 10 WHEN 0 THEN 'BID' WHEN 1 THEN 'Q6H' WHEN 8 THEN 'WITH MEALS' END AS frequency,
       CASE p_partkey % 10 WHEN 2 THEN 700.0 END AS target_ml_day, CASE WHEN p_partkey % 10 IN (4, 5) THEN (p_size + 10) * 100.0 END AS restriction_ml_day FROM part""",
)
def extract_fields(spark, sf):
    s, k = F.col("summary"), F.col("p_partkey") % 10
    feed, drug, fluid = extraction.enteral_feeding(s), extraction.medication(s), extraction.fluid_plan(s)
    return orders(spark, sf).select(
        "p_partkey", feed["rate_ml_hr"].alias("rate_ml_hr"), feed["hours_per_day"].alias("hours_per_day"), feed["flush_ml"].alias("flush_ml"), F.when(k == 0, drug["dose"]).alias("dose"), extraction.order_frequency(s).alias("frequency"),
        F.when(k == 2, fluid["target_ml_day"]).alias("target_ml_day"), F.when(k.isin(4, 5), fluid["restriction_ml_day"]).alias("restriction_ml_day"),
    )


@query(
    "q_diet_fields",
    """SELECT p_partkey, CASE p_partkey % 10 WHEN 3 THEN 'ccd' WHEN 5 THEN 'regular' END AS diet_type, CASE p_partkey % 10 WHEN 3 THEN 'ground' END AS texture, CASE p_partkey % 10 WHEN 3 THEN 'thin' END AS liquid FROM part""",
)
def diet_fields(spark, sf):
    d, is_diet = extraction.diet(F.col("summary")), extraction.order_type(F.col("summary"), F.col("category")) == "diet"
    return orders(spark, sf).select("p_partkey", *(F.when(is_diet, d[k]).alias(name) for k, name in (("diet_type", "diet_type"), ("texture", "texture"), ("liquid_consistency", "liquid"))))


def weight_pages(spark, sf):
    """A page for each customer, with a row for each order."""
    row = F.concat(F.date_format("o_orderdate", "MM/dd/yyyy"), F.lit(" 08:30 "), (F.col("o_orderkey") % 200 + 90).cast("string"), F.lit(" Lbs (Scale)"))
    return read(spark, sf, "orders").groupBy("o_custkey").agg(F.concat(F.lit("Weights and Vitals Summary\n"), F.array_join(F.array_sort(F.collect_list(row)), "\n")).alias("text"))


@query("q_weight_rows", "SELECT o_custkey, o_orderdate::DATE + INTERVAL '8 hours 30 minutes' AS measured_at, (o_orderkey % 200 + 90)::DOUBLE AS weight_lb, 'Scale' AS description FROM orders")
def weight_rows(spark, sf):
    return extraction.weight_rows(weight_pages(spark, sf), ["o_custkey"]).select("o_custkey", F.col("measured_at").cast("timestamp_ntz").alias("measured_at"), "weight_lb", "description")


@query("q_report_dispatch", "SELECT o_custkey, 'weights' AS kind, count(*) + 1 AS n_lines FROM orders GROUP BY o_custkey")
def report_dispatch(spark, sf):
    pages = weight_pages(spark, sf)
    lines = lines_of(pages, ["o_custkey"]).groupBy("o_custkey").agg(F.count("*").alias("n_lines"))
    return pages.select("o_custkey", report_kind(F.col("text")).alias("kind")).join(lines, "o_custkey")


@query("q_document_text", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations WHERE text <> '' GROUP BY conv_id")
def whole_text(spark, sf):
    return document_text(read(spark, sf, "conversations"), "conv_id", "turn", "text")


@query("q_listing_orders", "SELECT o_custkey, o_orderkey AS record_key, 'P' || o_orderkey AS person_identifier, 'Give ' || o_orderpriority || ' daily' AS summary FROM orders")
def listing_orders(spark, sf):
    rows = read(spark, sf, "orders").select(
        F.col("o_custkey").alias("doc"),
        F.explode(F.array(F.struct((F.col("o_orderkey") * 3).alias("line_number"), F.format_string("Sample, Ada (P%d) Give", F.col("o_orderkey")).alias("line")), F.struct((F.col("o_orderkey") * 3 + 1).alias("line_number"), F.lit("Page 1").alias("line")), F.struct((F.col("o_orderkey") * 3 + 2).alias("line_number"), F.concat("o_orderpriority", F.lit(" daily")).alias("line")))).alias("x"),
    )
    out = extraction.listing_orders(rows.select("doc", "x.*"))
    return out.select(F.col("doc").alias("o_custkey"), F.substring("person_identifier", 2, 20).cast("long").alias("record_key"), "person_identifier", "summary")


@query(
    "q_food_json",
    """SELECT l_partkey AS food_id, l_linenumber::VARCHAR AS number, arg_max(l_quantity, l_orderkey) AS amount FROM lineitem GROUP BY 1, 2""",
)
def food_json(spark, sf):
    nested = F.struct(F.struct(F.col("l_linenumber").cast("string").alias("number"), F.lit("n").alias("name"), F.lit("g").alias("unitName")).alias("nutrient"), F.col("l_quantity").alias("amount"))
    flat = F.struct(F.col("l_linenumber").cast("string").alias("number"), F.lit("n").alias("name"), F.lit("g").alias("unitName"), F.col("l_quantity").alias("amount"))
    each = F.when(F.col("l_partkey") % 2 == 0, F.to_json(nested)).otherwise(F.to_json(flat))
    lists = read(spark, sf, "lineitem").groupBy("l_partkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_orderkey").alias("o"), each.alias("j")))).alias("n"))
    body = F.concat(F.lit('{"fdcId":'), F.col("l_partkey").cast("string"), F.lit(',"description":" food ","foodNutrients":['), F.array_join(F.transform("n", lambda x: x["j"]), ","), F.lit("]}"))
    return foods.foods(lists.select(body.alias("body")))[1].select("food_id", "number", "amount")


@query("q_detail_batches", "SELECT count(*) AS n_ids, TRUE AS all_small FROM (SELECT DISTINCT l_partkey FROM lineitem)")
def detail_batches(spark, sf):
    batches = foods.detail_batches(read(spark, sf, "lineitem"), "l_partkey")
    return batches.agg(F.sum(F.size("ids")).cast("long").alias("n_ids"), (F.max(F.size("ids")) <= foods.DETAIL_BATCH).alias("all_small"))


PEOPLE = """people AS (SELECT c_custkey AS person_id, 'first' || c_custkey % 700 AS f, 'last' || c_custkey % 700 AS l, CASE WHEN c_custkey % 5 > 0 THEN DATE '1950-01-01' + CAST(c_custkey % 900 AS INTEGER) END AS born, CASE WHEN c_custkey % 3 = 0 THEN 'ID' || c_custkey END AS ident, c_nationkey AS fac FROM customer)"""


@query(
    "q_identity_resolve",
    f"""WITH {PEOPLE}, r AS (SELECT person_id + 200 AS record_id, f, l, born, ident, fac FROM people WHERE person_id % 2 = 0 UNION ALL SELECT person_id + 1000000, 'new' || person_id, 'one', born, NULL, fac FROM people WHERE person_id % 50 = 0),
       m AS (SELECT r.record_id, r.born AS rb, count(DISTINCT CASE WHEN r.ident = p.ident AND r.fac = p.fac THEN p.person_id END) AS ni, min(CASE WHEN r.ident = p.ident AND r.fac = p.fac THEN p.person_id END) AS i,
         count(DISTINCT CASE WHEN r.f = p.f AND r.l = p.l AND r.born = p.born THEN p.person_id END) AS nb, min(CASE WHEN r.f = p.f AND r.l = p.l AND r.born = p.born THEN p.person_id END) AS b,
         count(DISTINCT CASE WHEN r.f = p.f AND r.l = p.l AND (r.born IS NULL OR p.born IS NULL) THEN p.person_id END) AS nn, min(CASE WHEN r.f = p.f AND r.l = p.l AND (r.born IS NULL OR p.born IS NULL) THEN p.person_id END) AS n
         FROM r LEFT JOIN people p ON (r.f = p.f AND r.l = p.l) OR (r.ident = p.ident AND r.fac = p.fac) GROUP BY 1, 2)
       SELECT record_id, CASE WHEN ni > 1 OR (ni = 0 AND nb > 1) OR (ni = 0 AND nb = 0 AND nn > 1) THEN 'ambiguous' WHEN ni + nb + nn = 0 THEN 'new' ELSE 'matched' END AS status,
         CASE WHEN NOT (ni > 1 OR (ni = 0 AND nb > 1) OR (ni = 0 AND nb = 0 AND nn > 1)) THEN coalesce(i, b, n) END AS person_id FROM m""",
)
def identity_resolve(spark, sf):
    key = F.col("c_custkey")
    people = read(spark, sf, "customer").select(
        key.alias("person_id"), F.concat(F.lit("first"), (key % 700).cast("string")).alias("first_name"), F.concat(F.lit("last"), (key % 700).cast("string")).alias("last_name"),
        F.when(key % 5 > 0, F.date_add(F.lit("1950-01-01").cast("date"), (key % 900).cast("int"))).alias("date_of_birth"), F.when(key % 3 == 0, F.concat(F.lit("ID"), key.cast("string"))).alias("identifier"), F.col("c_nationkey").alias("facility_id"), F.lit("F").alias("sex"),
    )
    known = people.filter("person_id % 2 = 0").withColumn("record_id", F.col("person_id") + 200).withColumn("first_name", F.upper("first_name"))
    new = people.filter("person_id % 50 = 0").withColumns({"record_id": F.col("person_id") + 1000000, "first_name": F.concat(F.lit("new"), F.col("person_id").cast("string")), "last_name": F.lit("one"), "identifier": F.lit(None).cast("string")})
    return identity.resolve(known.unionByName(new).drop("person_id"), people).select("record_id", "status", "person_id")


@query("q_document_facility", "SELECT o_custkey AS document_id, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN min(o_orderpriority) END AS facility_id FROM orders GROUP BY 1")
def document_facility(spark, sf):
    facts = read(spark, sf, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderpriority").alias("facility_id"))
    return identity.document_facility(facts)


@query("q_new_documents", "SELECT min(doc_id) AS doc_id FROM documents n WHERE doc_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM documents t WHERE t.doc_id % 2 = 0 AND sha256(t.text) = sha256(n.text)) GROUP BY sha256(text)")
def new_documents(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("checksum"))
    return identity.new_documents(docs.filter("doc_id % 2 = 1"), docs.filter("doc_id % 2 = 0"), "checksum", "doc_id").select("doc_id")


@query(
    "q_context_budget",
    """SELECT o_custkey, least(count(*), 5) AS kept, CASE WHEN count(*) > 5 THEN count(*) - 5 END AS omitted FROM orders GROUP BY o_custkey""",
)
def context_budget(spark, sf):
    lists = read(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("orders"))
    out = context.budget(lists.withColumn("extra", F.lit(" ")), {"orders": 5}, extra="extra")
    return out.select("o_custkey", F.size("orders").cast("long").alias("kept"), F.try_element_at("omitted", F.lit("orders")).cast("long").alias("omitted"))


@query(
    "q_truncate_tokens",
    """SELECT doc_id, strlen(text) > 300 AS cut, md5(CASE WHEN strlen(text) <= 300 THEN text ELSE left(text, list_max(list_filter(range(0, 289), lambda i: strlen(left(text, i::INT)) <= 288))::INT) || chr(10) || '[truncated]' END) AS body FROM documents""",
)
def truncate_tokens(spark, sf):
    from larder.functions.text import truncate_to_tokens

    short = truncate_to_tokens(F.col("text"), 100)
    fits = required(F.octet_length(short) <= 300, "a text is over its budget")
    return read(spark, sf, "documents").filter(fits).select("doc_id", short.endswith("\n[truncated]").alias("cut"), F.md5(short).alias("body"))


def _segments_sql() -> str:
    """A document is one page, so the walk has a closed form: the text is closed by the last heading that closes it, until the first strict title after that; before any such heading the page's first line may be the title."""
    quoted = lambda p: p.replace("'", "''")
    says = lambda x, p: f"regexp_matches({x}, '{quoted(p)}')"
    either = lambda x, ps: "(" + " OR ".join(says(x, p) for p in ps) + ")"
    small = ", ".join(f"'{w}'" for w in fixed.SMALL_WORDS)
    return f"""WITH l AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_number FROM documents),
n AS (SELECT *, trim(line, ' ') AS t, trim(regexp_replace(trim(line, ' '), ':+$', ''), ' ') AS x FROM l WHERE trim(line, ' ') <> ''),
m AS (SELECT *, {either("x", (fixed.REFERENCE_HEADING, fixed.CONTENTS_HEADING, fixed.METADATA_HEADING))} AS closes, coalesce({says("trim(lead(line) OVER (PARTITION BY doc ORDER BY line_number), ' ')", fixed.SUBSECTION_HEADING)}, FALSE) AS heads,
  count(*) FILTER ({says("t", fixed.CONTENTS_ENTRY)}) OVER (PARTITION BY doc) >= 2 AS listed,
  length(x) <= 90 AND len(regexp_split_to_array(x, '\\s+')) BETWEEN 2 AND 12 AND NOT {says("x", r"[.;,]$")} AND NOT {says("x", fixed.SUBSECTION_HEADING)} AND NOT {says("x", fixed.CONTENTS_ENTRY)}
    AND (len(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: NOT (regexp_matches(w, '^\\p{{Lu}}') OR lower(w) IN ({small})))) = 0 OR (upper(x) = x AND lower(x) <> x)) AS titled FROM n),
k AS (SELECT *, titled AND (heads OR {says("x", fixed.CLINICAL_TOPIC)}) AS strict, row_number() OVER (PARTITION BY doc ORDER BY line_number) AS i FROM m WHERE NOT {either("t", (fixed.PAGE_NUMBER, fixed.DOCUMENT_TITLE, *fixed.INLINE_METADATA))}),
c AS (SELECT *, max(CASE WHEN closes THEN i WHEN listed THEN 0 END) OVER (PARTITION BY doc ORDER BY i) AS closed FROM k),
r AS (SELECT *, min(CASE WHEN strict AND NOT closes THEN i END) OVER (PARTITION BY doc, closed) AS opens, first(CASE WHEN titled THEN t END) OVER (PARTITION BY doc ORDER BY i) AS own FROM c),
o AS (SELECT *, CASE WHEN closed IS NULL THEN own ELSE max(CASE WHEN i = opens THEN t END) OVER (PARTITION BY doc, closed) END AS section_title FROM r WHERE NOT closes)
SELECT doc, 1 AS page_number, line_number::INT AS line_number, section_title, t AS line FROM o WHERE closed IS NULL OR i >= opens"""


@query("q_content_segments", _segments_sql())
def content_segments(spark, sf):
    pages = read(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.lit(1).alias("page_number"), "text")
    lines = lines_of(pages, ["doc", "page_number"])
    return extraction.content_segments(lines.select("doc", "page_number", F.col("line_number").cast("int").alias("line_number"), "line"))


@query("q_event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, sf):
    out = incremental.event_windows(read(spark, sf, "events"), "ts", ["event_type"])
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


@query(
    "q_event_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
       h AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS started, count(*) AS n FROM h GROUP BY user_id, k""",
)
def event_sessions(spark, sf):
    out = incremental.event_sessions(read(spark, sf, "events"), "ts", ["user_id"], gap="6 hours")
    return out.select("user_id", F.col("window.start").cast("timestamp_ntz").alias("started"), "n")
