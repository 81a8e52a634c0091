"""Reports of several kinds, wounds from CSV texts, and windows over a vocabulary's tokens, from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import chunking, reports, wounds
from larder.plans.registry import query
from larder.sources.tables import read

WOUND_HEAD = 'Report,"1/25/2026 - 1/26/2026"\r\nFacility: North House,x\r\nPatient Number,Name,Wnd #,Wound Type,Wound Location,Stage,Weeks In Treatment,Assessment Note,Physician Orders\r\n'


def wound_texts(spark, sf):
    """A CSV report for each customer: a wound for each order, a row for each line item, notes with commas, doubled quotes and line breaks."""
    items = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_partkey", "l_suppkey")
    note = F.concat(F.lit('"Seen ""'), "l_returnflag", F.lit('"", drains\r\nstill"'))
    stage = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("S"), F.col("l_linenumber").cast("string"))).otherwise("")
    cells = [F.concat(F.lit("Z"), F.col("o_custkey").cast("string")), F.when(F.col("l_linenumber") % 2 == 0, F.lit('"Stone, Mia"')).otherwise(""), F.col("o_orderkey").cast("string"), F.lit("nan"), F.lit(" Heel "), stage, (F.col("l_quantity").cast("int")).cast("string"), note, F.lit("rest")]
    row = F.concat_ws(",", *cells)
    place = F.struct("o_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey", row.alias("row"))
    joined = read(spark, sf, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    body = joined.groupBy(F.col("o_custkey").alias("doc")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["row"]), "\r\n").alias("body"))
    return body.select("doc", F.concat(F.lit(WOUND_HEAD), "body", F.lit("\r\n")).alias("text"))


_WOUNDS = """WITH r AS (SELECT o_custkey AS doc, o_orderkey, l_returnflag, l_linenumber, l_quantity, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_quantity, l_partkey, l_suppkey) AS k FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
  n AS (SELECT o_orderkey, string_agg('Seen "' || l_returnflag || '", drains' || chr(10) || 'still', chr(10) ORDER BY k) AS note FROM (SELECT o_orderkey, l_returnflag, min(k) AS k FROM r GROUP BY 1, 2) GROUP BY 1)
  SELECT doc, 'Z' || doc AS identifier, o_orderkey::VARCHAR AS wound_number, max(CASE WHEN l_linenumber % 2 = 0 THEN 'Stone, Mia' END) AS person_name, arg_min(CASE WHEN l_linenumber % 3 = 0 THEN 'S' || l_linenumber END, k) FILTER (WHERE l_linenumber % 3 = 0) AS stage,
    arg_min(l_quantity, k)::INT AS weeks_in_treatment, any_value(note) AS assessment_note FROM r JOIN n USING (o_orderkey) GROUP BY doc, o_orderkey"""


@query("q_wound_report", f"SELECT *, 'Unknown' AS wound_type, 'Heel' AS location, 'rest' AS physician_orders, 'North House' AS facility_name, TIMESTAMP '2026-01-26' AS observed_at FROM ({_WOUNDS})")
def wound_report(spark, sf):
    columns = ["doc", "identifier", "wound_number", "person_name", "stage", "weeks_in_treatment", "assessment_note", "wound_type", "location", "physician_orders", "facility_name"]
    return wounds.wound_report(wound_texts(spark, sf)).select(*columns, F.col("observed_at").cast("timestamp_ntz").alias("observed_at"))


@query("q_vocabulary_chunks")
def vocabulary_chunks(spark, sf):
    """Windows of 600 tokens, 100 shared with the next, over the tokens of a public vocabulary; tests hold them against the library."""
    import public_tokenizers

    out = chunking.vocabulary_chunks(read(spark, sf, "documents"), ["doc_id"], "text", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "chunk_index", "n_tokens", F.md5("content").alias("body"))


#: What the report of a customer is, by its number modulo six.
REPORT_KINDS = ("weights", "notes", "labs", "orders", "wounds", "unknown")


def report_pages(spark, sf):
    """A report for each customer, of a kind by its number, with a row for each order."""
    key, person = F.col("o_orderkey").cast("string"), F.col("o_custkey")
    day = F.date_format("o_orderdate", "MM/dd/yyyy")
    rows = (
        F.concat(day, F.lit(" 08:30 "), (F.col("o_orderkey") % 60 + 90).cast("string"), F.lit(" Lbs (Scale "), key, F.lit(")")),
        F.concat(F.lit("Effective Date: "), day, F.lit(" 10:00\nType: Nursing Note\nAuthor: Ann\nNote Text: ate "), key),
        F.concat(F.lit("Sodium 1"), key, F.lit(" mmol/L 135 - 145 Final")),
        F.concat(F.lit("Stone, Mia (ID7)\nRenal diet "), key, F.lit("\nDietary - Diet\nActive\n"), day, F.lit("\nN")),
        F.concat(F.lit("Z7,Mia,"), key, F.lit(",Ulcer,Heel")),
        F.concat(F.lit("word"), key),
    )
    heads = ("Weights and Vitals Summary\nStone, Mia (ID7)\n", "Progress Notes *NEW*\n", "Lab Results\n", "Order Listing Report\nNorth House\n", "Wound Type Tabular Report,1/25/2026\nPatient Number,Name,Wnd #,Wound Type,Wound Location\n", "A letter\n")
    of = lambda options: F.get(F.array(*options), (person % 6).cast("int"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), of(rows).alias("r")))), lambda x: x["r"]), "\n")
    return read(spark, sf, "orders").groupBy(person).agg(lines.alias("lines")).select(person.alias("doc"), F.lit(1).alias("page"), F.concat(of([F.lit(h) for h in heads]), "lines").alias("text"))


_KIND_SQL = "CASE o_custkey % 6 " + " ".join(f"WHEN {k} THEN '{name}'" for k, name in enumerate(REPORT_KINDS)) + " END"


@query(
    "q_read_reports",
    f"""WITH o AS (SELECT o_custkey AS doc, {_KIND_SQL} AS kind, o_orderkey::VARCHAR AS key, o_orderdate, o_orderkey FROM orders),
  w AS (SELECT *, row_number() OVER (PARTITION BY doc, o_orderdate ORDER BY o_orderkey) AS k FROM o WHERE kind = 'weights')
  SELECT doc, kind, CASE kind WHEN 'notes' THEN 'note' WHEN 'labs' THEN 'lab' WHEN 'orders' THEN 'diet' ELSE 'wound' END AS fact_type, CASE kind WHEN 'orders' THEN 'ID7' WHEN 'wounds' THEN 'Z7' END AS person,
    CASE kind WHEN 'notes' THEN 'ate ' || key WHEN 'labs' THEN '1' || key WHEN 'orders' THEN 'Renal diet ' || key ELSE key END AS said FROM o WHERE kind NOT IN ('weights', 'unknown')
  UNION ALL SELECT doc, kind, 'weight', 'ID7', 'Scale ' || key FROM w WHERE k = 1
  UNION ALL SELECT doc, kind, 'text', NULL, 'A letter ' || string_agg('word' || key, ' ' ORDER BY o_orderkey) FROM o WHERE kind = 'unknown' GROUP BY 1, 2""",
)
def read_reports(spark, sf):
    got = reports.read_reports(report_pages(spark, sf))
    part = lambda name: F.get_json_object("body", f"$.{name}")
    said = F.when(F.col("kind") == "weights", part("description")).when(F.col("kind") == "notes", part("note_text")).when(F.col("kind") == "labs", part("result")).when(F.col("kind") == "orders", part("summary")).when(F.col("kind") == "wounds", part("wound_number")).otherwise(part("content"))
    return got.select("doc", "kind", "fact_type", F.col("person_identifier").alias("person"), said.alias("said"))
