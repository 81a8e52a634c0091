"""Laboratory reports, facts to relations, running lines, and small set rules, over texts and rows made from the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larder import fixed_values as fixed
from larder.operators import extraction, facts, labs, relational
from larder.plans.registry import query
from larder.sources.tables import read


@query(
    "q_lab_lines",
    """SELECT l_orderkey, l_linenumber, 'Assay ' || l_returnflag AS name, l_quantity::BIGINT::VARCHAR AS result, CASE WHEN l_suppkey % 3 = 0 THEN 'See note' WHEN l_suppkey % 3 = 1 THEN 'mg/dL' END AS unit, CASE WHEN l_suppkey % 3 = 0 THEN '< 9' WHEN l_suppkey % 3 = 1 THEN l_linenumber || ' - 99' END AS reference_range
       FROM lineitem WHERE l_linestatus = 'F' AND l_linenumber <> 7""",
)
def lab_lines(spark, sf):
    text = lambda c: F.col(c).cast("string")
    kind = F.col("l_suppkey") % 3
    tail = F.when(kind == 0, F.lit(" See note < 9")).when(kind == 1, F.concat(F.lit(" mg/dL "), text("l_linenumber"), F.lit(" - 99"))).otherwise("")
    value = F.when(F.col("l_linenumber") == 7, "Invalid").otherwise(F.col("l_quantity").cast("long").cast("string"))
    line = F.concat(F.lit(" Assay "), "l_returnflag", F.lit("  "), value, tail, F.when(F.col("l_tax") > 0.04, " H").otherwise(""), F.when(F.col("l_linestatus") == "F", " Final").otherwise(" Pending"))
    # a list of one or none, exploded: the result is worked out once, not again for the test and for each field
    found = F.filter(F.array(labs.result_of_line(line)), lambda r: r.isNotNull())
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.inline(found))


@query(
    "q_lab_columns",
    """SELECT o_custkey, name, result, unit, reference_range, flag FROM (SELECT o_custkey, 'Serum ' || o_orderpriority AS name, o_orderkey::VARCHAR AS result, 'mmol' AS unit, '1 - 2' AS reference_range, CASE WHEN o_orderkey % 2 = 0 THEN 'H' END AS flag FROM orders WHERE o_orderstatus <> 'P')""",
)
def lab_columns(spark, sf):
    """A page for each customer, a header at a height of 10 points, then a line for each order, its words a point apart in height."""
    order = read(spark, sf, "orders")
    word = lambda x, y, text: F.struct(F.lit(float(x)).alias("x0"), F.lit(float(x + 30)).alias("x1"), y.cast("double").alias("y0"), text.alias("text"))
    head = order.select("o_custkey").distinct().select("o_custkey", F.explode(F.array(*(word(x, F.lit(10), F.lit(t)) for x, t in ((20, "Test"), (180, "Result"), (250, "Unit"), (320, "Ref."), (390, "Flag"), (460, "Status"))))).alias("w"))
    y = 10 + 10 * F.col("n")
    status = F.when(F.col("o_orderstatus") == "P", "Pending").otherwise("Final")
    numbered = numbered_orders(order)
    cells = [word(20, y, F.lit("Serum")), word(60, y + 1, F.col("o_orderpriority")), word(180, y, F.col("o_orderkey").cast("string")), word(250, y + 1, F.lit("mmol")), word(310, y, F.lit("1")), word(320, y, F.lit("-")), word(330, y, F.lit("2")), word(460, y, status)]
    flag = F.when(F.col("o_orderkey") % 2 == 0, F.array(word(390, y, F.lit("H"))))
    body = numbered.select("o_custkey", F.explode(F.concat(F.array(*cells), F.coalesce(flag, F.slice(F.array(word(390, y, F.lit("H"))), 1, 0)))).alias("w"))
    words = head.unionByName(body).select("o_custkey", "w.*")
    return labs.results_of_words(words, ["o_custkey"]).drop("line_number")


def numbered_orders(order):
    """Orders with their place among the customer's."""
    return order.withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))


@query(
    "q_lab_once",
    "SELECT l_partkey, lower(l_returnflag) AS name, l_quantity::BIGINT::VARCHAR AS result, min(l_orderkey * 10 + l_linenumber) AS first_place FROM lineitem GROUP BY ALL",
)
def lab_once(spark, sf):
    rows = read(spark, sf, "lineitem").select("l_partkey", F.lit(None).cast("timestamp").alias("at"), F.when(F.col("l_linenumber") % 2 == 0, F.lower("l_returnflag")).otherwise(F.col("l_returnflag")).alias("name"), F.col("l_quantity").cast("long").cast("string").alias("result"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first_place"))
    return labs.once(rows, "l_partkey", "at", ["first_place"]).select("l_partkey", F.lower("name").alias("name"), "result", "first_place")


TYPES = [*fixed.FACT_RELATIONS, "unheard_of"]


def part_facts(spark, sf):
    """A fact of each type in turn for every part."""
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("p_partkey") % len(TYPES) + 1).cast("int"))
    field = lambda name, value: (F.lit(name), value)
    payload = F.create_map(*field("name", F.concat(F.lit(" "), F.upper("p_name"))), *field("brand", F.col("p_brand")), *field("status", F.lit("active")), *field("action", F.lit("new")), *field("wound_type", F.col("p_type")), *field("observed_at", F.lit("2026-01-02 03:04:05")), *field("measured_at", F.lit("2026-02-03")))
    return read(spark, sf, "part").select("p_partkey", "p_brand", kind.alias("fact_type"), payload.alias("payload"))


@query(
    "q_fact_routing",
    f"""WITH f AS (SELECT *, [{", ".join(f"'{t}'" for t in TYPES)}][p_partkey % {len(TYPES)} + 1] AS t, trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) AS n, trim(lower(p_brand)) AS b, trim(lower(p_type)) AS w FROM part)
       SELECT p_partkey, CASE t {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.FACT_RELATIONS.items())} END AS relation, CASE WHEN t = 'weight' THEN TIMESTAMP '2026-02-03' WHEN t <> 'unheard_of' THEN TIMESTAMP '2026-01-02 03:04:05' END AS observed_at,
         CASE WHEN t IN ({", ".join(f"'{t}'" for t in fixed.STATEFUL_FACTS)}) THEN sha256(to_json([t, 'brand', b, 'measured_at', '2026-02-03', 'name', n, 'wound_type', w])::VARCHAR) END AS state_key,
         CASE WHEN t IN ('appetite', 'gi_observation') THEN sha256(to_json([t, 'action', 'new', 'brand', p_brand, 'measured_at', '2026-02-03', 'name', ' ' || upper(p_name), 'observed_at', '2026-01-02 03:04:05', 'status', 'active', 'wound_type', p_type])::VARCHAR) END AS observation_key,
         CASE WHEN t IN ('wound', 'edema') THEN 'Unspecified' END AS place, CASE WHEN t = 'wound' THEN p_type END AS wound FROM f""",
)
def fact_routing(spark, sf):
    out = facts.routed(part_facts(spark, sf))
    get = lambda k: F.try_element_at("row", F.lit(k)).alias(k)
    return out.select("p_partkey", "relation", F.col("observed_at").cast("timestamp_ntz").alias("observed_at"), "state_key", "observation_key", get("location").alias("place"), get("type").alias("wound"))


@query("q_facts_once", "SELECT p_brand AS document, count(*) AS n FROM part GROUP BY 1")
def facts_once(spark, sf):
    one = part_facts(spark, sf).select(F.col("p_brand").alias("document"), F.col("p_partkey").alias("person"), F.lit(1).alias("source_page"), "fact_type", "payload", F.lit(0).alias("copy"))
    twice = one.unionByName(one.withColumn("copy", F.lit(1)))
    return facts.once(twice, "document", ["person"], ["copy"]).filter("copy = 0").groupBy("document").agg(F.count("*").alias("n"))


@query(
    "q_running_lines",
    """SELECT conv_id, turn, replace(text, chr(10), ' ') AS line FROM conversations WHERE regexp_matches(text, '[^ ]')""",
)
def running_lines(spark, sf):
    """Every turn is a page: a running title, the text on one line, a page number. What stays is the text."""
    row = read(spark, sf, "conversations")
    page = F.array(F.lit("Sample House Diet Manual 7"), F.regexp_replace("text", r"\n", " "), F.concat(F.lit("Page "), F.col("turn").cast("string")))
    lines = row.select(F.col("conv_id").alias("doc"), F.col("turn").cast("int").alias("page_number"), F.posexplode(page).alias("line_number", "line"))
    # a conversation of one turn has no second page that repeats its title
    again = lines.filter("line_number <> 1").withColumn("page_number", F.col("page_number") + 1_000_000)
    out = extraction.without_running_lines(lines.unionByName(again))
    return out.select(F.col("doc").alias("conv_id"), F.col("page_number").cast("long").alias("turn"), "line")


@query(
    "q_set_rules",
    """SELECT o_custkey, bool_or(o_orderpriority = '1-URGENT') AND bool_or(o_orderpriority = '2-HIGH') AS both_kinds, count(DISTINCT o_orderstatus) = 1 AND min(o_orderstatus) = 'O' AS only_open FROM orders GROUP BY 1""",
)
def set_rules(spark, sf):
    kinds = read(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"), F.collect_set("o_orderstatus").alias("s"))
    return kinds.select("o_custkey", relational.has_all(F.col("p"), ["1-URGENT", "2-HIGH"]).alias("both_kinds"), relational.same_set(F.col("s"), F.array(F.lit("O"), F.lit("O"))).alias("only_open"))


@query("q_source_owned", "SELECT o_orderkey, o_orderpriority::VARCHAR AS kind, substr(o_orderpriority, 1, 1)::INT AS rank FROM orders WHERE o_orderstatus <> 'F' OR o_orderpriority IN ('1-URGENT', '2-HIGH')")
def source_owned(spark, sf):
    rows = relational.from_own_source(read(spark, sf, "orders"), "o_orderstatus", "F", "o_orderpriority", ["1-URGENT", "2-HIGH"])
    return rows.select("o_orderkey", F.col("o_orderpriority").alias("kind"), relational.of_type(F.substring("o_orderpriority", 1, 1), "int").alias("rank"))


@query("q_delete_named", "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'P') AND NOT EXISTS (SELECT 1 FROM lineitem d WHERE d.l_returnflag = 'R' AND d.l_linenumber = 1 AND d.l_orderkey = l.l_orderkey AND d.l_linenumber = l.l_linenumber)")
def delete_named(spark, sf):
    """Lines of named orders go, then single links by both their keys."""
    line = read(spark, sf, "lineitem")
    named = read(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    links = line.filter("l_returnflag = 'R' AND l_linenumber = 1").select("l_orderkey", "l_linenumber")
    kept = relational.without_keys(line, named, ["l_orderkey"])
    return relational.without_keys(kept, links, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber")
