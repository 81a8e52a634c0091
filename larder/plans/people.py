"""Whole records of people, identities and merges by type: customers are people, their orders, line items and events what is known of them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larder.operators import detail, identity
from larder.plans.registry import query
from larder.sources.tables import read

#: Kinds of records: those of orders by priority with what is current of them, of line items by flag, of events by type.
ORDER_KINDS = {"1-URGENT": ("diet", "single"), "2-HIGH": ("diagnosis", "keyed"), "3-MEDIUM": ("medication", "set"), "4-NOT SPECIFIED": ("dialysis", "single"), "5-LOW": ("supplement", "keyed")}
ITEM_KINDS = {"A": "lab", "N": "edema", "R": "wound"}
EVENT_KINDS = {"click": "weight", "view": "intake", "purchase": "note", "error": "fact", "signup": "goal"}
CAP, CAPS = 3, {"lab": 5, "weight": 2}
ON_DATE = "2024-06-01"


def people(spark, sf):
    key = F.col("c_custkey")
    return read(spark, sf, "customer").select(
        key.alias("person_id"), F.col("c_name").alias("name"), F.date_add(F.lit("1940-01-01").cast("date"), (key * 37 % 20000).cast("int")).alias("date_of_birth"),
        F.when(key % 3 == 0, "Female").when(key % 3 == 1, "m").alias("sex"), F.when(key % 7 > 0, 55.0 + key % 20).alias("height_in"),
    )


def relations(spark, sf):
    status = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "inactive").otherwise("unknown")
    orders = read(spark, sf, "orders").withColumns({"status": status, "month": F.date_trunc("month", "o_orderdate")})
    items = read(spark, sf, "lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    of = lambda names, column: F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), F.col(column))
    state = of({p: s for p, (_, s) in ORDER_KINDS.items()}, "o_orderpriority")
    return {
        "orders": detail.Relation(orders, "o_custkey", "o_orderkey", ["month"], ["o_totalprice"], "status", state, F.when(state != "single", F.col("o_orderkey") % 2), of({p: k for p, (k, _) in ORDER_KINDS.items()}, "o_orderpriority")),
        "items": detail.Relation(items, "o_custkey", "id", ["l_shipdate"], ["l_quantity"], kind=of(ITEM_KINDS, "l_returnflag")),
        "events": detail.Relation(read(spark, sf, "events"), "user_id", "event_id", ["ts"], ["value"], kind=of(EVENT_KINDS, "event_type")),
    }


def _detail_sql() -> str:
    month = "date_trunc('month', o_orderdate)"
    orders = "\nUNION ALL ".join(
        f"SELECT o_custkey AS person_id, '{kind}' AS kind, '{state}' AS state, {"''" if state == 'single' else '(o_orderkey % 2)::VARCHAR'} AS key, o_orderkey AS id, {month}::TIMESTAMP AS seen, o_orderstatus = 'O' AS active FROM orders WHERE o_orderpriority = '{p}'"
        for p, (kind, state) in ORDER_KINDS.items()
    )
    items = "\nUNION ALL ".join(f"SELECT o_custkey, '{kind}', 'list', '', l_orderkey * 10 + l_linenumber, l_shipdate::TIMESTAMP, TRUE FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = '{flag}'" for flag, kind in ITEM_KINDS.items())
    events = "\nUNION ALL ".join(f"SELECT user_id, '{kind}', 'list', '', event_id, ts, TRUE FROM events WHERE event_type = '{name}'" for name, kind in EVENT_KINDS.items())
    cap = "CASE kind " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in CAPS.items()) + f" ELSE {CAP} END"
    return f"""WITH r AS ({orders}\nUNION ALL {items}\nUNION ALL {events}),
placed AS (SELECT *, row_number() OVER (PARTITION BY person_id, kind ORDER BY seen DESC NULLS LAST, id DESC) AS place, {cap} AS cap FROM r),
lists AS (SELECT person_id, string_agg(kind || '=' || ids || '+' || greatest(total - cap, 0), ';' ORDER BY kind) AS lists FROM (SELECT person_id, kind, any_value(cap) AS cap, count(*) AS total, string_agg(id, ',' ORDER BY place) FILTER (WHERE place <= cap) AS ids FROM placed GROUP BY 1, 2) GROUP BY 1),
top AS (SELECT person_id, kind, key, any_value(state) AS state, list(id ORDER BY id) AS ids FROM (SELECT *, rank() OVER (PARTITION BY person_id, kind, key ORDER BY seen DESC NULLS LAST) AS k FROM r WHERE active AND state <> 'list') WHERE k = 1 GROUP BY 1, 2, 3),
states AS (SELECT person_id, string_agg(kind || '/' || key || '=' || ids[-1], ';' ORDER BY kind, key) FILTER (WHERE state = 'set' OR len(ids) = 1) AS current, string_agg(kind || '/' || key || '=' || array_to_string(ids, ','), ';' ORDER BY kind, key) FILTER (WHERE state <> 'set' AND len(ids) > 1) AS conflicts FROM top GROUP BY 1),
w AS (SELECT user_id AS person_id, arg_max(value, (ts, event_id)) AS weight_lb FROM events WHERE event_type = 'click' AND value > 0 AND ts IS NOT NULL GROUP BY 1),
p AS (SELECT c_custkey AS person_id, c_name AS name, DATE '1940-01-01' + (c_custkey * 37 % 20000)::INT AS born, CASE c_custkey % 3 WHEN 0 THEN 'f' WHEN 1 THEN 'm' END AS sex, CASE WHEN c_custkey % 7 > 0 THEN 55.0 + c_custkey % 20 END::DOUBLE AS height_in FROM customer)
SELECT person_id, name, coalesce(lists, '') AS lists, coalesce(current, '') AS current, coalesce(conflicts, '') AS conflicts, date_part('year', age(DATE '{ON_DATE}', born))::INT AS age, weight_lb,
  round(CASE sex WHEN 'f' THEN 100 + 5 * (height_in - 60) WHEN 'm' THEN 106 + 6 * (height_in - 60) END, 4) AS ideal_weight_lb,
  concat_ws(',', CASE WHEN weight_lb IS NULL THEN 'dated_current_weight' END, CASE WHEN height_in IS NULL THEN 'height_in' END, CASE WHEN sex IS NULL THEN 'normalized_sex' END) AS missing
FROM p LEFT JOIN lists USING (person_id) LEFT JOIN states USING (person_id) LEFT JOIN w USING (person_id)"""


@query("q_person_detail", _detail_sql())
def person_detail(spark, sf):
    weights = detail.Relation(read(spark, sf, "events").filter("event_type = 'click'"), "user_id", "event_id", ["ts"], ["value"])
    rows = detail.person_detail(people(spark, sf), relations(spark, sf), F.lit(ON_DATE).cast("date"), CAP, CAPS, weights)
    ids = lambda xs: F.array_join(F.transform(xs, lambda x: x.cast("string")), ",")
    shown = lambda xs, text: F.array_join(F.transform(xs, text), ";")
    return rows.select(
        "person_id", "name",
        shown("lists", lambda x: F.concat(x["kind"], F.lit("="), ids(x["items"]["id"]), F.lit("+"), x["omitted"].cast("string"))).alias("lists"),
        shown("current", lambda x: F.concat(x["kind"], F.lit("/"), x["key"], F.lit("="), x["id"].cast("string"))).alias("current"),
        shown("conflicts", lambda x: F.concat(x["kind"], F.lit("/"), x["key"], F.lit("="), ids(x["ids"]))).alias("conflicts"),
        F.col("age").cast("int").alias("age"), "weight_lb", F.round("ideal_weight_lb", 4).alias("ideal_weight_lb"), F.array_join("missing_inputs", ",").alias("missing"),
    )


#: Orders as records of people: customers of one name, one birth date or one number are told apart, or not, by what each order says.
_RECORDS = """r AS (SELECT o_orderkey AS record_id, CASE WHEN o_orderkey % 5 IN (0, 2, 3) OR o_orderkey % 35 = 4 THEN 'first' || o_custkey % 451 END AS f, CASE WHEN o_orderkey % 5 IN (0, 2, 3) OR o_orderkey % 35 = 4 THEN 'last' || o_custkey % 451 END AS l,
  CASE WHEN o_orderkey % 5 IN (0, 2) THEN DATE '1940-01-01' + (o_custkey // 3)::INT END AS born, CASE WHEN o_orderkey % 5 IN (1, 4) OR o_orderkey % 20 = 5 THEN 'N' || o_custkey // 2 END AS ident, CASE WHEN o_orderkey % 4 > 0 THEN o_custkey % 2 END AS fac
  FROM orders WHERE o_orderkey % 3 = 0 OR o_custkey % 4 > 0)"""


def _batch_sql() -> str:
    compatible = "(x.fac IS NULL OR y.fac IS NULL OR x.fac = y.fac)"
    return f"""WITH RECURSIVE {_RECORDS}, k AS MATERIALIZED (SELECT *, CASE WHEN born IS NOT NULL THEN 'n' || f || '|' || l || '|' || born END AS kn, 'i' || ident || '|' || coalesce(fac::VARCHAR, '?') AS ki FROM r),
e AS MATERIALIZED (SELECT DISTINCT kn AS a, ki AS b FROM k WHERE kn IS NOT NULL AND ki IS NOT NULL UNION SELECT DISTINCT ki, kn FROM k WHERE kn IS NOT NULL AND ki IS NOT NULL),
reach(node, root) AS (SELECT DISTINCT n, n FROM (SELECT coalesce(kn, ki) AS n FROM k UNION SELECT coalesce(ki, kn) FROM k) WHERE n IS NOT NULL UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.node),
roots AS MATERIALIZED (SELECT node, min(root) AS root FROM reach GROUP BY 1),
q AS MATERIALIZED (SELECT k.*, roots.root FROM k LEFT JOIN roots ON node = coalesce(kn, ki)),
p AS MATERIALIZED (SELECT root, count(DISTINCT born) AS births, bool_or(ident IS NOT NULL) AS identified, bool_or(fac IS NOT NULL) AS placed FROM q WHERE root IS NOT NULL GROUP BY 1),
places AS MATERIALIZED (SELECT DISTINCT p.*, s.f, s.l, w.fac FROM p JOIN q s ON s.root = p.root AND s.f IS NOT NULL JOIN q w ON w.root = p.root AND (w.fac IS NOT NULL OR NOT placed)),
j AS (SELECT x.root, min(y.root) AS lo, max(y.root) AS hi FROM places x JOIN places y ON x.f = y.f AND x.l = y.l AND {compatible} WHERE x.births = 0 AND x.identified AND y.births = 1 AND NOT y.identified GROUP BY 1),
m AS MATERIALIZED (SELECT p.root, CASE WHEN lo = hi THEN lo ELSE p.root END AS person, CASE WHEN births > 1 THEN 'conflict' WHEN lo <> hi THEN 'ambiguous' ELSE 'new' END AS status FROM p LEFT JOIN j USING (root)),
y AS (SELECT f, l, fac, person AS root FROM places JOIN m USING (root) WHERE status <> 'ambiguous'),
alone AS (SELECT record_id, min(y.root) AS lo, max(y.root) AS hi FROM q x LEFT JOIN y ON x.f = y.f AND x.l = y.l AND {compatible} WHERE x.root IS NULL GROUP BY 1),
out AS (SELECT record_id, status, person FROM q JOIN m USING (root) UNION ALL SELECT record_id, CASE WHEN lo IS NULL THEN 'insufficient' WHEN lo <> hi THEN 'ambiguous' ELSE status END, lo FROM alone LEFT JOIN m ON m.root = lo)
SELECT record_id, status, CASE WHEN status = 'new' THEN min(record_id) OVER (PARTITION BY CASE WHEN status = 'new' THEN person END) END AS first_record FROM out"""


@query("q_identity_batch", _batch_sql())
def identity_batch(spark, sf):
    key, person = F.col("o_orderkey"), F.col("o_custkey")
    named, dated = (key % 5).isin(0, 2, 3) | (key % 35 == 4), (key % 5).isin(0, 2)
    text = lambda prefix, n: F.concat(F.lit(prefix), n.cast("long").cast("string"))
    records = read(spark, sf, "orders").filter((key % 3 == 0) | (person % 4 > 0)).select(
        key.alias("record_id"), F.when(named, text("First", person % 451)).alias("first_name"), F.when(named, text("LAST", person % 451)).alias("last_name"),
        F.when(dated, F.date_add(F.lit("1940-01-01").cast("date"), F.floor(person / 3).cast("int"))).alias("date_of_birth"),
        F.when((key % 5).isin(1, 4) | (key % 20 == 5), text("N", F.floor(person / 2))).alias("identifier"), F.when(key % 4 > 0, person % 2).alias("facility_id"), F.lit(None).cast("string").alias("sex"),
    )
    found = identity.resolve_new(records)
    return found.select("record_id", "status", F.when(F.col("status") == "new", F.min("record_id").over(Window.partitionBy(F.when(F.col("status") == "new", F.col("person_key"))))).alias("first_record"))
