"""Current state, newest rows and changes over time. Orders stand for a person's records: status O is active, F inactive, P unknown."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import dates
from larder.operators import temporal
from larder.plans.registry import query
from larder.sources.tables import read

#: SQL of the records that several queries start from.
RECORDS = """records AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderdate, o_totalprice,
  CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'inactive' ELSE 'unknown' END AS status,
  date_trunc('month', greatest(o_orderdate, s.shipped)) AS clinical
  FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1) s ON l_orderkey = o_orderkey)"""


def records(spark, sf):
    """Orders with a status and a clinical time, the later of order date and last shipment, by the month so that ties occur."""
    shipped = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
    orders = read(spark, sf, "orders").join(shipped, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    status = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "inactive").otherwise("unknown")
    time = F.date_trunc("month", temporal.clinical_time(F.col("shipped"), F.col("o_orderdate")))
    return orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate", "o_totalprice", status.alias("status"), time.alias("clinical"))



def is_active():
    return F.col("status") == "active"


def stamp(c: str):
    """Times as plain date and time, as DuckDB gives them."""
    return F.col(c).cast("timestamp_ntz").alias(c)


@query("q_current_singleton", f"WITH {RECORDS} SELECT o_custkey, o_orderkey, clinical FROM (SELECT *, rank() OVER w AS r, count(*) OVER (PARTITION BY o_custkey, clinical) AS n FROM records WHERE status = 'active' WINDOW w AS (PARTITION BY o_custkey ORDER BY clinical DESC NULLS LAST)) WHERE r = 1 AND n = 1")
def current_singleton(spark, sf):
    return temporal.current(records(spark, sf), ["o_custkey"], "clinical", is_active()).select("o_custkey", "o_orderkey", stamp("clinical"))


@query("q_current_singleton_conflicts", f"WITH {RECORDS} SELECT o_custkey, count(*) AS n_tied, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS ids FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY clinical DESC NULLS LAST) AS r FROM records WHERE status = 'active') WHERE r = 1 GROUP BY o_custkey HAVING count(*) > 1")
def current_singleton_conflicts(spark, sf):
    return temporal.conflicts(records(spark, sf), ["o_custkey"], "clinical", "o_orderkey", is_active())


@query("q_current_by_key", f"WITH {RECORDS} SELECT o_custkey, o_orderpriority, o_orderkey FROM (SELECT *, rank() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY clinical DESC NULLS LAST) AS r, count(*) OVER (PARTITION BY o_custkey, o_orderpriority, clinical) AS n FROM records WHERE status = 'active') WHERE r = 1 AND n = 1")
def current_by_key(spark, sf):
    return temporal.current(records(spark, sf), ["o_custkey", "o_orderpriority"], "clinical", is_active()).select("o_custkey", "o_orderpriority", "o_orderkey")


@query("q_current_by_key_conflicts", f"WITH {RECORDS} SELECT o_custkey, o_orderpriority, count(*) AS n_tied, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS ids FROM (SELECT *, rank() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY clinical DESC NULLS LAST) AS r FROM records WHERE status = 'active') WHERE r = 1 GROUP BY 1, 2 HAVING count(*) > 1")
def current_by_key_conflicts(spark, sf):
    return temporal.conflicts(records(spark, sf), ["o_custkey", "o_orderpriority"], "clinical", "o_orderkey", is_active())


@query("q_active_dedup", f"WITH {RECORDS} SELECT o_custkey, o_orderpriority, o_orderkey FROM records WHERE status <> 'inactive' QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY clinical DESC NULLS LAST, o_orderkey DESC) = 1")
def active_dedup(spark, sf):
    order = [F.col("clinical").desc_nulls_last(), F.col("o_orderkey").desc()]
    return temporal.active_set(records(spark, sf), ["o_custkey", "o_orderpriority"], order, F.col("status") != "inactive").select("o_custkey", "o_orderpriority", "o_orderkey")


@query("q_cross_key_conflict", f"WITH {RECORDS} SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_kinds, count(*) AS n_rows FROM records WHERE status = 'active' AND o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1")
def cross_key_conflict(spark, sf):
    return temporal.cross_key_conflicts(records(spark, sf), "o_custkey", "o_orderpriority", is_active() & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))


@query("q_argmax", "SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def argmax(spark, sf):
    return temporal.latest_valid(read(spark, sf, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey", "o_totalprice").select("o_custkey", stamp("o_orderdate"), "o_orderkey", "o_totalprice")


@query("q_topn_per_entity", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) <= 3")
def topn_per_entity(spark, sf):
    return temporal.top_n_per(read(spark, sf, "orders"), ["o_custkey"], [F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey").desc()], 3).select("o_custkey", "o_orderkey", "o_totalprice")


@query("q_nulls_first_topn", "SELECT user_id, event_id FROM (SELECT *, CASE WHEN event_type <> 'error' THEN ts END AS t FROM events) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t DESC NULLS FIRST, event_id DESC) <= 5")
def nulls_first_topn(spark, sf):
    events = read(spark, sf, "events").withColumn("t", F.when(F.col("event_type") != "error", F.col("ts")))
    return temporal.top_n_per(events, ["user_id"], [F.col("t").desc_nulls_first(), F.col("event_id").desc()], 5).select("user_id", "event_id")


@query(
    "q_latest_per_identity",
    """SELECT o_custkey, o_orderkey FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, lower(o_orderpriority) ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
       QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 3""",
)
def latest_per_identity(spark, sf):
    order = [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]
    return temporal.latest_per_identity(read(spark, sf, "orders"), "o_custkey", F.lower("o_orderpriority"), order, 3).select("o_custkey", "o_orderkey")


@query(
    "q_latest_vs_prior",
    """WITH l AS (SELECT *, first_value(o_orderkey) OVER w AS latest_id, first_value(o_totalprice) OVER w AS latest_value, first_value(o_orderdate) OVER w AS latest_at
       FROM orders WHERE o_totalprice > 0 WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC))
       SELECT o_custkey, o_orderkey, latest_id, round(latest_value - o_totalprice, 2) AS change, round((latest_value - o_totalprice) / o_totalprice * 100, 4) AS percent,
       CASE WHEN latest_value < o_totalprice THEN 'loss' WHEN latest_value > o_totalprice THEN 'gain' ELSE 'change' END AS direction, date_diff('day', o_orderdate::DATE, latest_at::DATE) AS elapsed_days
       FROM l WHERE o_orderkey <> latest_id AND o_orderdate::DATE < latest_at::DATE""",
)
def latest_vs_prior(spark, sf):
    out = temporal.latest_against_prior(read(spark, sf, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey", "o_totalprice")
    return out.select("o_custkey", "o_orderkey", "latest_id", F.round("change", 2).alias("change"), F.round("percent", 4).alias("percent"), "direction", F.col("elapsed_days").cast("long").alias("elapsed_days"))


@query(
    "q_month_window_signif",
    """WITH l AS (SELECT *, first_value(o_orderkey) OVER w AS latest_id, first_value(o_totalprice) OVER w AS v, first_value(o_orderdate) OVER w::DATE AS d
       FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)),
       x AS (SELECT o_custkey, o_orderkey, (v - o_totalprice) / o_totalprice * 100 AS p, CASE WHEN d <= o_orderdate::DATE + INTERVAL 1 MONTH THEN 1 WHEN d <= o_orderdate::DATE + INTERVAL 3 MONTH THEN 3 WHEN d <= o_orderdate::DATE + INTERVAL 6 MONTH THEN 6 END AS months
       FROM l WHERE o_orderkey <> latest_id AND o_orderdate::DATE < d)
       SELECT o_custkey, o_orderkey, months AS window_months, coalesce(CASE months WHEN 1 THEN abs(p) >= 5 WHEN 3 THEN abs(p) >= 7.5 WHEN 6 THEN abs(p) >= 10 END, FALSE) AS significant FROM x""".replace("first_value(o_orderdate) OVER w::DATE", "(first_value(o_orderdate) OVER w)::DATE"),
)
def month_window_signif(spark, sf):
    out = temporal.latest_against_prior(read(spark, sf, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey", "o_totalprice")
    return out.select("o_custkey", "o_orderkey", "window_months", "significant")


@query(
    "q_elapsed_months",
    """WITH l AS (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS p, (first_value(o_orderdate) OVER w)::DATE AS d, first_value(o_orderkey) OVER w AS latest_id FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)),
       m AS (SELECT *, (year(d) - year(p)) * 12 + month(d) - month(p) AS m0 FROM l WHERE o_orderkey <> latest_id AND p < d),
       n AS (SELECT *, CASE WHEN (p + to_months(CAST(m0 AS INTEGER)))::DATE > d THEN m0 - 1 ELSE m0 END AS m1 FROM m),
       e AS (SELECT *, floor(m1 + date_diff('day', (p + to_months(CAST(m1 AS INTEGER)))::DATE, d) / date_diff('day', (p + to_months(CAST(m1 AS INTEGER)))::DATE, (p + to_months(CAST(m1 + 1 AS INTEGER)))::DATE)::DOUBLE + 0.5)::BIGINT AS n FROM n)
       SELECT o_custkey, o_orderkey, CASE WHEN n < 1 THEN '<1 month' WHEN n = 1 THEN '1 month' ELSE n::VARCHAR || ' months' END AS elapsed FROM e""",
)
def elapsed_months(spark, sf):
    out = temporal.latest_against_prior(read(spark, sf, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey", "o_totalprice")
    return out.select("o_custkey", "o_orderkey", "elapsed")


@query(
    "q_weight_history_text",
    """WITH l AS (SELECT *, first_value(o_totalprice) OVER w AS v, first_value(o_orderkey) OVER w AS latest_id, (first_value(o_orderdate) OVER w)::DATE AS d FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC))
       SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || ': ' || regexp_replace(printf('%.2f', round(o_totalprice, 2)), '\\.?0+$', '') || ' lbs' AS line FROM l WHERE o_orderkey <> latest_id AND o_orderdate::DATE < d""",
)
def weight_history_text(spark, sf):
    out = temporal.latest_against_prior(read(spark, sf, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey", "o_totalprice")
    line = temporal.change_sentence(F.col("o_orderdate"), F.col("o_totalprice"), F.col("percent"), F.col("direction"), F.col("change"), F.col("elapsed"))
    return out.select("o_custkey", "o_orderkey", F.get(F.split(line, ";"), 0).alias("line"))


@query("q_record_time", "SELECT o_orderkey, coalesce(greatest(nullif(o_orderdate, TIMESTAMP '1995-01-01'), s.shipped), TIMESTAMP '1970-01-01') AS at FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) s ON l_orderkey = o_orderkey")
def record_time(spark, sf):
    shipped = read(spark, sf, "lineitem").filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
    rows = read(spark, sf, "orders").join(shipped, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    known = F.nullif("o_orderdate", F.lit("1995-01-01").cast("timestamp"))
    return rows.select("o_orderkey", temporal.record_time([known, F.col("shipped")], F.lit("1970-01-01").cast("timestamp")).cast("timestamp_ntz").alias("at"))


@query(
    "q_list_caps",
    """SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate DESC, o_orderkey DESC) FILTER (WHERE r <= 5) AS items, greatest(count(*) - 5, 0) AS omitted
       FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) GROUP BY o_custkey""",
)
def list_caps(spark, sf):
    out = temporal.capped_lists(read(spark, sf, "orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], ["o_orderkey"], 5)
    return out.select("o_custkey", F.array_join(F.transform("items", lambda x: x["o_orderkey"].cast("string")), ",").alias("items"), "omitted")


@query(
    "q_carry_forward",
    """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS last_user_chars FROM conversations""",
)
def carry_forward(spark, sf):
    turns = read(spark, sf, "conversations").withColumn("last_user_chars", F.when(F.col("role") == "user", F.length("text").cast("long")))
    return temporal.carry_forward(turns, ["conv_id"], ["turn"], ["last_user_chars"]).select("conv_id", "turn", "last_user_chars")


@query("q_sessionize_markers", "SELECT conv_id, turn, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS session FROM conversations")
def sessionize_markers(spark, sf):
    return temporal.sessions(read(spark, sf, "conversations"), ["conv_id"], ["turn"], F.col("role") == "user").select("conv_id", "turn", "session")


@query("q_lookahead", "SELECT conv_id, turn, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations")
def lookahead(spark, sf):
    return temporal.look_ahead(read(spark, sf, "conversations"), ["conv_id"], ["turn"], "role", "next_role").select("conv_id", "turn", "next_role")


@query("q_first_non_null", "SELECT user_id, arg_min(CASE WHEN event_type <> 'view' THEN value END, event_id) FILTER (WHERE event_type <> 'view') AS first_value, arg_min(CASE WHEN event_type = 'purchase' THEN props END, event_id) FILTER (WHERE event_type = 'purchase') AS first_props FROM events GROUP BY user_id")
def first_non_null(spark, sf):
    rows = read(spark, sf, "events").withColumns({"first_value": F.when(F.col("event_type") != "view", F.col("value")), "first_props": F.when(F.col("event_type") == "purchase", F.col("props"))})
    return temporal.first_known(rows, ["user_id"], "event_id", ["first_value", "first_props"])


@query("q_first_wins_dedupe", "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1")
def first_wins_dedupe(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", "source", F.md5("text").alias("key"))
    return temporal.first_wins(rows, ["key"], [F.col("doc_id")]).select("doc_id", "source")


@query("q_first_gap", "SELECT conv_id, min(top) AS body_top FROM (SELECT conv_id, turn * 100.0 AS top, turn * 100.0 - lag(turn * 100.0 + length(text) % 100) OVER (PARTITION BY conv_id ORDER BY turn) AS gap FROM conversations) WHERE gap > 50 GROUP BY conv_id")
def first_gap(spark, sf):
    lines = read(spark, sf, "conversations").select("conv_id", (F.col("turn") * 100.0).alias("top"), (F.col("turn") * 100.0 + F.length("text") % 100).alias("bottom"))
    return temporal.first_gap(lines, ["conv_id"], "top", "bottom", 50.0)


@query(
    "q_age",
    """SELECT c_custkey, year(o) - year(b) - CASE WHEN (month(o), day(o)) < (month(b), day(b)) THEN 1 ELSE 0 END AS age FROM (SELECT c_custkey, (DATE '1935-01-01' + CAST(c_custkey * 37 % 25000 AS INTEGER)) AS b, DATE '2024-02-29' AS o FROM customer)""",
)
def age(spark, sf):
    born = F.date_add(F.lit("1935-01-01").cast("date"), (F.col("c_custkey") * 37 % 25000).cast("int"))
    return read(spark, sf, "customer").select("c_custkey", dates.completed_years(born, F.lit("2024-02-29").cast("date")).cast("long").alias("age"))


@query(
    "q_multi_format_dates",
    """SELECT o_orderkey, o_orderdate::DATE AS day, hour(o_orderdate) * 3600 + minute(o_orderdate) * 60 AS second FROM orders WHERE o_orderkey % 4 <> 3 UNION ALL SELECT o_orderkey, NULL, NULL FROM orders WHERE o_orderkey % 4 = 3""",
)
def multi_format_dates(spark, sf):
    at, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format(at, "MM/dd/yyyy")).when(k == 1, F.date_format(at, "MMM d, yyyy")).when(k == 2, F.date_format(at, "yyyy-MM-dd")).otherwise("soon")
    clock = F.when(k == 3, "noonish").when(k == 1, F.date_format(at, "h:mm a")).otherwise(F.date_format(at, "HH:mm"))
    return read(spark, sf, "orders").select("o_orderkey", dates.parse_date(text).alias("day"), dates.parse_time(clock).cast("long").alias("second"))
