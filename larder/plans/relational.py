"""Lookups, joins, sets and aggregates over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import merge, relational, temporal
from larder.plans.registry import query
from larder.sources.tables import read


@query("q_point_lookup", "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey = 7")
def point_lookup(spark, sf):
    return read(spark, sf, "customer").filter(relational.match_all({"c_custkey": 7})).select("c_custkey", "c_name", "c_nationkey")


@query("q_in_list_sorted", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (1, 4, 7, 10, 13) ORDER BY o_orderdate DESC, o_orderkey DESC")
def in_list_sorted(spark, sf):
    rows = read(spark, sf, "orders").filter(F.col("o_custkey").isin(1, 4, 7, 10, 13))
    return rows.orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).select("o_orderkey", "o_custkey", "o_totalprice")


@query("q_ci_contains_or", "SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name), 'anv') OR contains(lower(p_brand), 'anv') OR contains(lower(p_brand), '#2') OR contains(lower(p_type), 'brass')")
def ci_contains_or(spark, sf):
    return read(spark, sf, "part").filter(relational.contains_any(["p_name", "p_brand"], "ANV") | relational.contains_any(["p_brand"], "#2") | relational.contains_any(["p_type"], "BRASS")).select("p_partkey", "p_name", "p_brand")


@query("q_gated_or", "SELECT vec_id, label FROM embeddings WHERE (TRUE AND label = 1) OR (FALSE AND label = 2) OR (TRUE AND label = 3)")
def gated_or(spark, sf):
    return read(spark, sf, "embeddings").filter(relational.gated({"1": True, "2": False, "3": True}, "label")).select("vec_id", "label")


@query("q_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def exists(spark, sf):
    pending = read(spark, sf, "orders").filter("o_orderstatus = 'P'")
    return read(spark, sf, "customer").join(pending, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("q_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def not_exists(spark, sf):
    return read(spark, sf, "customer").join(read(spark, sf, "orders").filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query(
    "q_null_tolerant_match",
    """SELECT a.c_custkey, b.n_nationkey FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k, c_nationkey FROM customer) a
       JOIN (SELECT n_nationkey, nullif(n_regionkey, 0) AS r FROM nation) b ON a.c_nationkey = b.n_nationkey
       WHERE (a.k IS NULL OR b.r IS NULL OR a.k % 5 = b.r)""",
)
def null_tolerant_match(spark, sf):
    people = read(spark, sf, "customer").select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("k"), "c_nationkey")
    places = read(spark, sf, "nation").select("n_nationkey", F.nullif("n_regionkey", F.lit(0)).alias("r"))
    both = people.join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return both.filter(relational.compatible(F.col("k") % 5, F.col("r"))).select("c_custkey", "n_nationkey")


@query(
    "q_unique_or_ambiguous",
    """SELECT q.brand AS brand, count(p.p_partkey) AS n_matches, CASE WHEN count(p.p_partkey) = 0 THEN 'not_found' WHEN count(p.p_partkey) = 1 THEN 'ok' ELSE 'ambiguous' END AS status,
              min(p.p_name) AS first_choice, max(p.p_name) AS last_choice, CASE WHEN count(p.p_partkey) = 1 THEN min(p.p_partkey) END AS p_partkey
       FROM (SELECT DISTINCT p_brand || '/' || p_size AS brand, p_brand AS b, p_size + 1 AS s FROM part) q LEFT JOIN part p ON p.p_brand = q.b AND p.p_size = q.s GROUP BY q.brand""",
)
def unique_or_ambiguous(spark, sf):
    part = read(spark, sf, "part")
    asked = part.select(F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string")).alias("brand"), F.col("p_brand").alias("b"), (F.col("p_size") + 1).alias("s")).distinct()
    out = relational.unique_or_status(asked, part, (F.col("p_brand") == F.col("b")) & (F.col("p_size") == F.col("s")), "brand", F.col("p_name"), ["p_partkey"])
    return out.select("brand", "n_matches", "status", "first_choice", "last_choice", "p_partkey")


@query(
    "q_isclose",
    "SELECT p_partkey, p_retailprice FROM part WHERE abs(p_retailprice / 100 - round_even(p_retailprice / 100, 1)) <= greatest(1e-9 * greatest(abs(p_retailprice / 100), abs(round_even(p_retailprice / 100, 1))), 0.01)",
)
def isclose(spark, sf):
    price = F.col("p_retailprice") / 100
    return read(spark, sf, "part").filter(relational.is_close(price, F.bround(price, 1))).select("p_partkey", "p_retailprice")


@query(
    "q_check_split",
    """SELECT CASE WHEN l_quantity <= 45 AND l_discount <= 0.08 AND l_shipdate >= TIMESTAMP '1993-01-01' THEN 'valid' ELSE 'reject' END AS side,
              count(*) AS n, count(*) FILTER (WHERE l_quantity > 45) AS n_quantity, count(*) FILTER (WHERE l_discount > 0.08) AS n_discount FROM lineitem GROUP BY 1""",
)
def check_split(spark, sf):
    rules = {"quantity": F.col("l_quantity") <= 45, "discount": F.col("l_discount") <= 0.08, "date": F.col("l_shipdate") >= F.lit("1993-01-01").cast("timestamp")}
    good, bad = relational.split_valid(read(spark, sf, "lineitem"), rules)
    count = lambda df, side: df.agg(F.count("*").alias("n"), F.count_if(F.col("l_quantity") > 45).alias("n_quantity"), F.count_if(F.col("l_discount") > 0.08).alias("n_discount")).withColumn("side", F.lit(side))
    return count(good, "valid").unionByName(count(bad, "reject")).filter("n > 0").select("side", "n", "n_quantity", "n_discount")


@query(
    "q_json_no_nulls",
    """SELECT c_custkey, '{' || coalesce('"key":' || nullif(c_custkey, 5)::VARCHAR || ',', '') || coalesce('"nation":' || nullif(c_nationkey, 3)::VARCHAR || ',', '') || '"segment":"' || c_mktsegment || '"}' AS body FROM customer""",
)
def json_no_nulls(spark, sf):
    body = F.to_json(F.struct(F.nullif("c_custkey", F.lit(5)).alias("key"), F.nullif("c_nationkey", F.lit(3)).alias("nation"), F.col("c_mktsegment").alias("segment")), {"ignoreNullFields": "true"})
    return read(spark, sf, "customer").select("c_custkey", body.alias("body"))


@query("q_join_status", "SELECT e.vec_id, e.label, l.quality FROM embeddings e JOIN labels l ON e.vec_id = l.doc_id WHERE l.toxic = 0")
def join_status(spark, sf):
    done = read(spark, sf, "labels").filter("toxic = 0")
    return read(spark, sf, "embeddings").join(done, F.col("vec_id") == F.col("doc_id")).select("vec_id", "label", "quality")


@query("q_join_3way_distinct", "SELECT DISTINCT c_custkey, c_nationkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_returnflag = 'R' AND l_quantity > 40")
def join_3way_distinct(spark, sf):
    back = read(spark, sf, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 40")
    both = back.join(read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "c_nationkey").distinct()


@query(
    "q_union_hetero",
    """SELECT o_custkey AS person_id, 'order' AS kind, o_totalprice AS value, o_orderpriority AS priority FROM orders
       UNION ALL BY NAME SELECT user_id AS person_id, 'event' AS kind, value, event_type AS event FROM events""",
)
def union_hetero(spark, sf):
    orders = read(spark, sf, "orders").select(F.col("o_custkey").alias("person_id"), F.lit("order").alias("kind"), F.col("o_totalprice").alias("value"), F.col("o_orderpriority").alias("priority"))
    events = read(spark, sf, "events").select(F.col("user_id").alias("person_id"), F.lit("event").alias("kind"), "value", F.col("event_type").alias("event"))
    return merge.union_all([orders, events])


@query(
    "q_pivot_nutrients",
    """SELECT p_partkey, max(CASE WHEN l_linenumber = 1 THEN l_quantity END) AS n1, max(CASE WHEN l_linenumber = 2 THEN l_quantity END) AS n2, max(CASE WHEN l_linenumber = 3 THEN l_quantity END) AS n3
       FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey""",
)
def pivot_nutrients(spark, sf):
    wide = read(spark, sf, "lineitem").groupBy("l_partkey").pivot("l_linenumber", [1, 2, 3]).agg(F.max("l_quantity"))
    both = read(spark, sf, "part").join(wide, F.col("p_partkey") == F.col("l_partkey"), "left")
    return both.select("p_partkey", F.col("1").alias("n1"), F.col("2").alias("n2"), F.col("3").alias("n3"))


@query("q_nm_exists", "SELECT p_partkey, count(DISTINCT l_suppkey) AS n_suppliers, bool_or(l_suppkey = 3) AS has_supplier FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey")
def nm_exists(spark, sf):
    links = read(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()
    both = read(spark, sf, "part").join(links, F.col("p_partkey") == F.col("l_partkey"))
    return both.groupBy("p_partkey").agg(F.count("*").alias("n_suppliers"), F.bool_or(F.col("l_suppkey") == 3).alias("has_supplier"))


@query(
    "q_alias_resolve",
    """SELECT c_custkey, n.n_name AS asked, coalesce(a.canonical, '?') AS canonical FROM customer JOIN nation n ON c_nationkey = n_nationkey
       LEFT JOIN (SELECT lower(n_name) AS alias, n_name AS canonical FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT lower(n_name), 'region ' || n_regionkey FROM nation WHERE n_nationkey % 4 = 1) a ON a.alias = lower(n.n_name)""",
)
def alias_resolve(spark, sf):
    nation = read(spark, sf, "nation")
    names = nation.filter("n_nationkey % 2 = 0").select(F.lower("n_name").alias("alias"), F.col("n_name").alias("canonical"))
    names = names.unionByName(nation.filter("n_nationkey % 4 = 1").select(F.lower("n_name").alias("alias"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("canonical")))
    people = read(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return relational.resolve_alias(people, F.lower("n_name"), names).select("c_custkey", F.col("n_name").alias("asked"), F.coalesce("canonical", F.lit("?")).alias("canonical"))


@query(
    "q_bucket_join",
    "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' WHEN c_acctbal < 5000 THEN 'middle' ELSE 'high' END AS band FROM customer",
)
def bucket_join(spark, sf):
    bands = [("debt", float("-inf"), 0.0), ("low", 0.0, 1000.0), ("middle", 1000.0, 5000.0), ("high", 5000.0, float("inf"))]
    return relational.in_band(read(spark, sf, "customer"), F.col("c_acctbal"), bands).select("c_custkey", "band")


@query(
    "q_band_assign",
    "SELECT p_partkey, b.name AS band FROM part JOIN (VALUES ('test', 900.0, 1100.0), ('result', 1100.0, 1300.0), ('unit', 1300.0, 1500.0)) b(name, l, r) ON p_retailprice + p_size / 2.0 >= b.l AND p_retailprice + p_size / 2.0 < b.r",
)
def band_assign(spark, sf):
    middle = F.col("p_retailprice") + F.col("p_size") / 2.0
    return relational.in_band(read(spark, sf, "part"), middle, [("test", 900.0, 1100.0), ("result", 1100.0, 1300.0), ("unit", 1300.0, 1500.0)]).select("p_partkey", "band")


@query(
    "q_set_diff_both",
    """SELECT k AS c_custkey, side FROM ((SELECT c_custkey AS k, 'missing' AS side FROM customer EXCEPT SELECT o_custkey, 'missing' FROM orders WHERE o_totalprice > 100000)
       UNION ALL (SELECT o_custkey, 'unexpected' FROM orders WHERE o_totalprice > 100000 EXCEPT SELECT c_custkey, 'unexpected' FROM customer))""",
)
def set_diff_both(spark, sf):
    asked = read(spark, sf, "customer").select("c_custkey")
    got = read(spark, sf, "orders").filter("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return relational.set_differences(asked, got, ["c_custkey"])


@query("q_counts_observe", "SELECT count(*) AS scanned, count(*) FILTER (WHERE o_orderstatus = 'O') AS created, count(*) FILTER (WHERE o_orderstatus = 'F') AS existing, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed FROM orders")
def counts_observe(spark, sf):
    by = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return read(spark, sf, "orders").agg(F.count("*").alias("scanned"), by("O").alias("created"), by("F").alias("existing"), by("P").alias("failed"))


@query(
    "q_having_repeat",
    r"""WITH lines AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM documents),
       ends AS (SELECT DISTINCT doc_id, unnest(list_concat(l[1:2], l[-2:])) AS line FROM lines)
       SELECT lower(regexp_replace(line, '\s+', ' ', 'g')) AS line, count(DISTINCT doc_id) AS n_pages FROM ends WHERE line <> '' GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2""",
)
def having_repeat(spark, sf):
    return relational.repeated_lines(read(spark, sf, "documents"), "doc_id", "text")


@query("q_all_or_null_sum", "SELECT l_orderkey, l_linenumber, round(l_quantity + nullif(l_tax, 0.02) + nullif(l_discount, 0.05), 4) AS total FROM lineitem")
def all_or_null_sum(spark, sf):
    rows = read(spark, sf, "lineitem").withColumns({"t": F.nullif("l_tax", F.lit(0.02)), "d": F.nullif("l_discount", F.lit(0.05))})
    return rows.select("l_orderkey", "l_linenumber", F.round(temporal.all_or_null(["l_quantity", "t", "d"]), 4).alias("total"))


@query("q_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(spark, sf):
    return read(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("q_partial_failure", "SELECT user_id, count(*) FILTER (WHERE event_type <> 'error') AS n_ok, count(*) FILTER (WHERE event_type = 'error') AS n_failed, CASE WHEN count(*) FILTER (WHERE event_type <> 'error') = 0 THEN 'failed' WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN 'partial' ELSE 'ok' END AS status FROM events GROUP BY user_id")
def partial_failure(spark, sf):
    return relational.policy_error(read(spark, sf, "events"), ["user_id"], F.col("event_type") != "error")


@query("q_json_decode", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN event_type IN ('purchase', 'error') THEN event_type ELSE 'other' END AS kind FROM events")
def json_decode(spark, sf):
    body = F.from_json("props", "k long")
    return read(spark, sf, "events").select("event_id", body["k"].alias("k"), F.when(F.col("event_type").isin("purchase", "error"), F.col("event_type")).otherwise("other").alias("kind"))


@query("q_rate_window", "SELECT user_id, date_trunc('hour', ts) AS hour, count(*) AS n, count(*) > 2 AS over_quota FROM events GROUP BY 1, 2")
def rate_window(spark, sf):
    hours = read(spark, sf, "events").groupBy("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"))
    return hours.withColumn("over_quota", F.col("n") > 2)


@query(
    "q_suffix_dispatch",
    r"""SELECT page_id, CASE WHEN lower(url) LIKE '%.pdf' THEN 'pdf' WHEN contains(lower(html), '<table') THEN 'table' WHEN contains(lower(html), '<article') THEN 'article' ELSE 'fallback' END AS reader,
       CASE lower(nullif(regexp_extract(url, '\.([A-Za-z0-9]+)$', 1), '')) WHEN 'pdf' THEN 'application/pdf' WHEN 'csv' THEN 'text/csv' WHEN 'txt' THEN 'text/plain' ELSE 'application/octet-stream' END AS mime FROM pages""",
)
def suffix_dispatch(spark, sf):
    from larder.functions.text import mime_type, suffix
    from larder.sources.documents import dispatch

    readers = [("pdf", F.coalesce(suffix(F.col("url")) == "pdf", F.lit(False))), ("table", F.lower("html").contains("<table")), ("article", F.lower("html").contains("<article"))]
    return read(spark, sf, "pages").select("page_id", dispatch(readers, "fallback").alias("reader"), mime_type(F.col("url")).alias("mime"))
