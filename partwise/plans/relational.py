from __future__ import annotations

from pyspark.sql import functions as F

from partwise.operators import relational as P
from partwise.plans.registry import query
from partwise.session import table


@query("p01_projection", "SELECT c_custkey, c_name FROM customer")
def p01(spark, d):
    return P.project(table(spark, d, "customer"), ["c_custkey", "no_such", "c_name"])


@query("p02_comparisons", """
SELECT l_orderkey, l_linenumber FROM lineitem
WHERE l_quantity > 10 AND l_quantity <= 30 AND l_discount >= 0.05 AND l_tax < 0.06 AND l_returnflag IS DISTINCT FROM 'N' AND l_linestatus = 'F'""")
def p02(spark, d):
    rules = [("l_quantity", ">", 10), ("l_quantity", "<=", 30), ("l_discount", ">=", 0.05), ("l_tax", "<", 0.06),
             ("l_returnflag", "!=", "N"), ("l_linestatus", "==", "F")]
    conditions = [{"column": c, "operator": o, "value": v} for c, o, v in rules]
    return P.where_all(table(spark, d, "lineitem"), conditions).select("l_orderkey", "l_linenumber")


@query("p03_membership", """
SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O','P') AND coalesce(o_orderpriority NOT IN ('5-LOW','2-HIGH'), true)""")
def p03(spark, d):
    return P.where_all(table(spark, d, "orders"), [
        {"column": "o_orderstatus", "operator": "in", "value": ["O", "P"]},
        {"column": "o_orderpriority", "operator": "not_in", "value": ["5-LOW", "2-HIGH"]}]).select("o_orderkey")


@query("p04_contains_regex", "SELECT doc_id, lang FROM documents WHERE coalesce(regexp_matches(text, 'https?://|[0-9]{3}-[0-9]{4}'), false)")
def p04(spark, d):
    rule = {"column": "text", "operator": "contains", "value": "https?://|[0-9]{3}-[0-9]{4}"}
    return P.where_all(table(spark, d, "documents"), [rule]).select("doc_id", "lang")


@query("p05_drop_duplicates", """
SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1""")
def p05(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", F.md5("text").alias("copy_key"))
    return P.drop_duplicates(docs, ["copy_key"], [F.col("doc_id")]).drop("copy_key")


@query("p06_sort_nulls_last", """
SELECT nation, top, row_number() OVER (ORDER BY top DESC NULLS LAST, nation) AS pos FROM (
 SELECT n_name AS nation, round(max(s_acctbal) FILTER (WHERE s_acctbal > 9000), 2) AS top
 FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1) ORDER BY pos LIMIT 30""")
def p06(spark, d):
    best = (
        table(spark, d, "nation").join(table(spark, d, "supplier").filter("s_acctbal > 9000"),
                                       F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .groupBy(F.col("n_name").alias("nation")).agg(F.round(F.max("s_acctbal"), 2).alias("top"))
    )
    return P.sort(best, "top", ascending=False).limit(30).withColumn(
        "pos", F.expr("row_number() OVER (ORDER BY top DESC NULLS LAST, nation)").cast("bigint"))


@query("p07_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def p07(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return P.apply_filters(o.orderBy(F.desc("o_totalprice"), "o_orderkey"), {"limit": 25})


@query("p08_keyword_search", """
SELECT p_partkey, p_name, p_brand FROM part WHERE (p_name ILIKE '%RING%' OR p_brand ILIKE '%RING%') AND p_type = 'PROMO'
ORDER BY p_name, p_partkey LIMIT 50""")
def p08(spark, d):
    return P.keyword_search(table(spark, d, "part"), ["p_name", "p_brand"], "RING", {"p_type": "PROMO"},
                            ["p_name", "p_partkey"], 50).select("p_partkey", "p_name", "p_brand")


@query("p09_category_search", """
SELECT code, name, level FROM (
 SELECT DISTINCT p_type AS code, p_type AS name, 1 AS level FROM part UNION ALL
 SELECT DISTINCT p_type || '/' || p_name, p_name, 2 FROM part)
WHERE (code ILIKE '%gear%' OR name ILIKE '%gear%') AND level = 2 ORDER BY level, code LIMIT 100""")
def p09(spark, d):
    part = table(spark, d, "part")
    cats = part.select(F.col("p_type").alias("code"), F.col("p_type").alias("name"), F.lit(1).alias("level")).distinct().unionByName(
        part.select(F.concat_ws("/", "p_type", "p_name").alias("code"), F.col("p_name").alias("name"), F.lit(2).alias("level")).distinct())
    return P.keyword_search(cats, ["code", "name"], "gear", {"level": 2}, ["level", "code"], 100)


@query("p10_category_head", "SELECT p_partkey, p_name FROM part WHERE p_type = 'ECONOMY' ORDER BY p_partkey LIMIT 50")
def p10(spark, d):
    return P.keyword_search(table(spark, d, "part"), [], "", {"p_type": "ECONOMY"}, ["p_partkey"], 50).select("p_partkey", "p_name")


@query("p11_page_read", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 200")
def p11(spark, d):
    return P.page(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 50, 200)


@query("p12_result_log", """
SELECT event_id, CAST(user_id AS VARCHAR) AS session_id, event_type AS processing_type, CAST(props->>'k' AS INTEGER) AS k
FROM events WHERE user_id = 8 AND event_type = 'view'""")
def p12(spark, d):
    log = table(spark, d, "events").select(
        "event_id", F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("processing_type"),
        F.col("ts").alias("created_at"), F.col("props").alias("result"))
    found = P.result_log(log, session="8", kind="view", json_columns={"result": "k int"}, tie="event_id")
    return found.select("event_id", "session_id", "processing_type", F.col("result.k").alias("k"))
