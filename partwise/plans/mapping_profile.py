from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from partwise.operators import mapping as M
from partwise.operators import profiling as D
from partwise.plans.items import ITEMS, items
from partwise.plans.registry import query
from partwise.rules import headers as H
from partwise.rules import industry as I
from partwise.session import table

MED_HEADERS = {"p_partkey": "商品操作码", "p_name": "产品名称", "p_brand": "生产厂家", "p_type": "产品规格", "p_size": "医保代码"}


def headed(spark, d):
    return M.rename(table(spark, d, "part"), MED_HEADERS)


@query("m01_rename_by_table", 'SELECT p_partkey AS "商品操作码", p_name AS "产品名称", p_retailprice FROM part')
def m01(spark, d):
    return headed(spark, d).select("商品操作码", "产品名称", "p_retailprice")


@query("m02_best_template", "SELECT 'medical_device' AS template, count(*) AS n FROM part")
def m02(spark, d):
    df = headed(spark, d)
    return df.groupBy(F.lit(M.best_template(df.columns)).alias("template")).agg(F.count("*").alias("n"))


@query("m03_auto_mapping", """
SELECT CAST(p_partkey AS VARCHAR) AS material_id, p_name AS material_name, p_type AS specification, p_brand AS manufacturer,
       CAST(p_size AS VARCHAR) AS standard_code FROM part""")
def m03(spark, d):
    df = headed(spark, d)
    return M.apply_mapping(df, M.auto_mapping(df.columns))


@query("m04_standard_schema", """
SELECT p_partkey AS row_id, p_name AS material_name, p_brand AS brand, '' AS specification, '' AS manufacturer FROM part""")
def m04(spark, d):
    mapping = {"material_name": "p_name", "brand": "p_brand", "manufacturer": "no_such"}
    return M.apply_mapping(table(spark, d, "part").withColumn("row_id", F.col("p_partkey")), mapping, keep=["row_id"])


@query("m05_training_header_map", """
SELECT l_orderkey AS material_code, l_linenumber AS specification FROM lineitem""")
def m05(spark, d):
    df = table(spark, d, "lineitem").withColumnsRenamed({"l_orderkey": "order_code", "l_linenumber": "Spec_no"}).select("order_code", "Spec_no")
    return M.rename(df, {v: k for k, v in M.training_mapping(df.columns).items()})


@query("m06_industry_header_map", 'SELECT name AS material_name, spec AS specification, manufacturer FROM items'.replace("SELECT", f"WITH {ITEMS} SELECT", 1))
def m06(spark, d):
    df = items(spark, d).select(F.col("name").alias("物料名称"), F.col("spec").alias("规格型号"), F.col("manufacturer").alias("制造商"))
    return M.rename(df, {v: k for k, v in M.industry_mapping(df.columns, "manufacturing").items()})


@query("m07_identity_records", f"""
WITH {ITEMS} SELECT CASE WHEN size % 5 = 0 THEN format('MAT_{{:06d}}', row_number() OVER (ORDER BY code) - 1) ELSE CAST(code AS VARCHAR) END AS material_code,
 name AS material_name, spec AS specifications, manufacturer, type AS material_type, unit, '' AS source_system FROM items""")
def m07(spark, d):
    df = items(spark, d).select(
        F.col("code").alias("row"), F.when(F.expr("size % 5 <> 0"), F.col("code")).alias("code"), "name", "spec",
        F.col("manufacturer").alias("mfg"), "type", "unit")
    return M.identity_records(df, ["row"]).drop("raw_attributes")


@query("m08_first_nonblank", f"""
WITH {ITEMS} SELECT code, coalesce(nullif(trim(manufacturer), ''), nullif(trim(source), ''), '未知厂家') AS maker,
 regexp_replace(regexp_replace(trim(spec), '\\s+', ' ', 'g'), '[^\\p{{L}}\\p{{N}}_\\s\\-\\(\\)]', '', 'g') AS cleaned FROM items""")
def m08(spark, d):
    return items(spark, d).select("code", M.first_nonblank([F.col("manufacturer"), F.col("source")], "未知厂家").alias("maker"),
                                  M.clean_name(F.col("spec")).alias("cleaned"))


@query("m09_joined_specs", f"""
WITH {ITEMS} SELECT code, concat_ws(' | ', nullif(trim(spec), ''), type,
 CASE WHEN unit <> trim(spec) AND unit <> type THEN unit END) AS specification FROM items""")
def m09(spark, d):
    return items(spark, d).select("code", M.joined_distinct([F.col("spec"), F.col("type"), F.col("unit"), F.col("type")]).alias("specification"))


@query("m10_positional_records", f"""
WITH {ITEMS} SELECT code AS row_id, CAST(code AS VARCHAR) AS code, CASE WHEN trim(spec) <> '' THEN spec ELSE name END AS name, type AS category,
 CASE WHEN size % 3 = 1 THEN '' ELSE manufacturer END AS spec, '' AS unit FROM items WHERE size % 3 > 0""")
def m10(spark, d):
    cells = F.expr("""CASE WHEN size % 3 = 0 THEN array(string(code), spec)
      WHEN size % 3 = 1 THEN array(string(code), spec, name, type) ELSE array(string(code), spec, name, type, manufacturer) END""")
    return M.positional_records(items(spark, d).select(F.col("code").alias("row_id"), cells.alias("cells")), "cells")


@query("m11_compat_view", "SELECT p_partkey AS id, p_name AS title, p_retailprice AS price FROM part")
def m11(spark, d):
    return M.compat_view(table(spark, d, "part"), {"id": "p_partkey", "title": "p_name", "price": "p_retailprice"}, "pw_parts_compat")


@query("m12_flatten_matches", """
SELECT c_custkey AS input_c_custkey, coalesce(max(o_totalprice), 0.0) AS best_match_similarity,
 arg_max(o_orderkey, o_totalprice) AS best_match_id, CAST(count(o_orderkey) AS INTEGER) AS match_count, 'success' AS processing_status
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def m12(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("o_totalprice").alias("similarity"), F.col("o_orderkey").alias("id"))), asc=False).alias("matches"))
    found = table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").withColumn(
        "matches", F.coalesce("matches", F.array().cast("array<struct<similarity:double,id:bigint>>")))
    return M.flatten_matches(found, ["c_custkey"], "matches")


@query("m13_two_source_union", """
SELECT c_custkey AS id, c_name AS name, c_mktsegment AS specification, '' AS manufacturer, CAST(NULL AS VARCHAR) AS brand,
 c_name || ' ' || c_mktsegment || ' ' AS combined_text FROM customer
UNION ALL SELECT p_partkey, p_name, p_type, p_brand, p_brand, p_name || ' ' || p_type || ' ' || p_brand FROM part""")
def m13(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("spczm"), F.col("c_name").alias("产品名称"),
                                           F.col("c_mktsegment").alias("产品规格"), F.lit(None).cast("string").alias("生产厂家"))
    b = table(spark, d, "part").select(F.col("p_partkey").alias("资产代码"), F.col("p_name").alias("资产名称"), F.col("p_type").alias("规格型号"),
                                       F.col("p_brand").alias("生产厂家名称"), F.col("p_brand").alias("品牌"))
    return M.union_sources([
        (a, {"spczm": "id", "产品名称": "name", "产品规格": "specification", "生产厂家": "manufacturer"}),
        (b, {"资产代码": "id", "资产名称": "name", "规格型号": "specification", "生产厂家名称": "manufacturer", "品牌": "brand"})])


ORDER_FIELDS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
LONG = "long AS (" + " UNION ALL ".join(f"SELECT '{f}' AS field, CAST({f} AS VARCHAR) AS value FROM orders" for f in ORDER_FIELDS) + ")"


@query("d01_column_stats", f"""
WITH {LONG} SELECT field, count(*) FILTER (WHERE value IS NULL) AS null_count, count(DISTINCT value) AS distinct_count, count(*) AS row_count,
 CASE field WHEN 'o_orderkey' THEN 'bigint' WHEN 'o_custkey' THEN 'bigint' WHEN 'o_totalprice' THEN 'double' WHEN 'o_orderdate' THEN 'timestamp_ntz' ELSE 'string' END AS data_type
FROM long GROUP BY field""")
def d01(spark, d):
    return D.column_stats(table(spark, d, "orders"))


@query("d02_field_types", f"""
WITH {LONG} SELECT field, CASE WHEN count(*) FILTER (WHERE value <> '') = 0 THEN 'unknown'
 WHEN count(*) FILTER (WHERE TRY_CAST(regexp_replace(value, '[, ]', '', 'g') AS DOUBLE) IS NOT NULL) * 1.0 / count(*) > 0.7 THEN 'numeric'
 WHEN count(DISTINCT value) * 1.0 / count(*) < 0.1 THEN 'categorical' ELSE 'text' END AS field_type FROM long GROUP BY field""")
def d02(spark, d):
    return D.field_types(D.value_counts(table(spark, d, "orders")))


@query("d03_length_stats", f"""
WITH {LONG} SELECT field, CAST(min(length(value)) AS INTEGER) AS min_len, CAST(max(length(value)) AS INTEGER) AS max_len,
 round(avg(length(value)), 6) AS avg_len, round(stddev_pop(length(value)), 5) AS std_len FROM long WHERE trim(value) <> '' GROUP BY field""")
def d03(spark, d):
    s = D.length_stats(D.value_counts(table(spark, d, "orders")))
    return s.withColumns({"avg_len": F.round("avg_len", 6), "std_len": F.round("std_len", 5)})


@query("d04_pattern_flags", """
WITH long AS (SELECT 'text' AS field, text AS value FROM documents UNION ALL SELECT 'lang', lang FROM documents UNION ALL SELECT 'source', source FROM documents)
SELECT field, bool_or(regexp_matches(value, '[0-9]+')) AS contains_numbers, bool_or(regexp_matches(value, '[/\\-*+()]')) AS contains_special_chars,
 bool_or(regexp_matches(value, '(?i)[0-9]+\\s*(mm|cm|m|kg|g|ml|l)')) AS contains_units FROM long GROUP BY field""")
def d04(spark, d):
    long = D.long_form(table(spark, d, "documents"), ["text", "lang", "source"])
    return D.pattern_flags(long)


@query("d05_value_distribution", f"""
WITH {LONG}, c AS (SELECT field, value, count(*) AS n FROM long WHERE value <> '' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS rk FROM c)
SELECT field, CAST(sum(n) AS BIGINT) AS total_count, count(*) AS unique_count, CAST(0 AS BIGINT) AS blank_count,
 string_agg(value || ':' || n, '|' ORDER BY rk) FILTER (WHERE rk <= 5) AS most_common FROM r GROUP BY field""")
def d05(spark, d):
    return D.value_distribution(D.value_counts(table(spark, d, "orders")))


def _industry_sql() -> str:
    body = "'物料名称: ' || name || ', 规格型号: ' || spec || ', 制造商: ' || manufacturer"
    parts = []
    for i, (name, kinds) in enumerate(I.INDICATORS.items()):
        terms = []
        for kind, w in I.KIND_WEIGHTS.items():
            if kind == "patterns":
                hits = [f"len(regexp_extract_all(body, '(?i){p}'))" for p in kinds[kind]]
            else:
                hits = [f"(length(body) - length(replace(body, '{x}', ''))) / {len(x)}" for x in kinds[kind]]
            terms.append(f"least(sum({' + '.join(hits)}) * least(1.0, 100.0::DOUBLE / count(*)) / {len(kinds[kind])}, 1.0) * {w}")
        parts.append(f"SELECT {i} AS rank, '{name}' AS industry, round(CAST({' + '.join(terms)} AS DOUBLE), 6) AS score FROM b")
    return f"WITH {ITEMS}, b AS (SELECT {body} AS body FROM items) " + " UNION ALL ".join(parts)


def source_rows(spark, d):
    return items(spark, d).select(F.col("name").alias("物料名称"), F.col("spec").alias("规格型号"), F.col("manufacturer").alias("制造商"))


@query("d06_industry_scores", _industry_sql())
def d06(spark, d):
    return D.industry_scores(source_rows(spark, d)).withColumn("score", F.round("score", 6))


SOURCE_LONG = f"""{ITEMS}, long AS (SELECT '物料名称' AS field, name AS value FROM items UNION ALL SELECT '规格型号', spec FROM items
 UNION ALL SELECT '制造商', manufacturer FROM items)"""
QUALITY = """q AS (SELECT field, count(*) FILTER (WHERE trim(value) <> '') * 1.0::DOUBLE / count(*) AS completeness,
 greatest(0.0, 1 - count(DISTINCT regexp_replace(value, '[0-9]+', 'N', 'g')) * 1.0::DOUBLE / count(*)) AS consistency FROM long GROUP BY field)"""


@query("d07_source_quality", f"WITH {SOURCE_LONG}, {QUALITY} SELECT field, round(completeness, 6) AS completeness, round(consistency, 6) AS consistency FROM q")
def d07(spark, d):
    q = D.source_quality(D.value_counts(source_rows(spark, d)))
    return q.withColumns({"completeness": F.round("completeness", 6), "consistency": F.round("consistency", 6)})


@query("d08_source_schema", f"""
WITH {SOURCE_LONG}, {QUALITY}, s AS ({_industry_sql().replace(f"WITH {ITEMS}, b AS", "WITH b AS")})
SELECT 'parts' AS source_id, (SELECT arg_max(industry, score) FROM s) AS industry_type, (SELECT round(max(score), 5) FROM s) AS confidence,
 '规格型号' AS spec_field, round(avg(completeness) * 0.6 + avg(consistency) * 0.4, 6) AS overall_quality, count(*) AS field_count FROM q""")
def d08(spark, d):
    s = D.source_schema(source_rows(spark, d), "parts")
    return s.select("source_id", "industry_type", F.round("confidence_score", 5).alias("confidence"),
                    F.col("field_mappings")["specification"].alias("spec_field"),
                    F.round("quality_metrics.overall_quality", 6).alias("overall_quality"), F.col("quality_metrics.field_count").alias("field_count"))


COMBO_FIELDS = {"material_name": "name", "specification": "spec", "manufacturer": "manufacturer", "source": "source", "unit": "unit"}
NOT_EMPTY = " <> ''"
COMBOS = [c for k in (2, 3) for c in combinations(sorted(COMBO_FIELDS), k)]
COMBO_SQL = "combos AS (" + " UNION ALL ".join(
    f"SELECT '{','.join(c)}' AS fields, count(*) FILTER (WHERE {' AND '.join(COMBO_FIELDS[f] + NOT_EMPTY for f in c)}) * 1.0::DOUBLE / count(*) AS support FROM items"
    for c in COMBOS) + ")"


def combo_rows(spark, d):
    return D.field_combinations(items(spark, d).select(*[F.col(c).alias(f) for f, c in COMBO_FIELDS.items()]), list(COMBO_FIELDS))


@query("d09_field_combinations", f"WITH {ITEMS}, {COMBO_SQL} SELECT fields, round(support, 6) AS support FROM combos WHERE support > 0")
def d09(spark, d):
    return combo_rows(spark, d).withColumn("support", F.round("support", 6))


WEIGHT_CASE = "CASE f " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in D.BASE_FIELD_WEIGHTS.items()) + f" ELSE {D.DEFAULT_FIELD_WEIGHT} END"


@query("d10_combination_weights", f"""
WITH {ITEMS}, {COMBO_SQL}, x AS (SELECT fields, support, unnest(string_split(fields, ',')) AS f FROM combos WHERE support > 0.3)
SELECT fields, round(support, 6) AS support, f AS field, round(CAST({WEIGHT_CASE} AS DOUBLE) / sum(CAST({WEIGHT_CASE} AS DOUBLE)) OVER (PARTITION BY fields), 6) AS weight FROM x""")
def d10(spark, d):
    w = D.combination_weights(combo_rows(spark, d))
    return w.withColumns({"support": F.round("support", 6), "weight": F.round("weight", 6)})
