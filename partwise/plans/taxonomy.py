from __future__ import annotations

from pyspark.sql import functions as F

from partwise.operators import sampling as N
from partwise.operators import taxonomy as H
from partwise.plans.items import ITEMS, items
from partwise.plans.registry import query
from partwise.session import table

RAW = """SELECT ' A' || chr(65 + r_regionkey) AS code, r_name AS name, 'root' AS template, CAST(r_regionkey AS BIGINT) AS seq FROM {region} UNION ALL
 SELECT 'A' || chr(65 + n_regionkey) || lpad(CAST(n_nationkey AS STRING), 2, '0'), n_name || ' ', '', CAST(1000 + n_nationkey AS BIGINT) FROM {nation} UNION ALL
 SELECT 'A' || chr(65 + n_regionkey) || lpad(CAST(n_nationkey AS STRING), 2, '0') || lpad(CAST(s_suppkey % 100 AS STRING), 2, '0'),
  CASE WHEN s_acctbal < 0 THEN ' ' ELSE s_name END, CASE WHEN s_acctbal > 5000 THEN 'rich' ELSE 'plain' END, 10000 + s_suppkey FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey"""
CATS = "raw AS (" + RAW.format(region="region", nation="nation", supplier="supplier") + """),
cats AS (SELECT trim(code) AS code, trim(name) AS name, template, seq, CASE WHEN length(trim(code)) <= 3 THEN 1 WHEN length(trim(code)) <= 5 THEN 2 ELSE 3 END AS level,
 CASE WHEN length(trim(code)) >= 4 THEN left(trim(code), -2) END AS parent_code FROM raw WHERE trim(name) <> ''
 QUALIFY row_number() OVER (PARTITION BY trim(code) ORDER BY seq DESC) = 1)"""


def raw(spark, d):
    return spark.sql(RAW.format(region="{region}", nation="{nation}", supplier="{supplier}"), region=table(spark, d, "region"),
                     nation=table(spark, d, "nation"), supplier=table(spark, d, "supplier"))


def cats(spark, d):
    return H.import_categories(raw(spark, d), "seq")


@query("h01_code_level", f"WITH {CATS} SELECT seq, CASE WHEN length(trim(code)) <= 3 THEN 1 WHEN length(trim(code)) <= 5 THEN 2 ELSE 3 END AS level FROM raw")
def h01(spark, d):
    return raw(spark, d).select("seq", H.level(F.col("code")).alias("level"))


@query("h02_parent_code", f"WITH {CATS} SELECT seq, CASE WHEN length(trim(code)) >= 4 THEN left(trim(code), -2) END AS parent_code FROM raw")
def h02(spark, d):
    code = F.trim("code")
    return raw(spark, d).select("seq", H.parent(code, H.level(code)).alias("parent_code"))


@query("h03_leaf_flag", f"WITH {CATS} SELECT code, code NOT IN (SELECT parent_code FROM cats WHERE parent_code IS NOT NULL) AS is_leaf FROM cats")
def h03(spark, d):
    return H.mark_leaves(cats(spark, d)).select("code", "is_leaf")


@query("h04_category_import", f"WITH {CATS} SELECT code, name, template, level, parent_code, seq AS sort_order FROM cats")
def h04(spark, d):
    return cats(spark, d).select("code", "name", "template", "level", "parent_code", "sort_order")


@query("h05_category_tree", f"""WITH RECURSIVE {CATS}, t(code, path, depth) AS (SELECT code, code, 1 FROM cats WHERE level = 1 UNION ALL
 SELECT c.code, t.path || '/' || c.code, t.depth + 1 FROM cats c JOIN t ON c.parent_code = t.code)
SELECT code, path, depth, coalesce((SELECT string_agg(k.code, ',' ORDER BY k.code) FROM cats k WHERE k.parent_code = t.code), '') AS children FROM t""")
def h05(spark, d):
    return H.tree(cats(spark, d)).select("code", "path", "depth", F.array_join("children", ",").alias("children"))


@query("h06_children", f"WITH {CATS} SELECT code, name, level FROM cats WHERE parent_code = 'AA'")
def h06(spark, d):
    return H.children_of(cats(spark, d), "AA").select("code", "name", "level")


@query("h07_taxonomy_statistics", f"""WITH {CATS} SELECT 'total' AS metric, count(*) AS value FROM cats
UNION ALL SELECT 'leaf', count(*) FILTER (WHERE code NOT IN (SELECT parent_code FROM cats WHERE parent_code IS NOT NULL)) FROM cats
UNION ALL SELECT 'level_' || level, count(*) FROM cats GROUP BY 1 UNION ALL SELECT 'template_' || template, count(*) FROM cats WHERE template <> '' GROUP BY 1
UNION ALL SELECT 'prefix_' || left(code, 1), count(*) FROM cats WHERE level = 1 GROUP BY 1
UNION ALL SELECT 'coverage', CAST(least(95, count(DISTINCT left(code, 1)) * 20) AS BIGINT) FROM cats WHERE level = 1 AND left(code, 1) IN ('A', 'B', 'C', 'D', 'E')""")
def h07(spark, d):
    c = H.mark_leaves(cats(spark, d))
    rate = H.coverage(c).select(F.lit("coverage").alias("metric"), F.col("coverage_rate").cast("bigint").alias("value"))
    return H.statistics(c).unionByName(rate)


@query("h08_feature_template", """
SELECT o_orderkey AS feature, CAST(row_number() OVER (ORDER BY o_orderkey) AS INTEGER) AS display_order, CAST(len(o_orderpriority) AS INTEGER) AS first_len FROM orders WHERE o_custkey = 7""")
def h08(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("feature"), F.to_json(F.array("o_orderpriority", "o_orderstatus")).alias("options"))
    listed = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("feature", "options"))).alias("l")).select(
        "o_custkey", F.posexplode("l").alias("pos", "x")).select("o_custkey", "x.feature", "x.options", (F.col("pos") + 1).alias("display_order"))
    return H.feature_template(listed, 7, "o_custkey").select("feature", "display_order", F.length(F.get("options", F.lit(0))).alias("first_len"))


@query("h09_level_groups", f"WITH {CATS} SELECT level, count(*) AS n, md5(string_agg(name, '|' ORDER BY name)) AS names FROM cats GROUP BY 1")
def h09(spark, d):
    return H.by_level(cats(spark, d)).select("level", "n", F.md5(F.array_join("names", "|")).alias("names"))


NOUNS = f"{ITEMS}, src AS (SELECT code AS id, CASE WHEN contains(name, '疏水器') THEN '疏水器' WHEN contains(name, '金属软管') THEN '金属软管' ELSE category END AS category FROM items)"


@query("n01_stratified_split", f"""WITH {NOUNS}, c AS (SELECT *, count(*) OVER (PARTITION BY category) AS k, count(*) OVER () AS total, md5('42:' || id) AS h FROM src),
w AS (SELECT *, greatest(1, least(floor(k * 0.3::DOUBLE), floor(2000 * k / total))) AS base FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY h, id) <= CASE WHEN category IN ('疏水器', '金属软管') THEN greatest(base, least(k, floor(k * 0.5::DOUBLE))) ELSE base END AS chosen FROM w)
SELECT id, category, CASE WHEN chosen THEN 'database' ELSE 'test' END AS part, chosen AND row_number() OVER (PARTITION BY chosen ORDER BY h, id) > 2000 AS dropped FROM r""")
def n01(spark, d):
    src = items(spark, d).select(F.col("code").alias("id"), F.expr(
        "CASE WHEN contains(name, '疏水器') THEN '疏水器' WHEN contains(name, '金属软管') THEN '金属软管' ELSE category END").alias("category"))
    return N.stratified_split(src, "id", "category")


@query("n02_head_tail", "SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey) <= 2000 THEN 'head' ELSE 'tail' END AS part FROM orders")
def n02(spark, d):
    return N.head_tail(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@query("n03_union_difference", """
SELECT c_custkey AS id, 'customer' AS source FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT s_suppkey, 'supplier' FROM supplier""")
def n03(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("source"))
    ordered = table(spark, d, "orders").select(F.col("o_custkey").alias("id"))
    return N.difference(c, ordered, ["id"]).unionByName(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("source")))
