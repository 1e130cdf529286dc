from __future__ import annotations

from pyspark.sql import functions as F

from partwise.operators import training as T
from partwise.plans.items import ITEMS, MED_ITEMS, items, med_items
from partwise.plans.registry import query
from partwise.plans.text_features import q, sql_any, sql_first
from partwise.rules import dedup as DR
from partwise.rules import training as R
from partwise.session import table

WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')"


@query("t01_token_frequency", f"""SELECT token, count(*) AS n FROM (SELECT unnest({WORDS}) AS token FROM documents UNION ALL SELECT unnest({WORDS}) FROM benchmark) GROUP BY 1 HAVING count(*) >= 5""")
def t01(spark, d):
    both = table(spark, d, "documents").select("text").unionByName(table(spark, d, "benchmark").select("text"))
    return T.token_frequency(both, "text")


MAKERS = f"{ITEMS}, {MED_ITEMS}, mk AS (SELECT DISTINCT manufacturer FROM (SELECT manufacturer FROM items UNION ALL SELECT manufacturer FROM med UNION ALL SELECT s_name || CASE s_suppkey % 3 WHEN 0 THEN '电子' WHEN 1 THEN '重工' ELSE '' END FROM supplier) WHERE manufacturer <> '')"
MAKER_CASE = sql_first("lower(manufacturer)", R.MAKER_RULES, q(R.MAKER_DEFAULT))


def makers(spark, d):
    s = table(spark, d, "supplier").select(F.expr("s_name || CASE s_suppkey % 3 WHEN 0 THEN '电子' WHEN 1 THEN '重工' ELSE '' END").alias("manufacturer"))
    return items(spark, d).select("manufacturer").unionByName(med_items(spark, d).select("manufacturer")).unionByName(s)


@query("t02_maker_categories", f"WITH {MAKERS} SELECT manufacturer, {MAKER_CASE} AS category FROM mk")
def t02(spark, d):
    return T.maker_categories(makers(spark, d), "manufacturer")


@query("t03_spec_buckets", f"WITH {ITEMS} " + " UNION ALL ".join(
    f"SELECT spec, '{b}' AS bucket, count(*) AS n FROM items WHERE regexp_matches(spec, {q(p)}) GROUP BY 1" for b, p in R.SPEC_BUCKETS.items()))
def t03(spark, d):
    return T.spec_buckets(items(spark, d), "spec").groupBy("spec", "bucket").agg(F.count("*").alias("n"))


FIXED = " UNION ALL ".join([f"SELECT 'keyword' AS rule_type, '{c}' AS category, {len(ks)} AS n, '{min(ks)}' AS first_key, 0.7::DOUBLE AS confidence" for c, ks in R.KEYWORD_RULES.items()]
                           + [f"SELECT 'specification', '{c}', {len(ks)}, '{min(ks)}', 0.6::DOUBLE" for c, ks in R.SPEC_RULES.items()])


@query("t04_rule_table", f"WITH {MAKERS}, m AS (SELECT manufacturer, {MAKER_CASE} AS category FROM mk) {FIXED} UNION ALL SELECT 'manufacturer', category, CAST(count(*) AS INTEGER), min(manufacturer), 0.75::DOUBLE FROM m GROUP BY category")
def t04(spark, d):
    rules = T.regroup_rules(T.rule_table(T.maker_categories(makers(spark, d), "manufacturer")))
    first = F.get("rules", F.lit(0))
    return rules.select("rule_type", "category", F.size("rules").alias("n"), first["rule_key"].alias("first_key"), first["confidence"].alias("confidence"))


@query("t05_domain_keywords", f"""WITH {MED_ITEMS}, f AS (SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(name), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS token FROM med) GROUP BY 1 ORDER BY n DESC, token LIMIT 100),
g AS (SELECT *, row_number() OVER (ORDER BY n DESC, token) AS rank FROM f WHERE {sql_any("token", R.DOMAIN_WORDS)})
SELECT token, n, '医疗器械' AS category FROM g WHERE rank <= 20 UNION ALL """ + " UNION ALL ".join(
    f"SELECT token, n, '{c}' FROM g WHERE {sql_any('token', ws)}" for c, ws in R.DOMAIN_LISTS.items()))
def t05(spark, d):
    return T.domain_keywords(med_items(spark, d), "name")


@query("t06_training_import", """
SELECT c_name AS material_name, c_custkey AS material_code, c_mktsegment AS category, CAST(NULL AS VARCHAR) AS specification FROM customer
UNION ALL SELECT p_name, p_partkey, p_brand, p_type FROM part WHERE p_size <> 7""")
def t06(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("编号"), F.col("c_name").alias("名称"), F.col("c_mktsegment").alias("分类"))
    b = table(spark, d, "part").select(F.col("p_partkey").alias("Part Code"), F.when(F.col("p_size") == 7, " ").otherwise(F.col("p_name")).alias("Name"),
                                       F.col("p_brand").alias("Category"), F.col("p_type").alias("型号"))
    return T.import_training([a, b])


LABELLED = """lab AS (SELECT code, name AS material_name, spec AS specification, manufacturer, category AS predicted_category, (0.5 + size / 100.0)::DOUBLE AS confidence_score,
 CASE WHEN quality = 1 THEN 'correct' WHEN toxic = 1 THEN NULL ELSE 'incorrect' END AS user_feedback, size AS age FROM items JOIN labels ON doc_id = code)"""
KEPT = f"{ITEMS}, {LABELLED}, kept AS (SELECT * FROM lab WHERE age <= 30 AND user_feedback IS NOT NULL)"
FEATURES = KEPT + f""", feat AS (SELECT code, confidence_score AS confidence, least(1.0, 0.8 + CASE WHEN {sql_any("lower(material_name)", R.CATEGORY_WORDS)} THEN 0.1 ELSE 0 END)::DOUBLE AS consistency,
 (CASE WHEN length(trim(material_name)) > 2 THEN 0.4 ELSE 0 END + CASE WHEN length(trim(specification)) > 2 THEN 0.3 ELSE 0 END + CASE WHEN length(trim(manufacturer)) > 2 THEN 0.2 ELSE 0 END
  + CASE WHEN length(trim(predicted_category)) > 1 THEN 0.1 ELSE 0 END)::DOUBLE AS completeness,
 least(1.0, confidence_score * 0.6 + CASE WHEN contains(lower(material_name), lower(predicted_category)) OR contains(lower(predicted_category), lower(material_name)) THEN 0.3 ELSE 0 END + 0.1)::DOUBLE AS accuracy,
 least(1.0, 0.7 + CASE WHEN {sql_any("specification", R.SPEC_MARKS)} THEN 0.2 ELSE 0 END)::DOUBLE AS compliance, CASE WHEN user_feedback = 'correct' THEN 1 ELSE 0 END AS label FROM kept)"""
CANDIDATES = T.weight_candidates()


def history(spark, d):
    asof = F.expr("timestamp_ntz'2024-03-01'")
    rows = items(spark, d).join(table(spark, d, "labels"), F.col("code") == F.col("doc_id"))
    log = rows.select("code", F.col("name").alias("material_name"), F.col("spec").alias("specification"), "manufacturer", F.col("category").alias("predicted_category"),
                      (0.5 + F.col("size") / 100.0).alias("confidence_score"), (asof - F.make_dt_interval(F.col("size"))).alias("created_at"),
                      F.when(F.col("quality") == 1, "correct").when(F.col("toxic") == 1, None).otherwise("incorrect").alias("user_feedback"))
    return T.labelled_history(log, asof, 30)


@query("w01_labelled_history", f"WITH {KEPT} SELECT code, user_feedback FROM kept")
def w01(spark, d):
    return history(spark, d).select("code", "user_feedback")


NAMES = ["confidence", "consistency", "completeness", "accuracy", "compliance"]


@query("w02_quality_features", f"WITH {FEATURES} SELECT code, {', '.join(f'round({c}, 6) AS {c}' for c in NAMES)}, label FROM feat")
def w02(spark, d):
    return T.quality_features(history(spark, d)).select("code", *[F.round(c, 6).alias(c) for c in NAMES], "label")


@query("w03_weight_search", f"WITH {FEATURES} " + " UNION ALL ".join(
    f"SELECT {i} AS candidate, round(avg(CASE WHEN (round({' + '.join(f'{k} * {v}::DOUBLE' for k, v in w.items())}, 9) >= 0.75) = (label = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM feat"
    for i, w in enumerate(CANDIDATES)))
def w03(spark, d):
    return T.search_weights(T.quality_features(history(spark, d)), CANDIDATES).select("candidate", F.round("accuracy", 6).alias("accuracy"))


@query("w04_cross_validation")
def w04(spark, d):
    folds = T.cross_validate(T.quality_features(history(spark, d)), CANDIDATES[0], "code")
    return spark.createDataFrame([(i, a) for i, a in enumerate(folds)], "fold int, accuracy double")


@query("w05_weight_adoption", f"""
WITH {FEATURES}, acc AS (""" + " UNION ALL ".join(
    f"SELECT {i} AS candidate, avg(CASE WHEN (round({' + '.join(f'{k} * {v}::DOUBLE' for k, v in w.items())}, 9) >= 0.75) = (label = 1) THEN 1.0 ELSE 0.0 END) AS a FROM feat"
    for i, w in enumerate(CANDIDATES)) + """), b AS (SELECT (SELECT a FROM acc WHERE candidate = 0) AS base, (SELECT max(a) FROM acc) AS best)
SELECT round(best - base, 6)::DOUBLE AS improvement, best - base > 0.02 AS adopted FROM b""")
def w05(spark, d):
    ranked = T.search_weights(T.quality_features(history(spark, d)), CANDIDATES)
    return T.adopt(ranked).select(F.round("improvement", 6).alias("improvement"), "adopted")


STEP = {k: R.FEEDBACK_STEP * (2 if k == "name" else 1) for k in DR.WEIGHTS}


@query("w06_feedback_weights", f"""
WITH m AS (SELECT ts, event_id, CASE WHEN event_type IN ('click', 'view') AND least(value / 50, 1) < 0.8 THEN 1 WHEN event_type = 'error' AND least(value / 50, 1) > 0.7 THEN -1 END AS mv FROM events),
s AS (SELECT mv, coalesce(sum(CASE WHEN mv = 1 THEN 1 ELSE 0 END) OVER w, 0) AS p, coalesce(sum(CASE WHEN mv = -1 THEN 1 ELSE 0 END) OVER w, 0) AS q FROM m WHERE mv IS NOT NULL
 WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT exp(max(p) * ln(1 / 1.35) + max(q) * ln(1 / 0.65)) AS a, sum(mv * exp(p * ln(1 / 1.35) + q * ln(1 / 0.65))) AS b FROM s)
""" + " UNION ALL ".join(f"SELECT '{k}' AS field, round(a * {w} + b * {STEP[k]}, 6)::DOUBLE AS weight FROM f" for k, w in DR.WEIGHTS.items()))
def w06(spark, d):
    log = table(spark, d, "events").select(
        "ts", "event_id", F.expr("CASE WHEN event_type IN ('click', 'view') THEN 'merge' WHEN event_type = 'error' THEN 'separate' END").alias("decision"),
        F.least(F.col("value") / 50, F.lit(1.0)).alias("confidence_before"))
    return T.feedback_weights(log, ["ts", "event_id"]).withColumn("weight", F.round("weight", 6))
