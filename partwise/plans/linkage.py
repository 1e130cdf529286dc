from __future__ import annotations

from pyspark.sql import functions as F

from partwise.functions import tfidf as V
from partwise.functions.text import maker_fingerprint
from partwise.operators import matching as J
from partwise.operators.dedup import maker_similarity
from partwise.operators.mapping import flatten_matches
from partwise.plans import tfidf_sql as S
from partwise.plans.items import ITEMS, items
from partwise.plans.registry import query
from partwise.plans.text_features import sql_all
from partwise.rules.extraction import SPEC_FEATURES
from partwise.session import table

NEW = "SELECT item_id AS id, text FROM benchmark"
MASTER = "SELECT doc_id AS id, text FROM documents"
ROWS = "SELECT count(*) FROM documents"
FIELD = J.MatchConfig("item_id", "doc_id", [("text", "text")])
ONE_TEXT = J.MatchConfig("item_id", "doc_id", [("text", "text")], describe=False, vectoriser=V.BASELINE)
SIMILAR = J.MatchConfig("item_id", "doc_id", [("text", "text")], describe=False, vectoriser=V.SIMILAR)
COS = S.cosine(NEW, MASTER, ROWS, V.FIELD_MATCH)


def passages(spark, d):
    return table(spark, d, "benchmark")


def documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def doc_counts(spark, d, vectorisers):
    rows = documents(spark, d)
    counts = V.term_counts(V.profiles(rows, {f: F.col("text") for f in vectorisers}), vectorisers)
    return rows, counts


CONFIGS = {"baseline": V.BASELINE, **V.CAPPED}


@query("e22_vocabularies", "WITH " + ", ".join(
    S.grams(f"{k}_tf", MASTER, v) + ", " + S.vocabulary(f"{k}_v", f"{k}_tf", ROWS, v) for k, v in CONFIGS.items()) + " " + " UNION ALL ".join(
    f"SELECT '{k}' AS vectoriser, count(*) AS terms, round(sum(idf), 4) AS idf_sum FROM {k}_v" for k in CONFIGS))
def e22_vocab(spark, d):
    rows = documents(spark, d)
    bounded = {k: v for k, v in CONFIGS.items() if v.max_features}
    both = V.frequent_terms(rows, "text", bounded).unionByName(V.row_vocabulary(rows, "text", "baseline", V.BASELINE))
    return both.groupBy(F.col("field").alias("vectoriser")).agg(F.count("*").alias("terms"), F.round(F.sum("idf"), 4).alias("idf_sum"))


@query("e22_tfidf_weights", "WITH " + ", ".join([
    S.grams("m_tf", MASTER, V.CAPPED["field_match"]), S.vocabulary("voc", "m_tf", ROWS, V.CAPPED["field_match"]), S.weights("m_w", "m_tf", "voc")])
    + " SELECT id AS doc_id, term, round(w, 6) AS weight FROM m_w")
def e22(spark, d):
    w = V.capped_weights(documents(spark, d), "doc_id", "text", V.CAPPED["field_match"])
    return w.select("doc_id", "term", F.round("w", 6).alias("weight"))


BLOCK_NEW = """SELECT s_suppkey, CASE WHEN s_acctbal >= 0 THEN CAST(s_nationkey AS STRING) ELSE '' END AS nation,
 CASE WHEN s_acctbal > 5000 THEN 'BUILDING' ELSE '' END AS segment FROM {t}"""


@query("j01_conditional_blocking", f"""
WITH n AS ({BLOCK_NEW.format(t='supplier')}) SELECT s_suppkey AS id, count(c_custkey) AS candidates
FROM n LEFT JOIN customer ON (nation = '' OR nation = CAST(c_nationkey AS VARCHAR)) AND (segment = '' OR segment = c_mktsegment) GROUP BY 1""")
def j01(spark, d):
    new = spark.sql(BLOCK_NEW.format(t="{s}"), s=table(spark, d, "supplier"))
    cfg = J.MatchConfig("s_suppkey", "c_custkey", [], [("nation", "c_nationkey"), ("segment", "c_mktsegment")])
    return J.candidate_counts(new, table(spark, d, "customer"), cfg)


@query("j02_field_cosine", f"WITH {COS} SELECT new_id, master_id, round(s, 6) AS score FROM cos WHERE s >= 0.3")
def j02(spark, d):
    m = J.Matcher(passages(spark, d), documents(spark, d), FIELD, 0.3)
    scored = m.score(m.candidates(0.3)).select("n_pk", "m_pk", F.round("s_f0", 9).alias("s")).filter("s >= 0.3")
    return J.expand_pairs(m, scored).select("new_id", "master_id", F.round("s", 6).alias("score"))


@query("j03_weighted_mean", f"""
WITH {COS} SELECT new_id, master_id, round(s, 6) AS s_f0, round(s, 6) AS s_description, round((0.8 * s + 0.6 * s) / 1.4, 6) AS similarity FROM cos WHERE s >= 0.4""")
def j03(spark, d):
    m = J.Matcher(passages(spark, d), documents(spark, d), FIELD, 0.4)
    scored = m.combined(m.score(m.candidates(0.4))).filter(F.round("similarity", 9) >= 0.4)
    out = J.expand_pairs(m, scored)
    return out.select("new_id", "master_id", *[F.round(c, 6).alias(c) for c in ("s_f0", "s_description", "similarity")])


TOP = "row_number() OVER (PARTITION BY new_id ORDER BY s DESC, master_id)"


@query("j04_threshold_topn", f"""
WITH {COS} SELECT new_id, master_id, CAST({TOP} AS INTEGER) AS rank, round(s, 6) AS similarity, round(s, 4) AS text_similarity FROM cos WHERE s >= 0.3
QUALIFY rank <= 5""")
def j04(spark, d):
    found = J.match(passages(spark, d), documents(spark, d), FIELD, 0.3, 5).withColumn("details", J.match_details(FIELD))
    return found.select("new_id", "master_id", "rank", F.round("similarity", 6).alias("similarity"), F.col("details")["f0_similarity"].alias("text_similarity"))


CAPPED = J.MatchConfig("item_id", "doc_id", [("text", "text")], vectoriser=V.CAPPED["field_match"])


@query("j04_threshold_topn_capped", f"""
WITH {S.cosine(NEW, MASTER, ROWS, V.CAPPED["field_match"])} SELECT new_id, master_id, CAST({TOP} AS INTEGER) AS rank, round(s, 6) AS similarity FROM cos WHERE s >= 0.3
QUALIFY rank <= 5""")
def j04_capped(spark, d):
    """The match over the most frequent terms only, as an explicit choice."""
    return J.match(passages(spark, d), documents(spark, d), CAPPED, 0.3, 5).select("new_id", "master_id", "rank", F.round("similarity", 6).alias("similarity"))


@query("j05_baseline_top3", f"""
WITH {S.cosine(NEW, MASTER, ROWS, V.BASELINE)}, a AS (SELECT item_id AS new_id, doc_id AS master_id, coalesce(s, 0.0) AS s FROM benchmark CROSS JOIN documents
 LEFT JOIN cos ON cos.new_id = item_id AND cos.master_id = doc_id)
SELECT new_id, master_id, CAST({TOP} AS INTEGER) AS rank, round(s, 6) AS similarity FROM a QUALIFY rank <= 3""")
def j05(spark, d):
    out = J.match_baseline(passages(spark, d), documents(spark, d), ONE_TEXT, 3)
    return out.withColumn("similarity", F.round("similarity", 6))


@query("j06_batch_match_lists", f"""
WITH {COS}, t AS (SELECT *, {TOP} AS rank FROM cos WHERE s >= 0.3 QUALIFY rank <= 3)
SELECT item_id AS input_item_id, coalesce(round(max(s), 6), 0.0) AS best_match_similarity, max(master_id) FILTER (WHERE rank = 1) AS best_match_id,
 CAST(count(master_id) AS INTEGER) AS match_count, 'success' AS processing_status FROM benchmark LEFT JOIN t ON new_id = item_id GROUP BY 1""")
def j06(spark, d):
    new = passages(spark, d)
    lists = J.match_lists(J.match(new, documents(spark, d), FIELD, 0.3, 3), new, "item_id")
    return flatten_matches(lists, ["item_id"], "matches").withColumn("best_match_similarity", F.round("best_match_similarity", 6))


COS_SIMILAR = S.cosine(NEW, MASTER, ROWS, V.SIMILAR)


@query("j07_similar_search", f"""
WITH {COS_SIMILAR} SELECT new_id, master_id, CAST({TOP} AS INTEGER) AS rank, round(s, 6) AS similarity, CAST(floor(s * 100) AS INTEGER) AS percent
FROM cos WHERE s >= 0.3 QUALIFY rank <= 10""")
def j07(spark, d):
    out = J.find_similar(passages(spark, d), documents(spark, d), SIMILAR, 0.3, 10)
    return out.withColumn("similarity", F.round("similarity", 6))


SAMPLE = "SELECT doc_id AS item_id, text FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 10"


@query("j08_threshold_advice", f"""
WITH smp AS ({SAMPLE}), {S.cosine("SELECT item_id AS id, text FROM smp", MASTER, ROWS, V.SIMILAR)},
t AS (SELECT *, {TOP} AS rank FROM cos WHERE s > 0 QUALIFY rank <= 20)
SELECT round(quantile_cont(s, 0.25), 6) AS low, round(quantile_cont(s, 0.5), 6) AS medium, round(quantile_cont(s, 0.75), 6) AS high FROM t""")
def j08(spark, d):
    docs = documents(spark, d)
    sample = docs.orderBy(F.md5(F.concat(F.lit("7:"), "doc_id")), "doc_id").limit(10).withColumnRenamed("doc_id", "item_id")
    out = J.recommend_threshold(sample, docs, SIMILAR, 20)
    return out.select(*[F.round(c, 6).alias(c) for c in ("low", "medium", "high")])


NAME_COS = S.cosine("SELECT s_suppkey AS id, s_name AS text FROM supplier", "SELECT c_custkey AS id, c_name AS text FROM customer",
                    "SELECT count(*) FROM customer", V.BASELINE)


@query("j09_best_strategy", f"""
WITH {NAME_COS}, e AS (SELECT s_suppkey AS source_id, c_custkey AS target_id, 1.0::DOUBLE AS confidence, 'exact_code' AS strategy, 0 AS o
  FROM supplier JOIN customer ON s_suppkey = c_custkey WHERE s_acctbal > 0),
t AS (SELECT new_id, master_id, s, 'text_similarity', 1 FROM cos WHERE s >= 0.5),
b AS (SELECT * FROM (SELECT * FROM e UNION ALL SELECT * FROM t) QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY confidence DESC, o, target_id) = 1)
SELECT s_suppkey AS source_id, target_id, round(coalesce(confidence, 0.0), 6) AS confidence, coalesce(strategy, 'none') AS strategy
FROM supplier LEFT JOIN b ON s_suppkey = source_id""")
def j09(spark, d):
    s = table(spark, d, "supplier").withColumn("standard_code", F.when(F.col("s_acctbal") > 0, F.col("s_suppkey")))
    c = table(spark, d, "customer").withColumn("standard_code", F.col("c_custkey"))
    cfg = J.MatchConfig("s_suppkey", "c_custkey", [("s_name", "c_name")], describe=False, vectoriser=V.BASELINE)
    found = [J.STRATEGIES[k](s, c, "s_suppkey", "c_custkey", cfg) for k in ("exact_code", "text_similarity")]
    return J.best_match(s, found, "s_suppkey").withColumn("confidence", F.round("confidence", 6))


#: Two systems write the same maker differently; the fingerprint drops the company form.
SRC_MAKER = "CASE WHEN p_size % 7 = 0 THEN '' ELSE replace(p_brand, '#', '') || '阀门有限公司' END"
TGT_MAKER = "CASE WHEN p_size % 5 = 0 THEN NULL ELSE replace(p_brand, '#', ' ') || '阀门 制造' END"
SPEC_SETS = "list_distinct(flatten([" + ", ".join(
    f"list_transform({sql_all('lower(specification)', [(p, 1) for p in ps], '')}, lambda x: '{k}=' || x)" for k, ps in SPEC_FEATURES.items()) + "]))"
SIDES = f"""{ITEMS}, src AS (SELECT code AS source_id, name, spec AS specification, CASE WHEN size % 3 = 0 THEN code + 1 END AS standard_code, lower(replace(maker, '有限公司', '')) AS maker
  FROM items JOIN (SELECT p_partkey AS code, {SRC_MAKER} AS maker FROM part) USING (code) WHERE source = 'ERP'),
tgt AS (SELECT code AS target_id, name, spec AS specification, code AS standard_code, lower(replace(maker, ' ', '')) AS maker
  FROM items JOIN (SELECT p_partkey AS code, {TGT_MAKER} AS maker FROM part) USING (code) WHERE source = 'PLM')"""
PART_COS = S.cosine("SELECT source_id AS id, name AS text FROM src", "SELECT target_id AS id, name AS text FROM tgt", "SELECT count(*) FROM tgt", V.BASELINE)
FOUR = f"""{SIDES}, {PART_COS}, {S.ratio("mr", "SELECT DISTINCT s.maker AS a, t.maker AS b FROM src s, tgt t WHERE s.maker <> '' AND t.maker <> ''")},
ss AS (SELECT source_id, list_sort({SPEC_SETS}) AS f FROM src), ts AS (SELECT min(target_id) AS target_id, list_sort({SPEC_SETS}) AS f FROM tgt GROUP BY 2),
sd AS (SELECT DISTINCT f FROM ss), sp AS (SELECT sd.f, target_id, len(list_intersect(sd.f, ts.f)) * 1.0::DOUBLE / len(list_distinct(sd.f || ts.f)) AS c FROM sd, ts WHERE len(list_intersect(sd.f, ts.f)) > 0),
e AS (SELECT source_id, target_id, 1.0::DOUBLE AS confidence, 'exact_code' AS strategy, 0 AS o FROM src JOIN tgt USING (standard_code)),
x AS (SELECT new_id AS source_id, master_id AS target_id, s AS confidence, 'text_similarity' AS strategy, 1 AS o FROM cos WHERE s >= 0.5
  QUALIFY row_number() OVER (PARTITION BY new_id ORDER BY s DESC, master_id) <= 5),
p AS (SELECT source_id, target_id, round(c, 9) AS confidence, 'specification' AS strategy, 2 AS o FROM ss JOIN (
  SELECT * FROM sp WHERE c >= 0.6 QUALIFY row_number() OVER (PARTITION BY f ORDER BY round(c, 9) DESC, target_id) = 1) USING (f)),
k AS (SELECT source_id, target_id, round(ratio, 9) AS confidence, 'manufacturer' AS strategy, 3 AS o FROM src JOIN (
  SELECT a AS maker, target_id, ratio FROM mr JOIN (SELECT maker, min(target_id) AS target_id FROM tgt GROUP BY 1) t ON t.maker = b WHERE ratio >= 0.8 - 1e-9
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(ratio, 9) DESC, target_id) = 1) USING (maker)),
found AS (SELECT * FROM e UNION ALL SELECT * FROM x UNION ALL SELECT * FROM p UNION ALL SELECT * FROM k)"""


def two_systems(spark, d):
    part = table(spark, d, "part")
    rows = items(spark, d).join(part.select(F.col("p_partkey").alias("code"), F.expr(SRC_MAKER).alias("here"), F.expr(TGT_MAKER).alias("there")), "code")
    rows = rows.withColumnRenamed("spec", "specification")
    src = rows.filter("source = 'ERP'").select(F.col("code").alias("source_id"), "name", "specification", F.col("here").alias("manufacturer"), F.when(F.col("size") % 3 == 0, F.col("code") + 1).alias("standard_code"))
    tgt = rows.filter("source = 'PLM'").select(F.col("code").alias("target_id"), "name", "specification", F.col("there").alias("manufacturer"), F.col("code").alias("standard_code"))
    return src, tgt


def strategies_run(spark, d):
    src, tgt = two_systems(spark, d)
    cfg = J.MatchConfig("source_id", "target_id", [("name", "name")], describe=False, vectoriser=V.BASELINE)
    return src, [fn(src, tgt, "source_id", "target_id", cfg) for fn in J.STRATEGIES.values()]


@query("j09_four_strategies", f"""
WITH RECURSIVE {FOUR}, b AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY confidence DESC, o, target_id) = 1)
SELECT src.source_id, target_id, round(coalesce(confidence, 0.0), 6) AS confidence, coalesce(strategy, 'none') AS strategy FROM src LEFT JOIN b USING (source_id)""")
def j09_four(spark, d):
    src, found = strategies_run(spark, d)
    return J.best_match(src, found, "source_id").withColumn("confidence", F.round("confidence", 6))


@query("u01_all_strategies", f"WITH RECURSIVE {FOUR} SELECT source_id, target_id, round(confidence, 6) AS confidence, strategy FROM found")
def u01_all(spark, d):
    _, found = strategies_run(spark, d)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.withColumn("confidence", F.round("confidence", 6))


@query("j10_maker_similarity", f"""WITH RECURSIVE p AS (SELECT DISTINCT regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS a,
  regexp_replace(lower(regexp_replace(s_name, 'Supplier#0*', 'Brand#')), '[^a-z0-9]', '', 'g') AS b FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
{S.ratio("r", "SELECT a, b FROM p")} SELECT a, b, round(ratio, 6) AS similarity FROM r""")
def j10(spark, d):
    li, p, s = (table(spark, d, t) for t in ("lineitem", "part", "supplier"))
    pairs = li.join(p, F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(
        maker_fingerprint(F.col("p_brand")).alias("a"), maker_fingerprint(F.regexp_replace("s_name", "Supplier#0*", "Brand#")).alias("b")).distinct()
    return pairs.withColumn("similarity", F.round(maker_similarity(F.col("a"), F.col("b")), 6))


MAPPING = """SELECT p_type AS original_category, max(p_brand) AS standard_category, round(count(*) * 1.0 / 10000, 6) AS confidence
FROM {t} WHERE p_type <> 'PROMO' GROUP BY 1"""


@query("j20_category_lookup", f"""
WITH m AS ({MAPPING.format(t='part')}) SELECT p_partkey, coalesce(standard_category, p_type) AS standard_category, coalesce(confidence::DOUBLE, 1.0::DOUBLE) AS confidence,
 CASE WHEN standard_category IS NULL THEN 'original' ELSE 'mapped' END AS mapping_type FROM part LEFT JOIN m ON original_category = p_type""")
def j20(spark, d):
    part = table(spark, d, "part")
    mapping = spark.sql(MAPPING.format(t="{p}"), p=part).withColumn("confidence", F.col("confidence").cast("double"))
    out = J.lookup_category(part.select("p_partkey", "p_type"), mapping, "p_type")
    return out.select("p_partkey", "standard_category", "confidence", "mapping_type")


@query("j21_history_recommendation", """
WITH h AS (SELECT p_name AS name, p_type AS category, min(p_partkey) AS id FROM part GROUP BY 1, 2), n AS (SELECT DISTINCT p_name AS name FROM part),
j AS (SELECT n.name, h.category, h.id, CASE WHEN n.name = h.name THEN 1.0 ELSE len(list_intersect(string_split(n.name, ' '), string_split(h.name, ' '))) * 1.0
  / len(list_distinct(string_split(n.name, ' ') || string_split(h.name, ' '))) END::DOUBLE * 0.8 AS confidence FROM n, h),
t AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY confidence DESC, id) AS rank FROM j WHERE confidence > 0 QUALIFY rank <= 3)
SELECT p_partkey AS item_id, category, round(confidence, 6) AS confidence, t.id AS history_id, CAST(rank AS INTEGER) AS rank FROM part JOIN t ON t.name = p_name""")
def j21(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"))
    return J.history_recommendation(part, part, 3).withColumn("confidence", F.round("confidence", 6))


@query("a08_match_statistics", "WITH " + S.grams("m_tf", MASTER, V.FIELD_MATCH) + ", " + S.vocabulary("voc", "m_tf", ROWS, V.FIELD_MATCH) + """
SELECT (SELECT count(*) FROM documents) AS master_rows, 'text' AS field, count(*) AS features FROM voc""")
def a08(spark, d):
    vec = {"text": V.FIELD_MATCH}
    rows, counts = doc_counts(spark, d, vec)
    sizes = V.vocabulary(counts, rows, vec).groupBy("field").agg(F.count_distinct("term").alias("features"))
    # A one-row total beside one row per field.
    return rows.agg(F.count("*").alias("master_rows")).crossJoin(sizes)


@query("u01_strategy_registry", f"""
WITH {NAME_COS}, t AS (SELECT new_id AS source_id, master_id AS target_id, s AS confidence, 'text_similarity' AS strategy FROM cos WHERE s >= 0.5
  QUALIFY row_number() OVER (PARTITION BY new_id ORDER BY s DESC, master_id) <= 5)
SELECT source_id, target_id, round(confidence, 6) AS confidence, strategy FROM t""")
def u01(spark, d):
    cfg = J.MatchConfig("s_suppkey", "c_custkey", [("s_name", "c_name")], describe=False, vectoriser=V.BASELINE)
    got = J.STRATEGIES["text_similarity"](table(spark, d, "supplier"), table(spark, d, "customer"), "s_suppkey", "c_custkey", cfg)
    return got.withColumn("confidence", F.round("confidence", 6))
