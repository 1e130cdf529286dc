from __future__ import annotations

from pyspark.sql import functions as F

from partwise.functions import records as REC
from partwise.functions import tfidf as V
from partwise.operators import classify as C
from partwise.operators import matching as J
from partwise.operators import reports as A
from partwise.plans import tfidf_sql as S
from partwise.plans.items import ITEMS, MED_ITEMS, NOUN, items, med_items
from partwise.plans.linkage import MAPPING
from partwise.plans.registry import query
from partwise.plans.text_features import CLASS_SQL, DEVICE_SQL, q, sql_all, sql_any, sql_first
from partwise.rules import classification as R
from partwise.rules import extraction as X
from partwise.rules import manufacturing as MF
from partwise.rules import medical as MD
from partwise.rules import training as TR
from partwise.session import stored, table

CATEGORY_ROWS = """SELECT category, min(level) AS level, '' AS description FROM (SELECT category, 2 AS level FROM {items} UNION ALL SELECT type, 1 FROM {items} UNION ALL
 SELECT noun, 3 FROM {nouns}) GROUP BY category"""
BASE = f"{ITEMS}, nouns AS (SELECT {NOUN} AS noun FROM part), cats AS ({CATEGORY_ROWS.format(items='items', nouns='nouns')})"


def it(spark, d):
    return items(spark, d).withColumnRenamed("code", "item_id")


def cats(spark, d):
    nouns = table(spark, d, "part").select(F.expr(NOUN).alias("noun"))
    return spark.sql(CATEGORY_ROWS.format(items="{items}", nouns="{nouns}"), items=items(spark, d), nouns=nouns)


def runs(e, p):
    return f"list_distinct(regexp_extract_all(lower({e}), {q(p)}))"


def pair_case() -> str:
    out = []
    for kind, w, r in C.PAIR_RULES:
        plain = R.FAMILY_SCORE if kind == "family" else R.SYNONYM_EXACT if (w, r) in R.EXACT_SYNONYMS else R.SYNONYM_SCORE
        exact = R.FAMILY_EXACT if kind == "family" else plain
        out.append(f"WHEN contains(n, {q(w)}) AND contains(c, {q(r)}) THEN CASE WHEN n = {q(w)} AND c = {q(r)} THEN {exact} ELSE {plain} END")
    return " ".join(out)


def jac(a, b):
    return f"(CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) * 1.0::DOUBLE / len(list_distinct({a} || {b})) ELSE 0 END)"


def sample_case(at: int | None = None) -> str:
    parts = []
    for cat, samples in R.SAMPLES.items():
        scores = []
        for _, _, dn, pn, mat in samples:
            hits = " + ".join(f"(CASE WHEN len([v FOR v IN f_{k} IF contains({q(s.lower())}, v)]) > 0 THEN 1 ELSE 0 END)" for k, s in (("dn", dn), ("pn", pn), ("material", mat)))
            scores.append(f"CASE WHEN given > 0 THEN ({hits}) * 1.0::DOUBLE / given ELSE 0 END")
        parts.append(f"WHEN {q(cat)} THEN greatest({', '.join(scores)})")
    return f"CASE category {' '.join(parts)} ELSE 0 END"


UNIT_CASE = "CASE WHEN unit = '' THEN 0.5 ELSE CASE category " + " ".join(
    f"WHEN {q(c)} THEN " + (f"CASE WHEN unit IN ({', '.join(q(u) for u in us)}) THEN 1.0 ELSE 0.3 END" if us else "0.3") for c, us in C.sample_units().items()) + " ELSE 0.5 END END"


def scored(src: str, top: int = 5) -> str:
    """CTEs from ``src`` (item_id, name, spec, unit) to ranked categories in ``ranked``."""
    feats = ", ".join(f"{sql_all('lower(spec)', [(p, 1) for p in X.SPEC_FEATURES[k]], '')} AS f_{k}" for k in ("dn", "pn", "material"))
    return f"""prof AS (SELECT DISTINCT name, spec, unit, lower(trim(name)) AS n, {runs('name', C.RUNS)} AS nr, {runs("name || ' ' || spec", C.RUNS2)} AS nw, {feats} FROM {src}),
pairs AS (SELECT prof.*, category, level, lower(category) AS c, {runs('category', C.RUNS)} AS cr, {runs('category', C.RUNS2)} AS cw,
  (CASE WHEN len(f_dn) > 0 THEN 1 ELSE 0 END + CASE WHEN len(f_pn) > 0 THEN 1 ELSE 0 END + CASE WHEN len(f_material) > 0 THEN 1 ELSE 0 END) AS given FROM prof CROSS JOIN cats),
parts4 AS (SELECT *, (CASE WHEN n = c THEN 1 WHEN contains(c, n) OR contains(n, c) THEN 0.8 WHEN len(list_intersect(nr, cr)) > 0 THEN greatest({jac('nr', 'cr')} * 0.6, 0.3) {pair_case()} ELSE 0 END)::DOUBLE AS name_score,
  ({sample_case()})::DOUBLE AS spec_score, ({UNIT_CASE})::DOUBLE AS unit_score, {jac('nw', 'cw')}::DOUBLE AS keyword_score FROM pairs),
tot AS (SELECT *, round(least(1.0, (0.8 * name_score + 0.1 * spec_score + 0.05 * unit_score + 0.05 * keyword_score) * CASE WHEN name_score > 0.9 THEN 1.2 ELSE 1 END), 9) AS sim FROM parts4),
conf AS (SELECT *, round(sim * 100, 1) AS confidence FROM tot WHERE sim > 0.02),
ranked0 AS (SELECT *, row_number() OVER (PARTITION BY name, spec, unit ORDER BY CASE WHEN category IN ({', '.join(q(x) for x in R.SPECIFIC)}) AND confidence > 50 THEN confidence + 20
  WHEN category IN ({', '.join(q(x) for x in R.GENERAL)}) THEN confidence - 10 ELSE confidence END DESC, level, category) AS rank FROM conf QUALIFY rank <= {top}),
ranked AS (SELECT i.item_id, r.* FROM {src} i JOIN ranked0 r USING (name, spec, unit))"""


SRC = "src AS (SELECT code AS item_id, name, spec, unit FROM items)"
RULED = f"{BASE}, {SRC}, {scored('src')}"


def register_score(i: int, name: str) -> None:
    @query(f"c0{i}_{name}_similarity", f"WITH {RULED} SELECT item_id, category, round({name}_score, 6) AS score FROM ranked")
    def one(spark, d):
        return C.rule_classify(it(spark, d), cats(spark, d)).select("item_id", "category", F.round(f"{name}_score", 6).alias("score"))


for _i, _name in enumerate(["name", "spec", "unit", "keyword"], 1):
    register_score(_i, _name)


@query("c05_rule_classifier", f"WITH {RULED} SELECT item_id, category, confidence, CAST(rank AS INTEGER) AS rank FROM ranked")
def c05(spark, d):
    return C.rule_classify(it(spark, d), cats(spark, d)).select("item_id", "category", "confidence", "rank")


WIDE_CATEGORIES = """SELECT category, min(level) AS level, '' AS description FROM (SELECT category, 2 AS level FROM {items} UNION ALL
 SELECT noun || ' ' || brand, 3 FROM {nouns} UNION ALL SELECT type || ' ' || noun, 4 FROM {nouns} UNION ALL SELECT noun, 3 FROM {nouns}) GROUP BY category"""
NOUNS = f"SELECT {NOUN} AS noun, p_brand AS brand, p_type AS type FROM "
WIDE_BASE = f"{ITEMS}, nouns AS ({NOUNS} part), cats AS ({WIDE_CATEGORIES.format(items='items', nouns='nouns')})"


@query("c05_rule_classifier_wide", f"WITH {WIDE_BASE}, {SRC}, {scored('src', 40)} SELECT item_id, category, confidence, CAST(rank AS INTEGER) AS rank FROM ranked")
def c05_wide(spark, d):
    """The rule classifier over some hundred categories, forty for each item."""
    wide = spark.sql(WIDE_CATEGORIES.format(items="{items}", nouns="{nouns}"), items=items(spark, d), nouns=spark.sql(NOUNS + "{part}", part=table(spark, d, "part")))
    return C.rule_classify(it(spark, d), wide, top=40).select("item_id", "category", "confidence", "rank")


def joined_features(k):
    return f"array_to_string({sql_all('lower(spec)', [(p, 1) for p in X.SPEC_FEATURES[k]], '')}, ', ')"


ATTRS = "concat_ws('|', '分类名称=' || category, '分类级别=第' || level || '级', " + ", ".join(
    f"CASE WHEN {joined_features(k)} <> '' THEN '{label}=' || {joined_features(k)} || '{tail}' END" for k, label, tail in
    (("dn", "公称直径", ""), ("pn", "压力等级", ""), ("material", "材质", ""), ("length", "长度", "m"))) + ")"


@query("c06_attributes_samples", f"WITH {RULED} SELECT item_id, category, {ATTRS} AS attributes, CAST(CASE WHEN category IN ({', '.join(q(c) for c, s in R.SAMPLES.items() if len(s) == 1)}) THEN CASE WHEN spec_score > 0.3 THEN 1 ELSE 0 END ELSE NULL END AS INTEGER) AS one_sample FROM ranked")
def c06(spark, d):
    got = C.attributes(C.rule_classify(it(spark, d), cats(spark, d)))
    shown = F.array_join(F.transform("attributes", lambda a: F.concat_ws("=", a["label"], a["value"])), "|")
    single = F.col("category").isin([c for c, s in R.SAMPLES.items() if len(s) == 1])
    return got.select("item_id", "category", shown.alias("attributes"), F.when(single, F.size("samples")).alias("one_sample"))


@query("c07_material_classifier")
def c07(spark, d):
    out = C.material_classify(it(spark, d), cats(spark, d))
    return out.select("item_id", "category", "original_confidence", "material_bonus", "confidence", "rank", F.array_join("materials", "|").alias("materials"))


@query("c08_comparison")
def c08(spark, d):
    i, c = it(spark, d), cats(spark, d)
    return C.compare(C.rule_classify(i, c), C.material_classify(i, c))


TEXT = "trim(lower(name || ' ' || spec || ' ' || manufacturer))"
RULES = [(c, k, TR.RULE_CONFIDENCE["keyword"]) for c, ks in TR.KEYWORD_RULES.items() for k in ks] + [(c, k, TR.RULE_CONFIDENCE["specification"]) for c, ks in TR.SPEC_RULES.items() for k in ks]
TRAINED = "rules(category, key, rc) AS (VALUES " + ", ".join(f"({q(c)}, {q(k)}, {x}::DOUBLE)" for c, k, x in RULES) + ")"
TEXTS = f"texts AS (SELECT code AS item_id, {TEXT} AS text FROM items)"
LEX = "lex AS (SELECT category, unnest(list_distinct([category] || " + " || ".join(
    f"CASE WHEN {sql_any('lower(category)', ts)} THEN [{', '.join(q(k) for k in ks)}] ELSE [] END" for ts, ks in R.TRIGGERS) + ")) AS key FROM cats)"
RANK = "row_number() OVER (PARTITION BY item_id ORDER BY confidence DESC, place, category)"
WIDE = f"wide AS (SELECT item_id, category, round(least(count(*) * 0.3, 0.95), 9)::DOUBLE AS confidence, 'enhanced_matching' AS source, 0 AS place FROM texts JOIN lex ON contains(text, lower(key)) GROUP BY 1, 2 QUALIFY {RANK} <= 5)"
KEYWORD = f"""kw AS (SELECT * FROM (SELECT item_id, category, round(least(sum(rc * 0.25), 1.0), 9)::DOUBLE AS confidence, 'db_trained_keywords' AS source, 0 AS place FROM texts JOIN rules ON contains(text, lower(key)) GROUP BY 1, 2
 UNION ALL SELECT item_id, category, round(least(count(*) * 0.15, 0.95), 9)::DOUBLE, 'keyword_matching', 2 FROM texts JOIN lex ON contains(text, lower(key)) GROUP BY 1, 2) QUALIFY {RANK} <= 3)"""
STEXT = "trim(lower(spec || ' ' || name))"


def spec_list() -> str:
    out = []
    for cat, words in TR.SPEC_RULES.items():
        n = "(" + " + ".join(f"CASE WHEN contains({STEXT}, {q(w.lower())}) THEN 1 ELSE 0 END" for w in words) + ")"
        out.append(f"CASE WHEN {n} > 0 THEN {{'category': {q(cat)}, 'confidence': least({n} * 0.3, 0.8)::DOUBLE, 'source': 'trained_spec_pattern'}} END")
    for _, p, cs in R.SPEC_FAMILIES:
        out += [f"CASE WHEN regexp_matches(spec, {q('(?i)' + p)}) THEN {{'category': {q(c)}, 'confidence': 0.25::DOUBLE, 'source': 'spec_pattern'}} END" for c in cs]
    return f"[{', '.join(out)}]"


SPEC = f"""sl AS (SELECT code AS item_id, list_filter({spec_list()}, lambda x: x IS NOT NULL)[:3] AS l FROM items),
sp AS (SELECT item_id, l[i].category AS category, round(l[i].confidence, 9) AS confidence, l[i].source AS source, i AS place FROM (SELECT item_id, l, unnest(range(1, len(l) + 1)) AS i FROM sl))"""
MAPPING_ROWS = "SELECT replace(p_brand, '#', '') || '阀门' AS maker, max(p_type) AS category FROM {part} WHERE p_brand LIKE '%1%' GROUP BY 1"
MAKER = f"""mp AS ({MAPPING_ROWS.format(part='part')}), mk AS (SELECT DISTINCT manufacturer AS m FROM items WHERE manufacturer <> ''),
ruled AS (SELECT m, category, 0.75::DOUBLE AS confidence, 'trained_manufacturer' AS source, row_number() OVER (PARTITION BY m ORDER BY maker, category) AS rank FROM mk JOIN mp ON contains(m, maker) OR contains(maker, m) QUALIFY rank <= 3),
past AS (SELECT manufacturer AS m, category, 0.4::DOUBLE AS confidence, 'manufacturer_pattern' AS source, row_number() OVER (PARTITION BY manufacturer ORDER BY count(*) DESC, category) AS rank FROM items
 WHERE manufacturer <> '' AND manufacturer NOT IN (SELECT m FROM ruled) GROUP BY 1, 2 QUALIFY rank <= 2),
ma AS (SELECT code AS item_id, category, confidence, source, rank FROM (SELECT code, manufacturer AS m FROM items) JOIN (SELECT * FROM ruled UNION ALL SELECT * FROM past) USING (m))"""
LISTS = f"{BASE}, {TRAINED}, {TEXTS}, {LEX}, {WIDE}, {KEYWORD}, {SPEC}, {MAKER}"


def trained_rules(spark):
    return spark.createDataFrame(RULES, "category string, key string, rule_confidence double")


def mapping(spark, d):
    return spark.sql(MAPPING_ROWS.format(part="{part}"), part=table(spark, d, "part"))


def lists(spark, d, wanted=None):
    """Items and their recommendations; of the items ``wanted`` (item_id) alone, with what all items say of categories and makers."""
    every, c = it(spark, d), cats(spark, d)
    i = every if wanted is None else stored(every.join(wanted, "item_id", "left_semi"), "wanted")
    lex = C.lexicon(c)
    return i, [C.wide_keywords(i, lex), C.keyword_recommendation(i, trained_rules(spark), lex, c), C.spec_patterns(i), C.maker_recommendation(i, mapping(spark, d), every)]


@query("c09_trained_keywords", f"WITH {BASE}, {TRAINED}, {TEXTS} SELECT item_id, category, round(least(sum(rc * 0.25), 1.0), 6)::DOUBLE AS confidence FROM texts JOIN rules ON contains(text, lower(key)) GROUP BY 1, 2")
def c09(spark, d):
    return C.trained_keywords(it(spark, d), trained_rules(spark)).select("item_id", "category", F.round("confidence", 6).alias("confidence"))


@query("c10_keyword_recommendation", f"WITH {LISTS} SELECT item_id, category, round(confidence, 6) AS confidence, source, CAST({RANK} AS INTEGER) AS rank FROM kw")
def c10(spark, d):
    return lists(spark, d)[1][1].select("item_id", "category", F.round("confidence", 6).alias("confidence"), "source", "rank")


@query("c11_spec_patterns", f"WITH {BASE}, {SPEC} SELECT item_id, category, round(confidence, 6) AS confidence, source, CAST(place AS INTEGER) AS rank FROM sp")
def c11(spark, d):
    return C.spec_patterns(it(spark, d)).select("item_id", "category", F.round("confidence", 6).alias("confidence"), "source", "rank")


@query("c12_maker_rules", f"WITH {BASE}, {MAKER} SELECT item_id, category, confidence, source, CAST(rank AS INTEGER) AS rank FROM ma")
def c12(spark, d):
    i = it(spark, d)
    return C.maker_recommendation(i, mapping(spark, d), i).select("item_id", "category", "confidence", "source", "rank")


@query("c13_wide_keywords", f"WITH {BASE}, {TEXTS}, {LEX}, {WIDE} SELECT item_id, category, round(confidence, 6) AS confidence, CAST({RANK} AS INTEGER) AS rank FROM wide")
def c13(spark, d):
    return C.wide_keywords(it(spark, d), C.lexicon(cats(spark, d))).select("item_id", "category", F.round("confidence", 6).alias("confidence"), "rank")


EVERY = f"""every AS (SELECT item_id, category, confidence, source, 0 + {RANK} AS place FROM wide UNION ALL SELECT item_id, category, confidence, source, 100 + {RANK} FROM kw
 UNION ALL SELECT item_id, category, confidence, source, 200 + place FROM sp UNION ALL SELECT item_id, category, confidence, source, 300 + rank FROM ma)"""
MERGED = f"""{LISTS}, {EVERY}, mean0 AS (SELECT item_id, category, round(avg(confidence), 9) AS confidence, min(place) AS place, string_agg(source, ', ' ORDER BY place) AS source FROM every GROUP BY 1, 2),
mean AS (SELECT *, {RANK} AS rank FROM mean0 QUALIFY rank <= 5),
merged AS (SELECT item_id, category, confidence, source, rank FROM mean UNION ALL SELECT code, '未分类', 0.1, 'fallback', 1 FROM items WHERE code NOT IN (SELECT item_id FROM mean))"""


@query("c14_merge_mean", f"WITH {MERGED} SELECT item_id, category, round(confidence, 6)::DOUBLE AS confidence, source, CAST(rank AS INTEGER) AS rank FROM merged")
def c14(spark, d):
    i, ls = lists(spark, d)
    return C.merge_mean(i, ls).withColumn("confidence", F.round("confidence", 6))


@query("c15_merge_max", f"""WITH {LISTS}, {EVERY}, mx AS (SELECT item_id, category, max(confidence) AS confidence, min(place) AS place FROM every GROUP BY 1, 2)
SELECT item_id, category, round(confidence, 6) AS confidence, CAST({RANK} AS INTEGER) AS rank FROM mx QUALIFY rank <= 10""")
def c15(spark, d):
    _, ls = lists(spark, d)
    every = None
    for n, x in enumerate(ls):
        part = x.select("item_id", "category", "confidence", "source", (F.lit(n * 100) + F.col("rank")).alias("place"))
        every = part if every is None else every.unionByName(part)
    return C.merge_max(every).select("item_id", "category", F.round("confidence", 6).alias("confidence"), "rank")


NAMES = ["IntelligentClassifier", "SmartClassifier", "AdvancedMatcher", "Rules"]
RESULTS = f"""{MERGED}, {SRC}, {scored('src')}, res AS (SELECT item_id, category, confidence, '{NAMES[0]}' AS classifier, 0 AS place FROM merged WHERE rank = 1 UNION ALL
 SELECT item_id, category, confidence / 100, '{NAMES[1]}', 1 FROM ranked WHERE rank = 1 UNION ALL SELECT item_id, category, confidence, '{NAMES[2]}', 2 FROM sp WHERE place = 1 UNION ALL
 SELECT item_id, category, confidence, '{NAMES[3]}', 3 FROM ma WHERE rank = 1)"""


def results(spark, d, wanted=None):
    i, ls = lists(spark, d, wanted)
    ranked = C.rule_classify(i, cats(spark, d)).withColumn("confidence", F.col("confidence") / 100)
    out = None
    for place, (name, df) in enumerate(zip(NAMES, [C.merge_mean(i, ls), ranked, ls[2], ls[3]])):
        part = df.filter("rank = 1").select("item_id", "category", "confidence", F.lit(name).alias("classifier"), F.lit(place).alias("place"))
        out = part if out is None else out.unionByName(part)
    return i, out


WEIGHT = "CASE classifier " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in R.CLASSIFIER_WEIGHTS.items()) + " ELSE 0.2 END"


@query("c16_weighted_vote", f"""WITH {RESULTS}, v AS (SELECT item_id, category, round(sum(confidence * ({WEIGHT})::DOUBLE), 9) AS score, min(place) AS place FROM res GROUP BY 1, 2)
SELECT item_id, category, round(least(score, 1.0), 6) AS confidence FROM v QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, place) = 1""")
def c16(spark, d):
    return C.weighted_vote(results(spark, d)[1]).withColumn("confidence", F.round("confidence", 6))


CASCADE = f"""{RESULTS}, f AS (SELECT * FROM res WHERE confidence >= 0.6 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY place) = 1),
cas AS (SELECT code AS item_id, coalesce(f.category, '分类失败') AS category, coalesce(confidence, 0.0) AS confidence, coalesce(classifier, 'Unified') AS classifier FROM items LEFT JOIN f ON f.item_id = code)"""


@query("c17_priority_cascade", f"WITH {CASCADE} SELECT item_id, category, round(confidence, 6)::DOUBLE AS confidence, classifier FROM cas")
def c17(spark, d):
    return C.priority_cascade(*results(spark, d)).withColumn("confidence", F.round("confidence", 6))


@query("c18_highest_confidence", f"""WITH {RESULTS} SELECT item_id, arg_max(category, confidence * 1000 - place) AS category, round(max(confidence), 6) AS confidence,
 string_agg(classifier || ':' || category, '|' ORDER BY place) AS details FROM res GROUP BY 1""")
def c18(spark, d):
    out = C.highest_confidence(results(spark, d)[1].withColumn("confidence", F.round("confidence", 6)))
    return out.withColumn("details", F.array_join(F.transform("details", lambda x: F.concat_ws(":", x["classifier"], x["category"])), "|"))


@query("c19_batch_summary", f"""WITH {CASCADE} SELECT count(*) AS total, count(*) FILTER (WHERE category <> '分类失败') AS successful, count(*) FILTER (WHERE category = '分类失败') AS failed,
 round(avg(confidence) FILTER (WHERE category <> '分类失败'), 6) AS average_confidence FROM cas""")
def c19(spark, d):
    return C.batch_summary(C.priority_cascade(*results(spark, d))).withColumn("average_confidence", F.round("average_confidence", 6))


def domain_sql() -> str:
    out = []
    for prefix, groups in (("医疗用品-", X.MEDICAL_TAGS), ("工业用品-", X.INDUSTRIAL_TAGS)):
        for tag, words in groups.items():
            n = "(" + " + ".join(f"CASE WHEN contains(text, {q(w)}) THEN 1 ELSE 0 END" for w in words) + ")"
            out.append(f"SELECT item_id, {q(prefix + tag)} AS category, round(0.5 + least(0.4, {n} * 0.1), 9)::DOUBLE AS confidence FROM b WHERE {n} > 0")
    drug, elec = sql_any("s", R.DRUG_UNITS), sql_any("s", R.ELECTRIC_UNITS)
    out.append(f"SELECT item_id, {q(R.DRUG_CATEGORY)}, 0.8 FROM (SELECT item_id, unnest(brand) AS s FROM b) WHERE {sql_any('s', R.BRAND_WORDS)}")
    out.append(f"SELECT item_id, {q(R.DRUG_CATEGORY)}, 0.7 FROM (SELECT item_id, unnest(sp) AS s FROM b) WHERE {drug}")
    out.append(f"SELECT item_id, {q(R.ELECTRIC_CATEGORY)}, 0.7 FROM (SELECT item_id, unnest(sp) AS s FROM b) WHERE NOT {drug} AND {elec}")
    return " UNION ".join(out)


@query("c20_domain_recommendation", f"""WITH {MED_ITEMS}, {ITEMS}, t AS (SELECT 'm' || code AS item_id, name || ' ' || spec || ' ' || manufacturer AS text FROM med UNION ALL SELECT 'i' || code, name || ' ' || spec || ' ' || manufacturer FROM items),
b AS (SELECT *, {sql_all('text', X.FAMILIES['brand'])} AS brand, {sql_all('text', X.FAMILIES['specification'])} AS sp FROM t), u AS ({domain_sql()}),
top AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY confidence DESC, category) AS rank FROM u QUALIFY rank <= 5)
SELECT item_id, category, round(confidence, 6)::DOUBLE AS confidence, CAST(rank AS INTEGER) AS rank FROM top UNION ALL SELECT item_id, '未分类', 0.1, 1 FROM t WHERE item_id NOT IN (SELECT item_id FROM u)""")
def c20(spark, d):
    text = F.concat_ws(" ", "name", "spec", "manufacturer").alias("text")
    both = med_items(spark, d).select(F.concat(F.lit("m"), "code").alias("item_id"), text).unionByName(
        items(spark, d).select(F.concat(F.lit("i"), "code").alias("item_id"), text))
    return C.domain_recommendation(both, "text").withColumn("confidence", F.round("confidence", 6))


def levels_sql(text, categories, level3):
    def case(pick):
        return "CASE " + " ".join(f"WHEN {sql_any(text, [w.lower() for w in ws])} THEN {pick(f, a, b)}" for f, a, b, ws in categories) + " END"

    third = case(lambda f, a, b: sql_first(text, level3[f]) if f in level3 else "NULL")
    return f"coalesce({case(lambda f, a, b: q(a))}, '未分类') AS level1, coalesce({case(lambda f, a, b: q(b))}, '未分类') AS level2, {third} AS level3"


@query("c21_industry_levels", f"""WITH {ITEMS}, {MED_ITEMS}, mm AS (SELECT code, lower(name || ' ' || {DEVICE_SQL} || ' ' || {CLASS_SQL}) AS t FROM med), ii AS (SELECT code, lower(name || ' ' || spec) AS t FROM items)
SELECT 'm' || code AS item_id, {levels_sql('t', MD.CATEGORIES, MD.LEVEL3)} FROM mm UNION ALL SELECT 'i' || code, {levels_sql('t', MF.CATEGORIES, MF.LEVEL3)} FROM ii""")
def c21(spark, d):
    rec = REC.record({"产品名称": F.col("name"), "分类": F.col("class")})
    med = med_items(spark, d).withColumn("rec", rec)
    m = med.select(F.concat(F.lit("m"), "code").alias("item_id"), C.medical_levels(
        F.col("name"), REC.device_type(F.col("rec")), REC.regulatory_class(F.col("rec"), F.col("name"))).alias("l"))
    i = items(spark, d).select(F.concat(F.lit("i"), "code").alias("item_id"), C.manufacturing_levels(F.col("name"), F.col("spec")).alias("l"))
    return m.unionByName(i).select("item_id", "l.level1", "l.level2", "l.level3")


# Similar items of the same table vote with their standard category, beside the rule classifier's answers.
SAME = "SELECT code AS id, name || ' ' || spec AS text FROM items"
NEAR = f"""{BASE}, {SRC}, {scored('src')}, std AS (SELECT code, coalesce(standard_category, type) AS category FROM items LEFT JOIN ({MAPPING.format(t='part')}) ON original_category = type),
{S.cosine(SAME, SAME, 'SELECT count(*) FROM items', V.SEGMENTED)},
near AS (SELECT new_id AS item_id, s, category, row_number() OVER (PARTITION BY new_id ORDER BY s DESC, master_id) AS rank FROM cos JOIN std ON code = master_id WHERE s >= 0.3 QUALIFY rank <= 10),
done AS (SELECT item_id, category, confidence / 100 AS confidence FROM ranked),
votes AS (SELECT item_id, category, count(*) AS n, round(least(avg(s) * count(*) * 0.3, 0.85), 6)::DOUBLE AS confidence FROM near ANTI JOIN done USING (item_id, category) WHERE category <> '' GROUP BY 1, 2)"""


def near(spark, d):
    """The ten most similar rows of each item, text segmented, with the standard category of their type."""
    i = items(spark, d)
    rows = i.select("code", F.concat_ws(" ", "name", "spec").alias("text"))
    cfg = J.MatchConfig("item_id", "code", [("text", "text")], describe=False, vectoriser=V.SEGMENTED)
    found = J.find_similar(rows.withColumnRenamed("code", "item_id"), rows, cfg)
    mapping = spark.sql(MAPPING.format(t="{p}"), p=table(spark, d, "part")).withColumn("confidence", F.col("confidence").cast("double"))
    std = J.lookup_category(i.select(F.col("code").alias("master_id"), "type"), mapping, "type").select("master_id", "standard_category")
    return found.join(std, "master_id").select(F.col("new_id").alias("item_id"), "rank", "similarity", "standard_category")


def votes(spark, d):
    done = C.rule_classify(it(spark, d), cats(spark, d)).select("item_id", "category", (F.col("confidence") / 100).alias("confidence"))
    return done, C.similar_votes(near(spark, d), done).withColumn("confidence", F.round("confidence", 6))


@query("c30_similar_votes", f"WITH {NEAR} SELECT item_id, category, n, confidence FROM votes")
def c30(spark, d):
    return votes(spark, d)[1]


@query("c31_hybrid_answer", f"""WITH {NEAR}, b AS (SELECT item_id, category, confidence, 'classifier' AS source, 0 AS o FROM done UNION ALL SELECT item_id, category, confidence, 'similar_items', 1 FROM votes)
SELECT item_id, category, round(confidence, 6) AS confidence, source, CAST(row_number() OVER (PARTITION BY item_id ORDER BY o, confidence DESC, category) AS INTEGER) AS rank FROM b""")
def c31(spark, d):
    return C.hybrid(*votes(spark, d)).withColumn("confidence", F.round("confidence", 6))


@query("c32_reclassification_report")
def c32(spark, d):
    i = it(spark, d)
    full, _ = C.reclassification_report(C.material_classify(i, cats(spark, d)), i)
    return full.withColumn("suggestions", F.array_join("suggestions", "|"))


@query("c33_keyword_lexicon", f"WITH {BASE}, {LEX} SELECT category, key FROM lex")
def c33(spark, d):
    return C.lexicon(cats(spark, d))


@query("c34_lexicon_scores", f"""WITH {BASE}, {TEXTS}, {LEX}, sz AS (SELECT category, count(*) AS k FROM lex GROUP BY 1),
x AS (SELECT item_id, category, round(sum(0.7 / k + CASE WHEN key = category THEN 0.95 ELSE 0 END), 9)::DOUBLE AS score FROM texts JOIN lex ON contains(text, lower(key)) JOIN sz USING (category) GROUP BY 1, 2)
SELECT item_id, category, round(least(score, 1.0), 6) AS confidence FROM x WHERE score > 0.1""")
def c34(spark, d):
    return C.lexicon_scores(it(spark, d), C.lexicon(cats(spark, d))).withColumn("confidence", F.round("confidence", 6))


CHARS = "list_distinct(string_split(lower({}), ''))"
LEVEL1 = "SELECT DISTINCT CASE p_type WHEN 'PROMO' THEN '阀门' WHEN 'SMALL' THEN '化工材料钢材' WHEN 'LARGE' THEN '螺栓疏水' ELSE p_type END AS category, 1 AS level FROM {part}"


@query("c35_character_fallback", f"""WITH {ITEMS}, {TEXTS}, l1 AS (SELECT category FROM ({LEVEL1.format(part='part')})),
x AS (SELECT item_id, category, len(list_intersect({CHARS.format('text')}, {CHARS.format('category')})) AS k, greatest(length(text), length(category)) AS g FROM texts CROSS JOIN l1)
SELECT item_id, category, round(k * 1.0::DOUBLE / g, 6) AS confidence, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(k * 1.0::DOUBLE / g, 9) DESC, category) AS INTEGER) AS rank FROM x WHERE k >= 2 QUALIFY rank <= 3""")
def c35(spark, d):
    level1 = spark.sql(LEVEL1.format(part="{part}"), part=table(spark, d, "part"))
    return C.character_fallback(it(spark, d), level1).select("item_id", "category", F.round("confidence", 6).alias("confidence"), "rank")


@query("u02_classifier_interface")
def u02(spark, d):
    out = C.run_classifiers(it(spark, d), categories=cats(spark, d))
    return out.select("item_id", "category", F.round("confidence", 4).alias("confidence"), "classifier")


@query("a10_classifier_evaluation")
def a10(spark, d):
    i, c = it(spark, d), cats(spark, d)
    truth = i.select("item_id", F.col("category").alias("expected"), F.expr("CASE WHEN size % 3 = 0 THEN 'easy' WHEN size % 3 = 1 THEN 'medium' ELSE 'hard' END").alias("difficulty"))
    both = C.compare(C.rule_classify(i, c), C.material_classify(i, c)).join(truth, "item_id")
    return A.evaluation(both.withColumns({"original_correct": F.col("original_category") == F.col("expected"), "enhanced_correct": F.col("enhanced_category") == F.col("expected")}))
