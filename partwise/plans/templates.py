from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from partwise.functions import tfidf as V
from partwise.operators import matching as J
from partwise.operators import profiling as D
from partwise.operators import templates as C
from partwise.plans import tfidf_sql as S
from partwise.plans.items import ITEMS, MED_ITEMS, items, med_items
from partwise.plans.linkage import PART_COS, SIDES, two_systems
from partwise.plans.mapping_profile import source_rows
from partwise.plans.registry import query
from partwise.plans.text_features import q
from partwise.rules import industry as I
from partwise.rules import templates as R
from partwise.session import stored, table

COMBOS = [(["manufacturer", "specification"], 0.6), (["category", "manufacturer", "material_name"], 0.9)]
# The item rows name one product each, so a rule counts from one keyword in five.
RULES = [dict(r, threshold=0.2) if r["rule_type"] == "keyword" else r for r in C.template_rules("manufacturing", COMBOS)]
FEAT = f"{ITEMS}, f AS (SELECT code AS item_id, name AS material_name, spec AS specification, category, manufacturer FROM items)"


def features(spark, d):
    return items(spark, d).select(F.col("code").alias("item_id"), F.col("name").alias("material_name"), F.col("spec").alias("specification"), "category", "manufacturer")


def share(flags):
    return "(" + " + ".join(f"CASE WHEN {x} THEN 1 ELSE 0 END" for x in flags) + f") * 1.0::DOUBLE / {len(flags)}"


def rule_sql(kind: str | None = None) -> str:
    out = []
    for r in RULES:
        if kind and r["rule_type"] != kind:
            continue
        text = "concat_ws(' ', " + ", ".join(f"nullif({c}, '')" for c in r.get("fields", [])) + ")"
        if r["rule_type"] == "keyword":
            s, cond = share([f"contains(lower({text}), {q(k.lower())})" for k in r["keywords"]]), f">= {r['threshold']}"
        elif r["rule_type"] == "pattern":
            s, cond = share([f"regexp_matches({text}, {q('(?i)' + p)})" for p in r["patterns"]]), "> 0"
        elif r["rule_type"] == "composite":
            s, cond = share([f"{c} <> ''" for c in r["fields"]]), f">= {r['support']}"
        else:
            continue
        one, two = (q(r["level1"]), q(r["level2"])) if "level1" in r else ("NULL", "NULL")
        out.append(f"SELECT item_id, {q(r['rule_id'])} AS rule_id, {q(r['rule_type'])} AS rule_type, {s} AS score, {r['weight']}::DOUBLE AS weight, {r.get('boost', 0)}::DOUBLE AS boost, CAST({one} AS VARCHAR) AS level1, CAST({two} AS VARCHAR) AS level2 FROM f WHERE round({s}, 9) {cond}")
    return " UNION ALL ".join(out)


def register_kind(i: int, kind: str) -> None:
    @query(f"c{i}_{kind}_rules", f"WITH {FEAT}, r AS ({rule_sql(kind)}) SELECT item_id, rule_id, round(score, 6) AS score, weight FROM r")
    def one(spark, d):
        got = C.apply_rules(features(spark, d), [r for r in RULES if r["rule_type"] == kind])
        return got.select("item_id", "rule_id", F.round("score", 6).alias("score"), "weight")


for _i, _kind in ((22, "keyword"), (23, "pattern"), (25, "composite")):
    register_kind(_i, _kind)


@query("c23_pattern_parameters", f"WITH {FEAT} SELECT item_id, nullif(regexp_extract(specification, '(?i)DN\\s*([0-9]+)', 1), '') AS diameter, nullif(regexp_extract(specification, '(?i)PN\\s*([0-9]+)', 1), '') AS pressure FROM f")
def c23(spark, d):
    return C.extract_parameters(features(spark, d), next(r for r in RULES if r["rule_type"] == "pattern"))


COS = S.cosine("SELECT item_id AS id, text FROM benchmark", "SELECT doc_id AS id, text FROM documents", "SELECT count(*) FROM documents", V.FIELD_MATCH)


@query("c24_similarity_rules", f"WITH {COS} SELECT new_id AS item_id, 's0' AS rule_id, round(max(s), 6) AS score, 0.25::DOUBLE AS weight FROM cos GROUP BY 1 HAVING max(s) >= 0.6")
def c24(spark, d):
    rule = next(r for r in RULES if r["rule_id"] == "s0")
    cfg = J.MatchConfig("item_id", "doc_id", [("text", "text")], describe=False)
    found = J.match(table(spark, d, "benchmark"), table(spark, d, "documents").select("doc_id", "text"), cfg, rule["threshold"], 1)
    got = C.similarity_results(found.select(F.col("new_id").alias("item_id"), F.col("similarity").alias("score")), rule)
    return got.select("item_id", "rule_id", F.round("score", 6).alias("score"), "weight")


@query("c24_fuzzy_maker_rule", f"""WITH RECURSIVE {SIDES}, {S.ratio("mr", "SELECT DISTINCT s.maker AS a, t.maker AS b FROM src s, tgt t WHERE s.maker <> '' AND t.maker <> ''")}
SELECT source_id AS item_id, 's1' AS rule_id, round(max(ratio), 6) AS score, 0.15::DOUBLE AS weight, 0.1::DOUBLE AS boost FROM src JOIN mr ON maker = a WHERE ratio >= 0.8 - 1e-9 GROUP BY 1""")
def c24_fuzzy(spark, d):
    rule = next(r for r in RULES if r["rule_id"] == "s1")
    src, tgt = two_systems(spark, d)
    found = J.maker_match(src, tgt, "source_id", "target_id", "manufacturer", "manufacturer", rule["threshold"])
    got = C.similarity_results(found.select(F.col("source_id").alias("item_id"), F.col("confidence").alias("score")), rule)
    return got.select("item_id", "rule_id", F.round("score", 6).alias("score"), "weight", "boost")


VOTED = f"""{FEAT}, r AS ({rule_sql()}), tot AS (SELECT item_id, count(*) AS k, least(1.0, sum(score * weight) / sum(weight) + sum(boost)) AS confidence FROM r GROUP BY 1),
v AS (SELECT item_id, level1, level2, round(sum(score * weight), 9) AS s, min(rule_id) AS first FROM r WHERE level1 IS NOT NULL GROUP BY 1, 2, 3),
vr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, first) AS rank FROM v),
voted AS (SELECT f.item_id, coalesce(b.level1, '未分类') AS level1, coalesce(b.level2, CASE WHEN k IS NULL THEN '无匹配规则' ELSE '规则无分类' END) AS level2, coalesce(confidence, 0.0) AS confidence, coalesce(k, 0) AS rules_matched,
 coalesce((SELECT string_agg(x.level2, '|' ORDER BY x.rank) FROM vr x WHERE x.item_id = f.item_id AND x.rank BETWEEN 2 AND 4), '') AS alternatives
 FROM f LEFT JOIN tot USING (item_id) LEFT JOIN (SELECT * FROM vr WHERE rank = 1) b ON b.item_id = f.item_id)"""


def voted(spark, d):
    f = features(spark, d)
    return C.vote(f, C.apply_rules(f, RULES))


@query("c26_rule_vote", f"WITH {VOTED} SELECT item_id, level1, level2, round(confidence, 6) AS confidence, rules_matched, alternatives FROM voted")
def c26(spark, d):
    names = F.array_join(F.transform("alternatives", lambda x: x["level2"]), "|")
    return voted(spark, d).withColumns({"confidence": F.round("confidence", 6), "alternatives": names})


@query("c27_batch_run", f"""WITH {VOTED} SELECT 'manufacturing' AS industry, count(*) AS total, count(*) FILTER (WHERE rules_matched = 0) AS unmatched, round(avg(confidence), 6) AS average_confidence,
 count(*) FILTER (WHERE confidence < 0.7) AS low_confidence_count FROM voted""")
def c27(spark, d):
    industry = D.recognise_industry(D.industry_scores(source_rows(spark, d)))
    return C.batch_summary(voted(spark, d), industry).withColumn("average_confidence", F.round("average_confidence", 6))


@query("c28_template_generation", f"""WITH {ITEMS}, long AS (SELECT '物料名称' AS field, name AS value FROM items UNION ALL SELECT '规格型号', spec FROM items UNION ALL SELECT '制造商', manufacturer FROM items),
qf AS (SELECT count(*) FILTER (WHERE trim(value) <> '') * 1.0::DOUBLE / count(*) AS comp, greatest(0.0, 1 - count(DISTINCT regexp_replace(value, '[0-9]+', 'N', 'g')) * 1.0::DOUBLE / count(*)) AS cons FROM long GROUP BY field),
o AS (SELECT avg(comp) * 0.6 + avg(cons) * 0.4 AS quality FROM qf)
SELECT 'manufacturing_parts' AS template_id, round(CASE WHEN quality > 0.8 THEN 0.45 ELSE 0.35 END, 4)::DOUBLE AS name_weight, 0.7::DOUBLE AS threshold, {len(C.template_rules('manufacturing', COMBOS))} AS n_rules FROM o""")
def c28(spark, d):
    t = C.generate_template(D.source_schema(source_rows(spark, d), "parts"))
    rules = C.rules_table(spark, C.template_rules("manufacturing", COMBOS)).agg(F.count("*").cast("int").alias("n_rules"))
    return t.select("template_id", F.round(F.col("quality_weights")["name_matching"], 4).alias("name_weight"), F.round("confidence_threshold", 4).alias("threshold")).crossJoin(rules)


# Two sources of different industries; the rules of each follow from what it is recognised as.
FIELDS = ["material_name", "specification", "category", "manufacturer"]
MED_CATEGORY = "CASE p_size % 5 WHEN 0 THEN '化学药品' WHEN 1 THEN '注射用品' WHEN 2 THEN '生物制品 中药制剂' WHEN 3 THEN '维生素' ELSE '' END"
MED_ID = 1_000_000_000_000
KEYWORD_SHARE = 0.2


def two_sources(spark, d):
    parts = features(spark, d).select(F.lit("parts").alias("source_id"), "item_id", *FIELDS)
    kinds = table(spark, d, "part").select(F.col("p_partkey").alias("code"), F.expr(MED_CATEGORY).alias("category"))
    med = med_items(spark, d).join(kinds, "code").select(F.lit("med").alias("source_id"), (F.col("code") + MED_ID).alias("item_id"), F.col("name").alias("material_name"),
                                                         F.col("spec").alias("specification"), "category", "manufacturer")
    return stored(parts.unionByName(med), "two_sources")


def two_rules(spark, d):
    """Items, the industry of each source and the rules that follow; a keyword rule counts from one keyword in five, as the items name one product each."""
    two = two_sources(spark, d)
    industries = stored(D.recognise_industry(D.industry_scores(two.select("source_id", *FIELDS), "source_id"), "source_id"), "industries")
    rules = C.industry_rules(spark).withColumn("threshold", F.when(F.col("rule_type") == "keyword", KEYWORD_SHARE).otherwise(F.col("threshold")))
    return two, industries, C.source_rules(two, industries, rules, FIELDS)


def two_voted(spark, d):
    two, industries, rules = two_rules(spark, d)
    src, tgt = two_systems(spark, d)
    cfg = J.MatchConfig("source_id", "target_id", [("name", "name")], describe=False, vectoriser=V.BASELINE)
    alike = J.match(src, tgt, cfg, 0.6, 1).select(F.col("new_id").alias("item_id"), F.lit("tfidf_cosine").alias("method"), F.col("similarity").alias("score"))
    makers = J.maker_match(src, tgt, "source_id", "target_id", "manufacturer", "manufacturer").select(
        F.col("source_id").alias("item_id"), F.lit("fuzzy_string").alias("method"), F.col("confidence").alias("score"))
    return two, industries, C.vote_by_source(two, rules, FIELDS, alike.unionByName(makers))


def _listed(values: list[str]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]::VARCHAR[]"


def _rule_values() -> str:
    """The fixed rules as SQL rows, written from the constants alone."""
    rows = []
    for industry, kinds in R.TAXONOMY.items():
        for i, (one, two, words) in enumerate(kinds):
            rows.append(f"('{industry}', 'k{i}', 'keyword', 0.4, 0.2, {KEYWORD_SHARE}, {q(one)}, {q(two)}, NULL, {_listed(words)}, {_listed(['material_name', 'specification', 'category'])})")
        if industry in R.PATTERN_RULES:
            rows.append(f"('{industry}', 'p0', 'pattern', 0.3, 0.15, 0.0, NULL, NULL, NULL, {_listed(R.PATTERN_RULES[industry][0])}, {_listed(R.PATTERN_RULES[industry][1])})")
        rows.append(f"('{industry}', 's0', 'similarity', 0.25, 0.0, 0.6, NULL, NULL, 'tfidf_cosine', {_listed([])}, {_listed(['material_name', 'specification'])})")
        rows.append(f"('{industry}', 's1', 'similarity', 0.15, 0.1, 0.8, NULL, NULL, 'fuzzy_string', {_listed([])}, {_listed(['manufacturer'])})")
    return ", ".join(rows)


def _score_sql() -> str:
    body = " || ', ' || ".join(f"'{c}: ' || {c}" for c in FIELDS)
    parts = []
    for i, (name, kinds) in enumerate(I.INDICATORS.items()):
        terms = []
        for kind, w in I.KIND_WEIGHTS.items():
            hits = [f"len(regexp_extract_all(body, '(?i){x}'))" if kind == "patterns" else f"(length(body) - length(replace(body, '{x}', ''))) / {len(x)}" for x in kinds[kind]]
            terms.append(f"least(sum({' + '.join(hits)}) * least(1.0, 100.0::DOUBLE / count(*)) / {len(kinds[kind])}, 1.0) * {w}")
        parts.append(f"SELECT source_id, {i} AS rank, '{name}' AS industry, {' + '.join(terms)} AS score FROM bodies GROUP BY source_id")
    return f"bodies AS (SELECT source_id, {body} AS body FROM two), scores AS ({' UNION ALL '.join(parts)})"


COMBO_SQL = " UNION ALL ".join(
    f"SELECT source_id, {_listed(list(c))} AS fields, avg(CASE WHEN {' AND '.join(f + chr(60) + chr(62) + repr('') for f in c)} THEN 1.0::DOUBLE ELSE 0.0 END) AS support FROM two GROUP BY source_id"
    for k in (2, 3) for c in combinations(sorted(FIELDS), k))
TWO = f"""{SIDES}, {MED_ITEMS}, two AS (SELECT 'parts' AS source_id, code AS item_id, name AS material_name, spec AS specification, category, manufacturer FROM items
 UNION ALL SELECT 'med', code + {MED_ID}, name, spec, c, manufacturer FROM med JOIN (SELECT p_partkey AS code, {MED_CATEGORY} AS c FROM part) USING (code)),
{_score_sql()}, ind AS (SELECT source_id, CASE WHEN score >= 0.1 THEN industry ELSE 'generic' END AS industry FROM scores QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY score DESC, rank) = 1),
rr(industry, rule_id, rule_type, weight, boost, threshold, level1, level2, method, terms, fields) AS (VALUES {_rule_values()}), combos AS ({COMBO_SQL}),
rules AS (SELECT source_id, rule_id, rule_type, weight::DOUBLE AS weight, boost::DOUBLE AS boost, threshold::DOUBLE AS threshold, level1, level2, method, terms, fields FROM ind JOIN rr USING (industry)
 UNION ALL SELECT source_id, 'c:' || array_to_string(fields, ','), 'composite', 0.35, 0.0, round(support, 9), NULL, NULL, NULL, []::VARCHAR[], fields FROM combos WHERE support > 0.3)"""


@query("c28_rules_of_sources", f"WITH RECURSIVE {TWO} SELECT source_id, rule_id, rule_type, weight, boost, round(threshold, 6) AS threshold, level1, level2, array_to_string(terms, '|') AS terms, array_to_string(fields, '|') AS fields FROM rules")
def c28_rules(spark, d):
    _, _, rules = two_rules(spark, d)
    joined = lambda c: F.array_join(c, "|").alias(c)
    return rules.select("source_id", "rule_id", "rule_type", "weight", "boost", F.round("threshold", 6).alias("threshold"), "level1", "level2", joined("terms"), joined("fields"))


TWO_VOTED = f"""{TWO}, {PART_COS}, {S.ratio("mr", "SELECT DISTINCT s.maker AS a, t.maker AS b FROM src s, tgt t WHERE s.maker <> '' AND t.maker <> ''")},
sim AS (SELECT new_id AS item_id, 'tfidf_cosine' AS method, max(s) AS score FROM cos GROUP BY 1 UNION ALL SELECT source_id, 'fuzzy_string', max(ratio) FROM src JOIN mr ON maker = a GROUP BY 1),
fv AS (SELECT source_id, item_id, MAP {{{", ".join(f"'{c}': {c}" for c in FIELDS)}}} AS m FROM two),
fr AS (SELECT f.item_id, r.*, list_transform(r.fields, lambda x: coalesce(f.m[x], '')) AS here FROM fv f JOIN rules r USING (source_id)),
ft AS (SELECT *, array_to_string(list_filter(here, lambda x: x <> ''), ' ') AS body FROM fr),
sc AS (SELECT ft.*, CASE rule_type WHEN 'keyword' THEN list_avg(list_transform(terms, lambda t: CASE WHEN contains(lower(body), lower(t)) THEN 1.0::DOUBLE ELSE 0 END))
  WHEN 'pattern' THEN list_avg(list_transform(terms, lambda t: CASE WHEN regexp_matches(body, '(?i)' || t) THEN 1.0::DOUBLE ELSE 0 END))
  WHEN 'composite' THEN list_avg(list_transform(here, lambda x: CASE WHEN x <> '' THEN 1.0::DOUBLE ELSE 0 END)) ELSE sim.score END AS score
 FROM ft LEFT JOIN sim ON sim.item_id = ft.item_id AND sim.method = ft.method),
r AS (SELECT * FROM sc WHERE score > 0 AND round(score, 9) >= threshold),
tot AS (SELECT item_id, count(*) AS k, least(1.0, sum(score * weight) / sum(weight) + sum(boost)) AS confidence FROM r GROUP BY 1),
v AS (SELECT item_id, level1, level2, round(sum(score * weight), 9) AS s, min(rule_id) AS first FROM r WHERE level1 IS NOT NULL GROUP BY 1, 2, 3),
top AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY s DESC, first) = 1),
voted AS (SELECT t.source_id, t.item_id, coalesce(level1, '未分类') AS level1, coalesce(level2, CASE WHEN k IS NULL THEN '无匹配规则' ELSE '规则无分类' END) AS level2,
 coalesce(confidence, 0.0) AS confidence, coalesce(k, 0) AS rules_matched, material_name || specification || category || manufacturer = '' AS blank
 FROM two t LEFT JOIN tot USING (item_id) LEFT JOIN top USING (item_id))"""


@query("c26_vote_over_sources", f"WITH RECURSIVE {TWO_VOTED} SELECT item_id, level1, level2, round(confidence, 6) AS confidence, rules_matched FROM voted")
def c26_sources(spark, d):
    return two_voted(spark, d)[2].select("item_id", "level1", "level2", F.round("confidence", 6).alias("confidence"), "rules_matched")


@query("c27_runs_of_sources", f"""WITH RECURSIVE {TWO_VOTED} SELECT source_id, industry, count(*) AS total, count(*) FILTER (WHERE blank) AS failed, count(*) FILTER (WHERE rules_matched = 0) AS unmatched,
 round(avg(confidence), 6) AS average_confidence, count(*) FILTER (WHERE confidence < 0.7) AS low_confidence_count FROM voted JOIN ind USING (source_id) GROUP BY 1, 2""")
def c27_sources(spark, d):
    two, industries, voted = two_voted(spark, d)
    return C.source_summaries(two, voted, industries, FIELDS).withColumn("average_confidence", F.round("average_confidence", 6))


PERF = """perf AS (SELECT 't' || user_id % 5 AS template_id, avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END)::DOUBLE * (0.8 + user_id % 5 * 0.08) AS accuracy, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY user_id % 5)"""


def performance(spark, d):
    e = table(spark, d, "events").withColumn("g", F.pmod("user_id", F.lit(5)))
    return e.groupBy("g").agg(F.avg(F.when(F.col("event_type") != "error", 1.0).otherwise(0.0)).alias("a"), F.count_if(F.col("event_type") == "error").alias("errors")).select(
        F.concat(F.lit("t"), "g").alias("template_id"), (F.col("a") * (0.8 + F.col("g") * 0.08)).alias("accuracy"), "errors")


KINDS = {"keyword": 0.4, "similarity": 0.25, "pattern": 0.3}


@query("c29_template_retune", f"WITH {PERF}, k(rule_type, weight) AS (VALUES " + ", ".join(f"('{k}', {w}::DOUBLE)" for k, w in KINDS.items()) + """)
SELECT template_id, rule_type, round(weight * CASE WHEN accuracy < 0.7 AND rule_type = 'keyword' THEN 1.1 WHEN accuracy < 0.7 AND rule_type = 'similarity' THEN 0.9 ELSE 1 END, 6)::DOUBLE AS weight,
 round(0.75 + CASE WHEN errors > 10 THEN 0.05 WHEN accuracy > 0.9 THEN -0.02 ELSE 0 END, 6)::DOUBLE AS confidence_threshold FROM perf, k""")
def c29(spark, d):
    perf = performance(spark, d)
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("rule_type"), F.lit(w).alias("weight")) for k, w in KINDS.items()])).alias("k")
    rules = perf.select("template_id", kinds).select("template_id", "k.*")
    thresholds = C.retune_threshold(perf.select("template_id", F.lit(0.75).alias("confidence_threshold")), perf)
    return C.retune(rules, perf).join(thresholds.select("template_id", "confidence_threshold"), "template_id").select(
        "template_id", "rule_type", F.round("weight", 6).alias("weight"), F.round("confidence_threshold", 6).alias("confidence_threshold"))


@query("c29_templates_by_industry", """SELECT c_custkey AS template_id, c_mktsegment AS industry_type, c_acctbal AS last_updated FROM customer WHERE c_mktsegment = 'MACHINERY'""")
def c29_list(spark, d):
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("template_id"), F.col("c_mktsegment").alias("industry_type"), F.col("c_acctbal").alias("last_updated"))
    return C.by_industry(t, "MACHINERY")
