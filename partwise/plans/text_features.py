from __future__ import annotations

from pyspark.sql import functions as F

from partwise.functions import extract as E
from partwise.functions import grades as G
from partwise.functions import records as R
from partwise.functions import text as X
from partwise.plans.items import ITEMS, MED_ITEMS, items, med_items
from partwise.plans.registry import query
from partwise.rules import extraction as XR
from partwise.rules import grades as GR
from partwise.rules import manufacturing as MF
from partwise.rules import medical as MD
from partwise.session import table

# SQL spellings of the small helpers the expressions share.


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_any(col: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(w)})" for w in words) + ")"


def sql_first(col: str, rules, default="NULL") -> str:
    return "CASE " + " ".join(f"WHEN {sql_any(col, ws)} THEN {q(v) if isinstance(v, str) else v}" for ws, v in rules) + f" ELSE {default} END"


def sql_match(col: str, patterns: list[str], flags="(?i)") -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({col}, {q(flags + p)}, 0), '')" for p in patterns) + ")"


def sql_all(col: str, patterns, flags="(?i)") -> str:
    lists = " || ".join(f"regexp_extract_all({col}, {q(flags + p)}, {g})" for p, g in patterns)
    return f"list_sort(list_distinct([y FOR y IN [regexp_replace(x, '^\\s+|\\s+$', '', 'g') FOR x IN ({lists})] IF y <> '']))"


def sql_remove(col: str, words: list[str]) -> str:
    for w in words:
        col = f"replace({col}, {q(w)}, '')"
    return col


def joined(c):
    return F.array_join(F.array_sort(c), "|")


FAMILY_SQL = ", ".join(f"array_to_string({sql_all('text', ps)}, '|') AS {k}" for k, ps in XR.FAMILIES.items())


@query("e01_parameter_families", f"""
WITH {ITEMS}, t AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'i' || code, name || ' ' || spec || ' ' || manufacturer FROM items),
f AS (SELECT id, {FAMILY_SQL} FROM t) SELECT id, md5(brand) AS brand, specification, model, material, usage FROM f""")
def e01(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    parts = items(spark, d).select(F.concat(F.lit("i"), "code").alias("id"), F.concat_ws(" ", "name", "spec", "manufacturer").alias("text"))
    got = docs.unionByName(parts).select("id", E.parameters(F.col("text")).alias("p"))
    out = [joined(F.coalesce(F.col("p")[k], F.array().cast("array<string>"))).alias(k) for k in XR.FAMILIES]
    return got.select("id", *out).withColumn("brand", F.md5("brand"))


def tag_sql(groups):
    parts = ", ".join(f"CASE WHEN {sql_any('text', ws)} THEN '{t}' END" for t, ws in groups.items())
    return f"concat_ws('|', {parts})"


@query("e02_domain_tags", f"""
WITH {ITEMS}, {MED_ITEMS}, t AS (SELECT 'i' || code AS id, name || ' ' || spec AS text FROM items UNION ALL SELECT 'm' || code, name || ' ' || spec FROM med)
SELECT id, {tag_sql(XR.MEDICAL_TAGS)} AS medical, {tag_sql(XR.INDUSTRIAL_TAGS)} AS industrial FROM t""")
def e02(spark, d):
    both = items(spark, d).select(F.concat(F.lit("i"), "code").alias("id"), F.concat_ws(" ", "name", "spec").alias("text")).unionByName(
        med_items(spark, d).select(F.concat(F.lit("m"), "code").alias("id"), F.concat_ws(" ", "name", "spec").alias("text")))
    return both.select("id", F.array_join(E.domain_tags(F.col("text"), XR.MEDICAL_TAGS), "|").alias("medical"),
                       F.array_join(E.domain_tags(F.col("text"), XR.INDUSTRIAL_TAGS), "|").alias("industrial"))


@query("e03_standard_values", f"""
WITH {ITEMS}, {MED_ITEMS}, f AS (SELECT i.code, {sql_all("m.spec", XR.FAMILIES["specification"])} AS s, {sql_all("i.manufacturer", XR.FAMILIES["brand"])} AS b,
  {sql_all("i.spec", XR.FAMILIES["model"])} AS m FROM items i JOIN med m USING (code))
SELECT code, array_to_string(list_sort([regexp_replace(regexp_replace(x, '([0-9]+(?:\\.[0-9]+)?)\\s*(mg|ml|g|l)', '\\1\\2', 'g'), '[*×]', '×', 'g') FOR x IN s]), '|') AS specs,
 array_to_string(list_sort([regexp_replace(x, '(集团|公司|厂|制药|医药|有限)$', '') FOR x IN b]), '|') AS brands,
 array_to_string(list_sort([upper(x) FOR x IN m]), '|') AS models FROM f""")
def e03(spark, d):
    both = items(spark, d).join(med_items(spark, d).select("code", F.col("spec").alias("m_spec")), "code")
    f = XR.FAMILIES
    return both.select(
        "code", joined(E.standardise(X.all_matches(F.col("m_spec"), f["specification"]), "specification")).alias("specs"),
        joined(E.standardise(X.all_matches(F.col("manufacturer"), f["brand"]), "brand")).alias("brands"),
        joined(E.standardise(X.all_matches(F.col("spec"), f["model"]), "model")).alias("models"))


@query("e04_spec_features", f"WITH {ITEMS} SELECT code, " + ", ".join(
    f"array_to_string({sql_all('lower(spec)', [(p, 1) for p in ps], '')}, '|') AS {k}" for k, ps in XR.SPEC_FEATURES.items()) + " FROM items")
def e04(spark, d):
    return items(spark, d).select("code", *[F.array_join(c, "|").alias(k) for k, c in E.spec_features(F.col("spec")).items()])


def _grade_cases():
    out = []
    for keyword, (base, weight, category, grade, _) in G.dictionary():
        k = keyword.lower().replace("#", r"\#")
        hit = f"regexp_matches(lower(name), {q(f'{k}(不锈钢|钢|合金|$)|(^|[^a-z]){k}([^a-z]|$)')})"
        conf = f"0.8 + CASE WHEN contains(lower(name), {q(keyword)}) THEN 0.1 ELSE 0 END"
        out.append((hit, keyword, base, weight, category, grade, conf))
    return out


GRADE_SQL = "hits AS (" + " UNION ALL ".join(
    f"SELECT code, name, {i} AS rank, {q(k)} AS detected, {q(b)} AS base, {w}::DOUBLE AS weight, {q(c)} AS category, {q(g)} AS grade, "
    f"least(1.0, {conf} + CASE WHEN {sql_any('lower(name)', GR.CONTEXT_WORDS)} THEN 0.05 ELSE 0 END)::DOUBLE AS confidence FROM items WHERE {hit}"
    for i, (hit, k, b, w, c, g, conf) in enumerate(_grade_cases())) + "), bases AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY code, base ORDER BY rank) = 1)"


@query("e05_grade_hits", f"WITH {ITEMS}, {GRADE_SQL} SELECT code, detected, base, weight, category, grade, round(confidence, 4) AS confidence FROM bases")
def e05(spark, d):
    hits = items(spark, d).select("code", F.explode(G.grade_hits("name")).alias("h"))
    return hits.select("code", "h.detected", "h.base", "h.weight", "h.category", "h.grade", F.round("h.confidence", 4).alias("confidence"))


@query("e06_core_concept")
def e06(spark, d):
    hits = items(spark, d).select("code", "name", G.grade_hits("name").alias("hits"))
    return hits.select("code", "name", G.core_concept(F.col("name"), F.col("hits")).alias("concept"))


BONUS_CASE = "CASE grade " + " ".join(f"WHEN '{g}' THEN {v}" for g, v in GR.GRADE_BONUS.items()) + f" ELSE {GR.OTHER_GRADE_BONUS} END"


@query("e07_grade_bonus", f"""
WITH {ITEMS}, {GRADE_SQL}, b AS (SELECT code, sum({BONUS_CASE}) AS s, bool_or(category = '不锈钢') AS st, bool_or(category = '碳钢') AS ca FROM bases GROUP BY 1)
SELECT i.code, round(CASE WHEN b.code IS NULL THEN 0 ELSE least(0.3, s
 + CASE WHEN st AND {sql_any("i.category", GR.CATEGORY_BONUS[0][1])} THEN 0.1 ELSE 0 END
 + CASE WHEN ca AND {sql_any("i.category", GR.CATEGORY_BONUS[1][1])} THEN 0.08 ELSE 0 END) END::DOUBLE, 4) AS bonus
FROM items i LEFT JOIN b USING (code)""")
def e07(spark, d):
    hits = items(spark, d).select("code", "category", G.grade_hits("name").alias("hits"))
    return hits.select("code", F.round(G.bonus(F.col("hits"), F.col("category")), 4).alias("bonus"))


def item_records(spark, d):
    rec = R.record({"物料名称": F.col("name"), "规格型号": F.col("spec"), "制造商": F.col("manufacturer")})
    return items(spark, d).withColumn("rec", rec)


BODY = "(name || ' ' || spec || ' ' || manufacturer)"


def _last(p, g):
    return f"TRY_CAST(list_last(regexp_extract_all(spec, {q('(?i)' + p)}, {g})) AS DOUBLE)"


@query("e08_size_parameters", f"WITH {ITEMS} SELECT code, " + ", ".join(f"{_last(p, g)} AS {n}" for n, p, g in MF.SIZES) + f""",
 round({_last(MF.SIZE_WITH_UNIT, 1)} * CASE lower(list_last(regexp_extract_all(spec, {q('(?i)' + MF.SIZE_WITH_UNIT)}, 2))) WHEN 'cm' THEN 10.0 WHEN 'm' THEN 1000.0
 WHEN 'inch' THEN 25.4 WHEN '"' THEN 25.4 ELSE 1.0 END, 6) AS size_mm FROM items""")
def e08(spark, d):
    got = item_records(spark, d).select("code", R.sizes(F.col("spec"), F.col("rec")).alias("s"))
    return got.select("code", *[F.col("s")[n].alias(n) for n, _, _ in MF.SIZES], F.round(F.col("s")["size_mm"], 6).alias("size_mm"))


@query("e09_ratings_standard_material", f"""
WITH {ITEMS} SELECT code, {sql_match("spec", MF.PRESSURES)} AS pressure, {sql_match(BODY, MF.STANDARDS)} AS standard,
 CASE WHEN regexp_matches({BODY}, {q(MF.TEMPERATURE_RANGE)}) THEN regexp_extract({BODY}, {q(MF.TEMPERATURE_RANGE)}, 1) || '~' || regexp_extract({BODY}, {q(MF.TEMPERATURE_RANGE)}, 2) || '℃'
 WHEN regexp_matches({BODY}, {q(MF.TEMPERATURE_ONE)}) THEN regexp_extract({BODY}, {q(MF.TEMPERATURE_ONE)}, 1) || '℃' END AS temperature,
 coalesce({sql_first(BODY, [(al, n) for n, al in MF.MATERIALS.items()])}, '未知材质') AS material FROM items""")
def e09(spark, d):
    rec = F.col("rec")
    return item_records(spark, d).select("code", R.pressure_rating(F.col("spec")).alias("pressure"), R.standard(rec).alias("standard"),
                                         R.temperature_rating(rec).alias("temperature"), R.material_type(rec).alias("material"))


def _tech(p):
    return f"CASE WHEN regexp_matches(spec, {q(p)}) THEN regexp_extract(spec, {q(p)}, 1) || ' ' || regexp_extract(spec, {q(p)}, 2) END"


@query("e10_technical_parameters", f"WITH {ITEMS} SELECT code, {_tech(MF.TECH_PATTERNS['流量'])} AS flow, {_tech(MF.TECH_PATTERNS['功率'])} AS power, {_tech(MF.TECH_PATTERNS['转速'])} AS speed FROM items")
def e10(spark, d):
    got = item_records(spark, d).select("code", R.technical_parameters(F.col("rec")).alias("p"))
    return got.select("code", F.col("p")["流量"].alias("flow"), F.col("p")["功率"].alias("power"), F.col("p")["转速"].alias("speed"))


def med_records(spark, d):
    rec = R.record({"产品名称": F.col("name"), "规格": F.col("spec"), "分类": F.col("class"), "备注": F.col("note"), "用途": F.col("indication"),
                    "生产企业": F.col("manufacturer")})
    return med_items(spark, d).withColumn("rec", rec)


MBODY = "(name || ' ' || spec || ' ' || class || ' ' || note || ' ' || indication || ' ' || manufacturer)"
FORMS = [([f], f) for forms in MD.DOSAGE_FORMS.values() for f in forms]
DEVICE_SQL = sql_first("name", MD.TYPE_WORDS, "'未知类型'")
CLASS_SQL = f"coalesce({sql_first('class', [(w, label) for w, label, _ in MD.CLASSES])}, nullif(class, ''), {sql_first('name', MD.CLASS_BY_NAME)}, '未分类')"


@query("e11_medical_record_features", f"""
WITH {MED_ITEMS} SELECT code, {sql_match(MBODY, MD.REGISTRATIONS, "")} AS registration, {sql_match(MBODY, MD.DATES, "")} AS expiry,
 {sql_first("(name || ' ' || spec)", FORMS)} AS form, coalesce(CASE WHEN regexp_matches(spec, {q('(?i)' + MD.HAS_CONCENTRATION)}) THEN trim(spec) END, {sql_match(MBODY, MD.CONCENTRATIONS)}) AS concentration,
 coalesce(CASE WHEN regexp_matches(spec, {q(MD.HAS_PACKAGE)}) THEN trim(spec) END, {sql_match(MBODY, MD.PACKAGES, "")}) AS package,
 {sql_match(MBODY, MD.STANDARDS)} AS standard, {DEVICE_SQL} AS device FROM med""")
def e11(spark, d):
    rec = F.col("rec")
    return med_records(spark, d).select(
        "code", R.registration_no(rec).alias("registration"), R.expiry_date(rec).alias("expiry"), R.dosage_form(rec, F.col("name")).alias("form"),
        R.concentration(rec).alias("concentration"), R.package_spec(rec).alias("package"), R.medical_standard(rec).alias("standard"),
        R.device_type(rec).alias("device"))


@query("e12_regulatory_class", f"""
WITH {MED_ITEMS}, c AS (SELECT code, {CLASS_SQL} AS label FROM med)
SELECT code, label, {sql_first("label", [(w, lv) for w, _, lv in MD.CLASSES], "0")} AS level FROM c""")
def e12(spark, d):
    got = med_records(spark, d).select("code", R.regulatory_class(F.col("rec"), F.col("name")).alias("label"))
    return got.withColumn("level", R.class_level(F.col("label")))


@query("e13_clinical_parameters", f"""
WITH {MED_ITEMS} SELECT code, nullif(indication, '') AS dosage, CASE WHEN note <> '' THEN note END AS reactions,
 (CASE WHEN indication <> '' THEN 1 ELSE 0 END + CASE WHEN note <> '' THEN 1 ELSE 0 END) AS n FROM med""")
def e13(spark, d):
    rec = R.record({"给药方案": F.col("indication"), "副作用": F.col("note")})
    got = med_items(spark, d).select("code", R.clinical_parameters(rec).alias("p"))
    return got.select("code", F.col("p")["用法用量"].alias("dosage"), F.col("p")["不良反应"].alias("reactions"), F.size("p").alias("n"))


STOP_SQL = "(" + ", ".join(q(w) for w in MF.NAME_STOP_WORDS) + ")"
SIG_SQL = "concat_ws('|', " + ", ".join(
    f"'{n}:' || CAST({_last(p, g)} AS VARCHAR)" for n, p, g in MF.SIZES if n in MF.SIGNATURE_ORDER) + ")"


@query("e14_manufacturing_signature", f"""
WITH {ITEMS}, p AS (SELECT *, {sql_match("spec", MF.PRESSURES)} AS pr, coalesce({sql_first(BODY, [(al, n) for n, al in MF.MATERIALS.items()])}, '未知材质') AS mt FROM items)
SELECT code, array_to_string([w FOR w IN regexp_extract_all(name, '[\\p{{L}}\\p{{N}}_]+') IF length(w) > 1 AND w NOT IN {STOP_SQL}], '|') AS keywords,
 {SIG_SQL} AS signature, coalesce({sql_first("upper(pr)", [([c], p) for c, p in MF.CLASS_TO_PN.items()])}, upper(pr)) AS pressure_class,
 trim({sql_remove("manufacturer", MF.MAKER_SUFFIXES)}) AS maker,
 CASE mt WHEN '不锈钢' THEN 'high' WHEN '碳钢' THEN 'medium' WHEN '合金钢' THEN 'high' END AS strength FROM p""")
def e14(spark, d):
    spec, rec = F.col("spec"), F.col("rec")
    return item_records(spark, d).select(
        "code", F.array_join(R.name_keywords(F.col("name"), MF.NAME_STOP_WORDS), "|").alias("keywords"),
        R.size_signature(R.sizes(spec, rec)).alias("signature"), R.pressure_class(R.pressure_rating(spec)).alias("pressure_class"),
        R.plain_maker(F.col("manufacturer")).alias("maker"), R.material_properties(R.material_type(rec))["强度"].alias("strength"))


GROUP_CASE = "CASE form " + " ".join(f"WHEN '{f}' THEN '{g}'" for g, fs in MD.DOSAGE_FORMS.items() for f in fs) + " END"
PARTS = f"regexp_extract(spec, {q(MD.CONCENTRATION_PARTS)}, 1)", f"regexp_extract(spec, {q(MD.CONCENTRATION_PARTS)}, 2)"


@query("e15_medical_signature", f"""
WITH {MED_ITEMS}, f AS (SELECT *, {sql_first("(name || ' ' || spec)", FORMS)} AS form FROM med)
SELECT code, {GROUP_CASE} AS dosage_group, TRY_CAST({PARTS[0]} AS DOUBLE) AS value, nullif({PARTS[1]}, '') AS unit,
 round(TRY_CAST({PARTS[0]} AS DOUBLE) * CASE lower({PARTS[1]}) WHEN 'g' THEN 1000.0 WHEN 'μg' THEN 0.001 WHEN 'mcg' THEN 0.001 ELSE 1.0 END, 6) AS mg,
 trim({sql_remove("manufacturer", MD.MAKER_SUFFIXES)}) AS maker, {sql_first("lower(indication)", [(w, a) for a, w in MD.THERAPEUTIC_AREAS])} AS area FROM f""")
def e15(spark, d):
    parts = R.concentration_parts(F.col("spec"))
    return med_records(spark, d).select(
        "code", R.dosage_group(R.dosage_form(F.col("rec"), F.col("name"))).alias("dosage_group"), parts["value"].alias("value"),
        parts["unit"].alias("unit"), F.round(parts["mg"], 6).alias("mg"), R.plain_maker(F.col("manufacturer"), MD.MAKER_SUFFIXES).alias("maker"),
        R.therapeutic_area(F.col("indication")).alias("area"))


FP = {
    "name_fp": f"array_to_string(list_sort(regexp_extract_all({sql_remove('lower(trim(name))', XR.NAME_NOISE)}, '[\\x{{4e00}}-\\x{{9fa5}}a-zA-Z0-9]+')), '')",
    "spec_fp": f"array_to_string(list_sort(regexp_extract_all(lower(trim(spec)), {q(XR.NUM)}) || regexp_extract_all(lower(trim(spec)), {q(XR.SPEC_UNITS)}, 1) || regexp_extract_all(lower(trim(spec)), {q(XR.SPEC_MARKS)}, 1)), '')",
    "maker_fp": f"regexp_replace({sql_remove('lower(trim(manufacturer))', XR.COMPANY_SUFFIXES)}, '[^\\x{{4e00}}-\\x{{9fa5}}a-zA-Z0-9]', '', 'g')",
}
FP_SELECT = ", ".join(f"{e} AS {k}" for k, e in FP.items())


@query("e16_fingerprints", f"WITH {ITEMS} SELECT code, {FP_SELECT} FROM items")
def e16(spark, d):
    return items(spark, d).select("code", X.name_fingerprint(F.col("name")).alias("name_fp"), X.spec_fingerprint(F.col("spec")).alias("spec_fp"),
                                  X.maker_fingerprint(F.col("manufacturer")).alias("maker_fp"))


@query("e17_combined_fingerprint", f"WITH {ITEMS}, f AS (SELECT code, {FP_SELECT} FROM items) SELECT code, md5(name_fp || '|' || spec_fp || '|' || maker_fp) AS combined FROM f")
def e17(spark, d):
    return items(spark, d).select("code", X.combined_fingerprint(F.col("name"), F.col("spec"), F.col("manufacturer")).alias("combined"))


def content_hash_sql(fields: dict[str, str]) -> str:
    parts = ", ".join(f"CASE WHEN {e} <> '' THEN '\"{f}\":\"' || lower(trim({e})) || '\"' END" for f, e in sorted(fields.items()))
    return f"md5('{{' || concat_ws(',', {parts}) || '}}')"


HASH_COLUMNS = {"material_name": "name", "specification": "spec", "manufacturer": "manufacturer", "material_type": "type", "unit": "unit", "category": "category"}


@query("e18_content_hash", f"WITH {ITEMS} SELECT code, {content_hash_sql(HASH_COLUMNS)} AS content_hash FROM items")
def e18(spark, d):
    return items(spark, d).select("code", X.content_hash({f: F.col(c) for f, c in HASH_COLUMNS.items()}).alias("content_hash"))


@query("e19_row_hash", """
SELECT event_id, md5('{"event_id":' || event_id || ',"event_type":"' || event_type || '","props":"' || replace(props, '"', '\\"') || '","user_id":' || user_id || '}') AS row_hash FROM events""")
def e19(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "props", F.col("ts").alias("updated_at"))
    return e.select("event_id", X.record_hash(e.columns).alias("row_hash"))


@query("e20_last_modified", """
SELECT event_id, strftime(CASE WHEN event_type = 'view' THEN ts WHEN event_type = 'click' THEN ts + INTERVAL 1 HOUR ELSE TIMESTAMP '2024-06-01' END, '%Y-%m-%d %H:%M:%S') AS modified FROM events""")
def e20(spark, d):
    e = table(spark, d, "events").select(
        "event_id", F.when(F.col("event_type") == "view", F.col("ts").cast("string")).otherwise("not a time").alias("last_modified"),
        F.when(F.col("event_type") == "click", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).cast("string")).alias("modified_at"))
    asof = F.expr("timestamp_ntz'2024-06-01 00:00:00'")
    return e.select("event_id", F.date_format(X.last_modified(e.columns, asof), "yyyy-MM-dd HH:mm:ss").alias("modified"))


@query("e21_baseline_category", f"""
WITH {MED_ITEMS} SELECT code, {sql_first("name", [([w], v) for w, v in XR.BASELINE_CATEGORIES], q(XR.BASELINE_DEFAULT))} AS category,
 name || ' ' || spec || ' ' || manufacturer AS raw_text FROM med""")
def e21(spark, d):
    return med_items(spark, d).select("code", X.baseline_category(F.col("name")).alias("category"),
                                      F.concat_ws(" ", "name", "spec", "manufacturer").alias("raw_text"))


TAG_SQL = "concat_ws('|', " + ", ".join(f"CASE WHEN regexp_matches(text, {q('(?i)' + p)}) THEN '{t}:{label}' END" for p, t, label in XR.SPEC_TAGS) + ")"


@query("e23_spec_tags", f"""
WITH {ITEMS}, t AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'i' || code, spec FROM items) SELECT id, {TAG_SQL} AS tags FROM t""")
def e23(spark, d):
    both = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text").unionByName(
        items(spark, d).select(F.concat(F.lit("i"), "code").alias("id"), F.col("spec").alias("text")))
    return both.select("id", F.array_join(F.transform(E.spec_tags(F.col("text")), lambda x: F.concat_ws(":", x["tag"], x["label"])), "|").alias("tags"))


@query("u04_user_patterns", """
SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '(?i)[a-z0-9._]+@[a-z0-9.]+', 0))), '|') AS email,
 array_to_string(list_sort(list_distinct(regexp_extract_all(text, '(?i)v([0-9]+\\.[0-9]+)', 1))), '|') AS version FROM documents""")
def u04(spark, d):
    families = {"email": [("[a-z0-9._]+@[a-z0-9.]+", 0)], "version": [(r"v([0-9]+\.[0-9]+)", 1)]}
    got = E.parameter_families(F.col("text"), families)
    return table(spark, d, "documents").select("doc_id", *[joined(c).alias(k) for k, c in got.items()])
