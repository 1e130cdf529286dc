from __future__ import annotations

from pyspark.sql import functions as F

from partwise.operators import classify as C
from partwise.operators import quality as Q
from partwise.plans.classification import CASCADE, results
from partwise.plans.duplicates import GROUPS, run
from partwise.plans.items import ITEMS, items
from partwise.plans.registry import query
from partwise.plans.text_features import q, sql_any
from partwise.rules import quality as R

# Record fields from the item rows, in the dialect both engines share.
FIELDS = {
    "material_name": "CASE WHEN size = 13 THEN name || '★' WHEN size = 17 THEN 'test ' || name WHEN size = 19 THEN ' ' ELSE name END",
    "specification": "CASE WHEN size % 8 = 0 THEN lower(name) || ' ' || spec || ' 材质:304 型号 规格 温度 压力16 应用于管道系统的标准部件说明书附录完整版本' ELSE spec END",
    "manufacturer": "CASE WHEN size = 5 THEN 'X' ELSE manufacturer END",
    "material_type": "CASE WHEN size % 3 = 0 THEN '' ELSE type END",
    "unit": "CASE WHEN size = 11 THEN '根~' ELSE unit END",
    "model": "CASE WHEN size % 5 = 0 THEN 'M' || size ELSE '' END",
    "brand": "CASE WHEN size % 2 = 0 THEN manufacturer ELSE '' END",
    "application": "CASE WHEN size % 10 = 0 THEN '化工' ELSE '' END",
    "related_materials": "CASE WHEN size % 6 = 1 THEN 'R1' ELSE '' END",
    "source_system": "source",
    "last_updated": "CASE WHEN size = 23 THEN 'soon' ELSE '20' || (20 + size % 5) || '-0' || (1 + size % 9) || '-15 00:00:00' END",
    "validation_status": "CASE size % 4 WHEN 0 THEN 'Approved' WHEN 1 THEN '已审核' WHEN 2 THEN 'pending' ELSE '' END",
    "category": "category",
}
ABSENT = ["technical_parameters", "notes", "supplier_info"]
REC = f"{ITEMS}, rec AS (SELECT code, " + ", ".join(f"{e} AS {c}" for c, e in FIELDS.items()) + ", " + ", ".join(f"'' AS {c}" for c in ABSENT) + " FROM items)"
ASOF = "2024-10-01"


def pts(cond, n):
    return f"(CASE WHEN {cond} THEN {n} ELSE 0 END)"


def share(names, n):
    return "(" + " + ".join(pts("trim(" + k + ") <> ''", 1) for k in names) + f") * {n}.0 / {len(names)}"


LEGAL = f"(regexp_matches(material_name, {q(R.LEGAL_NAME)}) AND NOT regexp_matches(material_name, {q(R.TEST_NAME)}))"
HITS = "(" + " + ".join(pts(f"regexp_matches(specification, {q(p)})", 1) for p in R.SPEC_PATTERNS) + ")"
SHARED = "len(list_distinct(list_intersect(regexp_extract_all(lower(material_name), '[\\p{L}\\p{N}_]{2,}'), regexp_extract_all(lower(specification), '[\\p{L}\\p{N}_]{2,}'))))"
BOTH = "(material_name <> '' AND specification <> '')"
UNITS = "lower(unit) IN (" + ", ".join(q(u) for u in R.STANDARD_UNITS) + ")"
ODD = {k: f"(NOT {sql_any(k, R.PLAIN_BRACKETS)} AND {sql_any(k, R.ODD_SYMBOLS)})" for k in Q.TEXT_FIELDS}
DAYS = f"floor((epoch_us(TIMESTAMP '{ASOF}') - epoch_us(TRY_CAST(last_updated AS TIMESTAMP))) / 86400000000)"
DIM = {
    "completeness": " + ".join([share(R.REQUIRED, 60), share(R.PREFERRED, 25), share(R.BONUS, 15)]),
    "accuracy": f"{pts('material_name <> ' + q('') + ' AND ' + LEGAL, 40)} + least(40, {HITS} * 15) + {pts('length(manufacturer) >= 2', 20)}",
    "consistency": f"CASE WHEN {BOTH} THEN least(40, {SHARED} * 10) ELSE 0 END + {pts(UNITS, 30)} + greatest(0, 30 - ({' + '.join(pts(o, 10) for o in ODD.values())}))",
    "richness": "CASE WHEN length(specification) > 50 THEN 20 WHEN length(specification) > 20 THEN 10 ELSE 0 END + least(20, "
    + " + ".join(pts(f"contains(specification, {q(w)})", 3) for w in R.TECH_WORDS) + ") + least(10, " + " + ".join(pts(f"{k} <> ''", 2) for k in R.ADDITIONAL)
    + f") + {pts('application <> ' + q(''), 15)} + {pts('length(category) > 5', 15)} + {pts('related_materials <> ' + q(''), 10)} + {pts('supplier_info <> ' + q('') + ' OR manufacturer <> ' + q(''), 10)}",
    "reliability": f"CASE WHEN {sql_any('source_system', R.TRUSTED_SOURCES)} THEN 40 WHEN source_system <> '' THEN 20 ELSE 0 END + CASE WHEN {DAYS} <= 30 THEN 30 WHEN {DAYS} <= 90 THEN 20 WHEN {DAYS} <= 365 THEN 10 ELSE 0 END"
    f" + CASE WHEN {sql_any('lower(validation_status)', R.APPROVED)} THEN 30 WHEN validation_status <> '' THEN 15 ELSE 0 END",
}


def note(cond, text):
    return f"CASE WHEN {cond} THEN {q(text)} END"


ISSUES = "concat_ws('|', " + ", ".join(
    [note(f"trim({k}) = ''", R.MISSING_REQUIRED.format(k)) for k in R.REQUIRED]
    + [note(f"material_name <> '' AND NOT {LEGAL}", R.BAD_NAME), note(f"specification <> '' AND {HITS} = 0", R.BAD_SPEC), note(f"{BOTH} AND {SHARED} = 0", R.NO_OVERLAP)]
    + [note(o, R.ODD_FIELD.format(k)) for k, o in ODD.items()] + [note("source_system = ''", R.NO_SOURCE), note("validation_status = ''", R.NO_STATUS)]) + ")"
SCORED = f"{REC}, dim AS (SELECT code, category, manufacturer, " + ", ".join(f"({e})::DOUBLE AS {k}" for k, e in DIM.items()) + f", {ISSUES} AS issues FROM rec)" + (
    ", tot AS (SELECT *, round(" + " + ".join(f"{k} * {w}::DOUBLE" for k, w in R.WEIGHTS.items()) + ", 2) AS overall_score FROM dim), "
    "scored AS (SELECT *, CASE WHEN overall_score >= 90 THEN 'A' WHEN overall_score >= 75 THEN 'B' WHEN overall_score >= 60 THEN 'C' ELSE 'D' END AS quality_grade FROM tot)")


def records(spark, d):
    return items(spark, d).select("code", "size", *[F.expr(e).alias(c) for c, e in FIELDS.items()])


def assessed(spark, d):
    return Q.assess(records(spark, d), F.expr(f"timestamp_ntz'{ASOF}'"))


def register_dimension(i: int, name: str) -> None:
    @query(f"q0{i}_{name}", f"WITH {SCORED} SELECT code, round({name}, 4) AS {name} FROM scored")
    def one(spark, d):
        return assessed(spark, d).select("code", F.round(name, 4).alias(name))


for _i, _name in enumerate(R.WEIGHTS, 1):
    register_dimension(_i, _name)


@query("q06_total_grade_issues", f"WITH {SCORED} SELECT code, overall_score, quality_grade, issues FROM scored")
def q06(spark, d):
    return assessed(spark, d).select("code", "overall_score", "quality_grade", F.array_join("issues", "|").alias("issues"))


@query("q07_batch_statistics", f"""WITH {SCORED} SELECT count(*) AS total, round(avg(overall_score), 2) AS average_score, {', '.join(f"count(*) FILTER (WHERE quality_grade = '{g}') AS grade_{g}" for g, _ in R.GRADES)},
 {', '.join(f'round(avg({k}), 4) AS mean_{k}' for k in R.WEIGHTS)} FROM scored""")
def q07(spark, d):
    s = Q.batch_statistics(assessed(spark, d))
    return s.withColumns({f"mean_{k}": F.round(f"mean_{k}", 4) for k in R.WEIGHTS})


def report_sql(source: str, head: str) -> str:
    return f"""WITH {SCORED}, r AS ({source}), i AS (SELECT unnest(string_split(issues, '|')) AS issue FROM r WHERE issues <> ''), c AS (SELECT issue, count(*) AS n FROM i GROUP BY 1 ORDER BY n DESC, issue LIMIT 5),
rep AS (SELECT round(avg(overall_score), 2) AS average_score, count(*) FILTER (WHERE quality_grade IN ('A', 'B')) * 1.0::DOUBLE / count(*) AS rate, count(*) FILTER (WHERE quality_grade = 'D') * 1.0 / count(*) AS poor,
 (SELECT string_agg(issue || ':' || n, '|' ORDER BY n DESC, issue DESC) FROM c) AS common_issues FROM r) {head}"""


REPORT_HEAD = "SELECT average_score, CASE WHEN average_score >= 75 THEN 'high' WHEN average_score >= 60 THEN 'medium' ELSE 'low' END AS quality_level, round(rate, 6) AS high_quality_rate, common_issues FROM rep"


def shown(rep):
    return rep.select("average_score", "quality_level", F.round("high_quality_rate", 6).alias("high_quality_rate"),
                      F.array_join(F.transform("common_issues", lambda x: F.concat_ws(":", x["issue"], x["frequency"])), "|").alias("common_issues"))


@query("q08_quality_report", report_sql("SELECT * FROM scored", REPORT_HEAD))
def q08(spark, d):
    return shown(Q.report(assessed(spark, d)))


ADVICE = "concat_ws('|', " + ", ".join([note("average_score < 60", t) for t in R.LOW_AVERAGE] + [note("poor > 0.3", R.MANY_POOR)] + [
    "CASE " + " ".join(f"WHEN contains(split_part(common_issues, '|', {i}), {q(w)}) THEN {q(t)}" for w, t in R.BY_ISSUE) + " END" for i in (1, 2, 3)]) + ")"


@query("q09_recommendations", report_sql("SELECT * FROM scored", f"SELECT {ADVICE} AS recommendations FROM rep"))
def q09(spark, d):
    return Q.recommendations(Q.report(assessed(spark, d))).select(F.array_join("recommendations", "|").alias("recommendations"))


def classified(spark, d):
    """The classifiers' answer for each item: the first that is confident enough."""
    return C.priority_cascade(*results(spark, d)).withColumnRenamed("item_id", "code")


CLASSIFIED = f"cl AS (SELECT * FROM (WITH {CASCADE} SELECT item_id, category AS answer, confidence FROM cas))"


@query("q10_integrated_score", f"""WITH {SCORED}, {CLASSIFIED}, x AS (SELECT code, answer AS category, confidence, overall_score, quality_grade,
 round(confidence * 0.6::DOUBLE + overall_score / 100 * 0.4::DOUBLE, 4) AS integrated FROM scored JOIN cl ON item_id = code)
SELECT code, category, round(confidence, 6)::DOUBLE AS confidence, overall_score, quality_grade, integrated,
 CASE WHEN integrated >= 0.8 THEN 'high_confidence' WHEN integrated >= 0.6 THEN 'medium_confidence' ELSE 'low_confidence' END AS band FROM x""")
def q10(spark, d):
    return Q.integrated(classified(spark, d), assessed(spark, d), "code").withColumn("confidence", F.round("confidence", 6))


@query("q11_filtered_report", report_sql("SELECT * FROM scored WHERE category = '法兰'", REPORT_HEAD))
def q11(spark, d):
    return shown(Q.filtered_report(records(spark, d), F.expr(f"timestamp_ntz'{ASOF}'"), "code", category="法兰"))


@query("q12_batch_stages", f"""WITH RECURSIVE {GROUPS}, {CLASSIFIED}
SELECT count(*) AS total, count(*) FILTER (WHERE confidence >= 0.6) AS classified, count(*) AS assessed, (SELECT count(*) FROM rowm) AS in_duplicate_group FROM cl""")
def q12(spark, d):
    return Q.stage_counts(items(spark, d), classified(spark, d), assessed(spark, d), run(spark, d).members, "code")
