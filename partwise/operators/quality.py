"""Quality scores of item records: five dimensions, grade, issues and suggestions, all row-local expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partwise.functions.text import WORD2, contains_any
from partwise.rules import quality as R

TEXT_FIELDS = [
    "material_name", "specification", "manufacturer", "material_type", "unit", "model", "brand", "technical_parameters", "application",
    "notes", "related_materials", "supplier_info", "source_system", "last_updated", "validation_status",
]


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _points(cond: Column, n: float) -> Column:
    return F.when(cond, F.lit(float(n))).otherwise(0.0)


def _note(cond: Column, text: str) -> Column:
    return F.when(cond, F.lit(text))


class Dimension:
    """Score with the messages raised on the way."""

    def __init__(self, score: Column, issues: list[Column] = (), suggestions: list[Column] = ()):
        self.score, self.issues, self.suggestions = score, list(issues), list(suggestions)


def completeness(f: dict[str, Column]) -> Dimension:
    full = {k: F.trim(f[k]) != "" for k in [*R.REQUIRED, *R.PREFERRED, *R.BONUS]}
    share = lambda names, n: _sum([_points(full[k], 1) for k in names]) / len(names) * n
    return Dimension(
        share(R.REQUIRED, 60) + share(R.PREFERRED, 25) + share(R.BONUS, 15),
        [_note(~full[k], R.MISSING_REQUIRED.format(k)) for k in R.REQUIRED],
        [_note(~full[k], R.FILL_REQUIRED.format(k)) for k in R.REQUIRED] + [_note(~full[k], R.FILL_PREFERRED.format(k)) for k in R.PREFERRED])


def accuracy(f: dict[str, Column]) -> Dimension:
    name, spec, maker = f["material_name"], f["specification"], f["manufacturer"]
    legal = name.rlike(R.LEGAL_NAME) & ~name.rlike(R.TEST_NAME)
    hits = _sum([_points(spec.rlike(p), 1) for p in R.SPEC_PATTERNS])
    bad_name, bad_spec = (name != "") & ~legal, (spec != "") & (hits == 0)
    score = _points((name != "") & legal, 40) + F.least(F.lit(40.0), hits * 15) + _points(F.length(maker) >= 2, 20)
    return Dimension(score, [_note(bad_name, R.BAD_NAME), _note(bad_spec, R.BAD_SPEC)],
                     [_note(bad_name, R.FIX_NAME), _note(bad_spec, R.FIX_SPEC), _note(F.length(maker) == 1, R.SHORT_MAKER)])


def consistency(f: dict[str, Column]) -> Dimension:
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(WORD2), F.lit(0))
    name, spec, unit = f["material_name"], f["specification"], f["unit"]
    both = (name != "") & (spec != "")
    shared = F.size(F.array_intersect(words(name), words(spec)))
    standard = F.lower(unit).isin(R.STANDARD_UNITS)
    odd = {k: ~contains_any(c, R.PLAIN_BRACKETS) & contains_any(c, R.ODD_SYMBOLS) for k, c in f.items()}
    form = F.greatest(F.lit(0.0), F.lit(30.0) - _sum([_points(o, 10) for o in odd.values()]))
    score = F.when(both, F.least(F.lit(40.0), shared * 10.0)).otherwise(0.0) + _points(standard, 30) + form
    apart = both & (shared == 0)
    return Dimension(score, [_note(apart, R.NO_OVERLAP)] + [_note(o, R.ODD_FIELD.format(k)) for k, o in odd.items()],
                     [_note(apart, R.FIX_OVERLAP), F.when((unit != "") & ~standard, F.format_string(R.FIX_UNIT.replace("{}", "%s"), unit))])


def richness(f: dict[str, Column], category: Column) -> Dimension:
    spec = f["specification"]
    score = (F.when(F.length(spec) > 50, 20.0).when(F.length(spec) > 20, 10.0).otherwise(0.0)
             + F.least(F.lit(20.0), _sum([_points(F.contains(spec, F.lit(w)), 3) for w in R.TECH_WORDS]))
             + F.least(F.lit(10.0), _sum([_points(f[k] != "", 2) for k in R.ADDITIONAL]))
             + _points(f["application"] != "", 15) + _points(F.length(category) > 5, 15)
             + _points(f["related_materials"] != "", 10) + _points((f["supplier_info"] != "") | (f["manufacturer"] != ""), 10))
    return Dimension(score, [], [_note(score < 60, R.MORE_DETAIL), _note(score < 40, R.TOO_SIMPLE)])


def reliability(f: dict[str, Column], asof: Column) -> Dimension:
    source, status, when = f["source_system"], F.lower(f["validation_status"]), f["last_updated"]
    trusted, approved = contains_any(source, R.TRUSTED_SOURCES), contains_any(status, R.APPROVED)
    stamp = when.try_cast("timestamp_ntz")
    days = F.floor((F.unix_micros(asof.cast("timestamp")) - F.unix_micros(stamp.cast("timestamp"))) / 86_400_000_000)
    age = F.when(stamp.isNull(), 0.0)
    for limit, points in R.AGE_POINTS:
        age = age.when(days <= limit, float(points))
    oldest = R.AGE_POINTS[-1][0]
    score = (F.when(trusted, 40.0).when(source != "", 20.0).otherwise(0.0) + age.otherwise(0.0)
             + F.when(approved, 30.0).when(status != "", 15.0).otherwise(0.0))
    return Dimension(
        score, [_note(source == "", R.NO_SOURCE), _note(status == "", R.NO_STATUS)],
        [_note((source != "") & ~trusted, R.CHECK_SOURCE), _note(source == "", R.NAME_SOURCE), _note(days > oldest, R.OLD_DATA),
         _note((when != "") & stamp.isNull(), R.BAD_TIME), _note((status != "") & ~approved, R.FINISH_REVIEW), _note(status == "", R.FILL_STATUS)])


def assess(df: DataFrame, asof: Column) -> DataFrame:
    """Adds the five dimension scores, ``overall_score``, ``quality_grade``, ``issues`` and ``suggestions``.

    Missing columns count as blank. ``asof`` is the day ages are measured from.
    """
    f = {k: F.coalesce(F.col(k).cast("string"), F.lit("")) if k in df.columns else F.lit("") for k in TEXT_FIELDS}
    category = F.coalesce(F.col("category").cast("string"), F.lit("")) if "category" in df.columns else f["material_type"]
    dims = {"completeness": completeness(f), "accuracy": accuracy(f), "consistency": consistency(f),
            "richness": richness(f, category), "reliability": reliability(f, asof)}
    scored = df.withColumns({k: x.score for k, x in dims.items()} | {
        "issues": F.array_compact(F.array(*[m for x in dims.values() for m in x.issues])),
        "suggestions": F.array_compact(F.array(*[m for x in dims.values() for m in x.suggestions]))})
    total = F.round(_sum([F.col(k) * w for k, w in R.WEIGHTS.items()]), 2)
    grade = F.when(F.lit(False), "")
    for g, at in R.GRADES:
        grade = grade.when(F.col("overall_score") >= at, g)
    return scored.withColumn("overall_score", total).withColumn("quality_grade", grade.otherwise("D"))


def batch_statistics(assessed: DataFrame) -> DataFrame:
    return assessed.agg(F.count("*").alias("total"), F.round(F.avg("overall_score"), 2).alias("average_score"),
                        *[F.count_if(F.col("quality_grade") == g).alias(f"grade_{g}") for g, _ in R.GRADES],
                        *[F.avg(k).alias(f"mean_{k}") for k in R.WEIGHTS])


def common_issues(assessed: DataFrame, top: int = 5) -> DataFrame:
    return assessed.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("frequency")).orderBy(
        F.desc("frequency"), "issue").limit(top)


def report(assessed: DataFrame) -> DataFrame:
    """One row: level, share of A and B, grade counts, and the five most frequent issues in order."""
    stats = batch_statistics(assessed)
    top = common_issues(assessed).agg(F.sort_array(F.collect_list(F.struct("frequency", "issue")), asc=False).alias("common_issues"))
    avg = F.col("average_score")
    return stats.crossJoin(top).select(
        avg, F.when(avg >= 75, "high").when(avg >= 60, "medium").otherwise("low").alias("quality_level"),
        ((F.col("grade_A") + F.col("grade_B")) / F.col("total")).alias("high_quality_rate"), *[f"grade_{g}" for g, _ in R.GRADES], "common_issues")


def recommendations(rep: DataFrame) -> DataFrame:
    """Advice from the mean, the share of D and the three most frequent issues."""
    total = _sum([F.col(f"grade_{g}") for g, _ in R.GRADES])
    issue = lambda i: F.coalesce(F.get("common_issues", F.lit(i))["issue"], F.lit(""))
    by_issue = [reduce(lambda a, r: a.when(F.contains(issue(i), F.lit(r[0])), r[1]), R.BY_ISSUE, F.when(F.lit(False), "")) for i in range(3)]
    notes = [_note(F.col("average_score") < 60, t) for t in R.LOW_AVERAGE] + [_note(F.col("grade_D") / total > R.POOR_LIMIT, R.MANY_POOR)]
    return rep.select(F.array_compact(F.array(*notes, *by_issue)).alias("recommendations"))


def integrated(classified: DataFrame, assessed: DataFrame, key: str) -> DataFrame:
    """Classification and quality joined per item: 0.6 and 0.4, three bands."""
    score = F.col("confidence") * R.CLASSIFICATION_WEIGHT + F.col("overall_score") / 100 * R.QUALITY_WEIGHT
    out = classified.select(key, "category", "confidence").join(assessed.select(key, "overall_score", "quality_grade"), key)
    return out.withColumn("integrated", F.round(score, 4)).withColumn("band", F.when(
        F.col("integrated") >= R.HIGH_CONFIDENCE, "high_confidence").when(F.col("integrated") >= R.MEDIUM_CONFIDENCE, "medium_confidence").otherwise("low_confidence"))


def filtered_report(df: DataFrame, asof: Column, order: str, category: str | None = None, maker: str | None = None, limit: int | None = None) -> DataFrame:
    """The report over the rows of a category or maker: all of them, or the first ``limit`` by ``order``."""
    for name, value in (("category", category), ("manufacturer", maker)):
        if value is not None:
            df = df.filter(F.col(name) == value)
    return report(assess(df if limit is None else df.orderBy(order).limit(limit), asof))


def stage_counts(df: DataFrame, classified: DataFrame, assessed: DataFrame, members: DataFrame, key: str, at: float = 0.6) -> DataFrame:
    """Batch summary: rows in, classified with confidence, assessed, and found in a duplicate group."""
    flags = (df.select(key).join(classified.select(key, (F.col("confidence") >= at).alias("ok_class")), key, "left")
             .join(assessed.select(key, F.col("overall_score").isNotNull().alias("ok_quality")), key, "left")
             .join(members.select(F.col("code").alias(key), F.lit(True).alias("in_group")), key, "left"))
    return flags.agg(F.count("*").alias("total"), F.count_if("ok_class").alias("classified"), F.count_if("ok_quality").alias("assessed"),
                     F.count_if("in_group").alias("in_duplicate_group"))
