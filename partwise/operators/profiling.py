"""Column profiles and source recognition.

Distinct values are counted once per (field, value), so a value that fills a third of
a column is combined before the shuffle and every statistic reads that reduced table.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwise.operators.mapping import industry_mapping, text
from partwise.rules import industry as I


def long_form(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    fields = fields or df.columns
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("value")) for f in fields])
    return df.select(F.explode(pairs).alias("p")).select("p.*")


def value_counts(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    return long_form(df, fields).groupBy("field", "value").agg(F.count("*").alias("n"))


def column_stats(df: DataFrame) -> DataFrame:
    """Type, nulls, distinct values and row count of each column."""
    kinds = F.create_map(*[x for f in df.schema.fields for x in (F.lit(f.name), F.lit(f.dataType.simpleString()))])
    return value_counts(df).groupBy("field").agg(
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("null_count"),
        F.count("value").alias("distinct_count"), F.sum("n").alias("row_count"),
    ).withColumn("data_type", kinds[F.col("field")])


def field_types(counts: DataFrame) -> DataFrame:
    """numeric when over 70% of non-empty values parse, categorical when distinct/total < 0.1, else text."""
    filled = F.coalesce(F.col("value"), F.lit("")) != ""
    number = F.regexp_replace("value", "[, ]", "").try_cast("double").isNotNull()
    agg = counts.groupBy("field").agg(
        F.sum(F.when(filled, F.col("n")).otherwise(0)).alias("total"),
        F.sum(F.when(filled & number, F.col("n")).otherwise(0)).alias("parsed"),
        F.count_distinct(F.when(filled, F.trim("value"))).alias("uniq"))
    kind = (F.when(F.col("total") == 0, "unknown").when(F.col("parsed") / F.col("total") > 0.7, "numeric")
            .when(F.col("uniq") / F.col("total") < 0.1, "categorical").otherwise("text"))
    return agg.select("field", kind.alias("field_type"))


def length_stats(counts: DataFrame) -> DataFrame:
    """Length min, max, mean and population deviation of non-blank values."""
    size, n = F.length("value"), F.col("n")
    agg = counts.filter(F.trim(F.coalesce("value", F.lit(""))) != "").groupBy("field").agg(
        F.min(size).alias("min_len"), F.max(size).alias("max_len"), F.sum(n).alias("c"),
        F.sum(size * n).alias("s"), F.sum(size * size * n).alias("q"))
    mean = F.col("s") / F.col("c")
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("c") - mean * mean))
    return agg.select("field", "min_len", "max_len", mean.alias("avg_len"), std.alias("std_len"))


# Pattern flags of a field's values.
FLAGS = {
    "contains_numbers": "[0-9]+",
    "contains_special_chars": r"[/\-*+()]",
    "contains_units": r"(?i)[0-9]+\s*(mm|cm|m|kg|g|ml|l)",
}


def pattern_flags(counts: DataFrame) -> DataFrame:
    hit = [F.coalesce(F.bool_or(F.col("value").rlike(p)), F.lit(False)).alias(k) for k, p in FLAGS.items()]
    return counts.groupBy("field").agg(*hit)


def value_distribution(counts: DataFrame, top: int = 5) -> DataFrame:
    """Filled count, distinct, blank count and the most common values as ``value:count`` text."""
    filled = counts.filter(F.coalesce("value", F.lit("")) != "")
    stats = filled.groupBy("field").agg(
        F.sum("n").alias("total_count"), F.count("*").alias("unique_count"),
        F.sum(F.when(F.trim("value") == "", F.col("n")).otherwise(0)).alias("blank_count"))
    rank = F.expr("row_number() OVER (PARTITION BY field ORDER BY n DESC, value)")
    best = filled.withColumn("rank", rank).filter(F.col("rank") <= top)
    shown = F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))), lambda x: F.concat_ws(":", x["value"], x["n"]))
    return stats.join(best.groupBy("field").agg(F.array_join(shown, "|").alias("most_common")), "field")


def _occurrences(body, word: str):
    return (F.length(body) - F.length(F.replace(body, F.lit(word), F.lit("")))) / F.lit(len(word))


#: Rows that the saturation of the industry scores is meant for.
DENSITY_ROWS = 100


def industry_scores(df: DataFrame, by: str | None = None) -> DataFrame:
    """Score of every industry, of each source where its column ``by`` is named: weighted share of indicator occurrences, each kind saturating at one per indicator.

    Occurrences are counted over all rows and beyond ``DENSITY_ROWS`` scaled down to that many,
    so that a score says how dense an industry's indicators are, however many rows there are.
    Rows alike in all columns are read once.
    """
    body = F.concat_ws(", ", *[F.concat(F.lit(f"{c}: "), text(c)) for c in df.columns if c != by])
    keys = [by] if by else []
    sums = []
    for name, kinds in I.INDICATORS.items():
        for kind in I.KIND_WEIGHTS:
            if kind == "patterns":
                hits = [F.regexp_count(F.col("body"), F.lit("(?i)" + p)) for p in kinds[kind]]
            else:
                hits = [_occurrences(F.col("body"), w) for w in kinds[kind]]
            total = F.sum(sum(hits[1:], hits[0]) * F.col("n")) * F.least(F.lit(1.0), F.lit(float(DENSITY_ROWS)) / F.sum("n"))
            sums.append(F.least(total / len(kinds[kind]), F.lit(1.0)).alias(f"{name}_{kind}"))
    flat = df.select(*keys, body.alias("body")).groupBy(*keys, "body").agg(F.count("*").alias("n")).groupBy(*keys).agg(*sums)
    rows = F.array(*[
        F.struct(F.lit(i).alias("rank"), F.lit(name).alias("industry"),
                 sum((F.col(f"{name}_{k}") * w for k, w in I.KIND_WEIGHTS.items()), F.lit(0.0)).alias("score"))
        for i, name in enumerate(I.INDICATORS)])
    return flat.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def recognise_industry(scores: DataFrame, by: str | None = None) -> DataFrame:
    """Best industry (of each source), the first listed on a tie; generic with confidence 0 below the minimum score."""
    keys = [by] if by else []
    best = scores.groupBy(*keys).agg(F.max_by(F.struct("industry", "score"), F.struct("score", -F.col("rank"))).alias("b"))
    known = F.col("b.score") >= I.MIN_INDUSTRY_SCORE
    return best.select(*keys, F.when(known, F.col("b.industry")).otherwise("generic").alias("industry"),
                       F.when(known, F.col("b.score")).otherwise(F.lit(0.0)).alias("confidence"))


def source_quality(counts: DataFrame) -> DataFrame:
    """Completeness and masked-pattern consistency of each field."""
    value = F.coalesce("value", F.lit(""))
    masked = counts.withColumn("mask", F.regexp_replace(value, "[0-9]+", "N"))
    per_mask = masked.groupBy("field", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.trim(value) != "", F.col("n")).otherwise(0)).alias("filled"))
    return per_mask.groupBy("field").agg(
        (F.sum("filled") / F.sum("n")).alias("completeness"),
        F.greatest(F.lit(0.0), 1 - F.count("*") / F.sum("n")).alias("consistency"))


def overall_quality(fields: DataFrame) -> DataFrame:
    return fields.agg(F.avg("completeness").alias("overall_completeness"), F.avg("consistency").alias("overall_consistency"),
                      F.count("*").alias("field_count")).withColumn(
        "overall_quality", F.col("overall_completeness") * 0.6 + F.col("overall_consistency") * 0.4)


def source_schema(df: DataFrame, source_id: str) -> DataFrame:
    """One nested row: industry, field types, header mapping per industry, quality and confidence."""
    counts = value_counts(df)
    types = field_types(counts).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "field_type")))).alias("field_types"))
    maps = {name: industry_mapping(df.columns, name) for name in ("manufacturing", "medical", "generic")}
    literal = F.create_map(*[
        x for name, m in maps.items()
        for x in (F.lit(name), F.create_map(*[F.lit(v) for kv in m.items() for v in kv]) if m else F.lit(None).cast("map<string,string>"))])
    industry = recognise_industry(industry_scores(df))
    quality = overall_quality(source_quality(counts))
    # Three one-row aggregates side by side.
    one = industry.crossJoin(types).crossJoin(quality)
    return one.select(F.lit(source_id).alias("source_id"), F.col("industry").alias("industry_type"), "field_types",
                      literal[F.col("industry")].alias("field_mappings"),
                      F.struct("overall_completeness", "overall_consistency", "overall_quality", "field_count").alias("quality_metrics"),
                      F.col("confidence").alias("confidence_score"))


def field_combinations(df: DataFrame, fields: list[str], by: str | None = None) -> DataFrame:
    """Support of each 2- and 3-field combination (in each source); rows collapse to their population pattern first."""
    keys = [by] if by else []
    filled = F.array_compact(F.array(*[F.when(text(f) != "", F.lit(f)) for f in fields]))
    patterns = df.groupBy(*keys, filled.alias("filled")).agg(F.count("*").alias("n"))
    combos = [c for k in (2, 3) for c in combinations(sorted(fields), k)]
    listed = F.array(*[F.array(*[F.lit(f) for f in c]) for c in combos])
    # Patterns number at most 2^fields whatever the row count, so one counting window over them is small.
    total = F.expr(f"sum(n) OVER ({f'PARTITION BY {by}' if by else ''})")
    hit = F.explode(F.filter(listed, lambda c: F.size(F.array_except(c, F.col("filled"))) == 0))
    exploded = patterns.withColumn("total", total).select(*keys, "n", "total", hit.alias("combo"))
    return exploded.groupBy(*keys, F.array_join("combo", ",").alias("fields"), "total").agg(
        F.sum("n").alias("n")).select(*keys, "fields", (F.col("n") / F.col("total")).alias("support"))


# Base weights of the fields in a combination.
BASE_FIELD_WEIGHTS = {"material_name": 0.4, "specification": 0.3, "manufacturer": 0.15, "category": 0.35, "model": 0.2, "standard": 0.1}
DEFAULT_FIELD_WEIGHT = 0.1


def combination_weights(combos: DataFrame, min_support: float = 0.3) -> DataFrame:
    """Combinations above the support, one row per field with its normalised weight."""
    base = F.create_map(*[F.lit(x) for kv in BASE_FIELD_WEIGHTS.items() for x in kv])
    names = F.split("fields", ",")
    weights = F.transform(names, lambda f: F.coalesce(base[f], F.lit(DEFAULT_FIELD_WEIGHT)))
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    kept = combos.filter(F.col("support") > min_support).withColumn("total_weight", total)
    return kept.select("fields", "support", "total_weight", F.explode(F.arrays_zip(names.alias("field"), weights.alias("w"))).alias("z")).select(
        "fields", "support", F.col("z.field").alias("field"), (F.col("z.w") / F.col("total_weight")).alias("weight"))
