"""Reports over results: counts, buckets and rates, each one pass of aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partwise.rules import dedup as R
from partwise.sources.writers import latest_per_key


def confidence_buckets(c: Column) -> list[Column]:
    return [F.count_if(c >= R.HIGH).alias("high"), F.count_if((c >= R.MEDIUM) & (c < R.HIGH)).alias("medium"), F.count_if(c < R.MEDIUM).alias("low")]


def dedup_report(groups: DataFrame, by: str | None = None) -> DataFrame:
    c = F.col("similarity")
    keyed = groups.groupBy(by) if by else groups.groupBy()
    return keyed.agg(F.count_distinct("master").alias("total_groups"), F.avg(c).alias("avg_confidence"), *confidence_buckets(c))


def dedup_statistics(rows: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """Per source: rows, rows in a duplicate group; the overall rate counts every member but the masters."""
    involved = rows.join(members.select("code"), "code", "left_semi").groupBy("source").agg(F.count("*").alias("involved"))
    total = rows.groupBy("source").agg(F.count("*").alias("total"))
    extra = members.agg(F.count_if(F.col("code") != F.col("master")).alias("duplicates"))
    overall = rows.agg(F.count("*").alias("all_rows"))
    rate = extra.crossJoin(overall).select((F.col("duplicates") / F.col("all_rows")).alias("duplication_rate"))
    return total.join(involved, "source", "left").select(
        "source", "total", F.coalesce("involved", F.lit(0)).alias("involved")).crossJoin(F.broadcast(rate))


def action_summary(recommended: DataFrame) -> DataFrame:
    return recommended.agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("auto_merge", "manual_review", "separate")],
                           F.count("*").alias("total_groups"))


def master_dashboard(df: DataFrame, category: str, maker: str) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.count_distinct(category).alias("categories"), F.count_distinct(maker).alias("makers"))


def value_counts(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    out = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")
    return out.limit(limit) if limit is not None else out


def platform_statistics(files: DataFrame, results: DataFrame, asof: Column) -> DataFrame:
    """files(rows, uploaded_at), results(kind): long form of the counters."""
    day = F.col("uploaded_at") > asof - F.expr("INTERVAL 24 HOURS")
    f = files.agg(F.count("*").alias("files"), F.sum("rows").alias("rows"), F.count_if(day).alias("last_24h"))
    long = f.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("bigint").alias("value")) for c in f.columns])).alias("m"))
    kinds = results.groupBy(F.concat(F.lit("type_"), "kind").alias("metric")).agg(F.count("*").alias("value"))
    return long.select("m.*").unionByName(kinds)


def training_statistics(samples: DataFrame, sessions: DataFrame) -> DataFrame:
    s = samples.agg(F.count("*").alias("samples"), F.count_distinct("category").alias("categories"), F.count_distinct("brand").alias("brands"))
    m = sessions.agg(F.count_distinct("session_id").alias("sessions"), F.count_if("is_active").alias("active_models"))
    return s.crossJoin(m)  # two one-row totals


def retention(files: DataFrame, results: DataFrame, asof: Column, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """Files older than the limit are flagged deleted; old results are dropped."""
    since = asof - F.make_dt_interval(F.lit(days))
    kept = files.withColumn("is_deleted", F.col("is_deleted") | (F.col("uploaded_at") < since))
    return kept, results.filter(F.col("created_at") >= since)


def evaluation(results: DataFrame) -> DataFrame:
    """Per difficulty: mean confidences, correct answers of both classifiers, and cases improved by more than 5 points."""
    gain = F.col("enhanced_confidence") - F.col("original_confidence")
    return results.groupBy("difficulty").agg(
        F.count("*").alias("cases"), F.avg("original_confidence").alias("original_mean"), F.avg("enhanced_confidence").alias("enhanced_mean"),
        F.count_if("original_correct").alias("original_correct"), F.count_if("enhanced_correct").alias("enhanced_correct"),
        F.avg(gain).alias("mean_gain"), F.count_if(gain > 5).alias("improved"))


def latest(df: DataFrame, keys: list[str], order: list[str], active: Column | None = None) -> DataFrame:
    return latest_per_key(df.filter(active) if active is not None else df, keys, [F.col(o) for o in order])
