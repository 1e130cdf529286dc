"""Stratified and head/tail splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partwise.rules import training as T


def share(count: Column, total: Column, category: Column, favoured: list[str] | None = None) -> Column:
    """Rows of a category that go to the database: 1 to 30%, its part of the target size, half for favoured ones."""
    base = F.greatest(F.lit(1), F.least(F.floor(count * T.SAMPLE_SHARE), F.floor(F.lit(T.SAMPLE_TARGET) * count / total)))
    return F.when(category.isin(T.FAVOURED if favoured is None else favoured), F.greatest(base, F.least(count, F.floor(count * T.FAVOURED_SHARE)))).otherwise(base)


def stratified_split(df: DataFrame, ident: str, category: str, seed: int = 42, favoured: list[str] | None = None) -> DataFrame:
    """Adds ``part``: database or test, and ``dropped`` where the database size limit cuts.

    The n smallest seeded hashes of a category are chosen. Counts per (category, hash bucket)
    tell which bucket holds the n-th, and only that bucket's rows are ranked, so a category
    with a third of all rows is never sorted in one task.
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(ident).cast("string")))
    rows = df.withColumns({"_h": h, "_b": F.substring(h, 1, 3)})
    buckets = rows.groupBy(category, "_b").agg(F.count("*").alias("n"))
    upto = F.expr(f"sum(n) OVER (PARTITION BY {category} ORDER BY _b)")
    total = df.agg(F.count("*").alias("_all"))
    sized = buckets.withColumns({"_upto": upto, "_count": F.expr(f"sum(n) OVER (PARTITION BY {category})")}).crossJoin(F.broadcast(total))
    want = sized.withColumn("_want", share(F.col("_count"), F.col("_all"), F.col(category), favoured))
    plan = want.select(category, "_b", (F.col("_upto") - F.col("n")).alias("_before"), "_upto", "_want")
    joined = rows.join(plan, [category, "_b"])
    whole = joined.filter(F.col("_upto") <= F.col("_want")).withColumn("part", F.lit("database"))
    none = joined.filter(F.col("_before") >= F.col("_want")).withColumn("part", F.lit("test"))
    edge = joined.filter((F.col("_upto") > F.col("_want")) & (F.col("_before") < F.col("_want")))
    place = F.expr(f"row_number() OVER (PARTITION BY {category}, _b ORDER BY _h, {ident})")
    split = edge.withColumn("part", F.when(place + F.col("_before") <= F.col("_want"), "database").otherwise("test"))
    out = whole.unionByName(none).unionByName(split).select(*df.columns, "part", "_h")
    cut = out.filter("part = 'database'").orderBy("_h", ident).limit(T.SAMPLE_TARGET).agg(F.max(F.struct("_h", F.col(ident).alias("_i"))).alias("_last"))
    over = F.struct("_h", F.col(ident).alias("_i")) > F.col("_last")
    return out.crossJoin(F.broadcast(cut)).withColumn("dropped", (F.col("part") == "database") & over).drop("_h", "_last")


def head_tail(df: DataFrame, order: str, size: int = T.SAMPLE_TARGET) -> DataFrame:
    """Adds ``part``: the first ``size`` rows by a unique order are head, the rest tail; only the cut-off key is found by sorting."""
    cut = df.select(order).orderBy(order).limit(size).agg(F.max(order).alias("_cut"))
    return df.crossJoin(F.broadcast(cut)).withColumn("part", F.when(F.col(order) <= F.col("_cut"), "head").otherwise("tail")).drop("_cut")


def difference(df: DataFrame, taken: DataFrame, key: list[str]) -> DataFrame:
    return df.join(taken.select(*key), key, "left_anti")
