"""Category codes, hierarchy and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partwise.rules.training import COVERAGE_PREFIXES
from partwise.sources.writers import latest_per_key


def level(code: Column) -> Column:
    """1: two or three characters starting with A; 2: up to five, digits after the second; 3: six or more; else 1."""
    c, n = F.trim(F.coalesce(code, F.lit(""))), F.length(F.trim(F.coalesce(code, F.lit(""))))
    return (F.when((n <= 3) & (n >= 2) & c.startswith("A"), 1).when((n <= 5) & F.substring(c, 3, 5).rlike("^[0-9]+$"), 2)
            .when(n >= 6, 3).otherwise(1))


def parent(code: Column, lvl: Column) -> Column:
    n = F.length(code)
    cut = F.substring(code, F.lit(1), n - 2)
    return F.when((lvl == 2) & (n >= 4), cut).when((lvl == 3) & (n >= 6), cut)


def import_categories(raw: DataFrame, seq: str) -> DataFrame:
    """Trimmed rows with code and name, level and parent from the code, the last row of a repeated code."""
    cols = {c: F.trim(F.col(c)) for c, t in raw.dtypes if t == "string"}
    rows = raw.withColumns(cols).filter((F.coalesce("code", F.lit("")) != "") & (F.coalesce("name", F.lit("")) != ""))
    one = latest_per_key(rows, ["code"], [F.col(seq)])
    lvl = one.withColumn("level", level(F.col("code")))
    return lvl.withColumns({"parent_code": parent(F.col("code"), F.col("level")), "sort_order": F.col(seq)})


def mark_leaves(cats: DataFrame) -> DataFrame:
    parents = cats.select(F.col("parent_code").alias("code")).filter("code IS NOT NULL").distinct().withColumn("has_child", F.lit(True))
    return cats.join(parents, "code", "left").withColumn("is_leaf", F.col("has_child").isNull()).drop("has_child")


def tree(cats: DataFrame, depth: int = 3) -> DataFrame:
    """Every node reachable from a level-1 root: path of codes, depth, and its child codes in order.

    Codes fix the depth, so one equi join per level replaces recursion.
    """
    nodes = cats.select("code", "name", "parent_code", "level")
    ring = nodes.filter("level = 1").select("code", "name", F.col("code").alias("path"), F.lit(1).alias("depth"))
    out = ring
    for d in range(2, depth + 1):
        up = ring.select(F.col("code").alias("parent_code"), F.col("path").alias("up"))
        ring = nodes.join(up, "parent_code").select("code", "name", F.concat_ws("/", "up", "code").alias("path"), F.lit(d).alias("depth"))
        out = out.unionByName(ring)
    kids = nodes.filter("parent_code IS NOT NULL").groupBy(F.col("parent_code").alias("code")).agg(F.array_sort(F.collect_list("code")).alias("children"))
    return out.join(kids, "code", "left").withColumn("children", F.coalesce("children", F.array().cast("array<string>")))


def children_of(cats: DataFrame, parent_code: str | None = None) -> DataFrame:
    df = cats.filter(F.col("parent_code") == parent_code) if parent_code is not None else cats
    return df.orderBy("level", "name")


def statistics(cats: DataFrame) -> DataFrame:
    """Long form: total, leaves, counts per level, template and level-1 prefix."""
    rows = F.array(
        F.struct(F.lit("total").alias("metric"), F.lit(1).alias("one")),
        F.when(F.col("is_leaf"), F.struct(F.lit("leaf").alias("metric"), F.lit(1).alias("one"))),
        F.struct(F.concat(F.lit("level_"), "level").alias("metric"), F.lit(1).alias("one")),
        F.when(F.coalesce("template", F.lit("")) != "", F.struct(F.concat(F.lit("template_"), "template").alias("metric"), F.lit(1).alias("one"))),
        F.when(F.col("level") == 1, F.struct(F.concat(F.lit("prefix_"), F.substring("code", 1, 1)).alias("metric"), F.lit(1).alias("one"))))
    return cats.select(F.explode(F.array_compact(rows)).alias("r")).groupBy("r.metric").agg(F.count("*").alias("value"))


def coverage(cats: DataFrame) -> DataFrame:
    """Share of the expected level-1 prefixes present, as a percentage of at most 95."""
    first = F.substring("code", 1, 1)
    found = cats.filter((F.col("level") == 1) & first.isin(COVERAGE_PREFIXES)).agg(F.count_distinct(first).alias("n"))
    return found.select(F.least(F.lit(95.0), F.col("n") / len(COVERAGE_PREFIXES) * 100).alias("coverage_rate"))


def feature_template(features: DataFrame, category: str, column: str = "category_id") -> DataFrame:
    """Ordered features of a category with the options JSON parsed."""
    return features.filter(F.col(column) == category).withColumn("options", F.from_json("options", "array<string>")).orderBy("display_order")


def by_level(cats: DataFrame) -> DataFrame:
    return cats.groupBy("level").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("name")).alias("names"))
