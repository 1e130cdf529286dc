"""Lexicon mining, rule tables, and learning of quality and similarity weights."""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partwise.functions.text import WORD2, contains_any, first_contained, tokens
from partwise.operators.mapping import rename, training_mapping
from partwise.rules import dedup as DR
from partwise.rules import training as T


def token_frequency(names: DataFrame, text: str, at_least: int = 5) -> DataFrame:
    words = names.select(F.explode(tokens(F.col(text), WORD2)).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") >= at_least)


def maker_categories(makers: DataFrame, column: str) -> DataFrame:
    one = makers.select(F.col(column).alias("manufacturer")).filter("manufacturer <> ''").distinct()
    return one.withColumn("category", first_contained(F.lower("manufacturer"), T.MAKER_RULES, T.MAKER_DEFAULT))


def spec_buckets(specs: DataFrame, column: str) -> DataFrame:
    """One row per spec and bucket it falls in."""
    hits = F.array_compact(F.array(*[F.when(F.col(column).rlike(p), F.lit(b)) for b, p in T.SPEC_BUCKETS.items()]))
    return specs.select(F.col(column).alias("spec"), F.explode(hits).alias("bucket"))


def rule_table(makers: DataFrame) -> DataFrame:
    """(rule_type, rule_key, category, confidence): fixed keyword and spec rules with the mined maker rules."""
    spark = makers.sparkSession
    fixed = [("keyword", k, c, T.RULE_CONFIDENCE["keyword"]) for c, ks in T.KEYWORD_RULES.items() for k in ks]
    fixed += [("specification", k, c, T.RULE_CONFIDENCE["specification"]) for c, ks in T.SPEC_RULES.items() for k in ks]
    table = spark.createDataFrame(fixed, "rule_type string, rule_key string, category string, confidence double")
    mined = makers.select(F.lit("manufacturer").alias("rule_type"), F.col("manufacturer").alias("rule_key"), "category",
                          F.lit(T.RULE_CONFIDENCE["manufacturer"]).alias("confidence"))
    return table.unionByName(mined)


def regroup_rules(rules: DataFrame, kind: str | None = None) -> DataFrame:
    """Rules of a type by category, each an ordered list of (key, confidence)."""
    df = rules.filter(F.col("rule_type") == kind) if kind else rules
    return df.groupBy("rule_type", "category").agg(F.array_sort(F.collect_list(F.struct("rule_key", "confidence"))).alias("rules"))


def domain_keywords(names: DataFrame, text: str, top: int = 100, kept: int = 20) -> DataFrame:
    """The most frequent tokens that hold a domain word, listed for the device category and its sub-lists."""
    best = token_frequency(names, text, 1).orderBy(F.desc("n"), "token").limit(top).filter(contains_any(F.col("token"), T.DOMAIN_WORDS))
    rank = F.expr("row_number() OVER (ORDER BY n DESC, token)")  # at most ``top`` rows
    ranked = best.withColumn("rank", rank)
    lists = F.array(F.when(F.col("rank") <= kept, F.lit("医疗器械")), *[
        F.when(contains_any(F.col("token"), ws), F.lit(c)) for c, ws in T.DOMAIN_LISTS.items()])
    return ranked.select("token", "n", F.explode(F.array_compact(lists)).alias("category"))


def import_training(sources: list[DataFrame]) -> DataFrame:
    """Sources with their headers mapped, united; rows without a name are left out."""
    mapped = [rename(df, {v: k for k, v in training_mapping(df.columns).items()}) for df in sources]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), mapped)
    return both.filter(F.trim(F.coalesce("material_name", F.lit(""))) != "")


# Quality weights


def labelled_history(log: DataFrame, asof: Column, days: int = 30) -> DataFrame:
    return log.filter((F.col("created_at") >= asof - F.make_dt_interval(F.lit(days))) & F.col("user_feedback").isNotNull())


def quality_features(df: DataFrame) -> DataFrame:
    """The five feature scores and the 0/1 label; the random terms of the original scores are left out."""
    long = lambda c, n: F.length(F.trim(F.coalesce(c, F.lit("")))) > n
    name, cat = F.lower("material_name"), F.lower("predicted_category")
    completeness = (F.when(long("material_name", 2), 0.4).otherwise(0.0) + F.when(long("specification", 2), 0.3).otherwise(0.0)
                    + F.when(long("manufacturer", 2), 0.2).otherwise(0.0) + F.when(long("predicted_category", 1), 0.1).otherwise(0.0))
    match = F.contains(name, cat) | F.contains(cat, name)
    return df.withColumns({
        "confidence": F.col("confidence_score"),
        "consistency": F.least(F.lit(1.0), F.lit(0.8) + F.when(contains_any(name, T.CATEGORY_WORDS), 0.1).otherwise(0.0)),
        "completeness": F.least(F.lit(1.0), completeness),
        "accuracy": F.least(F.lit(1.0), F.col("confidence_score") * 0.6 + F.when(match, 0.3).otherwise(0.0) + 0.1),
        "compliance": F.least(F.lit(1.0), F.lit(0.7) + F.when(contains_any(F.col("specification"), T.SPEC_MARKS), 0.2).otherwise(0.0)),
        "label": F.when(F.col("user_feedback") == "correct", 1).otherwise(0)})


def weight_candidates(n: int = 50, seed: int = 42) -> list[dict[str, float]]:
    """Seeded normalised weight vectors from the search ranges."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        raw = {k: rng.uniform(lo, hi) for k, (lo, hi) in T.SEARCH.items()}
        out.append({k: round(v / sum(raw.values()), 6) for k, v in raw.items()})
    return out


def search_weights(features: DataFrame, candidates: list[dict[str, float]]) -> DataFrame:
    """(candidate, accuracy, weights) of all candidates, best first, in one pass over the rows."""
    def accuracy(w: dict[str, float]) -> Column:
        score = sum((F.col(k) * v for k, v in w.items()), F.lit(0.0))
        # Rounded, so that a score exactly at the limit falls the same way however it was summed.
        return F.avg(F.when((F.round(score, 9) >= T.PREDICT_AT).cast("int") == F.col("label"), 1.0).otherwise(0.0))

    flat = features.agg(*[accuracy(w).alias(f"c{i}") for i, w in enumerate(candidates)])
    rows = F.array(*[
        F.struct(F.lit(i).alias("candidate"), F.col(f"c{i}").alias("accuracy"),
                 F.create_map(*[F.lit(x) for kv in w.items() for x in kv]).alias("weights")) for i, w in enumerate(candidates)])
    return flat.select(F.explode(rows).alias("r")).select("r.*").orderBy(F.desc("accuracy"), "candidate")


def cross_validate(features: DataFrame, weights: dict[str, float], ident: str, folds: int = 5) -> list[float]:
    """Held-out accuracy per fold of a logistic regression on the weighted features; folds by hashed id.

    Held-out rows are scored by the coefficients as a column expression: the model's own transform
    sends the model, its training summary and with that the session, which cannot be sent once the session has tags.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    scaled = features.select("label", F.pmod(F.xxhash64(ident), F.lit(folds)).alias("fold"), *[(F.col(k) * w).alias(k) for k, w in weights.items()])
    data = VectorAssembler(inputCols=list(weights), outputCol="features").transform(scaled)
    out = []
    for fold in range(folds):
        train, held = data.filter(F.col("fold") != fold), scaled.filter(F.col("fold") == fold)
        model = LogisticRegression(maxIter=50, regParam=0.001).fit(train)
        margin = sum((F.col(k) * float(c) for k, c in zip(weights, model.coefficients)), F.lit(float(model.intercept)))
        row = held.agg(F.avg(((margin > 0).cast("int") == F.col("label")).cast("double")).alias("a")).first()
        out.append(row["a"])
    return out


def adopt(ranked: DataFrame, current: int = 0) -> DataFrame:
    """One row (improvement, adopted, weights) of a weight search: its best weights where they gain more than the limit, else the current candidate's."""
    best = F.max_by("weights", F.struct("accuracy", -F.col("candidate")))
    mine = F.col("candidate") == current
    gain = ranked.agg(F.max("accuracy").alias("best"), F.max(F.when(mine, F.col("accuracy"))).alias("base"), best.alias("_best"), F.any_value(
        F.when(mine, F.col("weights")), ignoreNulls=True).alias("_current")).withColumn("improvement", F.col("best") - F.col("base"))
    adopted = F.col("improvement") > T.ADOPT_GAIN
    return gain.select("improvement", adopted.alias("adopted"), F.when(adopted, F.col("_best")).otherwise(F.col("_current")).alias("weights"))


# Similarity weights from feedback


def feedback_weights(log: DataFrame, order: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """Weights after the whole feedback log, in order: (field, weight).

    A step adds the same vector up or down and divides by the new sum, so it is w -> a*w + b*c.
    Steps compose: each sorted partition folds its rows to one (a, b), and only those few
    pairs, one per partition, are folded again.
    """
    weights = weights or DR.WEIGHTS
    step = {k: T.FEEDBACK_STEP * (2 if k == "name" else 1) for k in weights}
    total = sum(step.values())
    up = (F.col("decision") == "merge") & (F.col("confidence_before") < T.MERGE_BELOW)
    down = (F.col("decision") == "separate") & (F.col("confidence_before") > T.SEPARATE_ABOVE)
    moves = log.withColumn("move", F.when(up, 1).when(down, -1)).filter("move IS NOT NULL").sort(*order).select(
        F.spark_partition_id().alias("part"), "move")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, a, b = None, 1.0, 0.0
        for frame in frames:
            if len(frame):
                part, move = int(frame["part"].iloc[0]), frame["move"].to_numpy(dtype=float)
                # What is left of a step after all later ones: products of the scales from its own on.
                left = np.cumprod(1.0 / (1.0 + move[::-1] * total))[::-1]
                a, b = a * left[0], b * left[0] + float(move @ left)
        if part is not None:
            yield pd.DataFrame({"part": [part], "a": [a], "b": [b]})

    parts = moves.mapInPandas(fold, "part int, a double, b double")
    none = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    whole = parts.agg(F.aggregate(
        F.array_sort(F.collect_list(F.struct("part", "a", "b"))), none,
        lambda s, x: F.struct((s["a"] * x["a"]).alias("a"), (s["b"] * x["a"] + x["b"]).alias("b"))).alias("f"))
    rows = F.array(*[F.struct(F.lit(k).alias("field"), (F.col("f.a") * w + F.col("f.b") * step[k]).alias("weight")) for k, w in weights.items()])
    return whole.select(F.explode(rows).alias("r")).select("r.*")
