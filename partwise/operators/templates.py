"""Industry templates: a rules table, and the vote of its rules over item rows.

A rule is a dict; a template has a few dozen, so applying it is one row-local expression.
Items have item_id and text columns named like the rules' fields.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partwise.operators.profiling import field_combinations
from partwise.rules import templates as R
from partwise.session import stored

RESULT = "rule_id string, rule_type string, score double, weight double, boost double, level1 string, level2 string"


def template_rules(industry: str, combinations: list[tuple[list[str], float]] = ()) -> list[dict]:
    """Keyword, pattern, similarity and composite rules of an industry, highest priority first."""
    rules = [dict(R.KEYWORD_RULE, rule_type="keyword", rule_id=f"k{i}", level1=a, level2=b, keywords=ks)
             for i, (a, b, ks) in enumerate(R.TAXONOMY.get(industry, R.TAXONOMY["generic"]))]
    if industry in R.PATTERN_RULES:
        patterns, fields, params = R.PATTERN_RULES[industry]
        rules.append(dict(R.PATTERN_RULE, rule_type="pattern", rule_id="p0", patterns=patterns, fields=fields, parameters=params))
    rules += [dict(r, rule_type="similarity", rule_id=f"s{i}") for i, r in enumerate(R.SIMILARITY_RULES)]
    rules += [dict(R.COMPOSITE_RULE, rule_type="composite", rule_id="c:" + ",".join(fs), fields=fs, support=s, boost=0.0) for fs, s in combinations]
    rules = [dict(r, enabled=r.get("enabled", True)) for r in rules]
    return sorted(rules, key=lambda r: -r["priority"])


def rules_table(spark, rules: list[dict]) -> DataFrame:
    rows = [(r["rule_id"], r["rule_type"], r["priority"], float(r["weight"]), float(r.get("boost", 0)), r.get("level1"), r.get("level2"),
             r.get("keywords") or r.get("patterns") or r.get("fields"), r["enabled"]) for r in rules]
    return spark.createDataFrame(rows, "rule_id string, rule_type string, priority int, weight double, boost double, level1 string, level2 string, terms array<string>, enabled boolean")


RULE = ("rule_id string, rule_type string, priority int, weight double, boost double, threshold double, level1 string, level2 string, "
        "method string, terms array<string>, fields array<string>")
#: Combinations of filled fields become rules from this support on.
MIN_SUPPORT = 0.3


def industry_rules(spark) -> DataFrame:
    """The rules of every industry as rows: industry and the columns of ``RULE``."""
    rows = []
    for industry in R.TAXONOMY:
        for r in template_rules(industry):
            if r["enabled"]:
                rows.append((industry, r["rule_id"], r["rule_type"], r["priority"], float(r["weight"]), float(r.get("boost", 0)), float(r.get("threshold", 0)),
                             r.get("level1"), r.get("level2"), r.get("method"), r.get("keywords") or r.get("patterns") or [], r.get("fields") or []))
    return spark.createDataFrame(rows, "industry string, " + RULE)


def source_rules(items: DataFrame, industries: DataFrame, rules: DataFrame, fields: list[str]) -> DataFrame:
    """The rules of each source: those of its recognised industry, and composite rules for the fields that its own items fill together.

    ``items`` has source_id and ``fields``, ``industries`` one row (source_id, industry) per
    source, ``rules`` the columns of ``industry_rules``. One row per source and rule.
    """
    names = [c.split()[0] for c in RULE.split(", ")]
    own = industries.select("source_id", "industry").join(rules, "industry").select("source_id", *names)
    combos = field_combinations(items.select("source_id", *fields), fields, "source_id").filter(F.col("support") > MIN_SUPPORT)
    null = F.lit(None).cast("string")
    composite = combos.select("source_id", F.concat(F.lit("c:"), "fields").alias("rule_id"), F.lit("composite").alias("rule_type"), F.lit(R.COMPOSITE_RULE["priority"]).alias("priority"),
                              F.lit(float(R.COMPOSITE_RULE["weight"])).alias("weight"), F.lit(0.0).alias("boost"), F.round("support", 9).alias("threshold"), null.alias("level1"),
                              null.alias("level2"), null.alias("method"), F.array().cast("array<string>").alias("terms"), F.split("fields", ",").alias("fields"))
    return own.unionByName(composite)


def apply_source_rules(items: DataFrame, rules: DataFrame, fields: list[str], similarities: DataFrame | None = None) -> DataFrame:
    """(item_id, result columns) of each rule of the item's source that holds.

    The rules of a source travel as one array beside its items, a row per source, and one
    expression reads them; no rule is known when the plan is made. ``similarities`` (item_id,
    method, score) are what similarity joins found; a similarity rule takes an item's best of its method.
    """
    return _held(_with_found(items, similarities), rules, fields)


def vote_by_source(items: DataFrame, rules: DataFrame, fields: list[str], similarities: DataFrame | None = None) -> DataFrame:
    """``vote`` over ``apply_source_rules``: items of a source with the same texts and similarities are judged once, and all get the answer."""
    rows = stored(_with_found(items.select("item_id", "source_id", *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields]), similarities), "items")
    what = ["source_id", *fields, "found"]
    key = F.md5(F.to_json(F.struct(*what))).alias("texts")
    one = stored(rows.select(*what).distinct().select(key.alias("item_id"), *what), "texts")
    return rows.select("item_id", key).join(vote(one, _held(one, rules, fields)).withColumnRenamed("item_id", "texts"), "texts").drop("texts")


def _with_found(items: DataFrame, similarities: DataFrame | None) -> DataFrame:
    """Items with ``found``, the best score of each method in the order of the methods."""
    if similarities is None:
        return items.withColumn("found", F.lit(None).cast("array<struct<method:string,score:double>>"))
    best = similarities.groupBy("item_id", "method").agg(F.max("score").alias("score"))
    return items.join(best.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("method", "score"))).alias("found")), "item_id", "left")


def _held(items: DataFrame, rules: DataFrame, fields: list[str]) -> DataFrame:
    packed = stored(rules.groupBy("source_id").agg(F.collect_list(F.struct(*[c.split()[0] for c in RULE.split(", ")])).alias("rules")), "source_rules")
    values = F.create_map(*[x for f in fields for x in (F.lit(f), F.coalesce(F.col(f).cast("string"), F.lit("")))])
    rows = items.join(packed, "source_id").withColumn("found", F.map_from_entries("found"))

    def score(r: Column) -> Column:
        here = F.transform(r.fields, lambda f: F.coalesce(F.element_at(F.col("values"), f), F.lit("")))
        body = F.array_join(F.filter(here, lambda x: x != ""), " ")
        low = F.lower(body)
        of = lambda hit, xs: F.size(F.filter(xs, hit)) / F.size(xs)
        return (F.when(r.rule_type == "keyword", of(lambda t: F.contains(low, F.lower(t)), r.terms))
                .when(r.rule_type == "pattern", of(lambda t: F.regexp_like(body, F.concat(F.lit("(?i)"), t)), r.terms))
                .when(r.rule_type == "composite", of(lambda x: x != "", here))
                .when(r.rule_type == "similarity", F.element_at(F.col("found"), r.method)))

    results = F.transform("rules", lambda r: F.struct(r.rule_id.alias("rule_id"), r.rule_type.alias("rule_type"), score(r).cast("double").alias("score"), r.weight.alias("weight"),
                                                      r.boost.alias("boost"), r.level1.alias("level1"), r.level2.alias("level2"), r.threshold.alias("threshold")))
    held = rows.withColumn("values", values).select("item_id", F.explode(results).alias("r")).select("item_id", "r.*")
    return held.filter((F.col("score") > 0) & (F.round("score", 9) >= F.col("threshold"))).drop("threshold")


def source_summaries(items: DataFrame, voted: DataFrame, industries: DataFrame, fields: list[str]) -> DataFrame:
    """Totals of a run for each source with its recognised industry; items without any text fail."""
    blank = F.concat_ws("", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]) == ""
    rows = items.select("source_id", "item_id", blank.alias("blank")).join(voted, "item_id")
    return rows.groupBy("source_id").agg(
        F.count("*").alias("total"), F.count_if("blank").alias("failed"), F.count_if(F.col("rules_matched") == 0).alias("unmatched"), F.avg("confidence").alias("average_confidence"),
        F.count_if(F.col("confidence") < R.LOW_CONFIDENCE).alias("low_confidence_count")).join(industries.select("source_id", "industry"), "source_id")


def _text(df: DataFrame, names: list[str]) -> Column:
    return F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in names if c in df.columns])


def _result(rule: dict, score: Column) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(F.lit(rule["rule_id"]).alias("rule_id"), F.lit(rule["rule_type"]).alias("rule_type"), score.alias("score"),
                    F.lit(float(rule["weight"])).alias("weight"), F.lit(float(rule.get("boost", 0))).alias("boost"),
                    (F.lit(rule["level1"]) if "level1" in rule else null).alias("level1"), (F.lit(rule["level2"]) if "level2" in rule else null).alias("level2"))


def _share(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(x, 1.0).otherwise(0.0) for x in flags]) / len(flags)


def apply_rules(items: DataFrame, rules: list[dict]) -> DataFrame:
    """(item_id, result columns) for each enabled keyword, pattern and composite rule that holds."""
    out = []
    for r in (r for r in rules if r["enabled"]):
        if r["rule_type"] == "keyword":
            text = F.lower(_text(items, r["fields"]))
            share = _share([F.contains(text, F.lit(k.lower())) for k in r["keywords"]])
            out.append(F.when(F.round(share, 9) >= r["threshold"], _result(r, share)))
        elif r["rule_type"] == "pattern":
            share = _share([_text(items, r["fields"]).rlike("(?i)" + p) for p in r["patterns"]])
            out.append(F.when(share > 0, _result(r, share)))
        elif r["rule_type"] == "composite":
            share = _share([F.coalesce(F.col(f), F.lit("")) != "" if f in items.columns else F.lit(False) for f in r["fields"]])
            out.append(F.when(F.round(share, 9) >= r["support"], _result(r, share)))
    return items.select("item_id", F.explode(F.array_compact(F.array(*out))).alias("r")).select("item_id", "r.*")


def extract_parameters(items: DataFrame, rule: dict) -> DataFrame:
    """First match of each parameter of a pattern rule."""
    text = _text(items, rule["fields"])
    return items.select("item_id", *[F.nullif(F.regexp_extract(text, "(?i)" + p, g), F.lit("")).alias(k) for k, (p, g) in rule["parameters"].items()])


def similarity_results(scores: DataFrame, rule: dict) -> DataFrame:
    """An item's best similarity (item_id, score) as a rule result where it reaches the rule's minimum."""
    kept = scores.groupBy("item_id").agg(F.max("score").alias("score")).filter(F.col("score") >= rule["threshold"])
    return kept.select("item_id", _result(rule, F.col("score")).alias("r")).select("item_id", "r.*")


def vote(items: DataFrame, results: DataFrame) -> DataFrame:
    """Category with the highest weighted score, confidence, and up to three alternatives.

    Confidence is the weighted mean score plus the boosts, at most 1. Items no rule met are unclassified with 0.
    """
    w = F.col("score") * F.col("weight")
    total = results.groupBy("item_id").agg(
        F.count("*").alias("rules_matched"), F.least(F.lit(1.0), F.sum(w) / F.sum("weight") + F.sum("boost")).alias("confidence"))
    votes = results.filter("level1 IS NOT NULL").groupBy("item_id", "level1", "level2").agg(
        F.round(F.sum(w), 9).alias("score"), F.count("*").alias("votes"), F.min("rule_id").alias("first"))
    rank = F.expr("row_number() OVER (PARTITION BY item_id ORDER BY score DESC, first)")
    top = votes.withColumn("rank", rank).filter("rank <= 4").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rank", "level1", "level2", "score", "votes"))).alias("v"))
    best = F.get("v", F.lit(0))
    out = items.select("item_id").join(total, "item_id", "left").join(top, "item_id", "left")
    matched = F.coalesce("rules_matched", F.lit(0))
    return out.select(
        "item_id", F.coalesce(best["level1"], F.lit(R.UNCLASSIFIED)).alias("level1"),
        F.coalesce(best["level2"], F.when(matched == 0, R.NO_RULE).otherwise(R.NO_CATEGORY)).alias("level2"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), matched.alias("rules_matched"), F.slice(F.coalesce("v", F.array().cast(dict(top.dtypes)["v"])), 2, 3).alias("alternatives"))


def batch_summary(voted: DataFrame, industry: DataFrame) -> DataFrame:
    """Totals of a run, with the industry its source was recognised as."""
    t = voted.agg(F.count("*").alias("total"), F.count_if(F.col("rules_matched") == 0).alias("unmatched"), F.avg("confidence").alias("average_confidence"),
                  F.count_if(F.col("confidence") < R.LOW_CONFIDENCE).alias("low_confidence_count"))
    return t.crossJoin(industry.select("industry"))  # two one-row results


def quality_weights(overall: Column) -> Column:
    """map of matching weights, raised for good and for poor sources."""
    parts = []
    for k, w in R.QUALITY_WEIGHTS.items():
        up = F.when(overall > R.GOOD_SOURCE, R.GOOD_GAINS.get(k, 0.0)).when(overall < R.POOR_SOURCE, R.POOR_GAINS.get(k, 0.0)).otherwise(0.0)
        parts += [F.lit(k), F.lit(w) + up]
    return F.create_map(*parts)


def confidence_threshold(industry: Column, confidence: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in R.THRESHOLDS.items() for x in kv])
    base = F.coalesce(table[industry], F.lit(R.THRESHOLDS["generic"]))
    return base + F.when(confidence > R.SURE_SOURCE, -R.SURE_LOSS).when(confidence < R.UNSURE_SOURCE, R.UNSURE_GAIN).otherwise(0.0)


def generate_template(schema: DataFrame) -> DataFrame:
    """Template header per recognised source: id, weights and threshold; its rules come from ``template_rules``."""
    return schema.select(
        F.concat_ws("_", "industry_type", "source_id").alias("template_id"), "industry_type", F.concat("industry_type", F.lit("分类模板")).alias("template_name"),
        "field_mappings", quality_weights(F.col("quality_metrics.overall_quality")).alias("quality_weights"),
        confidence_threshold(F.col("industry_type"), F.col("confidence_score")).alias("confidence_threshold"))


def retune(rules: DataFrame, performance: DataFrame) -> DataFrame:
    """Rule weights after a run: (template_id, accuracy, errors) moves keyword and similarity weights when accuracy is low."""
    low = F.col("accuracy") < R.LOW_ACCURACY
    factor = F.when(low & (F.col("rule_type") == "keyword"), R.KEYWORD_FACTOR).when(low & (F.col("rule_type") == "similarity"), R.SIMILARITY_FACTOR).otherwise(1.0)
    return rules.join(performance, "template_id").withColumn("weight", F.col("weight") * factor)


def retune_threshold(templates: DataFrame, performance: DataFrame) -> DataFrame:
    move = F.when(F.col("errors") > R.MANY_ERRORS, R.ERROR_GAIN).when(F.col("accuracy") > R.HIGH_ACCURACY, -R.ACCURACY_LOSS).otherwise(0.0)
    return templates.join(performance, "template_id").withColumn("confidence_threshold", F.col("confidence_threshold") + move)


def by_industry(templates: DataFrame, industry: str) -> DataFrame:
    return templates.filter(F.col("industry_type") == industry).orderBy(F.col("last_updated").desc(), "template_id")
