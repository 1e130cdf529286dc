"""Parameter families, domain tags, specification features and value normalisers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from partwise.functions.text import all_matches, contains_any, strip
from partwise.rules import extraction as X


def parameter_families(text: Column, families: dict | None = None) -> dict[str, Column]:
    """Family -> array of values. ``families`` may add user patterns to the default ones or replace them."""
    return {name: all_matches(text, patterns) for name, patterns in (families or X.FAMILIES).items()}


def parameters(text: Column, families: dict | None = None) -> Column:
    """map<family, values> without empty families."""
    parts = parameter_families(text, families)
    built = F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v)])
    return F.map_filter(built, lambda _, v: F.size(v) > 0)


def domain_tags(text: Column, groups: dict[str, list[str]]) -> Column:
    return F.array_compact(F.array(*[F.when(contains_any(text, words), F.lit(tag)) for tag, words in groups.items()]))


def standardise(values: Column, field: str) -> Column:
    if field == "specification":
        fix = lambda v: F.regexp_replace(F.regexp_replace(v, r"([0-9]+(?:\.[0-9]+)?)\s*(mg|ml|g|l)", "$1$2"), "[*×]", "×")
    elif field == "brand":
        fix = lambda v: F.regexp_replace(v, "(集团|公司|厂|制药|医药|有限)$", "")
    elif field == "model":
        fix = F.upper
    else:
        fix = lambda v: v
    return F.transform(values, lambda v: strip(fix(v)))


def spec_features(*texts: Column) -> dict[str, Column]:
    """dn, pn, material, length and temp values of the joined lower-cased texts, distinct and sorted."""
    joined = F.lower(F.concat_ws(" ", *texts))
    return {k: F.array_sort(all_matches(joined, [(p, 1) for p in ps], "")) for k, ps in X.SPEC_FEATURES.items()}


def spec_tags(text: Column) -> Column:
    """array<struct<tag,label>> of every tag pattern that hits."""
    hits = [F.when(text.rlike("(?i)" + p), F.struct(F.lit(t).alias("tag"), F.lit(label).alias("label"))) for p, t, label in X.SPEC_TAGS]
    return F.array_compact(F.array(*hits))
