"""Similarity joins of token sets and of strings, by prefix filter.

Tokens are ordered from rare to frequent. Two sets that share at least o tokens share one among
the first |a| - o + 1 of the one and |b| - o + 1 of the other, so only these are joined, and a
pair is emitted at its first shared token alone. Long posting lists are cut into blocks on both
sides, so a task joins two blocks of bounded size whatever the token.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from partwise.session import stored

#: Postings of one token on one side that one task joins.
LIST_ROWS = 20_000
EPS = 1e-9


def block_pairs(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, rows: int = LIST_ROWS) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``left_block`` and ``right_block``, so that rows of a key meet once: each has its own block by its hash and visits all of the other side's.

    Keys that only one side has are dropped.
    """
    parts = lambda side, name: side.groupBy(*keys).agg(F.ceil(F.count("*") / rows).alias(name))
    sizes = stored(parts(left, "_lefts").join(parts(right, "_rights"), keys), "block_sizes")
    blocks = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda ident, n: F.pmod(F.xxhash64(ident), F.col(n))
    lefts = left.join(sizes, keys).withColumn("left_block", own(left_id, "_lefts")).withColumn("right_block", blocks("_rights"))
    rights = right.join(sizes, keys).withColumn("right_block", own(right_id, "_rights")).withColumn("left_block", blocks("_lefts"))
    return lefts.drop("_lefts", "_rights"), rights.drop("_lefts", "_rights")


def _ordered(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, tokens) with the tokens of each set from rare to frequent, as struct(n, token)."""
    posts = left.select(F.explode("tokens").alias("token")).unionByName(right.select(F.explode("tokens").alias("token")))
    counts = stored(posts.groupBy("token").agg(F.count("*").alias("n")), "token_counts")

    def one(side: DataFrame) -> DataFrame:
        by_token = side.select("id", F.explode("tokens").alias("token")).join(counts, "token")
        return stored(by_token.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("tokens")), "token_sets")

    return one(left), one(right)


def _meet(left: DataFrame, right: DataFrame, needed: Column) -> DataFrame:
    """(left_id, right_id, a, b): pairs of (id, tokens) that share a token among the first |tokens| - ``needed`` + 1, each pair once."""
    def heads(side: DataFrame, name: str) -> DataFrame:
        head = F.slice("tokens", F.lit(1), F.greatest(F.size("tokens") - needed.cast("int") + 1, F.lit(0)))
        out = side.withColumn("head", head).select(F.col("id").alias(f"{name}_id"), F.col("tokens").alias(name), F.col("head").alias(f"{name}_head"), F.explode("head").alias("x"))
        return out.withColumn("token", F.col("x.token")).drop("x")

    a, b = block_pairs(heads(left, "a"), heads(right, "b"), ["token"], "a_id", "b_id")
    first = F.get(F.array_intersect("a_head", "b_head"), F.lit(0))
    met = a.join(b, ["token", "left_block", "right_block"]).filter(first["token"] == F.col("token"))
    return met.select(F.col("a_id").alias("left_id"), F.col("b_id").alias("right_id"), "a", "b")


def similar_sets(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(left_id, right_id, similarity): pairs of (id, tokens array) whose Jaccard similarity reaches ``threshold`` (above 0). Ids are unique on each side; empty and null sets match nothing."""
    sets = lambda side: side.select("id", F.array_distinct(F.array_compact("tokens")).alias("tokens"))
    left, right = _ordered(sets(left), sets(right))
    met = _meet(left, right, F.ceil(F.size("tokens") * threshold - EPS))
    shared = F.size(F.array_intersect("a", "b"))
    jaccard = shared / (F.size("a") + F.size("b") - shared)
    # The smaller set has at least the threshold's share of the larger one.
    close = F.least(F.size("a"), F.size("b")) >= F.greatest(F.size("a"), F.size("b")) * threshold - EPS
    return met.filter(close).select("left_id", "right_id", jaccard.alias("similarity")).filter(F.col("similarity") >= threshold - EPS)


@F.pandas_udf(DoubleType())
def blocks_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two strings."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype=float)


def _grams(text: Column, q: int) -> Column:
    """Overlapping pieces of q characters, each with its number of occurrence, so that a set counts repeats."""
    pieces = F.transform(F.sequence(F.lit(1), F.length(text) - q + 1), lambda i: F.substring(text, i, F.lit(q)))
    numbered = F.transform(pieces, lambda p, i: F.concat(p, F.lit("#"), F.size(F.filter(F.slice(pieces, F.lit(1), i + 1), lambda x: x == p)).cast("string")))
    return F.when(F.length(text) >= q, numbered).otherwise(F.array().cast("array<string>"))


def similar_strings(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(left_id, right_id, similarity): pairs of (id, text) whose matching-blocks ratio 2M / S reaches ``threshold`` (above 2/3).

    S is the sum of the lengths and M the matched characters, M >= t S / 2. These lie in at most
    S - 2M + 1 blocks, so at least 3M - S - 1 pieces of two characters are shared with repeats.
    Where that says nothing (very short strings), M single characters are shared. Ids are unique
    on each side; empty and null texts match nothing.
    """
    if threshold <= 2 / 3:
        raise ValueError("pieces of two characters say nothing at two thirds or below")
    texts = lambda side: side.select("id", "text").filter(F.length("text") > 0)
    left, right = texts(left), texts(right)
    least = lambda total: F.ceil(total * threshold / 2 - EPS)
    # Without rounding M, so that more characters never ask for fewer pieces.
    pairs_shared = lambda total: F.ceil(total * (1.5 * threshold - 1) - 1 - EPS)
    span = threshold / (2 - threshold)
    n = F.length("text")
    shortest, longest = n + F.ceil(n * span - EPS), n + F.floor(n / span + EPS)
    sides = {}
    for q, fits in ((2, pairs_shared(longest) >= 1), (1, pairs_shared(shortest) < 1)):
        # Of all partners the shortest needs the fewest shared pieces.
        of = lambda side: stored(side.filter(fits).select(F.struct("id", "text").alias("id"), _grams(F.col("text"), q).alias("tokens")), "grams")  # noqa: B023, E731
        sides[q] = _ordered(of(left), of(right))
    found = None
    for q, (a, b) in sides.items():
        size = F.length(F.col("id.text"))
        total = size + F.ceil(size * span - EPS)
        needed = F.greatest(F.when(F.lit(q == 2), pairs_shared(total)).otherwise(least(total)), F.lit(1))
        total = F.length("left_id.text") + F.length("right_id.text")
        mine = (pairs_shared(total) >= 1) if q == 2 else (pairs_shared(total) < 1)
        enough = pairs_shared(total) if q == 2 else least(total)
        near = F.least(F.length("left_id.text"), F.length("right_id.text")) * 2 >= total * threshold - EPS
        part = _meet(a, b, needed).filter(mine & near & (F.size(F.array_intersect("a", "b")) >= enough)).select("left_id", "right_id")
        found = part if found is None else found.unionByName(part)
    scored = found.withColumn("similarity", F.when(F.col("left_id.text") == F.col("right_id.text"), 1.0).otherwise(blocks_ratio(F.col("left_id.text"), F.col("right_id.text"))))
    return scored.filter(F.col("similarity") >= threshold - EPS).select(F.col("left_id.id").alias("left_id"), F.col("right_id.id").alias("right_id"), "similarity")
