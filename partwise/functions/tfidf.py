"""TF-IDF in long form: one row per (profile, field, term) with an L2-normalised weight.

Weight is tf * (ln((1 + n) / (1 + df)) + 1). Rows with the same texts are one profile, so
copies are weighed once however many there are; document frequencies still count rows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partwise.functions.termcodes import frequent_runs, row_scores, row_weights  # noqa: F401
from partwise.functions.text import SEGMENTS, WORD, WORD2, ngrams, tokens


@dataclass(frozen=True)
class Vectoriser:
    """Token pattern, longest n-gram, how many of the most frequent terms are kept (None: all), and the pattern's group that is the token."""

    pattern: str = WORD
    longest: int = 1
    max_features: int | None = None
    group: int = 0


# The vectorisers of the matchers, and the numbers of most frequent terms they may be cut to.
BASELINE = Vectoriser(WORD2, 1)
FIELD_MATCH = Vectoriser(WORD, 2)
DEDUP_NAME = Vectoriser(WORD, 3)
DEDUP_SPEC = Vectoriser(WORD, 2)
SIMILAR = Vectoriser(WORD2, 2)
SEGMENTED = Vectoriser(SEGMENTS, 2, group=1)
CAPPED = {
    "field_match": replace(FIELD_MATCH, max_features=1000),
    "dedup_name": replace(DEDUP_NAME, max_features=1000),
    "dedup_spec": replace(DEDUP_SPEC, max_features=800),
    "similar": replace(SIMILAR, max_features=1000),
}


def profiles(df: DataFrame, texts: dict[str, Column], exact: list[str] | None = None) -> DataFrame:
    """Distinct rows of the text and exact fields: (pk, exact..., texts..., n)."""
    exact = exact or []
    keyed = df.select(*exact, *[F.coalesce(c, F.lit("")).alias(f) for f, c in texts.items()])
    key = profile_key([F.col(c) for c in [*exact, *texts]])
    keep = [F.any_value(c).alias(c) for c in [*exact, *texts]]
    return keyed.groupBy(key.alias("pk")).agg(*keep, F.count("*").alias("n"))


def profile_key(fields: list[Column]) -> Column:
    """128-bit key of a profile; the lengths keep field borders apart."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in fields]
    return F.md5(F.concat_ws("\x1f", *[x for p in parts for x in (F.length(p).cast("string"), p)]))


def term_counts(prof: DataFrame, vectorisers: dict[str, Vectoriser]) -> DataFrame:
    """(pk, n, field, term, tf). Grouping by pk first makes this free of a further shuffle."""
    per_field = F.array(*[
        F.struct(F.lit(f).alias("field"), F.lit(v.longest).alias("longest"), tokens(F.col(f), v.pattern, v.group).alias("words"))
        for f, v in vectorisers.items()])
    words = prof.select("pk", "n", F.explode(per_field).alias("x")).select("pk", "n", "x.*")
    runs = ngrams(F.col("words"), max(v.longest for v in vectorisers.values()))
    none = F.array().cast("array<string>")
    terms = F.concat(*[F.when(F.col("longest") >= k, r).otherwise(none) if k > 1 else r for k, r in enumerate(runs, 1)])
    exploded = words.select("pk", "n", "field", F.explode(terms).alias("term"))
    return exploded.groupBy("pk", "field", "term").agg(F.count("*").alias("tf"), F.any_value("n").alias("n"))


def vocabulary(counts: DataFrame, rows: DataFrame, vectorisers: dict[str, Vectoriser]) -> DataFrame:
    """(field, term, df, idf) of the master's term counts; ``rows`` is the master, for its size."""
    stats = counts.groupBy("field", "term").agg(F.sum("n").alias("df"), F.sum(F.col("tf") * F.col("n")).alias("cf"))
    limits = {f: v.max_features for f, v in vectorisers.items() if v.max_features}
    if limits:
        limit = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
        frequent = F.expr("row_number() OVER (PARTITION BY field ORDER BY cf DESC, term)")
        cap = max(limits.values())
        ranked = stats.withColumn("by_cf", frequent).filter(F.col("by_cf") <= cap)
        stats = ranked.filter(F.col("by_cf") <= F.coalesce(limit[F.col("field")], F.lit(cap)))
    total = rows.agg(F.count("*").alias("rows"))
    idf = F.log((1 + F.col("rows")) / (1 + F.col("df"))) + 1
    return stats.crossJoin(F.broadcast(total)).select("field", "term", "df", idf.alias("idf"))


def frequent_terms(texts: DataFrame, text: str, vectorisers: dict[str, Vectoriser]) -> DataFrame:
    """(field, term, df, idf) of the most frequent terms of each vectoriser with ``max_features``, over the same text column.

    What ``vocabulary`` gives for them, without counting every run of words (see ``termcodes.frequent_runs``);
    vectorisers of one pattern share the counts. The terms themselves reach the driver: ``max_features`` each.
    """
    if not all(v.max_features for v in vectorisers.values()):
        raise ValueError("only vectorisers with max_features")
    total, found = texts.count(), []
    for pattern, group in dict.fromkeys((v.pattern, v.group) for v in vectorisers.values()):
        limits = {f: (v.longest, v.max_features) for f, v in vectorisers.items() if (v.pattern, v.group) == (pattern, group)}
        for f, terms in frequent_runs(texts, F.col(text), pattern, group, limits).items():
            found += [(f, term, df) for term, df in terms]
    kept = texts.sparkSession.createDataFrame(found, "field string, term string, df long")
    return kept.withColumn("idf", F.log((1 + F.lit(total)) / (1 + F.col("df"))) + 1)


def capped_weights(rows: DataFrame, ident: str, text: str, v: Vectoriser) -> DataFrame:
    """(ident, term, w) of each row of a text column over its ``max_features`` most frequent terms, which the driver holds."""
    terms = [(r.term, r.idf) for r in frequent_terms(rows, text, {text: v}).collect()]
    return row_weights(rows, ident, F.col(text), v.pattern, v.group, terms)


def row_vocabulary(texts: DataFrame, text: str, field: str, v: Vectoriser) -> DataFrame:
    """(field, term, df, idf) of all single words of a text column; a row's repeats go before anything is grouped."""
    if v.longest != 1 or v.max_features:
        raise ValueError("single words without a limit only")
    words = texts.select(F.explode(F.array_distinct(tokens(F.col(text), v.pattern, v.group))).alias("term"))
    total = texts.agg(F.count("*").alias("rows"))
    idf = F.log((1 + F.col("rows")) / (1 + F.col("df"))) + 1
    return words.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total)).select(F.lit(field).alias("field"), "term", "df", idf.alias("idf"))


def vectors(counts: DataFrame, vocab: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(pk, field, term, idf, w): weights of the terms the vocabulary knows, normalised over all of them.

    With ``wanted`` (field, term) only those terms are returned. Norms are sums per profile, combined before the shuffle.
    """
    raw = counts.join(vocab, ["field", "term"]).withColumn("raw", F.col("tf") * F.col("idf"))
    norms = raw.groupBy("pk", "field").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    kept = raw if wanted is None else counts.join(wanted, ["field", "term"], "left_semi").join(vocab, ["field", "term"]).withColumn(
        "raw", F.col("tf") * F.col("idf"))
    return kept.join(norms, ["pk", "field"]).select("pk", "field", "term", "idf", (F.col("raw") / F.col("norm")).alias("w"))


def packed(vecs: DataFrame, fields: list[str]) -> DataFrame:
    """One row per profile with a map<term, w> per field."""
    entries = [F.map_from_entries(F.collect_list(F.when(F.col("field") == f, F.struct("term", "w")))).alias(f"v_{f}") for f in fields]
    return vecs.groupBy("pk").agg(*entries)


def postings(vecs: DataFrame) -> DataFrame:
    """Adds ``tail``: the norm of a vector from this term on, terms running from rare to frequent."""
    tail = F.expr("""sqrt(sum(w * w) OVER (PARTITION BY pk, field ORDER BY idf DESC, term
                     ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""")
    place = F.expr("row_number() OVER (PARTITION BY pk, field ORDER BY idf DESC, term)")
    return vecs.withColumns({"tail": tail, "place": place})


def dot(a: Column, b: Column) -> Column:
    """Product of two sparse vectors, iterating over the first."""
    none = F.create_map().cast("map<string,double>")
    left, right = F.coalesce(a, none), F.coalesce(b, none)
    return F.aggregate(F.map_entries(left), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(right[e["key"]], F.lit(0.0)))
