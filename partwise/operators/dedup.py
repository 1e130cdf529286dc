"""Duplicate detection: pair similarity, components, group scores and what to do with each group.

Rows alike in every compared field are one profile with a count, so a group of copies costs
one node however large it is. Pairs are generated per shared rare term under a proven bound.
Group means come from sums over the group, never from listing its pairs.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from partwise.functions import tfidf as V
from partwise.functions.text import maker_fingerprint
from partwise.operators.setjoin import block_pairs
from partwise.rules import dedup as R
from partwise.session import cut_lineage, stored

EPS = 1e-9


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    pairs = pd.DataFrame({"a": a, "b": b})
    distinct = pairs.drop_duplicates()
    ratio = [SequenceMatcher(None, x, y).ratio() for x, y in zip(distinct["a"], distinct["b"])]
    return pairs.merge(distinct.assign(r=ratio), on=["a", "b"], how="left")["r"]


def maker_similarity(a: Column, b: Column) -> Column:
    """Of two maker fingerprints: 0 when either is blank, 1 when equal, else the matching-blocks ratio."""
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(_ratio(a, b))


def equal_filled(a: Column, b: Column) -> Column:
    return F.when((a != "") & (a == b), 1.0).otherwise(0.0)


def canonical_unit(unit: Column) -> Column:
    table = F.create_map(*[F.lit(x) for std, names in R.UNITS.items() for n in names for x in (n, std)])
    low = F.lower(F.trim(F.coalesce(unit, F.lit(""))))
    return F.coalesce(table[low], low)


def attribute_similarity(a: Column, b: Column) -> Column:
    """Share of equal values among the common keys, case ignored."""
    common = F.array_intersect(F.map_keys(a), F.map_keys(b))
    same = F.filter(common, lambda k: F.lower(a[k]) == F.lower(b[k]))
    return F.when(F.size(common) > 0, F.size(same) / F.size(common)).otherwise(0.0)


VECTORISERS = {"name": V.DEDUP_NAME, "spec": V.DEDUP_SPEC}


class Duplicates:
    """Prepared input. ``df`` has code, name, spec, manufacturer, type, unit, source and a string map ``attributes``;
    ``code`` is a unique number whose order is the input order."""

    def __init__(self, df: DataFrame):
        blank = lambda c: F.coalesce(F.col(c), F.lit(""))
        attrs = F.array_sort(F.map_entries(F.coalesce("attributes", F.create_map().cast("map<string,string>"))))
        rows = df.select(
            "code", "source", blank("name").alias("name"), blank("spec").alias("spec"),
            maker_fingerprint(F.col("manufacturer")).alias("maker"), F.lower(blank("type")).alias("type"),
            canonical_unit(F.col("unit")).alias("unit"), F.to_json(F.map_from_entries(attrs)).alias("attrs"))
        fields = ["name", "spec", "maker", "type", "unit", "attrs"]
        pk = V.profile_key([F.col(c) for c in fields]).alias("pk")
        self.rows = rows.select(pk, "code", "source")
        # Grouped by the fields themselves, which are hashed; first values of text per key would sort all rows.
        prof = rows.groupBy(*fields).agg(F.count("*").alias("n"), F.min("code").alias("node")).select(pk, *fields, "n", "node")
        self.profiles = cut_lineage(prof.withColumn("attrs", F.from_json("attrs", "map<string,string>")))
        counts = stored(V.term_counts(self.profiles, VECTORISERS), "terms")
        vocab = V.vocabulary(counts, df, VECTORISERS)
        self.vectors = stored(V.vectors(counts, vocab), "vectors")

    def pairs(self, threshold: float = R.EDGE) -> DataFrame:
        """Profile pairs at or above the threshold with each part of the score: (a, b, n_a, n_b, ..., similarity).

        Name and spec form one scaled vector. A pair's product is at most the product of the two
        tails from its first shared term, and the remaining fields can add only what they agree on.
        """
        side = ["pk", "node", "n", "maker", "type", "unit", "attrs"]
        scale = F.create_map(*[F.lit(x) for f in VECTORISERS for x in (f, R.WEIGHTS[f] ** 0.5)])
        scaled = self.vectors.withColumn("w", F.col("w") * scale[F.col("field")])
        tail = F.expr("""sqrt(sum(w * w) OVER (PARTITION BY pk ORDER BY idf DESC, field, term
                         ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""")
        # Other fields add at most their weights, and no tail exceeds the whole vector: frequent terms fall here.
        rest = sum(w for k, w in R.WEIGHTS.items() if k not in VECTORISERS)
        whole = sum(R.WEIGHTS[f] for f in VECTORISERS) ** 0.5
        useful = scaled.withColumn("tail", tail).filter(F.col("tail") >= (threshold - rest - EPS) / whole)
        posts = useful.join(self.profiles.select(*side), "pk")
        left, right = block_pairs(posts, posts, ["field", "term"], "pk", "pk")
        a, b = left.alias("a"), right.alias("b")
        filled = lambda c: (F.col(f"a.{c}") != "") & (F.col(f"b.{c}") != "")
        equal = lambda c: equal_filled(F.col(f"a.{c}"), F.col(f"b.{c}"))
        plain = (F.when(filled("maker"), R.WEIGHTS["maker"]).otherwise(0.0) + equal("type") * R.WEIGHTS["type"]
                 + equal("unit") * R.WEIGHTS["unit"])
        product, least = F.col("a.tail") * F.col("b.tail"), F.lit(threshold - EPS) - plain
        shared = attribute_similarity(F.col("a.attrs"), F.col("b.attrs")) * R.WEIGHTS["attributes"]
        can_reach = (product >= least - R.WEIGHTS["attributes"]) & (product >= least - shared)
        found = a.join(b, (F.col("a.field") == F.col("b.field")) & (F.col("a.term") == F.col("b.term")) & (F.col("a.left_block") == F.col("b.left_block")) & (F.col("a.right_block") == F.col("b.right_block"))
                       & (F.col("a.node") < F.col("b.node")) & can_reach).select(
            F.col("a.pk").alias("a_pk"), F.col("b.pk").alias("b_pk")).distinct()
        return self.score(found).filter(F.col("similarity") >= threshold)

    def score(self, found: DataFrame) -> DataFrame:
        """Exact similarity of profile pairs (a_pk, b_pk)."""
        packed = V.packed(self.vectors, list(VECTORISERS))
        full = self.profiles.join(packed, "pk", "left").select("pk", "node", "n", "maker", "type", "unit", "attrs", "v_name", "v_spec")
        left = full.select(*[F.col(c).alias(f"a_{c}") for c in full.columns])
        right = full.select(*[F.col(c).alias(f"b_{c}") for c in full.columns])
        both = found.join(left, "a_pk").join(right, "b_pk")
        col = lambda c: (F.col(f"a_{c}"), F.col(f"b_{c}"))
        parts = {
            "name": V.dot(*col("v_name")), "spec": V.dot(*col("v_spec")), "maker": maker_similarity(*col("maker")),
            "type": equal_filled(*col("type")), "unit": equal_filled(*col("unit")), "attributes": attribute_similarity(*col("attrs"))}
        scored = both.select("a_pk", "b_pk", F.col("a_node").alias("a"), F.col("b_node").alias("b"), "a_n", "b_n",
                             *[c.alias(f"s_{k}") for k, c in parts.items()])
        total = sum((F.col(f"s_{k}") * w for k, w in R.WEIGHTS.items()), F.lit(0.0))
        return scored.withColumn("similarity", F.round(total, 9))

    def self_similarity(self) -> DataFrame:
        """Similarity of two copies of a profile: full marks for each filled field."""
        has = self.vectors.select("pk", "field").distinct().groupBy("pk").agg(
            F.max(F.col("field") == "name").alias("has_name"), F.max(F.col("field") == "spec").alias("has_spec"))
        w = R.WEIGHTS
        on = lambda c, k: F.when(c, w[k]).otherwise(0.0)
        total = (on(F.coalesce("has_name", F.lit(False)), "name") + on(F.coalesce("has_spec", F.lit(False)), "spec")
                 + on(F.col("maker") != "", "maker") + on(F.col("type") != "", "type") + on(F.col("unit") != "", "unit")
                 + on(F.size("attrs") > 0, "attributes"))
        return self.profiles.join(has, "pk", "left").select("pk", "node", "n", F.round(total, 9).alias("similarity"))

    def groups(self, pairs: DataFrame, threshold: float = R.EDGE) -> DataFrame:
        """(pk, node, n, master): profiles in a group of two rows or more; the master is its smallest code.

        With two points enough for a cluster, density clustering is exactly the connected
        components of the pairs at or above the threshold.
        """
        linked = components(pairs.select("a", "b"))
        nodes = self.self_similarity().join(linked, F.col("node") == F.col("v"), "left")
        alone = F.col("label").isNull() & (F.col("n") > 1) & (F.col("similarity") >= threshold)
        return nodes.filter(F.col("label").isNotNull() | alone).select("pk", "node", "n", F.coalesce("label", "node").alias("master"))

    def group_scores(self, groups: DataFrame) -> DataFrame:
        """Mean similarity over all pairs of rows in each group, from sums.

        Over all pairs the cosines add up to (|sum v|^2 - sum |v|^2) / 2, equal values to the
        pairs within each value, and unequal makers to one ratio per pair of distinct makers.
        """
        g = groups.select("pk", "master").join(self.profiles, "pk")
        size = g.groupBy("master").agg(F.sum("n").alias("rows"))
        vec = self.vectors.join(g.select("pk", "master", "n"), "pk")
        per_term = vec.groupBy("master", "field", "term").agg(F.sum(F.col("n") * F.col("w")).alias("s"), F.sum(F.col("n") * F.col("w") ** 2).alias("q"))
        cos = per_term.groupBy("master").pivot("field", list(VECTORISERS)).agg(((F.sum(F.col("s") ** 2) - F.sum("q")) / 2).alias("x"))

        def equal_pairs(c: str) -> DataFrame:
            counts = g.filter(F.col(c) != "").groupBy("master", c).agg(F.sum("n").alias("k"))
            return counts.groupBy("master").agg(F.sum(F.col("k") * (F.col("k") - 1) / 2).alias(c))

        makers = g.filter(F.col("maker") != "").groupBy("master", "maker").agg(F.sum("n").alias("k"))
        other = makers.alias("x").join(makers.alias("y"), (F.col("x.master") == F.col("y.master")) & (F.col("x.maker") < F.col("y.maker"))).select(
            F.col("x.master").alias("master"), (F.col("x.k") * F.col("y.k") * _ratio(F.col("x.maker"), F.col("y.maker"))).alias("p"))
        same = makers.select("master", (F.col("k") * (F.col("k") - 1) / 2).alias("p"))
        maker = same.unionByName(other).groupBy("master").agg(F.sum("p").alias("maker"))

        out = size
        for part in (cos, maker, equal_pairs("type"), equal_pairs("unit"), _attribute_pairs(g)):
            out = out.join(part, "master", "left")
        total = sum((F.coalesce(F.col(k), F.lit(0.0)) * w for k, w in R.WEIGHTS.items()), F.lit(0.0))
        mean = total / (F.col("rows") * (F.col("rows") - 1) / 2)
        return out.select("master", "rows", F.round(mean, 9).alias("similarity"))


def _attribute_pairs(g: DataFrame) -> DataFrame:
    """Summed attribute similarity per group: equal values are paired within (key set, key set), of which there are few."""
    entries = g.select("master", "n", F.array_sort(F.map_keys("attrs")).alias("keys"), F.explode("attrs").alias("k", "v"))
    counts = entries.groupBy("master", "keys", "k", F.lower("v").alias("v")).agg(F.sum("n").alias("c"))
    x, y = counts.alias("x"), counts.alias("y")
    same = F.array_join("x.keys", "\x1f") == F.array_join("y.keys", "\x1f")
    both = x.join(y, (F.col("x.master") == F.col("y.master")) & (F.col("x.k") == F.col("y.k")) & (F.col("x.v") == F.col("y.v"))
                  & (F.array_join("x.keys", "\x1f") <= F.array_join("y.keys", "\x1f")))
    n = F.when(same, F.col("x.c") * (F.col("x.c") - 1) / 2).otherwise(F.col("x.c") * F.col("y.c"))
    share = n / F.size(F.array_intersect("x.keys", "y.keys"))
    return both.select(F.col("x.master").alias("master"), share.alias("p")).groupBy("master").agg(F.sum("p").alias("attributes"))


#: A node with more than this share of all rows is a hub, so there are fewer hubs than its inverse.
HUB_SHARE = 1 / 1000


def _beside(rows: DataFrame, of_node: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``of_node``, which has one row per ``key`` and the number ``n`` of its rows; hubs by broadcast, the others by a shuffle."""
    bound = (of_node.agg(F.sum("n")).first()[0] or 0) * HUB_SHARE
    hubs, others = F.broadcast(of_node.filter(F.col("n") > bound).drop("n")), of_node.filter(F.col("n") <= bound).drop("n")  # fewer than a thousand rows
    return rows.join(hubs, key).unionByName(rows.join(hubs.select(key), key, "left_anti").join(others, key))


def components(edges: DataFrame) -> DataFrame:
    """(v, label): smallest node reachable from each node of the edge list (a, b); null ends and loops are ignored.

    Star contraction: a large step links the larger neighbours of a node to the smallest node it
    knows, a small step links a node's smaller neighbours to the smallest of them, until every
    node hangs on its component's smallest one. A node's neighbours are never listed: their
    minimum is combined before the shuffle, and the edges of a hub stay where they are. Every
    round is written to the shared folder.
    """
    ends = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).filter("a IS NOT NULL AND b IS NOT NULL AND v <> m")
    ends = stored(ends.distinct(), "links")
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first())
    before = mark(ends)
    while True:
        both = ends.unionByName(ends.select(F.col("m").alias("v"), F.col("v").alias("m")))
        least = stored(both.groupBy("v").agg(F.least("v", F.min("m")).alias("root"), F.count("*").alias("n")), "least")
        large = _beside(ends.select(F.col("m").alias("v"), F.col("v").alias("x")), least, "v").select(F.col("x").alias("v"), F.col("root").alias("m"))
        large = stored(large.filter("v <> m").distinct(), "links")
        least = stored(large.groupBy("v").agg(F.min("m").alias("root"), F.count("*").alias("n")), "least")
        small = _beside(large.select("v", F.col("m").alias("x")), least, "v").filter("x <> root").select(F.col("x").alias("v"), F.col("root").alias("m"))
        ends = stored(small.unionByName(least.select("v", F.col("root").alias("m"))).distinct(), "links")
        after = mark(ends)
        if after == before:
            return ends.select("v", F.col("m").alias("label")).unionByName(ends.select(F.col("m").alias("v"), F.col("m").alias("label")).distinct())
        before = after


def decide(scores: DataFrame) -> DataFrame:
    s = F.col("similarity")
    return scores.withColumns({
        "confidence_level": F.when(s >= R.HIGH, "高置信度").when(s >= R.MEDIUM, "中等置信度").otherwise("低置信度"),
        "action": F.when(s >= R.HIGH, "auto_merge").when(s >= R.MEDIUM, "manual_review").otherwise("separate"),
        "review_required": s < R.HIGH})


def persist_tables(decided: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Group rows and member rows as they are stored; the group id is a hash of its master."""
    gid = F.md5(F.col("master").cast("string"))
    groups = decided.select(gid.alias("group_id"), F.col("master").alias("master_code"), F.col("similarity").alias("group_confidence"),
                            F.lit("pending").alias("status"))
    rows = members.join(decided.select("master", "similarity"), "master").select(
        gid.alias("group_id"), "code", "source", F.col("similarity").alias("similarity_score"))
    return groups, rows


def member_rows(dup: Duplicates, groups: DataFrame) -> DataFrame:
    return dup.rows.join(groups.select("pk", "master"), "pk").select("master", "code", "source")


PIECE = 3


def _pieces(c: Column) -> Column:
    """Distinct substrings of one to three characters."""
    none = F.array().cast("array<string>")
    cut = lambda k: F.when(F.length(c) >= k, F.transform(F.sequence(F.lit(1), F.length(c) - (k - 1)), lambda i: F.substring(c, i, F.lit(k)))).otherwise(none)
    return F.array_distinct(F.concat(*[cut(k) for k in range(1, PIECE + 1)]))


def containment(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """(text_id, key) wherever text contains key, as an equi join on the key's rarest piece.

    ``texts`` is (text_id, text) with one row per id, ``keys`` is (key). A text gives its pieces of
    up to three characters beside its id alone; pieces that no key has are dropped at once, a
    key is looked up under the one that fewest texts have, and what is found is checked against
    the text.
    """
    wanted = keys.filter("key <> ''").select("key").distinct()
    width = F.least(F.length("key"), F.lit(PIECE))
    of_key = F.transform(F.sequence(F.lit(1), F.length("key") - width + 1), lambda i: F.substring(F.col("key"), i, width))
    parts = wanted.select("key", F.explode(F.array_distinct(of_key)).alias("piece"))
    posts = texts.select("text_id", F.explode(_pieces(F.col("text"))).alias("piece")).join(parts.select("piece").distinct(), "piece", "left_semi")
    counts = posts.groupBy("piece").agg(F.count("*").alias("df"))
    anchor = parts.join(counts, "piece").groupBy("key").agg(F.min_by("piece", F.struct("df", "piece")).alias("piece"), F.count("*").alias("known"))
    # A key with a piece that no text has is in none.
    whole = parts.groupBy("key").agg(F.count("*").alias("known"))
    found = posts.join(anchor.join(whole, ["key", "known"]).select("key", "piece"), "piece").select("text_id", "key")
    return found.join(texts, "text_id").filter(F.contains("text", F.col("key"))).select("text_id", "key")


def enrich_groups(decided: DataFrame, master_rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Look each group's master up in the catalog: its name or spec inside a catalog name or spec.

    ``master_rows`` is (master, name, spec), ``catalog`` is (id, name, spec, category). One
    distinct category over all hits raises the score and proposes merging into it. Blank text
    looks nothing up. The catalog is reduced to distinct (text, category) first and written, so neither
    copies of a text nor a master's number of hits are ever listed.
    """
    cats = None
    for c in ("name", "spec"):
        keys = master_rows.filter(F.col(c) != "").select(F.col(c).alias("key"), "master")
        known = stored(catalog.filter(F.col(c) != "").select(F.col(c).alias("text"), "category").distinct().withColumn("text_id", F.md5("text")), "catalog")
        got = containment(known.select("text_id", "text").distinct(), keys.select("key"))
        per_key = got.join(known.drop("text"), "text_id").select("key", "category").distinct()
        part = per_key.join(keys, "key").select("master", "category")
        cats = part if cats is None else cats.unionByName(part)
    cats = cats.groupBy("master").agg(F.array_sort(F.collect_set("category")).alias("existing_categories"))
    one = F.size("existing_categories") == 1
    out = decided.join(cats, "master", "left")
    return out.withColumns({
        "similarity": F.when(one, F.least(F.col("similarity") + R.EXISTING_GAIN, F.lit(1.0))).otherwise(F.col("similarity")),
        "action": F.when(one, "merge_with_existing").otherwise(F.col("action"))})


def recommend_actions(enriched: DataFrame, classified: DataFrame, auto_merge=R.AUTO_MERGE, review=R.REVIEW) -> DataFrame:
    """Action and priority by the request's thresholds, with the category to use or the conflict to settle.

    ``classified`` is (master, category) from a classifier, used where the catalog knew nothing.
    """
    s, cats = F.col("similarity"), F.col("existing_categories")
    kind = F.when(F.size(cats) == 1, "merge_to_existing").when(F.size(cats) > 1, "resolve_conflicts").when(
        F.col("new_category").isNotNull(), "new_classification").otherwise("manual_classification")
    out = enriched.join(classified.select("master", F.col("category").alias("new_category")), "master", "left")
    return out.select(
        "master", "similarity", "rows", F.when(s >= auto_merge, "auto_merge").when(s >= review, "manual_review").otherwise("separate").alias("action"),
        F.when(s >= auto_merge, "high").when(s >= review, "medium").otherwise("low").alias("priority"), kind.alias("integration_type"),
        F.when(F.size(cats) == 1, F.get(cats, F.lit(0))).when(cats.isNull(), F.col("new_category")).alias("suggested_category"),
        F.when(F.size(cats) > 1, cats).alias("conflicting_categories"))


def split_by_source(members: DataFrame) -> DataFrame:
    sources = members.groupBy("master").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.count("*").alias("rows"))
    return sources.withColumn("scope", F.when(F.size("sources") > 1, "cross_source").otherwise("single_source"))


def merge_map(members: DataFrame, requested: DataFrame) -> DataFrame:
    """One row per merged code of the requested groups; an unknown group is reported with status not_found."""
    merged = requested.join(members, "master").filter(F.col("code") != F.col("master")).select(
        "master", F.col("code").alias("merged_code"), F.lit("merged").alias("status"))
    unknown = requested.join(members.select("master").distinct(), "master", "left_anti").select(
        "master", F.lit(None).cast("bigint").alias("merged_code"), F.lit("not_found").alias("status"))
    return merged.unionByName(unknown)
