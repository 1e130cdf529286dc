"""New items against a master list: blocking, cosine scores, thresholds and top-n.

Scores are exact. A pair is scored only if some shared term shows it can reach the
threshold: with terms ordered from rare to frequent, the product of two vectors is at most
the product of their tails from the first shared term on. So frequent terms, whose tails
are short, generate no pairs, and nothing is capped or sampled.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partwise.functions import tfidf as V
from partwise.functions.extract import spec_features
from partwise.functions.text import maker_fingerprint
from partwise.operators.reach import master_words, reachable, row_frequencies
from partwise.operators.setjoin import block_pairs, similar_sets, similar_strings
from partwise.session import stored

EPS = 1e-9
# Weights of a fuzzy field and of the joined description.
FIELD_WEIGHT, DESCRIPTION_WEIGHT = 0.8, 0.6


@dataclass(frozen=True)
class MatchConfig:
    """Which columns are compared. ``fuzzy`` and ``exact`` pair a new-item column with a master column."""

    new_id: str
    master_id: str
    fuzzy: list[tuple[str, str]]
    exact: list[tuple[str, str]] = field(default_factory=list)
    describe: bool = True
    vectoriser: V.Vectoriser = V.FIELD_MATCH

    def fields(self) -> list[str]:
        return [f"f{i}" for i in range(len(self.fuzzy))] + (["description"] if self.describe else [])

    def compared(self) -> list[str]:
        """Fields whose texts differ: the description of one field is that field."""
        return ["f0"] if len(self.fuzzy) == 1 else self.fields()

    def weights(self) -> dict[str, float]:
        return {f: DESCRIPTION_WEIGHT if f == "description" else FIELD_WEIGHT for f in self.fields()}

    def vectorisers(self) -> dict[str, V.Vectoriser]:
        return {f: self.vectoriser for f in self.compared()}


def _side(df: DataFrame, cfg: MatchConfig, which: int) -> tuple[DataFrame, dict[str, Column], list[str]]:
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    ident = cfg.new_id if which == 0 else cfg.master_id
    exact = [f"e{i}" for i in range(len(cfg.exact))]
    cols = [F.col(ident).alias("id")] + [blank(p[which]).alias(e) for e, p in zip(exact, cfg.exact)]
    texts = {f"f{i}": F.coalesce(F.col(p[which]).cast("string"), F.lit("")) for i, p in enumerate(cfg.fuzzy)}
    if "description" in cfg.compared():
        texts["description"] = F.concat_ws(" ", *texts.values())
    rows = df.select(*cols, *[c.alias(f) for f, c in texts.items()])
    return rows, {f: F.col(f) for f in texts}, exact


def _members(rows: DataFrame, texts, exact) -> DataFrame:
    return rows.select(V.profile_key([F.col(c) for c in [*exact, *texts]]).alias("pk"), "id")


def candidate_counts(new: DataFrame, master: DataFrame, cfg: MatchConfig) -> DataFrame:
    """Masters left per new item by the exact fields; a blank new value does not filter.

    Counted from per-key totals, one equi join per combination of filled fields, without
    listing the candidates.
    """
    n_rows, _, exact = _side(new, cfg, 0)
    m_rows, _, _ = _side(master, cfg, 1)
    out = None
    for mask in product([False, True], repeat=len(exact)):
        used = [e for e, on in zip(exact, mask) if on]
        part = n_rows.select("id", *exact).filter(_mask(exact, mask))
        totals = m_rows.groupBy(*used).agg(F.count("*").alias("candidates"))
        found = part.join(totals, used, "left") if used else part.crossJoin(F.broadcast(totals))
        found = found.select("id", F.coalesce("candidates", F.lit(0)).alias("candidates"))
        out = found if out is None else out.unionByName(found)
    return out


def _mask(exact: list[str], mask: tuple[bool, ...]) -> Column:
    keep = F.lit(True)
    for e, on in zip(exact, mask):
        keep = keep & ((F.col(e) != "") if on else (F.col(e) == ""))
    return keep


def _pairs(new_posts: DataFrame, master_posts: DataFrame, exact: list[str], can_reach: Column) -> DataFrame:
    """Profile pairs sharing a (field, term) that ``can_reach``; one equi join per filled-field combination."""
    # A term's lists are cut on both sides, so no hot term is one task.
    new_posts, master_posts = block_pairs(new_posts, master_posts, ["field", "term"], "pk", "pk")
    out = None
    for mask in product([False, True], repeat=len(exact)):
        used = [e for e, on in zip(exact, mask) if on]
        left = new_posts.filter(_mask(exact, mask)).alias("n")
        on = [F.col(f"n.{c}") == F.col(f"m.{c}") for c in ["field", "term", "left_block", "right_block", *used]]
        joined = left.join(master_posts.alias("m"), on).filter(can_reach)
        found = joined.select(F.col("n.pk").alias("n_pk"), F.col("m.pk").alias("m_pk"))
        out = found if out is None else out.unionByName(found)
    return out.distinct()


class Matcher:
    """The prepared sides of a match: profiles, vocabulary of the master, vectors of both."""

    def __init__(self, new: DataFrame, master: DataFrame, cfg: MatchConfig, threshold: float | None = None, most: int | None = None):
        """With ``threshold`` or ``most`` only what reaches it, or is among as many best, need be found; few new texts then find it by bounds."""
        self.cfg = cfg
        self.n_rows, texts, self.exact = _side(new, cfg, 0)
        self.m_rows, _, _ = _side(master, cfg, 1)
        self.all_rows = self.m_rows
        self.texts = list(texts)
        n_prof = V.profiles(self.n_rows, texts, self.exact)
        vec = cfg.vectorisers()
        # Texts are read and split once; every later step starts from these written counts.
        n_counts = stored(V.term_counts(n_prof, vec), "terms")
        self.near = self._near(n_counts, threshold, most)
        if self.near is not None:
            return
        m_prof = V.profiles(self.m_rows, texts, self.exact)
        m_counts = stored(V.term_counts(m_prof, vec), "terms")
        self.vocab = stored(V.vocabulary(m_counts, self.m_rows, vec), "vocabulary")
        self.n_vec = stored(V.vectors(n_counts, self.vocab), "vectors")
        # A product has only terms of both sides, so of the master only the new items' terms are kept; its norms count all.
        self.m_vec = stored(V.vectors(m_counts, self.vocab, self.n_vec.select("field", "term").distinct()), "vectors")
        self.n_exact = n_prof.select("pk", *self.exact)
        self.m_exact = m_prof.select("pk", *self.exact)

    def _near(self, n_counts: DataFrame, threshold: float | None, most: int | None) -> DataFrame | None:
        """(n_pk, m_pk, s_f0) of the pairs that can matter, and ``m_rows`` cut to theirs; None where the whole master is to be compared.

        Of the master only the terms of these rows are counted, over all its rows.
        """
        v = self.cfg.vectoriser
        if self.cfg.compared() != ["f0"] or self.exact or v.max_features or v.longest > 2 or not ((threshold or 0) > 0 or most):
            return None
        words = master_words(self.m_rows, "f0", v)
        rows = words.count()
        pairs = reachable(n_counts, words, v, rows, threshold, most)
        if pairs is None:
            return None
        pairs = stored(pairs, "near")
        self.m_rows = stored(self.m_rows.withColumn("pk", V.profile_key([F.col("f0")])).join(pairs.select(F.col("m_pk").alias("pk")).distinct(), "pk", "left_semi").drop("pk"), "near_rows")
        vec = self.cfg.vectorisers()
        counts = stored(V.term_counts(V.profiles(self.m_rows, {"f0": F.col("f0")}), vec), "terms")
        known = row_frequencies(words, counts.select("term"), v.longest).withColumn("idf", F.log((1 + F.lit(rows)) / (1 + F.col("df"))) + 1)
        raw = F.col("tf") * F.col("idf")
        norms = counts.join(known, "term").groupBy(F.col("pk").alias("m_pk")).agg(F.sqrt(F.sum(raw * raw)).alias("norm"))
        return stored(pairs.join(norms, "m_pk").select("n_pk", "m_pk", (F.col("dot") / F.col("norm")).alias("s_f0")), "scores")

    def _posts(self, vec: DataFrame, exact: DataFrame) -> DataFrame:
        posts = V.postings(vec)
        return posts.join(exact, "pk") if self.exact else posts

    def score(self, pairs: DataFrame) -> DataFrame:
        """Per-field cosine of profile pairs: (n_pk, m_pk, s_<field>...)."""
        fields = self.cfg.compared()
        same = [f for f in self.cfg.fields() if f not in fields]
        if self.near is not None:
            return pairs.withColumns({f"s_{f}": F.col("s_f0") for f in same})
        left = V.packed(self.n_vec, fields).withColumnsRenamed({"pk": "n_pk"} | {f"v_{f}": f"n_{f}" for f in fields})
        right = V.packed(self.m_vec, fields).withColumnsRenamed({"pk": "m_pk"} | {f"v_{f}": f"m_{f}" for f in fields})
        both = pairs.join(left, "n_pk").join(right, "m_pk")
        scored = both.select("n_pk", "m_pk", *[V.dot(F.col(f"n_{f}"), F.col(f"m_{f}")).alias(f"s_{f}") for f in fields])
        return scored.withColumns({f"s_{f}": F.col("s_f0") for f in same})

    def candidates(self, threshold: float) -> DataFrame:
        """Profile pairs some field of which can reach the threshold; a weighted mean never exceeds its largest term."""
        low = threshold - EPS
        if self.near is not None:
            return self.near.filter(F.col("s_f0") >= low)
        n = self._posts(self.n_vec, self.n_exact).filter(F.col("tail") >= low)
        m = self._posts(self.m_vec, self.m_exact).filter(F.col("tail") >= low)
        return _pairs(n, m, self.exact, F.col("n.tail") * F.col("m.tail") >= low)

    def candidates_topk(self, k: int, probe: int = 8) -> DataFrame:
        """Profile pairs that can be among a new profile's k best, for one field and no threshold.

        The ``probe`` rarest terms give k scored masters, hence a floor; only terms whose tail
        reaches the floor are then looked up. Without k masters the floor is 0 and every term is.
        """
        if self.near is not None:
            return self.near
        n = self._posts(self.n_vec, self.n_exact)
        m = self._posts(self.m_vec, self.m_exact)
        name = self.cfg.fields()[0]
        first = self.score(_pairs(n.filter(F.col("place") <= probe), m, self.exact, F.lit(True)))
        rank = F.expr(f"row_number() OVER (PARTITION BY n_pk ORDER BY s_{name} DESC)")
        floor = first.withColumn("r", rank).filter(F.col("r") == k).select(F.col("n_pk").alias("pk"), F.col(f"s_{name}").alias("floor"))
        reach = n.join(floor, "pk", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)) - EPS).filter(F.col("tail") >= F.col("floor"))
        return _pairs(reach, m, self.exact, F.col("n.tail") * F.col("m.tail") >= F.col("n.floor"))

    def combined(self, scored: DataFrame) -> DataFrame:
        return _combined(scored, self.cfg)

    def top_rows(self, scored: DataFrame, top_n: int) -> DataFrame:
        """Best masters per new item, ties by master id: profiles first, then their rows.

        At most top_n profiles, and top_n rows of each, can matter; both limits are ranks that
        Spark applies before shuffling.
        """
        cols = [c for c in scored.columns if c not in ("n_pk", "m_pk")]
        masters = _members(self.m_rows, self.texts, self.exact).withColumn(
            "at", F.expr("row_number() OVER (PARTITION BY pk ORDER BY id)")).filter(F.col("at") <= top_n)
        rows = scored.join(masters.select(F.col("pk").alias("m_pk"), F.col("id").alias("master_id")), "m_pk")
        rank = F.expr("row_number() OVER (PARTITION BY n_pk ORDER BY similarity DESC, master_id)")
        best = rows.withColumn("rank", rank).filter(F.col("rank") <= top_n)
        items = _members(self.n_rows, self.texts, self.exact).select(F.col("pk").alias("n_pk"), F.col("id").alias("new_id"))
        return items.join(best, "n_pk").select("new_id", "master_id", "rank", *cols)


def match(new: DataFrame, master: DataFrame, cfg: MatchConfig, threshold: float = 0.3, top_n: int = 5) -> DataFrame:
    """(new_id, master_id, rank, s_<field>..., similarity) with similarity at or above the threshold."""
    few = _match_capped(new, master, cfg, threshold, top_n)
    if few is not None:
        return few
    m = Matcher(new, master, cfg, threshold, top_n)
    scored = m.combined(m.score(m.candidates(threshold)))
    # Rounded before ranking, so that equal scores tie whatever order their terms were added in.
    kept = scored.withColumn("similarity", F.round("similarity", 9)).filter(F.col("similarity") >= threshold)
    return m.top_rows(kept, top_n)


#: Most numbers (terms times distinct new texts) that are sent to every task.
BROADCAST_CELLS = 1 << 22


def _match_capped(new: DataFrame, master: DataFrame, cfg: MatchConfig, threshold: float, top_n: int) -> DataFrame | None:
    """``match`` of one text over a bounded vocabulary with few new texts: each master is compared where it is read. None where these are too many."""
    v = cfg.vectoriser
    if not v.max_features or cfg.compared() != ["f0"] or cfg.exact or threshold <= 0:
        return None
    n_rows, texts, _ = _side(new, cfg, 0)
    m_rows, _, _ = _side(master, cfg, 1)
    prof = stored(V.profiles(n_rows, texts).select("pk", "f0"), "profiles")
    if prof.count() * v.max_features > BROADCAST_CELLS:
        return None
    terms = [(r.term, r.idf) for r in V.frequent_terms(m_rows, "f0", {"f0": v}).collect()]
    at, weights = {t: i for i, (t, _) in enumerate(terms)}, V.row_weights(prof, "pk", F.col("f0"), v.pattern, v.group, terms).collect()
    names = sorted({r.pk for r in weights})
    column, vectors = {pk: i for i, pk in enumerate(names)}, np.zeros((len(terms), len(names)))
    for r in weights:
        vectors[at[r.term], column[r.pk]] = r.w
    found = V.row_scores(m_rows, "id", F.col("f0"), v.pattern, v.group, terms, names, vectors, threshold, top_n)
    scored = found.select(F.col("name").alias("n_pk"), F.col("id").alias("master_id"), *[F.col("s").alias(f"s_{f}") for f in cfg.fields()])
    kept = _combined(scored, cfg).withColumn("similarity", F.round("similarity", 9)).filter(F.col("similarity") >= threshold)
    best = kept.withColumn("rank", F.expr("row_number() OVER (PARTITION BY n_pk ORDER BY similarity DESC, master_id)")).filter(F.col("rank") <= top_n)
    items = _members(n_rows, list(texts), []).select(F.col("pk").alias("n_pk"), F.col("id").alias("new_id"))
    return items.join(best, "n_pk").select("new_id", "master_id", "rank", *[f"s_{f}" for f in cfg.fields()], "similarity")


def _combined(scored: DataFrame, cfg: MatchConfig) -> DataFrame:
    weights = cfg.weights()
    total = sum((F.col(f"s_{f}") * w for f, w in weights.items()), F.lit(0.0))
    return scored.withColumn("similarity", total / sum(weights.values()))


def match_details(cfg: MatchConfig) -> Column:
    """map of ``<field>_similarity`` rounded to four places."""
    pairs = [x for f in cfg.fields() for x in (F.lit(f"{f}_similarity"), F.round(F.col(f"s_{f}"), 4))]
    return F.create_map(*pairs)


def match_baseline(new: DataFrame, master: DataFrame, cfg: MatchConfig, top_n: int = 3) -> DataFrame:
    """One joined text, no threshold: the best top_n masters, zero scores included."""
    m = Matcher(new, master, cfg, most=top_n)
    name = cfg.fields()[0]
    scored = m.score(m.candidates_topk(top_n)).withColumn("similarity", F.round(f"s_{name}", 9)).filter(F.col("similarity") > 0)
    best = m.top_rows(scored.select("n_pk", "m_pk", "similarity"), top_n)
    return _fill_zero(m, best, top_n)


def _fill_zero(m: Matcher, best: DataFrame, top_n: int) -> DataFrame:
    """Items short of top_n take unscored masters of their block by id. The first 2n-1 of a block always suffice."""
    rows = best.groupBy("new_id").agg(F.count("*").alias("have"), F.collect_set("master_id").alias("seen"))
    short = m.n_rows.select(F.col("id").alias("new_id"), *m.exact).join(rows, "new_id", "left").withColumns(
        {"have": F.coalesce("have", F.lit(0)), "seen": F.coalesce("seen", F.array().cast(f"array<{dict(m.all_rows.dtypes)['id']}>"))}).filter(F.col("have") < top_n)
    out = best
    for mask in product([False, True], repeat=len(m.exact)):
        used = [e for e, on in zip(m.exact, mask) if on]
        order = ", ".join(used)
        ranked = F.expr(f"row_number() OVER ({'PARTITION BY ' + order if used else ''} ORDER BY id)")
        pool = m.all_rows.select("id", *used).orderBy("id").limit(2 * top_n - 1) if not used else (
            m.all_rows.select("id", *used).withColumn("at", ranked).filter(F.col("at") <= 2 * top_n - 1).drop("at"))
        pools = pool.groupBy(*used).agg(F.array_sort(F.collect_list("id")).alias("pool"))
        part = short.filter(_mask(m.exact, mask))
        got = part.join(pools, used) if used else part.crossJoin(F.broadcast(pools))
        fill = F.slice(F.array_except("pool", "seen"), F.lit(1), F.lit(top_n) - F.col("have").cast("int"))
        rest = got.select("new_id", "have", F.posexplode(fill).alias("pos", "master_id")).select(
            "new_id", "master_id", (F.col("have") + F.col("pos") + 1).cast("int").alias("rank"), F.lit(0.0).alias("similarity"))
        out = out.unionByName(rest)
    return out


def match_lists(matches: DataFrame, new: DataFrame, new_id: str) -> DataFrame:
    """Each new row with its ordered list of matches; rows without one get an empty list."""
    packed = matches.groupBy("new_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "similarity", F.col("master_id").alias("id")))),
        lambda x: F.struct(x["similarity"].alias("similarity"), x["id"].alias("id"))).alias("matches"))
    kind = packed.schema["matches"].dataType.simpleString()
    return new.join(packed, new[new_id] == packed["new_id"], "left").drop("new_id").withColumn(
        "matches", F.coalesce("matches", F.array().cast(kind)))


def find_similar(new: DataFrame, corpus: DataFrame, cfg: MatchConfig, threshold=0.3, max_results=10) -> DataFrame:
    """Ranked similar rows with the score as an integer percentage."""
    found = match(new, corpus, cfg, threshold, max_results)
    return found.withColumn("percent", (F.col("similarity") * 100).cast("int")).drop(*[f"s_{f}" for f in cfg.fields()])


# Thresholds advised when nothing positive was seen.
DEFAULT_THRESHOLDS = {"low": 0.2, "medium": 0.4, "high": 0.6}


def recommend_threshold(sample: DataFrame, corpus: DataFrame, cfg: MatchConfig, max_results: int = 20) -> DataFrame:
    """Quartiles of the positive scores among each sampled row's best matches."""
    m = Matcher(sample, corpus, cfg, most=max_results)
    scored = m.score(m.candidates_topk(max_results)).withColumn("similarity", F.round(f"s_{cfg.fields()[0]}", 9))
    best = m.top_rows(scored.filter(F.col("similarity") > 0).select("n_pk", "m_pk", "similarity"), max_results)
    q = best.agg(F.percentile("similarity", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return q.select(*[F.coalesce(F.get("q", F.lit(i)), F.lit(v)).alias(k) for i, (k, v) in enumerate(DEFAULT_THRESHOLDS.items())])


def best_match(source: DataFrame, scored: list[DataFrame], source_id: str) -> DataFrame:
    """Best target per source row over ordered strategies; a later strategy wins only with a strictly higher confidence.

    Each scored frame is (source_id, target_id, confidence, strategy).
    """
    ranked = None
    for i, s in enumerate(scored):
        part = s.select("source_id", "target_id", "confidence", "strategy", F.lit(i).alias("order"))
        ranked = part if ranked is None else ranked.unionByName(part)
    # max_by on (confidence, earlier strategy, smaller id), combined before the shuffle.
    pick = F.max_by(F.struct("target_id", "confidence", "strategy"), F.struct("confidence", -F.col("order"), -F.col("target_id")))
    best = ranked.filter("confidence > 0").groupBy("source_id").agg(pick.alias("b"))
    return source.select(F.col(source_id).alias("source_id")).join(best, "source_id", "left").select(
        "source_id", F.col("b.target_id").alias("target_id"), F.coalesce("b.confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("b.strategy", F.lit("none")).alias("strategy"))


def exact_code(source: DataFrame, target: DataFrame, source_id: str, target_id: str, source_code: str, target_code: str) -> DataFrame:
    """Strategy: equal non-blank standard codes score 1. A code shared by many targets keeps its smallest id."""
    t = target.filter(F.coalesce(F.col(target_code).cast("string"), F.lit("")) != "").groupBy(
        F.col(target_code).alias("code")).agg(F.min(target_id).alias("target_id"))
    s = source.select(F.col(source_id).alias("source_id"), F.col(source_code).alias("code"))
    return s.join(t, "code").select("source_id", "target_id", F.lit(1.0).alias("confidence"), F.lit("exact_code").alias("strategy"))


def lookup_category(df: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Standard category and confidence by name; an unmapped name keeps itself with confidence 1 and type original."""
    m = mapping.withColumnRenamed("original_category", column)
    return df.join(m, column, "left").withColumns({
        "mapping_type": F.when(F.col("standard_category").isNull(), "original").otherwise("mapped"),
        "standard_category": F.coalesce("standard_category", column),
        "confidence": F.coalesce("confidence", F.lit(1.0))})


#: Similarities at which the best past names are looked for in turn; the last one takes any shared word.
STEPS = (0.6, 0.3, 1e-6)


def history_recommendation(items: DataFrame, history: DataFrame, top: int = 3) -> DataFrame:
    """Categories of past names by word Jaccard times 0.8; names collapse to distinct texts before they are compared.

    Names are first compared at a high similarity, where few share a rare word; only those short
    of ``top`` past rows are compared again at a lower one, so common words are joined for the rest alone.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    sets = lambda df: df.select(F.col("name").alias("id"), words(F.col("name")).alias("tokens"))
    old = stored(history.groupBy("name", "category").agg(F.min("id").alias("history_id")), "history")
    past = stored(sets(old.select("name").distinct()), "history_words")
    rows_of = old.groupBy(F.col("name").alias("right_id")).agg(F.count("*").alias("rows"))
    left, found = stored(sets(items.select("name").distinct()), "item_words"), None
    for step in STEPS:
        pairs = stored(similar_sets(left, past, step), "name_pairs")
        # The last look finds whatever there is; before, a name is done once it has enough past rows.
        have = pairs.join(rows_of, "right_id").groupBy(F.col("left_id").alias("id")).agg(F.sum("rows").alias("rows"))
        done = have.filter(F.col("rows") >= (top if step != STEPS[-1] else 1)).select("id")
        part = pairs.join(done, pairs["left_id"] == done["id"], "left_semi")
        found = part if found is None else found.unionByName(part)
        left = stored(left.join(done, "id", "left_anti"), "item_words")
        if left.isEmpty():
            break
    alike = F.lower("left_id") == F.lower("right_id")
    scored = found.withColumn("confidence", F.when(alike, 1.0).otherwise(F.col("similarity")) * 0.8)
    full = scored.join(old.withColumnRenamed("name", "right_id"), "right_id").withColumn("confidence", F.round("confidence", 9))
    rank = F.expr("row_number() OVER (PARTITION BY left_id ORDER BY confidence DESC, history_id)")
    best = full.withColumn("rank", rank).filter(F.col("rank") <= top)
    return items.select(F.col("id").alias("item_id"), F.col("name").alias("left_id")).join(best, "left_id").select(
        "item_id", "category", "confidence", "history_id", "rank")


def expand_pairs(m: Matcher, scored: DataFrame) -> DataFrame:
    """Profile pairs as pairs of row ids."""
    n = _members(m.n_rows, m.texts, m.exact).select(F.col("pk").alias("n_pk"), F.col("id").alias("new_id"))
    r = _members(m.m_rows, m.texts, m.exact).select(F.col("pk").alias("m_pk"), F.col("id").alias("master_id"))
    return scored.join(n, "n_pk").join(r, "m_pk").drop("n_pk", "m_pk")


def _exact_strategy(source, target, source_id, target_id, cfg):
    return exact_code(source, target, source_id, target_id, "standard_code", "standard_code")


def _text_strategy(source, target, source_id, target_id, cfg, threshold=0.5, top_n=5):
    found = match(source, target, cfg, threshold, top_n)
    return found.select(F.col("new_id").alias("source_id"), F.col("master_id").alias("target_id"),
                        F.col("similarity").alias("confidence"), F.lit("text_similarity").alias("strategy"))


def _best_of(source: DataFrame, target: DataFrame, source_id: str, target_id: str, source_text: str, target_text: str, key, join, strategy: str) -> DataFrame:
    """Best target of each source row by a join of their distinct keys; ties go to the smallest target id.

    ``key`` makes the key of a text, null where it matches nothing; it is made once for each distinct text, not for each row.
    """
    texts = target.groupBy(F.col(target_text).alias("text")).agg(F.min(target_id).alias("target_id"))
    keyed = stored(texts.select(key(F.col("text")).alias("key"), "target_id"), "target_keys").filter("key IS NOT NULL").groupBy("key").agg(F.min("target_id").alias("target_id"))
    mine = stored(source.select(F.col(source_text).alias("text")).distinct().select("text", key(F.col("text")).alias("key")), "source_keys").filter("key IS NOT NULL")
    pairs = join(mine.select("key").distinct(), keyed.select("key"))
    # One target per distinct source key, before any copies of the key come in.
    pick = F.max_by(F.struct("target_id", "similarity"), F.struct("similarity", -F.col("target_id")))
    best = pairs.join(keyed, pairs["right_id"] == keyed["key"]).withColumn("similarity", F.round("similarity", 9)).groupBy("left_id").agg(pick.alias("b"))
    by_text = mine.join(best, mine["key"] == best["left_id"]).select("text", "b")
    return source.select(F.col(source_id).alias("source_id"), F.col(source_text).alias("text")).join(by_text, "text").select(
        "source_id", F.col("b.target_id").alias("target_id"), F.col("b.similarity").alias("confidence"), F.lit(strategy).alias("strategy"))


def maker_match(source: DataFrame, target: DataFrame, source_id: str, target_id: str, source_maker: str, target_maker: str, threshold: float = 0.8) -> DataFrame:
    """Strategy: the target with the most alike maker name, by matching blocks of the names without their company forms; blank names match nothing."""
    key = lambda c: F.nullif(maker_fingerprint(c), F.lit(""))
    text = lambda df: df.select(F.col("key").alias("id"), F.col("key").alias("text"))
    return _best_of(source, target, source_id, target_id, source_maker, target_maker, key, lambda a, b: similar_strings(text(a), text(b), threshold), "manufacturer")


def spec_match(source: DataFrame, target: DataFrame, source_id: str, target_id: str, source_spec: str, target_spec: str, threshold: float = 0.6) -> DataFrame:
    """Strategy: the target that shares most of the parsed features (nominal size, pressure, material, length, temperature) of a specification text."""
    def key(c: Column) -> Column:
        found = [F.transform(v, lambda x: F.concat(F.lit(f"{k}="), x)) for k, v in spec_features(F.coalesce(c, F.lit(""))).items()]  # noqa: B023
        return F.nullif(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.array(*found)))), "|"), F.lit(""))

    sets = lambda df: df.select(F.col("key").alias("id"), F.split("key", r"\|").alias("tokens"))
    return _best_of(source, target, source_id, target_id, source_spec, target_spec, key, lambda a, b: similar_sets(sets(a), sets(b), threshold), "specification")


def _maker_strategy(source, target, source_id, target_id, cfg):
    return maker_match(source, target, source_id, target_id, "manufacturer", "manufacturer")


def _spec_strategy(source, target, source_id, target_id, cfg):
    return spec_match(source, target, source_id, target_id, "specification", "specification")


# A strategy is a function of (source, target, source_id, target_id, cfg) giving (source_id, target_id, confidence, strategy).
STRATEGIES = {"exact_code": _exact_strategy, "text_similarity": _text_strategy, "specification": _spec_strategy, "manufacturer": _maker_strategy}


def register_strategy(name: str, fn) -> None:
    STRATEGIES[name] = fn
