"""Category recommendation: the rule classifier, its material-aware form, keyword and pattern rules, and fusion.

A recommendation is (item_id, category, confidence, source, place); ``place`` is the order in
which equal confidences keep their rank.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partwise.functions import grades as G
from partwise.functions import records as REC
from partwise.functions.extract import parameter_families, spec_features
from partwise.functions.text import contains_any
from partwise.functions.tfidf import profile_key
from partwise.operators.dedup import containment
from partwise.rules import classification as R
from partwise.rules import extraction as X
from partwise.rules import training as TR
from partwise.session import cut_lineage, stored

RUNS = r"[\x{4e00}-\x{9fff}]+|[a-zA-Z]+"
RUNS2 = r"[\x{4e00}-\x{9fff}]{2,}|[a-zA-Z]{2,}"
# (kind, word, category word) in the order the ladder tries them.
PAIR_RULES = [("family", w, r) for w, rs in R.FAMILIES for r in rs] + [("synonym", w, r) for w, rs in R.SYNONYMS for r in rs]


def runs(c: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.size(F.array_union(a, b))).otherwise(0.0)


def _rule_ids(column: str, which: int) -> Column:
    """Ids of the pair rules whose item word (1) or category word (2) the named column contains."""
    by_word: dict[str, list[int]] = {}
    for i, rule in enumerate(PAIR_RULES):
        by_word.setdefault(rule[which], []).append(i)
    parts = [f"CASE WHEN contains({column}, '{w}') THEN array({', '.join(map(str, ids))}) ELSE cast(array() AS array<int>) END" for w, ids in by_word.items()]
    return F.expr(f"concat({', '.join(parts)})")


def _rule_scores() -> Column:
    """Rule id -> struct(score, exact score, item word, category word)."""
    out = []
    for kind, w, r in PAIR_RULES:
        plain = R.FAMILY_SCORE if kind == "family" else R.SYNONYM_EXACT if (w, r) in R.EXACT_SYNONYMS else R.SYNONYM_SCORE
        exact = R.FAMILY_EXACT if kind == "family" else plain
        out.append(f"struct({plain}D AS plain, {exact}D AS exact, '{w}' AS word, '{r}' AS target)")
    return F.expr(f"array({', '.join(out)})")


def name_similarity(item: Column, cat: Column, item_runs: Column, cat_runs: Column, item_rules: Column, cat_rules: Column) -> Column:
    """Equal 1; contained 0.8; shared words; the first family or synonym rule both sides meet; else 0. Texts lower-cased."""
    shared = F.size(F.array_intersect(item_runs, cat_runs))
    first = F.array_min(F.array_intersect(item_rules, cat_rules))
    rule = F.get(_rule_scores(), first)
    return (F.when(item == cat, 1.0).when(F.contains(cat, item) | F.contains(item, cat), R.CONTAINED)
            .when(shared > 0, F.greatest(jaccard(item_runs, cat_runs) * R.OVERLAP_FACTOR, F.lit(R.OVERLAP_LEAST)))
            .when(first.isNotNull(), F.when((item == rule["word"]) & (cat == rule["target"]), rule["exact"]).otherwise(rule["plain"]))
            .otherwise(0.0))


def _sample_scores(values: dict[str, Column]) -> dict[str, list[Column]]:
    """Category -> score of each of its samples: share of the given kinds some value of which the sample contains."""
    given = sum((F.when(F.size(v) > 0, 1).otherwise(0) for v in values.values()), F.lit(0))
    out = {}
    for cat, samples in R.SAMPLES.items():
        out[cat] = []
        for _, _, dn, pn, material in samples:
            hits = sum((F.when(F.exists(values[k], lambda v: F.contains(F.lit(s.lower()), v)), 1).otherwise(0)
                        for k, s in (("dn", dn), ("pn", pn), ("material", material))), F.lit(0))
            out[cat].append(F.when(given > 0, hits / given).otherwise(0.0))
    return out


def _by_category(cat: Column, values: dict[str, Column], default) -> Column:
    return reduce(lambda a, kv: a.when(cat == kv[0], kv[1]), values.items(), F.when(F.lit(False), default)).otherwise(default)


def sample_units() -> dict[str, list[str]]:
    return {cat: sorted({u for s in samples for key, us in R.COMMON_UNITS.items() if key in s[0] for u in us}) for cat, samples in R.SAMPLES.items()}


def unit_similarity(unit: Column, cat: Column) -> Column:
    known = {c: F.when(unit.isin(us), R.UNIT_MATCH).otherwise(R.UNIT_OTHER) for c, us in sample_units().items()}
    return F.when(F.coalesce(unit, F.lit("")) == "", R.UNIT_DEFAULT).otherwise(_by_category(cat, known, F.lit(R.UNIT_DEFAULT)))


ITEM_TEXTS = ["name", "spec", "unit", "dn", "pn", "material"]


def _profiles(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct item texts with what every comparison needs, computed once."""
    have = [F.coalesce(F.col(c), F.lit("")).alias(c) if c in items.columns else F.lit("").alias(c) for c in ITEM_TEXTS]
    keyed = items.select("item_id", *have).withColumn("pk", profile_key([F.col(c) for c in ITEM_TEXTS]))
    # Distinct by the texts themselves, which are hashed; first values of text per key would sort all rows.
    one = items.select(*have).distinct().withColumn("pk", profile_key([F.col(c) for c in ITEM_TEXTS])).withColumn("low", F.lower(F.trim("name")))
    feats = spec_features(F.col("spec"), F.col("dn"), F.col("pn"), F.col("material"))
    with_input = {k: F.filter(F.concat(feats[k], F.array(F.lower(F.col(k)))), lambda v: v != "") for k in ("dn", "pn", "material")}
    return keyed.select("item_id", "pk"), one.select(
        "pk", "name", "spec", "unit", "low", runs(F.col("low"), RUNS).alias("runs"), runs(F.concat_ws(" ", "name", "spec"), RUNS2).alias("words"),
        _rule_ids("low", 1).alias("rules"), *[v.alias(f"in_{k}") for k, v in with_input.items()], *[feats[k].alias(f"x_{k}") for k in feats])


def _categories(categories: DataFrame) -> DataFrame:
    text = F.concat_ws(" ", "category", F.coalesce("description", F.lit("")))
    named = categories.withColumn("c_low", F.lower(F.trim("category")))
    return named.select("category", "level", "c_low", runs(F.col("c_low"), RUNS).alias("c_runs"), runs(text, RUNS2).alias("c_words"),
                        _rule_ids("c_low", 2).alias("c_rules"))


def _pool(cats: DataFrame, top: int) -> DataFrame:
    """The sampled and general categories, and the first ``top`` others by level and name."""
    fixed = F.col("category").isin([*R.GENERAL, *R.SAMPLES])
    return cats.filter(fixed).unionByName(cats.filter(~fixed).orderBy("level", "category").limit(top))


def _candidates(prof: DataFrame, cats: DataFrame) -> DataFrame:
    """(pk, category) pairs outside the pool that can be among an item's best five.

    They share a word or a rule with the item, equal it, or one contains the other: all equi
    joins. All other categories score the same for an item, so of those only as many as are
    asked for can be listed, the first by level and name, which is what the pool holds.
    """
    def by(left: str, right: str) -> DataFrame:
        return prof.select("pk", F.explode(left).alias("k")).join(cats.select("category", F.explode(right).alias("k")), "k").select("pk", "category")

    equal = prof.join(cats, F.col("low") == F.col("c_low")).select("pk", "category")
    names, targets = prof.select("low", "pk").filter("low <> ''"), cats.select("c_low", "category").filter("c_low <> ''")
    inside = containment(names.select(F.col("low").alias("text_id"), F.col("low").alias("text")).distinct(), targets.select(F.col("c_low").alias("key")))
    around = containment(targets.select(F.col("c_low").alias("text_id"), F.col("c_low").alias("text")).distinct(), names.select(F.col("low").alias("key")))
    contained = (inside.select(F.col("text_id").alias("low"), F.col("key").alias("c_low")).unionByName(around.select(F.col("key").alias("low"), F.col("text_id").alias("c_low")))
                 .join(names, "low").join(targets, "c_low").select("pk", "category"))
    parts = [by("runs", "c_runs"), by("words", "c_words"), by("rules", "c_rules"), equal, contained]
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def _pairs(prof: DataFrame, cats: DataFrame, top: int) -> DataFrame:
    """Item profiles beside the categories worth scoring: the pool, row-locally, and what is found for the item alone."""
    prof, pool = cut_lineage(prof), _pool(cats, top)
    row = pool.agg(F.collect_list(F.struct(*cats.columns)).alias("pool"))
    listed = prof.crossJoin(F.broadcast(row)).select(*prof.columns, F.explode("pool").alias("c")).select(*prof.columns, "c.*")  # one row of at most ``top`` and the fixed names
    found = _candidates(prof, cats).join(F.broadcast(pool.select("category")), "category", "left_anti")
    return listed.unionByName(found.join(prof, "pk").join(cats, "category").select(*listed.columns))


def _scored(items: DataFrame, categories: DataFrame, top: int) -> tuple[DataFrame, DataFrame]:
    rows, prof = _profiles(items)
    # Written, so that its lists are columns to what follows and not expressions to be computed at every use.
    cats = stored(_categories(categories), "categories")
    both = _pairs(prof, cats, top)
    samples = _sample_scores({k: F.col(f"in_{k}") for k in ("dn", "pn", "material")})
    best = {c: F.greatest(*s) if len(s) > 1 else s[0] for c, s in samples.items()}
    scored = both.withColumns({
        "name_score": name_similarity(F.col("low"), F.col("c_low"), F.col("runs"), F.col("c_runs"), F.col("rules"), F.col("c_rules")),
        "spec_score": _by_category(F.col("category"), best, F.lit(0.0)),
        "unit_score": unit_similarity(F.col("unit"), F.col("category")),
        "keyword_score": jaccard(F.col("words"), F.col("c_words"))})
    total = sum((F.col(f"{k}_score") * w for k, w in R.SCORE_WEIGHTS.items()), F.lit(0.0))
    rewarded = F.when(F.col("name_score") > R.REWARD_ABOVE, total * R.REWARD).otherwise(total)
    return rows, scored.withColumn("similarity", F.round(F.least(rewarded, F.lit(1.0)), 9))


def rule_classify(items: DataFrame, categories: DataFrame, top: int = 5) -> DataFrame:
    """Best categories per item. ``items``: item_id, name, spec, unit and optional dn, pn, material;
    ``categories``: category, level, description."""
    rows, scored = _scored(items, categories, top)
    kept = scored.filter(F.col("similarity") > R.KEEP_ABOVE).withColumn("confidence", F.round(F.col("similarity") * 100, 1))
    c = F.col("confidence")
    key = (F.when(F.col("category").isin(R.SPECIFIC) & (c > R.SPECIFIC_FROM), c + R.SPECIFIC_GAIN)
           .when(F.col("category").isin(R.GENERAL), c - R.GENERAL_LOSS).otherwise(c))
    rank = F.expr("row_number() OVER (PARTITION BY pk ORDER BY sort_key DESC, level, category)")
    best = kept.withColumn("sort_key", key).withColumn("rank", rank).filter(F.col("rank") <= top)
    return rows.join(best.drop("sort_key"), "pk").drop("pk")


def attributes(df: DataFrame) -> DataFrame:
    """Adds the labelled attributes of a rule_classify row and its matching samples above 0.3, three at most."""
    item = lambda label, v: F.struct(F.lit(label).alias("label"), v.alias("value"))
    joined = lambda k: F.array_join(F.col(f"x_{k}"), ", ")
    given = [("dn", "公称直径"), ("pn", "压力等级"), ("material", "材质")]
    attrs = [item("分类名称", F.col("category")), item("分类级别", F.format_string("第%d级", F.col("level")))]
    attrs += [F.when(F.size(f"x_{k}") > 0, item(label, joined(k))) for k, label in given]
    attrs += [F.when(F.size("x_length") > 0, item("长度", F.concat(joined("length"), F.lit("m"))))]
    scores = _sample_scores({k: F.col(f"in_{k}") for k in ("dn", "pn", "material")})
    none = F.array().cast("array<struct<score:double,at:int,name:string,spec:string>>")
    found = {}
    for cat, per in scores.items():
        hits = [F.when(s > R.SAMPLE_ABOVE, F.struct(F.round(s * 100, 1).alias("score"), F.lit(-i).alias("at"), F.lit(x[0]).alias("name"), F.lit(x[1]).alias("spec")))
                for i, (s, x) in enumerate(zip(per, R.SAMPLES[cat]))]
        found[cat] = F.slice(F.sort_array(F.array_compact(F.array(*hits)), asc=False), 1, 3)
    return df.withColumns({"attributes": F.array_compact(F.array(*attrs)), "samples": _by_category(F.col("category"), found, none)})


def material_classify(items: DataFrame, categories: DataFrame, top: int = 5) -> DataFrame:
    """rule_classify on the name without its grades, then the grade bonus and family points, capped at 100 and ranked again.

    Grades are read once for each distinct name, and the categories are ranked once for each
    distinct set of texts, however many items have it.
    """
    have = [F.coalesce(F.col(c), F.lit("")).alias(c) if c in items.columns else F.lit("").alias(c) for c in ITEM_TEXTS]
    texts = profile_key([F.col(c) for c in ITEM_TEXTS]).alias("texts")
    one = stored(items.select(*have).distinct().select(texts, *ITEM_TEXTS), "texts")
    # Written, so that the searches run once and not at every use of the hits.
    hits = stored(one.select("name").distinct().withColumn("hits", G.grade_hits("name")), "grades")
    named = hits.withColumn("concept", G.core_concept(F.col("name"), F.col("hits")))
    clean = stored(named.select("name", "hits", F.when(F.coalesce("concept", F.lit("")) != "", F.col("concept")).otherwise(F.col("name")).alias("clean")), "grades")
    hits = one.join(clean, "name").select(F.col("texts").alias("item_id"), F.col("clean").alias("name"), *[c for c in ITEM_TEXTS if c != "name"], "hits")
    base = rule_classify(hits.drop("hits"), categories, top).join(hits.select("item_id", "hits"), "item_id")
    low = F.lower("category")
    points = F.when(F.lit(False), 0.0)
    for family, rules in R.MATERIAL_BOOSTS:
        has = F.exists("hits", lambda h: h["category"] == family)
        gain = reduce(lambda a, r: a.when(contains_any(low, r[0]), float(r[1])), rules, F.when(F.lit(False), 0.0)).otherwise(0.0)
        points = points.when(has, gain)
    out = base.withColumnsRenamed({"confidence": "original_confidence", "rank": "original_rank"}).withColumns({
        "bonus": G.bonus(F.col("hits"), F.col("category")) * 100, "material_bonus": F.round(G.bonus(F.col("hits"), F.col("category")) * 100, 1),
        "materials": F.transform("hits", lambda h: h["base"])})
    out = out.withColumn("confidence", F.round(F.least(F.col("original_confidence") + F.col("bonus") + points.otherwise(0.0), F.lit(100.0)), 1))
    c = F.col("confidence")
    key = (F.when((F.size("materials") > 0) & (c > R.MATERIAL_FROM), c + R.MATERIAL_GAIN)
           .when(contains_any(F.col("category"), R.RESORT_WORDS), c + R.RESORT_GAIN).otherwise(c))
    rank = F.expr("row_number() OVER (PARTITION BY item_id ORDER BY sort_key DESC, original_rank)")
    best = out.withColumn("sort_key", key).withColumn("rank", rank).drop("sort_key", "hits", "bonus").withColumnRenamed("item_id", "texts")
    return items.select("item_id", *have).select("item_id", texts).join(best, "texts").drop("texts")


def compare(original: DataFrame, enhanced: DataFrame) -> DataFrame:
    """Best of both classifiers side by side."""
    o = original.filter("rank = 1").select("item_id", F.col("category").alias("original_category"), F.col("confidence").alias("original_confidence"))
    e = enhanced.filter("rank = 1").select("item_id", F.col("category").alias("enhanced_category"), F.col("confidence").alias("enhanced_confidence"),
                                           (F.size("materials") > 0).alias("detected"))
    return o.join(e, "item_id").withColumn("improvement", F.round(F.col("enhanced_confidence") - F.col("original_confidence"), 1))


# Keyword and pattern rules


def item_text(spec_first: bool = False) -> Column:
    parts = ["spec", "name"] if spec_first else ["name", "spec", "manufacturer"]
    return F.trim(F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in parts])))


def keyword_hits(items: DataFrame, rules: DataFrame, text: Column | None = None) -> DataFrame:
    """(text, rule columns...) for every rule keyword inside a distinct item text; ``rules`` has key and more."""
    texts = items.select((item_text() if text is None else text).alias("text")).distinct().select(F.md5("text").alias("text_id"), "text")
    low = rules.withColumn("low_key", F.lower("key"))
    found = containment(texts, low.select(F.col("low_key").alias("key"))).join(texts, "text_id")
    return found.select("text", F.col("key").alias("low_key")).join(low, "low_key").drop("low_key")


def _back(items: DataFrame, per_text: DataFrame, text: Column | None = None) -> DataFrame:
    return items.select("item_id", (item_text() if text is None else text).alias("text")).join(per_text, "text").drop("text")


def _top(df: DataFrame, n: int, by: str = "item_id") -> DataFrame:
    rank = F.expr(f"row_number() OVER (PARTITION BY {by} ORDER BY confidence DESC, place, category)")
    return df.withColumn("rank", rank).filter(F.col("rank") <= n)


def trained_keywords(items: DataFrame, rules: DataFrame) -> DataFrame:
    """Trained rules (category, key, rule_confidence): 0.25 times the rule's confidence per hit, at most 1."""
    per = keyword_hits(items, rules).groupBy("text", "category").agg(
        F.round(F.least(F.sum(F.col("rule_confidence") * R.TRAINED_HIT), F.lit(R.TRAINED_CAP)), 9).alias("confidence"))
    return _back(items, per.withColumns({"source": F.lit("db_trained_keywords"), "place": F.lit(0)}))


def mapped_keywords(items: DataFrame, lexicon: DataFrame, hit: float, cap: float, source: str, place: int) -> DataFrame:
    """Lexicon (category, key): a fixed gain per keyword inside the text, capped."""
    per = keyword_hits(items, lexicon).groupBy("text", "category").agg(F.round(F.least(F.count("*") * hit, F.lit(cap)), 9).alias("confidence"))
    return _back(items, per.withColumns({"source": F.lit(source), "place": F.lit(place)}))


def medical_priority(items: DataFrame, categories: DataFrame) -> DataFrame:
    """The first medical category that exists, for texts with a priority word."""
    order = F.array(*[F.lit(c) for c in R.PRIORITY_CATEGORIES])
    first = categories.filter(F.col("category").isin(R.PRIORITY_CATEGORIES)).agg(F.min_by("category", F.array_position(order, F.col("category"))).alias("category"))
    hit = items.filter(contains_any(item_text(), R.PRIORITY_WORDS)).select("item_id")
    return hit.crossJoin(F.broadcast(first)).filter("category IS NOT NULL").select(
        "item_id", "category", F.lit(R.PRIORITY_CONFIDENCE).alias("confidence"), F.lit("medical_keyword_priority").alias("source"), F.lit(1).alias("place"))


def keyword_recommendation(items: DataFrame, trained: DataFrame, lexicon: DataFrame, categories: DataFrame) -> DataFrame:
    known = categories.select("category").distinct()
    parts = [trained_keywords(items, trained), medical_priority(items, categories),
             mapped_keywords(items, lexicon.join(known, "category", "left_semi"), R.MAP_HIT, R.MAP_CAP, "keyword_matching", 2)]
    return _top(reduce(lambda a, b: a.unionByName(b), parts), R.MAP_TOP)


def wide_keywords(items: DataFrame, lexicon: DataFrame) -> DataFrame:
    return _top(mapped_keywords(items, lexicon, R.WIDE_HIT, R.WIDE_CAP, "enhanced_matching", 0), R.WIDE_TOP)


def spec_patterns(items: DataFrame) -> DataFrame:
    """Spec keywords, then the regex families, in rule order; the first three count. Each distinct (spec, name) is read once, however many items have it."""
    keys = [F.coalesce("spec", F.lit("")).alias("spec"), F.coalesce("name", F.lit("")).alias("name")]
    text, spec = item_text(spec_first=True), F.coalesce("spec", F.lit(""))
    rec = lambda c, conf, source: F.struct(F.lit(c).alias("category"), conf.alias("confidence"), F.lit(source).alias("source"))
    out = []
    for cat, words in TR.SPEC_RULES.items():
        n = sum((F.when(F.contains(text, F.lit(w.lower())), 1).otherwise(0) for w in words), F.lit(0))
        out.append(F.when(n > 0, rec(cat, F.least(n * R.SPEC_HIT, F.lit(R.SPEC_CAP)), "trained_spec_pattern")))
    for _, pattern, cats in R.SPEC_FAMILIES:
        out += [F.when(spec.rlike("(?i)" + pattern), rec(c, F.lit(R.SPEC_PATTERN), "spec_pattern")) for c in cats]
    first = F.slice(F.array_compact(F.array(*out)), 1, 3)
    found = stored(items.select(*keys).distinct().select("spec", "name", first.alias("found")), "spec_patterns").filter(F.size("found") > 0)
    got = items.select("item_id", *keys).join(found, ["spec", "name"]).select("item_id", F.posexplode("found").alias("place", "r"))
    return got.select("item_id", "r.category", F.round("r.confidence", 9).alias("confidence"), "r.source", "place", (F.col("place") + 1).alias("rank"))


def maker_recommendation(items: DataFrame, mapping: DataFrame, history: DataFrame) -> DataFrame:
    """Mapping (maker, category) where either maker contains the other: 0.75; else the maker's two most used categories: 0.4.

    Makers are compared as distinct names, by containment joins in both directions.
    """
    mine = items.filter(F.coalesce("manufacturer", F.lit("")) != "").select("item_id", F.col("manufacturer").alias("m"))
    names, known = mine.select("m").distinct(), mapping.filter("maker <> ''").select("maker").distinct()
    a = containment(names.select(F.col("m").alias("text_id"), F.col("m").alias("text")), known.select(F.col("maker").alias("key")))
    b = containment(known.select(F.col("maker").alias("text_id"), F.col("maker").alias("text")), names.select(F.col("m").alias("key")))
    pairs = a.select(F.col("text_id").alias("m"), F.col("key").alias("maker")).unionByName(b.select(F.col("key").alias("m"), F.col("text_id").alias("maker"))).distinct()
    hit = pairs.join(mapping, "maker")
    rank = F.expr("row_number() OVER (PARTITION BY m ORDER BY maker, category)")
    ruled = hit.withColumn("rank", rank).filter("rank <= 3").select("m", "category", F.lit(R.MAKER_RULE).alias("confidence"), F.lit("trained_manufacturer").alias("source"), "rank")
    used = history.filter("manufacturer <> ''").groupBy(F.col("manufacturer").alias("m"), "category").agg(F.count("*").alias("n"))
    often = F.expr("row_number() OVER (PARTITION BY m ORDER BY n DESC, category)")
    past = used.join(ruled.select("m").distinct(), "m", "left_anti").withColumn("rank", often).filter("rank <= 2").select(
        "m", "category", F.lit(R.MAKER_HISTORY).alias("confidence"), F.lit("manufacturer_pattern").alias("source"), "rank")
    return mine.join(ruled.unionByName(past), "m").select("item_id", "category", "confidence", "source", F.col("rank").alias("place"), "rank")


# Merging and fusion


def merge_mean(items: DataFrame, lists: list[DataFrame], top: int = 5) -> DataFrame:
    """Lists merged by category: mean confidence, sources in list order; items without any get the default."""
    every = reduce(lambda a, b: a.unionByName(b), [
        x.select("item_id", "category", "confidence", "source", (F.lit(i * 100) + F.col("rank")).alias("place")) for i, x in enumerate(lists)])
    merged = every.groupBy("item_id", "category").agg(
        F.round(F.avg("confidence"), 9).alias("confidence"), F.min("place").alias("place"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "source"))), lambda x: x["source"]), ", ").alias("source"))
    best = _top(merged, top).select("item_id", "category", "confidence", "source", "rank")
    default = items.select("item_id").join(best, "item_id", "left_anti").select(
        "item_id", F.lit(R.UNCLASSIFIED).alias("category"), F.lit(R.UNCLASSIFIED_CONFIDENCE).alias("confidence"), F.lit("fallback").alias("source"), F.lit(1).alias("rank"))
    return best.unionByName(default)


def merge_max(every: DataFrame, top: int = 10) -> DataFrame:
    """Highest confidence per category, sorted."""
    best = every.filter("category IS NOT NULL").groupBy("item_id", "category").agg(
        F.max_by(F.struct("confidence", "source"), F.struct("confidence", -F.col("place"))).alias("b"), F.min("place").alias("place"))
    return _top(best.select("item_id", "category", "b.*", "place"), top)


def weighted_vote(results: DataFrame) -> DataFrame:
    """Ensemble vote over (item_id, category, confidence, classifier, place); the first category seen wins a tie."""
    table = F.create_map(*[F.lit(x) for kv in R.CLASSIFIER_WEIGHTS.items() for x in kv])
    weight = F.coalesce(table[F.col("classifier")], F.lit(R.OTHER_CLASSIFIER_WEIGHT))
    votes = results.groupBy("item_id", "category").agg(F.round(F.sum(F.col("confidence") * weight), 9).alias("score"), F.min("place").alias("place"))
    best = votes.groupBy("item_id").agg(F.max_by(F.struct("category", "score"), F.struct("score", -F.col("place"))).alias("b"))
    return best.select("item_id", F.col("b.category").alias("category"), F.least(F.col("b.score"), F.lit(1.0)).alias("confidence"))


def priority_cascade(items: DataFrame, results: DataFrame, accept: float = R.ACCEPT_AT) -> DataFrame:
    """First classifier by place whose confidence is high enough, else a failed result."""
    first = results.filter(F.col("confidence") >= accept).groupBy("item_id").agg(F.min_by(F.struct("category", "confidence", "classifier"), "place").alias("b"))
    return items.select("item_id").join(first, "item_id", "left").select(
        "item_id", F.coalesce("b.category", F.lit(R.FAILED)).alias("category"), F.coalesce("b.confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("b.classifier", F.lit("Unified")).alias("classifier"))


def highest_confidence(results: DataFrame) -> DataFrame:
    """The most confident classifier's category, with every classifier's answer."""
    detail = F.transform(F.array_sort(F.collect_list(F.struct("place", "classifier", "category", "confidence"))),
                         lambda x: F.struct(x["classifier"].alias("classifier"), x["category"].alias("category"), x["confidence"].alias("confidence")))
    return results.groupBy("item_id").agg(
        F.max_by("category", F.struct("confidence", -F.col("place"))).alias("category"), F.max("confidence").alias("confidence"), detail.alias("details"))


def batch_summary(classified: DataFrame) -> DataFrame:
    ok = F.col("category") != R.FAILED
    return classified.agg(F.count("*").alias("total"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"),
                          F.avg(F.when(ok, F.col("confidence"))).alias("average_confidence"))


def domain_recommendation(items: DataFrame, text: str, top: int = 5) -> DataFrame:
    """Categories from domain tags, brand words and units of the extracted parameters, distinct, best five."""
    t = F.col(text)
    rec = lambda c, conf: F.struct((c if isinstance(c, Column) else F.lit(c)).alias("category"), conf.alias("confidence"))
    branches = []
    for prefix, groups in (("医疗用品-", X.MEDICAL_TAGS), ("工业用品-", X.INDUSTRIAL_TAGS)):
        for tag, words in groups.items():
            n = sum((F.when(F.contains(t, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))
            branches.append(F.when(n > 0, rec(prefix + tag, F.round(F.lit(0.5) + F.least(F.lit(0.4), n * 0.1), 9))))
    out = items.select("item_id", text, *[c.alias(k) for k, c in parameter_families(t, {k: X.FAMILIES[k] for k in ("brand", "specification")}).items()])
    branches.append(F.when(F.exists("brand", lambda b: contains_any(b, R.BRAND_WORDS)), rec(R.DRUG_CATEGORY, F.lit(R.BRAND_CONFIDENCE))))
    drug = lambda s: contains_any(s, R.DRUG_UNITS)
    branches.append(F.when(F.exists("specification", drug), rec(R.DRUG_CATEGORY, F.lit(R.UNIT_CONFIDENCE))))
    branches.append(F.when(F.exists("specification", lambda s: ~drug(s) & contains_any(s, R.ELECTRIC_UNITS)), rec(R.ELECTRIC_CATEGORY, F.lit(R.UNIT_CONFIDENCE))))
    found = F.array_distinct(F.array_compact(F.array(*branches)))
    default = F.array(rec(R.UNCLASSIFIED, F.lit(R.UNCLASSIFIED_CONFIDENCE)))
    ordered = F.transform(F.array_sort(F.transform(found, lambda r: F.struct((-r["confidence"]).alias("n"), r["category"].alias("category")))),
                          lambda r: F.struct(r["category"].alias("category"), (-r["n"]).alias("confidence")))
    best = out.select("item_id", ordered.alias("found")).select(
        "item_id", F.posexplode(F.when(F.size("found") > 0, F.slice("found", 1, top)).otherwise(default)).alias("place", "r"))
    return best.select("item_id", "r.category", "r.confidence", (F.col("place") + 1).alias("rank"))


# Lexicon from category names


def lexicon(categories: DataFrame) -> DataFrame:
    """(category, key): the name itself and the keywords of every trigger group it meets, distinct."""
    low = F.lower("category")
    none = F.array().cast("array<string>")
    extra = [F.when(contains_any(low, ts), F.array(*[F.lit(k) for k in ks])).otherwise(none) for ts, ks in R.TRIGGERS]
    return categories.select("category", F.explode(F.array_distinct(F.concat(F.array("category"), *extra))).alias("key"))


def lexicon_scores(items: DataFrame, lex: DataFrame) -> DataFrame:
    """0.95 for the name inside the text and 0.7/len for each keyword; over 0.1 kept, at most 1."""
    sized = lex.join(lex.groupBy("category").agg(F.count("*").alias("size")), "category")
    gain = R.LEXICON_KEYWORD / F.col("size") + F.when(F.col("key") == F.col("category"), R.LEXICON_EXACT).otherwise(0.0)
    per = keyword_hits(items, sized).groupBy("text", "category").agg(F.round(F.sum(gain), 9).alias("score")).filter(F.col("score") > R.LEXICON_KEEP)
    return _back(items, per).select("item_id", "category", F.least(F.col("score"), F.lit(1.0)).alias("confidence"))


def character_fallback(items: DataFrame, categories: DataFrame) -> DataFrame:
    """Shared distinct characters (two or more) with every level-1 name, as a share of the longer text; best three.

    Texts and names meet on pairs of characters they share, so a name with fewer than two in common is never formed.
    """
    chars = lambda c: F.array_sort(F.array_distinct(F.split(F.lower(c), "")))
    twos = F.flatten(F.transform("chars", lambda a: F.transform(F.filter("chars", lambda b: b > a), lambda b: F.concat(a, b))))
    texts = items.select(item_text().alias("text")).distinct().withColumn("chars", chars(F.col("text")))
    names = categories.filter("level = 1").select("category").distinct().withColumn("chars", chars(F.col("category")))
    left, right = texts.select(F.md5("text").alias("t"), F.explode(twos).alias("k")), names.select("category", F.explode(twos).alias("k"))
    met = left.join(right, "k").select("t", "category").distinct()
    pairs = met.join(texts.withColumn("t", F.md5("text")), "t").join(names.select("category", F.col("chars").alias("c_chars")), "category")
    scored = pairs.withColumn("shared", F.size(F.array_intersect("chars", "c_chars"))).filter(F.col("shared") >= R.FALLBACK_SHARED).withColumns({
        "confidence": F.round(F.col("shared") / F.greatest(F.length("text"), F.length("category")), 9), "place": F.lit(0)})
    return _back(items, _top(scored.select("text", "category", "confidence", "place"), R.FALLBACK_TOP, "text").drop("place"))


# Similar items as votes


def similar_votes(similar: DataFrame, recommended: DataFrame) -> DataFrame:
    """Standard categories of an item's ten most similar rows, unless recommended already.

    ``similar``: item_id, rank, similarity, standard_category; ``recommended``: item_id, category.
    """
    near = similar.filter(F.col("rank") <= R.VOTE_ITEMS).withColumnRenamed("standard_category", "category").filter("category <> ''")
    fresh = near.join(recommended.select("item_id", "category").distinct(), ["item_id", "category"], "left_anti")
    votes = fresh.groupBy("item_id", "category").agg(F.count("*").alias("n"), F.avg("similarity").alias("mean"))
    return votes.select("item_id", "category", "n", F.least(F.col("mean") * F.col("n") * R.VOTE_FACTOR, F.lit(R.VOTE_CAP)).alias("confidence"))


def hybrid(classified: DataFrame, votes: DataFrame) -> DataFrame:
    """Classifier categories first, then the votes, ranked within each source by confidence."""
    both = classified.select("item_id", "category", "confidence", F.lit("classifier").alias("source"), F.lit(0).alias("block")).unionByName(
        votes.select("item_id", "category", "confidence", F.lit("similar_items").alias("source"), F.lit(1).alias("block")))
    rank = F.expr("row_number() OVER (PARTITION BY item_id ORDER BY block, confidence DESC, category)")
    return both.withColumn("rank", rank).drop("block")


def reclassification_report(enhanced: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per item the best category and three suggestions; overall detection rate and mean confidence."""
    per = enhanced.filter("rank <= 3").groupBy("item_id").agg(
        F.min_by("category", "rank").alias("category"), F.min_by("confidence", "rank").cast("int").alias("confidence"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "category"))), lambda x: x["category"]).alias("suggestions"),
        F.max(F.size("materials") > 0).alias("detected"))
    full = items.select("item_id").join(per, "item_id", "left").withColumns({
        "category": F.coalesce("category", F.lit(R.UNCLASSIFIED)), "confidence": F.coalesce("confidence", F.lit(0)), "detected": F.coalesce("detected", F.lit(False))})
    total = full.agg(F.count("*").alias("total"), F.count_if("detected").alias("detected"), F.round(F.avg("confidence"), 1).alias("average_confidence"),
                     F.round(F.count_if("detected") / F.count("*") * 100, 1).alias("detection_rate"))
    return full, total


def manufacturing_levels(name: Column, spec: Column) -> Column:
    from partwise.rules import manufacturing as MF

    return REC.category_levels(F.concat_ws(" ", name, spec), MF.CATEGORIES, MF.LEVEL3)


def medical_levels(name: Column, device: Column, label: Column) -> Column:
    from partwise.rules import medical as MD

    return REC.category_levels(F.concat_ws(" ", name, device, label), MD.CATEGORIES, MD.LEVEL3)


# Classifier interface: DataFrame(item rows) -> (item_id, category, confidence, classifier, place)

CLASSIFIERS: dict = {}


def register_classifier(name: str, fn) -> None:
    CLASSIFIERS[name] = fn


def run_classifiers(items: DataFrame, names: list[str] | None = None, **tables) -> DataFrame:
    """Best answer of each registered classifier, in the given order."""
    out = None
    for place, name in enumerate(names or CLASSIFIERS):
        part = CLASSIFIERS[name](items, **tables).select("item_id", "category", "confidence", F.lit(name).alias("classifier"), F.lit(place).alias("place"))
        out = part if out is None else out.unionByName(part)
    return out


def _smart(items, categories, **_):
    return material_classify(items, categories).filter("rank = 1").withColumn("confidence", F.col("confidence") / 100)


def _lexical(items, categories, **_):
    return wide_keywords(items, lexicon(categories)).filter("rank = 1")


register_classifier("SmartClassifier", _smart)
register_classifier("IntelligentClassifier", _lexical)
