"""Copies of rows: the costly steps read each distinct text once, and all copies get its answer."""

from pyspark.sql import functions as F

from partwise.operators import classify as C

ITEMS = [("304不锈钢疏水器", "DN20 PN16", "个"), ("304不锈钢疏水器", "", "台"), ("黄铜球阀", "DN50", None), (None, "M8", "个"), ("", "M8", "个")]
CATEGORIES = [("疏水阀", 2, ""), ("球阀", 2, ""), ("法兰", 2, ""), ("紧固件", 1, "")]


def counted(monkeypatch, module):
    """Rows of every table that the module writes, by label."""
    rows, store = {}, module.stored

    def keep(df, label):
        out = store(df, label)
        rows.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(module, "stored", keep)
    return rows


def test_material_classifier_reads_a_name_once(spark, monkeypatch):
    rows = counted(monkeypatch, C)
    items = spark.createDataFrame([(i * 100 + k, *x) for k in range(20) for i, x in enumerate(ITEMS)], "item_id long, name string, spec string, unit string")
    cats = spark.createDataFrame(CATEGORIES, "category string, level int, description string")
    got = C.material_classify(items, cats).select(F.expr("item_id div 100").alias("i"), F.expr("item_id % 100").alias("k"), "category", "confidence", "material_bonus", "rank").collect()
    assert rows["grades"] == [3, 3]  # null and empty are one name
    assert rows["texts"] == [4]
    of = {}
    for r in got:
        of.setdefault((r.i, r.k), []).append((r.rank, r.category, r.confidence, r.material_bonus))
    assert {i for i, _ in of} >= {0, 1, 2}
    assert all(sorted(v) == sorted(of[i, 0]) for (i, _), v in of.items()) and len(of) % 20 == 0
    best = {i: sorted(of[i, 0])[0] for i in (0, 2)}
    assert best[0][1] == "疏水阀" and best[2][1] == "球阀"


def test_sources_are_voted_once_for_each_text(spark, monkeypatch):
    from partwise.operators import templates as T

    rows = counted(monkeypatch, T)
    fields = ["material_name", "specification", "category", "manufacturer"]
    texts = [("a", "球阀 DN25", "DN25 PN16", "", "x"), ("a", "", "", "", ""), ("a", None, "", "", ""), ("b", "球阀", "5mg/ml", "", "")]
    items = spark.createDataFrame([(s, i * 100 + k, *x) for k in range(10) for i, (s, *x) in enumerate(texts)], "source_id string, item_id long, material_name string, specification string, category string, manufacturer string")
    industries = spark.createDataFrame([("a", "manufacturing"), ("b", "medical")], "source_id string, industry string")
    rules = T.source_rules(items, industries, T.industry_rules(spark), fields)
    similar = spark.createDataFrame([(1, "fuzzy_string", 0.9), (1, "fuzzy_string", 0.95), (301, "fuzzy_string", 0.9)], "item_id long, method string, score double")
    show = lambda df: sorted((r.item_id, r.level1, r.level2, round(r.confidence, 9), r.rules_matched) for r in df.collect())
    got = show(T.vote_by_source(items, rules, fields, similar))
    assert rows["texts"] == [5]  # null and empty are one text; items 1 and 301 differ from their copies in what was found for them
    assert got == show(T.vote(items, T.apply_source_rules(items, rules, fields, similar))) and len(got) == 40


def test_catalog_is_written_distinct(spark, monkeypatch):
    from partwise.operators import dedup as J

    rows = counted(monkeypatch, J)
    catalog = spark.createDataFrame([(i, "steel bolt", "", "a" if i % 2 else "b") for i in range(20)] + [(20, "ring", "", "a")], "id long, name string, spec string, category string")
    decided = spark.createDataFrame([(1, 0.7, "manual_review"), (2, 0.7, "manual_review")], "master long, similarity double, action string")
    keys = spark.createDataFrame([(1, "bolt", ""), (2, "ring", "")], "master long, name string, spec string")
    got = {r.master: (r.existing_categories, r.action) for r in J.enrich_groups(decided, keys, catalog).collect()}
    assert rows["catalog"] == [3, 0]
    assert got == {1: (["a", "b"], "manual_review"), 2: (["a"], "merge_with_existing")}
