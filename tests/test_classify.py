"""Classifier rules on labelled names, and candidate categories against scoring every pair."""

import pytest
from pyspark.sql import functions as F

from partwise.functions import grades as G
from partwise.functions import records as REC
from partwise.operators import classify as C
from partwise.operators import quality as Q
from partwise.rules import classification as R
from partwise.rules import training as TR

LABELLED = [
    ("304不锈钢疏水器", {"304"}), ("316L不锈钢法兰", {"316L"}), ("321不锈钢三通", {"321"}), ("碳钢螺塞", {"碳钢"}), ("20#钢管道", {"20#"}), ("Q235法兰", {"Q235"}),
    ("黄铜球阀", {"黄铜"}), ("紫铜管接头", {"紫铜"}), ("镀锌管接头", {"镀锌"}), ("镀镍螺栓", {"镀镍"}), ("304不锈钢镀锌法兰", {"304", "镀锌"}), ("疏水器", set()), ("球阀", set()),
]


def test_labelled_grades(spark):
    df = spark.createDataFrame([(n,) for n, _ in LABELLED], "name string")
    found = {r.name: set(r.b) for r in df.select("name", F.transform(G.grade_hits("name"), lambda h: h["base"]).alias("b")).collect()}
    for name, bases in LABELLED:
        assert bases <= found[name], name
    assert found["疏水器"] == found["球阀"] == set()


def test_core_concept(spark):
    df = spark.createDataFrame([("304不锈钢 疏水器",), ("Q235 法兰",), ("球阀",)], "name string").withColumn("hits", G.grade_hits("name"))
    got = {r.name: r.c for r in df.select("name", G.core_concept(F.col("name"), F.col("hits")).alias("c")).collect()}
    assert got == {"304不锈钢 疏水器": "疏水器", "Q235 法兰": "法兰", "球阀": "球阀"}


ITEMS = [(1, "304不锈钢疏水器", "DN25 CL150 CS", "个"), (2, "法兰", "DN200 1.0MPa", "件"), (3, "hex bolt", "M8", "kg"), (4, "泵 seal kit", "", ""), (5, "未知物", "", "台"),
         (6, "金属软管", "DN25 PN2.0", "根"), (7, "category 17 part", "category 40", "")]
CATEGORIES = [(c, 2, "") for c in ["疏水阀", "法兰", "紧固件", "管道配件", "机械密封及配件", "工业泵配件", "球阀", "金属软管", "疏水器"]] + [
    (f"category {chr(97 + i % 26)}{i}", 1 + i % 3, f"kit {i}") for i in range(60)]


@pytest.mark.parametrize("top", [5, 60])
def test_candidates_equal_all_pairs(spark, monkeypatch, top):
    """The pool and the found candidates give what scoring every category gives, also for long lists."""
    items = spark.createDataFrame(ITEMS, "item_id int, name string, spec string, unit string")
    cats = spark.createDataFrame(CATEGORIES, "category string, level int, description string")
    rows = lambda: sorted((r.item_id, r["rank"], r.category, r.confidence) for r in C.rule_classify(items, cats, top).collect())
    narrowed = rows()
    assert max(r[1] for r in narrowed) == top
    monkeypatch.setattr(C, "_pool", lambda cats, top: cats)
    assert narrowed == rows()


def test_material_bonus_and_resort(spark):
    items = spark.createDataFrame(ITEMS, "item_id int, name string, spec string, unit string")
    cats = spark.createDataFrame(CATEGORIES, "category string, level int, description string")
    best = {r.item_id: r for r in C.material_classify(items, cats).filter("rank = 1").collect()}
    assert (best[1].category, best[1].material_bonus, best[1].confidence) == ("疏水器", 20.0, 100.0)  # grades A and B+
    assert best[2].category == "法兰" and best[2].materials == []


def test_weighted_vote_and_cascade(spark):
    res = spark.createDataFrame([(1, "a", .5, "SmartClassifier", 1), (1, "b", .9, "AdvancedMatcher", 2), (1, "a", .4, "IntelligentClassifier", 0), (2, "c", .3, "x", 0)],
                                "item_id int, category string, confidence double, classifier string, place int")
    vote = {r.item_id: (r.category, round(r.confidence, 6)) for r in C.weighted_vote(res).collect()}
    assert vote == {1: ("a", 0.44), 2: ("c", 0.06)}
    items = spark.createDataFrame([(1,), (2,)], "item_id int")
    cascade = {r.item_id: (r.category, r.confidence) for r in C.priority_cascade(items, res).collect()}
    assert cascade == {1: ("b", 0.9), 2: (R.FAILED, 0.0)}


def test_regulatory_class_keeps_all_three(spark):
    df = spark.createDataFrame([("I类",), ("II类",), ("III类",), ("非处方药",)], "c string")
    got = [r[0] for r in df.select(REC.class_level(REC.regulatory_class(REC.record({"分类": F.col("c")}), F.lit("")))).collect()]
    assert got == [1, 2, 3, 5]


def test_quality_of_a_full_record(spark):
    row = {"material_name": "不锈钢球阀", "specification": "DN100 PN16", "manufacturer": "上海阀门厂", "unit": "个", "material_type": "阀门",
           "source_system": "ERP", "last_updated": "2024-09-20 00:00:00"}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))
    got = Q.assess(df, F.expr("timestamp_ntz'2024-10-01'")).first()
    assert (got.completeness, got.accuracy, got.consistency, got.richness, got.reliability) == pytest.approx((85, 90, 60, 16, 70))
    assert got.quality_grade == "C" and got.overall_score == pytest.approx(68.65)


def test_spec_patterns_read_each_distinct_text_once(spark, monkeypatch):
    kept, stored = {}, C.stored
    monkeypatch.setattr(C, "stored", lambda df, label: kept.setdefault(label, stored(df, label)))
    word = next(iter(TR.SPEC_RULES.values()))[0]
    items = spark.createDataFrame([(i, ["zz", None, "zz"][i % 3], [word, word, None][i % 3]) for i in range(30)], "item_id long, name string, spec string")
    got = C.spec_patterns(items).groupBy("item_id").count().collect()
    assert {r.item_id for r in got} == {i for i in range(30) if i % 3 < 2}
    assert kept["spec_patterns"].count() == 3
