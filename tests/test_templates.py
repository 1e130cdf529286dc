"""Rules as rows: each source is judged by the rules of its own industry, and similarity results take part."""

from partwise.operators import templates as C

FIELDS = ["material_name", "specification", "category", "manufacturer"]


def test_rules_follow_the_source(spark):
    rows = [("a", 1, "球阀 DN25", "DN25 PN16", "", "x"), ("a", 2, "", "", "", ""), ("b", 3, "球阀", "5mg/ml", "", ""), ("c", 4, "anything", None, None, None)]
    items = spark.createDataFrame(rows, "source_id string, item_id long, material_name string, specification string, category string, manufacturer string")
    industries = spark.createDataFrame([("a", "manufacturing"), ("b", "medical"), ("c", "generic")], "source_id string, industry string")
    rules = C.industry_rules(spark).withColumn("threshold", C.F.when(C.F.col("rule_type") == "keyword", 0.2).otherwise(C.F.col("threshold")))
    of = C.source_rules(items, industries, rules, FIELDS)
    similar = spark.createDataFrame([(1, "fuzzy_string", 0.9), (1, "fuzzy_string", 0.85), (3, "fuzzy_string", 0.7), (4, "tfidf_cosine", 0.6)], "item_id long, method string, score double")
    got = {(r.item_id, r.rule_id): round(r.score, 6) for r in C.apply_source_rules(items, of, FIELDS, similar).collect()}
    plain = {k: v for k, v in got.items() if not k[1].startswith("c:")}
    # A ball valve is a keyword for the parts source only; concentration is a pattern for the medical one only.
    assert plain == {(1, "k0"): 0.2, (1, "p0"): 1.0, (1, "s1"): 0.9, (3, "p0"): round(1 / 3, 6), (4, "s0"): 0.6}
    assert {k[1] for k in got if k[0] == 3 and k[1].startswith("c:")} == {"c:material_name,specification"}
    voted = C.vote(items, C.apply_source_rules(items, of, FIELDS, similar))
    runs = {r.source_id: (r.industry, r.total, r.failed, r.unmatched) for r in C.source_summaries(items, voted, industries, FIELDS).collect()}
    assert runs == {"a": ("manufacturing", 2, 1, 1), "b": ("medical", 1, 0, 0), "c": ("generic", 1, 0, 0)}
