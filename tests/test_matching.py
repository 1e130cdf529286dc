"""Matching against brute force on small fixtures: two fields, blocking, copies, thresholds."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from partwise.functions import tfidf as V
from partwise.functions.text import SEGMENTS, tokens
from partwise.operators import matching as J

MASTER = [(i, f"steel {a} valve {b}", f"dn{10 * (i % 5)} pn16 {b}", "acme" if i % 3 else "zeta")
          for i, (a, b) in enumerate([("ball", "red"), ("gate", "blue"), ("ball", "blue"), ("check", "red"), ("plug", "")] * 6)]
NEW = [(100, "ball valve red", "dn10 pn16", "acme"), (101, "gate valve", "pn16", ""), (102, "copper pipe", "dn40", "zeta"), (103, "", "", ""),
       (104, "ball valve red", "dn10 pn16", "acme")]


def grams(text):
    w = re.findall(r"\w+", text.lower())
    return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])


def fit(texts):
    df = Counter(t for x in texts for t in set(grams(x)))
    n = len(texts)
    return {t: math.log((1 + n) / (1 + d)) + 1 for t, d in df.items()}


def vector(text, idf):
    v = {t: c * idf[t] for t, c in grams(text).items() if t in idf}
    norm = math.sqrt(sum(x * x for x in v.values()))
    return {t: x / norm for t, x in v.items()} if norm else {}


def brute(threshold, top):
    texts = {"name": [m[1] for m in MASTER], "spec": [m[2] for m in MASTER], "desc": [f"{m[1]} {m[2]}" for m in MASTER]}
    idf = {k: fit(v) for k, v in texts.items()}
    out = set()
    for n in NEW:
        scored = []
        for m in MASTER:
            if n[3] and n[3] != m[3]:
                continue
            parts = {"name": (n[1], m[1]), "spec": (n[2], m[2]), "desc": (f"{n[1]} {n[2]}", f"{m[1]} {m[2]}")}
            s = {k: sum(w * vector(b, idf[k]).get(t, 0) for t, w in vector(a, idf[k]).items()) for k, (a, b) in parts.items()}
            total = round((0.8 * s["name"] + 0.8 * s["spec"] + 0.6 * s["desc"]) / 2.2, 9)
            if total >= threshold:
                scored.append((-total, m[0]))
        out |= {(n[0], m, i + 1, round(-t, 6)) for i, (t, m) in enumerate(sorted(scored)[:top])}
    return out


def frames(spark):
    new = spark.createDataFrame(NEW, "id int, title string, detail string, maker string")
    master = spark.createDataFrame(MASTER, "code int, name string, spec string, mfr string")
    return new, master, J.MatchConfig("id", "code", [("title", "name"), ("detail", "spec")], [("maker", "mfr")])


def test_two_fields_with_blocking(spark):
    new, master, cfg = frames(spark)
    for threshold, top in ((0.3, 5), (0.6, 3)):
        got = {(r.new_id, r.master_id, r["rank"], round(r.similarity, 6)) for r in J.match(new, master, cfg, threshold, top).collect()}
        assert got == brute(threshold, top)


def test_details_hold_every_field(spark):
    new, master, cfg = frames(spark)
    row = J.match(new, master, cfg).withColumn("d", J.match_details(cfg)).first()
    assert set(row.d) == {"f0_similarity", "f1_similarity", "description_similarity"}


def test_baseline_fills_with_zero_scores(spark):
    new, master, _ = frames(spark)
    cfg = J.MatchConfig("id", "code", [("title", "name")], [("maker", "mfr")], describe=False)
    got = J.match_baseline(new, master, cfg, 3).groupBy("new_id").count().collect()
    assert {(r.new_id, r["count"]) for r in got} == {(n[0], 3) for n in NEW}


def test_match_lists_keep_unmatched_items(spark):
    new, master, cfg = frames(spark)
    lists = {r.id: len(r.matches) for r in J.match_lists(J.match(new, master, cfg), new, "id").collect()}
    assert lists[103] == 0 and lists[100] > 0


def test_segmented_text_finds_longer_chinese_names(spark):
    """Names that share characters but no whole run are similar once split into pairs of characters."""
    rows = spark.createDataFrame([(1, "不锈钢球阀"), (2, "304不锈钢球阀 DN25"), (3, "碳钢法兰 PN16"), (4, "阀")], "id long, text string")
    cfg = J.MatchConfig("new", "id", [("text", "text")], describe=False, vectoriser=V.SEGMENTED)
    found = {(r.new_id, r.master_id): r.similarity for r in J.match(rows.withColumnRenamed("id", "new"), rows, cfg, 0.05, 5).collect()}
    assert 0 < found[1, 2] < 1 and abs(found[1, 1] - 1) < 1e-9
    assert (1, 3) not in found and not any(4 in k for k in found)
    words = rows.select("id", tokens(F.col("text"), SEGMENTS, 1).alias("w")).collect()
    assert {r.id: r.w for r in words} == {1: ["不锈", "锈钢", "钢球", "球阀"], 2: ["304", "不锈", "锈钢", "钢球", "球阀", "dn25"], 3: ["碳钢", "钢法", "法兰", "pn16"], 4: []}


def test_hot_terms_are_dealt_over_tasks(spark, monkeypatch):
    """Lists of one row per task give the same matches as whole lists."""
    rows = spark.createDataFrame([(i, f"valve steel {'ball' if i % 2 else 'gate'} {i % 7}") for i in range(60)], "id long, text string")
    cfg = J.MatchConfig("new", "id", [("text", "text")], describe=False)
    new = rows.filter("id < 9").withColumnRenamed("id", "new")
    want = sorted(map(tuple, J.match(new, rows, cfg, 0.3, 60).collect()))
    monkeypatch.setattr(J.block_pairs, "__defaults__", (3,))
    assert sorted(map(tuple, J.match(new, rows, cfg, 0.3, 60).collect())) == want


def test_frequent_terms_are_those_of_the_whole_vocabulary_without_counting_all_runs(spark, monkeypatch):
    rows = spark.createDataFrame([(i, " ".join(["a b c"] * (i % 4) + ["b c d", f"x{i} y{i % 3} a"])) for i in range(40)] + [(99, None), (100, "")], "id int, text string").repartition(3)
    vec = {"one": V.Vectoriser(V.WORD, 2, 7), "two": V.Vectoriser(V.WORD, 3, 12), "all": V.Vectoriser(V.WORD, 3, 1000), "long": V.Vectoriser(V.WORD2, 2, 5)}
    counts = V.term_counts(V.profiles(rows, {f: F.col("text") for f in vec}), vec)
    want = {(r.field, r.term, r.df, round(r.idf, 9)) for r in V.vocabulary(counts, rows, vec).collect()}
    # The whole vocabulary counts every run; the pruned one may not.
    monkeypatch.setattr(V, "term_counts", None)
    assert {(r.field, r.term, r.df, round(r.idf, 9)) for r in V.frequent_terms(rows, "text", vec).collect()} == want


def test_capped_weights_count_only_in_the_tasks(spark):
    rows = spark.createDataFrame([(i, " ".join(["a b c"] * (i % 4) + ["b c d", f"x{i} y{i % 3} a"])) for i in range(30)] + [(30, None), (31, ""), (31, "a b a b"), (32, "zz")], "id int, text string").repartition(3)
    v = V.Vectoriser(V.WORD, 2, 9)
    counts = V.term_counts(V.profiles(rows, {"text": F.col("text")}), {"text": v})
    want = V.vectors(counts, V.vocabulary(counts, rows, {"text": v}))
    members = rows.select("id", V.profile_key([F.col("text")]).alias("pk"))
    got = V.capped_weights(rows, "id", "text", v)
    key = lambda df: sorted((r.id, r.term, round(r.w, 9)) for r in df.collect())
    assert key(got) == key(members.join(want, "pk"))
    assert "Exchange" not in got.select("id", "term", "w")._jdf.queryExecution().executedPlan().toString().replace("Exchange RoundRobin", "")


def test_capped_match_with_few_new_texts_needs_no_join_of_terms(spark, monkeypatch):
    new = spark.createDataFrame([(1, "red valve dn50"), (2, "red valve dn50"), (3, ""), (4, None), (5, "blue pump nothing else")], "n int, t string")
    master = spark.createDataFrame([(i, f"red valve dn{i % 7 * 10} pn16") for i in range(40)] + [(90, "blue pump"), (91, "blue pump"), (92, None), (92, "pump blue"), (93, "qq")], "m int, t string").repartition(4)
    cfg = J.MatchConfig("n", "m", [("t", "t")], vectoriser=V.Vectoriser(V.WORD, 2, 30))
    key = lambda df: sorted((r.new_id, r.master_id, r["rank"], round(r.s_f0, 9), round(r.s_description, 9), round(r.similarity, 9)) for r in df.collect())
    with monkeypatch.context() as m:
        m.setattr(J, "BROADCAST_CELLS", 0)
        want = key(J.match(new, master, cfg, 0.3, 4))
    monkeypatch.setattr(J, "Matcher", None)
    assert want and key(J.match(new, master, cfg, 0.3, 4)) == want


def test_few_new_texts_find_their_best_rows_by_bounds(spark, monkeypatch):
    """The same pairs and scores as over the whole master's postings, with ties, copies, empty and null texts, and words seldom enough to be outside the table."""
    from partwise.operators import reach

    words = [f"w{i % 11}x" for i in range(97)] + [f"rare{i}" for i in range(60)]
    text = lambda i: " ".join(words[(i * j * 7 + j) % len(words)] for j in range(1, 5 + i % 9))
    master = spark.createDataFrame([(i, text(i % 150)) for i in range(200)] + [(900, None), (901, ""), (901, text(3)), (902, "w0x")], "m long, t string").repartition(5)
    new = spark.createDataFrame([(i, text(i * 13)) for i in range(12)] + [(20, text(13)), (50, None), (51, "unknown words"), (52, "w1x w1x rare3")], "n long, t string")
    key = lambda df: sorted(tuple(round(x, 7) if isinstance(x, float) else x for x in r) for r in df.collect())
    monkeypatch.setattr(reach, "FREQUENT_WORDS", 6)
    monkeypatch.setattr(reach, "ROWS", 7)
    monkeypatch.setattr(reach, "CELLS", 256)
    monkeypatch.setattr(reach, "CHUNK", 16)

    def results():
        config = lambda v, describe: J.MatchConfig("n", "m", [("t", "t")], describe=describe, vectoriser=v)
        yield key(J.match(new, master, config(V.FIELD_MATCH, True), 0.3, 4))
        yield key(J.match_baseline(new, master, config(V.BASELINE, False), 3))
        yield key(J.recommend_threshold(new, master, config(V.SIMILAR, False), 6))

    with monkeypatch.context() as m:
        m.setattr(J, "reachable", lambda *a: None)
        want = list(results())
    # Neither postings nor the vocabulary of the whole master are made.
    monkeypatch.setattr(V, "vocabulary", None)
    monkeypatch.setattr(V, "postings", None)
    assert all(want) and list(results()) == want
    monkeypatch.setattr(reach, "WANTED", 0)
    assert next(results()) == want[0]


def test_keys_are_made_once_for_each_distinct_text(spark, monkeypatch):
    """Copies of a specification or maker add rows, not keys; blank, null and key-less texts match nothing."""
    kept, stored = {}, J.stored
    monkeypatch.setattr(J, "stored", lambda df, label: kept.setdefault(label, stored(df, label)))
    src = spark.createDataFrame([(i, ["DN50 PN16", "dn 50 pn16", "", None, "plain"][i % 5]) for i in range(50)], "s long, a string")
    tgt = spark.createDataFrame([(i, ["DN50 PN16 L=2m", None, "DN50 PN16", "x"][i % 4]) for i in range(40)], "t long, b string")
    got = {r.source_id: (r.target_id, r.confidence) for r in J.spec_match(src, tgt, "s", "t", "a", "b").collect()}
    assert set(got) == {i for i in range(50) if i % 5 < 2} and set(got.values()) == {(2, 1.0)}
    assert kept["source_keys"].count() == 5 and kept["target_keys"].count() == 4
