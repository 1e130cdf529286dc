"""Duplicate detection against brute force over rows, with a hot group of copies and blank fields."""

import random
from difflib import SequenceMatcher
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from partwise.functions.text import maker_fingerprint
from partwise.operators import dedup as D
from partwise.rules import dedup as R
from tests.test_matching import fit, vector

ROWS = [
    ("ball valve", "dn100 pn16", "Shanghai Valve Co", "valve", "pcs", {"a": "1"}),
    ("ball valve", "dn100 pn16", "Shanghai Valve Ltd", "valve", "个", {"a": "1"}),
    ("ball valve 304", "dn100 pn16", "Shanghai Valves", "Valve", "件", {"a": "2", "b": "x"}),
    ("copper pipe", "25x2mm", "Tianjin Copper", "pipe", "米", {"a": "1"}),
    ("", "", "", "", "", {}),
    ("", "", "", "", "", {}),
] + [("steel bolt", "m8x40", "Bolt Works", "bolt", "kg", {"a": "9"})] * 7


def dup_frame(spark):
    rows = [(i, *r, ["ERP", "PLM"][i % 2]) for i, r in enumerate(ROWS)]
    return spark.createDataFrame(rows, "code int, name string, spec string, manufacturer string, type string, unit string, attributes map<string,string>, source string")


def trigrams(text):
    import re
    from collections import Counter

    w = re.findall(r"\w+", text.lower())
    return Counter(w + [" ".join(x) for x in zip(w, w[1:])] + [" ".join(x) for x in zip(w, w[1:], w[2:])])


@pytest.fixture(scope="module")
def brute(spark):
    import tests.test_matching as m

    fps = [r[0] for r in dup_frame(spark).orderBy("code").select(maker_fingerprint(F.col("manufacturer"))).collect()]
    specs = [r[1] for r in ROWS]
    spec_idf = fit(specs)
    bi = m.grams
    m.grams = trigrams
    name_idf = fit([r[0] for r in ROWS])
    name_vec = [vector(r[0], name_idf) for r in ROWS]
    m.grams = bi
    spec_vec = [vector(s, spec_idf) for s in specs]
    canon = {v: k for k, vs in R.UNITS.items() for v in vs}

    def sim(i, j):
        x, y = ROWS[i], ROWS[j]
        dot = lambda a, b: sum(w * b.get(t, 0) for t, w in a.items())
        mk = 0.0 if not fps[i] or not fps[j] else SequenceMatcher(None, fps[i], fps[j]).ratio()
        eq = lambda a, b: float(a != "" and a == b)
        common = set(x[5]) & set(y[5])
        at = sum(x[5][k] == y[5][k] for k in common) / len(common) if common else 0.0
        return (.35 * dot(name_vec[i], name_vec[j]) + .25 * dot(spec_vec[i], spec_vec[j]) + .15 * mk + .1 * eq(x[3].lower(), y[3].lower())
                + .05 * eq(canon.get(x[4], x[4]), canon.get(y[4], y[4])) + .1 * at)

    sims = {(i, j): sim(i, j) for i, j in combinations(range(len(ROWS)), 2)}
    label = list(range(len(ROWS)))
    for (i, j), s in sims.items():
        if round(s, 9) >= 0.65:
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    groups = {}
    for i, x in enumerate(label):
        groups.setdefault(x, []).append(i)
    groups = {k: v for k, v in groups.items() if len(v) > 1}
    return {k: (v, sum(sims[p] for p in combinations(v, 2)) / (len(v) * (len(v) - 1) / 2)) for k, v in groups.items()}


def test_groups_and_means(spark, brute):
    dup = D.Duplicates(dup_frame(spark))
    groups = D.cut_lineage(dup.groups(dup.pairs()))
    members = {}
    for r in D.member_rows(dup, groups).collect():
        members.setdefault(r.master, []).append(r.code)
    assert {k: sorted(v) for k, v in members.items()} == {k: v for k, (v, _) in brute.items()}
    scores = {r.master: r.similarity for r in dup.group_scores(groups).collect()}
    assert scores == pytest.approx({k: m for k, (_, m) in brute.items()}, abs=1e-6)
    assert 4 not in scores  # blank rows never group


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a int, b int")
    got = {r.v: r.label for r in D.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_components_of_random_graphs_and_hubs(spark):
    """Against union-find; one hub is the smallest node of its star, the other its largest."""
    rng = random.Random(3)
    edges = [(rng.randrange(600), rng.randrange(600)) for _ in range(420)] + [(None, 5), (6, None)]
    parent = list(range(600))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    linked = {x for a, b in edges if a is not None and b is not None and a != b for x in (a, b)}
    df = spark.createDataFrame(edges, "a long, b long")
    stars = spark.range(1, 1_000_000).select(F.when(F.col("id") < 900_000, 1000).otherwise(10_000_000).alias("a"), (F.col("id") + 1000).alias("b"))
    got = D.components(df.unionByName(stars))
    assert {r.v: r.label for r in got.filter("v < 600").collect()} == {x: root(x) for x in linked}
    big = {(r.label, r.n) for r in got.filter("v >= 600").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert big == {(1000, 900_000), (901_000, 100_001)}


def test_containment_by_rarest_piece(spark):
    """Keys of any length, also where all pieces of a key occur but not the key."""
    texts = ["abcabc", "xbcx", "a", "", "longer text with abc inside", "bcab"]
    keys = ["abc", "bc", "a", "missing", "longer text", "abcab", "bcabc", "cabx", "xbcxx", " "]
    t = spark.createDataFrame(list(enumerate(texts)), "text_id int, text string")
    k = spark.createDataFrame([(x,) for x in keys], "key string")
    want = {(i, key) for i, x in enumerate(texts) for key in keys if key in x}
    assert {tuple(r) for r in D.containment(t, k).collect()} == want
