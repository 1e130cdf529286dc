"""Language, toxicity and quality: held-out accuracy, and a defined result for every awkward row."""

import numpy as np
import pytest

from partwise.llm import language, quality, queries, toxicity
from tests.llm.cases import AWKWARD, awkward, documents, empty

SF01 = "/root/testdata/sf0.01"


def auc(y, p):
    order = np.argsort(np.argsort(p)) + 1.0
    for v in np.unique(p):
        order[p == v] = order[p == v].mean()
    ones = y.sum()
    return (order[y == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones))


def held(spark, name, label):
    got = queries.REGISTRY[name].run(spark, SF01)
    truth = spark.read.parquet(f"{SF01}/labels.parquet")
    rows = got.filter("held_out").join(truth, "doc_id").select("score", "predicted", label).toPandas()
    return rows[label].to_numpy(), rows["score"].to_numpy(), rows["predicted"].to_numpy()


def test_language_held_out(spark):
    got = queries.REGISTRY["op2_language_id"].run(spark, SF01).join(spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = got.filter("held_out").collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_filters_against_sets(spark):
    """The bit-sliced masks hold exactly the typical n-grams of each language, but for false positives."""
    rows = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("alpha beta", "x"), ("alpha beta gamma", "x"), ("delta beta", "y"), ("delta beta", "y")])],
                                 "doc_id long, text string, lang string")
    f = language.learn(rows, bits=16)
    assert f.languages == ["x", "y"]
    share = dict(zip(f.languages, f.shares("alpha")[0]))
    assert share["x"] > 0.99 and share["y"] < 0.01
    both = dict(zip(f.languages, f.shares("beta")[0]))
    assert both["x"] > 0.99 and both["y"] > 0.99
    assert f.predict("Delta")[0] == "y" and f.predict("123 !") == ("und", 0.0) and f.predict(None) == ("und", 0.0)


def test_language_awkward(spark):
    df = awkward(spark)
    f = language.learn(df)
    got = {r.doc_id: r.l for r in df.select("doc_id", language.identify(f, df).alias("l")).collect()}
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {1, 2, 3, 8}
    assert set(f.languages) == {"de", "en", "es", "fr"}
    nothing = language.learn(empty(spark))
    assert df.select(language.identify(nothing, df).alias("l")).filter("l.lang_pred = 'und' AND l.score = 0").count() == len(AWKWARD)


def test_predictions_against_sets(spark):
    """Every prediction of the small table from plain sets of n-grams; the filters have so many bits that false positives do not count."""
    docs = documents(spark).select("doc_id", "text", "lang")
    f = language.learn(docs, bits=24)
    texts, sets = {}, {}
    for r in docs.collect():
        if r.lang is not None and r.text is not None:
            texts.setdefault(r.lang, []).append(set(language.grams(r.text).tolist()))
    share = {k: {g: n / len(v) for g, n in __import__("collections").Counter(g for t in v for g in t).items() if n >= 2} for k, v in texts.items()}
    for k in share:
        sets[k] = {g for g, s in share[k].items() if s >= 0.004 and s >= 0.1 * max(o.get(g, 0) for o in share.values())}
    for r in docs.select("doc_id", "text", language.identify(f, docs).alias("l")).collect():
        g = language.grams(r.text or "").tolist()
        if not g:
            assert r.l.lang_pred == "und"
            continue
        want = {k: sum(x in sets[k] for x in g) / len(g) for k in sorted(sets)}
        assert r.l.lang_pred == max(want, key=want.get) and abs(r.l.score - max(want.values()) ** 2 / sum(v * v for v in want.values())) < 1e-3


@pytest.mark.parametrize("text", ["½", "②", "²", "Ⅷ", "7 ¾", "_", "", "٣"])
def test_numbers_are_no_letters(text):
    assert not len(language.grams(text))


@pytest.mark.parametrize("text", ["A.", "7 b", "x", "é", "ab", "a b", "Is.", "中"])
def test_grams_of_short_texts(text):
    b = f" {' '.join(''.join(c if c.isalpha() else ' ' for c in text.lower()).split())} ".encode()
    want = [int.from_bytes(bytes([n]) + b[i:i + n], "big") for n in language.SIZES for i in range(len(b) - n + 1)]
    assert language.grams(text).tolist() == want and want


def test_language_of_short_texts(spark):
    df = spark.createDataFrame([(1, "A.", "en"), (2, "7 b", "en"), (3, "ab", "de"), (4, "a b", "de"), (5, "...", "de"), (6, "A.", "en")], "doc_id long, text string, lang string")
    f = language.learn(df)
    got = {r.doc_id: r.l for r in df.select("doc_id", language.identify(f, df).alias("l")).collect()}
    assert len(got) == 6 and {i for i, r in got.items() if r.lang_pred == language.UNKNOWN} == {5} and got[1] == got[6] and got[1].lang_pred == "en"


def test_toxicity_held_out(spark):
    y, score, predicted = held(spark, "op3_toxicity_machine", "toxic")
    assert auc(y, score) > 0.8 and predicted[y == 0].mean() < 0.02 and predicted[y == 1].mean() > 0.6


def test_toxicity_learns_a_pair(spark):
    """Neither word alone is toxic, both together are: what a linear score cannot say."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(600):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        filler = " ".join(f"w{rng.integers(40)}" for _ in range(8))
        rows.append((i, f"{filler} {'insult' if a else 'calm'} {'group' if b else 'chair'}", int(a and b)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    m = toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"), passes=20, penalty=1e-4)
    score = m.scorer()
    assert score("w1 insult group") > 0.5 > max(score("w1 insult chair"), score("w1 calm group"), score("w1 calm chair"))


def test_toxicity_learns_pairs_of_neutral_words(spark):
    """No word says anything on its own; two of the four pairs are toxic."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(2000):
        a, b = rng.integers(2), rng.integers(2)
        filler = " ".join(f"w{rng.integers(40)}" for _ in range(8))
        rows.append((i, f"{filler} {('rotten', 'lovely')[a]} {('chair', 'group')[b]}", int(a == b)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    score = toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic")).scorer()
    assert min(score("lovely group"), score("rotten chair")) > 0.9 and max(score("lovely chair"), score("rotten group")) < 0.1


def test_probability_and_step_against_sums():
    """The margin is the double sum over pairs, and one step follows the derivative of the log loss."""
    rng = np.random.default_rng(4)
    theta, x, y = rng.normal(0, 0.3, (7, 4)), np.array([0, 2, 5]), 1.0
    theta[-1, 1:] = 0

    def loss(t):
        v = t[x, 1:]
        margin = t[-1, 0] + t[x, 0].sum() + sum(v[i] @ v[j] for i in range(3) for j in range(i))
        assert np.isclose(toxicity._probability(t[-1, 0], t[:, 0], t[:, 1:], x), 1 / (1 + np.exp(-margin)))
        return np.log1p(np.exp(-margin)) if y else np.log1p(np.exp(margin))

    moved = toxicity._train([x], np.array([y]), theta, 1, 1e-3, 0.0, 0) - theta
    for i, k in [(0, 0), (2, 1), (5, 3), (6, 0), (1, 1)]:
        up, down = theta.copy(), theta.copy()
        up[i, k] += 1e-6
        down[i, k] -= 1e-6
        slope = (loss(up) - loss(down)) / 2e-6
        # An adaptive step divides by the root of the start value and the square of the slope.
        assert np.isclose(moved[i, k], -1e-3 * slope / np.sqrt(1e-2 + slope * slope), atol=1e-8)


def test_toxicity_awkward(spark):
    df = awkward(spark)
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    for given in (labels, labels.limit(0)):
        m = toxicity.learn(df, given)
        got = [r.s for r in df.select(toxicity.toxicity(m, df).alias("s")).collect()]
        assert len(got) == len(AWKWARD) and all(0 <= s <= 1 for s in got)
    assert empty(spark).select(toxicity.toxicity(m, df)).collect() == []


def test_quality_held_out(spark):
    y, score, predicted = held(spark, "op4_quality_ridge", "quality")
    assert auc(y, score) > 0.95 and np.mean(y == predicted) > 0.9


def test_isotonic_against_quadratic_search():
    rng = np.random.default_rng(1)
    s, n = np.sort(rng.random(30)), rng.integers(1, 9, 30).astype(float)
    ones = np.array([rng.binomial(int(m), p) for m, p in zip(n, s)], dtype=float)
    knots, levels = quality.isotonic(s, ones, n)
    # Min-max formula of isotonic regression.
    best = [max(min(ones[a:b + 1].sum() / n[a:b + 1].sum() for b in range(i, 30)) for a in range(i + 1)) for i in range(30)]
    assert np.allclose(sorted(set(np.round(best, 12))), np.round(levels, 12))
    assert (np.diff(knots) > 0).all() and (np.diff(levels) > 0).all()


def test_ridge_against_direct_solution(spark):
    """The partition-summed normal equations give the solution over all rows at once."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, len(quality.STATISTICS)))
    y = (x[:, 0] + x[:, 1] > 0).astype(int)
    stats = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "doc_id long, stats array<double>").repartition(7)
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, quality int")
    m = quality.learn(stats, labels, waves=256)
    z = m.features(x)
    direct = np.linalg.solve(z.T @ z + 1e-3 * len(x) * np.diag([1.0] * 256 + [1e-9]), z.T @ y)
    assert np.allclose(direct, m.weights)
    assert np.mean((m.score(x) >= 0.5) == y) > 0.8


def test_quality_awkward(spark):
    df = awkward(spark)
    described = df.select("doc_id", quality.statistics_column().alias("stats"))
    rows = described.collect()
    assert len(rows) == len(AWKWARD) and all(len(r.stats) == len(quality.STATISTICS) and np.isfinite(r.stats).all() for r in rows)
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, None), (None, 1), (99, 1)], "doc_id long, quality int")
    for given in (labels, labels.limit(0)):
        m = quality.learn(described, given)
        got = [r.s for r in described.select(quality.quality(m, described).alias("s")).collect()]
        assert len(got) == len(AWKWARD) and all(0 <= s <= 1 for s in got)


@pytest.mark.parametrize("name", ["op2_language_id", "op3_toxicity_machine", "op4_quality_ridge"])
def test_every_document_has_a_row(spark, name):
    got = queries.REGISTRY[name].run(spark, "/root/testdata/sf0.001")
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(r.doc_id for r in documents(spark).select("doc_id").collect())


def test_quality_sums_reach_the_driver_once_whatever_the_partitions(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, len(quality.STATISTICS)))
    stats = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "doc_id long, stats array<double>").repartition(40)
    labels = spark.createDataFrame([(i, int(r[0] > 0)) for i, r in enumerate(x)], "doc_id long, quality int")
    kind, sent = type(stats), []
    collect = kind.collect

    def counted(df):
        rows = collect(df)
        sent.extend(len(r.s) for r in rows if "s" in df.columns and isinstance(r.s, (bytes, bytearray)))
        return rows

    monkeypatch.setattr(kind, "collect", counted)
    quality.learn(stats, labels, waves=32)
    assert sum(sent) == 4 * 33 * 34 * 8
