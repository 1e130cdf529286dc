import numpy as np
import pytest

from partwise.llm import pivots as P
from tests.llm.cases import documents


def brute(rows, least=0.9):
    """vec_id -> (links, component) by comparing all rows."""
    fine = [(i, np.array(v, dtype=np.float64)) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    out = {i: [0, i] for i, _ in rows}
    unit = [v / np.linalg.norm(v) for _, v in fine]
    pairs = [(a, b) for a in range(len(fine)) for b in range(a) if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least]
    label = {i: i for i, _ in fine}
    for a, b in pairs:
        out[fine[a][0]][0] += 1
        out[fine[b][0]][0] += 1
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            x, y = fine[a][0], fine[b][0]
            m = min(label[x], label[y])
            changed |= label[x] != m or label[y] != m
            label[x] = label[y] = m
    return {i: (n, label.get(i, c)) for i, (n, c) in out.items()}


@pytest.mark.parametrize("block", [3, 1024])
def test_planted_groups(spark, block):
    """Copies, near copies around the threshold, and vectors that must link with nothing."""
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for size in [1] * 60 + [2] * 20 + [25]:
        base = rng.normal(size=32)
        for k in range(size):
            v = base if k == 1 else base + rng.normal(size=32) * rng.choice([0.02, 0.2, 0.3]) * (k > 0)
            rows.append((n, [float(x) for x in v]))
            n += 1
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * 32), (n + 3, [float("nan")] + [1.0] * 31), (n + 4, [None] + [1.0] * 31), (n + 5, [float("inf")] * 32),
             (n + 6, [1.0, 2.0]), (n + 7, [2.0, 4.0]), (n + 8, [1e200] * 32), (n + 9, [1e-200] * 32), (n + 10, [-0.0, 1.0]), (n + 11, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS node", "1 AS n", "2 AS list")
    got = {r.vec_id: (r.n_links, r.component_id) for r in P.near_duplicates(df, block=block).collect()}
    want = brute(rows[:-4])
    want |= {n + 8: (1, n + 8), n + 9: (1, n + 8), n + 10: (1, n + 10), n + 11: (1, n + 10)}
    links, total = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert total >= links >= 0.97 * total
    assert all(got[i][0] <= want[i][0] for i in want)
    assert [got[n + k] for k in range(12)] == [want[n + k] for k in range(12)]
    assert all(r.kept == (r.vec_id == r.component_id) for r in P.near_duplicates(df).collect())


def test_embeddings_recall(spark):
    table = documents(spark, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    rows += [(10_000 + i, [x * 1.5 + 0.01 for x in v]) for i, v in rows[:60]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in P.near_duplicates(df).collect()}
    want = brute(rows)
    assert sum(v[0] for v in want.values()) >= 120
    assert got == want


def test_no_rows(spark):
    assert P.near_duplicates(documents(spark, "embeddings").limit(0)).collect() == []


@pytest.mark.parametrize("number", [89, 566, 4096])
def test_recall_does_not_fall_with_more_pivots(spark, number):
    """Pairs at cosine 0.90 exactly, in 64 dimensions: nearly all meet in a list."""
    rng = np.random.default_rng(number)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a, o = unit(rng.normal(size=(1000, 64))), rng.normal(size=(1000, 64))
    b = 0.9 * a + (1 - 0.81) ** 0.5 * unit(o - (o * a).sum(axis=1, keepdims=True) * a)
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([a, b]))], "node long, vector array<double>")
    lists = {r.node: set(r.lists) for r in P.inverted_lists(nodes, {64: unit(rng.normal(size=(number, 64)))}, 7, 2).collect()}
    assert np.mean([bool(lists[i] & lists[1000 + i]) for i in range(1000)]) >= 0.99
