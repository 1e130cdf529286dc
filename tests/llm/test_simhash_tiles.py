import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from partwise.llm import simhash_tiles as S
from tests.llm.cases import awkward, documents, empty


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h)) if h else 0


def brute(rows, radius=2):
    """(id, fingerprint, component) of every row by comparing all pairs."""
    prints = [(i, slow_fingerprint(t)) for i, t in rows]
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(prints):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d, f, least[root(i)]) for i, (d, f) in enumerate(prints))


def got(df):
    return sorted((r[0], r.fp % (1 << 64), r.component_id) for r in df.collect())


def test_documents_against_brute_force(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(S.near_duplicates(docs)) == brute(rows)


def test_awkward_rows(spark):
    rows = [(r.doc_id, r.text) for r in awkward(spark).collect() if len(r.text or "") < 10_000]
    want = brute(rows)
    found = [r for r in got(S.near_duplicates(awkward(spark))) if r[0] != 4]
    assert found == want
    assert S.near_duplicates(empty(spark)).collect() == []


@pytest.mark.parametrize("block", [2, 5, 2048])
def test_links_keep_every_component(spark, block):
    """Chains and dense groups of fingerprints, in blocks down to a few rows."""
    rng = random.Random(7)
    fps = set()
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 12])):
            fps.add(x)
            x ^= (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    edges = [(a % (1 << 64), b % (1 << 64)) for a, b in S.links(df, 2, block).collect()]

    def classes(pairs):
        label = {f: f for f in fps}
        changed = True
        while changed:
            changed = False
            for a, b in pairs:
                m = min(label[a], label[b])
                changed |= label[a] != m or label[b] != m
                label[a] = label[b] = m
        return label

    assert classes(edges) == classes([(a, b) for a in fps for b in fps if bin(a ^ b).count("1") <= 2])


def test_one_row_of_every_component(spark):
    """Rows without an id and rows that share one are told apart by their component."""
    texts = [f"{a} is a text of its own about {b} and {c}" for a, b, c in zip("abcdef", "ghijkl", "mnopqr")]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (None, texts[2]), (3, texts[2]), (7, texts[3]), (7, texts[4]), (7, texts[4]), (9, texts[4]), (1, texts[5]), (2, None),
            (None, "")]
    got = S.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, texts[0]), (None, texts[1]), (3, texts[2]), (7, texts[3]), (7, texts[4]), (1, texts[5]), (2, None)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
