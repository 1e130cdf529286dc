import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from partwise.llm import spelling as S
from tests.llm.cases import awkward, documents, empty


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def counted(rows, modulus=31, least_length=7, least_count=2):
    words = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            words[run[:h % len(run)] + run[h % len(run) + 1:] if h % modulus == 0 else run] += 1
    return {w: n for w, n in words.items() if len(w) >= least_length and n >= least_count}


def brute(words, times=10):
    """The contract's rows by comparing every two words of nearly one length."""
    by_length, near = {}, {w: [] for w in words}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    for w in words:
        near[w] = [u for k in (-1, 0, 1) for u in by_length.get(len(w) + k, []) if u != w and one_edit(u, w)]
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda u: (-words[u], u), default=None)
        form[w] = best if best and words[best] >= times * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()), key=repr)


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


@pytest.mark.parametrize("alphabet,lengths,times", [("ab", (2, 9), 2), ("abcé", (2, 6), 3)])
def test_dense_words_against_brute_force(spark, alphabet, lengths, times):
    """Every second word has dozens of neighbours, and repeats make one edit possible at several places."""
    rng = random.Random(len(alphabet))
    words = {"".join(rng.choice(alphabet) for _ in range(rng.randint(*lengths))): rng.choice([2, 3, 9, 40, 400]) for _ in range(700)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    pairs = [(r.word, r.near) for r in S.neighbours(df).collect()]
    assert len(pairs) == len(set(pairs))
    assert got(S.variants(df, times)) == brute(words, times)


def test_long_words(spark):
    """Words of thousands of code points that share nearly all of them."""
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh") for _ in range(3000))
    words = {base: 90, base[:1500] + base[1501:]: 9, base[:-1]: 3, base[:64] + "z" + base[65:]: 2, base + "x": 8, "z" + base: 1, base[:10]: 4, "a" * 200: 50, "a" * 199: 5, "a" * 202: 5}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert got(S.variants(df, 10)) == brute(words)


def test_documents_against_brute_force(spark):
    docs = documents(spark)
    want = brute(counted(rows_of(docs)))
    assert got(S.variant_groups(docs)) == want and any(r[1] for r in want)


def test_deletions_chains_and_ties(spark):
    rows = [(i, "Relation relatiom") for i in range(400)] + [(i, "relationn") for i in range(28)] + [(1, "relatioonn relatioonn"), (None, "Größeren größeren grösseren"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("word", "n", "id", "run", "h", "path", "node")})
    want = brute(counted(rows))
    assert got(S.variant_groups(df)) == want
    assert any(r[1] and r[2] != r[1] for r in want)


def test_awkward_rows(spark):
    df = awkward(spark)
    assert got(S.variant_groups(df, least_length=3)) == brute(counted(rows_of(df), least_length=3))
    assert got(S.variant_groups(empty(spark))) == []
