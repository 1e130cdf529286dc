import random
from difflib import SequenceMatcher

import pytest

from partwise.operators import setjoin as S


def strings(rng, n, alphabet, longest):
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, longest))) for _ in range(n // 3)]
    out = list(base)
    for _ in range(n - len(base)):
        s = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(s) + 1)
            s[i:i + rng.randint(0, 1)] = rng.choice(["", rng.choice(alphabet)])
        out.append("".join(s))
    return out


@pytest.mark.parametrize("alphabet,longest,threshold", [("ab", 5, 0.8), ("abcdef阀门", 14, 0.8), ("abc", 9, 0.7)])
def test_strings_against_all_pairs(spark, alphabet, longest, threshold):
    rng = random.Random(longest)
    a, b = ([*strings(rng, 90, alphabet, longest), "", None] for _ in range(2))
    left, right = (spark.createDataFrame(list(enumerate(x)), "id long, text string") for x in (a, b))
    want = {(i, j): SequenceMatcher(None, x, y).ratio() for i, x in enumerate(a) for j, y in enumerate(b) if x and y}
    want = {k: round(v, 9) for k, v in want.items() if v >= threshold - 1e-9}
    rows = S.similar_strings(left, right, threshold).collect()
    got = {(r.left_id, r.right_id): round(r.similarity, 9) for r in rows}
    assert got == want and len(rows) == len(want) > 5


@pytest.mark.parametrize("rows", [20_000, 3])
def test_sets_against_all_pairs(spark, monkeypatch, rows):
    """With blocks of three postings, frequent tokens are joined in many block pairs."""
    monkeypatch.setattr(S.block_pairs, "__defaults__", (rows,))
    rng = random.Random(rows)
    a, b = ([[f"t{min(rng.randrange(12), rng.randrange(12))}" for _ in range(rng.randint(0, 6))] for _ in range(60)] for _ in range(2))
    left, right = (spark.createDataFrame([*enumerate(x), (99, None)], "id long, tokens array<string>") for x in (a, b))
    want = {(i, j): len({*x} & {*y}) / len({*x} | {*y}) for i, x in enumerate(a) for j, y in enumerate(b) if {*x} & {*y}}
    found = S.similar_sets(left, right, 0.4).collect()
    got = {(r.left_id, r.right_id): round(r.similarity, 9) for r in found}
    assert got == {k: round(v, 9) for k, v in want.items() if v >= 0.4} and len(got) == len(found)
