"""Fingerprints and URL rules, both in DataFrame operations only, against plain Python."""

import hashlib
import random
import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from partwise.llm import fingerprints as P
from partwise.llm import url_rules
from tests.llm.cases import AWKWARD, awkward, documents, empty


def slow_fingerprint(text):
    """Votes of word pairs by their length, with the chained hash that Spark gives two columns."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    terms = [(xxh64_intdigest(b.encode(), xxh64_intdigest(a.encode(), 42)), len(a) + len(b)) for a, b in zip(words, words[1:])]
    terms = terms or [(xxh64_intdigest(w.encode(), 42), len(w)) for w in words]
    whole = sum(w for _, w in terms)
    return sum(1 << j for j in range(64) if 2 * sum(w for h, w in terms if h >> j & 1) > whole)


def test_edit_report_against_brute_force(spark):
    for df in (documents(spark), awkward(spark).filter("doc_id <> 7")):
        rows = sorted((r.doc_id, r.text or "") for r in df.collect())
        got = {r.doc_id: r for r in P.edit_report(df).collect()}
        assert len(got) == len(rows)
        prints = {}
        for k, (i, text) in enumerate(rows):
            following = rows[(k + 1) % len(rows)]
            cut = len(text) // 4
            edited = text[:len(text) - cut] + following[1][:cut]
            r = got[i]
            assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
            assert prints.setdefault(text, r.fingerprint) == r.fingerprint and prints.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
            if len(text) < 10_000:
                assert (int(r.fingerprint, 16), int(r.edited_fingerprint, 16)) == (slow_fingerprint(text), slow_fingerprint(edited))
            bits = bin(int(r.fingerprint, 16) ^ int(got[following[0]].fingerprint, 16)).count("1")
            assert r.near_next == pytest.approx(max(0.0, np.cos(np.pi * bits / 64)))
            assert 0 <= r.near_edited <= 1
        for r in got.values():
            want = sum(bin(int(r.fingerprint, 16) ^ int(o.fingerprint, 16)).count("1") <= 3 for o in got.values()) - 1 if r.doc_id % 100 == 0 else None
            assert r.within_radius == want


def test_edits_are_nearer_than_neighbours(spark):
    rows = [r for r in P.edit_report(documents(spark)).collect() if r.n_chars > 400]
    assert np.mean([r.near_edited > r.near_next for r in rows]) > 0.9


def test_repeated_and_missing_rows(spark):
    assert sorted(r.doc_id for r in P.edit_report(awkward(spark)).collect()) == sorted(r[0] for r in AWKWARD)
    assert P.edit_report(empty(spark)).collect() == []
    one = spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")
    r = P.edit_report(one).collect()[0]
    assert r.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()


@pytest.mark.parametrize("radius, blocks", [(0, 1), (2, 4), (3, 5), (3, 6)])
def test_block_tables_find_all(spark, radius, blocks):
    rng = random.Random(radius * 10 + blocks)
    fps = []
    for _ in range(60):
        x = rng.getrandbits(64)
        for flips in (0, 0, 1, 2, 3, 4, 6):
            fps.append(x ^ sum(1 << b for b in rng.sample(range(64), flips)))
    signed = [(int(np.uint64(f).view(np.int64)),) for f in fps] + [(None,)]
    df = spark.createDataFrame(signed, "fp long")
    asked = df.filter("pmod(fp, 3) = 0")
    got = sorted((r.fp, r.other, r.copies) for r in P.within_radius(asked, df, radius, blocks).collect())
    want = sorted((a, b, sum(s[0] == b for s in signed)) for a in {s[0] for s in signed if s[0] is not None and s[0] % 3 == 0} for b in {s[0] for s in signed if s[0] is not None}
                  if bin((a ^ b) % (1 << 64)).count("1") <= radius)
    assert got == want


URLS = [(1, None), (2, ""), (3, "no scheme/en/"), (4, "http://A.Example.COM/en/7?x"), (5, "http://example.com"), (6, "https://com/en/"), (7, "x://net/de/8#f"),
        (8, "http://example.net/de/8"), (8, "http://example.net/de/8"), (9, "http://notexample.com/en/1"), (10, "http://a.org?/es/"), (11, "http://org/es/" + "z" * 20000),
        (12, "://com/en/"), (13, "http://.com/en/x"), (14, "http://example.com:80/en/7"), (15, "http://" + ".".join("abc" * 400) + ".com/en/"), (16, "a://b://com/en/7")]
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
         ("allow", "ORG", "/es/"), ("block", None, "/x"), ("allow", "b:", "")]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    path = tail[:min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(len(h.lower()) + len(p), len(h), a == "block", h.lower() + p, a) for a, h, p in RULES if h and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    best = max(fits, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


@pytest.mark.parametrize("limit,short", [(100_000, 8), (2, 8), (100_000, 1), (2, 0)])
def test_url_rules_against_all_rules(spark, monkeypatch, limit, short):
    """Broadcast and salted shuffle give the same verdicts, also where different rules share their short prefix."""
    monkeypatch.setattr(url_rules, "SHORT", short)
    urls = spark.createDataFrame(URLS, "page_id long, url string").selectExpr("*", "'x' AS host", "'y' AS path", "1 AS rank")
    rules = spark.createDataFrame(RULES, "action string, host string, path string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(urls, rules, "page_id", broadcast_rules=limit).collect())
    assert got == sorted((i, *judged(u)) for i, u in URLS)
    assert url_rules.judge(urls.limit(0), rules, "page_id").collect() == []
    assert all(r.rule is None and r.verdict == "allow" for r in url_rules.judge(urls, rules.limit(0), "page_id").collect())


def test_rules_of_many_shapes(spark):
    """A thousand rules with two hundred path lengths cost one small plan; every URL still gets its longest rule."""
    rng = random.Random(11)
    rows = [(("block", "allow")[k % 2], ".".join(rng.choice("abc") for _ in range(1 + k % 5)), "/" + "p" * (k % 200)) for k in range(1000)]
    rules = spark.createDataFrame(rows, "action string, host string, path string")
    urls = [(k, f"http://{'.'.join(rng.choice('abcd') for _ in range(6))}/{'p' * rng.randrange(250)}") for k in range(40)]
    plan = url_rules.judge(spark.createDataFrame(urls, "page_id long, url string"), rules, "page_id")
    assert plan._jdf.queryExecution().analyzed().toString().count("sha2(") < 5

    def longest(url):
        host, path = url.removeprefix("http://").split("/", 1)
        fits = [h + p for _, h, p in rows if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        return max(fits, key=len, default=None)

    assert {r.page_id: r.rule and len(r.rule) for r in plan.collect()} == {i: longest(u) and len(longest(u)) for i, u in urls}
