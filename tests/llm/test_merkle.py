import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from partwise.llm import merkle as M
from partwise.llm.queries import REGISTRY
from tests.llm.cases import awkward, documents, empty


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, text)))


def levels(nodes):
    """All levels of one tree, leaves first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i:i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, i):
    found = []
    for level in tree[:-1]:
        run = i // 3 * 3
        found.append((level[run:i], level[i + 1:run + 3]))
        i //= 3
    return found


def brute(rows):
    """The contract's rows in plain Python."""
    parts = {}
    for r in rows:
        parts.setdefault(r.source, []).append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    names = sorted(parts, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(parts[s], key=lambda x: x[:3])]) for s in names}
    over = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, x in enumerate(sorted(parts[s], key=lambda x: x[:3])):
            r, steps = x[3], siblings(trees[s], i) + siblings(over, k)
            even = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
            f = leaf(r, r.text.replace("\n", "") if r.text is not None and even else r.text)
            for left, right in steps:
                f = h("".join([*left, f, *right]))
            proof = h("".join("".join([*a, *b]) for a, b in steps))
            out.append((r.doc_id, x[2], trees[s][-1][0], over[-1][0], proof, f, f == over[-1][0]))
    return sorted(out, key=repr)


def run(spark, df, tmp_path):
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = REGISTRY["op11_merkle_manifest"].run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, got.collect()), key=repr)


def test_documents_against_brute_force(spark, tmp_path):
    docs = documents(spark)
    got = run(spark, docs, tmp_path)
    assert got == brute(docs.collect())
    assert {r[6] for r in got} == {True, False}


def test_several_rounds_ties_and_null_ids(spark, tmp_path):
    """Parts of one row to several blocks; ids that repeat with and without the same text, and ids that are missing."""
    ids = F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 7 == 0, 7).otherwise(F.col("id"))
    df = spark.range(2600).select(ids.alias("doc_id"), F.when(F.col("id") % 3 != 0, "hot").when(F.col("id") < 9, F.concat(F.lit("s"), "id")).alias("source"),
                                  F.lit("en").alias("lang"), (F.col("id") % 5).alias("n_chars"), F.concat((F.col("id") % 11).cast("string"), F.lit("\nx")).alias("text"))
    assert run(spark, df, tmp_path) == brute(df.collect())


@pytest.mark.parametrize("n", [1, 730])
def test_block_edges(spark, n):
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit("part").alias("part"))
    rows = M.manifest(df, "source", "doc_id", M.leaf(F.col("doc_id"))).orderBy("doc_id").collect()
    tree = levels([h(f"{len(str(i))}:{i}") for i in range(n)])
    assert {r.root for r in rows} == {r.subroot for r in rows} == {tree[-1][0]}
    assert [[(s.left, s.right) for s in r.path] for r in rows] == [[("".join(a), "".join(b)) for a, b in siblings(tree, i)] for i in range(n)]


def test_awkward_rows(spark, tmp_path):
    df = awkward(spark)
    assert run(spark, df, tmp_path / "rows") == brute(df.collect())
    assert run(spark, empty(spark), tmp_path / "none") == []
