import collections

import corpus_pipeline as C
from partwise.llm import simhash_tiles
from tests.llm.cases import SF, awkward, documents


def test_stages(spark):
    """Each stage against what it must do to its own input."""
    docs, columns = documents(spark), documents(spark).columns
    seen = {}
    for name, stage in C.STAGES[:-1]:
        before, docs = docs, C.written(stage(spark, docs, SF), name)
        assert docs.columns == columns
        seen[name] = (before, docs)
    before, after = seen["language_id"]
    assert after.count() >= 0.99 * before.count()  # these tables hold text in a language only

    before, after = seen["toxicity"]
    gone = before.join(after, "doc_id", "left_anti")
    labels = documents(spark, "labels")
    assert gone.join(labels.filter("toxic = 0"), "doc_id").count() == 0

    before, after = seen["simhash_near_dedup"]
    heads = {r.doc_id for r in simhash_tiles.near_duplicates(before).collect() if r.doc_id == r.component_id}
    assert sorted(r.doc_id for r in after.collect()) == sorted(heads)

    before, after = seen["mixing"]
    taken = collections.Counter(r.doc_id for r in after.collect())
    assert set(taken) <= {r.doc_id for r in before.collect()} and max(taken.values()) == 2
    size = {r.doc_id: len(r.text.encode().split()) for r in before.collect()}
    assert abs(sum(size[d] * n for d, n in taken.items()) - 1.5 * sum(size.values())) < 0.02 * sum(size.values())

    packed = C.STAGES[-1][1](spark, docs, SF).collect()
    whole = collections.Counter(r.doc_id for r in packed if r.piece == 0)
    assert whole == taken
    bins = collections.defaultdict(list)
    for r in packed:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048


def test_awkward_rows(spark):
    docs = awkward(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in C.STAGES[:-1]:
        docs = C.written(stage(spark, docs, SF), name)
    assert {r.doc_id for r in docs.collect()} <= {r.doc_id for r in awkward(spark).collect()}
    none = documents(spark).limit(0)
    for _, stage in C.STAGES:
        none = C.written(stage(spark, none, SF), "none")
    assert none.count() == 0


def test_clashing_names(spark):
    """Columns with the names that the stages use themselves pass unchanged."""
    names = "_id _hash _no _rank _position _positions text_hash _language _toxicity row id hash rank found score position size of no head label fp".split()
    docs = documents(spark).limit(60)
    for i, c in enumerate(names):
        docs = docs.withColumn(c, docs.doc_id * 100 + i)
    columns = docs.columns
    for name, stage in C.STAGES[:-1]:
        docs = C.written(stage(spark, docs, SF), name)
        assert docs.columns == columns
        assert all(r[c] == r.doc_id * 100 + i for r in docs.collect() for i, c in enumerate(names))
    assert C.STAGES[-1][1](spark, docs, SF).count() >= docs.count() > 0
