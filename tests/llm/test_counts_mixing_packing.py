import collections
import hashlib
import zlib

import duckdb
import numpy as np
import pytest

from partwise.llm import mixing, packing, queries, rollups
from partwise.session import scratch_path
from pyspark.sql import functions as F
from tests.llm.cases import AWKWARD, SF, awkward, documents, empty
from tools.check import TABLES, table_of


@pytest.mark.parametrize("name", [n for n, q in queries.REGISTRY.items() if q.sql])
def test_against_sql(spark, name):
    q, con = queries.REGISTRY[name], duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, cur = q.run(spark, SF), con.execute(q.sql)
    assert table_of(df.columns, [tuple(r) for r in df.collect()]) == table_of([c[0] for c in cur.description], cur.fetchall())


# Rollups

def test_batches_are_committed_once_and_in_any_order(spark):
    none = F.lit(None).cast(rollups.STATE)
    one = lambda text, source="s": rollups.state(F.lit(source), F.lit(None), F.lit(text))
    row = spark.range(1)
    batches = {1: row.select(none.alias("before"), one("a b c").alias("after")), 2: row.select(one("a b c").alias("before"), one("a b").alias("after")),
               3: row.select(one("a b").alias("before"), one("a b", None).alias("after")), 4: row.select(none.alias("before"), one(None).alias("after"))}
    delta = {k: rollups.deltas(v, {"words": rollups.words}) for k, v in batches.items()}
    store = rollups.Rollup(spark, scratch_path(spark, "t"))
    assert store.totals().collect() == []
    assert [store.commit(k, delta[k]) for k in (3, 1, 1, 2, 3)] == [True, True, False, True, False]
    want = [(None, None, "words", 1, 2)]
    assert [tuple(r) for r in store.totals().collect()] == want
    assert [tuple(r) for r in store.totals(1).collect()] == [("s", None, "words", 1, 3)]
    store.compact(3)
    assert store.commit(2, delta[2]) is False
    assert [tuple(r) for r in store.totals().collect()] == want
    assert store.commit(4, delta[4]) and sorted(map(tuple, store.totals().collect()), key=str) == sorted([*want, ("s", None, "words", 1, 0)], key=str)


def test_half_written_batch_is_replaced(spark):
    store = rollups.Rollup(spark, scratch_path(spark, "t"))
    spark.createDataFrame([("s", "x", "words", 7, 7)], "source string, lang string, tokenizer string, docs long, tokens long").write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{store.path}/batch=1")
    assert store.totals().collect() == []
    change = spark.range(1).select(F.lit(None).cast(rollups.STATE).alias("before"), rollups.state(F.lit("s"), F.lit("x"), F.lit("a")).alias("after"))
    assert store.commit(1, rollups.deltas(change, {"words": rollups.words}))
    assert [tuple(r) for r in store.totals().collect()] == [("s", "x", "words", 1, 1)]


def test_rollup_of_awkward_rows(spark):
    df = awkward(spark)
    change = df.select(F.lit(None).cast(rollups.STATE).alias("before"), rollups.state(F.col("source"), F.col("lang"), F.col("text")).alias("after"))
    versions = {"words": rollups.words, "ids": rollups.vocabulary(queries.tokenizer_path())}
    got = {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in rollups.deltas(change, versions).collect()}
    encode, want = packing.encoder(queries.tokenizer_path()), collections.defaultdict(lambda: [0, 0])
    for _, text, lang, source in AWKWARD:
        for version, n in (("words", len((text or "").encode().split())), ("ids", len(encode(text or "")))):
            want[source, lang, version][0] += 1
            want[source, lang, version][1] += n
    assert got == {k: tuple(v) for k, v in want.items()}


# Mixing

def test_targets_against_repeated_resharing():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(1, 9))
        sizes, weights = [int(x) for x in rng.integers(0, 1000, n)], [float(x) for x in rng.choice([1, 2, 3], n)]
        got, total = mixing.targets(sizes, weights, 1.5, 2.0), 1.5 * sum(sizes)
        want, free = [0.0] * n, set(range(n))
        while free:
            rest = total - sum(want[i] for i in range(n) if i not in free)
            share = {i: rest * weights[i] / sum(weights[j] for j in free) for i in free}
            over = {i for i in free if share[i] > 2 * sizes[i]}
            for i in over or free:
                want[i] = 2.0 * sizes[i] if over else share[i]
            free = free - over if over else set()
        assert np.allclose(got, want)


def test_mix_meets_targets_and_repeats(spark):
    docs = documents(spark)
    run = lambda: {r.doc_id: r for r in mixing.mix(docs, (3, 1, 2), 1.5, 2.0, queries.SCHEDULES).drop("segments").collect()}
    got = run()
    assert got == run()
    by = collections.defaultdict(list)
    for r in got.values():
        assert r.taken == r.copies * r.size <= 2 * r.size and len(r.offsets) == r.copies
        by[r.source].append(r)
    for rows in by.values():
        taken, target = sum(r.taken for r in rows), rows[0].target
        assert abs(taken - target) <= max(r.size for r in rows) / 2 + 1
        places = sorted((o, r.size) for r in rows for o in r.offsets if r.size)
        assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and places[0][0] == 0  # a sequence without gaps


def test_positions_follow_the_schedule(spark):
    """The share of a source's words before a time is the integral of its schedule up to then."""
    schedule = ((0.0, 0.5), (0.4, 2.0), (1.0, 0.25))
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("w " * 5).alias("text"))
    ordered = mixing.copies_in_order(docs, mixing.mix(docs, (1,), 1.0, 2.0, [schedule]))
    t = np.array([r.position for r in ordered.collect()])
    assert (np.diff(t) >= 0).all() and len(t) == 2000
    fine = np.linspace(0, 1, 100_001)
    w = np.interp(fine, *zip(*schedule))
    area = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
    for q in (0.1, 0.3, 0.4, 0.7, 0.9):
        assert abs((t <= q).mean() - np.interp(q, fine, area / area[-1])) < 0.002


def test_mix_of_awkward_rows(spark):
    df = awkward(spark)
    mixed = mixing.mix(df, (3, 1, 2), 1.5, 2.0)
    rows = mixed.collect()
    assert len(rows) == len(AWKWARD) and sorted({r.source for r in rows}, key=str) == sorted({r[3] for r in AWKWARD}, key=str)
    ordered = mixing.in_training_order(df, mixed)
    assert collections.Counter(r.doc_id for r in ordered.collect()) == collections.Counter(r.doc_id for r in rows for _ in range(r.copies))
    none = mixing.mix(empty(spark), (3, 1, 2), 1.5, 2.0)
    assert none.collect() == [] and mixing.in_training_order(empty(spark), none).collect() == []


def test_mixing_query_follows_the_curriculum(spark, monkeypatch):
    """The rows of op8 stand in the order of their first copies, and another schedule gives another order."""
    docs = documents(spark)

    def got():
        return [r.doc_id for r in queries.REGISTRY["op8_curriculum_mixing"].run(spark, SF).collect() if r.taken]

    def want():
        mixed = mixing.mix(docs, queries.WEIGHTS, queries.SHARE, queries.CAP, queries.SCHEDULES)
        return [i for i in dict.fromkeys(r.doc_id for r in mixing.in_training_order(docs, mixed).collect()) if i in words]

    words = {r.doc_id for r in docs.collect() if (r.text or "").split()}
    first = got()
    assert first == want()
    monkeypatch.setattr(queries, "SCHEDULES", (((0.0, 0.1), (1.0, 2.0)), ((0.0, 2.0), (1.0, 0.1))))
    assert got() == want() != first


def test_partial_pass_fills_up(spark):
    """Against taking, document by document, what still fits: one very long document at the cut keeps none of the others out."""
    rng = np.random.default_rng(5)
    sizes = {s: [int(x) for x in rng.integers(100, 600, 300)] + [60_000] for s in "abcde"} | {None: [3, 5, 5, 9, 9, 9, 0, 0]}
    rows = [(f"{s}{i}", s, "w " * n) for s, v in sizes.items() for i, n in enumerate(v)]
    docs = spark.createDataFrame(rows, "doc_id string, source string, text string")
    got = mixing.mix(docs, (3, 1, 2), 1.4, 2.0).collect()
    for s in sizes:
        mine = sorted((r for r in got if r.source == s), key=lambda r: (hashlib.md5(r.doc_id.encode()).hexdigest(), r.doc_id))
        passes, missing = divmod(mine[0].target, mine[0].source_size)
        copies, cut = {r.doc_id: int(passes) for r in mine}, False
        for r in mine:
            if r.size <= missing and (r.size or not cut):
                copies[r.doc_id] += 1
                missing -= r.size
            else:
                cut = cut or r.size > missing
        rest = [r for r in mine if copies[r.doc_id] == passes and r.size and abs(missing - r.size) < missing]
        if rest:
            copies[min(rest, key=lambda r: abs(missing - r.size)).doc_id] += 1
        assert {r.doc_id: r.copies for r in mine} == copies
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 300
        places = sorted((o, r.size) for r in mine for o in r.offsets if r.size)
        assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and places[0][0] == 0


# Packing

def bins_of(rows):
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    return bins


def test_pieces_against_the_tokenizer(spark):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(queries.tokenizer_path())
    for df in (documents(spark), awkward(spark).filter("doc_id <> 7")):
        rows = packing.pack_documents(df, queries.tokenizer_path()).collect()
        by = collections.defaultdict(list)
        for r in rows:
            by[r.doc_id].append(r)
        total = 0
        for doc in df.collect():
            ids = [*reference.encode(doc.text or "", add_special_tokens=False).ids, 0]
            found = sorted(by[doc.doc_id], key=lambda r: r.piece)
            assert [i for r in found for i in r.ids] == ids
            assert [r.start for r in found] == [sum(x.length for x in found[:k]) for k in range(len(found))]
            assert all(r.length == 2048 for r in found[1:]) and [r.piece for r in found] == list(range(len(found)))
            assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in found)
            total += len(ids)
        bins = bins_of(rows)
        assert len(bins) <= 1.02 * total / 2048 + 1


def test_sequences_round_trip(spark):
    packed = packing.pack_documents(documents(spark), queries.tokenizer_path())
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r.sequence_id][r.offset:r.offset + r.length] == r.ids


def test_plan_against_placing_every_item():
    """The plan's places are disjoint, gapless and complete; large items sit at most two to a bin; few bins are lost."""
    rng = np.random.default_rng(0)
    for _ in range(100):
        capacity, n = int(rng.integers(3, 80)), int(rng.integers(1, 400))
        lengths = [int(x) for x in rng.integers(1, capacity + 1, n)]
        rows, number = packing.plan(dict(collections.Counter(lengths)), capacity)
        starts, bins = rows[:, 0] * (1 << 44) + rows[:, 1], collections.defaultdict(list)
        for length, count in collections.Counter(lengths).items():
            for rank in range(count):
                _, first, b, per, offset = rows[np.searchsorted(starts, length * (1 << 44) + rank, "right") - 1]
                bins[b + (rank - first) // per].append((offset + (rank - first) % per * length, length))
        assert len(bins) == number
        for places in bins.values():
            assert sum(3 * x > capacity for _, x in places) <= 2
            end = 0
            for offset, length in sorted(places):
                assert offset == end
                end += length
            assert end <= capacity
        # First-fit decreasing over the items themselves.
        open_bins: list[int] = []
        for x in sorted(lengths, reverse=True):
            at = next((i for i, g in enumerate(open_bins) if g >= x), None)
            if at is None:
                open_bins.append(capacity - x)
            else:
                open_bins[at] -= x
        assert number <= len(open_bins) * 1.1 + 1


def test_packing_nothing_and_repeats(spark):
    assert packing.pack_documents(empty(spark), queries.tokenizer_path()).collect() == []
    rows = packing.pack_documents(awkward(spark), queries.tokenizer_path(), with_ids=False).collect()
    assert collections.Counter(r.doc_id for r in rows if r.piece == 0) == collections.Counter(r[0] for r in AWKWARD)
    bins_of(rows)
    assert hashlib.sha256(repr(sorted((r.doc_id, r.piece, r.length) for r in rows)).encode()).hexdigest() == hashlib.sha256(
        repr(sorted((r.doc_id, r.piece, r.length) for r in packing.pack_documents(awkward(spark), queries.tokenizer_path()).collect())).encode()).hexdigest()
