"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct lower-cased words and their first letters (stems of four and
five), hashed into buckets. Besides one weight per bucket the machine learns a short vector per
bucket, and the product of two buckets' vectors is the weight of their occurring together, so an
insult beside a mention can weigh more than both alone. It is fitted by rounds of local
adaptive gradient steps on shards of a labelled sample, averaged after each round.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partwise.llm.common import sampled_rows, written

TOKEN = re.compile(r"\w+")
STEMS = (4, 5)
BUCKETS = 1 << 18
#: Cells that pairs of words are counted in before the promising ones are counted exactly.
CELLS = 1 << 20


def buckets_of(word: str) -> list[int]:
    """The buckets of a lower-cased word and of its stems."""
    stems = [f"{n}:{word[:n]}" for n in STEMS if len(word) > n]
    return [zlib.crc32(t.encode()) % BUCKETS for t in (word, *stems)]


@dataclass
class Machine:
    """slot[bucket] is the bucket's row in linear and factors, or -1."""

    slot: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def scorer(self):
        """text -> probability; remembers the slots of words it has met, a bounded number of them."""
        memo: dict[str, tuple[int, ...]] = {}

        def score(text: str) -> float:
            slots: set[int] = set()
            for word in set(TOKEN.findall(text.lower())):
                known = memo.get(word)
                if known is None:
                    if len(memo) > 200_000:
                        memo.clear()
                    known = memo[word] = tuple(int(s) for s in self.slot[buckets_of(word)] if s >= 0)
                slots.update(known)
            return float(_probability(self.bias, self.linear, self.factors, sorted(slots)))

        return score


def _probability(bias, linear, factors, x):
    v = factors[x]
    margin = bias + linear[x].sum() + 0.5 * (v.sum(axis=0) ** 2 - (v * v).sum(axis=0)).sum()
    return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def _train(rows: list[np.ndarray], y: np.ndarray, start: np.ndarray, passes: int, rate: float, penalty: float, seed: int) -> np.ndarray:
    """Adaptive gradient steps over shuffled rows. A parameter row is (linear, factors); the last row holds the bias."""
    theta, squares = start.copy(), np.full(start.shape, 1e-2)
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        for i in rng.permutation(len(rows)):
            x = rows[i]
            total = theta[x, 1:].sum(axis=0)
            g = _probability(theta[-1, 0], theta[:, 0], theta[:, 1:], x) - y[i]
            step = np.empty((len(x), theta.shape[1]))
            step[:, 0] = g
            step[:, 1:] = g * (total - theta[x, 1:])
            step += penalty * theta[x]
            squares[x] += step * step
            theta[x] -= rate * step / np.sqrt(squares[x])
            squares[-1, 0] += g * g
            theta[-1, 0] -= rate * g / np.sqrt(squares[-1, 0])
    return theta


def _pairs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of a text's words, the smaller first, and their cells."""
    i, j = np.triu_indices(len(words), 1)
    a, b = words[i].astype(np.uint64), words[j].astype(np.uint64)
    return words[i], words[j], ((a * np.uint64(0x9E3779B1) ^ b * np.uint64(0x85EBCA6B)) >> np.uint64(7)).astype(np.int64) % CELLS


def _telling_words(features: DataFrame, frequent: np.ndarray, n: float, ones: float, least_gain: float) -> np.ndarray:
    """Buckets of words that say something beside another word: among the texts with the one, the label depends on the other.

    Pairs are counted in hashed cells first, so that only those are counted exactly whose cell
    depends on the label. What a task holds is bounded by the cells, and the driver gets at most
    one number per cell and per bucket.
    """

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, CELLS), np.int64)
        for batch in batches:
            for y, words in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words.values.to_numpy()
                cell, k = np.unique(_pairs(words[frequent[words]])[2], return_counts=True)
                counts[y, cell] += k
        met = np.nonzero(counts.sum(axis=0))[0]
        yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int32)) for v in (met, counts[:, met].sum(axis=0), counts[1, met])], names=["cell", "df", "a"])

    def gain(n, ones, df, a):
        return F.try_divide(n * F.pow(a * n - df * ones, 2), df * (n - df) * ones * (n - ones))

    df, a = F.col("df"), F.col("a")
    # The labelled sample is bounded, so a few tasks can count it; each sends one row per cell, then one per promising pair.
    rows = features.select("y", "words").coalesce(4)
    counted = rows.mapInArrow(cells, "cell int, df int, a int").groupBy("cell").agg(F.sum("df").alias("df"), F.sum("a").alias("a"))
    promising = np.zeros(CELLS, bool)
    promising[counted.filter((df >= 5) & (df < n) & (gain(n, ones, df, a) >= least_gain)).select("cell").toPandas()["cell"].to_numpy(np.int64)] = True

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed() -> list:
            keys, where = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            return [(keys, *[np.bincount(where, np.concatenate([h[k] for h in held]), len(keys)) for k in (1, 2)])]

        for batch in batches:
            for y, words in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words.values.to_numpy()
                left, right, cell = _pairs(words[frequent[words]])
                keys = (left[promising[cell]].astype(np.int64) << 32) | right[promising[cell]]
                held.append((keys, np.ones(len(keys)), np.full(len(keys), float(y))))
                size += len(keys)
                if size > 1 << 22:
                    held = summed()
                    size = len(held[0][0])
        if size:
            keys, df, a = summed()[0]
            for i in range(0, len(keys), 1 << 16):
                part = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array((keys[part] >> 32).astype(np.int32)), pa.array((keys[part] & 0xFFFFFFFF).astype(np.int32)),
                                                  pa.array(df[part].astype(np.int32)), pa.array(a[part].astype(np.int32))], names=["u", "v", "df", "a"])

    exact = rows.mapInArrow(pairs, "u int, v int, df int, a int").groupBy("u", "v").agg(F.sum("df").alias("df"), F.sum("a").alias("a")).filter(df >= 5)
    one = rows.select("y", F.explode("words").alias("u")).groupBy("u").agg(F.count("*").alias("n_u"), F.sum("y").alias("ones_u"))
    exact = exact.join(one, "u").join(one.select(F.col("u").alias("v"), F.col("n_u").alias("n_v"), F.col("ones_u").alias("ones_v")), "v")
    beside = lambda m, k: F.coalesce(gain(F.col(m).cast("double"), F.col(k), df, a), F.lit(0.0)) >= least_gain
    telling = exact.filter(beside("n_u", "ones_u") | beside("n_v", "ones_v")).select(F.explode(F.array("u", "v")).alias("t")).distinct()
    return telling.toPandas()["t"].to_numpy(np.int64)


def learn(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 20_000,
          rank: int = 4, rounds: int = 4, passes: int = 8, shards: int = 4, rate: float = 0.25, penalty: float = 3e-4, least_gain: float = 10.0,
          least_pair_gain: float = 30.0, seed: int = 11) -> Machine:
    """A machine from the labelled documents.

    At most about ``max_rows`` labelled rows are used, chosen by a hash of the id (null labels,
    ids and texts are skipped; a document without a label is not used; repeated rows count each;
    long texts are read whole). Buckets get parameters if they occur in three texts or more and
    their occurrence depends on the label, alone (chi-square of at least ``least_gain``) or
    beside another word (``least_pair_gain``, of words in one text of 200 or more): a pair of
    neutral words can be what is toxic. Without labelled rows the machine gives every text one half.
    """
    labelled = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).dropna()
    labelled = sampled_rows(labelled, "i", max_rows)
    rows = documents.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("text")).dropna().join(F.broadcast(labelled), "i")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({b for w in set(TOKEN.findall(t.as_py().lower())) for b in buckets_of(w)}) for t in batch.column(1)]
            words = [sorted({buckets_of(w)[0] for w in set(TOKEN.findall(t.as_py().lower()))}) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int32())), pa.array(words, pa.list_(pa.int32()))],
                                             names=["i", "y", "terms", "words"])

    features = written(rows.select(F.col("i").cast("string"), "text", "y").mapInArrow(terms, "i string, y int, terms array<int>, words array<int>"), "terms")
    whole = features.agg(F.count("*").alias("n"), F.sum("y").alias("ones")).first()
    n, ones = float(whole.n), float(whole.ones or 0)
    slot = np.full(BUCKETS, -1, np.int32)
    if not 0 < ones < n:
        return Machine(slot, 0.0 if not n else (40.0 if ones else -40.0), np.zeros(0), np.zeros((0, rank)))
    a, df = F.col("a"), F.col("df")
    gain = n * F.pow(a * n - df * ones, 2) / (df * (n - df) * ones * (n - ones))
    kept = features.select("y", F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df"), F.sum("y").alias("a")).filter(
        (df >= 3) & (df < n) & (gain >= least_gain)).select("t").toPandas()["t"]
    of_words = features.select(F.explode("words").alias("t")).groupBy("t").agg(F.count("*").alias("df")).filter((df >= max(5.0, n / 200)) & (df < n)).select("t").toPandas()["t"]
    frequent = np.zeros(BUCKETS, bool)
    frequent[of_words.to_numpy(np.int64)] = True
    kept = np.union1d(kept.to_numpy(np.int64), _telling_words(features, frequent, n, ones, least_pair_gain))
    slot[kept] = np.arange(len(kept), dtype=np.int32)
    theta = np.random.default_rng(seed).normal(0, 0.01, (len(kept) + 1, rank + 1))
    theta[:, 0] = 0
    theta[-1] = 0
    theta[-1, 0] = np.log(ones / (n - ones))
    dealt = features.withColumn("shard", F.pmod(F.xxhash64("i"), F.lit(shards)).cast("int"))

    def trainer(start: np.ndarray, r: int):
        def train(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("i", kind="stable")
            slots = [slot[np.asarray(t, dtype=np.int64)] for t in part["terms"]]
            found = _train([s[s >= 0] for s in slots], part["y"].to_numpy(float), start, passes, rate / (1 + r), penalty, seed + r)
            return pd.DataFrame({"n": [len(part)], "theta": [found.tobytes()]})

        return train

    for r in range(rounds):
        parts = dealt.groupBy("shard").applyInPandas(trainer(theta, r), "n long, theta binary").collect()
        theta = sum(p.n * np.frombuffer(p.theta).reshape(theta.shape) for p in parts) / sum(p.n for p in parts)
    return Machine(slot, float(theta[-1, 0]), theta[:-1, 0].copy(), theta[:-1, 1:].copy())


def toxicity(machine: Machine, rows: DataFrame, text_col: str = "text") -> Column:
    """Probability (0 to 1) that a whole text is toxic. Null and empty texts get that of a text without known terms."""
    shared = rows.sparkSession.sparkContext.broadcast(machine)  # bounded by the number of buckets

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        of = shared.value.scorer()
        return pa.array([of(t.as_py() or "") for t in texts], pa.float64())

    return score(F.col(text_col).cast("string"))
