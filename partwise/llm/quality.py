"""Document quality by kernel ridge regression on document statistics, calibrated by isotonic regression.

A text is described by some twenty statistics of its characters, words and lines. Random Fourier
features of the standardised statistics approximate a Gaussian kernel, the normal equations of
the ridge regression are summed per partition and fold, and the scores that each fold gets from
the other folds' equations fix a monotone map to probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATISTICS = ("log_chars log_words log_lines word_length word_length_sd unique_words unique_pairs top_word short_words long_words upper digits "
              "sentence_marks commas symbols pipes non_ascii white_space words_per_line repeated_lines symbol_words upper_words marks_per_line").split()


def _table(characters: str) -> np.ndarray:
    hit = np.zeros(256, bool)
    hit[list(characters.encode())] = True
    return hit


UPPER, DIGIT, MARK, COMMA = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789"), _table(".!?"), _table(",;:")
SYMBOL, PIPE, WHITE = _table("#$%&*+<=>@[\\]^_`{|}~/"), _table("|"), _table(" \t\n\r\x0b\x0c")


def statistics(text: str) -> list[float]:
    """The statistics of a whole text, in the order of ``STATISTICS``; all zero for an empty one."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, m = len(raw), len(words)
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), np.float64, m)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = lambda hit: float(byte[hit].sum()) / n
    ends = np.fromiter((w[-1] for w in words), np.uint8, m)
    return [
        np.log1p(n), np.log1p(m), np.log1p(len(lines)), lengths.mean(), lengths.std(), len(counts) / m, len(set(zip(words, words[1:]))) / max(1, m - 1),
        max(counts.values()) / m, float((lengths <= 3).mean()), float((lengths >= 12).mean()), share(UPPER), share(DIGIT), share(MARK), share(COMMA),
        share(SYMBOL), share(PIPE), float(byte[128:].sum()) / n, share(WHITE), np.log1p(m / len(lines)), 1 - len(set(lines)) / len(lines),
        float(SYMBOL[ends].mean()), sum(w.isupper() for w in words) / m, float(byte[MARK].sum()) / len(lines)]


def statistics_column(text_col: str = "text") -> Column:
    """The statistics as array<double>; null texts count as empty."""

    @F.arrow_udf("array<double>")
    def described(texts: pa.Array) -> pa.Array:
        return pa.array([[float(x) for x in statistics(t.as_py() or "")] for t in texts], pa.list_(pa.float64()))

    return described(F.col(text_col).cast("string"))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray  # the last one is the intercept
    knots: np.ndarray  # ridge scores, ascending
    levels: np.ndarray  # their probabilities, ascending

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.phases)) * np.cos(z @ self.waves + self.phases), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.features(x) @ self.weights, self.knots, self.levels)


def isotonic(scores: np.ndarray, ones: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (mean score, mean label) of the blocks, both ascending. Inputs are bins in ascending order of score."""
    blocks: list[list[float]] = []
    for s, o, m in zip(scores, ones, n):
        blocks.append([s * m, o, m])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def learn(described: DataFrame, labels: DataFrame, id_col: str = "doc_id", stats_col: str = "stats", label_col: str = "quality", waves: int = 256,
          width: float = 0.6, ridge: float = 1e-3, folds: int = 4, bins: int = 400, leaves: int = 1024, seed: int = 5) -> Model | None:
    """A model from all rows of ``described`` (id, statistics; a table) that ``labels`` marks 0 or 1; None without any.

    Sums over rows are made in at most ``leaves`` tasks of several partitions each and then part by
    part over those, so the driver gets them once, ``folds`` times ``waves`` squared numbers, and
    ``bins`` rows for the calibration, whatever the number of partitions. Whole texts are described before; a repeated row counts as often as it stands.
    Null labels and ids are skipped. A row's fold is a hash of its id.
    """
    marked = labels.select(F.col(id_col).alias("_i"), F.col(label_col).cast("double").alias("y")).dropna()
    rows = described.select(F.col(id_col).alias("_i"), F.col(stats_col).alias("x")).join(marked, "_i").select(
        F.pmod(F.xxhash64(F.col("_i").cast("string"), F.lit("fold")), F.lit(folds)).cast("int").alias("fold"), "x", "y").persist()
    d = len(STATISTICS)
    moments = rows.agg(F.count("*").alias("n"), F.avg("y").alias("y"), *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(d)],
                       *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(d)]).first()
    if not moments.n:
        return None
    scale = np.array([moments[f"s{i}"] for i in range(d)])
    rng = np.random.default_rng(seed)
    model = Model(np.array([moments[f"m{i}"] for i in range(d)]), np.where(scale > 1e-9, scale, 1.0), rng.normal(0, 1 / (width * np.sqrt(d)), (d, waves)),
                  rng.uniform(0, 2 * np.pi, waves), np.zeros(waves + 1), np.zeros(1), np.array([moments.y]))
    k = waves + 1

    cuts = 4  # a fold's equations leave a task in so many parts, which are summed apart

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for part in batches:
            if len(part):
                total = np.zeros((folds, k, k + 1)) if total is None else total
                z, y, fold = model.features(np.array(part["x"].tolist())), part["y"].to_numpy(), part["fold"].to_numpy()
                for f in np.unique(fold):
                    at = fold == f
                    total[f] += np.hstack([z[at].T @ z[at], (z[at].T @ y[at])[:, None]])
        if total is not None:
            for i, piece in enumerate(np.array_split(total.ravel(), folds * cuts)):
                yield pd.DataFrame({"part": [i], "s": [piece.tobytes()]})

    def joined(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for frame in parts:
            for i, s in zip(frame["part"], frame["s"]):
                total[i] = total[i] + np.frombuffer(s) if i in total else np.frombuffer(s)
        # Nothing from a task without sums, however many such tasks there are.
        if total:
            yield pd.DataFrame({"part": list(total), "s": [s.tobytes() for s in total.values()]})

    parts = rows.coalesce(leaves).mapInPandas(summed, "part int, s binary").repartition(folds * cuts, "part").mapInPandas(joined, "part int, s binary").collect()
    by_fold = np.concatenate([np.frombuffer(r.s) for r in sorted(parts, key=lambda r: r.part)]).reshape(folds, k, k + 1)

    def solved(m: np.ndarray) -> np.ndarray:
        return np.linalg.solve(m[:, :k] + ridge * max(m[-1, k - 1], 1.0) * np.diag([1.0] * waves + [1e-9]), m[:, k])

    without = [solved(by_fold.sum(axis=0) - by_fold[f]) for f in range(folds)]

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            z = model.features(np.array(part["x"].tolist()))
            s = np.einsum("ij,ij->i", z, np.array(without)[part["fold"].to_numpy()])
            yield pd.DataFrame({"bin": np.clip((s + 0.5) / 2 * bins, 0, bins - 1).astype(int), "s": s, "y": part["y"]})

    held = rows.mapInPandas(binned, "bin int, s double, y double").groupBy("bin").agg(F.avg("s").alias("s"), F.sum("y").alias("y"), F.count("*").alias("n")).toPandas()
    held = held.sort_values("bin")
    model.weights = solved(by_fold.sum(axis=0))
    model.knots, model.levels = isotonic(held["s"].to_numpy(), held["y"].to_numpy(), held["n"].to_numpy(dtype=float))
    rows.unpersist()
    return model


def quality(model: Model | None, rows: DataFrame, stats_col: str = "stats") -> Column:
    """Probability (0 to 1) that a document has label 1; one half where there is no model."""
    if model is None:
        return F.lit(0.5)
    shared = rows.sparkSession.sparkContext.broadcast(model)  # bounded by the number of waves

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(np.array(x.tolist())) if len(x) else np.zeros(0))

    return score(F.col(stats_col))
