"""Runs of words counted in Arrow batches: terms are numbers in the tasks, and only sums leave them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partwise.functions.text import tokens
from partwise.session import stored


@dataclass
class Runs:
    """Known runs of words, one level per length. A run of k + 1 words is a pair of runs of k words, the second one word on."""

    words: list[str] = field(default_factory=list)
    pairs: list[np.ndarray] = field(default_factory=list)  # per level from 2 on: first * size of the level below + second, ascending

    @classmethod
    def of(cls, terms: list[str]) -> tuple[Runs, np.ndarray]:
        """The runs of ``terms`` and of all their parts, and for each (levels one after the other) its place in ``terms``, -1 for a mere part."""
        cut = [t.split(" ") for t in terms]
        levels, place = [], {t: i for i, t in enumerate(terms)}
        for k in range(1, max(map(len, cut), default=1) + 1):
            levels.append(sorted({" ".join(w[i:i + k]) for w in cut for i in range(len(w) - k + 1)}))
        out, order = cls(levels[0]), [levels[0]]
        for level in levels[1:]:
            at, size = {t: i for i, t in enumerate(order[-1])}, len(order[-1])
            pairs = sorted((at[t.rsplit(" ", 1)[0]] * size + at[t.split(" ", 1)[1]], t) for t in level)
            out.pairs.append(np.array([p for p, _ in pairs], np.int64))
            order.append([t for _, t in pairs])
        return out, np.array([place.get(t, -1) for level in order for t in level], np.int64)

    def sizes(self) -> list[int]:
        return [len(self.words), *map(len, self.pairs)]

    def found(self, column: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per level the number of the run at each place of the batch (-1: not known), with the batch row of the place."""
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        row = pc.list_parent_indices(column).to_numpy(zero_copy_only=False)
        at = pc.fill_null(pc.index_in(column.flatten(), value_set=pa.array(self.words, pa.string())), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        out = [(at, row)]
        for size, known in zip(self.sizes(), self.pairs):
            pair, row = adjacent(at, row, size)
            place = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
            at = np.where((pair >= 0) & (known[place] == pair), place, -1) if len(known) else np.full(len(pair), -1)
            out.append((at, row))
        return out


def adjacent(at: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbouring runs of one row as numbers, -1 where one of them is not known."""
    ok = (at[:-1] >= 0) & (at[1:] >= 0) & (row[:-1] == row[1:])
    return np.where(ok, at[:-1] * size + at[1:], -1), row[:-1]


def words_of(texts: DataFrame, text: Column, pattern: str, group: int) -> DataFrame:
    return texts.select(tokens(text, pattern, group).alias("words"))


def next_counts(words: DataFrame, known: Runs) -> DataFrame:
    """(pair, cf): occurrences of the runs one word longer than the longest known ones, both of whose parts are known."""
    shared = words.sparkSession.sparkContext.broadcast(known)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = shared.value.sizes()[-1]
        total, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            pair, _ = adjacent(*shared.value.found(b.column(0))[-1], size)
            one, m = np.unique(pair[pair >= 0], return_counts=True)
            total, back = np.unique(np.concatenate([total, one]), return_inverse=True)
            n = np.bincount(back, np.concatenate([n, m]), len(total)).astype(np.int64)
        for i in range(0, len(total), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(total[i:i + 100_000]), pa.array(n[i:i + 100_000])], ["pair", "cf"])

    return words.mapInArrow(counted, "pair long, cf long").groupBy("pair").agg(F.sum("cf").alias("cf"))


def row_counts(words: DataFrame, known: Runs) -> np.ndarray:
    """Number of rows that hold each known run, levels one after the other. The driver gets one number per run."""
    shared = words.sparkSession.sparkContext.broadcast(known)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = shared.value.sizes()
        total = np.zeros(sum(sizes), np.int64)
        for b in batches:
            first = 0
            for (at, row), size in zip(shared.value.found(b.column(0)), sizes):
                one = np.unique(row[at >= 0].astype(np.int64) * max(size, 1) + at[at >= 0])
                total[first:first + size] += np.bincount(one % max(size, 1), minlength=size)[:size]
                first += size
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    out = np.zeros(sum(known.sizes()), np.int64)
    for r in words.mapInArrow(counted, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r.at] = r.n
    return out


def frequent_runs(texts: DataFrame, text: Column, pattern: str, group: int, limits: dict[str, tuple[int, int]]) -> dict[str, list[tuple[str, int]]]:
    """For each name its (longest, most): the ``most`` most frequent runs of up to ``longest`` words with the rows that hold them, ties in code-point order.

    A run occurs at most as often as either run one word shorter inside it. So only runs whose
    parts are as frequent as the last one kept so far are counted, shortest first. What reaches
    the driver are the runs at or above that frequency: as many as are asked for, more only where they tie.
    """
    # Splitting is most of the work, so it is done once.
    words = stored(words_of(texts, text, pattern, group), "words")
    most = max(m for _, m in limits.values())
    counts = words.select(F.explode("words").alias("term")).groupBy("term").agg(F.count("*").alias("cf"))
    known, terms, cfs = Runs(), [], []

    def at_least(rows: DataFrame) -> list:
        """Rows of the level that can be among the ``most``, with those of the shorter levels that are already there."""
        best = [r.cf for r in rows.select("cf").orderBy(F.desc("cf")).limit(most).collect()]
        floor = sorted([*(c for level in cfs for c in level), *best], reverse=True)[:most]
        return rows.filter(F.col("cf") >= (floor[-1] if len(floor) == most else 0)).collect()

    first = sorted(at_least(counts.persist()), key=lambda r: r.term)
    counts.unpersist()
    known.words, terms, cfs = [r.term for r in first], [[r.term for r in first]], [[r.cf for r in first]]
    for _ in range(2, max(n for n, _ in limits.values()) + 1):
        pairs = next_counts(words, known).persist()
        kept = sorted(at_least(pairs), key=lambda r: r.pair)
        pairs.unpersist()
        size = len(terms[-1])
        known.pairs.append(np.array([r.pair for r in kept], np.int64))
        cfs.append([r.cf for r in kept])
        terms.append([terms[-1][r.pair // size] + " " + terms[-1][r.pair % size].rsplit(" ", 1)[-1] for r in kept])
    rows = row_counts(words, known)
    flat = [(t, c, k) for k, (ts, cs) in enumerate(zip(terms, cfs), 1) for t, c in zip(ts, cs)]
    out = {}
    for name, (longest, m) in limits.items():
        best = sorted((i for i, x in enumerate(flat) if x[2] <= longest), key=lambda i: (-flat[i][1], flat[i][0]))[:m]
        out[name] = [(flat[i][0], int(rows[i])) for i in best]
    return out


def _weights(b: pa.RecordBatch, known: Runs, place: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, w) of the batch (ident, words), ascending by row."""
    hits, first, size = [np.zeros(0, np.int64)], 0, max(len(idf), 1)
    for (at, row), n in zip(known.found(b.column(1)), known.sizes()):
        term = place[first + at[at >= 0]]
        hits.append((row[at >= 0].astype(np.int64) * size + term)[term >= 0])
        first += n
    one, tf = np.unique(np.concatenate(hits), return_counts=True)
    row, term = one // size, one % size
    raw = tf * idf[term]
    return row, term, raw / np.sqrt(np.bincount(row, raw * raw, b.num_rows))[row]


def row_weights(rows: DataFrame, ident: str, text: Column, pattern: str, group: int, terms: list[tuple[str, float]]) -> DataFrame:
    """(ident, term, w): the weight tf * idf of each of the (term, idf) in each row, of unit length per row; rows without any are left out.

    Each row is weighed where it is read, so nothing is shuffled; the terms are broadcast.
    """
    known, place = Runs.of([t for t, _ in terms])
    shared = rows.sparkSession.sparkContext.broadcast((known, place, [t for t, _ in terms], np.array([w for _, w in terms])))
    words = rows.select(ident, tokens(text, pattern, group).alias("words"))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place, names, idf = shared.value
        names = pa.array(names, pa.string())
        for b in batches:
            row, term, w = _weights(b, known, place, idf)
            for i in range(0, len(row), 200_000):
                part = slice(i, i + 200_000)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[part])), names.take(pa.array(term[part])), pa.array(w[part])], [ident, "term", "w"])

    return words.mapInArrow(weighed, f"`{ident}` {words.schema[ident].dataType.simpleString()}, term string, w double")


def row_scores(rows: DataFrame, ident: str, text: Column, pattern: str, group: int, terms: list[tuple[str, float]], names: list[str], vectors: np.ndarray,
               threshold: float, most: int, margin: float = 1e-8) -> DataFrame:
    """(ident, name, s): cosine of each row with each named vector (terms x names), where it reaches ``threshold`` less a margin.

    Terms and vectors are broadcast and each row is compared where it is read. Of a name's rows a
    task gives its ``most`` best of each batch, with all that are within the margin of the last one.
    """
    known, place = Runs.of([t for t, _ in terms])
    shared = rows.sparkSession.sparkContext.broadcast((known, place, np.array([w for _, w in terms]), names, vectors))
    words = rows.select(ident, tokens(text, pattern, group).alias("words"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place, idf, names, vectors = shared.value
        names = pa.array(names, pa.string())
        step = max(1, (1 << 22) // max(vectors.shape[1], 1))
        for b in batches:
            row, term, w = _weights(b, known, place, idf)
            found = []
            start = 0
            while start < len(row):
                # Whole rows, some four million products at a time.
                end = len(row) if start + step >= len(row) else max(int(np.searchsorted(row, row[start + step])), int(np.searchsorted(row, row[start], "right")))
                one, first = np.unique(row[start:end], return_index=True)
                s = np.add.reduceat(vectors[term[start:end]] * w[start:end, None], first)
                at, name = np.nonzero(s >= threshold - margin)
                found.append((one[at], name, s[at, name]))
                start = end
            if not found:
                continue
            r, name, s = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((-s, name))
            r, name, s = r[order], name[order], s[order]
            head = np.searchsorted(name, name)
            tail = np.searchsorted(name, name, "right") - 1
            keep = s >= s[np.minimum(head + most - 1, tail)] - margin
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r[keep])), names.take(pa.array(name[keep])), pa.array(s[keep])], [ident, "name", "s"])

    return words.mapInArrow(scored, f"`{ident}` {words.schema[ident].dataType.simpleString()}, name string, s double")
