"""Which rows of a large master some of few new texts can reach, found by bounds, and how many rows hold the terms that decide it.

A cosine is an exact product over the norm of the master's row. The product needs only the new
texts' terms; the norm lies between two sums, because a word outside the table of frequent words
is in at most as many rows as the rarest word of that table, and a run of two words in at most
as many as the rarer of them, or as all runs of the same hash together. So rows are judged where they are read, and only the terms of
those that can matter are counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwise.functions import tfidf as V
from partwise.functions.text import ngrams, tokens
from partwise.session import stored

#: New texts, and terms of all of them, that are sent to every task; more are matched over postings.
MOST_TEXTS, MOST_TERMS = 1 << 12, 1 << 20
#: Words with a row count that are sent to every task.
FREQUENT_WORDS = 1 << 18
#: Cells in which rows are counted by the hash of a run of two words, and how many of them one row of the sums holds.
CELLS, CHUNK = 1 << 22, 1 << 16
#: Terms whose hashes are sent to every task; more are counted by a join.
WANTED = 1 << 23
#: Rows of a batch that are worked on at a time.
ROWS = 2000
MARGIN = 1e-8


def master_words(rows: DataFrame, text: str, v: V.Vectoriser) -> DataFrame:
    """(pk, words) of every row, split once."""
    return stored(rows.select(V.profile_key([F.coalesce(text, F.lit(""))]).alias("pk"), tokens(F.col(text), v.pattern, v.group).alias("words")), "words")


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def _coded(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Number of the word and row of every place, and the words by number."""
    coded = column.flatten().dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), pc.list_parent_indices(column).to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _single(code: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word, occurrences)."""
    one, tf = np.unique(row * size + code, return_counts=True)
    return one // size, one % size, tf


def _double(code: np.ndarray, row: np.ndarray, size: int, keep=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, second word, occurrences) of the runs of two words, of those that ``keep`` takes."""
    ok = row[:-1] == row[1:]
    if keep is not None:
        ok[ok] = keep(code[:-1][ok], code[1:][ok])
    one, tf = np.unique((row[:-1][ok] * size + code[:-1][ok]) * size + code[1:][ok], return_counts=True)
    return one // size // size, one // size % size, one % size, tf


def _hashes(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def _pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (first * np.uint64(0x9E3779B97F4A7C15)) ^ (second + np.uint64(0x7F4A7C15))


def _inside(x: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    return ascending[np.minimum(np.searchsorted(ascending, x), len(ascending) - 1)] == x if len(ascending) else np.zeros(len(x), bool)


def row_frequencies(words: DataFrame, wanted: DataFrame, longest: int) -> DataFrame:
    """(term, df) of the wanted terms (distinct, of one or two words) that some row holds.

    Hashes of the wanted terms sort out where words are read what need not be counted; the terms themselves decide.
    """
    wanted = stored(wanted.select("term").distinct(), "wanted")
    if longest > 2 or wanted.count() > WANTED:
        every = words.select(F.explode(F.array_distinct(F.concat(*ngrams(F.col("words"), longest)))).alias("term"))
        return every.groupBy("term").agg(F.count("*").alias("df")).join(wanted, "term", "left_semi")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = pc.split_pattern(b.column(0), " ")
            n = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
            h, start = _hashes(parts.flatten()), np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
            last = np.where(n > 1, h[start + n - 1], 0).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(h[start].view(np.int64)), pa.array(last.view(np.int64)), pa.array(n > 1)], ["first", "last", "double"])

    table = wanted.mapInArrow(hashed, "first long, last long, double boolean").toArrow()
    first, last, double = (table.column(i).to_numpy() for i in range(3))
    first, last = first.view(np.uint64), last.view(np.uint64)
    sides = (np.unique(first[~double]), np.unique(first[double]), np.unique(last[double]), np.unique(_pair_hash(first[double], last[double])))
    shared = words.sparkSession.sparkContext.broadcast(sides)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        singles, firsts, lasts, pairs = shared.value
        for b in _slices(batches, ROWS):
            code, row, names = _coded(b.column(0))
            size = len(names)
            if not size:
                continue
            h = _hashes(names)
            one = _inside(h, singles)[code]
            _, at, _ = _single(code[one], row[one], size)
            at, n = np.unique(at, return_counts=True)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(at)), pa.array(n)], ["term", "n"])
            if len(pairs):
                begins, ends = _inside(h, firsts), _inside(h, lasts)

                def keep(a, b):
                    both = begins[a] & ends[b]  # noqa: B023
                    both[both] = _inside(_pair_hash(h[a[both]], h[b[both]]), pairs)  # noqa: B023
                    return both

                _, a, z, _ = _double(code, row, size, keep)
                at, n = np.unique(a * size + z, return_counts=True)
                term = pc.binary_join_element_wise(names.take(pa.array(at // size)), names.take(pa.array(at % size)), " ")
                yield pa.RecordBatch.from_arrays([term, pa.array(n)], ["term", "n"])

    found = words.select("words").mapInArrow(counted, "term string, n long").groupBy("term").agg(F.sum("n").alias("df"))
    return found.join(wanted, "term", "left_semi")


def frequent_words(words: DataFrame) -> tuple[list[str], list[int], int]:
    """At most ``FREQUENT_WORDS`` words with the rows that hold them, and the number of rows that no other word exceeds."""
    counts = stored(words.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df")), "word_counts")
    above = counts.agg(*[F.count_if(F.col("df") > (1 << i)).alias(f"n{i}") for i in range(48)]).first()
    floor = next(1 << i for i in range(48) if above[i] <= FREQUENT_WORDS)
    table = counts.filter(F.col("df") > floor).toArrow()
    return table.column("term").to_pylist(), table.column("df").to_pylist(), floor


def pair_cells(words: DataFrame) -> np.ndarray:
    """Per cell the sum of the rows that hold each run of two words hashed to it, so at least those of any one of them. Sums of whole chunks are shuffled, ``CELLS`` numbers reach the driver."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int32)
        for b in _slices(batches, ROWS):
            code, row, names = _coded(b.column(0))
            if len(names):
                h, (_, a, z, _) = _hashes(names), _double(code, row, len(names))
                total += np.bincount((_pair_hash(h[a], h[z]) % np.uint64(CELLS)).astype(np.int64), minlength=CELLS).astype(np.int32)
        yield from chunks(total.reshape(-1, CHUNK))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for b in batches:
            for chunk, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(counts, np.int32)
        for chunk, counts in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([counts.tobytes()])], ["chunk", "counts"])

    def chunks(total: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in np.flatnonzero(total.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total[i].tobytes()])], ["chunk", "counts"])

    kind, out = "chunk int, counts binary", np.zeros((CELLS // CHUNK, CHUNK), np.int32)
    for r in words.select("words").mapInArrow(counted, kind).repartition("chunk").mapInArrow(added, kind).collect():
        out[r.chunk] = np.frombuffer(r.counts, np.int32)
    return out.reshape(-1)


@dataclass
class Known:
    """What every task knows: words with their idf, bounds for the others, and the new texts' terms with their weights."""

    words: pa.Array
    idf: np.ndarray
    low: float
    high: float
    word_term: np.ndarray  # term of a word, -1: none
    pairs: np.ndarray  # first word * len(words) + second word, ascending
    pair_term: np.ndarray
    term_idf: np.ndarray
    start: np.ndarray  # weights of term t are those from start[t] to start[t + 1]
    name: np.ndarray
    weight: np.ndarray
    names: int
    cells: np.ndarray | None = None  # least idf of the runs of two words of each cell

    def bounds(self, column: pa.ListArray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(products rows x names, least norms, largest norms) of the rows of a batch."""
        n, dots = len(column), np.zeros((len(column), self.names))
        code, row, dictionary = _coded(column)
        size, all_words = len(dictionary), len(self.words)
        if not size:
            return dots, np.ones(n), np.ones(n)
        at = pc.fill_null(pc.index_in(dictionary, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        low, high = np.where(at >= 0, self.idf[at], self.low), np.where(at >= 0, self.idf[at], self.high)
        r, c, tf = _single(code, row, size)
        least, most = np.bincount(r, (tf * low[c]) ** 2, n), np.bincount(r, (tf * high[c]) ** 2, n)
        term = np.where(at[c] >= 0, self.word_term[at[c]], -1)
        hits = [(r[term >= 0], term[term >= 0], tf[term >= 0])]
        if longest > 1:
            r, a, b, tf = _double(code, row, size)
            pair = np.where((at[a] >= 0) & (at[b] >= 0), at[a] * all_words + at[b], -1)
            place = np.minimum(np.searchsorted(self.pairs, pair), max(len(self.pairs) - 1, 0))
            term = np.where(self.pairs[place] == pair, self.pair_term[place], -1) if len(self.pairs) else np.full(len(pair), -1)
            exact, rarer = self.term_idf[np.maximum(term, 0)], np.maximum(low[a], low[b])
            if self.cells is not None:
                h = _hashes(dictionary)
                rarer = np.maximum(rarer, self.cells[(_pair_hash(h[a], h[b]) % np.uint64(len(self.cells))).astype(np.int64)])
            least += np.bincount(r, (tf * np.where(term >= 0, exact, rarer)) ** 2, n)
            most += np.bincount(r, (tf * np.where(term >= 0, exact, self.high)) ** 2, n)
            hits.append((r[term >= 0], term[term >= 0], tf[term >= 0]))
        r, term, tf = (np.concatenate(x) for x in zip(*hits))
        raw, times = tf * self.term_idf[term], self.start[term + 1] - self.start[term]
        step = np.searchsorted(np.cumsum(times), np.arange(0, times.sum() + 1, 1 << 21))
        for i, j in zip(step, [*step[1:], len(r)]):
            t = times[i:j]
            post = np.arange(t.sum()) + np.repeat(self.start[term[i:j]] - (np.cumsum(t) - t), t)
            cell = np.repeat(r[i:j], t) * self.names + self.name[post]
            dots += np.bincount(cell, np.repeat(raw[i:j], t) * self.weight[post], n * self.names).reshape(n, self.names)
        return dots, np.sqrt(np.where(least > 0, least, 1.0)), np.sqrt(np.where(most > 0, most, 1.0))


def _known(counts: list, frequencies: dict[str, int], rows: int, frequent: tuple[list[str], list[int], int]) -> Known:
    idf = lambda df: np.log((1 + rows) / (1 + np.asarray(df, float))) + 1
    words, dfs, floor = frequent
    terms = sorted(frequencies)
    have = set(words)
    more = [t for t in terms if " " not in t and t not in have]
    words, dfs = words + more, dfs + [frequencies[t] for t in more]
    at, term_at = {w: i for i, w in enumerate(words)}, {t: i for i, t in enumerate(terms)}
    # A run of two words is in no more rows than either of them; words of runs that are no terms alone do not exist.
    word_term, term_idf = np.full(max(len(words), 1), -1), idf([frequencies[t] for t in terms])
    pairs = []
    for t, i in term_at.items():
        a, _, b = t.partition(" ")
        if b:
            pairs.append((at[a] * len(words) + at[b], i))
        else:
            word_term[at[t]] = i
    pairs.sort()
    names = {pk: i for i, pk in enumerate(sorted({r.pk for r in counts}))}
    posts = sorted((term_at[r.term], names[r.pk], r.tf) for r in counts if r.term in term_at)
    term, name, tf = (np.array([p[k] for p in posts], np.int64) for k in range(3))
    raw = tf * term_idf[term] if len(posts) else np.zeros(0)
    norm = np.sqrt(np.bincount(name, raw * raw, max(len(names), 1)))
    start = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(terms)))]).astype(np.int64)
    return Known(pa.array(words, pa.string()), idf(dfs) if words else np.zeros(1), float(idf(floor)), float(idf(1)), word_term,
                 np.array([p for p, _ in pairs], np.int64), np.array([i for _, i in pairs], np.int64), term_idf if terms else np.zeros(1), start, name, raw / norm[name], len(names))


def reachable(n_counts: DataFrame, words: DataFrame, v: V.Vectoriser, rows: int, threshold: float | None, most: int | None) -> DataFrame | None:
    """(n_pk, m_pk, dot): pairs that can be among a new text's ``most`` best rows at or above the threshold, with the score times the norm of the master's text; None if the new texts are too many.

    ``n_counts`` are the (pk, term, tf) of the new texts, ``words`` the (pk, words) of the master's ``rows`` rows.
    """
    if n_counts.count() > MOST_TERMS or n_counts.select("pk").distinct().count() > MOST_TEXTS:
        return None
    counts = n_counts.select("pk", "term", "tf").collect()
    frequencies = {r.term: r.df for r in row_frequencies(words, n_counts.select("term"), v.longest).collect()}
    known = _known(counts, frequencies, rows, frequent_words(words))
    if v.longest > 1 and not threshold:
        # Without a threshold many rows come near the last of the best, so narrower bounds pay.
        known.cells = (np.log((1 + rows) / (1 + np.minimum(pair_cells(words), rows).astype(np.float32))) + 1 - 1e-4).astype(np.float32)
    shared, longest, least = words.sparkSession.sparkContext.broadcast((known, sorted({r.pk for r in counts}))), v.longest, (threshold or 0.0) - MARGIN
    step = max(1, min(ROWS, (1 << 22) // max(known.names, 1)))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, names), floor = shared.value, least
        names = pa.array(names, pa.string())
        best = np.full((most or 0, known.names), -1.0)
        for b in _slices(batches, step):
            dots, small, large = known.bounds(b.column(1), longest)
            lower, upper = dots / large[:, None], dots / small[:, None]
            if most:
                # The most best rows so far are at least so good, so nothing below the last of them matters.
                best = np.sort(np.concatenate([best, lower]), axis=0)[-most:]
                floor = np.maximum(best[0] - MARGIN, least)
            # One row of each text: copies have the same bounds.
            once = np.unique(pc.dictionary_encode(b.column(0)).indices.to_numpy(zero_copy_only=False), return_index=True)[1]
            r, name = np.nonzero((dots[once] > 0) & (upper[once] >= floor))
            r = once[r]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(name)), b.column(0).take(pa.array(r)), *(pa.array(x[r, name]) for x in (dots, lower, upper))], ["n_pk", "m_pk", "dot", "lower", "upper"])

    found = stored(words.mapInArrow(judged, "n_pk string, m_pk string, dot double, lower double, upper double"), "bounds")
    if most:
        rank = F.expr("row_number() OVER (PARTITION BY n_pk ORDER BY lower DESC)")
        floors = found.withColumn("at", rank).filter(F.col("at") == most).select("n_pk", F.col("lower").alias("floor"))
        found = found.join(F.broadcast(floors), "n_pk", "left").filter(F.col("floor").isNull() | (F.col("upper") >= F.col("floor") - MARGIN))
    # Rows with the same text have the same product.
    return found.groupBy("n_pk", "m_pk").agg(F.any_value("dot").alias("dot"))
