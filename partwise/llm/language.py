"""Language identification with bit-sliced Bloom filters over byte n-grams.

Every language has a Bloom filter of the n-grams that are typical of it. The filters are stored
bit-sliced: at each bit position stands a mask with one bit per language, so that the
conjunction of an n-gram's positions gives at once all languages that contain it. A text's
count for a language is how many of its n-grams have that language's bit, less what the
filter's false positives add on average. The language with the most decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers that are written with other signs than digits: halves, circled and Roman numbers.
NUMBER_SIGNS = frozenset(c for c in map(chr, range(0x80, 0x20000)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())
NOT_LETTERS = re.compile(r"[\W\d_]+")
OTHERS = re.compile(rf"[ {''.join(sorted(NUMBER_SIGNS))}]+")


def letters_of(text: str) -> str:
    """The lower-cased letters of a text, with one space for whatever is between them."""
    found = NOT_LETTERS.sub(" ", text.lower())
    # Few texts have number signs, and looking for them one by one is slow.
    if not found.isascii() and not NUMBER_SIGNS.isdisjoint(found):
        found = OTHERS.sub(" ", found)
    return found.strip()
UNKNOWN = "und"
SIZES = (3, 5)
#: Odd multipliers of the hash functions, one for each probe.
PROBES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def grams(text: str) -> np.ndarray:
    """The byte n-grams of a text's lower-cased letters, each word between spaces, as numbers; empty where it has no letter."""
    letters = letters_of(text)
    if not letters:
        return np.zeros(0, np.uint64)
    b = np.frombuffer(f" {letters} ".encode(), np.uint8).astype(np.uint64)
    found = []
    for n in SIZES:
        windows = max(0, len(b) - n + 1)  # a text of one letter has none of the longer n-grams
        g = np.full(windows, n, np.uint64)
        for i in range(n):
            g = g << np.uint64(8) | b[i:windows + i]
        found.append(g)
    return np.concatenate(found)


def positions(g: np.ndarray, bits: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        mixed = [g * np.uint64(p) for p in PROBES]
        return [((m ^ m >> np.uint64(29)) * np.uint64(PROBES[0]) >> np.uint64(64 - bits)).astype(np.int64) for m in mixed]


@dataclass
class Filters:
    """languages in order, masks[position, word] with bit i of word w for language 64 w + i, and each language's false-positive rate."""

    languages: list[str]
    masks: np.ndarray
    false_rate: np.ndarray

    def shares(self, text: str) -> tuple[np.ndarray, int]:
        """Corrected share of the text's n-grams found in each language, and their number."""
        g = grams(text)
        if not len(g):
            return np.zeros(len(self.languages)), 0
        at = positions(g, int(self.masks.shape[0]).bit_length() - 1)
        hits = np.zeros(len(self.languages))
        for w in range(self.masks.shape[1]):
            m = self.masks[at[0], w]
            for p in at[1:]:
                m = m & self.masks[p, w]
            for i in range(min(64, len(self.languages) - 64 * w)):
                hits[64 * w + i] = np.count_nonzero(m & np.uint64(1 << i))
        share = hits / len(g)
        return np.clip((share - self.false_rate) / (1 - self.false_rate), 0, 1), len(g)

    def predict(self, text: str | None) -> tuple[str, float]:
        share, n = self.shares(text or "")
        if not n or not self.languages:
            return UNKNOWN, 0.0
        best, weight = int(share.argmax()), share * share
        return self.languages[best], float(weight[best] / weight.sum()) if weight.sum() > 0 else 0.0


def learn(rows: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", docs_per_language: int = 3000,
          min_share: float = 0.004, rival: float = 0.1, bits: int = 21, max_languages: int = 1024) -> Filters:
    """Filters from labelled rows (null labels and texts are skipped).

    About ``docs_per_language`` whole texts of each language are used, chosen by a hash of the
    id. An n-gram is typical of a language if at least ``min_share`` of its texts (and two) have
    it, and their share is at least ``rival`` of that in any other language. The driver gets at
    most ``2 ** bits`` positions; more than ``max_languages`` languages are an error.
    """
    rows = rows.select(F.col(id_col).alias("i"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).dropna(
        subset=["lang", "text"])
    counts = dict(rows.groupBy("lang").count().limit(max_languages + 1).collect())
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    languages = sorted(counts)
    words = -(-max(len(languages), 1) // 64)
    if not languages:
        return Filters([], np.zeros((1 << bits, 1), np.uint64), np.zeros(0))
    keep = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, docs_per_language / counts[k]))])
    draw = F.pmod(F.xxhash64(F.col("i").cast("string"), F.lit("language")), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.filter(draw < F.element_at(keep, F.col("lang"))).select(F.array_position(F.lit(languages), F.col("lang")).cast("int").alias("l"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of: dict[int, list[np.ndarray]] = {}
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                of.setdefault(k, []).append(np.unique(grams(text.as_py())))
                of.setdefault(-k, []).append(np.zeros(1, np.uint64))  # gram 0 counts the texts
            for k, found in of.items():
                g, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), abs(k), np.int32)), pa.array(g.view(np.int64)), pa.array(n)], names=["l", "g", "n"])

    counted = sample.mapInArrow(count, "l int, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n"))
    seen = dict(counted.filter("g = 0").select("l", "n").collect())
    texts = F.create_map(*[F.lit(x) for k, v in seen.items() for x in (k, float(v))]) if seen else F.create_map(F.lit(0), F.lit(1.0))
    share = (F.col("n") / F.element_at(texts, F.col("l"))).alias("s")
    by_gram = counted.filter("g <> 0 AND n >= 2").select("g", "l", share).groupBy("g").agg(F.collect_list(F.struct("s", "l")).alias("in"), F.max("s").alias("top"))
    typical = by_gram.filter(F.col("top") >= min_share).select("g", F.explode("in").alias("x"), "top").filter(
        (F.col("x.s") >= min_share) & (F.col("x.s") >= rival * F.col("top")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, k = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy() - 1
            for p in positions(g, bits):
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array((k // 64).astype(np.int32)), pa.array((np.uint64(1) << (k % 64).astype(np.uint64)).view(np.int64))],
                                                 names=["p", "w", "m"])

    placed = typical.select("g", F.col("x.l").alias("l")).mapInArrow(place, "p long, w int, m long").groupBy("p", "w").agg(F.expr("bit_or(m)").alias("m"))
    filled = placed.toArrow()
    masks = np.zeros((1 << bits, words), np.uint64)
    masks[filled.column(0).to_numpy(), filled.column(1).to_numpy()] = filled.column(2).to_numpy().view(np.uint64)
    fill = np.array([np.count_nonzero(masks[:, i // 64] & np.uint64(1 << i % 64)) for i in range(len(languages))]) / (1 << bits)
    return Filters(languages, masks, fill ** len(PROBES))


def identify(filters: Filters, rows: DataFrame, text_col: str = "text") -> Column:
    """struct(lang_pred, score) of each whole text: the language, and the square of its share over the sum of all squares (0 to 1).

    Null texts and texts without a letter are ``und`` with score 0; a text none of whose n-grams
    is known gets the first language with score 0. The text is the only input.
    """
    shared = rows.sparkSession.sparkContext.broadcast(filters)  # bounded: 2 ** bits masks

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        got = []
        for t in texts:
            t = t.as_py() or ""
            got.append(shared.value.predict(t))
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["lang_pred", "score"])

    return predict(F.col(text_col).cast("string"))
