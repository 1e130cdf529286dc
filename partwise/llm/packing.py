"""Tokenised documents packed into sequences of a fixed capacity, by matching large pieces and best-fitting small ones.

Pieces of one length are interchangeable, so the packing is planned on the histogram of lengths
alone: at most ``capacity`` numbers, however many documents there are. Pieces above a third of
the capacity go at most two to a bin and are matched greedily, the largest with the largest
partner that still fits; the others fill the remaining gaps in descending order, each the
tightest gap that holds it, before a new bin is opened. The plan says for ranges of ranks within
a length which bins they go to; Spark ranks the pieces and looks their places up.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partwise.llm.common import written

#: The split pattern of byte-level BPE, and the same without its look-ahead, which only double white space needs.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
#: Characters that every Unicode version since 5 classifies alike, so that two regex engines split them alike.
COMMON = re.compile("[\t\n\r -~¡-ɏЀ-џ‐-‧、-】ぁ-ゔァ-ヺ一-龥가-힣！-～]*")
DOUBLE = re.compile(r"\s\s")


def _byte_alphabet() -> dict[str, int]:
    """Byte-level BPE writes byte b as chr(b) where that is visible, else as the next character from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> list of ids, as ``tokenizers`` gives them for the file at ``path`` without special tokens added.

    A byte-level BPE whose ids are in merge order is also what ``tiktoken`` computes, several
    times faster; texts with special tokens, unusual characters, or another kind of file go
    through ``tokenizers`` itself.
    """
    spec = json.load(open(path, encoding="utf-8"))
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    slow: list = []

    def reference(text: str) -> list[int]:
        if not slow:
            from tokenizers import Tokenizer

            slow.append(Tokenizer.from_file(path))
        return slow[0].encode(text, add_special_tokens=False).ids

    alphabet, vocab = _byte_alphabet(), model.get("vocab", {})
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
    plain_bpe = (model.get("type") == "BPE" and spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
                 and pre.get("use_regex", True) and not model.get("dropout") and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(pairs)))
    if not plain_bpe:
        return reference
    import tiktoken

    special = [t["content"] for t in spec.get("added_tokens", [])]
    ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items() if t not in special}
    full, plain = (tiktoken.Encoding(n, pat_str=p, mergeable_ranks=ranks, special_tokens={}) for n, p in (("full", PATTERN), ("plain", PLAIN)))

    def encode(text: str) -> list[int]:
        if any(s in text for s in special) or not COMMON.fullmatch(text):
            return reference(text)
        return (full if DOUBLE.search(text) else plain).encode_ordinary(text)

    return encode


def pieces(documents: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(id, piece, start, length, ids_crc32, ids): each whole text's token ids and ``end_id``, cut only where longer than ``capacity``.

    All pieces of a cut document have the full length except the first. A null text is empty and
    gives the end id alone. ``with_ids=False`` leaves the ids null, for jobs that only place pieces.
    """
    id_type = documents.schema[id_col].dataType.simpleString()
    docs = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                tokens = np.array([*encode(text.as_py()), end_id], dtype="<u4")
                first = len(tokens) % capacity or capacity
                edges = [0, *range(first, len(tokens) + 1, capacity)]
                for n, (a, b) in enumerate(zip(edges, edges[1:])):
                    row.append(i), piece.append(n), start.append(a), length.append(b - a)
                    crc.append(zlib.crc32(tokens[a:b]))
                    ids.append(tokens[a:b].astype("i4") if with_ids else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                 pa.array(crc, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["id", "piece", "start", "length", "ids_crc32", "ids"])

    return docs.mapInArrow(cut, f"id {id_type}, piece int, start long, length long, ids_crc32 long, ids array<int>").withColumnRenamed("id", id_col)


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Places for all pieces of a length histogram, and the number of bins.

    A row (length, rank, bin, per_bin, offset) places the pieces of that length from that rank
    on, up to the next row's: ``per_bin`` next to each other from ``offset`` in the given bin, as
    many in the following one, and so on.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    rank = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> (first bin, number of bins), the bins of a group filled alike
    bins = 0

    def place(length: int, number: int, first: int, per_bin: int, offset: int) -> None:
        rows.append((length, rank[length], first, per_bin, offset))
        rank[length] += number
        left[length] -= number

    def leave(gap: int, first: int, number: int) -> None:
        if gap and number:
            gaps.setdefault(gap, []).append((first, number))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for a in large:
        for b in [n for n in large if n <= min(a, capacity - a)]:
            if b == a:
                twos = left[a] // 2
                if twos:
                    place(a, 2 * twos, bins, 2, 0)
            else:
                twos = min(left[a], left[b])
                if twos:
                    place(a, twos, bins, 1, 0)
                    place(b, twos, bins, 1, a)
            leave(capacity - a - b, bins, twos)
            bins += twos
            if not left[a]:
                break
        if left[a]:
            leave(capacity - a, bins, left[a])
            bins += left[a]
            place(a, left[a], bins - left[a], 1, 0)

    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        for gap in sorted(g for g in gaps if g >= n):
            for first, number in gaps.pop(gap):
                per_bin = gap // n
                take = min(left[n], number * per_bin)
                if take:
                    place(n, take, first, per_bin, capacity - gap)
                full, rest = divmod(take, per_bin)
                leave(gap - per_bin * n, first, full)
                if rest:
                    leave(gap - rest * n, first + full, 1)
                leave(gap, first + full + (rest > 0), number - full - (rest > 0))
            if not left[n]:
                break
        if left[n]:
            per_bin = capacity // n
            full, rest = divmod(left[n], per_bin)
            leave(capacity - per_bin * n, bins, full)
            if rest:
                leave(capacity - rest * n, bins + full, 1)
            opened = full + (rest > 0)
            place(n, left[n], bins, per_bin, 0)
            bins += opened
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5), bins


def pack(items: DataFrame, capacity: int, order: list[str], length_col: str = "length") -> DataFrame:
    """``items`` (lengths 1 to ``capacity``) with sequence_id and offset; the items of a sequence lie gapless from 0 and none overlap.

    ``items`` must be deterministic (a table), since it is read twice; ``order`` makes the ranks
    repeatable. Ranks within a length are counted in hash buckets first, so that a length which
    very many items share is dealt over many tasks. What reaches the driver is one count per length.
    """
    held = dict(items.groupBy(length_col).count().collect())
    total = sum(held.values())
    rows, _ = plan(held, capacity)
    starts = rows[:, 0] * (1 << 44) + rows[:, 1]
    buckets = 64 + total // 100_000
    dealt = items.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    per_bucket = dealt.groupBy(length_col, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(length_col).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = per_bucket.select(length_col, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy(length_col, "_bucket").orderBy(*order))
    ranked = dealt.withColumn("_inside", inside).join(base, [length_col, "_bucket"]).withColumn("_rank", F.col("_base") + F.col("_inside") - 1)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = rows[np.searchsorted(starts, length.to_numpy() * (1 << 44) + rank.to_numpy(), "right") - 1]
        ahead, within = np.divmod(rank.to_numpy() - at[:, 1], at[:, 3])
        return pd.DataFrame({"sequence_id": at[:, 2] + ahead, "offset": at[:, 4] + within * length.to_numpy()})

    return ranked.withColumn("_place", place(F.col(length_col).cast("long"), "_rank")).select(*items.columns, "_place.*")


def pack_documents(documents: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
                   with_ids: bool = True) -> DataFrame:
    """Every piece of every document with its place: id, piece, start, length, ids_crc32, ids, sequence_id, offset.

    Null and empty texts give one piece with the end id; repeated rows are packed as often as
    they stand; an empty table gives no piece; other columns are ignored.
    """
    cut = written(pieces(documents, tokenizer, capacity, end_id, id_col, text_col, with_ids), "pieces")
    return pack(cut, capacity, [id_col, "piece"])


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the filled sequences. A sequence holds at most ``capacity`` ids, so a group is bounded."""
    grouped = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return grouped.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))
