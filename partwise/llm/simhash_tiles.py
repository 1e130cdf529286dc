"""SimHash near-duplicates by tiled exact comparison.

Equal fingerprints are one node. Distinct fingerprints are put into tiles by the population
counts of their four 16-bit quarters; the counts of two fingerprints that differ in d bits
differ by at most d in sum, so a tile is compared only with tiles within that distance, and the
comparison inside a pair of tiles is an exact exclusive-or and bit count in numpy. A tile with
many fingerprints is cut into blocks by a hash, so a task holds two blocks at a time. What a
pair of blocks yields is its connected components, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partwise.llm.common import components, text_of, written

QUARTERS, QUARTER_BITS = 4, 16


def text_fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """SimHash of the lower-cased (A-Z) text's word shingles, repeats included; 0 without a word."""
    from xxhash import xxh64_intdigest

    w = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    n = max(1, len(w) - words + 1)
    h = np.fromiter((xxh64_intdigest(s, seed) for s in shingles), dtype="<u8", count=n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):
        ones += np.unpackbits(h[i:i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint_column(text_col: str, words: int = 3) -> Column:
    """The fingerprint of a whole text as a long; null and wordless texts give 0."""

    @F.arrow_udf("long")
    def fingerprint(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([text_fingerprint(t.as_py() or b"", words) for t in texts], dtype=np.uint64).view(np.int64))

    return fingerprint(F.col(text_col).cast("string").cast("binary"))


def _near_tiles(radius: int) -> list[int]:
    """Offsets of a tile number to those at most ``radius`` counts away, one of each opposite pair, 0 included."""
    steps = [()]
    for _ in range(QUARTERS):
        steps = [(*s, d) for s in steps for d in range(-radius, radius + 1) if sum(map(abs, s)) + abs(d) <= radius]
    return sorted({sum(d * 32**i for i, d in enumerate(s)) for s in steps if tuple(-d for d in s) <= s})


def _linked(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the links between blocks a and b, or within a."""
    nodes, right = (a, a) if b is None else (np.concatenate([a, b]), b)
    us, vs = [], []
    for i in range(0, len(a), 256):
        x, y = np.nonzero(np.bitwise_count(a[i:i + 256, None] ^ right[None, :]) <= radius)
        us.append(x + i), vs.append(y + (0 if b is None else len(a)))
    u, v = np.concatenate(us), np.concatenate(vs)
    if b is None:
        u, v = u[u < v], v[u < v]
    label = np.arange(len(nodes))
    while len(u):
        was = label.copy()
        np.minimum.at(label, u, label[v])
        np.minimum.at(label, v, label[u])
        label = label[label]
        if (label == was).all():
            break
    moved = np.nonzero(label != np.arange(len(nodes)))[0]
    return nodes[moved], nodes[label[moved]]


def links(fingerprints: DataFrame, radius: int, block: int = 2048) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column ``fp``, distinct longs) whose components are those of all pairs within ``radius`` bits."""
    quarter = [F.bit_count(F.shiftrightunsigned("fp", QUARTER_BITS * i).bitwiseAND((1 << QUARTER_BITS) - 1)).cast("long") for i in range(QUARTERS)]
    # Counts are 0 to 16, so with base 32 no offset of a near tile is ambiguous.
    tile = sum((q * 32**i for i, q in enumerate(quarter)), F.lit(0).cast("long"))
    tiled = fingerprints.select("fp", tile.alias("tile"))
    sizes = tiled.groupBy("tile").agg(F.ceil(F.count("*") / block).alias("n"))
    blocks = tiled.join(sizes, "tile").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("n"))).groupBy("tile", "block").agg(
        F.collect_list("fp").alias("fps"))
    blocks = written(blocks, "tiles")
    # A tile number is four counts of 0 to 16, so there are at most 17^4 rows to broadcast, however large the table is.
    near = F.broadcast(blocks.groupBy("tile").agg((F.max("block") + 1).alias("n")))
    left = blocks.select(F.col("tile").alias("tile_a"), F.col("block").alias("block_a"), F.col("fps").alias("a"),
                         F.explode(F.array(*[F.lit(d) for d in _near_tiles(radius)])).alias("step"))
    left = left.withColumn("tile", F.col("tile_a") + F.col("step")).join(near, "tile")
    # Every pair of blocks has a row of its own before the shuffle, so the pairs of a full tile are dealt by block.
    first = F.when(F.col("step") == 0, F.col("block_a")).otherwise(F.lit(0))
    left = left.select("tile", F.explode(F.sequence(first, F.col("n") - 1)).alias("block"), "step", "block_a", "a")
    paired = left.join(blocks, ["tile", "block"]).select(
        "a", F.when((F.col("step") != 0) | (F.col("block_a") != F.col("block")), F.col("fps")).alias("b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                a, b = (batch.column(k)[i] for k in (0, 1))
                a = a.values.to_numpy(zero_copy_only=False).view(np.uint64)
                found.append(_linked(a, b.values.to_numpy(zero_copy_only=False).view(np.uint64) if b.is_valid else None, radius))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found]).view(np.int64)) for k in (0, 1)], names=["a", "b"])

    return paired.mapInArrow(compare, "a long, b long")


def _labelled(nodes: DataFrame, radius: int) -> DataFrame:
    """``nodes`` (one row per ``fp``) and ``label``, the same for the fingerprints of one component."""
    label = components(links(nodes.select("fp"), radius)).select(F.col("v").alias("fp"), "label")
    return nodes.join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp"))


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, words: int = 3) -> DataFrame:
    """(id, fp, component_id), one row per row of ``documents``: fingerprints that differ in at most ``radius`` bits are linked.

    ``component_id`` is the smallest id reachable over links. Null and wordless texts have the
    fingerprint 0 and are linked like any other; repeated rows are kept; rows without an id do
    not become a component's id; an empty table gives an empty result; other columns are ignored.
    """
    prints = written(documents.select(F.col(id_col), fingerprint_column(text_col, words).alias("fp")), "fingerprints")
    nodes = _labelled(prints.groupBy("fp").agg(F.min(id_col).alias("least")), radius)
    groups = nodes.groupBy("label").agg(F.min("least").alias("component_id"))
    of_print = nodes.join(groups, "label").select("fp", "component_id")
    return prints.join(of_print, "fp").select(id_col, "fp", "component_id")


def one_of_each(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, words: int = 3) -> DataFrame:
    """One row of ``documents`` for each component: that with the smallest id; all columns stay, whatever their names.

    Among different texts with that id the one with the smallest hash stays, of repeated rows any
    one. Rows without an id stay only where no other row of their component has one; rows that
    share an id, or have none, but belong to different components are kept each.
    """
    text_hash = F.xxhash64(text_of(text_col))
    rank = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), text_hash.alias("hash"))
    prints = written(documents.select(rank.alias("head"), fingerprint_column(text_col, words).alias("fp")), "fingerprints")
    nodes = _labelled(written(prints.groupBy("fp").agg(F.min("head").alias("head")), "heads"), radius)
    # A text has one fingerprint, so id and text hash belong to one component.
    heads = nodes.groupBy("label").agg(F.min("head").alias("head")).select(F.col("head.id").alias("_id"), F.col("head.hash").alias("_head"))
    rows = documents.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), text_hash.alias("hash"))
    rows = rows.join(heads, F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_head")), "left_semi")
    return rows.dropDuplicates(["id", "hash"]).select("row.*")
