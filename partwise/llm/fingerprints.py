"""SimHash fingerprints and their look-up through permuted block tables, in DataFrame operations only.

A text's terms are its pairs of neighbouring words (one word: that word; words are runs between
ASCII white space). Each occurrence votes with the bits of its hash, and its weight is the
length of the term, because long terms are rare and short ones are mostly function words. A bit
of the fingerprint is 1 where the ones outweigh the zeros. An empty or null text has no term and
the fingerprint zero. Votes are sums, so they combine before any shuffle, and equal texts have
equal fingerprints wherever they stand.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partwise.llm.common import written
from partwise.llm.ordered import beside_next

BITS = 64
#: Two 32-bit counters share a long: bit j and bit j + 32 of the hash.
LANES = (1 << 32) | 1


def _terms(text: Column) -> Column:
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.arrays_zip(words.alias("a"), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))).alias("b"))


def fingerprints(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """keys and ``fingerprint`` (long), one row per distinct value of ``keys``.

    ``keys`` must identify a text. Where ``texts`` is already partitioned by some of them, no row moves.
    """
    pairs = F.posexplode_outer(_terms(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    rows = texts.select(*keys, pairs.alias("pos", "t")).select(*keys, "pos", F.col("t.a").alias("a"), F.col("t.b").alias("b"))
    # The last word has no neighbour; it is a term only where it is the single word.
    weight = F.when(F.col("a").isNull() | (F.col("b").isNull() & (F.col("pos") > 0)), F.lit(0)).otherwise(
        F.length("a") + F.coalesce(F.length("b"), F.lit(0))).cast("long")
    rows = rows.select(*keys, F.xxhash64("a", "b").alias("h"), weight.alias("w"))
    votes = [F.sum(F.expr(f"(shiftrightunsigned(h, {j}) & {LANES}L) * w")).alias(f"v{j}") for j in range(BITS // 2)]
    summed = rows.groupBy(*keys).agg(F.sum("w").alias("w"), *votes)
    low = [F.when(F.col(f"v{j}").bitwiseAND((1 << 32) - 1) * 2 > F.col("w"), F.lit(1 << j)).otherwise(F.lit(0).cast("long")) for j in range(32)]
    high = [F.when(F.shiftrightunsigned(f"v{j}", 32) * 2 > F.col("w"), F.lit((1 << (j + 32)) - ((1 << 64) if j == 31 else 0))).otherwise(
        F.lit(0).cast("long")) for j in range(32)]
    whole = (low + high)[0]
    for bit in (low + high)[1:]:
        whole = whole.bitwiseOR(bit)
    return summed.select(*keys, whole.alias("fingerprint"))


def likeness(a: str, b: str) -> Column:
    """Estimated cosine of the two texts' weighted terms: the share of differing bits is their angle. 1 for equal fingerprints, at least 0."""
    return F.greatest(F.lit(0.0), F.cos(F.bit_count(F.col(a).bitwiseXOR(F.col(b))) * (math.pi / BITS)))


def as_hex(col: str) -> Column:
    return F.lower(F.lpad(F.hex(col), 16, "0"))


def block_keys(fp: str, radius: int, blocks: int) -> Column:
    """The keys of a fingerprint in every permuted table: the table's number and the bits of its leading blocks.

    Two fingerprints within the radius differ in at most ``radius`` blocks, so they agree on all
    of some choice of ``blocks - radius`` blocks, and each such choice is a table.
    """
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(masks[i] for i in chosen)
        keys.append(F.struct(F.lit(n).alias("table"), F.col(fp).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")).alias("key")))
    return F.array(*keys)


def within_radius(queries: DataFrame, all_fps: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """(fp, other, copies): for each distinct fingerprint ``fp`` of ``queries`` every one of ``all_fps`` within ``radius`` bits, itself included.

    Both inputs have one column ``fp`` (long; nulls are skipped); ``copies`` counts the rows of
    ``all_fps`` that have ``other``. Copies are counted before the tables are made, so a group
    of equal fingerprints is one row. A pair that several tables hold is given by the first.
    """
    assert 0 <= radius < blocks
    counted = all_fps.filter("fp IS NOT NULL").groupBy(F.col("fp").alias("other")).agg(F.count("*").alias("copies"))
    asked = queries.filter("fp IS NOT NULL").select("fp").distinct()
    left = asked.select("fp", F.explode(block_keys("fp", radius, blocks)).alias("k")).select("fp", "k.*")
    right = counted.select("other", "copies", F.explode(block_keys("other", radius, blocks)).alias("k")).select("other", "copies", "k.*")
    near = left.join(right, ["table", "key"]).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius)
    first = F.array_position(F.zip_with(block_keys("fp", radius, blocks), block_keys("other", radius, blocks), lambda a, b: a["key"] == b["key"]), True)
    return near.filter(first - 1 == F.col("table")).select("fp", "other", "copies")


def edit_report(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, blocks: int = 5, every: int = 100) -> DataFrame:
    """Fingerprint of every whole text and of its edited form, and how alike they are; one row per row of ``documents``.

    The edited text has its last quarter of code points (rounded down) replaced by as many from
    the start of the next document, fewer if that is shorter. ``within_radius`` counts the other
    rows whose fingerprint differs in at most ``radius`` bits; it is given for the stated query
    set, the ids that ``every`` divides, and null for the others. Null texts count as empty,
    repeated rows are kept, rows without an id come last in the order, and columns other than
    the id and the text are ignored. An empty table gives an empty result.
    """
    docs = documents.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    rows = beside_next(docs, id_col, "_text")
    n, cut = F.length("_text"), F.floor(F.length("_text") / 4).cast("int")
    rows = rows.withColumns({"n_chars": n.cast("long"), "_cut": cut})
    rows = rows.withColumn("_edited", F.expr("concat(left(_text, n_chars - _cut), left(coalesce(next_value, ''), _cut))"))
    rows = rows.withColumn("edited_sha256", F.sha2("_edited", 256)).withColumn("_kind", F.explode(F.expr(
        "CASE WHEN guest THEN array(named_struct('edited', false, 'text', _text)) "
        "ELSE array(named_struct('edited', false, 'text', _text), named_struct('edited', true, 'text', _edited)) END")))
    keys = ["bucket", "seq", "guest", id_col, "n_chars", "edited_sha256", "edited"]
    prints = fingerprints(rows.select(*keys[:-1], "_kind.*"), keys, "text")
    both = prints.groupBy(*keys[:-1]).agg(F.max(F.when(~F.col("edited"), F.col("fingerprint"))).alias("fp"),
                                          F.max(F.when(F.col("edited"), F.col("fingerprint"))).alias("efp"))
    both = both.withColumn("nfp", F.lead("fp").over(Window.partitionBy("bucket").orderBy("seq"))).filter(~F.col("guest"))
    both = written(both.select(id_col, "n_chars", "edited_sha256", "fp", "efp", F.coalesce("nfp", "fp").alias("nfp")), "fingerprints")
    asked = F.coalesce(F.pmod(F.col(id_col), F.lit(every)) == 0, F.lit(False))
    near = within_radius(both.filter(asked).select("fp"), both.select("fp"), radius, blocks).groupBy("fp").agg((F.sum("copies") - 1).alias("within_radius"))
    done = both.filter(asked).join(near, "fp").select(*both.columns, "within_radius").unionByName(
        both.filter(~asked).withColumn("within_radius", F.lit(None).cast("long")))
    return done.select(id_col, "n_chars", "edited_sha256", as_hex("fp").alias("fingerprint"), as_hex("efp").alias("edited_fingerprint"),
                       likeness("fp", "efp").alias("near_edited"), likeness("fp", "nfp").alias("near_next"), "within_radius")
