"""Merkle manifest of a table: one hash tree per part, one over the parts, and a proof for every row.

Rows are hashed where they lie, so texts are never shuffled. Leaves get their place in the part
by a range sort and counts of its pieces; no part passes through one task. Each aligned block of
729 leaves keeps a level of the tree as one hex string: fixed-width substrings of it are hashed
to the level above, and the substrings that flank a node in its run of three are its siblings.
What a block comes to is a leaf of the next round, so a part of n rows takes log(n) / log(729)
rounds, each on 1/729 of the rows of the one before. Paths then grow from the root down, joined
once per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partwise.llm.common import written

FANOUT, LEVELS, DIGEST = 3, 6, 64
BLOCK = FANOUT**LEVELS


def field(value: Column) -> Column:
    """A value as it enters a leaf: ``-`` for null, else its UTF-8 byte count, a colon and the value; integers in decimal."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` and ``size``: the place in the part by ``order``, from 0, and the number of the part's rows.

    ``order`` with the part is a key of the stored ``rows``, so a task that runs again gives the same places.
    """
    keys = ["part", *order]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # The id numbers the rows of each partition: partition * 2^33 + row.
    ranked = written(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_piece", F.shiftright("_at", 33)), "ranked")
    pieces = ranked.groupBy("part", "_piece").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("part").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = written(pieces.select("part", "_piece", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                                   F.sum("_n").over(Window.partitionBy("part")).alias("size")), "pieces")
    return ranked.join(pieces, ["part", "_piece"]).withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_piece", "_first", "_before", "_n")


def _parents(level: Column) -> Column:
    """The hex string of the level above: each run of three digests hashed, a last shorter one too."""
    width = FANOUT * DIGEST
    run = F.transform(F.sequence(F.lit(0), F.floor((F.length(level) - 1) / width).cast("int")), lambda r: F.sha2(F.substring(level, r * width + 1, F.lit(width)), 256))
    return F.array_join(run, "")


def _flanks(levels: Column, size: Column, i: Column) -> Column:
    """Siblings of the leaf at place ``i`` of its block, level by level: (left, right), the digests before and after it in its run."""
    steps = []
    for j in range(LEVELS):
        node = F.floor(i / FANOUT**j).cast("int")
        run = F.substring(F.get(levels, F.lit(j)), F.floor(node / FANOUT).cast("int") * FANOUT * DIGEST + 1, F.lit(FANOUT * DIGEST))
        k = node % FANOUT * DIGEST
        steps.append(F.when(size > FANOUT**j, F.struct(F.substring(run, F.lit(1), k).alias("left"), F.substring(run, k + DIGEST + 1, F.lit(FANOUT * DIGEST)).alias("right"))))
    return F.array_compact(F.array(*steps))


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """Block tables (part, block, size, items, levels, top), one per round; ``nodes`` has part, pos, size, digest and carried."""
    rounds = []
    while True:
        item = F.struct("pos", "digest", "carried")
        blocks = nodes.groupBy("part", "size", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(item)).alias("items"))
        first = F.array_join(F.transform("items", lambda x: x.digest), "")
        grown = F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), F.array(first), lambda levels, j: F.when(
            F.col("size") > F.pow(F.lit(float(FANOUT)), j), F.concat(levels, F.array(_parents(F.element_at(levels, -1))))).otherwise(levels))
        rounds.append(written(blocks.withColumn("levels", grown).withColumn("top", F.element_at("levels", -1)), "blocks"))
        nodes = rounds[-1].filter(F.col("size") > BLOCK).select("part", F.col("block").alias("pos"), F.ceil(F.col("size") / BLOCK).alias("size"),
                                                               F.col("top").alias("digest"), F.lit(None).cast("string").alias("carried"))
        if nodes.isEmpty():
            return rounds


def _ends(rounds: list[DataFrame]) -> DataFrame:
    """(part, digest): the root of each part."""
    ends = [r.filter(F.col("size") <= BLOCK).select("part", F.col("top").alias("digest")) for r in rounds]
    found = ends[0]
    for more in ends[1:]:
        found = found.unionByName(more)
    return found


def _paths(rounds: list[DataFrame], crown: DataFrame | None) -> DataFrame:
    """(part, pos, digest, carried, path, subroot, root) of every node of the first round; ``crown`` has part, above and root."""
    steps = "array<struct<left:string,right:string>>"
    found = None
    for blocks in reversed(rounds):
        ended = blocks.filter(F.col("size") <= BLOCK).withColumn("subroot", F.col("top"))
        ended = ended.join(crown, "part") if crown is not None else ended.withColumns({"above": F.array().cast(steps), "root": F.col("top")})
        if found is not None:
            higher = found.select("part", F.col("pos").alias("block"), F.col("path").alias("above"), "subroot", "root")
            ended = ended.unionByName(blocks.filter(F.col("size") > BLOCK).join(higher, ["part", "block"]))
        nodes = F.transform("items", lambda x, i: F.struct(x.pos.alias("pos"), x.digest.alias("digest"), x.carried.alias("carried"),
                                                           F.concat(_flanks(F.col("levels"), F.col("size"), i), F.col("above")).alias("path")))
        found = ended.select("part", "subroot", "root", F.explode(nodes).alias("node")).select("part", "subroot", "root", "node.*")
    return found


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf and its siblings come to."""
    return F.aggregate(path, digest, lambda h, s: F.sha2(F.concat(s.left, h, s.right), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s.left, s.right)), ""), 256)


def manifest(rows: DataFrame, part_col: str, id_col: str, leaf_hash: Column, altered_hash: Column | None = None) -> DataFrame:
    """(id, leaf, altered, subroot, root, path), one row per row of ``rows``; ``path`` holds the (left, right) siblings up to the root.

    ``leaf_hash`` and ``altered_hash`` are hex digests computed from a row; the tree is built from
    the first, the second is carried along for checks (null: not altered). Leaves of a part ascend
    by id, null ids first and equal ids by digest; repeated rows are leaves of their own. Parts
    ascend bytewise, the null part first. A part of one row is its own subroot; with one part
    the root is its subroot; an empty table gives no rows. Long texts are hashed whole. Other
    columns are ignored, whatever their names, unless the hashes read them.
    """
    altered = F.lit(None).cast("string") if altered_hash is None else altered_hash
    # The stored number tells repeated rows apart.
    leaves = written(rows.select(F.struct(F.col(part_col).alias("name")).alias("part"), F.col(id_col).alias("id"), leaf_hash.alias("digest"),
                                 altered.alias("altered"), F.monotonically_increasing_id().alias("no")), "leaves")
    placed = _placed(leaves, ["id", "digest", "no"])
    rounds = _rounds(placed.select("part", "pos", "size", "digest", F.struct("id", "altered").alias("carried")))
    subroots = _ends(rounds).select(F.struct(F.lit(0).alias("name")).alias("part"), F.col("part").alias("of"), "digest")
    over = _placed(written(subroots, "subroots"), ["of"])
    crown = _paths(_rounds(over.select("part", "pos", "size", "digest", F.col("of").alias("carried"))), None)
    crown = written(crown.select(F.col("carried").alias("part"), F.col("path").alias("above"), "root"), "crown")
    return _paths(rounds, crown).select(F.col("carried.id").alias(id_col), F.col("digest").alias("leaf"), F.col("carried.altered").alias("altered"), "subroot", "root", "path")
