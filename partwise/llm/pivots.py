"""Embedding near-duplicates through a pivot-permutation index.

A vector is described by its nearest reference points (pivots) in order. Vectors that point the
same way have many of their first pivots in common, so the inverted lists, one for each set of
``shared`` pivots, hold all pairs with that many first pivots in common; every such pair is
verified by its cosine. Equal vectors are one node with a count. A long list is cut into blocks
by a hash and its pairs of blocks are verified in separate tasks; a pair of vectors is counted
at its first common list only. What a pair of blocks yields is a number of links per vector and
its connected components, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwise.llm.common import components, written


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows in double precision, scaled to length one; scaled by the largest component first, so that no square overflows."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """node and vector of the rows whose vector can be compared: not null or zero, all components finite."""
    v = F.col(vector_col).cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    # Adding 0 makes -0 and 0 the same component.
    same = F.transform(v, lambda x: x + F.lit(0.0))
    return rows.select(F.col(id_col), F.when(F.coalesce(fine, F.lit(False)), same).alias("vector")).withColumn(
        "node", F.when(F.col("vector").isNotNull() & F.col(id_col).isNotNull(), F.xxhash64("vector")))


def pivots_of(nodes: DataFrame, dims: int, number: int) -> np.ndarray:
    """``number`` vectors of that dimension, chosen by a hash: the bounded sample that fits the index."""
    picked = nodes.filter(F.size("vector") == dims).orderBy(F.xxhash64("node"), "node").limit(number).select("vector").collect()
    return _unit(np.array([p.vector for p in picked]))


def depth(number: int, nearest: int) -> int:
    """How many of its ``number`` pivots describe a vector: ``nearest`` up to 89 pivots, one more for each doubling.

    More pivots lie closer together, so that two near vectors have fewer of their first ones in
    common; with the depth the share of pairs found stays the same.
    """
    return min(number, nearest + max(0, math.ceil(math.log2(number / 89))))


def inverted_lists(nodes: DataFrame, pivots: dict[int, np.ndarray], nearest: int, shared: int) -> DataFrame:
    """(node, list, first): the list numbers of each vector, and its nearest pivots in ascending number.

    ``nearest`` is the number for few pivots (see ``depth``). A list number is made of the dimension and ``shared`` pivot numbers, so vectors of different dimensions never meet.
    """
    known = nodes.sparkSession.sparkContext.broadcast(pivots)  # bounded: one matrix per dimension

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, vectors = batch.column(0).to_numpy(), batch.column(1)
            sizes = np.diff(vectors.offsets.to_numpy())
            for dims in np.unique(sizes):
                at = np.nonzero(sizes == dims)[0]
                p = known.value[int(dims)]
                near = np.argsort(-(_unit(np.stack([vectors[int(i)].values.to_numpy() for i in at])) @ p.T), axis=1, kind="stable")[:, :depth(len(p), nearest)]
                near.sort(axis=1)
                lists = [_list(int(dims), near[:, c]) for c in combinations(range(near.shape[1]), min(shared, near.shape[1]))]
                yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(np.stack(lists, axis=1).tolist(), pa.list_(pa.int64())),
                                                  pa.array(near.tolist(), pa.list_(pa.int32()))], names=["node", "lists", "first"])

    return nodes.select("node", "vector").mapInArrow(describe, "node long, lists array<long>, first array<int>")


def _list(dims: int, chosen: np.ndarray) -> np.ndarray:
    number = np.full(len(chosen), dims, np.int64)
    for k in range(chosen.shape[1]):
        number = number * 8192 + chosen[:, k]
    return number


def _verify(list_no: int, dims: int, a: dict, b: dict | None, shared: int, least: float):
    """Links per node and (node, smallest node) pairs between two blocks of a list, or within one."""
    other = a if b is None else b
    x, y = _unit(a["v"]), _unit(other["v"])
    nodes = a["node"] if b is None else np.concatenate([a["node"], b["node"]])
    shift = 0 if b is None else len(x)
    links, us, vs = np.zeros(len(nodes), np.int64), [], []
    for i in range(0, len(x), 512):
        u, v = np.nonzero(x[i:i + 512] @ y.T >= least)
        u = u + i
        if b is None:
            u, v = u[u < v], v[u < v]
        for j in range(0, len(u), 1 << 16):
            p, q = u[j:j + (1 << 16)], v[j:j + (1 << 16)]
            common = (a["first"][p][:, :, None] == other["first"][q][:, None, :]).any(axis=2)
            # The first list of a pair is that of its smallest common pivots.
            width = min(shared, common.shape[1])
            leading = np.argsort(~common, axis=1, kind="stable")[:, :width]
            first = _list(dims, np.take_along_axis(a["first"][p], leading, axis=1)) == list_no
            us.append(p[first]), vs.append(q[first] + shift)
    u, v = (np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, int), np.zeros(0, int))
    count = a["n"] if b is None else np.concatenate([a["n"], b["n"]])
    np.add.at(links, u, count[v])
    np.add.at(links, v, count[u])
    label = np.arange(len(nodes))
    while len(u):
        was = label.copy()
        np.minimum.at(label, u, label[v])
        np.minimum.at(label, v, label[u])
        label = label[label]
        if (label == was).all():
            break
    some = np.nonzero(links)[0]
    return nodes[some], links[some], nodes[label[some]]


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, nearest: int = 7, shared: int = 2,
                    block: int = 1024, max_pivots: int = 4096, max_dims: int = 256) -> DataFrame:
    """(id, n_links, component_id, kept): all rows are indexed, and pairs that share ``shared`` of their nearest pivots are verified.

    The result is approximate: of the pairs right at 0.9 some in a thousand are not found.
    ``nearest`` pivots describe a vector where pivots are few, more where they are many (``depth``).

    A row's links are the other rows whose cosine with it is ``least`` or more. Vectors that are
    null, zero or hold null or non-finite components link with nothing, nor do rows without an
    id; vectors of different dimensions are not compared. Repeated rows are rows of their own.
    An empty table gives an empty result; other columns are ignored. There are twice as many
    pivots as the root of the number of distinct vectors (at most ``max_pivots``), which keeps
    the lists short as the table grows. A larger ``shared`` loses many pairs near the threshold.
    """
    all_rows = written(usable(rows, id_col, vector_col), "vectors")
    nodes = written(all_rows.filter("node IS NOT NULL").groupBy("node").agg(
        F.first("vector").alias("vector"), F.count("*").alias("n"), F.min(id_col).alias("least")), "nodes")
    dims = dict(nodes.groupBy(F.size("vector")).count().limit(max_dims + 1).collect())
    if len(dims) > max_dims:
        raise ValueError(f"more than {max_dims} dimensions")
    pivots = {d: pivots_of(nodes, d, max(nearest, min(max_pivots, int(2 * n**0.5)))) for d, n in dims.items()}
    described = written(inverted_lists(nodes, pivots, nearest, shared), "described")
    postings = described.select("node", F.explode("lists").alias("list"))
    sizes = postings.groupBy("list").agg(F.count("*").alias("size")).filter("size > 1").select("list", F.ceil(F.col("size") / block).alias("blocks"))
    # Each posting goes to every pair of blocks that its block is part of.
    mine = postings.join(sizes, "list").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn(
        "with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    paired = mine.select("node", "list", F.least("own", "with").alias("left"), F.greatest("own", "with").alias("right"), "own")
    member = F.struct("node", "n", "vector", "first", (F.col("own") == F.col("left")).alias("is_left"))
    tasks = paired.join(nodes.select("node", "n", F.col("vector").cast("array<double>").alias("vector")), "node").join(
        described.select("node", "first"), "node").groupBy("list", "left", "right").agg(F.collect_list(member).alias("m"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(np.zeros(0, np.int64),) * 3]
            numbers, lefts, rights, members = (batch.column(i) for i in range(4))
            for i in range(batch.num_rows):
                m = members[i].values
                width, depth = len(m.field("vector")[0]), len(m.field("first")[0])
                part = {"node": m.field("node").to_numpy(), "n": m.field("n").to_numpy(), "v": m.field("vector").flatten().to_numpy().reshape(-1, width),
                        "first": m.field("first").flatten().to_numpy().reshape(-1, depth)}
                if lefts[i] == rights[i]:
                    found.append(_verify(numbers[i].as_py(), width, part, None, shared, least))
                else:
                    is_left = m.field("is_left").to_numpy(zero_copy_only=False)
                    a, b = ({k: x[at] for k, x in part.items()} for at in (is_left, ~is_left))
                    if len(a["node"]) and len(b["node"]):
                        found.append(_verify(numbers[i].as_py(), width, a, b, shared, least))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in range(3)], names=["node", "links", "root"])

    links = written(tasks.select("list", "left", "right", "m").mapInArrow(verify, "node long, links long, root long"), "links")
    label = components(links.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))).select(F.col("v").alias("node"), "label")
    found = nodes.select("node", "n", "least").join(links.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(label, "node", "left").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("label", "node").alias("label"), "least")
    groups = found.groupBy("label").agg(F.min("least").alias("component_id"))
    of_node = found.join(groups, "label").select("node", "n_links", "component_id")
    linked = all_rows.filter("node IS NOT NULL").select(id_col, "node").join(of_node, "node").select(id_col, "n_links", "component_id")
    alone = all_rows.filter("node IS NULL").select(id_col, F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
