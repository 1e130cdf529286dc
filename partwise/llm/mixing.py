"""Mixing sources to target weights along a time-varying curriculum.

Each source has a target number of words: its weight's share of the whole, at most ``cap`` times
what it has. It is met by whole passes over the source and a last partial pass in hash order, which
takes every document that still fits and is closed by the one that comes nearest to what is then
missing. Within a source the
taken copies form a sequence. A source's weight may change over training time; the integral of
that schedule is its cumulative demand, and inverting it gives each copy its position in
training, by which the mix is range-sorted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partwise.llm.common import WORD, text_of, written

#: A schedule is a list of (time, multiplier) knots from time 0 to 1, linear between them.
Schedule = Sequence[tuple[float, float]]


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, cap: float) -> list[float]:
    """Shares of ``share`` times all sizes by weight, none above ``cap`` times its size, the excess reshared by weight.

    Resharing ends where every source gets the smaller of its cap and one common level times its
    weight; that level is the largest that any set of lowest-ratio sources at their caps implies.
    """
    total, caps = share * sum(sizes), [cap * s for s in sizes]
    order = sorted(range(len(sizes)), key=lambda i: caps[i] / weights[i])
    level, held, rest = 0.0, 0.0, float(sum(weights))
    for i in order:
        level = max(level, (total - held) / rest)
        held, rest = held + caps[i], rest - weights[i]
    return [min(c, level * w) for c, w in zip(caps, weights)] if total < sum(caps) else caps


def segments(schedule: Schedule) -> list[tuple[float, float, float, float, float]]:
    """(begin, length, weight at begin, slope, share of the whole area before it) of each piece of a schedule."""
    knots = [(float(t), float(w)) for t, w in schedule]
    pieces = [(t0, t1 - t0, w0, w1) for (t0, w0), (t1, w1) in zip(knots, knots[1:]) if t1 > t0]
    areas = [d * (w0 + w1) / 2 for _, d, w0, w1 in pieces]
    whole = sum(areas)
    return [(t, d, w0 / whole, (w1 - w0) / d / whole, sum(areas[:i], 0.0) / whole) for i, (t, d, w0, w1) in enumerate(pieces)]


def source_plan(spark: SparkSession, sizes: list[tuple[str | None, int]], weights: Sequence[float], share: float, cap: float,
                schedules: Sequence[Schedule]) -> DataFrame:
    """One row per source: _s (its name), source_size, target, passes (whole ones), rest (words of the partial pass), segments.

    Sources are taken in code-point order, null last, and get ``weights`` and ``schedules`` in turn.
    """
    ordered = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    wanted = targets([n for _, n in ordered], [weights[i % len(weights)] for i in range(len(ordered))], share, cap)
    rows = []
    for i, ((source, n), t) in enumerate(zip(ordered, wanted)):
        passes = math.floor(t / n) if n else 0
        rows.append((source, n, float(t), passes, float(t - passes * n), segments(schedules[i % len(schedules)])))
    return spark.createDataFrame(rows, "_s string, source_size long, target double, passes int, rest double, "
                                       "segments array<struct<t:double,d:double,w:double,slope:double,before:double>>")


def _closing(left: DataFrame, refill: bool) -> DataFrame:
    """(_s, _end, _at): the documents that follow the prefix of a source's partial pass, known by where they end, and where each begins in that pass.

    ``left`` has source, size, source_size, _end, _filled and missing (words) of the documents
    behind the prefix. In their order every document is taken that still fits (only with
    ``refill``), and then the one that comes nearest to what is missing, if it comes nearer than
    none. Of equal sizes the first come first, so of size s no more than missing / s + 1 are
    looked at. As a document longer than ``missing`` ended the prefix, this is a number that the
    longest document bounds, however long the source is.
    """
    near = left.filter((F.col("size") > 0) & (F.col("size") < 2 * F.col("missing"))).select(
        F.coalesce("source", F.lit("")).alias("_source"), F.col("source").isNull().alias("_null"), "size", "_end", "_filled", "missing",
        F.floor(F.col("_end") / F.ceil(F.col("source_size") / 4096)).alias("_part"))
    # Ranks among equal sizes, in parts of the sequence, so that one frequent size is dealt over many tasks.
    enough = (F.floor(F.col("missing") / F.col("size")) if refill else F.lit(0)) + 1
    group = ["_source", "_null", "size", "_part"]
    ranked = near.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy("_end"))).filter(F.col("_rank") <= enough)
    ahead = Window.partitionBy("_source", "_null", "size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = ranked.groupBy(*group).agg(F.count("*").alias("_n")).select(*group, F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    few = ranked.join(before, group).filter(F.col("_before") + F.col("_rank") <= enough)

    def choose(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["_end"].to_pylist(), table["size"].to_pylist()))
        missing, at, taken, others = table["missing"][0].as_py(), table["_filled"][0].as_py(), [], []
        for end, size in rows:
            if refill and size <= missing:
                taken.append((end, at))
                missing, at = missing - size, at + size
            else:
                others.append((end, size))
        if best := min(((abs(missing - size), end) for end, size in others if abs(missing - size) < missing), default=None):
            taken.append((best[1], at))
        null = table["_null"][0].as_py()
        return pa.table({"_s": pa.array([None if null else table["_source"][0].as_py()] * len(taken), pa.string()),
                         "_end": pa.array([t[0] for t in taken], pa.int64()), "_at": pa.array([t[1] for t in taken], pa.int64())})

    return few.select("_source", "_null", "size", "_end", "_filled", "missing").groupBy("_source", "_null").applyInArrow(choose, "_s string, _end long, _at long")


def mix(documents: DataFrame, weights: Sequence[float], share: float, cap: float, schedules: Sequence[Schedule] = (((0, 1), (1, 1)),),
        id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", refill: bool = True) -> DataFrame:
    """One row per row of ``documents``: id, source, size, source_size, target, copies, taken, offsets, segments and ``text_hash``.

    Size counts words between ASCII white space (null text: 0). ``taken`` is copies times size,
    and ``offsets`` says where in its source's sequence each copy begins. Running sums are made
    in hash buckets within a source, so that a source with a third of all rows is dealt over
    many tasks; only one row per source reaches the driver. Null sources are a source of their
    own, repeated rows are separate rows, wordless documents are taken in their passes with 0
    words, an empty table gives an empty result, other columns are ignored. Without ``refill``
    the partial pass ends at the first document that does not fit, and one document closes it.
    """
    spark = documents.sparkSession
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    sized = written(documents.select(
        F.col(id_col), F.col(source_col).cast("string").alias("source"), F.xxhash64(text_of(text_col)).alias("text_hash"),
        F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"), key.alias("_key")), "sizes")
    sizes = [(r.source, r.n) for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    plan = F.broadcast(source_plan(spark, sizes, weights, share, cap, schedules))  # one row per source

    dealt = sized.withColumns({"_source": F.coalesce("source", F.lit("")), "_null": F.col("source").isNull(), "_bucket": F.substring("_key", 1, 3)})
    group = ["_source", "_null", "_bucket"]
    ahead = Window.partitionBy("_source", "_null").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy(*group).agg(F.sum("size").alias("_n")).select(*group, F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*group).orderBy("_key", F.col(id_col), "size", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("_sum", F.sum("size").over(inside)).join(base, group).withColumn("_end", F.col("_base") + F.col("_sum"))
    placed = written(placed.select(id_col, "source", "text_hash", "size", "_end"), "placed").join(plan, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")

    fits = F.col("_end") <= F.col("rest")
    filled = placed.groupBy(F.col("source").alias("_s")).agg(F.coalesce(F.max(F.when(fits, F.col("_end"))), F.lit(0)).alias("_filled"))
    filled = F.broadcast(filled)  # one row per source
    placed = placed.join(filled, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # A document with words is known within its source by where it ends.
    more = written(_closing(placed.filter(~fits).withColumn("missing", F.col("rest") - F.col("_filled")), refill), "closing").withColumnRenamed("_end", "end")
    placed = placed.join(more, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_end") == F.col("end")) & (F.col("size") > 0), "left").drop("_s")
    whole = F.transform(F.sequence(F.lit(1), F.col("passes")), lambda p: (p - 1) * F.col("source_size") + F.col("_end") - F.col("size"))
    partial = F.when(fits, F.array(F.col("passes") * F.col("source_size") + F.col("_end") - F.col("size"))).when(
        F.col("_at").isNotNull(), F.array(F.col("passes") * F.col("source_size") + F.col("_at"))).otherwise(F.array().cast("array<long>"))
    offsets = F.concat(F.when(F.col("passes") > 0, whole).otherwise(F.array().cast("array<long>")), partial)
    return placed.withColumn("offsets", offsets).withColumn("copies", F.size("offsets")).select(
        id_col, "source", "text_hash", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "offsets", "segments")


def position(offset: Column) -> Column:
    """Training time in 0 to 1 at which the source's cumulative demand reaches the copy that begins at ``offset``."""
    q = F.least(F.greatest((offset + F.col("size") / 2.0) / F.greatest(F.col("target"), F.lit(1e-9)), F.lit(0.0)), F.lit(1.0))
    s = F.element_at(F.filter("segments", lambda x: x["before"] <= q), -1)
    x = q - s["before"]
    root = s["w"] + F.sqrt(F.greatest(s["w"] * s["w"] + 2 * s["slope"] * x, F.lit(0.0)))
    return F.least(s["t"] + F.when(root > 0, F.least(2 * x / root, s["d"])).otherwise(F.lit(0.0)), F.lit(1.0))


def copies_in_order(documents: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """(row, position, rank) and the columns of ``mixed`` named in ``carry``: each row of ``documents`` as a struct, as often as it is taken, range-sorted by position.

    Rows that share an id are told apart by their text and then by number, so repeated rows stay
    exact; ``rank`` is the number among the rows of an id. Columns of ``documents`` may have any name.
    """
    left = documents.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("hash"))
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("hash")))
    copies = mixed.select(F.col(id_col).alias("of"), F.row_number().over(Window.partitionBy(id_col).orderBy("text_hash")).alias("no"),
                          F.transform("offsets", position).alias("positions"), *carry).filter(F.size("positions") > 0)
    joined = left.join(copies, F.col("id").eqNullSafe(F.col("of")) & (F.col("rank") == F.col("no")))
    rows = joined.select("row", "id", "rank", *carry, F.explode("positions").alias("position"))
    return rows.repartitionByRange("position", "id").sortWithinPartitions("position", "id")


def in_training_order(documents: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``documents``, each as often as it is taken, range-sorted by position; see ``copies_in_order``."""
    return copies_in_order(documents, mixed, id_col, text_col).select("row.*")


def taken_in_order(documents: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, source_size, target and taken of each row of ``mixed``, counted in the documents in training order.

    The rows are range-sorted by the position of their first copy, those never taken last. The
    training order is written once as a table of all copies, without the texts, which are not asked for here.
    """
    columns = ["size", "source_size", "target"]
    mixed = written(mixed, "mix")
    ordered = copies_in_order(documents.select(id_col, text_col), mixed, id_col, text_col, columns)
    ordered = written(ordered.select("id", "rank", "position", *columns), "ordered")
    found = ordered.groupBy("id", "rank").agg(*[F.first(c).alias(c) for c in columns], F.sum("size").alias("taken"), F.min("position").alias("first"))
    never = mixed.filter("copies = 0").select(F.col(id_col).alias("id"), *columns, "taken", F.lit(None).cast("double").alias("first"))
    rows = found.select("id", *columns, "taken", "first").unionByName(never)
    by = [F.col("first").asc_nulls_last(), F.col("id")]
    return rows.repartitionByRange(*by).sortWithinPartitions(*by).select(F.col("id").alias(id_col), *columns, "taken")
