"""Each row beside its successor in id order, without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _buckets(rows: DataFrame, id_col: str) -> list:
    """Ids that begin the buckets, ascending. Percentiles are ids of the table, so no bucket is empty."""
    n = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = rows.agg(F.min(id_col).alias("least"), F.percentile_approx(id_col, [i / n for i in range(1, n)], 100 * n).alias("cuts")).first()
    return sorted({r.least, *(r.cuts or [])} - {None})


def _bucket_of(ident: Column, starts: list, width: int = 32) -> Column:
    """Index of the last start at or below the id, looked up in two steps; a null id belongs to the last bucket."""
    groups = [starts[i:i + width] for i in range(0, len(starts), width)]
    coarse = F.array(*[F.lit(g[0]) for g in groups])
    fine = F.array(*[F.array(*[F.lit(x) for x in g]) for g in groups])
    g = F.greatest(F.size(F.filter(coarse, lambda x: x <= ident)), F.lit(1))
    f = F.size(F.filter(F.get(fine, g - 1), lambda x: x <= ident))
    return F.when(ident.isNull(), F.lit(len(starts) - 1)).otherwise(F.greatest((g - 1) * width + f - 1, F.lit(0)))


def beside_next(rows: DataFrame, id_col: str, value_col: str) -> DataFrame:
    """``rows`` with bucket, seq, guest and ``next_value``: the value of the row after it by id; after the last comes the first.

    Rows are dealt to buckets by id and sorted inside them, so each value is shuffled once. The
    first row of a bucket also visits the bucket before it as a guest, which puts it behind that
    bucket's last row; drop guests when they are no longer needed. (bucket, seq) identifies a
    row, and the result is partitioned by bucket. Rows of equal ids follow each other by the
    hash of their value; null ids come last. The bucket starts are the only thing that reaches
    the driver: four for each shuffle partition.
    """
    starts = _buckets(rows, id_col) or [0]
    bucket = _bucket_of(F.col(id_col), starts)
    before = (F.col("_home") + len(starts) - 1) % len(starts)
    firsts = F.array(*[F.lit(x) for x in starts])
    visits = F.when(F.col(id_col) == F.get(firsts, F.col("_home")), F.array(
        F.struct(F.col("_home").alias("bucket"), F.lit(False).alias("guest")), F.struct(before.alias("bucket"), F.lit(True).alias("guest")))).otherwise(
        F.array(F.struct(F.col("_home").alias("bucket"), F.lit(False).alias("guest"))))
    dealt = rows.withColumn("_home", bucket).withColumn("_visit", F.explode(visits)).select(*rows.columns, "_visit.*")
    order = Window.partitionBy("bucket").orderBy("guest", F.col(id_col).asc_nulls_last(), F.xxhash64(value_col))
    return dealt.withColumns({"seq": F.row_number().over(order), "next_value": F.lead(value_col).over(order)})
