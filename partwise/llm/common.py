"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partwise.session import cut_lineage, scratch_path

#: ASCII white space, as the contracts of the word-based operators spell it.
WORD = r"[^\x20\x09-\x0D]+"


def text_of(col: str = "text") -> Column:
    """The whole text; null reads as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def bucket_of(col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``: the fold rule of the labelled operators."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(modulus))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: later jobs read it instead of computing it again."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sampled_rows(rows: DataFrame, id_col: str, bound: int) -> DataFrame:
    """About ``bound`` rows, chosen by a hash of the id; all rows where there are fewer. The choice is row-local."""
    share = min(1.0, bound / max(1, rows.count()))
    return rows.filter(F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")), F.lit(1 << 20)) < share * (1 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame) -> DataFrame:
    """(v, label): smallest node reachable from each node of the edge list (a, b).

    Each round takes the smallest neighbouring label and then that label's own label, so
    chains shorten by half; every round is checkpointed and the loop ends when none changes.
    """
    both = cut_lineage(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).filter("u <> v").distinct())
    labels = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("v"), F.least("u", "m").alias("label")))
    while True:
        near = both.join(labels, "v").groupBy("u").agg(F.min("label").alias("m"))
        step = labels.join(near, labels["v"] == near["u"]).select("v", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("far"))
        nxt = step.join(jump, "label").select("v", "old", F.least("label", "far").alias("label"))
        nxt = cut_lineage(nxt)
        if nxt.filter("label <> old").isEmpty():
            return nxt.select("v", "label")
        labels = nxt.select("v", "label")
