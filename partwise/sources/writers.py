"""File and table sinks, and the keyed write patterns (upsert, insert-if-absent, replace-for-key)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_file(df: DataFrame, path: str, fmt="csv", sep=",", mode="overwrite", now: datetime | None = None, bom=True):
    """Write csv, json or parquet; an empty frame is skipped. Returns the path written, or None.

    ``{timestamp}`` in the path is filled once. CSV files start with a byte-order mark
    (carried by the first header) so that spreadsheets read them as UTF-8.
    """
    if df.isEmpty():
        return None
    path = path.replace("{timestamp}", (now or datetime.now()).strftime("%Y%m%d_%H%M%S"))
    if fmt == "csv":
        first = df.columns[0]
        out = df.withColumnRenamed(first, "\ufeff" + first) if bom else df
        out.write.mode(mode).csv(path, header=True, sep=sep, encoding="UTF-8")
    elif fmt == "json":
        df.write.mode(mode).json(path)
    elif fmt == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"unknown format {fmt}")
    return path


# What to do when the target table exists.
IF_EXISTS = {"fail": "error", "replace": "overwrite", "append": "append"}


def write_jdbc(df: DataFrame, url: str, dbtable: str, if_exists="append", properties: dict | None = None) -> int:
    """Write to a database table and return the rows written, counted during the write."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.jdbc(url, dbtable, IF_EXISTS[if_exists], properties or {})
    return seen.get["n"]


def _pick_per_key(df: DataFrame, keys: list[str], order: list[Column], pick) -> DataFrame:
    """One row per key as a map-side combined aggregate, so a hot key is never one task's window."""
    chosen = df.groupBy(*keys).agg(
        pick(F.struct(*df.columns), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("r"))
    return chosen.select("r.*")


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return _pick_per_key(df, keys, order, F.max_by)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return _pick_per_key(df, keys, order, F.min_by)


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows replace the target's rows of the same key; inside the batch the last by ``order`` wins."""
    batch = latest_per_key(rows, keys, order)
    return target.join(batch.select(*keys), keys, "left_anti").unionByName(batch.select(*target.columns))


def merge_into(rows: DataFrame, table: str, keys: list[str], order: list[Column]) -> None:
    """The same upsert as a MERGE, for catalogs whose tables support row-level writes."""
    batch = latest_per_key(rows, keys, order)
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{table}.{k}").eqNullSafe(F.col(f"batch.{k}"))
    batch.alias("batch").mergeInto(table, on).whenMatched().updateAll().whenNotMatched().insertAll().merge()


class KeyedTable:
    """A table stored in hash buckets of its keys; a commit rewrites the buckets that its rows fall into and no others.

    Commits carry a batch id and a batch is applied once, so a batch that is delivered again
    changes nothing. One writer at a time; a commit that fails half-way is repaired by
    committing the same batch again. The number of buckets is fixed when the table is made.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], buckets: int = 256):
        self.spark, self.rows_path, self.log_path, self.keys, self.buckets = spark, f"{folder}/rows", f"{folder}/batches", keys, buckets

    def create(self, rows: DataFrame) -> None:
        """Store ``rows``, one per key, as the first contents."""
        self._write(rows.withColumn("bucket", self._bucket()))
        self.spark.createDataFrame([], "batch string").write.mode("overwrite").parquet(self.log_path)

    def read(self) -> DataFrame:
        return self._stored().drop("bucket")

    def commit(self, batch: str, rows: DataFrame, order: list[Column]) -> int:
        """Upsert ``rows``; the last of a key by ``order`` counts. Gives the number of buckets rewritten, 0 for a batch already applied."""
        if not self.spark.read.parquet(self.log_path).filter(F.col("batch") == batch).isEmpty():
            return 0
        changed = latest_per_key(rows, self.keys, order).withColumn("bucket", self._bucket())
        touched = [r.bucket for r in changed.select("bucket").distinct().collect()]  # at most the number of buckets
        if touched:
            self._write(upsert(self._stored().filter(F.col("bucket").isin(touched)), changed, self.keys, order))
        self.spark.createDataFrame([(batch,)], "batch string").write.mode("append").parquet(self.log_path)
        return len(touched)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame:
        return self.spark.read.parquet(self.rows_path)

    def _write(self, rows: DataFrame) -> None:
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.rows_path)


def insert_if_absent(target: DataFrame, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows whose key the target lacks, first per key, appended to it."""
    fresh = first_per_key(rows, keys, order).join(target.select(*keys), keys, "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def replace_for_key(target: DataFrame, lists: DataFrame, key: str, items: str) -> DataFrame:
    """Delete a key's rows and insert its new ordered list (``items`` array of struct) from position 1."""
    kept = target.join(lists.select(key), key, "left_anti")
    fresh = lists.select(key, F.posexplode(items).alias("pos", "item")).select(
        key, "item.*", (F.col("pos") + 1).alias("display_order"))
    return kept.unionByName(fresh)


def nest_stages(sessions: DataFrame, stages: dict[str, DataFrame], key: str) -> DataFrame:
    """One nested document per session: each stage's rows as an array under the stage name."""
    out = sessions
    for name, rows in stages.items():
        fields = [c for c in rows.columns if c != key]
        packed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
        out = out.join(packed, key, "left")
    return out
