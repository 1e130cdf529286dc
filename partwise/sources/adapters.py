"""Source adapters: named loaders with the checks every source must pass."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from partwise.operators.mapping import apply_mapping, auto_mapping
from partwise.sources import readers as R

ADAPTERS: dict[str, Callable[..., DataFrame]] = {
    "csv": R.read_csv,
    "json": R.read_json_records,
    "parquet": lambda spark, path, **_: R.read_parquet(spark, path),
    "table": lambda spark, name, **o: R.read_table(spark, name, **o),
    "query": lambda spark, query, **o: R.read_query(spark, query, **o),
}


def register_adapter(name: str, loader: Callable[..., DataFrame]) -> None:
    ADAPTERS[name] = loader


def validate(df: DataFrame) -> DataFrame:
    """A source must have columns and at least one row."""
    if not df.columns or df.isEmpty():
        raise ValueError("the source holds no rows or no columns")
    return df


def load(spark: SparkSession, kind: str, *args, **options) -> DataFrame:
    return validate(ADAPTERS[kind](spark, *args, **options))


def load_standard(spark: SparkSession, kind: str, *args, mapping: dict[str, str] | None = None, **options) -> DataFrame:
    """Load a source and bring it to the standard schema, recognising its headers when no mapping is given."""
    df = load(spark, kind, *args, **options)
    return apply_mapping(df, mapping or auto_mapping(df.columns))
