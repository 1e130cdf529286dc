"""The config-driven filter language, searches and paging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partwise.sources.writers import first_per_key

COMPARE = {
    "==": lambda c, v: c == v,
    "!=": lambda c, v: ~c.eqNullSafe(v),
    ">": lambda c, v: c > v,
    "<": lambda c, v: c < v,
    ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(list(v)),
    "not_in": lambda c, v: ~F.coalesce(c.isin(list(v)), F.lit(False)),
    "contains": lambda c, v: F.coalesce(c.rlike(str(v)), F.lit(False)),
}


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    """Known columns only; when none is known the frame stays as it is."""
    known = [c for c in columns if c in df.columns]
    return df.select(*known) if known else df


def condition(column: str, operator: str, value) -> Column:
    return COMPARE[operator](F.col(column), F.lit(value) if operator not in ("in", "not_in", "contains") else value)


def where_all(df: DataFrame, conditions: list[dict]) -> DataFrame:
    """AND of the conditions; one on a column the frame lacks has no effect."""
    for c in conditions:
        if c["column"] in df.columns:
            df = df.filter(condition(c["column"], c.get("operator", "=="), c["value"]))
    return df


def drop_duplicates(df: DataFrame, subset: list[str] | None = None, order: list[Column] | None = None) -> DataFrame:
    """First row per subset; ``order`` says which is first, without it any copy may stay."""
    keys = subset or df.columns
    return first_per_key(df, keys, order) if order else df.dropDuplicates(keys)


def sort(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """Nulls go last either way."""
    c = F.col(column)
    return df.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last())


def apply_filters(df: DataFrame, filters: dict, order: list[Column] | None = None) -> DataFrame:
    """columns -> conditions -> duplicates -> sort -> limit, each optional."""
    if "columns" in filters:
        df = project(df, filters["columns"])
    df = where_all(df, filters.get("conditions", []))
    if filters.get("drop_duplicates"):
        df = drop_duplicates(df, filters.get("duplicate_subset"), order)
    by = filters.get("sort_by")
    if by:
        by = {"column": by} if isinstance(by, str) else by
        df = sort(df, by["column"], by.get("ascending", True))
    return df.limit(filters["limit"]) if "limit" in filters else df


def like_any(columns: list[str], keyword: str) -> Column:
    escaped = keyword.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{escaped}%") for c in columns])


def keyword_search(df, columns, keyword, equal=None, order=None, limit=None) -> DataFrame:
    """Case-insensitive substring search over several columns, with optional equalities."""
    df = df.filter(like_any(columns, keyword)) if keyword else df
    for name, value in (equal or {}).items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    df = df.orderBy(*order) if order else df
    return df.limit(limit) if limit is not None else df


def page(df: DataFrame, index: str, limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(index).offset(offset).limit(limit)


def result_log(df, session=None, kind=None, file=None, json_columns=None, newest="created_at", tie=None) -> DataFrame:
    """Filtered log, newest first, JSON text columns parsed by the given schemas."""
    for name, value in (("session_id", session), ("processing_type", kind), ("file_id", file)):
        if value is not None:
            df = df.filter(F.col(name) == value)
    for name, schema in (json_columns or {}).items():
        df = df.withColumn(name, F.from_json(name, schema))
    return df.orderBy(F.col(newest).desc(), *([tie] if tie else []))
