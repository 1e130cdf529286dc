"""Header recognition and the standard record. Headers are schema, so they are plain Python; rows never are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partwise.rules import headers as H
from partwise.session import cut_lineage


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(mapping)


def _hits(header: str, synonyms: list[str]) -> bool:
    return any(s in header for s in synonyms)


def best_template(columns: list[str], templates=H.TEMPLATES) -> str:
    """Template with the most standard fields recognised; the first listed wins a tie."""
    return max(templates, key=lambda t: sum(any(_hits(c, syn) for c in columns) for syn in templates[t].values()))


def auto_mapping(columns: list[str], template: str = "auto", templates=H.TEMPLATES) -> dict[str, str]:
    """Standard field -> first header that contains one of its synonyms."""
    chosen = templates[best_template(columns, templates) if template == "auto" else template]
    found = {f: next((c for c in columns if _hits(c, syn)), None) for f, syn in chosen.items()}
    return {f: c for f, c in found.items() if c is not None}


def _ranked_mapping(columns: list[str], rules) -> dict[str, str]:
    """Each header takes the first rule it meets; a later header replaces an earlier one."""
    out = {}
    for c in columns:
        target = next((f for f, syn in rules if _hits(c.lower(), syn)), None)
        if target:
            out[target] = c
    return out


def training_mapping(columns: list[str]) -> dict[str, str]:
    return _ranked_mapping(columns, H.TRAINING_HEADERS)


def industry_mapping(columns: list[str], industry: str) -> dict[str, str]:
    return _ranked_mapping(columns, H.INDUSTRY_HEADERS.get(industry, H.INDUSTRY_HEADERS["generic"]))


def text(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def apply_mapping(df: DataFrame, mapping: dict[str, str], keep: list[str] | None = None) -> DataFrame:
    """The standard schema as non-null text; required fields without a source become ''."""
    out = [F.col(k) for k in keep or []]
    out += [text(mapping[f]).alias(f) for f in H.STANDARD_FIELDS if mapping.get(f) in df.columns]
    out += [F.lit("").alias(f) for f in H.REQUIRED_FIELDS if mapping.get(f) not in df.columns]
    return df.select(*out)


def with_position(df: DataFrame, order: list[str], name="position") -> DataFrame:
    """Dense 0-based position in ``order`` without a single-task window.

    The rows are range-sorted and checkpointed, so partition and place are facts of a
    written table; only one count per partition meets in the running sum.
    """
    row_bits = (1 << 33) - 1
    placed = cut_lineage(df.sort(*order).withColumns(
        {"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit(row_bits))}))
    starts = placed.groupBy("_part").agg(F.count("*").alias("n")).select(
        "_part", F.expr("coalesce(sum(n) OVER (ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("_start"))
    # One row per partition, so the broadcast is bounded by the partition count.
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def first_nonblank(fields: list[Column], default: str | None = None) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in fields], F.lit(default))


def joined_distinct(fields: list[Column], sep=" | ") -> Column:
    """Distinct non-blank values in field order."""
    return F.array_join(F.array_distinct(F.array_compact(F.array(*[F.nullif(F.trim(c), F.lit("")) for c in fields]))), sep)


def clean_name(c: Column) -> Column:
    squeezed = F.regexp_replace(F.trim(c), r"\s+", " ")
    return F.regexp_replace(squeezed, r"[^\p{L}\p{N}_\s\-\(\)]", "")


# Aliases accepted for each identity field, in order.
IDENTITY_ALIASES = {
    "material_code": ["material_code", "code"],
    "material_name": ["material_name", "name"],
    "specifications": ["specifications", "specification", "spec"],
    "manufacturer": ["manufacturer", "mfg"],
    "material_type": ["material_type", "type"],
    "unit": ["unit"],
    "source_system": ["source_system"],
}


def identity_records(df: DataFrame, order: list[str]) -> DataFrame:
    """Identity schema by aliases; a missing code becomes MAT_%06d of the row's position; the raw row is kept as a map."""
    placed = with_position(df, order)
    out = []
    for field, names in IDENTITY_ALIASES.items():
        known = [F.nullif(text(n), F.lit("")) for n in names if n in df.columns]
        default = F.format_string("MAT_%06d", "position") if field == "material_code" else F.lit("")
        out.append(F.coalesce(*known, default).alias(field))
    raw = F.map_from_arrays(F.array(*[F.lit(c) for c in df.columns]), F.array(*[text(c) for c in df.columns]))
    return placed.select(*out, raw.alias("raw_attributes"))


# Cell order of a positional upload.
CELLS = ["code", "description", "name", "category", "spec", "model", "unit"]


def positional_records(df: DataFrame, cells: str) -> DataFrame:
    """Cells by position; the description is the name when present; rows under three cells are dropped."""
    rest = [c for c in df.columns if c != cells]
    got = {n: F.coalesce(F.get(cells, F.lit(i)), F.lit("")) for i, n in enumerate(CELLS)}
    name = F.when(F.trim(got["description"]) != "", got["description"]).otherwise(got["name"])
    return df.filter(F.size(cells) >= 3).select(
        *rest, got["code"].alias("code"), name.alias("name"), got["category"].alias("category"),
        F.concat_ws(" ", F.nullif(got["spec"], F.lit("")), F.nullif(got["model"], F.lit(""))).alias("spec"), got["unit"].alias("unit"))


def compat_view(df: DataFrame, aliases: dict[str, str], view: str) -> DataFrame:
    df.select(*[F.col(s).alias(t) for t, s in aliases.items()]).createOrReplaceTempView(view)
    return df.sparkSession.table(view)


def flatten_matches(df: DataFrame, inputs: list[str], matches: str) -> DataFrame:
    """``input_*`` columns, the best match's fields, the match count and a status."""
    best = F.get(matches, F.lit(0))
    element = df.schema[matches].dataType.elementType
    assert isinstance(element, T.StructType)
    detail = [best[f].alias(f"best_match_{f}") for f in element.names if f != "similarity"]
    return df.select(
        *[F.col(c).alias(f"input_{c}") for c in inputs], F.coalesce(best["similarity"], F.lit(0.0)).alias("best_match_similarity"),
        *detail, F.coalesce(F.size(matches), F.lit(0)).alias("match_count"), F.lit("success").alias("processing_status"))


def union_sources(frames: list[tuple[DataFrame, dict[str, str]]], text_fields=("name", "specification", "manufacturer")) -> DataFrame:
    """Rename each source, fill nulls, union by name, and add the combined text."""
    renamed = [rename(df, m).na.fill("", list(text_fields)) for df, m in frames]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), renamed)
    return both.withColumn("combined_text", F.concat_ws(" ", *text_fields))
