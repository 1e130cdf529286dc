"""Rows that every text operator must take: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
LONG = "word " * 60_000 + "Ende. " * 40_000
AWKWARD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n", None, None), (4, LONG, "de", "b"), (5, "one", "en", None), (6, "Two  words", "en", "a"),
    (7, "Two words", "en", "a"), (7, "Two words", "en", "a"), (8, "12 34 -- !!", "fr", "b"), (9, "中文 <|endoftext|> ñandú  é ☃", "es", "c"),
    (10, "two words\x1cthree four five", None, "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def awkward(spark):
    """The rows above, with columns whose names an operator might use itself."""
    df = spark.createDataFrame(AWKWARD, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in ("n_chars", "fp", "label", "host", "size", "position", "score", "id", "bucket", "seq", "rank", "length",
                                                   "quality", "toxic", "held_out", "target", "component_id", "tile", "_text", "h", "w")})


def empty(spark):
    return awkward(spark).limit(0)


def documents(spark, name="documents"):
    return spark.read.parquet(f"{SF}/{name}.parquet")
