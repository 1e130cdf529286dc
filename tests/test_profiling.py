"""Industry recognition on sources of very different sizes."""

from pyspark.sql import functions as F

from partwise.operators import profiling as D
from partwise.rules import industry as I


def test_industry_goes_by_density(spark):
    """One stray phrase of another industry in a thousand rows never outweighs the common one, however many rows there are."""
    common, stray = I.INDICATORS["medical"], I.INDICATORS["manufacturing"]
    kind = next(k for k in I.KIND_WEIGHTS if k != "patterns")
    words, odd = " ".join(common[kind]), " ".join(stray[kind])
    for rows in (100, 1000, 50_000):
        df = spark.range(rows).select(F.when(F.col("id") % 1000 == 0, F.lit(odd)).otherwise(F.lit(words)).alias("name"))
        assert D.recognise_industry(D.industry_scores(df)).first().industry == "medical"
