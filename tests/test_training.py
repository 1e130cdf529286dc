"""Learning of weights."""

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from partwise.operators import training as T


def test_cross_validation_in_a_session_with_tags(spark):
    own = spark.newSession()  # tags make a session one that no task can be sent with
    rows = [(i, i * 7 % 10 / 10, i * 3 % 8 / 8, int(i * 7 % 10 + i % 4 > 6)) for i in range(200)]
    df = own.createDataFrame(rows, "code long, confidence double, accuracy double, label int")
    weights = {"confidence": 0.5, "accuracy": 0.25}
    scaled = df.select("label", F.pmod(F.xxhash64("code"), F.lit(5)).alias("fold"), *[(F.col(k) * w).alias(k) for k, w in weights.items()])
    data = VectorAssembler(inputCols=list(weights), outputCol="features").transform(scaled)
    want = []
    for fold in range(5):
        model = LogisticRegression(maxIter=50, regParam=0.001).fit(data.filter(F.col("fold") != fold))
        want.append(model.transform(data.filter(F.col("fold") == fold)).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0])
    own.addTag("run")
    try:
        assert T.cross_validate(df, weights, "code") == pytest.approx(want)
    finally:
        own.clearTags()
