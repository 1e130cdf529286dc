"""Token counts as rollups that signed changes maintain.

A change carries a document's state before and after it: an insert has no before, a delete no
after, a revision both. Its delta takes the tokens of the one from their totals and adds those
of the other, for each tokenizer version. Totals are sums of deltas, so batches may be applied
in any order, once each: a batch is a folder named by its id, and one that has been committed is
not written again, whatever it is handed a second time.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partwise.llm.common import WORD

#: A tokenizer version's count of a text that is not null.
Counter = Callable[[Column], Column]
KEYS = ["source", "lang", "tokenizer"]
STATE = "struct<source:string,lang:string,text:string>"


def words(text: Column) -> Column:
    """Runs between ASCII white space."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def pieces(text: Column) -> Column:
    """Runs of letters, runs of digits, and every other visible character."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{M}]+|\p{N}+|[^\p{L}\p{M}\p{N}\x20\x09-\x0D]")).cast("long")


def vocabulary(path: str) -> Counter:
    """Ids of a tokenizer file, without special tokens added."""

    def counter(text: Column) -> Column:
        @F.arrow_udf("long")
        def count(texts: pa.Array) -> pa.Array:
            from partwise.llm.packing import encoder

            encode = encoder(path)
            return pa.array([None if t.as_py() is None else len(encode(t.as_py())) for t in texts], pa.int64())

        return count(text)

    return counter


def state(source: Column, lang: Column, text: Column) -> Column:
    return F.struct(source.cast("string").alias("source"), lang.cast("string").alias("lang"), text.cast("string").alias("text"))


def deltas(changes: DataFrame, tokenizers: dict[str, Counter], before: str = "before", after: str = "after") -> DataFrame:
    """(source, lang, tokenizer, docs, tokens): what the changes add to the totals.

    ``changes`` has two states (see ``state``), null where the document does not exist. Null
    sources and languages are keys like others, a null text counts as empty, repeated changes
    count as often as they stand. A change without either state adds nothing.
    """
    signed = [changes.filter(F.col(side).isNotNull()).select(F.lit(sign).alias("sign"), F.col(f"{side}.source").alias("source"), F.col(f"{side}.lang").alias("lang"),
                                                             F.coalesce(F.col(f"{side}.text"), F.lit("")).alias("text")) for side, sign in ((before, -1), (after, 1))]
    rows = reduce(DataFrame.unionByName, signed)
    counted = rows.select("sign", "source", "lang", *[c(F.col("text")).alias(f"t{i}") for i, c in enumerate(tokenizers.values())])
    # One row per source and language before the versions are spread.
    summed = counted.groupBy("source", "lang").agg(F.sum("sign").alias("docs"), *[F.sum(F.col("sign") * F.col(f"t{i}")).alias(f"t{i}") for i in range(len(tokenizers))])
    spread = F.explode(F.array(*[F.struct(F.lit(name).alias("tokenizer"), F.col(f"t{i}").alias("tokens")) for i, name in enumerate(tokenizers)]))
    return summed.select("source", "lang", "docs", spread.alias("s")).select("source", "lang", "s.tokenizer", "docs", "s.tokens")


class Rollup:
    """Totals in a folder that the cluster shares: ``batch=<id>`` for each committed batch, ``base=<id>`` for totals up to a batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _ids(self, kind: str) -> list[int]:
        """Ids of the folders that were written to the end: a job that failed leaves no success mark."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}=*/_SUCCESS")
        marks = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        return sorted(int(re.search(rf"{kind}=(\d+)/_SUCCESS$", m.getPath().toString())[1]) for m in marks)

    def commit(self, batch: int, delta: DataFrame) -> bool:
        """Write a batch's deltas unless the batch or a base that covers it is there; a half-written one is replaced. True if it was new."""
        if batch in self._ids("batch") or any(batch <= b for b in self._ids("base")):
            return False
        delta.select(*KEYS, "docs", "tokens").write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return True

    def _parts(self, upto: int | None = None) -> list[str]:
        bases = [b for b in self._ids("base") if upto is None or b <= upto]
        base = bases[-1] if bases else -1
        batches = [b for b in self._ids("batch") if b > base and (upto is None or b <= upto)]
        return [f"{self.path}/base={base}"] * bool(bases) + [f"{self.path}/batch={b}" for b in batches]

    def totals(self, upto: int | None = None) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) over all batches, or those up to an id; groups without a document left are dropped."""
        schema = "source string, lang string, tokenizer string, docs long, tokens long"
        parts = self._parts(upto)
        rows = self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 OR tokens <> 0")

    def compact(self, upto: int) -> None:
        """Sum the batches up to an id into one base; they must all have arrived, since later ones of that range are then refused."""
        if upto not in self._ids("base"):
            self.totals(upto).write.mode("overwrite").parquet(f"{self.path}/base={upto}")
