"""The corpus pipeline: language, toxicity, near-duplicates, mixing, packing; each stage a function of documents.

Every stage reads all rows that the one before it wrote and returns rows with the columns of
``documents``; the last returns the places of the packed pieces. An empty table passes through
all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partwise.llm import language, mixing, packing, simhash_tiles, toxicity
from partwise.llm.common import bucket_of, table, written
from partwise.llm.queries import CAP, SCHEDULES, SHARE, WEIGHTS, tokenizer_path
from partwise.plans.registry import Query

#: No language is clearly ahead below so many times the score of an even text, which is one over the number of languages.
LEAST_LANGUAGE_SCORE = 1.4
MOST_TOXICITY = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those without a letter (null and empty texts too) or a clear language go.

    The filters learn from the rows' own ``lang`` where there is one. Whole texts count; repeated
    rows have one fate; all columns stay, whatever their names; an empty table stays empty.
    """
    filters = language.learn(docs.filter(bucket_of("doc_id", 5) != 0))
    found = docs.select(F.struct("*").alias("row"), language.identify(filters, docs).alias("found"))
    least = LEAST_LANGUAGE_SCORE / max(2, len(filters.languages))
    return found.filter((F.col("found.lang_pred") != language.UNKNOWN) & (F.col("found.score") >= least)).select("row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine does not hold toxic. It learns from the labelled rows among them.

    Null and empty texts have the score of a text without known words; whole texts count;
    repeated rows have one fate; all columns stay, whatever their names; an empty table stays empty.
    """
    machine = toxicity.learn(docs, table(spark, sf_dir, "labels").filter(bucket_of("doc_id", 5) != 0))
    return docs.select(F.struct("*").alias("row"), toxicity.toxicity(machine, docs).alias("score")).filter(F.col("score") < MOST_TOXICITY).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group; null and wordless texts are one group, ties go by the text's hash.

    One of repeated rows stays; all columns stay, whatever their names; an empty table stays empty.
    """
    return simhash_tiles.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in training order. Null texts have no words, a null source is a source;
    repeated rows are documents of their own; all columns stay, whatever their names; an empty table stays empty."""
    return mixing.in_training_order(docs, mixing.mix(docs, WEIGHTS, SHARE, CAP, SCHEDULES))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences. Null and empty texts are one token long, only texts of more than
    a sequence are cut, repeated rows are packed each; other columns are ignored; an empty table gives no pieces."""
    packed = packing.pack_documents(docs, tokenizer_path(), with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: No stage but the mixing can be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


REGISTRY = {"pipeline": Query(run, ORACLE_SQL)}
