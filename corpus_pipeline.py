"""A training corpus from documents: toxic ones go, then copies and near copies, then sources are mixed and texts encoded."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from talkmill.llm.common import cut, fresh
from talkmill.llm.exact import drop_exact
from talkmill.llm.mixing import mix_sources
from talkmill.llm.near import drop_near
from talkmill.llm.queries import MODEL
from talkmill.llm.tokens import encode, with_token_counts
from talkmill.llm.toxicity import drop_toxic


#: Rows that Spark hands to Python at a time, on its way into a stage and out of it. Rows are texts of some KB here, and a task holds such a
#: batch several times over, inside and outside the JVM.
ROWS_A_BATCH = 1000


def in_small_batches(stage):
    """The stage with ROWS_A_BATCH set for the session, unless fewer are set already."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(name)) <= ROWS_A_BATCH:
            spark.conf.set(name, str(ROWS_A_BATCH))
        return stage(spark, docs, sf_dir)

    return run_stage


@in_small_batches
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the model fitted on all labels doesn't predict toxic. Null, empty and blank texts stay; repeated rows
    share their fate; without labels of both kinds, or on an empty table, nothing goes. Very long texts are read whole;
    further columns, whatever their names, come along."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased, null as empty), the row with the largest id; of rows that repeat that id and text,
    one. An empty table stays empty; further columns, whatever their names, come along."""
    return drop_exact(docs, keep="max")


@in_small_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 80 %), the document with the smallest id. Null, empty and blank texts and
    null ids stay, as do repeated rows of a document that stays. An empty table stays empty; further columns come along."""
    return drop_near(docs)


@in_small_batches
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix draws them, by their numbers of tokens. Null sources are one source; texts without tokens
    come with their block; repeated rows are drawn each on their own. An empty table stays empty; further columns come along."""
    names = fresh(docs, "tokens", "epoch", "at")
    counted = lambda rows, name: with_token_counts(rows, MODEL, name)
    return mix_sources(docs, names=tuple(names), counted=counted).drop(*names)


@in_small_batches
def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and round_trip of each row. Null and empty texts have no ids; repeated rows are encoded alike."""
    return encode(docs, MODEL)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("sentencepiece", sentencepiece)]

#: The stages' models and encodings are beyond SQL; tests hold each stage against plain Python on what it was given, and run() against the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage keeps is checkpointed, as each later one reads it more than once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
