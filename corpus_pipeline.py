"""From raw documents to token ids: five stages, each written down before the next one reads it.

Every stage takes all that the one before kept. The first four return the columns of the documents; n_chars, where it is a
column, follows the text. Rows without a doc_id cannot be named, so the near-duplicate stage keeps them. The stages learn from
and compare what they are given: toxicity from all labels of the documents, near duplicates among what toxicity left, repeats
among what near duplicates left, and so on. An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recohort.llm import bpe, decontaminate, minhash, suffixes, toxicity
from recohort.session import pin

#: A document goes if its probability of being toxic is at least this.
TOXIC_FROM = 0.5


def _with_length(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    scored = toxicity.score(docs, toxicity.fit(docs, labels), "_toxic")
    return scored.where(F.col("_toxic") < TOXIC_FROM).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id."""
    gone = pin(minhash.near_duplicates(docs).where("not kept and doc_id is not null").select("doc_id").distinct(), "copies")
    few = F.broadcast(gone) if gone.count() <= minhash.BROADCAST_IDS else gone
    return docs.join(few, "doc_id", "left_anti").select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_length(suffixes.remove_repeats(docs))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Written down between: two Python operators in one stage would hold twice the workers.
    found = pin(decontaminate.find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "hits")
    return _with_length(decontaminate.cut_spans(found).select(*docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids; round_trip tells that the ids decode to the text."""
    found = bpe.encode_documents(docs, bpe.vocabulary("byte_bpe_50k.json"), "ids", "_decoded")
    return found.withColumns({"n_tokens": (F.length("ids") / 4).cast("long"), "round_trip": F.col("_decoded") == F.coalesce("text", F.lit(""))}).drop("_decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_strings", drop_repeats),
    ("benchmark", drop_benchmark),
    ("tokens", encode),
]

#: Learnt scores and byte-wise removal have no SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = pin(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
