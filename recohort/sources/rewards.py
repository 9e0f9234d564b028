"""Distribution files: one JSON document per file, kept as variants so value types stay visible."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_distribution_texts(spark: SparkSession, path, epoch_pattern: str = r"(\d{4}-\d{2}-\d{2})") -> DataFrame:
    """(file, epoch_start, text) with the epoch taken from the path."""
    rows = spark.read.option("wholetext", True).text(path).withColumn("file", F.input_file_name())
    return rows.select("file", F.regexp_extract("file", epoch_pattern, 1).alias("epoch_start"), F.col("value").alias("text"))


def distribution_documents(texts: DataFrame) -> DataFrame:
    """Parsed documents; unreadable JSON and repeated keys give a null payload."""
    return texts.select("file", "epoch_start", F.try_parse_json("text").alias("payload"))


def _entries(documents: DataFrame, path: str) -> DataFrame:
    """Entries of a map, and one row without a key for a missing or empty map."""
    entries = F.try_variant_get("payload", path, "map<string,variant>")
    return documents.select("file", "epoch_start", entries.alias("m")).select(
        "file", "epoch_start", F.col("m").isNotNull().alias("recorded"), F.explode_outer("m").alias("k", "v"))


def ingest_reward_files(documents: DataFrame) -> DataFrame:
    """(file, epoch, recipient, raw amount as text, JSON type of the amount)."""
    return _entries(documents, "$.amounts").filter("k IS NOT NULL").select(
        "file", "epoch_start", F.col("k").alias("recipient"),
        F.try_variant_get("v", "$", "string").alias("amount_raw"), F.schema_of_variant("v").alias("amount_kind"))


def ingest_override_maps(documents: DataFrame) -> DataFrame:
    """(file, epoch, recorded, original, receiver); a file without the map has one row, recorded false.

    An empty map gives one row too, recorded true with a null original.
    """
    return _entries(documents, "$.appliedOverrides").select(
        "file", "epoch_start", "recorded", F.col("k").alias("original"),
        F.try_variant_get("v", "$", "string").alias("receiver"))
