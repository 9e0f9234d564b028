"""Session settings, and tables that cut lineage in the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """UTC instants everywhere; the rest of the configuration belongs to the cluster."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark



def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; on a local master without it, one beside the warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared"
    return f"{configured.rstrip('/')}/recohort/{spark.sparkContext.applicationId}"


def enough_parts(spark: SparkSession, rows: int, most: int) -> int:
    """Into how many parts rows are dealt so that a part has about ``most``, and every core one."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // most))


def new_folder(spark: SparkSession, name: str) -> str:
    """A path nothing else uses; all paths of an application share one parent folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def pin(frame: DataFrame, name: str = "table", compression: str | None = None) -> DataFrame:
    """Write the rows once and read them back, so that later uses see the very same rows.

    The written table survives lost executors, and its columnar form lets each later use read
    only the columns it needs.
    """
    path = new_folder(frame.sparkSession, name)
    frame.write.parquet(path, compression=compression)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
