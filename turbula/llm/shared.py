"""Cutting lineage in the folder that the cluster shares, and bounded samples."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where Spark runs on this machine alone."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="turbula-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The same rows, written once as Parquet in the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/turbula-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_sample(df: DataFrame, keys: list[str | Column], bound: int, n: int | None = None) -> list:
    """At most ``bound`` rows, chosen by a hash of ``keys``: the same rows however they are partitioned."""
    n = df.count() if n is None else n
    mark = F.pmod(F.xxhash64(*keys), F.lit(1 << 40))
    least = -(-(1 << 40) * bound // max(1, n))
    rows = df.withColumn("_mark", mark).where(F.col("_mark") < least).collect()
    return sorted(rows, key=lambda r: r["_mark"])[:bound]
