"""Sinks: datasets with unit rows, missing-value codes and gap filling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turbula.functions.constants import MISSING
from turbula.operators.periods import fill_gaps


def with_missing_code(df: DataFrame, code: float = MISSING) -> DataFrame:
    """Numbers as they are, nulls as the missing-value code."""
    numeric = ("double", "float", "int", "bigint", "smallint")
    return df.select(*[F.coalesce(F.col(c), F.lit(code).cast(t)).alias(c) if t in numeric else F.col(c) for c, t in df.dtypes])


def write_full_output(results: DataFrame, periods: DataFrame | None, path: str, on: str = "period", groups: dict[str, str] | None = None, units: dict[str, str] | None = None) -> None:
    """Text dataset, continuous if ``periods`` is given, with group, name and unit rows in a folder of its own."""
    full = with_missing_code(fill_gaps(periods, results, on) if periods is not None else results)
    full.write.mode("overwrite").option("header", "true").csv(f"{path}/data")
    rows = [",".join((d or {}).get(c, e) for c in full.columns) for d, e in ((groups, ""), ({c: c for c in full.columns}, ""), (units, "--"))]
    full.sparkSession.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")


def write_network_file(results: DataFrame, path: str, gains: dict[str, tuple[float, float]] | None = None) -> None:
    """One row for each period that has results, with unit gains and offsets; it is not gap-filled."""
    scaled = results
    for name, (gain, offset) in (gains or {}).items():
        scaled = scaled.withColumn(name, F.col(name) * gain + offset)
    with_missing_code(scaled).write.mode("overwrite").option("header", "true").csv(path)


def write_by_period(df: DataFrame, path: str, period: str = "period") -> None:
    """Spectra, raw levels and other long tables, a folder for each period."""
    df.write.mode("overwrite").partitionBy(period).parquet(path)


def write_model(df: DataFrame, path: str) -> None:
    """A fitted model's table, to be read again instead of fitted."""
    df.write.mode("overwrite").parquet(path)


def read_essentials(spark, path: str, schema: str) -> DataFrame:
    """Period results of an earlier step, missing-value codes as nulls."""
    df = spark.read.option("header", "true").schema(schema).csv(path)
    return df.select(*[F.when(F.col(c) != MISSING, F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
