"""What the catalog's queries share: the test signal, rounding, and the registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turbula.operators.periods import seconds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the DuckDB SQL that must give the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Rounded to six digits, without negative zero; moved a little first, as short decimals are often ties."""
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(3.1e-8), 6) + F.lit(0.0)


def rounded(df: DataFrame) -> DataFrame:
    """All double columns rounded."""
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wind-like signal from the events: a period of a day, a record number, a scalar with gaps and three components."""
    e = table(spark, sf_dir, "events")
    day = F.floor(seconds("ts") / 86400).cast("long")
    base = e.select(
        day.alias("p"), "event_id", "ts", seconds("ts").alias("sec"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("x"),
        (F.col("user_id") % 21).cast("double").alias("_u"), (F.col("user_id") % 13).cast("double").alias("_v"),
        (F.col("event_id") % 17).cast("double").alias("_w"),
    )
    rec = F.row_number().over(Window.partitionBy("p").orderBy("ts")).cast("long")
    return base.select("p", "event_id", "sec", rec.alias("rec"), "x", (F.col("_u") - 10.0).alias("u"), (F.col("_v") - 6.0).alias("v"), (F.col("_w") / 8.0 - 1.0).alias("w"))


#: The same signal as a common table expression.
SIG = """sig AS (SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) AS p, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec,
  row_number() OVER (PARTITION BY floor(epoch(ts) / 86400) ORDER BY ts) AS rec,
  CASE WHEN event_type <> 'error' THEN value END AS x,
  CAST(user_id % 21 AS DOUBLE) - 10.0::DOUBLE AS u, CAST(user_id % 13 AS DOUBLE) - 6.0::DOUBLE AS v,
  CAST(event_id % 17 AS DOUBLE) / 8.0::DOUBLE - 1.0::DOUBLE AS w FROM events)"""


def r(sql: str) -> str:
    """The same in SQL."""
    return f"round(CAST({sql} AS DOUBLE) + 3.1e-8::DOUBLE, 6) + 0.0::DOUBLE"
