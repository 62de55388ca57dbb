"""Small helpers that every text operator of this subpackage shares."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b"")).alias("text")


def map_rows(
    df: DataFrame,
    columns: Sequence[Column],
    fn: Callable[[Iterator[list[list]]], Iterator[list[list]]],
    schema: str,
    rows: int = 500,
) -> DataFrame:
    """Run ``fn`` over each partition's rows as plain Python columns, ``rows`` at a time.

    Only ``columns`` leave the JVM, so other columns of ``df``, whatever their
    names, play no part. ``fn`` gets an iterator of column lists and yields
    lists of output columns in the order of ``schema``.
    """
    names = [f.split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks():
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    part = batch.slice(at, rows)
                    yield [c.to_pylist() for c in part.columns]

        target = None
        for out in fn(blocks()):
            if target is None:
                target = _arrow_schema(schema)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=target.field(n).type) for c, n in zip(out, names, strict=True)], schema=target
            )

    return df.select(*columns).mapInArrow(run, schema)


def keep_rows(df: DataFrame, text_column: str, keep: Callable[[list[bytes]], list[bool]], rows: int = 500) -> DataFrame:
    """The rows of ``df`` whose text ``keep`` accepts, all columns as they are; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                texts = part.column(part.schema.get_field_index(text_column)).to_pylist()
                yield part.filter(pa.array(keep([(t or "").encode() for t in texts]), pa.bool_()))

    return df.mapInArrow(run, df.schema)


_ARROW = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "string": pa.string(),
    "boolean": pa.bool_(),
    "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()),
    "array<double>": pa.list_(pa.float64()),
    "array<string>": pa.list_(pa.string()),
}


def _arrow_schema(schema: str) -> pa.Schema:
    return pa.schema([(n, _ARROW[t]) for n, t in (f.split() for f in schema.split(","))])
