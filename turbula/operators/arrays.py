"""Kernels that need a period's records together and in order, over numpy arrays.

A period can be long, so it never becomes a pandas frame: it comes as Arrow
batches, a column that the kernel asks for becomes one array, the others wait as
they came, and the result leaves in batches again.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

KINDS = {"double": (DoubleType(), pa.float64()), "long": (LongType(), pa.int64()), "boolean": (BooleanType(), pa.bool_())}


def _cells(values, begin: int, end: int, kind: pa.DataType) -> pa.Array:
    part = values[begin:end] if np.ndim(values) else np.full(end - begin, values)
    return pa.array(part, from_pandas=True).cast(kind)


def over_periods(df: DataFrame, period: str, rec: str, reads: list[str], changes: list[str], adds: dict[str, str], kernel: Callable[[dict], None]) -> DataFrame:
    """``kernel`` over each period's records in the order of ``rec``.

    It gets a dict of the ``reads`` as arrays of floats, nan for null, and puts into
    it the new values of ``changes`` and of ``adds`` (name and "double", "long" or
    "boolean"), as arrays or as one value for all records. There, nan becomes null.
    Spark sorts the records; where they are dealt out by period already, they aren't dealt again.
    """
    schema = StructType([StructField(f.name, f.dataType, f.nullable or f.name in changes) for f in df.schema] + [StructField(n, KINDS[k][0]) for n, k in adds.items()])
    stay, names = [c for c in df.columns if c not in changes], [*df.columns, *adds]
    reads = list(dict.fromkeys(reads))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rest, kinds = {c: [] for c in reads}, [], {n: KINDS[k][1] for n, k in adds.items()}
        for b in batches:  # copied: a column's view would keep its whole batch
            kinds |= {c: b.schema.field(c).type for c in changes}
            for c in reads:
                parts[c].append(np.array(b.column(c).to_numpy(zero_copy_only=False), float))
            rest.append(b.select(stay).take(pa.array(np.arange(b.num_rows))))
        x = {c: np.concatenate(parts.pop(c)) for c in reads}
        at = np.concatenate([b.column(rec).to_numpy(zero_copy_only=False) for b in rest])
        if (at[1:] < at[:-1]).any():  # not if the sort below was kept
            order = np.argsort(at, kind="stable")
            x, rest = {c: v[order] for c, v in x.items()}, pa.Table.from_batches(rest).take(pa.array(order)).to_batches(10_000)
        kernel(x)
        begin = 0
        for b in rest:
            end = begin + b.num_rows
            yield pa.RecordBatch.from_arrays([_cells(x[n], begin, end, kinds[n]) if n in kinds else b.column(n) for n in names], names=names)
            begin = end

    return df.repartition(period).sortWithinPartitions(period, rec).groupBy(period).applyInArrow(run, schema)
