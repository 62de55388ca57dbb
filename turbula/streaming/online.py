"""Online mode: periods as they close on a stream of records."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turbula.functions import stats


def period_statistics(records: DataFrame, ts: str = "ts", minutes: int = 30, lateness: str = "30 minutes", keys: tuple[str, ...] = (), pairs: tuple[tuple[str, str], ...] = (("w", "u"), ("w", "x"))) -> DataFrame:
    """Counts, means and covariances of each averaging period, emitted when the watermark passes its end.

    Works on streams and on tables alike. Records that are later than
    ``lateness`` are left out by a stream, and only by a stream.
    """
    names = sorted({c for p in pairs for c in p})
    agg = [F.count("*").alias("n_records"), *[F.avg(c).alias(f"mean_{c}") for c in names]]
    agg += [stats.covariance(a, b).alias(f"cov_{a}{b}") for a, b in pairs]
    window = F.window(F.col(ts), f"{minutes} minutes")
    out = records.withWatermark(ts, lateness).groupBy(window, *keys).agg(*agg)
    return out.select(*keys, F.col("window.start").alias("period_start"), F.col("window.end").alias("period_end"), *[c for c in out.columns if c not in ("window", *keys)])


def storage_stream(periods: DataFrame, key: str, start: str, value: str, step_seconds: int, height: float) -> DataFrame:
    """Storage of each period against the one before it, with the last period of each key as state.

    Null unless the previous period ended where this one begins.
    """
    schema = f"{key} string, {start} long, {value} double, storage double"

    def run(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = pd.concat(list(frames)).sort_values(start)
        out = []
        for at, x in zip(rows[start], rows[value], strict=True):
            known = last is not None and last[0] + step_seconds == at and not pd.isna(x) and not pd.isna(last[1])
            out.append((k[0], int(at), x, (x - last[1]) * height / step_seconds if known else None))
            last = (int(at), float(x))
        if last is not None:
            state.update(last)
        yield pd.DataFrame(out, columns=[key, start, value, "storage"])

    return periods.select(F.col(key).cast("string").alias(key), start, value).groupBy(key).applyInPandasWithState(run, schema, "at long, x double", "append", "NoTimeout")
