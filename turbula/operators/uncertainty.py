"""Random uncertainty of covariances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _lagged(df: DataFrame, period: str, rec: str, pairs: dict[str, tuple[str, str]], lags: int, backward: tuple[str, ...] = ()) -> DataFrame:
    """One row per period: for each named pair an array of covariances at lags 0 to ``lags``, of the second with the later first for ``backward``."""
    w = Window.partitionBy(period).orderBy(rec)
    moved, out = {}, []
    for name, (a, b) in pairs.items():
        for k in range(lags + 1):
            column = f"_{b}_{'b' if name in backward else 'f'}{k}"
            moved[column] = F.col(b) if k == 0 else F.lag(b, k).over(w) if name in backward else F.lead(b, k).over(w)
        out.append(F.array(*[F.covar_pop(a, f"_{b}_{'b' if name in backward else 'f'}{k}") for k in range(lags + 1)]).alias(name))
    firsts = sorted({a for a, _ in pairs.values()})
    return df.select(period, *firsts, *[c.alias(n) for n, c in moved.items()]).groupBy(period).agg(F.count("*").alias("n"), *out)


def integral_scale(df: DataFrame, period: str, a: str, b: str, rec: str, lags: int, hertz: float, stop: float | None = None) -> DataFrame:
    """Integral time scale of the normalised covariance of ``a`` with later ``b``.

    Summed up to the first lag at or below ``stop`` (0, 1/e, or None for all lags).
    """
    found = _lagged(df, period, rec, {"c": (a, b)}, lags).where(F.get("c", F.lit(0)) != 0)
    ratio = F.transform("c", lambda x: x / F.get("c", F.lit(0)))
    found = found.select(period, F.filter(ratio, lambda r: r.isNotNull()).alias("r"))
    used = F.col("r")
    if stop is not None:
        cut = F.array_position(F.transform("r", lambda r: r <= stop), F.lit(True))
        used = F.when(cut > 0, F.slice("r", F.lit(1), (cut - 1).cast("int"))).otherwise(F.col("r"))
    return found.select(period, F.when(F.size(used) > 0, F.aggregate(used, F.lit(0.0), lambda s, r: s + r) / hertz).alias("its"))


def mann_lenschow(cov: Column, corr: Column, its: Column, seconds: Column | float) -> Column:
    return F.when(corr != 0, F.abs(cov) * F.sqrt((1 + corr * corr) / (corr * corr)) * F.sqrt(2 * F.abs(its) / seconds))


def finkelstein_sims(df: DataFrame, period: str, w: str, x: str, rec: str, lags: int) -> DataFrame:
    """Square root of the variance of the covariance, from lagged auto- and cross-covariances up to ``lags``."""
    found = _lagged(df, period, rec, {"ww": (w, w), "xx": (x, x), "wx": (w, x), "xw": (w, x)}, lags, backward=("xw",))
    at = lambda c, k: F.get(c, F.lit(k))
    term = lambda k: at("ww", k) * at("xx", k) + at("wx", k) * at("xw", k)
    total = term(0)
    for k in range(1, lags + 1):
        total = total + F.coalesce(2 * term(k), F.lit(0.0))
    return found.select(period, F.when(total != 0, F.sqrt(F.abs(total / F.col("n")))).alias("uncertainty"))


def billesbach(df: DataFrame, period: str, w: str, x: str, rec: str, times: int = 20, seed: int = 1) -> DataFrame:
    """Instrument noise: the mean absolute covariance with the vertical wind in random order.

    Each of the ``times`` orders comes from a hash of the record number and
    ``seed``, so a period's result doesn't depend on where it is computed.
    """
    ordered = Window.partitionBy(period).orderBy(rec)
    rows = df.select(period, rec, w, x)
    # The i-th record meets the wind of the i-th record by hash.
    mixed = rows.select(period, w, F.explode(F.sequence(F.lit(1), F.lit(times))).alias("_k"), F.col(rec).alias("_r"))
    mixed = mixed.withColumn("_i", F.row_number().over(Window.partitionBy(period, "_k").orderBy(F.xxhash64("_r", "_k", F.lit(seed)))))
    plain = rows.select(period, x, F.row_number().over(ordered).alias("_i"))
    cov = plain.join(mixed, [period, "_i"]).groupBy(period, "_k").agg(F.covar_pop(w, x).alias("c"))
    return cov.groupBy(period).agg(F.avg(F.abs("c")).alias("uncertainty"))


def mahrt(df: DataFrame, period: str, w: str, x: str, rec: str, parts: int = 6) -> DataFrame:
    """Random error and non-stationarity ratio from covariances of ``parts`` times ``parts`` nested chunks."""
    n = F.count("*").over(Window.partitionBy(period))
    outer = F.floor(n / parts)
    inner = F.floor(outer / parts)
    at = F.col(rec) - 1
    i = F.when(outer > 0, F.floor(at / F.nullif(outer, F.lit(0))))
    j = F.when(inner > 0, F.floor((at - i * outer) / F.nullif(inner, F.lit(0))))
    cells = df.select(period, w, x, i.alias("_i"), j.alias("_j")).where(F.col("_i").between(0, parts - 1) & F.col("_j").between(0, parts - 1))
    cov = cells.groupBy(period, "_i", "_j").agg(F.covar_pop(w, x).alias("_c"))
    rows = cov.groupBy(period, "_i").agg(F.avg("_c").alias("_m"), F.coalesce(F.stddev_samp("_c"), F.lit(0.0)).alias("_s"), F.sum("_c").alias("_t"), F.count("_c").alias("_k"))
    error = F.sum("_s") / parts / F.sqrt(F.lit(float(parts)))
    return rows.groupBy(period).agg(error.alias("uncertainty"), F.when(error > 0, F.stddev_samp("_m") / error).alias("ratio"))
