"""Ensembles over periods: class averages of spectra and fits of models to them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def humidity_class(rh: Column, width: float = 10.0) -> Column:
    """Number of the open interval that holds a relative humidity; a boundary is in none."""
    place = rh / width
    return F.when((rh > 0) & (rh < 100) & (place != F.floor(place)), F.floor(place).cast("long") + 1)


def stability_class(length: Column) -> Column:
    """unstable for -650 < L < 0, stable for 0 <= L < 1000."""
    return F.when((length > -650) & (length < 0), "unstable").when((length >= 0) & (length < 1000), "stable")


def class_average(spectra: DataFrame, keys: list[str], bin_column: str = "bin", least: int = 1) -> DataFrame:
    """Mean density of each class and bin with at least ``least`` spectra."""
    return spectra.groupBy(*keys, bin_column).agg(F.avg("freq").alias("freq"), F.avg("density").alias("density"), F.count("*").alias("n")).where(F.col("n") >= least)


def stability_average(cospectra: DataFrame, keys: list[str], stability: str = "stability") -> DataFrame:
    """Arithmetic mean of stable cospectra, geometric mean of unstable ones."""
    geometric = F.exp(F.avg(F.when(F.col("density") > 0, F.ln("density"))))
    return cospectra.groupBy(*keys, stability).agg(F.when(F.col(stability) == "stable", F.avg("density")).otherwise(geometric).alias("density"), F.count("*").alias("n"))


def remove_noise(spectra: DataFrame, keys: list[str], above: float) -> DataFrame:
    """Subtract the straight line through the spectrum above a frequency."""
    line = spectra.where(F.col("freq") > above).groupBy(*keys).agg(F.regr_slope("density", "freq").alias("_s"), F.regr_intercept("density", "freq").alias("_i"))
    out = spectra.join(line, keys, "left")
    return out.withColumn("density", F.col("density") - F.coalesce(F.col("_i") + F.col("_s") * F.col("freq"), F.lit(0.0))).drop("_s", "_i")


def levenberg_marquardt(model: Callable, x: np.ndarray, y: np.ndarray, start, rounds: int = 200, tolerance: float = 1e-10) -> np.ndarray:
    """Least squares of ``model(parameters, x)`` to y, with differences for derivatives."""
    p, damp = np.array(start, float), 1e-3
    residual = y - model(p, x)
    best = float(residual @ residual)
    for _ in range(rounds):
        step = 1e-6 * np.maximum(np.abs(p), 1e-6)
        jacobian = np.stack([(model(p + np.eye(len(p))[i] * s, x) - model(p, x)) / s for i, s in enumerate(step)], 1)
        a, g = jacobian.T @ jacobian, jacobian.T @ residual
        try:
            move = np.linalg.solve(a + damp * np.diag(np.maximum(np.diag(a), 1e-12)), g)
        except np.linalg.LinAlgError:
            damp *= 10
            continue
        with np.errstate(all="ignore"):
            fresh = y - model(p + move, x)
        total = float(fresh @ fresh)
        if np.isfinite(total) and total <= best:
            done = best - total <= tolerance * max(best, 1e-30)
            p, residual, best, damp = p + move, fresh, total, max(damp / 10, 1e-12)
            if done:
                break
        else:
            damp *= 10
            if damp > 1e12:
                break
    return p


#: Models by name: function of (parameters, x) and starting values.
MODELS: dict[str, tuple[Callable, tuple[float, ...]]] = {
    "first_order": (lambda p, x: p[0] / (1 + (x / p[1]) ** 2), (1.0, 0.1)),
    "gaussian": (lambda p, x: np.exp(-0.346574 * (x / p[0]) ** 2), (0.1,)),
    "exponential": (lambda p, x: np.exp(p[0] * x**2 + p[1] * x + p[2]), (0.0, 0.0, 0.0)),
    "hyperbola": (lambda p, x: p[0] / (p[1] + x) + 1, (0.1, 0.1)),
    "power": (lambda p, x: p[0] * x ** p[1], (1.0, -1.0)),
    "offset_power": (lambda p, x: p[0] + p[1] * x ** p[2], (0.0, 1.0, -1.0)),
    "cospectrum": (lambda p, x: np.log(p[0] * (x / p[1]) / (1 + (x / p[1]) ** (2 * p[2])) ** (1.1666667 / p[2])), (1.0, 0.09, 0.2)),
}


def fit_models(df: DataFrame, keys: list[str], x: str, y: str, model: str, least: int = 4) -> DataFrame:
    """Fit a model to the points of each class; ``parameters`` is null with fewer than ``least`` of them.

    A class has one point per bin and spectrum average, so a group is small.
    """
    function, start = MODELS[model]
    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + ", n long, parameters array<double>"

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f[np.isfinite(f[x].astype(float)) & np.isfinite(f[y].astype(float))].sort_values([x, y])
        found = levenberg_marquardt(function, f[x].to_numpy(float), f[y].to_numpy(float), start).tolist() if len(f) >= least else None
        return pd.DataFrame({**{k: [v] for k, v in zip(keys, key, strict=True)}, "n": [len(f)], "parameters": [found]})

    return df.select(*keys, x, y).groupBy(*keys).applyInPandas(run, schema)


def optimise_lags(lags: DataFrame, keys: list[str], lag: str, spread: float = 1.5) -> DataFrame:
    """Median lag of each class, and the range of ``spread`` scaled median deviations about it.

    A class's lags, one per period, are sorted twice by exact percentiles.
    """
    centre = lags.groupBy(*keys).agg(F.median(lag).alias("lag"), F.count(lag).alias("n"))
    away = lags.withColumnRenamed(lag, "_l").join(centre, keys).groupBy(*keys).agg(F.median(F.abs(F.col("_l") - F.col("lag"))).alias("_mad"))
    width = spread * F.col("_mad") / 0.6745
    return centre.join(away, keys).select(*keys, "n", "lag", (F.col("lag") - width).alias("low"), (F.col("lag") + width).alias("high"))
