"""Frequency-response corrections: transfer functions on a frequency grid, and closed forms."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Arrays:
    """What the functions of this module take from Spark's, for arrays: give it as ``xp``."""

    sqrt, exp, sin, cos, pow, greatest = np.sqrt, np.exp, np.sin, np.cos, np.power, np.maximum

    @staticmethod
    def lit(x):
        return x

    class when:
        def __init__(self, condition, value):
            self.condition, self.value = condition, value

        def otherwise(self, other):
            return np.where(self.condition, self.value, other)


def frequency_grid(spark: SparkSession, points: int = 500, lowest: float = 1 / 7200, highest: float = 10.0) -> DataFrame:
    """Logarithmically spaced frequencies, at most some hundreds: a side that is small whatever the input."""
    step = math.log(highest / lowest) / (points - 1)
    return spark.range(points).select(F.col("id").alias("k"), (F.lit(lowest) * F.exp(F.col("id") * F.lit(step))).alias("f"))


def model_cospectrum(kf: Column, f: Column, z_over_l: Column, momentum: bool = False, xp=F) -> Column:
    """Model cospectral density at natural frequency ``f`` and normalised frequency ``kf``."""
    # Coefficients of the stable and unstable models for scalars and momentum.
    if momentum:
        a0, a1, split = 0.124, 7.9, 0.24
        low, high = (20.78, 31.0, 1.575), (12.66, 9.6, 2.4)
    else:
        a0, a1, split = 0.284, 6.4, 0.54
        low, high = (12.92, 26.7, 1.375), (4.378, 3.8, 2.4)
    a = a0 * xp.pow(1 + a1 * xp.greatest(z_over_l, xp.lit(0.0)), xp.lit(0.75))
    stable = kf / (f * (a + 2.34 * xp.pow(a, xp.lit(-1.1)) * xp.pow(kf, xp.lit(2.1))))
    unstable = xp.when(kf < split, low[0] * kf / (f * xp.pow(1 + low[1] * kf, xp.lit(low[2])))).otherwise(
        high[0] * kf / (f * xp.pow(1 + high[1] * kf, xp.lit(high[2])))
    )
    return xp.when(z_over_l > 0, stable).otherwise(unstable)


def first_order(f: Column, tau: Column | float, xp=F) -> Column:
    """Response of a sensor with time constant ``tau``."""
    x = 2 * math.pi * f * tau
    return 1 / xp.sqrt(1 + x * x)


def path_average_vector(f: Column, path: float, wind: Column) -> Column:
    """Averaging along a sonic path."""
    x = 2 * math.pi * f * path / wind
    return 4 / x * (1 + F.exp(-x) / 2 - 3 * (1 - F.exp(-x)) / (2 * x))


def path_average_scalar(f: Column, path: float, wind: Column) -> Column:
    """Averaging along an analyser's optical path."""
    x = 2 * math.pi * f * path / wind
    return F.sqrt(F.greatest(F.lit(0.0), (3 + F.exp(-x) - 4 * (1 - F.exp(-x)) / x) / x))


def separation(f: Column, distance: float, wind: Column, xp=F) -> Column:
    return xp.exp(-9.9 * xp.pow(f * distance / wind, xp.lit(1.5)))


def air_viscosity(t: Column) -> Column:
    """Kinematic viscosity at a temperature in K."""
    return -1.1555e-14 * t * t * t + 9.5728e-11 * t * t + 3.7604e-8 * t - 3.4484e-6


def tube(f: Column, diameter: float, length: float, flow: float, diffusivity: float, t: Column) -> Column:
    """Attenuation in an intake tube, laminar below a Reynolds number of 2300."""
    speed = flow / (math.pi * (diameter / 2) ** 2)
    reynolds = speed * diameter / air_viscosity(t)
    x = math.pi * diameter / 2 * f
    laminar = F.exp(-(length / speed) * x * x / (6 * diffusivity))
    turbulent = F.exp(-80 * diameter / 2 * f * f * F.pow(reynolds, F.lit(-0.125)) * length / speed**2)
    return F.when(reynolds < 2300, laminar).otherwise(turbulent)


def high_pass(f: Column, method: str, minutes: float, hertz: float, seconds: float = 0.0, xp=F) -> Column:
    """What averaging over a period and detrending leave of low frequencies; methods ba, ld, rm and ew."""
    if method in ("rm", "ew"):
        if not seconds:
            return xp.lit(1.0)
        eta = math.exp(-1 / (hertz * seconds))
        x = 2 * math.pi * f * (eta / (hertz * (1 - eta)))
        return x * x / (1 + x * x / eta)
    x = math.pi * f * minutes * 60
    block = xp.sin(x) * xp.sin(x) / (x * x)
    if method == "ba":
        return 1 - block
    y = math.pi * f * seconds
    line = xp.sin(y) / y - xp.cos(y)
    return 1 - block - 3 * line * line / (y * y) if seconds else xp.lit(1.0)


def correction_factors(periods: DataFrame, grid: DataFrame, key: str, cospectrum: Column, transfer: Column) -> DataFrame:
    """Model covariance over its filtered part, by left Riemann sums over the grid, for each period.

    The grid has a fixed, small number of rows, so each period is repeated that
    often within its own task and summed there: no row leaves its partition
    before the partial sums.
    """
    w = Window.orderBy("k")
    wide = F.broadcast(grid.withColumn("df", F.lead("f").over(w) - F.col("f")).where("df is not null"))
    each = periods.join(wide, F.lit(True))
    area = F.when((F.col("f") > 1 / 5000) & (F.col("f") < 100), cospectrum * F.col("df"))
    return each.groupBy(key).agg((F.sum(area) / F.sum(area * transfer)).alias("factor"))


def analytic_factor(wind: Column, z_over_l: Column, cospectrum: Callable, transfer: Callable, points: int = 500, lowest: float = 1 / 7200, highest: float = 10.0) -> Column:
    """The factor of :func:`correction_factors` for one model, without a row for each period and frequency.

    ``cospectrum`` and ``transfer`` are functions of frequency, wind and stability
    as arrays (see :class:`Arrays`); each block of periods meets the whole grid of
    :func:`frequency_grid` in its task. Null without wind or stability.
    """

    @F.pandas_udf("double")
    def run(wind: pd.Series, z_over_l: pd.Series) -> pd.Series:
        grid = lowest * np.exp(np.arange(points) * (math.log(highest / lowest) / (points - 1)))
        f, width = grid[:-1], np.diff(grid)
        inside = (f > 1 / 5000) & (f < 100)
        f, width = f[inside], width[inside]
        u, zl = wind.to_numpy(float), z_over_l.to_numpy(float)
        out = np.full(len(u), np.nan)
        rows = np.flatnonzero((u != 0) & ~np.isnan(u) & ~np.isnan(zl))
        with np.errstate(all="ignore"):
            for at in range(0, len(rows), 32):
                i = rows[at : at + 32]
                area = cospectrum(f, u[i, None], zl[i, None]) * width
                out[i] = area.sum(1) / (area * transfer(f, u[i, None], zl[i, None])).sum(1)
        return pd.Series(out).astype("Float64").mask(np.isnan(out))

    return run(wind, z_over_l)


def horst_97(wind: Column, tau: float, height: Column | float, z_over_l: Column) -> Column:
    """Closed form for a first-order sensor."""
    nm = F.when(z_over_l <= 0, 0.085).otherwise(2 - 1.915 / (1 + 0.5 * z_over_l))
    alpha = F.when(z_over_l <= 0, 7 / 8).otherwise(1.0)
    return 1 + F.pow(2 * math.pi * wind * tau * nm / height, alpha)


def ibrom_07(a: float, b: float, wind: Column, cutoff: Column) -> Column:
    return a * wind / (b + cutoff) + 1


def massman_00(wind: Column, height: float, z_over_l: Column, tau: Column | float, minutes: float, method: str = "ba", seconds: float = 0.0) -> Column:
    """Closed form from equivalent time constants; null without wind."""
    wind = F.nullif(wind, F.lit(0.0))
    peak = F.when(z_over_l < 0, 0.085).otherwise(2 - 1.915 / (1 + 0.5 * z_over_l)) * wind / height
    alpha = F.when(z_over_l < 0, 0.925).otherwise(1.0)
    detrend = {"ld": minutes * 60 / 5.3, "ba": 1e10}.get(method, seconds)
    a = F.pow(2 * math.pi * peak * detrend, alpha)
    b = F.pow(2 * math.pi * peak * (minutes * 60 / 2.8), alpha)
    p = F.pow(2 * math.pi * peak * tau, alpha)
    kept = (a * b / ((a + 1) * (b + 1))) * (a * b / ((a + p) * (b + p))) * (1 / (p + 1)) * (1 + (p + 1) / (a + b))
    return 1 / kept


def humidity_cutoff(rh: Column, a: float, b: float, c: float) -> Column:
    """Cut-off frequency of water vapour at a relative humidity in percent."""
    x = rh / 100
    return F.exp(a * x * x + b * x + c)
