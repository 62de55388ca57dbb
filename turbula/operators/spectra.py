"""Spectra and cospectra: transform of a period in a kernel, then long tables and ordinary aggregation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def taper(kind: str, n: int) -> np.ndarray:
    """Window of ``n`` weights: squared (none), bartlett, welch, hamming or hann."""
    i = np.arange(n)
    half = (n - 1) / 2
    return {
        "squared": lambda: np.ones(n),
        "bartlett": lambda: 1 - np.abs((i - half) / half) if n > 1 else np.ones(n),
        "welch": lambda: 1 - ((i - half) / half) ** 2 if n > 1 else np.ones(n),
        "hamming": lambda: 0.54 - 0.46 * np.cos(2 * np.pi * i / max(1, n - 1)),
        "hann": lambda: 0.5 - 0.5 * np.cos(2 * np.pi * i / max(1, n - 1)),
    }[kind]()


def power_of_two(n: int) -> int:
    """Largest power of two that is not above n."""
    return 1 << (n.bit_length() - 1) if n > 0 else 0


def one_sided_density(x: np.ndarray, y: np.ndarray, hertz: float, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Natural frequencies, without zero, and the one-sided (co)spectral density of two series."""
    n = len(x)
    a, b = np.fft.rfft((x - x.mean()) * window), np.fft.rfft((y - y.mean()) * window)
    density = 2 * (a.real * b.real + a.imag * b.imag) / (hertz * (window**2).sum())
    if n % 2 == 0:
        density[-1] /= 2
    return np.arange(1, n // 2 + 1) * hertz / n, density[1:]


def cospectra(df: DataFrame, period: str, rec: str, pairs: list[tuple[str, str]], hertz: float, window: str = "hamming", max_missing: float = 1 / 3, cut_to_power_of_two: bool = False) -> DataFrame:
    """Long table ``period, pair, freq, density`` of one-sided densities of column pairs (a pair of one column is its spectrum).

    Gaps are interpolated linearly; a variable with more than ``max_missing`` of
    its records missing has no spectrum. All records of a period are transformed;
    with ``cut_to_power_of_two`` only the first of them, as many as the largest
    power of two. One period at a time is in memory.
    """
    names = sorted({c for p in pairs for c in p})
    key = df.schema[period].dataType.simpleString()

    def run(k: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(rec)
        n = power_of_two(len(f)) if cut_to_power_of_two else len(f)
        series = {}
        for c in names:
            x = f[c].to_numpy(float)[:n]
            good = np.isfinite(x)
            if n > 3 and good.sum() >= 2 and n - good.sum() <= n * max_missing:
                series[c] = np.interp(np.arange(n), np.flatnonzero(good), x[good])
        w = taper(window, n)
        parts = []
        for a, b in pairs:
            if a in series and b in series:
                freq, density = one_sided_density(series[a], series[b], hertz, w)
                parts.append(pd.DataFrame({period: [k[0]] * len(freq), "pair": [f"{a}_{b}"] * len(freq), "freq": freq, "density": density}))
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({c: pd.Series([], dtype=t) for c, t in ((period, object), ("pair", object), ("freq", float), ("density", float))})

    return df.select(period, rec, *names).groupBy(period).applyInPandas(run, f"{period} {key}, pair string, freq double, density double")


def explicit_cospectrum(df: DataFrame, period: str, rec: str, a: str, b: str, harmonics: int) -> DataFrame:
    """The first ``harmonics`` terms of the co-spectrum by sums of cosines and sines, in Columns alone.

    For each period and harmonic k: 2 (Re Re + Im Im) / n^2, so that all terms up
    to n / 2 sum to the covariance. Suits few harmonics; use ``cospectra`` for all.
    """
    n = F.count("*").over(Window.partitionBy(period))
    over = Window.partitionBy(period)
    base = df.select(period, (F.col(rec) - 1).alias("_t"), n.alias("_n"), (F.col(a) - F.avg(a).over(over)).alias("_a"), (F.col(b) - F.avg(b).over(over)).alias("_b"))
    dealt = base.withColumn("harmonic", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(harmonics).cast("long"))))
    angle = 2 * math.pi * F.col("harmonic") * F.col("_t") / F.col("_n")
    sums = dealt.groupBy(period, "harmonic").agg(
        F.first("_n").alias("n"),
        F.sum(F.col("_a") * F.cos(angle)).alias("ar"), F.sum(F.col("_a") * F.sin(angle)).alias("ai"),
        F.sum(F.col("_b") * F.cos(angle)).alias("br"), F.sum(F.col("_b") * F.sin(angle)).alias("bi"),
    )
    return sums.select(period, "harmonic", (2 * (F.col("ar") * F.col("br") + F.col("ai") * F.col("bi")) / (F.col("n") * F.col("n"))).alias("density"))


def normalised(spectra: DataFrame, covariances: DataFrame, on: list[str]) -> DataFrame:
    """Densities divided by the (co)variance of their period and pair."""
    return spectra.join(covariances, on).withColumn("density", F.when(F.col("cov") != 0, F.col("density") / F.col("cov"))).drop("cov")


def ogive(spectra: DataFrame, keys: list[str], freq: str = "freq", density: str = "density") -> DataFrame:
    """Integral of the density from the highest frequency down."""
    w = Window.partitionBy(*keys).orderBy(F.desc(freq))
    step = F.abs(F.coalesce(F.lag(freq).over(w) - F.col(freq), F.lit(0.0)))
    return spectra.withColumn("_area", step * F.col(density)).withColumn("ogive", F.sum("_area").over(w)).drop("_area")


def frequency_bin(freq: Column, lowest: float, highest: float, bins: int, closed: str = "right") -> Column:
    """Number, from 1, of the exponential bin between two frequencies; spectra are (lo, hi], ogives [lo, hi)."""
    width = math.log(highest / lowest) / bins
    place = F.ln(freq / lowest) / width
    number = F.ceil(place) if closed == "right" else F.floor(place) + 1
    return F.when((freq >= lowest) & (freq <= highest), F.greatest(F.lit(1), F.least(number, F.lit(bins))).cast("long"))


def binned(spectra: DataFrame, keys: list[str], lowest: float, highest: float, bins: int, closed: str = "right") -> DataFrame:
    """Mean frequency and density of each exponential bin, and the count of its values."""
    b = frequency_bin(F.col("freq"), lowest, highest, bins, closed)
    return spectra.withColumn("bin", b).where("bin is not null").groupBy(*keys, "bin").agg(F.avg("freq").alias("freq"), F.avg("density").alias("density"), F.count("*").alias("n"))


def plausible_bins(spectra: DataFrame, keys: list[str], most: float = 1e4) -> DataFrame:
    """Drop a whole spectrum when any of its bins is implausible."""
    worst = F.max(F.abs("density")).over(Window.partitionBy(*keys))
    return spectra.withColumn("_worst", worst).where(F.col("_worst") <= most).drop("_worst")


# Cut-off frequencies, Hz, of the degraded covariances.
DEGRADED_CUTOFFS = (1.626, 0.614, 0.277, 0.133, 0.065, 0.032, 0.016, 0.008, 0.004)


def degraded_covariances(spectra: DataFrame, keys: list[str], cutoffs: tuple[float, ...] = DEGRADED_CUTOFFS, width: Column | None = None) -> DataFrame:
    """Covariance left after first-order low-pass filters with each cut-off."""
    f, s = F.col("freq"), F.col("density") * (width if width is not None else F.lit(1.0))
    return spectra.groupBy(*keys).agg(*[F.sum(s * F.sqrt(1 / (1 + (f / c) * (f / c)))).alias(f"cov_{i}") for i, c in enumerate(cutoffs, 1)])
