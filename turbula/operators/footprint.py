"""Footprint distances: closed forms as Columns, and one integration in a vectorised function."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from turbula.functions import constants as C

# Dimensionless distances that hold 1, 10, 30, 50, 70, 80 and 90 % of the flux.
KLJUN_DISTANCE = {1: 0.302, 10: 0.601999, 30: 0.911995, 50: 1.183992, 70: 1.501988, 80: 1.693985, 90: 1.969982}
SHARES = {"offset": 0.01, "x10": 0.1, "x30": 0.3, "x50": 0.5, "x70": 0.7, "x80": 0.8, "x90": 0.9}


def kljun_04(sigma_w: Column, ustar: Column, z_over_l: Column, zm: float, z0: float, least_ustar: float = 0.2, span=(-200.0, 1.0)) -> dict[str, Column]:
    """Distances by the parameterisation of a backward Lagrangian model; null outside its range."""
    if zm < 1 or z0 <= 0:
        return {k: F.lit(None).cast("double") for k in ("peak", *SHARES)}
    c, d = 4.277 * (3.418 - math.log(z0)), 1.685 * (3.418 - math.log(z0))
    scale = zm * F.pow(sigma_w / ustar, F.lit(-0.8))
    ok = sigma_w.isNotNull() & (ustar >= least_ustar) & z_over_l.between(*span)
    at = {"peak": c - d} | {name: KLJUN_DISTANCE[round(share * 100)] * c - d for name, share in SHARES.items()}
    return {name: F.when(ok, scale * x) for name, x in at.items()}


def hsieh_00(z_over_l_scale: Column, length: Column, zu: float) -> dict[str, Column]:
    """Distances by an approximate analytical model, in closed form."""
    d = F.when(F.abs(z_over_l_scale) < 0.04, 0.97).when(z_over_l_scale < 0, 0.28).otherwise(2.44)
    p = F.when(F.abs(z_over_l_scale) < 0.04, 1.0).when(z_over_l_scale < 0, 0.59).otherwise(1.33)
    reach = d * F.pow(F.lit(zu), p) * F.pow(F.abs(length), 1 - p) / C.VON_KARMAN**2
    return {"peak": reach / 2} | {name: reach / -math.log(share) for name, share in SHARES.items()}


def hsieh_scale(zm: float, z0: float) -> float:
    return zm * (math.log(zm / z0) - 1 + z0 / zm)


def _kormann(zm: float, ustar: np.ndarray, zl: np.ndarray, wind: np.ndarray, steps: int = 10_000) -> dict[str, np.ndarray]:
    stable = zl > 0
    with np.errstate(all="ignore"):
        inner = np.where(stable, 1.0, 1 - 16 * zl)
        phi_m = np.where(stable, 1 + 5 * zl, inner**-0.25)
        phi_c = np.where(stable, phi_m, inner**-0.5)
        n = np.where(stable, 1 / phi_m, (1 - 24 * zl) / inner)
        key = C.VON_KARMAN * ustar * zm / (phi_c * zm**n)
        m = ustar * phi_m / (C.VON_KARMAN * wind)
        r = 2 + m - n
        mu = (1 + m) / r
        zeta = (wind / zm**m) * zm**r / (r * r * key)
        out = {"peak": zeta / (1 + mu)}
    rows = np.flatnonzero(np.isfinite(zeta) & np.isfinite(mu) & (mu > 0) & (zeta > 0))
    found = np.full((len(ustar), len(SHARES)), np.nan)
    found[rows] = _reached(mu[rows], zeta[rows], np.array(list(SHARES.values())), steps)
    return out | dict(zip(SHARES, found.T, strict=True))


def _reached(mu: np.ndarray, zeta: np.ndarray, shares: np.ndarray, steps: int, cells: int = 1 << 16) -> np.ndarray:
    """The first whole metre at which each running sum exceeds each of ``shares`` (ascending); nan beyond ``steps``.

    Summed in blocks of steps that double, each over the rows that have not yet
    reached the last share, ``cells`` values at a time; the sums are the same.
    """
    gamma = np.array([math.gamma(x) for x in mu])
    at, total, begin, width = np.zeros((len(mu), len(shares))), np.zeros(len(mu)), 0, 128
    active = np.arange(len(mu))
    while begin < steps and len(active):
        end = min(steps, begin + width)
        x = np.arange(begin + 1.0, end + 1)
        log_x = np.log(x)
        for part in np.array_split(active, -(-len(active) * (end - begin) // cells)):
            m, z = mu[part, None], zeta[part, None]
            sums = np.exp(m * np.log(z) - z / x - (1 + m) * log_x) / gamma[part, None]
            sums[:, 0] += total[part]
            np.cumsum(sums, axis=1, out=sums)
            for i, row in zip(part, sums, strict=True):
                at[i] += row.searchsorted(shares, "right")
            total[part] = sums[:, -1]
        active = active[total[active] <= shares[-1]]
        begin, width = end, width * 2
    return np.where(at < steps, at + 1, np.nan)


def kormann_meixner_01(ustar: Column, z_over_l: Column, wind: Column, zm: float) -> Column:
    """Struct of distances by the power-law model, integrated in steps of a metre."""

    @F.pandas_udf(", ".join(f"{k} double" for k in ("peak", *SHARES)))
    def run(us: pd.Series, zl: pd.Series, u: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(_kormann(zm, us.to_numpy(float), zl.to_numpy(float), u.to_numpy(float)))

    return run(ustar, z_over_l, wind)
