"""Time lags of gases by pre-whitened block bootstrap, and what is made of doubtful ones.

Wind, sonic temperature and gas of a period are whitened with the autoregressive
models of one another, blocks of them are drawn with replacement, and the lag of
the largest cross-correlation is noted for each draw. The lags' mode is the
estimate and their narrowest interval tells how far it can be trusted.

Detection is a numpy kernel over one period's records, so periods are spread over
the cluster; acceptance goes through a site's periods in order, one small row for
each gas and period.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from turbula.operators.transform import lagged_covariances

# The generator of block starts, and what each gas and pairing adds to the seed.
LCG_MULTIPLIER, LCG_INCREMENT, LCG_MODULUS = 1103515245, 12345, 2147483647
GAS_SEED, PAIR_SEED = 7919, 104729
GAS_NUMBER = {"co2": 5, "h2o": 6, "ch4": 7}
OTHER_GAS = 8
# Fixed value: 1 % critical value of the stationarity statistic.
STATIONARITY_LIMIT = 0.00537748023783321


@dataclass(frozen=True)
class Bootstrap:
    """Options of the method, with the published defaults."""

    min_lag: float = -10.0  # s
    max_lag: float = 10.0  # s
    draws: int = 99
    block: float = 20.0  # s; twice the longest lag if not positive
    min_valid: float = 0.3
    interval: float = 0.5  # s: a narrower interval is accepted by itself
    deviation: float = 0.5  # s: a lag as near to the last accepted one is accepted too
    smoothing: int = 5
    seed: int = 2024
    max_order: int = 0  # of the autoregressive models; 0: by length alone


def filled(x: np.ndarray) -> np.ndarray:
    """Gaps bridged by straight lines; ends continued."""
    known = np.flatnonzero(~np.isnan(x))
    return np.interp(np.arange(len(x)), known, x[known])


def is_stationary(x: np.ndarray) -> bool:
    d = x - x.mean()
    spread = d @ d
    return bool(spread <= 0 or (np.cumsum(d) ** 2).sum() / (len(x) ** 2 * spread) < STATIONARITY_LIMIT)


def _fast_length(n: int) -> int:
    return 1 << (n - 1).bit_length()


def autoregression(x: np.ndarray, max_order: int = 0) -> np.ndarray:
    """Coefficients of the autoregressive model with the least Akaike criterion, by Levinson's recursion."""
    n = len(x)
    top = min(int(100 * np.log10(max(n, 2))), n - 1)
    top = min(top, max_order) if max_order > 0 else top
    d = x - x.mean()
    spectrum = np.fft.rfft(d, _fast_length(2 * n))
    acov = np.fft.irfft(np.abs(spectrum) ** 2)[: top + 1] / n if top > 0 else np.zeros(1)
    best, phi = np.empty(0), np.empty(0)
    if top < 1 or acov[0] <= 0:
        return best
    variance, least = acov[0], n * np.log(acov[0])
    for order in range(1, top + 1):
        partial = (acov[order] - phi @ acov[order - 1 : 0 : -1]) / variance
        phi = np.append(phi - partial * phi[::-1], partial)
        variance *= 1 - partial * partial
        if variance <= 0:
            break
        score = n * np.log(variance) + 2 * order
        if score < least:
            best, least = phi, score
    return best


def whitened(x: np.ndarray, phi: np.ndarray) -> np.ndarray:
    """What the model leaves of ``x``; zero where the model lacks predecessors."""
    out = np.convolve(x - x.mean(), np.concatenate(([1.0], -phi)))[: len(x)]
    out[: len(phi)] = 0
    return out


def block_starts(state: int, count: int, most: int) -> tuple[np.ndarray, int]:
    """``count`` starts below ``most``, and the generator's next state."""
    out = np.empty(count, np.int64)
    for i in range(count):
        state = (LCG_MULTIPLIER * state + LCG_INCREMENT) % LCG_MODULUS
        out[i] = state % most
    return out, state


def correlations(x: np.ndarray, y: np.ndarray, reach: int) -> np.ndarray:
    """Cross-correlation of each row of ``x`` with that of ``y`` taken -reach to reach records later."""
    x, y = x - x.mean(1, keepdims=True), y - y.mean(1, keepdims=True)
    n = x.shape[1]
    size = _fast_length(n + reach)
    c = np.fft.irfft(np.conj(np.fft.rfft(x, size)) * np.fft.rfft(y, size), size)
    scale = np.sqrt((x * x).sum(1) * (y * y).sum(1))[:, None]
    lags = np.arange(-reach, reach + 1)
    c = np.divide(c[:, lags % size], scale, out=np.zeros((len(x), len(lags))), where=scale > 0)
    c[:, np.abs(lags) >= n - 1] = 0
    return c


def smoothed(c: np.ndarray, width: int) -> np.ndarray:
    """Running mean over lags (the last axis); ends take the nearest whole mean."""
    half, lags = width // 2, c.shape[-1]
    if 2 * half >= lags:
        return c
    means = np.lib.stride_tricks.sliding_window_view(c, 2 * half + 1, axis=-1).sum(-1) / width
    return np.concatenate([np.repeat(means[..., :1], half, -1), means, np.repeat(means[..., -1:], half, -1)], -1)


def mode(lags: np.ndarray) -> int:
    """The whole lag of the highest kernel density."""
    grid = np.arange(lags.min(), lags.max() + 1)
    if len(grid) == 1:
        return int(grid[0])
    width = max(1.0, 1.06 * lags.std(ddof=1) * len(lags) ** -0.2)
    return int(grid[np.exp(-0.5 * ((grid[:, None] - lags) / width) ** 2).sum(1).argmax()])


def narrowest_interval(values: np.ndarray) -> tuple[float, float]:
    """The shortest interval over 95 % of the values."""
    v = np.sort(values)
    m = max(1, int(0.95 * len(v)))
    if m >= len(v):
        return float(v[0]), float(v[-1])
    i = int((v[m:] - v[:-m]).argmin())
    return float(v[i]), float(v[i + m])


def _pairing(x: np.ndarray, y: np.ndarray, low: int, high: int, hertz: float, state: int, o: Bootstrap) -> tuple[int, np.ndarray, float]:
    """Estimate, lags of the draws, and the mean correlation at the estimate."""
    n, reach = len(x), max(abs(low), abs(high))
    wanted = round_half_up(o.block * hertz)
    block = min(max(1, wanted if wanted > 0 else 2 * reach), n)
    count = -(-n // block)
    inside = slice(low + reach, high + reach + 1)
    found, total = [], np.zeros(2 * reach + 1)
    at_once = max(1, (1 << 20) // n)  # bounds the memory of one batch of draws
    for done in range(0, max(1, o.draws), at_once):
        rows = []
        for _ in range(min(at_once, max(1, o.draws) - done)):
            starts, state = block_starts(state, count, n - block + 1)
            rows.append((starts[:, None] + np.arange(block)).ravel()[:n])
        at = np.stack(rows)
        c = correlations(x[at], y[at], reach)
        total += c.sum(0)
        found.append(np.abs(smoothed(c, max(1, o.smoothing))[:, inside]).argmax(1) + low)
    lags = np.concatenate(found)
    lag = mode(lags)
    return lag, lags, float(abs(smoothed(total / max(1, o.draws), max(1, o.smoothing))[lag + reach]))


def round_half_up(x: float) -> int:
    """The nearest whole number, halves away from zero."""
    return int(np.floor(abs(x) + 0.5)) * (1 if x >= 0 else -1)


def detect(w: np.ndarray, ts: np.ndarray, gas: np.ndarray, hertz: float, number: int, o: Bootstrap) -> dict:
    """Lag of ``gas`` behind ``w``: lag (records), low, high (s), pairing, edge, strength, covariance; empty if nothing can be told."""
    low, high = round_half_up(o.min_lag * hertz), round_half_up(o.max_lag * hertz)
    needed = max(0.0, min(1.0, o.min_valid)) * len(w)
    valid = [int((~np.isnan(x)).sum()) for x in (w, ts, gas)]
    if low >= high or min(valid) < max(1.0, needed):
        return {}
    w, ts, gas = filled(w), filled(ts), filled(gas)
    if not all(is_stationary(x) for x in (w, ts, gas)):
        w, ts, gas = (np.diff(x, prepend=x[:1]) for x in (w, ts, gas))
    models = {k: autoregression(x, o.max_order) for k, x in (("c", gas), ("w", w), ("t", ts))}
    series = {"w": w, "t": ts}
    best: tuple = ()
    for name in ("cw", "wc", "ct", "tc"):
        other = name.replace("c", "")
        phi = models[name[0]]
        state = max(1, o.seed + GAS_SEED * number + PAIR_SEED * (ord(name[0]) + 2 * ord(name[1])))
        lag, lags, strength = _pairing(whitened(series[other], phi), whitened(gas, phi), low, high, hertz, state, o)
        edge = lag in (low, high)
        rank = (not edge, strength)
        if not best or rank > best[0]:
            best = rank, name, lag, lags, edge, strength
    _, name, lag, lags, edge, strength = best
    a, b = narrowest_interval(lags / hertz)
    covariance = float(lagged_covariances(w, gas, range(lag, lag + 1))[0])
    return {"lag": lag, "low": a, "high": b, "pairing": name, "edge": edge, "strength": strength, "covariance": covariance}


def detect_lags(df: DataFrame, period: str, gases: list[str], hertz: float, options: Bootstrap = Bootstrap(), default: int = 0, rec: str = "rec", keys: tuple[str, ...] = ()) -> DataFrame:
    """One row for each period and gas: ``gas, lag, low, high, pairing, edge, strength, covariance, fallback``.

    ``df`` holds w, ts and the gases by period and record. What can't be told is
    null: a gas, wind or temperature with too few values. ``fallback`` is the lag
    of the largest covariance, or ``default`` where that lies at the range's end or is missing.
    """
    head = ", ".join(f"{c} {t}" for c, t in df.select(*keys, period).dtypes)
    schema = f"{head}, gas string, lag long, low double, high double, pairing string, edge boolean, strength double, covariance double, fallback long"
    low, high = round_half_up(options.min_lag * hertz), round_half_up(options.max_lag * hertz)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(rec)
        w, ts = f["w"].to_numpy(float), f["ts"].to_numpy(float)
        rows = []
        for g in gases:
            x = f[g].to_numpy(float)
            size = np.abs(lagged_covariances(w, x, range(low, high + 1)))
            known = np.flatnonzero(~np.isnan(size))
            best = int(np.nanargmax(size)) if len(known) else -1
            fallback = low + best if len(known) and best not in (known[0], known[-1]) else default
            rows.append({**{k: f[k].iloc[0] for k in (*keys, period)}, "gas": g, **detect(w, ts, x, hertz, GAS_NUMBER.get(g, OTHER_GAS), options), "fallback": fallback})
        out = pd.DataFrame(rows, columns=[*keys, period, "gas", "lag", "low", "high", "pairing", "edge", "strength", "covariance", "fallback"])
        return out.astype({"lag": "Int64", "edge": "boolean"})

    return df.groupBy(*keys, period).applyInPandas(run, schema)


def accept_lags(found: DataFrame, period: str, hertz: float, instruments: dict[str, str] | None = None, options: Bootstrap = Bootstrap(), keys: tuple[str, ...] = ()) -> DataFrame:
    """``found`` with ``applied`` (records) and ``reliability``, through a site's periods in order.

    ``S1_optimal``: narrow interval. ``S2_optimal``: near the last accepted lag.
    ``S4_instrument_shared``: the lag of another gas of the same instrument that
    was accepted in this period. ``S3_carryforward``: the last accepted lag.
    ``fallback``: none was accepted before. A site's rows (``keys``; one a period
    and gas) go through one task, as each depends on those before.
    """
    same, order = instruments or {}, list(GAS_NUMBER)
    schema = StructType([*found.schema.fields, StructField("applied", LongType()), StructField("reliability", StringType())])

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.assign(_n=f["gas"].map(lambda g: order.index(g) if g in order else len(order))).sort_values([period, "_n", "gas"]).reset_index(drop=True)
        last: dict[str, float] = {}
        applied, verdict = [0] * len(f), [""] * len(f)
        gas, lag, edge, fallback = f["gas"].tolist(), f["lag"].astype("Float64"), f["edge"], f["fallback"].tolist()
        seconds = (lag / hertz).to_numpy(float, na_value=np.nan)
        sound = ~np.isnan(seconds) & ~edge.astype("boolean").fillna(True).to_numpy(bool)
        width = (f["high"] - f["low"]).to_numpy(float)
        for _, rows in f.groupby(period, sort=False).indices.items():
            donors = []
            for i in rows:
                g = gas[i]
                if sound[i]:
                    near = g in last and abs(seconds[i] - last[g]) <= options.deviation
                    verdict[i] = "S1_optimal" if width[i] < options.interval else "S2_optimal" if near else ""
                if verdict[i]:
                    last[g] = seconds[i]
                    applied[i] = int(lag.iloc[i])
                    donors.append(i)
            for i in rows:
                g = gas[i]
                donor = next((k for k in donors if k != i and same.get(gas[k]) is not None and same.get(gas[k]) == same.get(g)), None)
                if verdict[i]:
                    continue
                if donor is not None:
                    verdict[i], applied[i], last[g] = "S4_instrument_shared", applied[donor], seconds[donor]
                elif g in last:
                    verdict[i], applied[i] = "S3_carryforward", round_half_up(last[g] * hertz)
                else:
                    verdict[i], applied[i] = "fallback", int(fallback[i])
        return f.drop(columns="_n").assign(applied=applied, reliability=verdict)

    return found.groupBy(*keys).applyInPandas(run, schema)


def reliability_counts(accepted: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Periods by gas and reliability: the method's summary of a run."""
    return accepted.groupBy(*keys, "gas", "reliability").count().withColumnRenamed("count", "n")
