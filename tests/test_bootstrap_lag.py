"""The bootstrap lag: its parts against plain loops, its estimate on planted lags, its acceptance case by case."""

import numpy as np
import pandas as pd
import pytest

from turbula.operators import bootstrap_lag as b
from turbula.plans import raw
from turbula.plans.config import Run


def red(rng, n, phi=0.7):
    out = np.zeros(n)
    for i in range(1, n):
        out[i] = phi * out[i - 1] + rng.normal()
    return out


def planted(seed=1, n=2000, lag=7):
    rng = np.random.default_rng(seed)
    w = red(rng, n + 50)
    gas = np.concatenate([np.zeros(lag), w])[: n + 50] + 0.5 * red(rng, n + 50)
    ts = w + red(rng, n + 50)
    return w[50:], ts[50:], gas[50:]


def test_autoregression_solves_the_yule_walker_equations():
    x = red(np.random.default_rng(0), 3000)
    phi = b.autoregression(x, 6)
    d = x - x.mean()
    acov = np.array([d[: len(d) - k] @ d[k:] for k in range(len(phi) + 1)]) / len(d)
    k = np.abs(np.subtract.outer(np.arange(len(phi)), np.arange(len(phi))))
    assert phi == pytest.approx(np.linalg.solve(acov[k], acov[1:]), abs=1e-9) and phi[0] == pytest.approx(0.7, abs=0.05)
    assert len(b.autoregression(np.ones(50))) == 0 and len(b.autoregression(np.ones(1))) == 0


def test_whitened_correlations_and_smoothing_against_loops():
    rng = np.random.default_rng(2)
    x, y, phi = rng.normal(size=60), rng.normal(size=60), np.array([0.5, -0.2])
    d = x - x.mean()
    want = [0.0 if i < 2 else d[i] - 0.5 * d[i - 1] + 0.2 * d[i - 2] for i in range(60)]
    assert b.whitened(x, phi) == pytest.approx(want)
    e, scale = y - y.mean(), np.sqrt((d @ d) * ((y - y.mean()) @ (y - y.mean())))
    want = [sum(d[i] * e[i + k] for i in range(60) if 0 <= i + k < 60) / scale for k in range(-5, 6)]
    c = b.correlations(x[None], y[None], 5)
    assert c[0] == pytest.approx(want)
    s = b.smoothed(c, 3)[0]
    assert s[1:-1] == pytest.approx([np.mean(c[0][i - 1 : i + 2]) for i in range(1, 10)]) and s[0] == s[1] and s[-1] == s[-2]
    assert b.smoothed(c, 99).tolist() == c.tolist()


def test_block_starts_mode_and_interval():
    assert b.block_starts(1, 2, 1000)[0].tolist() == [(1103515245 + 12345) % 2147483647 % 1000, (1103515245 * 1103527590 + 12345) % 2147483647 % 1000]
    assert b.mode(np.array([3, 3, 4, 9])) == 3 and b.mode(np.array([5])) == 5
    assert b.narrowest_interval(np.array([0.0] * 96 + [5.0] * 4)) == (0.0, 0.0)
    assert b.round_half_up(2.5) == 3 and b.round_half_up(-2.5) == -3


def test_planted_lag_is_found_and_gaps_do_not_hide_it():
    w, ts, gas = planted()
    gas[100:160] = np.nan
    got = b.detect(w, ts, gas, 10.0, 5, b.Bootstrap(-2.0, 2.0))
    assert got["lag"] == 7 and not got["edge"] and got["low"] <= 0.7 <= got["high"]
    assert got == b.detect(w, ts, gas, 10.0, 5, b.Bootstrap(-2.0, 2.0))
    nothing = np.full(len(w), np.nan)
    assert b.detect(w, ts, nothing, 10.0, 5, b.Bootstrap()) == {} and b.detect(w, nothing, gas, 10.0, 5, b.Bootstrap()) == {}


def test_acceptance_in_order(spark):
    rows = [
        (1, "co2", 30, 0.0, 3.0, False, 4), (1, "h2o", None, None, None, None, 6),  # nothing accepted yet
        (2, "co2", 20, 1.9, 2.1, False, 4), (2, "h2o", None, None, None, None, 6),  # narrow; shared
        (3, "co2", 23, 1.0, 3.0, False, 4), (3, "h2o", 90, 0.0, 9.0, False, 6),  # near the last; shared
        (4, "co2", 50, 0.0, 9.0, False, 4), (4, "h2o", 100, 9.9, 10.0, True, 6),  # neither; at the edge
    ]
    found = spark.createDataFrame(rows, "period long, gas string, lag long, low double, high double, edge boolean, fallback long")
    got = {(r["period"], r["gas"]): (r["reliability"], r["applied"]) for r in b.accept_lags(found, "period", 10.0, {"co2": "m", "h2o": "m"}).collect()}
    assert got == {
        (1, "co2"): ("fallback", 4), (1, "h2o"): ("fallback", 6), (2, "co2"): ("S1_optimal", 20), (2, "h2o"): ("S4_instrument_shared", 20),
        (3, "co2"): ("S2_optimal", 23), (3, "h2o"): ("S4_instrument_shared", 23), (4, "co2"): ("S3_carryforward", 23), (4, "h2o"): ("S3_carryforward", 23),
    }
    alone = {(r["period"], r["gas"]): r["reliability"] for r in b.accept_lags(found, "period", 10.0).collect()}
    assert alone[3, "h2o"] == "fallback"
    assert b.accept_lags(found.limit(0), "period", 10.0).count() == 0
    assert {(r["gas"], r["reliability"]): r["n"] for r in b.reliability_counts(b.accept_lags(found, "period", 10.0)).collect()}[("h2o", "fallback")] == 4


def test_the_plan_applies_bootstrap_lags(spark):
    frames = []
    for p in (1, 2):
        w, ts, gas = planted(p, 600)
        frames.append(pd.DataFrame({"period": p, "rec": range(1, 601), "u": 3.0, "v": 0.1, "w": w, "ts": 290 + ts, "co2": 16 + gas}))
    records = spark.createDataFrame(pd.concat(frames))
    run = Run(rotation="none", lag="pwb", bootstrap=b.Bootstrap(-2.0, 2.0), minutes=1)
    got = raw.fluxes_by_period(records, run, ("co2",)).orderBy("period").collect()
    lags = [r["lag_co2"] for r in got]
    # The peak is smoothed over five lags, so any of the two on either side may be taken.
    assert all(abs(x - 7) <= 2 for x in lags) and not any(r["default_lag_co2"] for r in got)
    df, _ = raw.align(raw.prepare(records, run, ["co2"]), run, ["co2"])
    before = {(r["period"], r["rec"]): r["co2"] for r in records.collect()}
    for r in df.collect():
        assert r["co2"] == before.get((r["period"], r["rec"] + lags[r["period"] - 1]))


def test_calm_and_constant_air_gives_rows(spark):
    """No division fails on a period without wind, friction or variance."""
    still = spark.createDataFrame([(1, i, 0.0, 0.0, 0.0, 290.0, 16.0, 500.0) for i in range(1, 41)], "period long, rec long, u double, v double, w double, ts double, co2 double, h2o double")
    for change in ({"high_frequency": "massman_00"}, {"high_frequency": "horst_97", "lag": "pwb"}, {"high_frequency": "moncrieff_97", "footprint": "kljun_04"}, {"footprint": "hsieh_00", "uncertainty": "finkelstein_sims_01"}):
        assert raw.fluxes_by_period(still, Run(minutes=1, **change)).count() == 1
