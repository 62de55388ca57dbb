"""Steps whose cost once grew faster than their input: the same results, by a form that grows with it."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from turbula import catalog
from turbula.operators import correction, footprint, periods, quality, site, transform


def frames_up_to_the_end(df) -> bool:
    """Whether a window reads the rest of its partition anew for each row."""
    return "currentrow$(), unboundedfollowing" in df._jdf.queryExecution().toString().lower()


def test_interpolation_of_a_long_period(spark):
    n = 60_000
    x = np.random.default_rng(4).normal(size=n)
    x[np.random.default_rng(5).random(n) < 0.2] = np.nan
    x[:3] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"p": 0, "rec": np.arange(n), "x": x})).withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
    out = transform.interpolate_gaps(df, "p", "x")
    assert not frames_up_to_the_end(out)
    got = out.orderBy("rec").toPandas()["x_i"].to_numpy(float)
    known = np.flatnonzero(~np.isnan(x))
    want = np.interp(np.arange(n), known, x[known])
    want[: known[0]] = want[known[-1] + 1 :] = np.nan
    np.testing.assert_allclose(got, want, atol=1e-12)


def test_drift_on_a_long_time_line(spark):
    n = 40_000
    points = spark.range(n).select((F.col("id") % 2).alias("site"), (F.col("id") * 5).alias("sec"))
    marks = spark.range(n // 100).select((F.col("id") % 2).alias("site"), (F.col("id") * 487 + 11).alias("sec"), (F.col("id") % 7 / 10).alias("offset"))
    out = site.drift_between_calibrations(points, marks, ["site"], "sec", 60)
    assert not frames_up_to_the_end(out)
    got = out.toPandas().sort_values(["site", "sec"])
    for s, part in got.groupby("site"):
        m = marks.where(F.col("site") == int(s)).orderBy("sec").toPandas()
        b = np.searchsorted(m["sec"], part["sec"], "right") - 1
        a = np.searchsorted(m["sec"], part["sec"], "left")
        ok = (b >= 0) & (a < len(m))
        tb, ta = m["sec"].to_numpy()[b[ok]], m["sec"].to_numpy()[a[ok]]
        ob, oa = m["offset"].to_numpy()[b[ok]], m["offset"].to_numpy()[a[ok]]
        whole, passed = (ta - tb) // 60, (part["sec"].to_numpy()[ok] - tb) // 60
        want = ob + np.where(whole > 0, (oa - ob) / np.maximum(whole, 1) * passed, 0.0)
        assert part["drift"].isna().to_numpy().tolist() == (~ok).tolist()
        np.testing.assert_allclose(part["drift"].to_numpy(float)[ok], want, atol=1e-12)


def test_footprint_sums_stop_at_the_last_share(monkeypatch):
    """The first metres at which a plain running sum exceeds the shares; little is summed beyond the last of them."""
    i = np.arange(600)
    us, zl, u = 0.1 + i % 37 / 50, i % 23 / 10 - 1, 1 + i % 13 / 2
    summed = []
    plain = np.exp
    monkeypatch.setattr(np, "exp", lambda z: (summed.append(np.size(z)), plain(z))[1])
    got = footprint._kormann(3.0, us, zl, u)
    monkeypatch.undo()
    assert sum(summed) < 600 * 4000
    with np.errstate(all="ignore"):
        stable = zl > 0
        inner = np.where(stable, 1.0, 1 - 16 * zl)
        phi_m = np.where(stable, 1 + 5 * zl, inner**-0.25)
        phi_c = np.where(stable, phi_m, inner**-0.5)
        n, m = np.where(stable, 1 / phi_m, (1 - 24 * zl) / inner), us * phi_m / (0.41 * u)
    r = 2 + m - n
    mu, zeta = (1 + m) / r, u / 3.0**m * 3.0**r / (r * r * (0.41 * us * 3.0 / (phi_c * 3.0**n)))
    x = np.arange(1.0, 10_001)
    for k in range(0, 600, 7):
        total = np.cumsum(np.exp(mu[k] * np.log(zeta[k]) - zeta[k] / x - (1 + mu[k]) * np.log(x)) / math.gamma(mu[k]))
        for name, share in footprint.SHARES.items():
            over = np.flatnonzero(total > share)
            assert got[name][k] == over[0] + 1 if len(over) else np.isnan(got[name][k])


@pytest.mark.parametrize("side", ["later", "strictly_later", "before", "strictly_before", "either"])
def test_tolerance_match_meets_no_pairs(spark, side):
    """Nearest times against a plain search; a point isn't copied, nor joined with all times near it."""
    rng = np.random.default_rng(6)
    at, times = rng.integers(-400, 3000, 500), np.unique(np.concatenate((rng.integers(-500, 800, 60), rng.integers(1500, 2600, 200))))
    rows = [(int(i), int(t)) for i, t in enumerate(at)] + [(0, int(at[0])), (900, None)]
    points, series = spark.createDataFrame(rows, "id long, t long"), spark.createDataFrame([(int(t),) for t in times] + [(None,)], "s long")
    out = periods.tolerance_match(points, series, "t", "s", 20, side)
    assert "join" not in out._jdf.queryExecution().toString().lower()
    want = set()
    for i, t in rows[:500]:
        gaps = [s - t for s in times.tolist()]
        ok = {"later": lambda g: 0 <= g <= 20, "strictly_later": lambda g: 0 < g <= 20, "before": lambda g: -20 <= g <= 0, "strictly_before": lambda g: -20 <= g < 0, "either": lambda g: abs(g) <= 20}[side]
        near = sorted((abs(g), t + g) for g in gaps if ok(g))
        if near:
            want.add((i, t, near[0][1]))
    got = [tuple(r) for r in out.collect()]
    assert out.columns == ["id", "t", "matched"] and len(got) == len(want) and set(got) == want


def test_model_factor_makes_no_row_for_each_frequency(spark):
    """The same factors as by the grid's rows, within the task of the period."""
    df = spark.createDataFrame([(i, 0.5 + i % 9 / 2 if i % 11 else None, i % 7 / 3 - 1 if i % 13 else None) for i in range(300)], "i long, u double, zl double")
    f, xp = F.col("f"), correction.Arrays
    want = correction.correction_factors(df, correction.frequency_grid(spark), "i", correction.model_cospectrum(f * 3.0 / F.col("u"), f, F.col("zl")), correction.first_order(f, 0.1) * correction.high_pass(f, "ld", 30, 10.0, 60.0))
    factor = correction.analytic_factor(
        F.col("u"), F.col("zl"), lambda f, u, zl: correction.model_cospectrum(f * 3.0 / u, f, zl, xp=xp), lambda f, u, zl: correction.first_order(f, 0.1, xp) * correction.high_pass(f, "ld", 30, 10.0, 60.0, xp)
    )
    both = df.join(want, "i").select("u", "zl", "factor", factor.alias("got")).toPandas()
    known = both["u"].notna() & both["zl"].notna()
    assert (both["got"].notna() == known).all() and known.sum() > 200
    np.testing.assert_allclose(both["got"][known].astype(float), both["factor"][known].astype(float), rtol=1e-10)
    assert "join" not in catalog.QUERIES["bpcf_analytic"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString().lower()


def test_kernels_of_a_period_hold_arrays(spark):
    """Despiking and lags make no frame of a period; order, nulls and the columns that only pass are kept."""
    n = 30_000
    rng = np.random.default_rng(9)
    w = rng.normal(size=n)
    c = np.roll(w, 4) + 0.1 * rng.normal(size=n)
    c[[500, 9_000]], c[[70, 71]] = 80.0, np.nan
    df = pd.DataFrame({"p": 1, "rec": np.arange(1, n + 1), "w": w, "c": c, "name": [f"r{i}" if i % 3 else None for i in range(1, n + 1)]})
    rows = spark.createDataFrame(df.sample(frac=1, random_state=1)).withColumn("c", F.nanvl("c", F.lit(None).cast("double")))
    out = transform.align_to_best_lags(quality.despike(rows, "p", ["c"], "rec", "median"), "p", "w", ["c"], range(-6, 7))
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
    got = out.toPandas().sort_values("rec")
    fixed, many = quality.despike_median(c)
    assert set(got["lag_c"]) == {4} and set(got["c_spikes"]) == {many} and many >= 2 and not got["default_lag_c"].any()
    np.testing.assert_array_equal(got["c"].to_numpy(float), transform.moved_by(fixed, 4))
    assert out.where("c is null").count() == 4 + np.isnan(fixed).sum() and out.where("isnan(c)").count() == 0
    assert got["name"].where(got["name"].notna(), None).tolist() == df["name"].tolist() and (got["w"].to_numpy() == w).all()


def test_express_plan_makes_no_frame_of_a_period(spark):
    from turbula.plans import config, raw

    rows = spark.range(400).select((F.col("id") % 2).alias("period"), F.floor(F.col("id") / 2 + 1).alias("rec"), *[F.rand(i).alias(c) for i, c in enumerate(("u", "v", "w", "co2", "h2o"))], (F.lit(290.0) + F.rand(7)).alias("ts"))
    out = raw.fluxes_by_period(rows, config.express(despike="median", rotation="triple_rotation"))
    plan = out._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan and "_spikes" not in out.columns and out.count() == 2


@pytest.mark.parametrize("options", [{"despike": "median", "lag": "maxcov", "detrend": "ld"}, {"lag": "none", "rotation": "none"}])
def test_statistics_of_all_levels_take_one_pass(spark, options):
    """The records are read once for all levels, each of which has the statistics of its step alone."""
    from turbula.plans import config, raw

    names = ["u", "v", "w", "ts", "co2", "h2o"]
    rng = np.random.default_rng(3)
    f = pd.DataFrame({c: rng.normal(size=900) + m for c, m in zip(names, (3, 1, 0.2, 290, 16, 500))})
    f["co2"] = np.where(np.arange(900) % 7 == 0, np.nan, f["co2"] + 0.5 * f["w"])
    f.loc[[50, 400], ["ts", "h2o"]] = 345.0, 900.0
    f.loc[[51, 500], "u"] = 70.0
    f.insert(0, "rec", np.arange(900) // 3 + 1)
    f.insert(0, "period", np.arange(900) % 3)
    records = spark.createDataFrame(f).withColumn("co2", F.nanvl("co2", F.lit(None).cast("double"))).localCheckpoint()
    run = config.Run(max_missing_percent=40.0, **options)
    out = raw.statistics_by_level(records, run)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and "Union" not in plan
    assert out.columns == ["period", "level", "variable", "n", "mean", "sd", "lowest", "highest", "skewness", "kurtosis", "cov_w"]
    got = {(r["period"], r["level"], r["variable"]): r for r in out.collect()}
    assert len(got) == 3 * 6 * 6 == out.count()
    two = raw.masked(records, run, names[4:])
    three = raw.despiked(two, run, names[4:])
    four = raw.rotated(three, run)
    five, _ = raw.align(four, run, names[4:])
    six = raw.fluctuate(five, run, names).select("period", *[F.col(f"{c}_p").alias(c) for c in names])
    for level, df in enumerate((records, two, three, four, five, six), 1):
        for period, g in df.select("period", *names).toPandas().astype(float).groupby("period"):
            for c in names:
                x, r = g[c], got[int(period), level, c]
                both = g[["w"]].assign(x=x).dropna()
                cov = ((both["w"] - both["w"].mean()) * (both["x"] - both["x"].mean())).mean()
                d = x - x.mean()
                want = [x.count(), x.mean(), x.std(), x.min(), x.max(), (d**3).mean() / x.std() ** 3, (d**4).mean() / x.std() ** 4, cov]
                np.testing.assert_allclose([r[k] for k in out.columns[3:]], want, rtol=1e-8, atol=1e-8)
