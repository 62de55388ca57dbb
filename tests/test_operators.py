"""Closed-form properties, and the kernels against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from turbula.functions import stats, thermo
from turbula.operators import correction, ensemble, fluxes, footprint, masks, periods, quality, spectra, transform


def frame(spark, **columns):
    names = list(columns)
    return spark.createDataFrame([tuple(None if isinstance(v, float) and math.isnan(v) else v for v in row) for row in zip(*columns.values(), strict=True)], names)


@pytest.fixture(scope="module")
def wind(spark):
    rng = np.random.default_rng(3)
    n = 256
    u, v, w = 3 + rng.normal(size=n), 1 + rng.normal(size=n), 0.3 + 0.2 * rng.normal(size=n)
    return frame(spark, period=[0] * n, rec=list(range(1, n + 1)), u=u.tolist(), v=v.tolist(), w=w.tolist())


def test_double_rotation_levels_the_mean_wind(wind):
    m = transform.double_rotation(wind, "period").agg(F.avg("u").alias("u"), F.avg("v").alias("v"), F.avg("w").alias("w")).first()
    assert abs(m["v"]) < 1e-9 and abs(m["w"]) < 1e-9 and m["u"] > 3


def test_rotation_keeps_the_speed_and_skips_incomplete_records(spark):
    df = frame(spark, period=[0, 0, 0], rec=[1, 2, 3], u=[1.0, 2.0, 3.0], v=[0.5, float("nan"), 1.0], w=[0.1, 0.2, 0.3])
    out = {r["rec"]: r for r in transform.double_rotation(df, "period").collect()}
    assert out[2]["u"] == 2.0 and out[2]["v"] is None
    assert math.hypot(out[1]["u"], out[1]["v"], out[1]["w"]) == pytest.approx(math.hypot(1.0, 0.5, 0.1))


def test_third_rotation_removes_the_covariance(wind):
    turned = transform.third_rotation(wind, "period", limit_degrees=180.0)
    assert abs(turned.agg(F.covar_pop("v", "w")).first()[0]) < 1e-9


def test_planar_fit_finds_the_plane(spark):
    rng = np.random.default_rng(1)
    u, v = rng.normal(size=40), rng.normal(size=40)
    df = frame(spark, sector=[1] * 40, u=u.tolist(), v=v.tolist(), w=(0.1 + 0.02 * u - 0.03 * v).tolist())
    fit = transform.planar_fit(df, "sector").first()
    assert [fit["b0"], fit["b1"], fit["b2"]] == pytest.approx([0.1, 0.02, -0.03])


def test_planar_fit_has_no_plane_where_there_are_too_few(spark):
    fit = transform.planar_fit(frame(spark, sector=[1, 1], u=[1.0, 2.0], v=[1.0, 2.0], w=[0.0, 0.0]), "sector").first()
    assert fit["b1"] is None


def test_borrowed_sectors(spark):
    fits = spark.createDataFrame([(1, 0.0, 0.1, 0.2), (2, None, None, None), (3, 0.0, 0.3, 0.4)], "sector long, b0 double, b1 double, b2 double")
    got = {r["sector"]: r["source"] for r in transform.borrow_sectors(fits, "sector", 4).collect()}
    assert got == {1: 1, 2: 3, 3: 3, 4: 1}


def test_lag_is_found_and_applied(spark):
    rng = np.random.default_rng(5)
    w = rng.normal(size=300)
    x = np.roll(w, 4)
    df = frame(spark, period=[0] * 300, rec=list(range(1, 301)), w=w.tolist(), x=x.tolist())
    lag = transform.best_lag(transform.lag_table(df, "period", "w", "x", range(-8, 9)), "period")
    assert lag.first()["lag"] == 4
    moved = transform.apply_lag(df, lag, "period", ["x"])
    assert moved.agg(F.corr("w", "x")).first()[0] == pytest.approx(1.0)
    assert moved.where("x is null").count() == 4


def test_linear_detrend_removes_a_line(spark):
    n = 50
    df = frame(spark, period=[0] * n, rec=list(range(1, n + 1)), x=[2.0 * i + 1 for i in range(n)])
    assert transform.linear_detrend(df, "period", ["x"]).agg(F.max(F.abs("x_p"))).first()[0] < 1e-9


def test_exponential_average_against_a_loop(spark):
    x = [1.0, float("nan"), 3.0, 2.0]
    df = frame(spark, period=[0] * 4, rec=[1, 2, 3, 4], x=x)
    got = [r["x_p"] for r in transform.exponential_average(df, "period", ["x"], 1.0, 2.0).orderBy("rec").collect()]
    keep, mean, want = math.exp(-0.5), None, []
    for v in x:
        if math.isnan(v):
            want.append(None)
        else:
            mean = v if mean is None else keep * mean + (1 - keep) * v
            want.append(v - mean)
    assert got[1] is None and [g for g in got if g is not None] == pytest.approx([w for w in want if w is not None])


@pytest.mark.parametrize("values, q, want", [([1, 2, 3, 4], 0.25, 1.5), ([1, 2, 3, 4], 0.5, 2.5), ([1, 2, 3], 0.5, 2), ([7], 0.25, 7), ([1, 2, 3, 4, 5], 0.75, 4)])
def test_sas5(spark, values, q, want):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    assert df.agg(stats.quantile_sas5("x", q)).first()[0] == want


def test_directions_wrap_around(spark):
    df = spark.createDataFrame([(350.0,), (10.0,)], "d double")
    m = df.agg(stats.circular_mean("d").alias("m"), stats.circular_deviation("d").alias("s")).first()
    assert min(m["m"], 360 - m["m"]) < 1e-9 and m["s"] == pytest.approx(10, rel=0.02)


def test_despike_replaces_a_spike():
    x = np.sin(np.arange(400) / 10)
    y = x.copy()
    y[100] = 50
    fixed, n = quality.despike_median(y)
    assert n == 1 and fixed[100] == pytest.approx(x[100], abs=0.02)
    fixed, n = quality.despike_moving(y, window=100, step=20)
    assert n >= 1 and abs(fixed[100]) < 2


def test_spectrum_obeys_parseval(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=512)
    f, s = spectra.one_sided_density(x, x, 10.0, spectra.taper("squared", 512))
    assert s.sum() * (f[1] - f[0]) == pytest.approx(x.var(), rel=1e-9)
    df = frame(spark, period=[0] * 512, rec=list(range(512)), x=x.tolist())
    out = spectra.cospectra(df, "period", "rec", [("x", "x")], 10.0, "squared").agg(F.sum("density")).first()[0]
    assert out * (f[1] - f[0]) == pytest.approx(x.var(), rel=1e-9)


@pytest.mark.parametrize("kind", ["squared", "bartlett", "welch", "hamming", "hann"])
def test_tapers_are_symmetric(kind):
    w = spectra.taper(kind, 33)
    assert w == pytest.approx(w[::-1]) and w.max() == pytest.approx(1.0)


def test_bins_close_on_the_stated_side(spark):
    df = spark.createDataFrame([(1.0,), (10.0,), (100.0,)], "f double")
    right = [r[0] for r in df.select(spectra.frequency_bin(F.col("f"), 1.0, 100.0, 2, "right")).collect()]
    left = [r[0] for r in df.select(spectra.frequency_bin(F.col("f"), 1.0, 100.0, 2, "left")).collect()]
    assert right == [1, 1, 2] and left == [1, 2, 2]


def test_correction_grows_with_the_sensor_and_shrinks_with_nothing(spark):
    p = spark.createDataFrame([(1, 2.0, -0.1)], "period long, u double, zl double")
    f, grid = F.col("f"), correction.frequency_grid(spark)
    model = correction.model_cospectrum(f * 3 / F.col("u"), f, F.col("zl"))
    factor = lambda t: correction.correction_factors(p, grid, "period", model, t).first()["factor"]
    assert factor(F.lit(1.0)) == pytest.approx(1.0)
    assert 1 < factor(correction.first_order(f, 0.05)) < factor(correction.first_order(f, 0.5))


def test_fit_recovers_a_cutoff(spark):
    x = np.geomspace(0.01, 5, 30)
    y = 0.9 / (1 + (x / 0.4) ** 2)
    df = frame(spark, k=[1] * 30, x=x.tolist(), y=y.tolist())
    got = ensemble.fit_models(df, ["k"], "x", "y", "first_order").first()
    assert [got["parameters"][0], abs(got["parameters"][1])] == pytest.approx([0.9, 0.4], rel=1e-4)


def test_too_few_points_are_not_fitted(spark):
    assert ensemble.fit_models(frame(spark, k=[1], x=[1.0], y=[1.0]), ["k"], "x", "y", "power").first()["parameters"] is None


def test_humidity_classes_are_open(spark):
    df = spark.createDataFrame([(5.0,), (10.0,), (15.0,), (100.0,)], "rh double")
    assert [r[0] for r in df.select(ensemble.humidity_class(F.col("rh"))).collect()] == [1, None, 2, None]


def test_saturation_pressure_is_about_right(spark):
    assert spark.range(1).select(thermo.saturation_pressure(F.lit(293.15))).first()[0] == pytest.approx(2339, rel=0.01)


def test_missing_terms_are_left_out(spark):
    none = F.lit(None).cast("double")
    k = F.lit
    got = spark.range(1).select(fluxes.closed_path_evaporation(k(1.0), none, none, k(0.01), k(1200.0), k(290.0), k(9e4), k(1.0), k(0.0))).first()[0]
    assert got == pytest.approx(1.0)


def test_storage_needs_the_period_before(spark):
    df = spark.createDataFrame([(0, 1.0), (10, 2.0), (30, 5.0)], "period long, t double")
    got = [r["storage_t"] for r in fluxes.storage(df, "period", 10, "t", 1.0, 1.0).orderBy("period").collect()]
    assert got == [None, 1.0, None]


def test_footprint_integral_is_ordered():
    d = footprint._kormann(3.0, np.array([0.4]), np.array([-0.1]), np.array([3.0]))
    assert d["offset"][0] < d["x10"][0] < d["x50"][0] < d["x90"][0]


def test_flags(spark):
    df = spark.createDataFrame([(10, 10), (40, 20), (600, 1), (None, 1)], "a int, b int")
    a, b = quality.partial_flag(F.col("a")), quality.partial_flag(F.col("b"))
    assert [r[0] for r in df.select(quality.overall_flag_0_2(a, b)).collect()] == [0, 1, 2, 2]


def test_masks_keep_rows(spark):
    df = frame(spark, period=[0, 0, 0], x=[1.0, -9999.0, float("inf")])
    assert [r["x"] for r in masks.finite(df, ["x"]).collect()] == [1.0, None, None]


@pytest.mark.parametrize("side, want", [("later", 110), ("strictly_later", 110), ("before", 95), ("strictly_before", 95), ("either", 95)])
def test_tolerance_sides(spark, side, want):
    points, series = spark.createDataFrame([(1, 100)], "id long, t long"), spark.createDataFrame([(95,), (110,), (300,)], "s long")
    assert periods.tolerance_match(points, series, "t", "s", 20, side).first()["matched"] == want


def test_as_of_without_an_earlier_row(spark):
    left = spark.createDataFrame([("a", 5), ("a", 15)], "k string, t long")
    right = spark.createDataFrame([("a", 10, 1.5)], "k string, r long, h double")
    assert sorted((r["t"], r["h"]) for r in periods.as_of_join(left, right, "t", "r", ["k"], ["h"]).collect()) == [(5, None), (15, 1.5)]


def test_range_join_keeps_empty_intervals(spark):
    left = spark.createDataFrame([(0, 10), (10, 20)], "a long, b long")
    right = spark.createDataFrame([(3,), (9,)], "t long")
    got = periods.range_join(left, right, "t", "a", "b", 7, "left")
    assert sorted((r["a"], r["t"]) for r in got.collect() if r["t"] is not None) == [(0, 3), (0, 9)] and got.where("t is null").count() == 1
