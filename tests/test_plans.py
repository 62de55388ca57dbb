"""Whole plans, the online mode, and the driver contract."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__
from turbula.plans import raw
from turbula.plans.config import Run, express
from turbula.sources import sinks
from turbula.streaming import online


@pytest.fixture(scope="module")
def records(spark):
    rng = np.random.default_rng(8)
    rows = []
    for p in (0, 1):
        w = rng.normal(size=600) * 0.3
        for i in range(600):
            rows.append((p, i + 1, *map(float, (3 + rng.normal() * 0.5 - 0.4 * w[i], rng.normal() * 0.5, w[i], 293 + 0.2 * w[i], 16 - 0.1 * w[i], 500 + 2 * w[i]))))
    return spark.createDataFrame(rows, "period long, rec long, u double, v double, w double, ts double, co2 double, h2o double")


def test_signs_of_fluxes(records):
    for r in raw.fluxes_by_period(records, Run(lag="none")).collect():
        assert r["h"] > 0 and r["flux_co2"] < 10 and r["le"] > 0 and r["tau"] < 0 and r["ustar"] > 0


def test_the_default_chain_against_numpy(records):
    """Rotation, covariances, moist air, stability, and the open path's density terms, from the published formulas."""
    got = {r["period"]: r for r in raw.fluxes_by_period(records, Run(lag="none", altitude=300.0, height=4.0, displacement=1.0)).collect()}
    for period, f in records.toPandas().groupby("period"):
        u, v, w, ts, co2, h2o = (f.sort_values("rec")[c].to_numpy() for c in ("u", "v", "w", "ts", "co2", "h2o"))
        yaw = np.arctan2(v.mean(), u.mean())
        u, v = u * np.cos(yaw) + v * np.sin(yaw), v * np.cos(yaw) - u * np.sin(yaw)
        pitch = np.arctan2(w.mean(), u.mean())
        u, w = u * np.cos(pitch) + w * np.sin(pitch), w * np.cos(pitch) - u * np.sin(pitch)
        cov = lambda a, b: ((a - a.mean()) * (b - b.mean())).mean()
        p, t = 1e5 * (1 - 2.25577e-5 * 300) ** 5.25588, ts.mean()
        e = h2o.mean() * 1e-3 * 8.314 * t
        rho_w, rho_d = e / (461.5 * t), (p - e) / (287.04 * t)
        ta = t / (1 + 0.51 * rho_w / (rho_w + rho_d))
        rh = min(100.0, 100 * e / (np.exp(77.345 + 0.0057 * t - 7235 / t) / t**8.2))
        c = t - 273.15
        rho_cp = (1859 + 0.13 * rh + (0.193 + 5.6e-3 * rh) * c + (1e-3 + 5e-5 * rh) * c * c) * rho_w + (1005 + (c + 23.12) ** 2 / 3364) * rho_d
        ustar = (cov(w, u) ** 2 + cov(w, v) ** 2) ** 0.25
        length = -ta * (1e5 / p) ** 0.286 * ustar**3 / (0.41 * 9.81 * cov(w, ts))
        h, mu, sigma = rho_cp * cov(w, ts), 0.02897 / 18.02e-3, rho_w / rho_d
        evaporation = (1 + mu * sigma) * (cov(w, h2o) * 0.01802e-3 + h * rho_w / (rho_cp * ta))
        flux = cov(w, co2) * 1e3 + mu * evaporation * co2.mean() * 1e3 / ((1 + mu * sigma) * rho_d) + h * co2.mean() * 1e3 / (rho_cp * ta)
        tau = np.sign(cov(w, u)) * (rho_d + rho_w) * ustar**2
        want = {"ustar": ustar, "ta": ta, "rh": rh, "l": length, "z_l": 3 / length, "h": h, "tau": tau, "evaporation": evaporation, "le": evaporation * (3147.5 - 2.37 * ta) * 1e3, "flux_co2": flux}
        assert {k: got[period][k] for k in want} == pytest.approx(want, rel=1e-9)


def test_a_stored_plane_is_used_again(records, tmp_path):
    run = Run(lag="none", rotation="planar_fit")
    sinks.write_model(raw.fit_planes(raw.masked(records, run, ["co2", "h2o"])), str(tmp_path / "planes"))
    again = raw.fluxes_by_period(records, run, planes=records.sparkSession.read.parquet(str(tmp_path / "planes"))).orderBy("period").collect()
    for a, b in zip(again, raw.fluxes_by_period(records, run).orderBy("period").collect(), strict=True):
        assert a["h"] == pytest.approx(b["h"], rel=1e-9) and a["mean_w"] == pytest.approx(b["mean_w"], abs=1e-12)
    tilted = records.sparkSession.createDataFrame([(1, 0.0, 0.1, 0.0)], "sector long, b0 double, b1 double, b2 double")
    assert raw.fluxes_by_period(records, run, planes=tilted).orderBy("period").first()["mean_w"] < again[0]["mean_w"] - 0.1


def test_statistics_follow_the_steps(records):
    got = {(r["period"], r["level"], r["variable"]): r for r in raw.statistics_by_level(records, Run(despike="median", lag="maxcov", detrend="ld")).collect()}
    assert len(got) == 2 * 6 * 6
    assert abs(got[0, 4, "w"]["mean"]) < 1e-9 < abs(got[0, 1, "w"]["mean"]) and abs(got[0, 6, "ts"]["mean"]) < 1e-6 and got[0, 5, "co2"]["n"] <= got[0, 4, "co2"]["n"] == 600


@pytest.mark.parametrize("change", [{"rotation": "triple_rotation"}, {"rotation": "planar_fit"}, {"detrend": "ld"}, {"detrend": "rm"}, {"detrend": "ew"}, {"high_frequency": "horst_97"}, {"footprint": "kormann_meixner_01"}, {"uncertainty": "finkelstein_sims_01"}, {"flags": "foken_03"}, {"lag": "constant", "default_lag": 1}])
def test_options(records, change):
    assert raw.fluxes_by_period(records, Run(**{"lag": "none"} | change)).count() == 2


def test_corrections_raise_fluxes(records):
    plain, more = (raw.fluxes_by_period(records, Run(lag="none", high_frequency=h)).orderBy("period").first()["h"] for h in ("none", "moncrieff_97"))
    assert more > plain


def test_every_option_has_an_effect(records):
    """Options that once did nothing: each changes what it names."""
    def one(**change):
        return raw.fluxes_by_period(records, Run(**{"lag": "none", "flags": "none"} | change)).orderBy("period").first().asDict()

    plain = one()
    found = {u: one(uncertainty=u)["uncertainty"] for u in ("finkelstein_sims_01", "mann_lenschow_94", "mahrt_98", "billesbach_11")}
    assert len({round(x, 12) for x in found.values()}) == 4 and all(x > 0 for x in found.values())
    assert one(altitude=2000.0)["rho_d"] < plain["rho_d"] == one(pressure=1e5)["rho_d"]
    closed = one(path="closed")
    assert closed["flux_co2"] not in (plain["flux_co2"], one(path="closed", density_terms=False)["flux_co2"])
    assert one(self_heating={"bottom": (0.9, 2.0), "top": (0.9, 2.0), "spar": (0.9, 2.0)})["flux_co2"] > plain["flux_co2"]
    assert one(high_frequency="ibrom_07", ibrom=(1.0, 0.5), cutoff=0.5)["h"] > one(high_frequency="ibrom_07", ibrom=(1.0, 0.5), cutoff=5.0)["h"]
    assert one(limits={"co2": (0.0, 1.0)}, max_missing_percent=100.0)["flux_co2"] is None
    turned, flat = (one(flags="foken_03", latitude=x) for x in (70.0, 1.0))
    assert turned["turbulence"] != flat["turbulence"]
    with pytest.raises(ValueError):
        Run(high_frequency="ibrom_07")


def test_planes_by_sector(spark):
    """Two wind directions over two planes: each period's mean vertical wind vanishes only with two sectors."""
    rng, rows = np.random.default_rng(1), []
    for p in range(12):
        side, a = p % 2, 0.2 * (p // 2)
        u, v = (3 + a, 1 + a * (p % 3)) if side == 0 else (-3 - a, -1 - a * (p % 3))
        slope = 0.1 if side == 0 else -0.05
        for i in range(50):
            x = u + 0.1 * rng.normal()
            rows.append((p, i + 1, x, v + 0.01 * rng.normal(), slope * x, 293.0 + rng.normal(), 16.0 + rng.normal(), 500.0 + rng.normal()))
    df = spark.createDataFrame(rows, "period long, rec long, u double, v double, w double, ts double, co2 double, h2o double")
    worst = {n: max(abs(r["mean_w"]) for r in raw.fluxes_by_period(df, Run(rotation="planar_fit", sectors=n, lag="none")).collect()) for n in (1, 2)}
    assert worst[2] < 0.02 < worst[1]


def test_lags_without_a_join_are_those_of_the_table(records):
    from turbula.operators import transform

    moved = records.withColumn("co2", F.lag("co2", 3).over(Window.partitionBy("period").orderBy("rec")))
    table = transform.lag_table(moved, "period", "w", "co2", range(-5, 6))
    want = transform.best_lag(table, "period", 0)
    old = transform.apply_lag(moved, want, "period", ["co2"])
    new = transform.align_to_best_lags(moved, "period", "w", ["co2"], range(-5, 6), 0)
    assert {r["lag_co2"] for r in new.collect()} == {3} == {r["lag"] for r in want.collect()}
    assert {(r["period"], r["rec"], r["co2"]) for r in new.collect()} == {(r["period"], r["rec"], r["co2"]) for r in old.collect()}


def test_records_are_read_few_times(records):
    plan = raw.fluxes_by_period(records, Run())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and "Join" not in plan


def test_scaled_cospectra(records):
    got = raw.spectra_by_period(records, Run(lag="none", taper="hann"), bins=8)
    other = raw.spectra_by_period(records, Run(lag="none", taper="squared"), bins=8)
    assert got.select("pair").distinct().count() == 4 and got.where("bin between 1 and 8").count() == got.count()
    first = lambda d: d.where("pair = 'w_p_ts_p'").orderBy("period", "bin").first()["density"]
    assert first(got) != first(other)


def test_wrong_options_are_refused():
    with pytest.raises(ValueError):
        Run(detrend="other")
    assert express().high_frequency == "moncrieff_97"


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    df = spark.range(0, 7200, 10).select(F.timestamp_seconds("id").alias("ts"), (F.col("id") % 7).cast("double").alias("w"), (F.col("id") % 5).cast("double").alias("u"), (F.col("id") % 3).cast("double").alias("x"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = online.period_statistics(stream, minutes=30).writeStream.format("memory").queryName("periods").outputMode("complete").start()
    try:
        q.processAllAvailable()
        got = {r["period_start"]: r["cov_wu"] for r in spark.table("periods").collect()}
    finally:
        q.stop()
    assert got == {r["period_start"]: r["cov_wu"] for r in online.period_statistics(df, minutes=30).collect()} and len(got) == 4


def test_storage_keeps_state(spark, tmp_path):
    spark.createDataFrame([("a", 0, 1.0), ("a", 10, 3.0), ("a", 30, 4.0)], "site string, start long, t double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("site string, start long, t double").parquet(str(tmp_path / "in"))
    q = online.storage_stream(stream, "site", "start", "t", 10, 5.0).writeStream.format("memory").queryName("storage").outputMode("append").start()
    try:
        q.processAllAvailable()
        got = sorted((r["start"], r["storage"]) for r in spark.table("storage").collect())
    finally:
        q.stop()
    assert got == [(0, None), (10, 1.0), (30, None)]


def test_contract(spark):
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries)
    assert __spark_entry__.entry(spark).count() > 0
