"""Queries of day and night, separation, drift and lagged correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from turbula.functions import stats
from turbula.operators import bootstrap_lag, periods, site
from turbula.plans.queries.base import SIG, query, r, r6, rounded, signal, table

_THETA = "(2 * pi() * floor(k / 48) / 365)"
_RAD = (
    f"greatest(0.0::DOUBLE, 1376 * (1.00011 + 0.034221 * cos({_THETA}) + 0.00128 * sin({_THETA}) + 0.000719 * cos(2 * {_THETA}) + 0.000077 * sin(2 * {_THETA})) * "
    f"(sin(dec) * sin(radians(48)) + cos(dec) * cos(radians(48)) * cos(radians(15 * abs(11.75 - (k % 48) / 2.0::DOUBLE)))))"
)


@query(f"""
WITH e AS (SELECT event_id, value, event_type, user_id, (dayofyear(ts) - 1) * 48 + hour(ts) * 2 + minute(ts) // 30 + 1 AS hh FROM events),
i AS (SELECT *, greatest(hh - 1, 2) AS k1 FROM e), k AS (SELECT event_id, value, event_type, user_id, hh, unnest([k1, k1 - 1]) AS k FROM i),
d AS (SELECT *, 0.006918 - 0.399912 * cos({_THETA}) + 0.070257 * sin({_THETA}) - 0.006758 * cos(2 * {_THETA}) + 0.000907 * sin(2 * {_THETA}) - 0.002697 * cos(3 * {_THETA}) + 0.00148 * sin(3 * {_THETA}) AS dec FROM k),
m AS (SELECT event_id, any_value(value) AS value, any_value(event_type) AS kind, any_value(user_id) AS u, avg({_RAD}) AS rad FROM d GROUP BY event_id)
SELECT event_id, {r('rad')} AS radiation, rad > 10 AS by_sun,
CASE WHEN kind = 'error' THEN rad > 10 ELSE coalesce(value > 12, false) OR (u % 3 = 0 AND value * 10 > 100) END AS daytime FROM m""")
def site_daytime(spark, sf_dir):
    """Potential radiation, and day or night by measured radiation or the sun's height."""
    e = table(spark, sf_dir, "events")
    ts, k = F.col("ts"), F.greatest(site.half_hour_number(F.col("ts")) - 1, F.lit(2))
    rad = (site.potential_radiation(k, 48.0) + site.potential_radiation(k - 1, 48.0)) / 2
    measured = F.when(F.col("event_type") != "error", F.col("value"))
    photons = F.when((F.col("event_type") != "error") & (F.col("user_id") % 3 == 0), F.col("value") * 10)
    return e.select("event_id", r6(rad).alias("radiation"), site.is_daytime(ts, 48.0).alias("by_sun"), site.daytime(measured, photons, ts, 48.0).alias("daytime"))


_HL = """WITH e AS (SELECT event_id, (user_id % 41 - 20) / 10.0::DOUBLE AS zl, CAST(event_id * 37 % 360 AS DOUBLE) AS wd FROM events),
k AS (SELECT *, 2 * pi() * CASE WHEN zl <= -0.1 THEN 0.07 ELSE 2.31 - 2.24 / pow(1.015 + 0.15 * zl, 2) END / 1.1 / 4.0::DOUBLE AS kx,
2 * pi() * CASE WHEN zl <= -0.05 THEN 0.15 ELSE 2.43 - 2.28 / pow(1.01 + 0.2 * zl, 2) END / 4.0::DOUBLE AS ky,
2 * pi() * CASE WHEN zl <= 0.03 THEN 0.1 ELSE 0.43 - 0.33 / pow(0.964 + 1.2 * zl, 2) END / 4.0::DOUBLE AS kz,
sqrt(0.05) * abs(cos(radians(wd - (180 + degrees(atan(0.5::DOUBLE))) - 180))) AS rx, sqrt(0.05) * abs(sin(radians(wd - (180 + degrees(atan(0.5::DOUBLE))) - 180))) AS ry FROM e)"""


@query(f"{_HL} SELECT event_id, {r('exp(sqrt(pow(kx * rx, 2) + pow(pow(ky * ry, 1.2), 2))) * exp(kz * 0.15)')} AS factor, {r('exp(pow(ky * ry, 1.2)) * exp(kz * 0.15)')} AS cross_and_vertical FROM k")
def bpcf_separation(spark, sf_dir):
    """Flux factors for displaced sensors."""
    e = table(spark, sf_dir, "events").select("event_id", ((F.col("user_id") % 41 - 20) / 10.0).alias("zl"), (F.col("event_id") * 37 % 360).cast("double").alias("wd"))
    each = {n: site.separation_factor(F.col("zl"), F.col("wd"), F.lit(10.0), 5.0, 1.0, 0.2, 0.1, 0.15, a) for n, a in (("factor", True), ("cross_and_vertical", False))}
    return rounded(e.select("event_id", *[c.alias(n) for n, c in each.items()]))


@query(f"""
WITH {SIG}, j AS (SELECT a.p, a.w AS a, b.x AS b FROM sig a JOIN sig b ON a.p = b.p AND b.rec = a.rec - 2 WHERE a.w IS NOT NULL AND b.x IS NOT NULL),
c AS (SELECT p, count(*) AS m, corr(a, b) AS c FROM j GROUP BY p)
SELECT p, m AS n, {r('c')} AS r, {r('CASE WHEN abs(c) < 1 THEN c * sqrt((m - 2) / (1 - c * c)) END')} AS t FROM c""")
def stat_unbiased_correlation(spark, sf_dir):
    """Correlation at a lag over present pairs, and its t value."""
    return rounded(stats.unbiased_correlation(signal(spark, sf_dir), "p", "w", "x", "rec", 2))


@query(f"""
WITH e AS (SELECT event_id, user_id % 7 AS site, CAST(floor(epoch(ts)) AS BIGINT) AS sec, event_type AS kind, value FROM events),
c AS (SELECT site, sec, max(value) / 1e6::DOUBLE AS o FROM e WHERE kind = 'signup' GROUP BY ALL),
j AS (SELECT p.*, b.sec AS bs, b.o AS bo FROM e p ASOF LEFT JOIN c b ON p.site = b.site AND p.sec >= b.sec WHERE p.kind = 'purchase'),
k AS (SELECT j.*, a.sec AS asec, a.o AS ao FROM j ASOF LEFT JOIN c a ON j.site = a.site AND j.sec <= a.sec),
d AS (SELECT event_id, value / 1e4::DOUBLE AS x, CASE WHEN ao IS NOT NULL THEN bo + CASE WHEN floor((asec - bs) / 1800) > 0 THEN (ao - bo) / floor((asec - bs) / 1800) * floor((sec - bs) / 1800) ELSE 0 END END AS drift FROM k),
y AS (SELECT *, CASE WHEN drift IS NULL OR x IS NULL THEN x ELSE (0.01 - drift) + (x - 0.01) / (1 - drift * 95) END AS y FROM d)
SELECT event_id, {r('drift * 1e3')} AS drift, {r('1 + 2 * y - 3 * y * y + 0.5 * y * y * y')} AS density FROM y""")
def drift_absorptance(spark, sf_dir):
    """Offsets between calibrations, removed from absorptances, and back to densities by a calibration curve."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 7).alias("site"), periods.seconds("ts").alias("sec"), "event_type", "value")
    marks = e.where("event_type = 'signup'").groupBy("site", "sec").agg((F.max("value") / 1e6).alias("offset"))
    points = e.where("event_type = 'purchase'").select("event_id", "site", "sec", (F.col("value") / 1e4).alias("x"))
    found = site.drift_between_calibrations(points, marks, ["site"], "sec", 1800)
    y = site.without_drift(F.col("x"), F.lit(0.01), F.col("drift"), F.lit(95_000.0))
    return rounded(found.select("event_id", (F.col("drift") * 1e3).alias("drift"), site.polynomial([1.0, 2.0, -3.0, 0.5], y).alias("density")))


@query()
def lag_bootstrap(spark, sf_dir):
    """Lags by pre-whitened block bootstrap, and what is accepted of them from day to day."""
    s = signal(spark, sf_dir).select("p", "rec", "w", (290 + F.col("w") * 0.3 + F.col("u") * 0.05).alias("ts"), F.col("x").alias("co2"), F.col("v").alias("h2o"))
    options = bootstrap_lag.Bootstrap(min_lag=-2.0, max_lag=2.0, block=4.0)
    found = bootstrap_lag.detect_lags(s, "p", ["co2", "h2o"], 10.0, options)
    return rounded(bootstrap_lag.accept_lags(found, "p", 10.0, {"co2": "a", "h2o": "a"}, options))
