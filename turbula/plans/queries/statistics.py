"""Queries of missing-aware statistics, masks and quality tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from turbula.functions import stats
from turbula.operators import masks, quality, transform, uncertainty
from turbula.plans.queries.base import SIG, query, r, rounded, signal, table

_N = "count(x)"


@query(f"""
WITH {SIG} SELECT p, count(*) AS n_records, count(x) AS n, {r('avg(x)')} AS mean, {r('stddev_samp(x)')} AS sd, {r('stddev_pop(x)')} AS sd_level,
{r('min(x)')} AS lo, {r('max(x)')} AS hi, {r('median(x)')} AS med, {r('sum(x)')} AS total FROM sig GROUP BY p""")
def stat_basic(spark, sf_dir):
    """Sums, means and deviations that skip missing values."""
    return rounded(signal(spark, sf_dir).groupBy("p").agg(
        F.count("*").alias("n_records"), F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.stddev_pop("x").alias("sd_level"),
        F.min("x").alias("lo"), F.max("x").alias("hi"), F.median("x").alias("med"), F.sum("x").alias("total")))


_PAIRS = [("u", "v"), ("u", "w"), ("v", "w"), ("u", "x"), ("v", "x"), ("w", "x"), ("u", "u"), ("v", "v"), ("w", "w"), ("x", "x")]


@query(f"WITH {SIG} SELECT p, " + ", ".join(f"{r(f'covar_pop({a}, {b})')} AS cov_{a}_{b}" for a, b in _PAIRS) + " FROM sig GROUP BY p")
def stat_covariance_matrix(spark, sf_dir):
    """Pairwise-complete population covariances, all in one aggregation."""
    return rounded(signal(spark, sf_dir).groupBy("p").agg(*[stats.covariance(a, b).alias(f"cov_{a}_{b}") for a, b in _PAIRS]))


@query(f"WITH {SIG} SELECT p, {r('covar_pop(w, x) / (stddev_samp(w) * stddev_samp(x))')} AS c_wx, {r('covar_pop(u, w) / (stddev_samp(u) * stddev_samp(w))')} AS c_uw, {r('covar_pop(x, x) / (stddev_samp(x) * stddev_samp(x))')} AS c_xx FROM sig GROUP BY p")
def stat_correlation(spark, sf_dir):
    """Population covariance over sample deviations."""
    return rounded(signal(spark, sf_dir).groupBy("p").agg(stats.mixed_correlation("w", "x").alias("c_wx"), stats.mixed_correlation("u", "w").alias("c_uw"), stats.mixed_correlation("x", "x").alias("c_xx")))


_CENTRED = f"WITH {SIG}, m AS (SELECT p, avg(x) AS mean, count(x) AS n, stddev_pop(x) AS sp, stddev_samp(x) AS ss FROM sig GROUP BY p), d AS (SELECT sig.p, n, sp, ss, sum(pow(x - mean, 3)) AS m3, sum(pow(x - mean, 4)) AS m4 FROM sig JOIN m ON sig.p = m.p GROUP BY ALL)"


@query(_CENTRED + f" SELECT p, {r('m3 / ((n - 1) * pow(sp, 3))')} AS level_skew, {r('m4 / ((n - 1) * pow(sp, 4))')} AS level_kurt, {r('m3 / (n * pow(ss, 3))')} AS helper_skew, {r('m4 / (n * pow(ss, 4))')} AS helper_kurt FROM d")
def stat_moments(spark, sf_dir):
    """Both conventions of skewness and kurtosis."""
    return rounded(signal(spark, sf_dir).groupBy("p").agg(
        stats.level_skewness("x").alias("level_skew"), stats.level_kurtosis("x").alias("level_kurt"),
        stats.helper_skewness("x").alias("helper_skew"), stats.helper_kurtosis("x").alias("helper_kurt")))


def _sas5(q: str) -> str:
    k = f"CAST(floor(n * {q}::DOUBLE + 1e-9) AS BIGINT)"
    return f"CASE WHEN abs(n * {q}::DOUBLE - {k}) < 1e-9 AND {k} >= 1 THEN (v[{k}] + v[least(n, {k} + 1)]) / 2 ELSE v[greatest(1, least(n, {k} + 1))] END"


@query(f"WITH {SIG}, l AS (SELECT p, list(x ORDER BY x) FILTER (WHERE x IS NOT NULL) AS v, count(x) AS n FROM sig GROUP BY p) SELECT p, {r(_sas5('0.25'))} AS q1, {r(_sas5('0.5'))} AS q2, {r(_sas5('0.75'))} AS q3 FROM l")
def stat_quantiles(spark, sf_dir):
    """Quartiles by the empirical distribution with averaging."""
    return rounded(signal(spark, sf_dir).groupBy("p").agg(*[stats.quantile_sas5("x", q).alias(n) for n, q in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))]))


_WD = "(180.0::DOUBLE - degrees(atan2(v, u)) - 360.0::DOUBLE * floor((180.0::DOUBLE - degrees(atan2(v, u))) / 360.0::DOUBLE))"


@query(f"""
WITH {SIG}, d AS (SELECT p, radians({_WD}) AS a FROM sig), m AS (SELECT p, avg(sin(a)) AS s, avg(cos(a)) AS c FROM d GROUP BY p)
SELECT p, {r('CASE WHEN degrees(atan2(s, c)) < 0 THEN degrees(atan2(s, c)) + 360 ELSE degrees(atan2(s, c)) END')} AS wd,
{r('degrees(asin(sqrt(greatest(0.0::DOUBLE, 1 - (s * s + c * c)))) * (1 + 0.1547::DOUBLE * pow(sqrt(greatest(0.0::DOUBLE, 1 - (s * s + c * c))), 3)))')} AS wd_sd FROM m""")
def stat_wind_direction(spark, sf_dir):
    """Circular mean and deviation of wind directions."""
    d = signal(spark, sf_dir).select("p", stats.wind_direction("u", "v").alias("d"))
    return rounded(d.groupBy("p").agg(stats.circular_mean("d").alias("wd"), stats.circular_deviation("d").alias("wd_sd")))


@query(f"WITH {SIG} SELECT p, {r('max(sqrt(u * u + v * v + w * w))')} AS max_speed, {r('0.5::DOUBLE * (var_pop(u) + var_pop(v) + var_pop(w))')} AS tke, {r('pow(pow(covar_pop(u, w), 2) + pow(covar_pop(v, w), 2), 0.25::DOUBLE)')} AS ustar FROM sig GROUP BY p")
def stat_turbulence(spark, sf_dir):
    """Maximum speed, kinetic energy, friction velocity."""
    return rounded(signal(spark, sf_dir).groupBy("p").agg(
        F.max(F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v") + F.col("w") * F.col("w"))).alias("max_speed"),
        stats.turbulent_kinetic_energy("u", "v", "w").alias("tke"), stats.friction_velocity(F.covar_pop("u", "w"), F.covar_pop("v", "w")).alias("ustar")))


@query(f"""
SELECT l_returnflag, l_linestatus, count(*) AS n, {r('avg(l_quantity)')} AS mean_q, {r('covar_pop(l_quantity, l_extendedprice)')} AS cov_qp,
{r('stddev_samp(l_discount)')} AS sd_d, {r('max(l_extendedprice)')} AS hi FROM lineitem GROUP BY ALL""")
def stat_volume(spark, sf_dir):
    """The same statistics over the largest table."""
    return rounded(table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.avg("l_quantity").alias("mean_q"), stats.covariance("l_quantity", "l_extendedprice").alias("cov_qp"), F.stddev_samp("l_discount").alias("sd_d"), F.max("l_extendedprice").alias("hi")))


_LAGS = range(-5, 6)


@query(f"WITH {SIG}, l AS (SELECT p, w, " + ", ".join(f"lead(x, {k}) OVER s AS l{i}" if k > 0 else f"lag(x, {-k}) OVER s AS l{i}" if k < 0 else f"x AS l{i}" for i, k in enumerate(_LAGS)) + " FROM sig WINDOW s AS (PARTITION BY p ORDER BY rec)), c AS (" + " UNION ALL ".join(f"SELECT p, CAST({k} AS BIGINT) AS lag, covar_pop(w, l{i}) AS cov FROM l GROUP BY p" for i, k in enumerate(_LAGS)) + f") SELECT p, lag, {r('cov')} AS cov FROM c")
def stat_lagged_covariance(spark, sf_dir):
    """Covariances at lags of -5 to 5 records."""
    return rounded(transform.lag_table(signal(spark, sf_dir), "p", "w", "x", _LAGS))


@query(f"WITH {SIG} SELECT p, rec, CASE WHEN x BETWEEN 5 AND 300 THEN x END AS x, CASE WHEN u BETWEEN -8 AND 8 THEN u END AS u FROM sig")
def mask_limits(spark, sf_dir):
    """Cells beyond absolute limits become null; rows stay."""
    return masks.limits_mask(signal(spark, sf_dir), {"x": (5.0, 300.0), "u": (-8.0, 8.0)}).select("p", "rec", "x", "u")


@query(f"WITH {SIG} SELECT p, count(*) FILTER (WHERE NOT x BETWEEN 5 AND 300) AS n_x, CASE WHEN count(*) FILTER (WHERE NOT x BETWEEN 5 AND 300) > 0 THEN 1 ELSE 0 END AS flag_x, count(*) FILTER (WHERE NOT u BETWEEN -9 AND 9) AS n_u, CASE WHEN count(*) FILTER (WHERE NOT u BETWEEN -9 AND 9) > 0 THEN 1 ELSE 0 END AS flag_u FROM sig GROUP BY p")
def mask_limit_counts(spark, sf_dir):
    """Values beyond limits and their flags by period."""
    return masks.absolute_limits(signal(spark, sf_dir), "p", {"x": (5.0, 300.0), "u": (-9.0, 9.0)})


@query(f"WITH {SIG} SELECT p, rec, CASE WHEN NOT coalesce(event_id % 7 > 5 OR event_id % 11 < 1, false) THEN x END AS x, CASE WHEN NOT coalesce(event_id % 7 > 5 OR event_id % 11 < 1, false) THEN w END AS w FROM sig")
def mask_flags(spark, sf_dir):
    """Records whose flag columns pass their thresholds become null."""
    s = signal(spark, sf_dir).withColumn("f1", F.col("event_id") % 7).withColumn("f2", F.col("event_id") % 11)
    return masks.flag_mask(s, {"f1": (">", 5), "f2": ("<", 1)}, ["x", "w"]).select("p", "rec", "x", "w")


@query(f"WITH {SIG} SELECT p, rec, CASE WHEN (event_id & 9) = 0 THEN x END AS x FROM sig")
def mask_diagnostic_bits(spark, sf_dir):
    """Values whose diagnostic has bit 0 or 3 set become null."""
    return masks.diagnostic_mask(signal(spark, sf_dir), "event_id", 9, ["x"]).select("p", "rec", "x")


@query(f"WITH {SIG} SELECT p, rec, CASE WHEN NOT (({_WD} > 30 AND {_WD} < 90) OR ({_WD} > 200 AND {_WD} < 220)) THEN x END AS x FROM sig")
def mask_sectors(spark, sf_dir):
    """Records from excluded wind sectors become null."""
    return masks.sector_mask(signal(spark, sf_dir), stats.wind_direction("u", "v"), [(30, 90), (200, 220)], ["x"]).select("p", "rec", "x")


@query(f"WITH {SIG}, n AS (SELECT *, (count(*) OVER (PARTITION BY p) - count(x) OVER (PARTITION BY p)) * 100.0::DOUBLE / count(*) OVER (PARTITION BY p) AS lack FROM sig) SELECT p, rec, CASE WHEN lack <= 20 THEN x END AS x FROM n")
def mask_corrupted(spark, sf_dir):
    """A variable with too many missing values is dropped for its period."""
    return masks.corrupted_variables(signal(spark, sf_dir), "p", ["x"], None, 20.0).select("p", "rec", "x")


@query(f"""
WITH {SIG}, i AS (SELECT *, CASE WHEN x IS NOT NULL THEN CAST(count(x) OVER (PARTITION BY p ORDER BY rec) AS DOUBLE) END AS i FROM sig),
t AS (SELECT *, count(x) OVER q AS n, sum(i) OVER q AS sx, sum(x) OVER q AS sy, sum(i * x) OVER q AS sxy, sum(i * i) OVER q AS sxx FROM i WINDOW q AS (PARTITION BY p)),
l AS (SELECT p, x - (sy / n + CASE WHEN sxx - sx * sx / n > 0 THEN (sxy - sx * sy / n) / (sxx - sx * sx / n) ELSE 0.0::DOUBLE END * (CAST(rec AS DOUBLE) - sx / n)) AS x FROM t),
m AS (SELECT p, avg(x) AS mean, count(x) AS n, stddev_samp(x) AS ss FROM l GROUP BY p),
d AS (SELECT l.p, sum(pow(x - mean, 3)) / (max(n) * pow(max(ss), 3)) AS s, sum(pow(x - mean, 4)) / (max(n) * pow(max(ss), 4)) AS k FROM l JOIN m ON l.p = m.p GROUP BY l.p)
SELECT p, {r('s')} AS skew_x, {r('k')} AS kurt_x, CASE WHEN s <= -2 OR s >= 2 OR k <= 1 OR k >= 8 THEN 2 WHEN s <= -1 OR s >= 1 OR k <= 2 OR k >= 5 THEN 1 ELSE 0 END AS flag_x FROM d""")
def qc_higher_moments(spark, sf_dir):
    """Flags by skewness and kurtosis about the linear trend."""
    return rounded(quality.higher_moments(signal(spark, sf_dir), "p", ["x"]))


@query(f"""
WITH {SIG}, k AS (SELECT *, count(*) OVER (PARTITION BY p) // 6 AS size FROM sig), c AS (SELECT p, (rec - 1) // nullif(size, 0) AS part, covar_pop(w, x) AS cov FROM k WHERE size > 0 AND (rec - 1) // nullif(size, 0) < 6 GROUP BY ALL),
i AS (SELECT p, avg(cov) AS inner_cov FROM c GROUP BY p), f AS (SELECT p, covar_pop(w, x) AS cov FROM sig GROUP BY p)
SELECT f.p, {r('cov')} AS cov, CASE WHEN cov <> 0 THEN CAST(floor(abs((inner_cov - cov) / cov) * 100) AS BIGINT) END AS deviation FROM f LEFT JOIN i ON f.p = i.p""")
def qc_stationarity(spark, sf_dir):
    """Deviation of sub-period covariances from the whole one."""
    return rounded(quality.stationarity(signal(spark, sf_dir), "p", "w", "x", "rec"))


_PF = "CASE WHEN d <= 15 THEN 1 WHEN d <= 30 THEN 2 WHEN d <= 50 THEN 3 WHEN d <= 75 THEN 4 WHEN d <= 100 THEN 5 WHEN d <= 250 THEN 6 WHEN d <= 500 THEN 7 WHEN d <= 1000 THEN 8 ELSE 9 END"


@query(f"""
WITH g AS (SELECT event_id, {_PF.replace('d <=', '(event_id * 7) % 1500 <=')} AS s, {_PF.replace('d <=', '(event_id * 13) % 1200 <=')} AS t FROM events)
SELECT event_id, s, t, CASE WHEN s <= 2 AND t <= 2 THEN 0 WHEN s <= 5 AND t <= 5 THEN 1 ELSE 2 END AS flag3,
CASE WHEN greatest(s, t) <= 2 THEN 1 WHEN greatest(s, t) <= 4 THEN 2 WHEN greatest(s, t) <= 6 THEN 3 WHEN greatest(s, t) <= 8 THEN 4 ELSE 5 END AS flag5 FROM g""")
def qc_flags(spark, sf_dir):
    """Percent deviations to partial flags and overall flags."""
    e = table(spark, sf_dir, "events").select("event_id", quality.partial_flag((F.col("event_id") * 7) % 1500).alias("s"), quality.partial_flag((F.col("event_id") * 13) % 1200).alias("t"))
    return e.select("event_id", "s", "t", quality.overall_flag_0_2(F.col("s"), F.col("t")).alias("flag3"), quality.overall_flag_1_5(F.col("s"), F.col("t")).alias("flag5"))


@query(f"""
WITH {SIG}, d AS (SELECT p, rec, x - lag(x) OVER (PARTITION BY p ORDER BY rec) AS d FROM sig),
s AS (SELECT p, rec, d, CASE WHEN d <> 0 THEN sign(d) END AS g FROM d),
t AS (SELECT p, d, g, last_value(g IGNORE NULLS) OVER (PARTITION BY p ORDER BY rec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM s),
m AS (SELECT p, avg(d) AS mean, count(d) AS n, stddev_samp(d) AS ss FROM t GROUP BY p)
SELECT t.p, {r('sum(pow(d - mean, 4)) / (max(n) * pow(max(ss), 4))')} AS kid, CAST(coalesce(sum(CASE WHEN g IS NOT NULL AND b IS NOT NULL THEN CASE WHEN g <> b THEN 1 ELSE 0 END END), 0) AS BIGINT) AS zero_crossings FROM t JOIN m ON t.p = m.p GROUP BY t.p""")
def qc_difference_kurtosis(spark, sf_dir):
    """Kurtosis and sign changes of first differences."""
    return rounded(quality.difference_kurtosis(signal(spark, sf_dir), "p", "x", "rec"))


@query(f"""
WITH {SIG}, k AS (SELECT p, x, count(x) OVER (PARTITION BY p ORDER BY rec) AS k FROM sig),
g AS (SELECT p, k, count(*) AS n FROM k WHERE x IS NULL GROUP BY ALL)
SELECT s.p, coalesce(max(g.n), 0) / 10.0::DOUBLE AS longest_gap FROM (SELECT DISTINCT p FROM sig) s LEFT JOIN g ON s.p = g.p GROUP BY s.p""")
def qc_longest_gap(spark, sf_dir):
    """Longest run of missing values."""
    return quality.longest_gap(signal(spark, sf_dir), "p", "x", "rec", 10.0)


@query(f"""
WITH {SIG}, a AS (SELECT p, degrees(atan2(w, sqrt(u * u + v * v))) AS a FROM sig)
SELECT p, {r('100.0::DOUBLE * count(*) FILTER (WHERE NOT a BETWEEN -10 AND 10) / count(a)')} AS outside_percent FROM a GROUP BY p""")
def qc_attack_angle(spark, sf_dir):
    """Share of extreme angles of attack."""
    return rounded(quality.attack_angles(signal(spark, sf_dir), "p", -10.0, 10.0))


@query(f"""
WITH {SIG}, m AS (SELECT p, regr_slope(u, rec) * (max(rec) - min(rec)) AS du, regr_slope(v, rec) * (max(rec) - min(rec)) AS dv, avg(u) AS mu, avg(v) AS mv FROM sig GROUP BY p),
y AS (SELECT *, atan2(mv, mu) AS yaw, mu * cos(atan2(mv, mu)) + mv * sin(atan2(mv, mu)) AS sp FROM m),
k AS (SELECT p, abs((du * cos(yaw) + dv * sin(yaw)) / sp) AS a, abs((dv * cos(yaw) - du * sin(yaw)) / sp) AS c, abs(sqrt(pow(du * cos(yaw) + dv * sin(yaw), 2) + pow(dv * cos(yaw) - du * sin(yaw), 2)) / sp) AS b FROM y WHERE sp > 0)
SELECT m.p, {r('a')} AS along, {r('c')} AS across, {r('b')} AS non_steadiness, CASE WHEN a >= 0.5 OR c >= 0.5 OR b >= 0.5 THEN 1 ELSE 0 END AS flag FROM m LEFT JOIN k ON m.p = k.p""")
def qc_non_steady_wind(spark, sf_dir):
    """Trend of the wind over its mean, along, across and both."""
    return rounded(quality.non_steady_wind(signal(spark, sf_dir), "p", "rec"))


@query(f"""
WITH {SIG}, b AS (SELECT p, rec AS a, count(*) OVER (PARTITION BY p) AS n FROM sig),
k AS (SELECT p, a FROM b WHERE (a - 1) % 10 = 0 AND a + 59 <= n),
h AS (SELECT k.p, k.a, avg(u) FILTER (WHERE rec < a + 30) - avg(u) FILTER (WHERE rec >= a + 30) AS m,
(var_samp(u) FILTER (WHERE rec < a + 30) - var_samp(u) FILTER (WHERE rec >= a + 30)) / nullif(var_samp(u), 0) AS v FROM k JOIN sig ON sig.p = k.p AND rec BETWEEN a AND a + 59 GROUP BY ALL),
x AS (SELECT p, max(m) AS m, max(v) AS v FROM h GROUP BY p)
SELECT s.p, {r('m')} AS max_mean_jump, {r('v')} AS max_variance_jump, CASE WHEN m > 4 OR v > 3 THEN 2 WHEN m > 2.7 OR v > 2 THEN 1 ELSE 0 END AS flag FROM (SELECT DISTINCT p FROM sig) s LEFT JOIN x ON s.p = x.p""")
def qc_discontinuities(spark, sf_dir):
    """Largest differences of mean and variance between the halves of moving windows."""
    return rounded(quality.discontinuities(signal(spark, sf_dir), "p", "u", "rec", 60, 10))


@query(f"""
WITH {SIG}, l AS (SELECT a.p, k.lag, covar_samp(a.w, b.x) AS cov FROM sig a CROSS JOIN (SELECT unnest(range(-5, 6)) AS lag) k JOIN sig b ON a.p = b.p AND b.rec = a.rec + k.lag GROUP BY ALL),
m AS (SELECT p, arg_max(lag, round(abs(cov), 9) - lag * 1e-12) AS lag, arg_max(cov, round(abs(cov), 9) - lag * 1e-12) AS mc, max(CASE WHEN lag = 0 THEN cov END) AS dc FROM l GROUP BY p)
SELECT p, lag, {r('mc')} AS max_cov, {r('dc')} AS default_cov, {r('(mc - dc) * 100 / nullif(dc, 0)')} AS excess_percent,
CASE WHEN (mc - dc) * 100 / nullif(dc, 0) >= 20 THEN 2 WHEN (mc - dc) * 100 / nullif(dc, 0) >= 10 THEN 1 ELSE 0 END AS flag FROM m""")
def qc_lag_test(spark, sf_dir):
    """The best lag's covariance against the default lag's."""
    return rounded(quality.lag_test(transform.lag_table(signal(spark, sf_dir), "p", "w", "x", range(-5, 6), sample=True), "p", 0))


@query(f"""
WITH {SIG}, d AS (SELECT p, rec, w, x, CASE WHEN lag(w) OVER q IS NULL OR NOT abs(w - lag(w) OVER q) < 1e-8 THEN w END AS w2, CASE WHEN lag(x) OVER q IS NULL OR NOT abs(x - lag(x) OVER q) < 1e-8 THEN x END AS x2 FROM sig WINDOW q AS (PARTITION BY p ORDER BY rec)),
l AS (SELECT a.p, k.lag, covar_pop(a.w, b.x) AS c, covar_pop(a.w2, b.x2) AS c2 FROM d a CROSS JOIN (SELECT unnest(range(-5, 6)) AS lag) k JOIN d b ON a.p = b.p AND b.rec = a.rec + k.lag GROUP BY ALL)
SELECT p, {r('pow(corr(c, c2), 2)')} AS r2 FROM l GROUP BY p""")
def qc_repeated_values(spark, sf_dir):
    """How much repeated values change the lagged covariances."""
    return rounded(quality.repeated_value_test(signal(spark, sf_dir), "p", "w", "x", "rec", range(-5, 6)))


@query(f"""
WITH {SIG}, s AS (SELECT p, count(x) AS nx, count(*) FILTER (WHERE abs(u) > 9) AS nu, count(*) FILTER (WHERE abs(w) > 2) AS nw FROM sig GROUP BY p)
SELECT p, 9000 + (CASE WHEN nu > 0 THEN 1 ELSE 0 END) * 100 + 90 + (CASE WHEN nw > 0 THEN 1 ELSE 0 END) AS packed, CASE WHEN nu > 0 THEN 1 ELSE 0 END AS first, CAST(NULL AS INTEGER) AS second FROM s""")
def qc_packed_flags(spark, sf_dir):
    """Flags of several variables in one number, and back."""
    s = signal(spark, sf_dir).groupBy("p").agg(F.count_if(F.abs("u") > 9).alias("nu"), F.count_if(F.abs("w") > 2).alias("nw"))
    one = lambda c: F.when(F.col(c) > 0, 1).otherwise(0)
    s = s.select("p", quality.pack_flags([one("nu"), F.lit(None), one("nw")]).alias("packed"))
    return s.select("p", "packed", quality.unpack_flag(F.col("packed"), 1, 3).alias("first"), quality.unpack_flag(F.col("packed"), 2, 3).alias("second"))


@query(f"""
WITH {SIG}, c AS (SELECT p, count(*) AS n, count(x) AS nx FROM sig GROUP BY p), h AS (SELECT p, (nx // 2 + 1) * (nx // 2) // 2 AS k, nx FROM c),
d AS (SELECT a.p, abs(a.x - b.x) AS d, row_number() OVER (PARTITION BY a.p ORDER BY abs(a.x - b.x)) AS i FROM sig a JOIN sig b ON a.p = b.p AND a.rec < b.rec WHERE a.x IS NOT NULL AND b.x IS NOT NULL)
SELECT d.p, {r('d.d * 2.2219 * nx / (nx + CASE WHEN nx % 2 = 1 THEN 1.4 ELSE 3.8 END)')} AS qn FROM d JOIN h ON d.p = h.p AND d.i = h.k""")
def qc_robust_scale(spark, sf_dir):
    """Robust scale from pairwise distances."""
    return rounded(quality.robust_scale(signal(spark, sf_dir), "p", "x"))


@query(f"""
WITH {SIG}, n AS (SELECT p, w, x, count(*) OVER (PARTITION BY p) AS n, rec - 1 AS z FROM sig),
k AS (SELECT p, w, x, z // nullif(n // 6, 0) AS i, (z - (z // nullif(n // 6, 0)) * (n // 6)) // nullif((n // 6) // 6, 0) AS j FROM n WHERE (n // 6) // 6 > 0),
c AS (SELECT p, i, j, covar_pop(w, x) AS c FROM k WHERE i BETWEEN 0 AND 5 AND j BETWEEN 0 AND 5 GROUP BY ALL),
s AS (SELECT p, i, avg(c) AS m, coalesce(stddev_samp(c), 0) AS s FROM c GROUP BY ALL)
SELECT p, {r('sum(s) / 6 / sqrt(6.0::DOUBLE)')} AS uncertainty, {r('CASE WHEN sum(s) > 0 THEN stddev_samp(m) / (sum(s) / 6 / sqrt(6.0::DOUBLE)) END')} AS ratio FROM s GROUP BY p""")
def uncertainty_nested(spark, sf_dir):
    """Random error from nested sub-periods."""
    return rounded(uncertainty.mahrt(signal(spark, sf_dir), "p", "w", "x", "rec"))


@query(f"""
WITH {SIG}, k AS (SELECT unnest(range(-8, 9)) AS lag),
a AS (SELECT a.p, k.lag, covar_pop(a.w, b.w) AS ww, covar_pop(a.x, b.x) AS xx, covar_pop(a.w, b.x) AS wx FROM sig a CROSS JOIN k JOIN sig b ON a.p = b.p AND b.rec = a.rec + k.lag GROUP BY ALL),
t AS (SELECT f.p, f.lag, (f.ww * f.xx + f.wx * g.wx) * CASE WHEN f.lag = 0 THEN 1 ELSE 2 END AS t FROM a f JOIN a g ON f.p = g.p AND g.lag = -f.lag WHERE f.lag >= 0),
n AS (SELECT p, count(*) AS n FROM sig GROUP BY p)
SELECT t.p, {r('sqrt(abs(sum(t) / max(n)))')} AS uncertainty FROM t JOIN n ON t.p = n.p GROUP BY t.p""")
def uncertainty_lagged(spark, sf_dir):
    """Random error from lagged covariances."""
    return rounded(uncertainty.finkelstein_sims(signal(spark, sf_dir), "p", "w", "x", "rec", 8))


@query(f"""
WITH {SIG}, a AS (SELECT a.p, k.lag, covar_pop(a.w, b.x) AS c FROM sig a CROSS JOIN (SELECT unnest(range(0, 21)) AS lag) k JOIN sig b ON a.p = b.p AND b.rec = a.rec + k.lag GROUP BY ALL),
q AS (SELECT p, lag, c / first_value(c) OVER (PARTITION BY p ORDER BY lag) AS q FROM a), f AS (SELECT p, min(lag) FILTER (WHERE q <= 0.36787944117144233) AS cut FROM q GROUP BY p)
SELECT q.p, {r('sum(q) FILTER (WHERE cut IS NULL OR lag < cut) / 10.0')} AS its FROM q JOIN f ON q.p = f.p GROUP BY q.p""")
def uncertainty_integral_scale(spark, sf_dir):
    """Integral time scale up to the first crossing of 1/e."""
    return rounded(uncertainty.integral_scale(signal(spark, sf_dir), "p", "w", "x", "rec", 20, 10.0, 0.36787944117144233))


_BINNED = f"""
WITH {SIG}, n AS (SELECT p, rec, x, (count(*) OVER (PARTITION BY p) - 100) // 50 + 1 AS many FROM sig),
w AS (SELECT p, rec, x, many, k.win FROM n JOIN (SELECT unnest(range(0, 100000)) AS win) k ON k.win BETWEEN (rec - 1) // 50 - 1 AND (rec - 1) // 50 AND k.win < many),
s AS (SELECT *, min(x) OVER q AS lo, max(x) OVER q AS hi, avg(x) OVER q AS m, stddev_samp(x) OVER q AS sd FROM w WINDOW q AS (PARTITION BY p, win)),
a AS (SELECT *, CASE WHEN hi - lo < 7 * sd THEN lo ELSE m - 3.5 * sd END AS a, CASE WHEN hi - lo < 7 * sd THEN hi - lo ELSE 7 * sd END / 20 AS step FROM s),
b AS (SELECT p, rec, win, many, CASE WHEN floor((x - a) / nullif(step, 0)) BETWEEN 0 AND 19 THEN floor((x - a) / nullif(step, 0)) + 1 END AS bin FROM a),
d AS (SELECT *, CASE WHEN bin = last_value(bin IGNORE NULLS) OVER (PARTITION BY p, win ORDER BY rec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS dr FROM b),
g AS (SELECT p, win, bin, max(many) AS many, count(*) AS n, sum(dr) AS d FROM d WHERE bin IS NOT NULL GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY p, win ORDER BY bin) AS c FROM g),
e AS (SELECT p, win, coalesce(min(bin) FILTER (WHERE c > 10) - 1, 20) AS lo, coalesce(min(bin) FILTER (WHERE c >= 90) - 1, 18) AS hi FROM c GROUP BY ALL)"""


@query(f"""{_BINNED}
SELECT c.p, {r('100.0::DOUBLE * (20 - count(*) * 1.0::DOUBLE / max(many)) / 20')} AS empty_percent,
{r('100.0::DOUBLE * sum(CASE WHEN least(lo, hi + 1) > 0 AND hi >= least(lo, hi + 1) THEN d * (CASE WHEN bin <= lo THEN 1 ELSE 0 END + CASE WHEN bin >= hi THEN 1 ELSE 0 END) ELSE 0 END) / (100 * max(many))')} AS extreme_percent,
{r('100.0::DOUBLE * sum(CASE WHEN least(lo, hi + 1) > 0 AND hi >= least(lo, hi + 1) AND bin BETWEEN lo AND hi THEN d ELSE 0 END) / (100 * max(many))')} AS central_percent
FROM c JOIN e ON c.p = e.p AND c.win = e.win GROUP BY c.p""")
def qc_resolution_and_dropouts(spark, sf_dir):
    """Empty histogram bins, and values that stay in their bin."""
    return rounded(quality.resolution_and_dropouts(signal(spark, sf_dir), "p", "x", "rec", 100, 20))


@query()
def despike_median(spark, sf_dir):
    """Spikes by median deviations, replaced."""
    s = signal(spark, sf_dir).select("p", "rec", "x")
    return rounded(quality.despike(s, "p", ["x"], "rec", "median", factor=3.0))


@query()
def despike_moving(spark, sf_dir):
    """Spikes by a moving window, replaced."""
    s = signal(spark, sf_dir).select("p", "rec", "x")
    return rounded(quality.despike(s, "p", ["x"], "rec", "moving", window=60, step=10, factor=2.5))
