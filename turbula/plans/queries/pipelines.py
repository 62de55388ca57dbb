"""Queries of whole plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from turbula.plans import raw
from turbula.plans.config import Run, express
from turbula.plans.corrections import correct_fluxes, cutoffs_by_class
from turbula.operators import spectra
from turbula.plans.queries.base import SIG, query, r, rounded, signal, table
from turbula.streaming.online import period_statistics


def _records(spark, sf_dir):
    s = signal(spark, sf_dir)
    return s.select(F.col("p").alias("period"), "rec", "u", "v", "w", (290 + F.col("w") * 0.3 + F.col("u") * 0.05).alias("ts"), (16 + F.col("x") / 200).alias("co2"), (500 + F.col("v")).alias("h2o"))


@query()
def plan_raw(spark, sf_dir):
    """Raw records to fluxes with the default options."""
    return rounded(raw.fluxes_by_period(_records(spark, sf_dir), Run(max_missing_percent=40.0)))


@query()
def plan_express(spark, sf_dir):
    """The express preset with another footprint and uncertainty."""
    run = express(max_missing_percent=40.0, footprint="hsieh_00", uncertainty="mahrt_98", rotation="triple_rotation", despike="median")
    return rounded(raw.fluxes_by_period(_records(spark, sf_dir), run))


@query()
def plan_planar_fit(spark, sf_dir):
    """Planar fit, linear detrending, no lag."""
    return rounded(raw.fluxes_by_period(_records(spark, sf_dir), Run(max_missing_percent=40.0, rotation="planar_fit", detrend="ld", lag="none", high_frequency="massman_00")))


_RAW = "raw AS (SELECT p AS period, rec, u, v, w, 290 + w * 0.3::DOUBLE + u * 0.05::DOUBLE AS ts, 16 + x / 200 AS co2, 500 + v AS h2o FROM sig)"
_VARIABLES = ("u", "v", "w", "ts", "co2", "h2o")


def _level(source: str, number: int) -> str:
    return " UNION ALL ".join(
        f"SELECT period, {number} AS level, '{c}' AS variable, count({c}) AS n, {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS sd, {r(f'min({c})')} AS lowest, {r(f'max({c})')} AS highest, {r(f'covar_pop(w, {c})')} AS cov_w FROM {source} GROUP BY period"
        for c in _VARIABLES
    )


@query(f"""
WITH {SIG}, {_RAW}, two AS (SELECT * REPLACE (CASE WHEN count(co2) OVER q >= 0.6 * count(*) OVER q THEN co2 END AS co2) FROM raw WINDOW q AS (PARTITION BY period)),
m AS (SELECT *, atan2(avg(v) OVER q, avg(u) OVER q) AS yaw, atan2(avg(w) OVER q, sqrt(pow(avg(u) OVER q, 2) + pow(avg(v) OVER q, 2))) AS pitch FROM two WINDOW q AS (PARTITION BY period)),
four AS (SELECT period, rec, (u * cos(yaw) + v * sin(yaw)) * cos(pitch) + w * sin(pitch) AS u, v * cos(yaw) - u * sin(yaw) AS v, w * cos(pitch) - (u * cos(yaw) + v * sin(yaw)) * sin(pitch) AS w, ts, co2, h2o FROM m),
five AS (SELECT period, rec, u, v, w, ts, lead(co2, 2) OVER q AS co2, lead(h2o, 2) OVER q AS h2o FROM four WINDOW q AS (PARTITION BY period ORDER BY rec)),
six AS (SELECT period, {", ".join(f"{c} - avg({c}) OVER (PARTITION BY period) AS {c}" for c in _VARIABLES)} FROM five)
{" UNION ALL ".join(_level(s, i) for i, s in enumerate(("raw", "two", "two", "four", "five", "six"), 1))}""")
def plan_statistics(spark, sf_dir):
    """Statistics of every variable after each step of a run."""
    run = Run(max_missing_percent=40.0, lag="constant", default_lag=2)
    return rounded(raw.statistics_by_level(_records(spark, sf_dir), run).drop("skewness", "kurtosis"))


@query()
def plan_corrections(spark, sf_dir):
    """Spectra to cut-off frequencies to corrected fluxes."""
    s = signal(spark, sf_dir)
    long = spectra.cospectra(s.select("p", "rec", "x"), "p", "rec", [("x", "x")], 10.0)
    bins = spectra.binned(long, ["p"], 10 / 400, 5.0, 12).withColumnRenamed("p", "period")
    bins = bins.withColumn("density", 1 / (1 + F.pow(F.col("freq") / 0.8, 2.0)))
    essentials = s.groupBy(F.col("p").alias("period")).agg(F.avg("x").alias("flux"), (F.abs(F.avg("u")) + 1).alias("wind")).withColumn("class", F.col("period") % 3)
    cut = cutoffs_by_class(bins, essentials, "class", least=2)
    return rounded(correct_fluxes(essentials, cut, "class", "flux", "wind", 1.0, 0.5))


@query(f"""
WITH {SIG} SELECT CAST(floor(sec / 1800) * 1800 AS BIGINT) AS start, count(*) AS n_records, {r('avg(u)')} AS mean_u, {r('avg(w)')} AS mean_w, {r('avg(x)')} AS mean_x, {r('covar_pop(w, u)')} AS cov_wu, {r('covar_pop(w, x)')} AS cov_wx FROM sig GROUP BY 1""")
def stream_period_statistics(spark, sf_dir):
    """The online mode's aggregation, here over the table."""
    s = signal(spark, sf_dir).withColumn("ts", F.timestamp_seconds("sec"))
    out = period_statistics(s, "ts", 30)
    return rounded(out.select(F.unix_timestamp("period_start").alias("start"), *[c for c in out.columns if not c.startswith("period_")]))


@query("""
SELECT p_partkey, p_type, CASE WHEN p_type LIKE '%BRASS%' THEN 'open' ELSE 'closed' END AS path_type, upper(p_name) AS label,
length(p_name) - length(replace(p_name, ' ', '')) AS n_blanks FROM part""")
def text_functions(spark, sf_dir):
    """Upper case, counted characters and classification by name."""
    p = table(spark, sf_dir, "part")
    name = F.col("p_name")
    return p.select("p_partkey", "p_type", F.when(F.col("p_type").contains("BRASS"), "open").otherwise("closed").alias("path_type"), F.upper(name).alias("label"), (F.length(name) - F.length(F.replace(name, F.lit(" "), F.lit("")))).cast("long").alias("n_blanks"))
