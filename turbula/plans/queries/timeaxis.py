"""Queries on the time axis: windows, spines, gaps, joins on time."""

from __future__ import annotations

from pyspark.sql import functions as F

from turbula.functions import stats
from turbula.operators import periods
from turbula.plans.queries.base import SIG, query, r, r6, rounded, signal, table


@query(f"""
WITH {SIG}, hours AS (SELECT CAST(floor(sec / 1800) * 1800 AS BIGINT) AS period, x, w FROM sig),
res AS (SELECT period, count(*) AS n_records, count(x) AS n_valid, avg(x) AS mean_x, covar_pop(w, x) AS flux FROM hours GROUP BY period),
spine AS (SELECT unnest(generate_series((SELECT min(period) FROM hours), (SELECT max(period) FROM hours), 1800)) AS period)
SELECT CAST(spine.period AS BIGINT) AS period, n_records, n_valid, {r('mean_x')} AS mean_x, {r('flux')} AS flux
FROM spine LEFT JOIN res ON spine.period = res.period""")
def win_flux_spine(spark, sf_dir):
    """Kinematic flux per half hour, every period present."""
    half = signal(spark, sf_dir).withColumn("period", (F.floor(F.col("sec") / 1800) * 1800).cast("long"))
    result = half.groupBy("period").agg(F.count("*").alias("n_records"), F.count("x").alias("n_valid"), F.avg("x").alias("mean_x"), stats.covariance("w", "x").alias("flux"))
    bounds = half.agg(F.min("period").alias("a"), F.max("period").alias("b"))
    return rounded(periods.fill_gaps(periods.spine(bounds, "a", "b", 1800), result))


@query("""
WITH f AS (SELECT DISTINCT CAST(floor(epoch(ts) / 600) * 600 AS BIGINT) AS start FROM events),
g AS (SELECT start, start - lag(start) OVER (ORDER BY start) AS gap FROM f)
SELECT start, gap, coalesce(gap > 600, true) AS new_run, CAST(sum(CASE WHEN coalesce(gap > 600, true) THEN 1 ELSE 0 END) OVER (ORDER BY start) AS BIGINT) AS run FROM g""")
def win_contiguity(spark, sf_dir):
    """Runs of files, ten minutes each, that follow one another."""
    files = table(spark, sf_dir, "events").select((F.floor(periods.seconds("ts") / 600) * 600).cast("long").alias("start")).distinct()
    return periods.contiguity(files, "start", 600)


@query("""
WITH e AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS sec, user_id % 10 AS site FROM events),
d AS (SELECT site, sec - lag(sec) OVER (PARTITION BY site ORDER BY sec) AS step FROM e),
c AS (SELECT site, step, count(*) AS n FROM d WHERE step IS NOT NULL GROUP BY ALL)
SELECT site, step, n FROM c QUALIFY row_number() OVER (PARTITION BY site ORDER BY n DESC, step) = 1""")
def win_common_step(spark, sf_dir):
    """Most frequent time step of each site."""
    e = table(spark, sf_dir, "events").select(periods.seconds("ts").alias("sec"), (F.col("user_id") % 10).alias("site"))
    return periods.common_step(e, "sec", ("site",)).select("site", "step", "n")


@query("""
SELECT event_id, CAST(year(ts) AS INT) AS y, CAST(dayofyear(ts) AS INT) AS doy, CAST(hour(ts) * 2 + minute(ts) // 30 + 1 + (dayofyear(ts) - 1) * 48 AS BIGINT) AS half_hour,
round(dayofyear(ts) + (hour(ts) * 60 + minute(ts)) / 1440.0::DOUBLE, 6) AS decimal_doy FROM events""")
def time_parts(spark, sf_dir):
    """Day of year, half-hour number and decimal day."""
    ts, doy = F.col("ts"), F.dayofyear("ts")
    minutes = F.hour(ts) * 60 + F.minute(ts)
    return table(spark, sf_dir, "events").select("event_id", F.year(ts).alias("y"), doy.alias("doy"), ((doy - 1) * 48 + F.floor(minutes / 30) + 1).cast("long").alias("half_hour"), F.round(doy + minutes / 1440.0, 6).alias("decimal_doy"))


@query("""
WITH pts AS (SELECT event_id, user_id % 7 AS site, CAST(floor(epoch(ts)) AS BIGINT) AS sec, ts FROM events WHERE event_type = 'purchase'),
meta AS (SELECT user_id % 7 AS site, CAST(floor(epoch(ts)) AS BIGINT) AS sec, value AS height FROM events WHERE event_type = 'signup')
SELECT p.event_id, p.site, p.sec, round(m.height + 3.1e-8::DOUBLE, 6) + 0.0::DOUBLE AS height FROM pts p ASOF LEFT JOIN
(SELECT site, sec, max(height) AS height FROM meta GROUP BY ALL) m ON p.site = m.site AND p.sec >= m.sec""")
def join_as_of(spark, sf_dir):
    """Each record with the last metadata row at or before it."""
    e = table(spark, sf_dir, "events").withColumn("sec", periods.seconds("ts")).withColumn("site", F.col("user_id") % 7)
    points = e.where("event_type = 'purchase'").select("event_id", "site", "sec")
    meta = e.where("event_type = 'signup'").select("site", F.col("sec").alias("msec"), F.col("value").alias("height"))
    return rounded(periods.as_of_join(points, meta, "sec", "msec", ["site"], ["height"]))


@query("""
WITH e AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec, event_type, value FROM events),
iv AS (SELECT event_id AS file_id, sec AS a, sec + 900 AS b FROM e WHERE event_type = 'purchase')
SELECT file_id, a, count(e.sec) AS n, round(sum(e.value), 6) AS total FROM iv JOIN e ON e.sec >= iv.a AND e.sec < iv.b AND e.event_type = 'view' GROUP BY file_id, a""")
def join_range(spark, sf_dir):
    """Records that fall into each interval, aggregated."""
    e = table(spark, sf_dir, "events").withColumn("sec", periods.seconds("ts"))
    intervals = e.where("event_type = 'purchase'").select(F.col("event_id").alias("file_id"), F.col("sec").alias("a"), (F.col("sec") + 900).alias("b"))
    points = e.where("event_type = 'view'").select("sec", "value")
    inside = periods.range_join(intervals, points, "sec", "a", "b", 900)
    return inside.groupBy("file_id", "a").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("""
WITH e AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec, event_type FROM events),
p AS (SELECT event_id, sec FROM e WHERE event_type = 'click'), s AS (SELECT DISTINCT sec AS t FROM e WHERE event_type = 'error')
SELECT p.event_id, p.sec, s.t AS matched FROM p JOIN s ON abs(s.t - p.sec) <= 600
QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY abs(s.t - p.sec), s.t) = 1""")
def join_tolerance(spark, sf_dir):
    """Nearest time of another series within ten minutes."""
    e = table(spark, sf_dir, "events").withColumn("sec", periods.seconds("ts"))
    points = e.where("event_type = 'click'").select("event_id", "sec")
    series = e.where("event_type = 'error'").select(F.col("sec").alias("t")).distinct()
    return periods.tolerance_match(points, series, "sec", "t", 600)


@query("""
WITH f AS (SELECT event_id AS file_id, CAST(floor(epoch(ts)) AS BIGINT) AS a FROM events WHERE event_type = 'purchase'),
p AS (SELECT file_id, a, unnest(generate_series(a // 3600, (a + 1799) // 3600)) * 3600 AS period FROM f)
SELECT file_id, CAST(period AS BIGINT) AS period, CAST(greatest(1, round((period - a) * 10.0::DOUBLE) + 1) AS BIGINT) AS first_record,
CAST(least(18000, round((period + 3600 - a) * 10.0::DOUBLE)) AS BIGINT) AS last_record FROM p""")
def join_file_portions(spark, sf_dir):
    """First and last record of each half-hour file of 10 Hz within each hour that it touches."""
    f = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("file_id"), periods.seconds("ts").alias("a"))
    spread = f.withColumn("period", F.explode(F.sequence(F.floor(F.col("a") / 3600), F.floor((F.col("a") + 1799) / 3600)))).withColumn("period", F.col("period") * 3600)
    first, last = periods.record_range(F.col("a"), F.col("period"), F.col("period") + 3600, 10.0)
    return spread.select("file_id", F.col("period").cast("long").alias("period"), first.alias("first_record"), F.least(F.lit(18000).cast("long"), last).alias("last_record"))


@query("""
SELECT c_custkey, c_nationkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def join_skipped_periods(spark, sf_dir):
    """Keys without any record."""
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("""
SELECT c_custkey, c_nationkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)""")
def join_relevant_periods(spark, sf_dir):
    """Keys with a relevant record."""
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 200000")
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query(f"""
WITH o AS (SELECT o_custkey, CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT) AS day, o_totalprice FROM orders),
b AS (SELECT o_custkey, day // 30 AS month, sum(o_totalprice) AS total FROM o GROUP BY ALL)
SELECT month, count(*) AS n_keys, {r('sum(total)')} AS total, {r('max(total)')} AS top FROM b GROUP BY month""")
def win_two_level(spark, sf_dir):
    """Aggregation by key and period, then by period."""
    day = F.floor(periods.seconds("o_orderdate") / 86400)
    by = table(spark, sf_dir, "orders").groupBy("o_custkey", F.floor(day / 30).cast("long").alias("month")).agg(F.sum("o_totalprice").alias("total"))
    return by.groupBy("month").agg(F.count("*").alias("n_keys"), r6(F.sum("total")).alias("total"), r6(F.max("total")).alias("top"))
