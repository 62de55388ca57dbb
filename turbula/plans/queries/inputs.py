"""Queries of what comes before a run: units, dynamic metadata, sonic frames, substitutes."""

from __future__ import annotations

from pyspark.sql import functions as F

from turbula.operators import masks, periods, transform
from turbula.plans.queries.base import SIG, query, r, r6, rounded, signal, table
from turbula.sources import biomet, metadata


@query(f"""
SELECT event_id, {r('(value - 32) * 5 / 9.0::DOUBLE + 273.15::DOUBLE')} AS kelvin, {r('value * 133.32::DOUBLE')} AS pascal, {r('value * 0.01::DOUBLE')} AS metres,
{r('value * 1000')} AS co2, {r('value / 1e6::DOUBLE')} AS h2o, {r('value * 1000')} AS ch4, {r('value - 273.15::DOUBLE')} AS celsius, {r('value / 100')} AS vpd, value AS same FROM events""")
def biomet_units(spark, sf_dir):
    """Slow variables to standard units and to those of network files."""
    v = F.col("value")
    made = {
        "kelvin": biomet.to_standard(v, "TEMPERATURE", "F"), "pascal": biomet.to_standard(v, "PRESSURE", "torr"), "metres": biomet.to_standard(v, "LENGTH", "CM"),
        "co2": biomet.to_standard(v, "CONCENTRATION", "mmol/mol", "CO2"), "h2o": biomet.to_standard(v, "CONCENTRATION", "PPB", "H2O"), "ch4": biomet.to_standard(v, "CONCENTRATION", "UMOLMOL-1", "CH4"),
        "celsius": biomet.to_network(v, "TEMPERATURE"), "vpd": biomet.to_network(v, "PRESSURE", "VPD"),
    }
    return table(spark, sf_dir, "events").select("event_id", *[r6(c).alias(n) for n, c in made.items()], biomet.to_standard(v, "FLOW", "?").alias("same"))


@query(f"""
WITH e AS (SELECT event_id, user_id % 7 AS site, CAST(floor(epoch(ts)) AS BIGINT) AS sec, event_type AS kind, value FROM events),
m AS (SELECT site, sec, max(CASE WHEN kind = 'signup' THEN value / 100.0::DOUBLE END) AS canopy FROM e WHERE kind IN ('signup', 'error') GROUP BY ALL),
j AS (SELECT p.event_id, p.site, p.sec, m.canopy FROM e p ASOF LEFT JOIN m ON p.site = m.site AND p.sec >= m.sec WHERE p.kind = 'purchase')
SELECT event_id, {r('coalesce(canopy, 0.5::DOUBLE)')} AS canopy_height, {r('coalesce(canopy * 0.67::DOUBLE, 0.3::DOUBLE)')} AS displacement_height,
{r('coalesce(canopy * 0.15::DOUBLE, 0.08::DOUBLE)')} AS roughness_length FROM j""")
def join_dynamic_metadata(spark, sf_dir):
    """The last metadata at or before each period's end, over those of the site."""
    e = table(spark, sf_dir, "events").withColumns({"sec": periods.seconds("ts"), "site": F.col("user_id") % 7})
    heights = e.where("event_type in ('signup', 'error')").groupBy("site", F.col("sec").alias("valid_from")).agg(F.max(F.when(F.col("event_type") == "signup", F.col("value") / 100)).alias("canopy_height"))
    points = e.where("event_type = 'purchase'").select("event_id", "site", "sec")
    known = metadata.SiteInfo(canopy_height=0.5, displacement_height=0.3, roughness_length=0.08)
    out = metadata.with_dynamic(points, metadata.with_canopy(heights), "sec", ["site"], known)
    return rounded(out.select("event_id", "canopy_height", "displacement_height", "roughness_length"))


@query(f"""
WITH {SIG}, q AS (SELECT p, rec, x, v, w, u, CASE WHEN x IS NOT NULL THEN v * cos(radians(x)) - 0.1::DOUBLE ELSE u END AS pu, CASE WHEN x IS NOT NULL THEN -v * sin(radians(x)) ELSE v END AS pv FROM sig),
a AS (SELECT *, (2 * u - v - w) / 2.1213::DOUBLE AS au, (w - v) / 1.2247::DOUBLE AS av FROM q)
SELECT p, rec, {r('CASE WHEN x IS NOT NULL THEN pu END')} AS polar_u, {r('CASE WHEN x IS NOT NULL THEN -pv END')} AS polar_v,
{r('au * cos(radians(30)) - av * sin(radians(30))')} AS axis_u, {r('au * sin(radians(30)) + av * cos(radians(30))')} AS axis_v, {r('(u + v + w) / 2.1213::DOUBLE')} AS axis_w FROM a""")
def tf_sonic_coordinates(spark, sf_dir):
    """Winds given as direction and speed, and along the sound paths, in one frame."""
    s = signal(spark, sf_dir)
    polar = transform.sonic_coordinates(s.withColumn("u", F.col("x")), "usa1_fast", "polar_w", offsets=(0.1, 0.0, 0.0))
    polar = polar.select("p", "rec", F.col("u").alias("polar_u"), F.when(F.col("x").isNotNull(), F.col("v")).alias("polar_v"))
    axis = transform.sonic_coordinates(s, "hs_50", "axis").select("p", "rec", *[F.col(c).alias(f"axis_{c}") for c in "uvw"])
    return rounded(polar.join(axis, ["p", "rec"]))


@query(f"""
WITH {SIG}, n AS (SELECT p, rec, least(10, rec - 1, count(*) OVER (PARTITION BY p) - rec) AS k FROM sig)
SELECT n.p, n.rec, {r('avg(s.x)')} AS x_c FROM n JOIN sig s ON s.p = n.p AND s.rec BETWEEN n.rec - n.k AND n.rec + n.k GROUP BY n.p, n.rec""")
def tf_centred_average(spark, sf_dir):
    """Means over windows that shrink near the ends."""
    return rounded(transform.centred_average(signal(spark, sf_dir).select("p", "rec", "x"), "p", ["x"], 20).select("p", "rec", "x_c"))


@query(f"""
WITH {SIG}, d AS (SELECT p, rec, x, avg(x) OVER (PARTITION BY p) AS m, stddev_pop(x) OVER (PARTITION BY p) AS s FROM sig)
SELECT p, rec, CASE WHEN abs(x - m) < 1.5 * s THEN x END AS x FROM d""")
def mask_deviations(spark, sf_dir):
    """Values far from their mean become null."""
    return masks.beyond_deviations(signal(spark, sf_dir), ["p"], ["x"], 1.5).select("p", "rec", "x")


@query(f"""
WITH {SIG}, t AS (SELECT p, rec, u + 290 AS ts, w + 250 + 100 * (p % 3) AS a, CASE WHEN p % 2 = 0 THEN v + 280 END AS b, x FROM sig),
m AS (SELECT *, avg(a) OVER (PARTITION BY p) AS ma, avg(b) OVER (PARTITION BY p) AS mb, avg(x) OVER (PARTITION BY p) AS mx, avg(a) OVER (PARTITION BY p) AS mr FROM t)
SELECT p, rec, {r('CASE WHEN mb > 220 AND mb < 340 THEN b WHEN ma > 220 AND ma < 340 THEN a ELSE ts END')} AS ts, {r('x * mr / mx / 1000')} AS gas FROM m""")
def tf_substitutes(spark, sf_dir):
    """Sonic temperature by another sensor's where that is plausible, and a gas scaled to a reference."""
    s = signal(spark, sf_dir).select("p", "rec", (F.col("u") + 290).alias("ts"), (F.col("w") + 250 + 100 * (F.col("p") % 3)).alias("a"), F.when(F.col("p") % 2 == 0, F.col("v") + 280).alias("b"), F.col("x").alias("gas"))
    out = transform.scaled_to_reference(transform.substitute_temperature(s, "p", "ts", ["a", "b"]), "p", "gas", "a")
    return rounded(out.select("p", "rec", "ts", "gas"))
