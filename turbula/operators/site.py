"""What depends on a site and its instruments: day and night, sensor separation, calibration drift."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def half_hour_number(ts: Column) -> Column:
    """Number, from 1, of the half hour of the year that begins at or before a time."""
    return (F.dayofyear(ts) - 1) * 48 + F.hour(ts) * 2 + F.floor(F.minute(ts) / 30) + 1


def potential_radiation(half_hour: Column, latitude: float) -> Column:
    """Radiation, W/m2, on a level surface above the atmosphere in a numbered half hour of the year."""
    day = F.floor(half_hour / 48) + 1
    theta = 2 * math.pi * (day - 1) / 365
    c1, s1, c2, s2, c3, s3 = F.cos(theta), F.sin(theta), F.cos(2 * theta), F.sin(2 * theta), F.cos(3 * theta), F.sin(3 * theta)
    # The published series for declination and distance, and the solar constant.
    declination = 0.006918 - 0.399912 * c1 + 0.070257 * s1 - 0.006758 * c2 + 0.000907 * s2 - 0.002697 * c3 + 0.00148 * s3
    distance = 1.00011 + 0.034221 * c1 + 0.00128 * s1 + 0.000719 * c2 + 0.000077 * s2
    hours = F.abs(12 - ((half_hour % 48) / 2 + 0.25))
    phi = math.radians(latitude)
    height = F.sin(declination) * math.sin(phi) + F.cos(declination) * math.cos(phi) * F.cos(F.radians(-15 * hours))
    return F.greatest(F.lit(0.0), 1376.0 * distance * height)


def is_daytime(ts: Column, latitude: float, limit: float = 10.0) -> Column:
    """Whether the two half hours before a period's end have a mean potential radiation above ``limit``."""
    k = F.greatest(half_hour_number(ts) - 1, F.lit(2))
    return (potential_radiation(k, latitude) + potential_radiation(k - 1, latitude)) / 2 > limit


def daytime(radiation: Column, photons: Column, ts: Column, latitude: float) -> Column:
    """By global radiation above 12 W/m2 or photon flux above 100; where both are missing, by potential radiation."""
    measured = F.coalesce(radiation > 12, F.lit(False)) | F.coalesce(photons > 100, F.lit(False))
    return F.when(radiation.isNull() & photons.isNull(), is_daytime(ts, latitude)).otherwise(measured)


def separation_direction(north: float, east: float) -> float:
    """Compass direction, in degrees, of a sensor displaced ``north`` and ``east`` of the anemometer, as the separation formula takes it."""
    west = -east
    if north == 0:
        return 90.0 if west > 0 else 270.0 if west < 0 else 0.0
    return (180.0 if north > 0 else 360.0 if west < 0 else 0.0) - math.degrees(math.atan(west / north))


def separation_factor(z_over_l: Column, wind_direction: Column, length: Column, height: float, displacement: float, north: float, east: float, vertical: float, along: bool = True) -> Column:
    """Flux factor for a gas sensor displaced from the anemometer; without ``along``, of its cross-wind and vertical parts only.

    Distances in m; ``vertical`` below 0 means a lower gas sensor. 1 where the stability is missing.
    """
    zl, z = z_over_l, height - displacement
    # Published peak wavenumbers of the cospectra in the three directions, and the cross-wind exponent.
    peak_along = F.when(zl <= -0.1, 0.07).otherwise(2.31 - 2.24 / F.pow(1.015 + 0.15 * zl, F.lit(2.0)))
    peak_across = F.when(zl <= -0.05, 0.15).otherwise(2.43 - 2.28 / F.pow(1.01 + 0.2 * zl, F.lit(2.0)))
    lower = (z + vertical) / F.nullif(length, F.lit(0.0))
    if vertical >= 0:
        peak_up, z_up = F.when(zl <= 0.03, 0.1).otherwise(0.43 - 0.33 / F.pow(0.964 + 1.2 * zl, F.lit(2.0))), z
    else:
        peak_up, z_up = F.when(lower <= -0.03, 0.013).otherwise(0.3 - 0.287 / F.pow(1.051 + 1.7 * lower, F.lit(2.0))), z + vertical
    exponent = 1.2
    k_along, k_across, k_up = 2 * math.pi * peak_along / 1.1 / z, 2 * math.pi * peak_across / z, 2 * math.pi * peak_up / z_up
    angle = F.radians(wind_direction - separation_direction(north, east) - 180)
    r = math.hypot(north, east)
    across = F.pow(k_across * F.abs(r * F.sin(angle)), F.lit(exponent))
    flat = F.sqrt(F.pow(k_along * F.abs(r * F.cos(angle)), F.lit(2.0)) + across * across) if along else across
    up = F.exp(k_up * abs(vertical))
    return F.when(zl.isNull(), 1.0).otherwise(F.exp(flat) * (F.coalesce(up, F.lit(1.0)) if along else up))


def polynomial(coefficients: list[float], x: Column) -> Column:
    """Value at ``x`` of the polynomial with ``coefficients`` from the constant one up."""
    out = F.lit(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        out = out * x + F.lit(float(c))
    return out


def drift_between_calibrations(periods: DataFrame, calibrations: DataFrame, keys: list[str], ts: str, step: int) -> DataFrame:
    """``periods`` with ``drift``: the offsets found at the calibrations before and after, interpolated by whole steps of ``step`` seconds.

    ``calibrations``: keys, ts (seconds) and offset. Null before the first and
    after the last one of a station. Two windows over a station's time line, one
    in each sense, as a window that ends at the line's end reads it anew for each row.
    """
    marks = calibrations.select(*keys, F.col(ts), F.struct(F.col(ts).alias("t"), F.col("offset").alias("o")).alias("_c"))
    both = periods.withColumn("_p", F.lit(True)).unionByName(marks, allowMissingColumns=True)
    line, back = Window.partitionBy(*keys).orderBy(ts), Window.partitionBy(*keys).orderBy(F.desc(ts))
    before, after = (F.last("_c", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)) for w in (line, back))
    out = both.withColumns({"_b": before, "_a": after}).where("_p")
    whole, passed = F.floor((F.col("_a.t") - F.col("_b.t")) / step), F.floor((F.col(ts) - F.col("_b.t")) / step)
    drift = F.col("_b.o") + F.when(whole > 0, (F.col("_a.o") - F.col("_b.o")) / whole * passed).otherwise(0.0)
    return out.withColumn("drift", F.when(F.col("_a").isNotNull(), drift)).drop("_c", "_p", "_a", "_b")


def signal_strength_drift(counts: Column, first: Column, last: Column, offset: Column, cell: Column, b: float, c: float) -> Column:
    """Drift from reference counts between those after one calibration and before the next; ``cell``: temperature in K."""
    scale = F.when(cell > 0, 0.6 + 0.4 / (1 + b * F.exp(c * (cell - 273.15)))).otherwise(1.0)
    return (counts - first * scale) / F.nullif(last - first * scale, F.lit(0.0)) * offset


def without_drift(absorptance: Column, mean: Column, drift: Column, cell_pressure: Column) -> Column:
    """Absorptance over pressure with a period's drift removed; unchanged where the drift is missing. Pressure in Pa."""
    right = (mean - drift) + (absorptance - mean) / F.nullif(1 - drift * cell_pressure * 1e-3, F.lit(0.0))
    return F.when(drift.isNull() | mean.isNull(), absorptance).otherwise(right)
