"""The flux chain, level 0 to 3, and what derives from it, as Columns on one row per period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turbula.functions import constants as C
from turbula.functions import thermo


def uncorrected_flux(cov: Column, measure: str, va: Column, vd: Column, water: bool = False) -> Column:
    """Level 0 by measure type: density (mmol/m3), mole fraction or mixing ratio."""
    if measure == "density":
        return cov if water else cov * 1e3
    return cov / (va if measure == "mole_fraction" else vd)


def friction(uw: Column, vw: Column) -> Column:
    return F.pow(uw * uw + vw * vw, F.lit(0.25))


def momentum_flux(density: Column, ustar: Column, uw: Column) -> Column:
    """Takes the sign of the covariance of u and w."""
    return F.when(uw < 0, -1.0).otherwise(1.0) * density * ustar * ustar


def obukhov_length(ustar: Column, t: Column, p: Column, wt: Column) -> Column:
    return F.when(wt != 0, -thermo.potential_temperature(t, p) * ustar * ustar * ustar / (C.VON_KARMAN * C.GRAVITY * wt))


def stability(height: float, displacement: float, length: Column) -> Column:
    return F.when(length != 0, (height - displacement) / length)


def scaling_temperature(wt: Column, ustar: Column) -> Column:
    return F.when(ustar != 0, -wt / ustar)


def evaporation_from_water_flux(water_flux: Column) -> tuple[Column, Column]:
    """Mass flux and evapotranspiration per hour."""
    return water_flux * C.MOLAR_MASS_WATER * 1e-3, water_flux * C.ET_PER_H2O_FLUX


def open_path_evaporation(e: Column, h: Column, rho_w: Column, rho_cp: Column, t: Column, sigma: Column, burba: Column | float = 0.0) -> Column:
    """Density correction of an open path's evaporation, with any heat of the instrument itself."""
    return (1 + C.MU * sigma) * (e + (h + burba) * rho_w / (rho_cp * t))


def closed_path_evaporation(e: Column, h_cell: Column, w_pressure: Column, rho_w: Column, rho_cp: Column, t_cell: Column, p_cell: Column, ratio: Column, sigma: Column) -> Column:
    """Of a closed path; a heat or pressure term that is missing is left out."""
    heat, pressure = h_cell * rho_w / (rho_cp * t_cell), w_pressure * rho_w / p_cell
    return (1 + C.MU * sigma) * (e * ratio + F.coalesce(heat, F.lit(0.0)) - F.coalesce(pressure, F.lit(0.0)))


def sonic_heat(h: Column, rho_cp: Column, ts: Column, e: Column, rho: Column, q: Column, wt: Column) -> Column:
    """Heat flux with humidity's effect on sonic temperature removed."""
    return h - rho_cp * 0.51 * ts * e / rho - rho_cp * 0.51 * q * wt


def open_path_gas(f: Column, e: Column, h: Column, d: Column, rho_d: Column, rho_cp: Column, t: Column, sigma: Column, burba: Column | float = 0.0) -> Column:
    """Density correction of an open path's gas flux; ``d``: its density in mmol/m3."""
    return f + C.MU * e * d * 1e3 / ((1 + C.MU * sigma) * rho_d) + (h + burba) * d * 1e3 / (rho_cp * t)


def closed_path_gas(f: Column, e: Column, h_cell: Column, w_pressure: Column, chi: Column, rho_w: Column, rho_cp: Column, t_cell: Column, p_cell: Column, va: Column, sigma: Column) -> Column:
    water = C.MU * sigma * e * chi / (rho_w * va)
    heat = (1 + C.MU * sigma) * h_cell * chi / (rho_cp * t_cell * va)
    pressure = (1 + C.MU * sigma) * w_pressure * chi / (p_cell * va)
    return f + F.coalesce(water, F.lit(0.0)) + F.coalesce(heat, F.lit(0.0)) - F.coalesce(pressure, F.lit(0.0))


def surface_heating(t: Column, wind: Column, surfaces: dict[str, tuple[float, float]], radius: dict[str, float] | None = None, length: dict[str, float] | None = None) -> Column:
    """Heat from an open-path analyser's bottom, top and spars; ``surfaces``: slope and intercept of their temperature, in degrees C. Null without wind."""
    # Radii and lengths, m, of the three surfaces.
    radius = radius or {"top": 0.0225, "spar": 0.0025}
    length = length or {"bottom": 0.065, "top": 0.045, "spar": 0.005}
    wind = F.when(wind > 0, wind)
    k = 6.7e-5 * (t - 273.15) + 0.024343
    rise = {name: a * (t - 273.15) + b + 273.15 - t for name, (a, b) in surfaces.items()}
    bottom = 0.004 * F.sqrt(length["bottom"] / wind) + 0.004
    top = 0.0028 * F.sqrt(length["top"] / wind) + 0.00025 / wind + 0.0045
    spar = 0.0058 * F.sqrt(length["spar"] / wind)
    total = (
        k * rise["bottom"] / bottom
        + k * rise["top"] * (radius["top"] + top) / (top * radius["top"])
        + 0.15 * k * rise["spar"] / (radius["spar"] * F.ln((radius["spar"] + spar) / radius["spar"]))
    )
    return total


def storage(df: DataFrame, period: str, step: int, value: str, height: float, seconds: float, factor: Column | float = 1.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """One-point storage, as ``storage_<value>``, only where the previous row is the period one step earlier.

    ``keys``: station columns. One row per period, so a station's order is short.
    """
    w = Window.partitionBy(*keys).orderBy(period)
    change = F.when(F.lag(period).over(w) + step == F.col(period), F.col(value) - F.lag(value).over(w))
    return df.withColumn(f"storage_{value}", factor * change * height / seconds)


# --- partitioning by conditional sampling --------------------------------------


def eddy_partition(df: DataFrame, period: str, w: str, c: str, q: str, least_valid: float = 0.9, least_both: float = 0.2, least_octant: float = 0.05, hyperbola: float = 0.0) -> DataFrame:
    """Ratios of the two upper octants' fluxes for each period, and how they may be used.

    ``w``, ``c`` and ``q`` are fluctuations. Updrafts that are moist and rich in
    the gas (octant 1) carry soil fluxes, moist and poor ones (octant 2) plant
    fluxes. Returns the ratios ``r_et`` and ``r_fc`` and the status of each gas:
    normal, stomatal, nonstomatal, singular or null.
    """
    valid = F.col(w).isNotNull() & F.col(c).isNotNull() & F.col(q).isNotNull()
    passes = F.lit(True)
    if hyperbola > 0:
        over = Window.partitionBy(period)
        spread = F.stddev_pop(w).over(over)
        passes = (F.abs(F.col(w) * F.col(q)) >= hyperbola * spread * F.stddev_pop(q).over(over)) & (F.abs(F.col(w) * F.col(c)) >= hyperbola * spread * F.stddev_pop(c).over(over))
    up = valid & (F.col(w) > 0) & (F.col(q) > 0) & passes
    marked = df.select(period, valid.alias("ok"), (up & (F.col(c) > 0)).alias("o1"), (up & (F.col(c) < 0)).alias("o2"), (F.col(w) * F.col(q)).alias("wq"), (F.col(w) * F.col(c)).alias("wc"))
    part = lambda x, o: F.coalesce(F.sum(F.when(F.col(o), F.col(x))), F.lit(0.0))
    agg = marked.groupBy(period).agg(
        F.count("*").alias("_n"), F.count_if("ok").alias("n_valid"), F.count_if("o1").alias("n1"), F.count_if("o2").alias("n2"),
        part("wq", "o1").alias("_e"), part("wq", "o2").alias("_t"), part("wc", "o1").alias("_r"), part("wc", "o2").alias("_p"),
    )
    f1, f2 = F.col("n1") / F.nullif(F.col("n_valid"), F.lit(0)), F.col("n2") / F.nullif(F.col("n_valid"), F.lit(0))
    fits = (F.col("n_valid") >= least_valid * F.col("_n")) & (f1 + f2 >= least_both)
    r_et = F.when(fits & (F.col("_t") != 0), F.col("_e") / F.nullif(F.col("_t"), F.lit(0.0)))
    r_fc = F.when(fits & (F.col("_p") != 0), F.col("_r") / F.nullif(F.col("_p"), F.lit(0.0)))
    out = agg.select(period, "n_valid", "n1", "n2", r_et.alias("r_et"), r_fc.alias("r_fc"), fits.alias("fits"), f1.alias("f1"), f2.alias("f2"))

    def status(ratio: Column) -> Column:
        return (
            F.when((F.col("f1") < least_octant) | (ratio == 0), "stomatal").when(F.col("f2") < least_octant, "nonstomatal").when(ratio.isNotNull(), "normal")
        )

    water = F.when(F.col("fits"), status(F.col("r_et")))
    carbon = F.when(F.col("fits"), F.when(F.abs(F.col("r_fc") + 1) < 0.05, "singular").otherwise(status(F.col("r_fc"))))
    return out.select(period, "n_valid", "n1", "n2", "r_et", "r_fc", water.alias("water_status"), carbon.alias("carbon_status"))


def split_flux(flux: Column, ratio: Column, status: Column) -> tuple[Column, Column]:
    """Non-stomatal and stomatal part of a flux."""
    soil = F.when(status == "stomatal", 0.0).when(status == "nonstomatal", flux).when((status == "normal") & (ratio != 0) & (ratio != -1), flux / (1 + 1 / ratio))
    return soil, F.when(status.isNotNull(), flux - soil)
