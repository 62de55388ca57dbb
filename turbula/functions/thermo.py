"""Moist-air thermodynamics as Columns: temperatures in K, pressures in Pa, densities in kg/m3."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turbula.functions import constants as C


def air_temperature(sonic: Column, slow: Column, ambient: Column) -> Column:
    """Ambient if plausible, else the slow sensor's, else the sonic's."""
    ok = lambda t: (t > 220) & (t < 340)
    return F.when(ok(ambient), ambient).when(ok(slow), slow).otherwise(sonic)


def air_pressure(altitude: float, sensor: Column, ambient: Column) -> Column:
    ok = lambda p: (p > 40000) & (p < 110000)
    return F.when(ok(ambient), ambient).when(ok(sensor), sensor).otherwise(F.lit(1e5 * (1 - 2.25577e-5 * altitude) ** 5.25588))


def molar_volume(t: Column, p: Column) -> Column:
    return F.when(p > 0, C.GAS_CONSTANT * t / p)


def saturation_pressure(t: Column) -> Column:
    return F.exp(77.345 + 0.0057 * t - 7235 / t) / F.pow(t, F.lit(8.2))


def vapour_pressure(rh: Column, t: Column) -> Column:
    """From relative humidity: above 130 or below 0 is an error, 100 to 130 counts as 100."""
    return F.when(rh.between(0, C.RH_LIMIT), F.least(rh, F.lit(100.0)) * saturation_pressure(t) / 100)


def vapour_density(e: Column, t: Column) -> Column:
    return e / (C.GAS_CONSTANT_VAPOUR * t)


def dry_density(e: Column, t: Column, p: Column) -> Column:
    return (p - e) / (C.GAS_CONSTANT_DRY * t)


def dew_point(e: Column) -> Column:
    x = F.ln(e / 611.0)
    return F.when(e > 0, 240.97 * x / (17.502 - x) + 273.15)


def specific_humidity(e: Column, t: Column, p: Column) -> Column:
    w = vapour_density(e, t)
    return w / (dry_density(e, t, p) + w)


def air_temperature_from_sonic(ts: Column, q: Column) -> Column:
    return ts / (1 + 0.51 * q)


def heat_capacity(e: Column, rh: Column, t: Column, p: Column) -> Column:
    """Volumetric heat capacity of moist air."""
    c = t - 273.15
    dry = 1005 + (c + 23.12) * (c + 23.12) / 3364
    vapour = 1859 + 0.13 * rh + (0.193 + 5.6e-3 * rh) * c + (1e-3 + 5e-5 * rh) * c * c
    return vapour * vapour_density(e, t) + dry * dry_density(e, t, p)


def vaporisation_heat(t: Column) -> Column:
    return (3147.5 - 2.37 * t) * 1e3


def mixing_ratio_to_mole_fraction(r: Column) -> Column:
    """mmol/mol of dry air to mmol/mol."""
    return r / (1 + r / 1e3)


def mole_fraction_to_mixing_ratio(chi: Column) -> Column:
    return chi / (1 - chi / 1e3)


def density_to_mole_fraction(d: Column, va: Column) -> Column:
    return d * va


def dry_mixing_ratio(chi: Column, water: Column) -> Column:
    """Of another gas, with water vapour's mole fraction in mmol/mol."""
    return chi / (1 - water * 1e-3)


def potential_temperature(t: Column, p: Column) -> Column:
    return t * F.pow(1e5 / p, F.lit(0.286))
