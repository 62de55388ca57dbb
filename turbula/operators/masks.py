"""Cell and record masks. A masked cell becomes null; its row stays, because position is time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def null_where(df: DataFrame, condition: Column, columns: list[str]) -> DataFrame:
    """Null ``columns`` where ``condition`` is true; an unknown condition masks nothing."""
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumns({c: F.when(~hit, F.col(c)) for c in columns})


def finite(df: DataFrame, columns: list[str], missing: float = -9999.0) -> DataFrame:
    """Null NaN, infinities and the missing-value code."""
    return df.withColumns(
        {c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")) & (F.col(c) != missing), F.col(c)) for c in columns}
    )


def flag_mask(df: DataFrame, flags: dict[str, tuple[str, float]], columns: list[str]) -> DataFrame:
    """Null whole records where any flag column is ">" or "<" its threshold."""
    hit = F.lit(False)
    for name, (side, threshold) in flags.items():
        c = F.col(name)
        hit = hit | F.coalesce(c > threshold if side == ">" else c < threshold, F.lit(False))
    return null_where(df, hit, columns)


def diagnostic_mask(df: DataFrame, diagnostic: str, bits: int, columns: list[str]) -> DataFrame:
    """Null ``columns`` where any of the ``bits`` of an integer diagnostic is set."""
    return null_where(df, F.col(diagnostic).bitwiseAND(F.lit(bits)) != 0, columns)


def anemometer_mask(df: DataFrame, diagnostic: str, columns: list[str], allowed: tuple[int, ...] = (0, 10, 11)) -> DataFrame:
    return null_where(df, ~F.col(diagnostic).isin(*allowed), columns)


def sector_mask(df: DataFrame, direction: Column, sectors: list[tuple[float, float]], columns: list[str]) -> DataFrame:
    """Null records whose direction lies strictly inside an excluded sector."""
    hit = F.lit(False)
    for a, b in sectors:
        hit = hit | ((direction > a) & (direction < b))
    return null_where(df, hit, columns)


def limits_mask(df: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """Null cells outside their closed limits."""
    return df.withColumns({c: F.when(F.col(c).between(a, b), F.col(c)) for c, (a, b) in limits.items()})


# Gross limits of wind components (m/s) and temperatures (K).
GROSS_WIND = 50.0
GROSS_TEMPERATURE = (200.0, 350.0)


def gross_limits(df: DataFrame, wind: list[str], temperature: list[str]) -> DataFrame:
    """Null winds beyond 50 m/s and temperatures outside 200-350 K."""
    return limits_mask(df, {c: (-GROSS_WIND, GROSS_WIND) for c in wind} | dict.fromkeys(temperature, GROSS_TEMPERATURE))


def corrupted_variables(df: DataFrame, period: str, columns: list[str], expected: int | None, max_missing_percent: float) -> DataFrame:
    """Null a variable for a whole period in which too many of its values are missing.

    ``expected`` records a period, or by default those that the period has.
    """
    w = Window.partitionBy(period)
    n = F.lit(expected) if expected else F.count("*").over(w)
    share = {c: (n - F.count(c).over(w)) * 100.0 / n for c in columns}
    return df.withColumns({c: F.when(share[c] <= max_missing_percent, F.col(c)) for c in columns})


def absolute_limits(df: DataFrame, period: str, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """For each period the number of values outside each variable's limits, and a flag if there are any."""
    out = []
    for c, (a, b) in limits.items():
        n = F.count_if(~F.col(c).between(a, b))
        out += [n.alias(f"n_{c}"), F.when(n > 0, 1).otherwise(0).alias(f"flag_{c}")]
    return df.groupBy(period).agg(*out)


def valid_records(columns: list[str]) -> Column:
    """Number of records with any valid value."""
    return F.count_if(F.coalesce(*columns).isNotNull())


def beyond_deviations(df: DataFrame, keys: list[str], columns: list[str], deviations: float = 3.5) -> DataFrame:
    """Values at or beyond so many deviations of the population from their mean become null, once."""
    over = Window.partitionBy(*keys)
    inside = {c: F.abs(F.col(c) - F.avg(c).over(over)) < deviations * F.stddev_pop(c).over(over) for c in columns}
    return df.withColumns({c: F.when(ok, F.col(c)) for c, ok in inside.items()})
