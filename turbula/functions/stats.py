"""Missing-aware statistics as aggregate Columns. Null cells are skipped; pairs need both cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def covariance(a, b) -> Column:
    """Population covariance over records where both are present."""
    return F.covar_pop(_col(a), _col(b))


def mixed_correlation(a, b) -> Column:
    """Population covariance over sample deviations: of a variable with itself it is (n - 1) / n."""
    spread = F.stddev_samp(_col(a)) * F.stddev_samp(_col(b))
    return F.when(spread > 0, F.covar_pop(_col(a), _col(b)) / spread)


def level_skewness(x) -> Column:
    """Third moment divided by n - 1, with the population deviation; null where that is zero or n is one."""
    n = F.count(_col(x))
    return F.when((n > 1) & (F.stddev_pop(_col(x)) > 0), F.skewness(_col(x)) * n / (n - 1))


def level_kurtosis(x) -> Column:
    """Fourth moment (not the excess) divided by n - 1, with the population deviation."""
    n = F.count(_col(x))
    return F.when((n > 1) & (F.stddev_pop(_col(x)) > 0), (F.kurtosis(_col(x)) + 3) * n / (n - 1))


def helper_skewness(x) -> Column:
    """Third moment divided by n, with the sample deviation."""
    n = F.count(_col(x)).cast("double")
    return F.when((n > 1) & (F.stddev_pop(_col(x)) > 0), F.skewness(_col(x)) * F.pow((n - 1) / n, F.lit(1.5)))


def helper_kurtosis(x) -> Column:
    """Fourth moment (not the excess) divided by n, with the sample deviation."""
    n = F.count(_col(x)).cast("double")
    return F.when((n > 1) & (F.stddev_pop(_col(x)) > 0), (F.kurtosis(_col(x)) + 3) * F.pow((n - 1) / n, F.lit(2.0)))


def quantile_sas5(x, q: float) -> Column:
    """Empirical quantile with averaging: the mean of x[k] and x[k+1] where k = n q is whole, else x[floor(n q) + 1].

    The values of one averaging period are gathered, which the period's length bounds.
    """
    values = F.array_sort(F.collect_list(_col(x)))
    n = F.size(values)
    k = F.floor(n * F.lit(q) + F.lit(1e-9)).cast("int")
    whole = F.abs(n * F.lit(q) - k) < 1e-9
    at = lambda i: F.element_at(values, F.greatest(F.lit(1), F.least(n, i)))
    return F.when(n > 0, F.when(whole & (k >= 1), (at(k) + at(k + 1)) / 2).otherwise(at(k + 1)))


def circular_mean(degrees) -> Column:
    """Mean direction in [0, 360)."""
    r = F.radians(_col(degrees))
    d = F.degrees(F.atan2(F.avg(F.sin(r)), F.avg(F.cos(r))))
    return F.when(d < 0, d + 360).otherwise(d)


def circular_deviation(degrees) -> Column:
    """Yamartino's deviation of directions, in degrees."""
    r = F.radians(_col(degrees))
    s, c = F.avg(F.sin(r)), F.avg(F.cos(r))
    e = F.sqrt(F.greatest(F.lit(0.0), 1 - (s * s + c * c)))
    return F.degrees(F.asin(e) * (1 + 0.1547 * e * e * e))


def wind_direction(u, v, offset: float = 0.0) -> Column:
    """Direction that the wind comes from, in [0, 360); null where a component is missing."""
    d = 180.0 - F.degrees(F.atan2(_col(v), _col(u))) + offset
    return d - 360.0 * F.floor(d / 360.0)


def turbulent_kinetic_energy(u, v, w) -> Column:
    return 0.5 * (F.var_pop(_col(u)) + F.var_pop(_col(v)) + F.var_pop(_col(w)))


def friction_velocity(uw: Column, vw: Column) -> Column:
    return F.pow(uw * uw + vw * vw, F.lit(0.25))


def sample_count_pairs(a, b) -> Column:
    return F.count_if(_col(a).isNotNull() & _col(b).isNotNull())


def unbiased_correlation(df: DataFrame, period: str, a: str, b: str, rec: str, lag: int) -> DataFrame:
    """Correlation of ``a`` with ``b`` taken ``lag`` records earlier, over present pairs: ``n, r`` and the t value of r."""
    w = Window.partitionBy(period).orderBy(rec)
    pairs = df.select(period, F.col(a).alias("_a"), (F.lag(b, lag).over(w) if lag >= 0 else F.lead(b, -lag).over(w)).alias("_b")).where("_a is not null and _b is not null")
    out = pairs.groupBy(period).agg(F.count("*").alias("n"), F.corr("_a", "_b").alias("r"))
    return out.withColumn("t", F.when(F.abs("r") < 1, F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r")))))
