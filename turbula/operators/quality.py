"""Raw-signal tests and quality flags, one row per period."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turbula.functions import stats
from turbula.operators.arrays import over_periods
from turbula.operators.transform import lag_table, linear_detrend


def resolution_and_dropouts(df: DataFrame, period: str, column: str, rec: str, window: int, bins: int = 100, deviations: float = 7.0, extreme_percent: float = 10.0) -> DataFrame:
    """Empty bins and drop-outs of histograms over half-overlapping windows of ``window`` records.

    A histogram spans ``deviations`` sample deviations about its window's mean, or
    the values' range if that is less; its last bin is open. A drop-out is a value
    in the same bin as the value before. Bins up to ``extreme_percent`` of a
    window's values, from either side, are extreme ones, the others and those at
    the border central ones. Returns, over all windows of a period, the
    percentages of empty bins and of extreme and central drop-outs.
    """
    half = window // 2
    n = F.count("*").over(Window.partitionBy(period))
    windows = F.floor(F.floor((n - window) / half)) + 1
    place, k = F.col(rec) - 1, F.floor((F.col(rec) - 1) / half)
    near = F.sequence(F.greatest(k - (window // half), F.lit(0)), k)
    # Counted before the records are dealt: in one step the copies would count, too.
    counted_first = df.select(period, rec, F.col(column).alias("_x"), windows.alias("_many"))
    dealt = counted_first.withColumn("_win", F.explode(near))
    dealt = dealt.where((F.col("_win") < F.col("_many")) & (place >= F.col("_win") * half) & (place < F.col("_win") * half + window))
    whole = Window.partitionBy(period, "_win")
    low, high, mean, spread = (f("_x").over(whole) for f in (F.min, F.max, F.avg, F.stddev_samp))
    narrow = high - low < deviations * spread
    begin = F.when(narrow, low).otherwise(mean - deviations / 2 * spread)
    step = F.when(narrow, high - low).otherwise(deviations * spread) / bins
    dealt = dealt.withColumns({"_a": begin, "_step": step})
    slot = F.floor((F.col("_x") - F.col("_a")) / F.nullif(F.col("_step"), F.lit(0.0)))
    dealt = dealt.withColumn("_bin", F.when(slot.between(0, bins - 1), slot + 1))
    before = F.last("_bin", ignorenulls=True).over(Window.partitionBy(period, "_win").orderBy(rec).rowsBetween(Window.unboundedPreceding, -1))
    dealt = dealt.withColumn("_drop", (F.col("_bin") == before).cast("int"))
    cells = dealt.where("_bin is not null").groupBy(period, "_win", "_bin").agg(F.max("_many").alias("_many"), F.count("*").alias("_n"), F.sum("_drop").alias("_d"))
    part = window // 100
    sofar = F.sum("_n").over(Window.partitionBy(period, "_win").orderBy("_bin"))
    cells = cells.withColumn("_c", sofar)
    least = F.coalesce(F.min(F.when(F.col("_c") > extreme_percent * part, F.col("_bin"))).over(whole) - 1, F.lit(bins))
    most = F.coalesce(F.min(F.when(F.col("_c") >= (100 - extreme_percent) * part, F.col("_bin"))).over(whole) - 1, F.lit(bins - bins // 10))
    cells = cells.withColumns({"_lo": F.least(least, most + 1), "_hi": most})
    counted = (F.col("_lo") > 0) & (F.col("_hi") >= F.col("_lo"))
    extreme = F.when(counted, (F.col("_bin") <= F.col("_lo")).cast("int") + (F.col("_bin") >= F.col("_hi")).cast("int")).otherwise(0)
    central = F.when(counted & F.col("_bin").between(F.col("_lo"), F.col("_hi")), 1).otherwise(0)
    d = F.coalesce("_d", F.lit(0))
    total = F.max("_many")
    return cells.groupBy(period).agg(
        (100.0 * (bins - F.count("*") / total) / bins).alias("empty_percent"),
        (100.0 * F.sum(d * extreme) / (window * total)).alias("extreme_percent"),
        (100.0 * F.sum(d * central) / (window * total)).alias("central_percent"),
    )


def higher_moments(df: DataFrame, period: str, columns: list[str], skewness=((-2.0, 2.0), (-1.0, 1.0)), kurtosis=((1.0, 8.0), (2.0, 5.0)), rec: str = "rec") -> DataFrame:
    """Skewness and kurtosis of each variable about its linear trend, and their flags: 2 hard, 1 soft, 0 none; a bound is outside."""

    def flag(x: Column, bounds) -> Column:
        (ha, hb), (sa, sb) = bounds
        return F.when((x <= ha) | (x >= hb), 2).when((x <= sa) | (x >= sb), 1).otherwise(0)

    out = []
    for c in columns:
        s, k = stats.helper_skewness(f"{c}_p"), stats.helper_kurtosis(f"{c}_p")
        out += [s.alias(f"skew_{c}"), k.alias(f"kurt_{c}"), F.greatest(flag(s, skewness), flag(k, kurtosis)).alias(f"flag_{c}")]
    return linear_detrend(df, period, columns, rec).groupBy(period).agg(*out)


def discontinuities(
    df: DataFrame, period: str, column: str, rec: str, window: int, step: int = 100, mean=(4.0, 2.7), variance=(3.0, 2.0)
) -> DataFrame:
    """Haar test over windows of ``window`` records that begin every ``step`` records.

    The lower half's mean minus the upper half's, in units of the variable, and
    the difference of their variances over the whole window's. Returns the
    largest of each over the period, and a flag: 2 where one is above its hard
    limit, 1 above its soft one.
    """
    half = window // 2
    w = Window.partitionBy(period).orderBy(rec)
    lower, upper, whole = w.rowsBetween(0, half - 1), w.rowsBetween(half, 2 * half - 1), w.rowsBetween(0, window - 1)
    begins = ((F.col(rec) - 1) % step == 0) & (F.count("*").over(whole) == window)
    level = F.avg(column).over(lower) - F.avg(column).over(upper)
    spread = (F.var_samp(column).over(lower) - F.var_samp(column).over(upper)) / F.nullif(F.var_samp(column).over(whole), F.lit(0.0))
    cells = df.select(period, F.when(begins, level).alias("_m"), F.when(begins, spread).alias("_v"))
    m, v = F.max("_m"), F.max("_v")
    flag = F.when((m > mean[0]) | (v > variance[0]), 2).when((m > mean[1]) | (v > variance[1]), 1).otherwise(0)
    return cells.groupBy(period).agg(m.alias("max_mean_jump"), v.alias("max_variance_jump"), flag.alias("flag"))


def lag_test(table: DataFrame, period: str, default: int, hard: float = 20.0, soft: float = 10.0) -> DataFrame:
    """Excess of the covariance at its best lag over that at the default lag, in percent, and its flag: 2 hard, 1 soft, 0 none.

    ``table``: period, lag, cov, of sample covariances.
    """
    # Covariances that agree to nine digits are equal: the smallest lag wins.
    best = F.max(F.struct(F.round(F.abs("cov"), 9).alias("c"), (-F.col("lag")).alias("l"), "cov"))
    found = table.where("cov is not null").groupBy(period).agg(best.alias("_b"), F.max(F.when(F.col("lag") == default, F.col("cov"))).alias("default_cov"))
    excess = (F.col("max_cov") - F.col("default_cov")) * 100 / F.nullif(F.col("default_cov"), F.lit(0.0))
    found = found.select(period, (-F.col("_b.l")).alias("lag"), F.col("_b.cov").alias("max_cov"), "default_cov").withColumn("excess_percent", excess)
    return found.withColumn("flag", F.when(F.col("excess_percent") >= hard, 2).when(F.col("excess_percent") >= soft, 1).otherwise(0))


def pack_flags(flags: list[Column]) -> Column:
    """One number: 9, then a digit for each flag, 9 where it is null (the variable is absent)."""
    out = F.lit(9)
    for f in flags:
        out = out * 10 + F.coalesce(f.cast("int"), F.lit(9))
    return out


def unpack_flag(packed: Column, place: int, many: int) -> Column:
    """The flag at ``place`` (from 1) of ``many`` packed ones; null where it is 9."""
    digit = F.floor(packed / 10 ** (many - place)) % 10
    return F.when(digit != 9, digit.cast("int"))


def attack_angles(df: DataFrame, period: str, low: float, high: float, u: str = "u", v: str = "v", w: str = "w") -> DataFrame:
    """Percentage of records whose angle of attack, in degrees, lies outside [low, high]."""
    angle = F.degrees(F.atan2(F.col(w), F.sqrt(F.col(u) * F.col(u) + F.col(v) * F.col(v))))
    return df.groupBy(period).agg(F.when(F.count(angle) > 0, 100.0 * F.count_if(~angle.between(low, high)) / F.count(angle)).alias("outside_percent"))


def non_steady_wind(df: DataFrame, period: str, rec: str, limit: float = 0.5, u: str = "u", v: str = "v") -> DataFrame:
    """Change of the wind along its linear trend over the period, relative to its mean speed.

    Along the mean wind, across it, and both together; flagged where one reaches ``limit``.
    """
    n = F.max(rec) - F.min(rec)
    du, dv = F.regr_slope(u, rec) * n, F.regr_slope(v, rec) * n
    mu, mv = F.avg(u), F.avg(v)
    speed = F.sqrt(mu * mu + mv * mv)
    along = F.when(speed > 0, F.abs(du * mu + dv * mv) / (speed * speed))
    across = F.when(speed > 0, F.abs(dv * mu - du * mv) / (speed * speed))
    ratio = F.when(speed > 0, F.sqrt(du * du + dv * dv) / speed)
    flag = F.when(F.greatest(along, across, ratio) >= limit, 1).otherwise(0)
    return df.groupBy(period).agg(along.alias("along"), across.alias("across"), ratio.alias("non_steadiness"), flag.alias("flag"))


def difference_kurtosis(df: DataFrame, period: str, column: str, rec: str) -> DataFrame:
    """Kurtosis of first differences (KID) and the number of their sign changes, zeros apart."""
    w = Window.partitionBy(period).orderBy(rec)
    d = df.select(period, rec, (F.col(column) - F.lag(column).over(w)).alias("_d"))
    sign = F.when(F.col("_d") != 0, F.signum("_d"))
    before = F.last(sign, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_turn", (sign != before).cast("int"))
    return d.groupBy(period).agg(stats.helper_kurtosis("_d").alias("kid"), F.coalesce(F.sum("_turn"), F.lit(0)).cast("long").alias("zero_crossings"))


def longest_gap(df: DataFrame, period: str, column: str, rec: str, hertz: float = 1.0) -> DataFrame:
    """Longest run of missing values, in seconds: gaps and islands."""
    w = Window.partitionBy(period).orderBy(rec)
    island = F.count(column).over(w)
    runs = df.withColumn("_k", island).where(F.col(column).isNull()).groupBy(period, "_k").agg(F.count("*").alias("_n"))
    longest = runs.groupBy(period).agg(F.max("_n").alias("_n"))
    return df.select(period).distinct().join(longest, period, "left").select(period, (F.coalesce("_n", F.lit(0)) / hertz).alias("longest_gap"))


def repeated_value_test(df: DataFrame, period: str, a: str, b: str, rec: str, lags: range = range(-25, 26), epsilon: float = 1e-8) -> DataFrame:
    """Squared correlation of the lagged covariances of two variables with those without values that repeat their predecessor."""
    w = Window.partitionBy(period).orderBy(rec)
    fresh = {c: F.when(~(F.abs(F.col(c) - F.lag(c).over(w)) < epsilon) | F.lag(c).over(w).isNull(), F.col(c)) for c in (a, b)}
    d = df.select(period, rec, a, b, fresh[a].alias("_a"), fresh[b].alias("_b"))
    raw, new = lag_table(d, period, a, b, lags, rec), lag_table(d, period, "_a", "_b", lags, rec)
    both = raw.join(new.withColumnRenamed("cov", "_c"), [period, "lag"])
    return both.groupBy(period).agg(F.pow(F.corr("cov", "_c"), F.lit(2.0)).alias("r2"))


def qn_scale(x: np.ndarray) -> float:
    """Robust scale by the quantile of order floor(n/2)+1 over 2 of pairwise distances, without making the pairs.

    The k-th smallest distance is found by bisection over the sorted values: the
    pairs within a distance are counted by one search a value.
    """
    x = np.sort(x[~np.isnan(x)])
    n = len(x)
    if n < 2:
        return np.nan
    h = n // 2 + 1
    k = h * (h - 1) // 2

    def within(d: float) -> int:
        return int((np.searchsorted(x, x + d, "right") - np.arange(1, n + 1)).sum())

    low, high = -1.0, float(x[-1] - x[0])
    while True:
        middle = (low + high) / 2
        if middle <= low or middle >= high:
            break
        low, high = (low, middle) if within(middle) >= k else (middle, high)
    # The published corrections for small samples.
    small = {2: 0.399, 3: 0.994, 4: 0.512, 5: 0.844, 6: 0.611, 7: 0.857, 8: 0.669, 9: 0.872}
    return high * 2.2219 * (small.get(n) or n / (n + (1.4 if n % 2 else 3.8)))


def robust_scale(df: DataFrame, period: str, column: str) -> DataFrame:
    """:func:`qn_scale` of each period."""

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({period: [key[0]], "qn": [qn_scale(f[column].to_numpy(float))]})

    kind = dict(df.dtypes)[period]
    return df.select(period, column).groupBy(period).applyInPandas(run, f"{period} {kind}, qn double")


def stationarity(df: DataFrame, period: str, a: str, b: str, rec: str, parts: int = 6) -> DataFrame:
    """Deviation of the mean covariance of ``parts`` equal chunks from the whole one, in truncated percent.

    Records that do not fill the chunks are left out of them.
    """
    size = F.floor(F.count("*").over(Window.partitionBy(period)) / parts)
    chunk = F.when(size > 0, F.floor((F.col(rec) - 1) / F.nullif(size, F.lit(0))))
    dealt = df.select(period, a, b, chunk.alias("_k"))
    inner = dealt.where(F.col("_k") < parts).groupBy(period, "_k").agg(F.covar_pop(a, b).alias("_c"))
    inner = inner.groupBy(period).agg(F.avg("_c").alias("_inner"))
    whole = df.groupBy(period).agg(F.covar_pop(a, b).alias("cov"))
    deviation = F.when(F.col("cov") != 0, F.floor(F.abs((F.col("_inner") - F.col("cov")) / F.col("cov")) * 100).cast("long"))
    return whole.join(inner, period, "left").select(period, "cov", deviation.alias("deviation"))


def chunk_covariances(a: str, b: str, rec: str, n: Column, parts: int = 6) -> Column:
    """Aggregate: mean of the covariances of ``parts`` equal chunks of a period of ``n`` records, as in :func:`stationarity`."""
    size = F.floor(n / parts)
    chunk = F.when(size > 0, F.floor((F.col(rec) - 1) / F.nullif(size, F.lit(0))))
    each = F.array(*[F.covar_pop(F.when(chunk == i, F.col(a)), F.when(chunk == i, F.col(b))) for i in range(parts)])
    found = F.filter(each, lambda c: c.isNotNull())
    return F.when(F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda s, c: s + c) / F.size(found))


def itc_models(z_over_l: Column, latitude: float, ustar: Column) -> tuple[Column, Column]:
    """Modelled sigma_w / u* and sigma_u / u* at a stability; null in neutral and stable air without friction."""
    import math

    f = 2 * 7.2921e-5 * abs(math.sin(math.radians(latitude)))
    near_neutral = F.ln(F.lit(f) / F.nullif(ustar, F.lit(0.0)))
    sw = F.when(z_over_l < -0.2, 1.3 * F.pow(1 - 2 * z_over_l, F.lit(1 / 3))).otherwise(0.21 * near_neutral + 3.1)
    su = F.when(z_over_l < -0.2, 4.15 * F.pow(F.abs(z_over_l), F.lit(1 / 8))).otherwise(0.44 * near_neutral + 6.3)
    return sw, su


def developed_turbulence(measured: Column, model: Column) -> Column:
    """Deviation of a measured from a modelled characteristic, in truncated percent."""
    return F.when(model != 0, F.floor(F.abs((model - measured) / model) * 100).cast("long"))


# Upper limits, in percent, of partial flags 1 to 8.
PARTIAL_LIMITS = (15, 30, 50, 75, 100, 250, 500, 1000)


def partial_flag(deviation: Column) -> Column:
    """1 to 9 by a deviation in percent; null stays null."""
    out = F.when(deviation <= PARTIAL_LIMITS[0], 1)
    for i, limit in enumerate(PARTIAL_LIMITS[1:], 2):
        out = out.when(deviation <= limit, i)
    return out.when(deviation > PARTIAL_LIMITS[-1], 9)


def overall_flag_0_2(stationary: Column, turbulence: Column) -> Column:
    """0 best, 1 usable, 2 poor; 2 where a partial flag is missing."""
    return (
        F.when(stationary.isNull() | turbulence.isNull(), 2)
        .when((stationary <= 2) & (turbulence <= 2), 0)
        .when((stationary <= 5) & (turbulence <= 5), 1)
        .otherwise(2)
    )


def overall_flag_1_9(stationary: Column, turbulence: Column) -> Column:
    rules = (((1, 1), (1, 2), 1), ((2, 2), (1, 2), 2), ((1, 2), (3, 4), 3), ((3, 4), (1, 2), 4), ((1, 4), (3, 5), 5), ((5, 5), (1, 5), 6), ((1, 6), (1, 6), 7), ((1, 8), (1, 8), 8))
    out = F.when(stationary.isNull() | turbulence.isNull(), F.lit(None))
    for (a, b), (c, d), flag in rules:
        out = out.when(stationary.between(a, b) & turbulence.between(c, d), flag)
    return out.otherwise(9)


def overall_flag_1_5(stationary: Column, turbulence: Column) -> Column:
    worst = F.greatest(stationary, turbulence)
    return F.when(stationary.isNull() | turbulence.isNull(), F.lit(None)).when(worst <= 2, 1).when(worst <= 4, 2).when(worst <= 6, 3).when(worst <= 8, 4).otherwise(5)


# --- despiking: iterated on corrected data, so a kernel over one period ----------


def _interpolate(x: np.ndarray, bad: np.ndarray) -> np.ndarray:
    good = ~bad & ~np.isnan(x)
    if good.sum() < 2:
        return x
    at = np.flatnonzero(bad)
    x = x.copy()
    x[at] = np.interp(at, np.flatnonzero(good), x[good])
    return x


def despike_median(x: np.ndarray, factor: float = 7.0, passes: int = 10) -> tuple[np.ndarray, int]:
    """Values beyond ``factor`` scaled median deviations are interpolated, until none is left."""
    total = 0
    for _ in range(passes):
        centre = np.nanmedian(x) if np.isfinite(x).any() else np.nan
        mad = np.nanmedian(np.abs(x - centre)) if np.isfinite(centre) else np.nan
        if not np.isfinite(mad):
            break
        with np.errstate(invalid="ignore"):
            bad = np.abs(x - centre) > factor * mad / 0.6745
        if not bad.any():
            break
        total += int(bad.sum())
        x = _interpolate(x, bad)
    return x, total


def despike_moving(x: np.ndarray, window: int, step: int = 100, factor: float = 3.5, longest: int = 3, passes: int = 10, growth: float = 0.1) -> tuple[np.ndarray, int]:
    """Runs of at most ``longest`` values beyond ``factor`` deviations of a moving window are interpolated.

    A window's mean and deviation hold for its central ``step`` values; the factor
    grows with each pass.
    """
    total, n = 0, len(x)
    for _ in range(passes):
        low, high = np.full(n, -np.inf), np.full(n, np.inf)
        for begin in range(0, max(1, n - window + 1), step):
            part = x[begin : begin + window]
            if np.isfinite(part).sum() < 2:
                continue
            m, s = np.nanmean(part), np.nanstd(part)
            a = 0 if begin == 0 else begin + (window - step) // 2
            b = n if begin + step > n - window else begin + (window + step) // 2
            low[a:b], high[a:b] = m - factor * s, m + factor * s
        with np.errstate(invalid="ignore"):
            out = (x < low) | (x > high)
        edge = np.diff(np.concatenate([[0], out.astype(int), [0]]))
        begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        bad = np.zeros(n, bool)
        for a, b in zip(begins, ends, strict=True):
            bad[a:b] = b - a <= longest
        if not bad.any():
            break
        total += int(((ends - begins) <= longest).sum())
        x = _interpolate(x, bad)
        factor += growth
    return x, total


def despike(df: DataFrame, period: str, columns: list[str], rec: str, method: str = "median", **options) -> DataFrame:
    """Replace spikes in ``columns`` and count them as ``<column>_spikes``; ``method`` is "median" or "moving"."""
    kernel = {"median": despike_median, "moving": despike_moving}[method]

    def run(x: dict) -> None:
        for c in columns:
            x[c], x[f"{c}_spikes"] = kernel(x[c], **options)

    return over_periods(df, period, rec, columns, columns, {f"{c}_spikes": "long" for c in columns}, run)
