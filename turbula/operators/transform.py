"""Ordered transforms within a period: detrending, rotation, planar fit, lags, gap interpolation.

All but the recursive ones are Columns over windows of one period, whose length
bounds what a task holds; periods are spread over the cluster.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turbula.operators.arrays import over_periods


def _within(period: str) -> Window:
    return Window.partitionBy(period)


def _ordered(period: str, rec: str = "rec") -> Window:
    return Window.partitionBy(period).orderBy(rec)


# --- fluctuations -----------------------------------------------------------


def block_average(df: DataFrame, period: str, columns: list[str]) -> DataFrame:
    """Fluctuations about the period's mean, as ``<column>_p``."""
    return df.withColumns({f"{c}_p": F.col(c) - F.avg(c).over(_within(period)) for c in columns})


def linear_detrend(df: DataFrame, period: str, columns: list[str], rec: str = "rec", chunk: int | None = None) -> DataFrame:
    """Fluctuations about a straight line, by chunks of ``chunk`` records or over the period.

    The line is fitted against the number of valid records so far, and evaluated
    at the position among all records of the chunk, as in the published scheme.
    """
    part = [period] + ([F.floor((F.col(rec) - 1) / chunk)] if chunk else [])
    whole, running = Window.partitionBy(*part), Window.partitionBy(*part).orderBy(rec)
    place = F.row_number().over(running).cast("double")
    out = df
    for c in columns:
        valid = F.when(F.col(c).isNotNull(), F.count(c).over(running).cast("double"))
        out = out.withColumn("_i", valid)
        n, sx, sy = F.count(c).over(whole), F.sum("_i").over(whole), F.sum(c).over(whole)
        sxy, sxx = F.sum(F.col("_i") * F.col(c)).over(whole), F.sum(F.col("_i") * F.col("_i")).over(whole)
        spread = sxx - sx * sx / n
        slope = F.when(spread > 0, (sxy - sx * sy / n) / spread).otherwise(0.0)
        trend = sy / n + slope * (place - sx / n)
        out = out.withColumn(f"{c}_p", F.col(c) - trend).drop("_i")
    return out


def running_mean(df: DataFrame, period: str, columns: list[str], records: int, rec: str = "rec") -> DataFrame:
    """Fluctuations about the mean of the last ``records`` records, fewer at the beginning."""
    w = _ordered(period, rec).rowsBetween(-(records - 1), 0)
    return df.withColumns({f"{c}_p": F.col(c) - F.avg(c).over(w) for c in columns})


def exponential_average(df: DataFrame, period: str, columns: list[str], hertz: float, seconds: float, rec: str = "rec") -> DataFrame:
    """Fluctuations about an exponentially weighted running mean; missing records leave the mean as it is.

    A recursion, so it runs over the arrays of one period at a time.
    """
    keep = math.exp(-1.0 / (hertz * seconds))

    def run(x: dict) -> None:
        for c in columns:
            out, mean = np.full(len(x[c]), np.nan), np.nan
            for i, value in enumerate(x[c]):
                if not math.isnan(value):
                    mean = value if math.isnan(mean) else keep * mean + (1 - keep) * value
                    out[i] = value - mean
            x[f"{c}_p"] = out

    return over_periods(df, period, rec, columns, [], {f"{c}_p": "double" for c in columns}, run)


def centred_average(df: DataFrame, period: str, columns: list[str], records: int, rec: str = "rec") -> DataFrame:
    """Mean over ``records // 2`` records on either side, as ``<column>_c``.

    Near the ends of a period the window shrinks on both sides alike. Missing
    values count for nothing; a window without any other is null.
    """
    half = records // 2

    def run(x: dict) -> None:
        for c in columns:
            place, known = np.arange(len(x[c])), ~np.isnan(x[c])
            reach = np.minimum(half, np.minimum(place, len(place) - 1 - place))
            sums, counts = (np.concatenate(([0.0], np.cumsum(v))) for v in (np.where(known, x[c], 0.0), known))
            n = counts[place + reach + 1] - counts[place - reach]
            x[f"{c}_c"] = np.divide(sums[place + reach + 1] - sums[place - reach], n, out=np.full(len(place), np.nan), where=n > 0)

    return over_periods(df, period, rec, columns, [], {f"{c}_c": "double" for c in columns}, run)


def difference(df: DataFrame, period: str, column: str, rec: str = "rec") -> DataFrame:
    """First difference, as ``<column>_d``."""
    return df.withColumn(f"{column}_d", F.col(column) - F.lag(column).over(_ordered(period, rec)))


def interpolate_gaps(df: DataFrame, period: str, column: str, rec: str = "rec", max_missing: float = 1 / 3) -> DataFrame:
    """Linear interpolation between valid neighbours, as ``<column>_i``.

    Records before the first and after the last valid value stay missing; a
    variable with more than ``max_missing`` of its records missing is all null.
    What comes after a record is what comes before it from the other end: a window
    up to the period's end would read the rest of it anew for each record.
    """
    back, ahead = (w.rowsBetween(Window.unboundedPreceding, 0) for w in (_ordered(period, rec), Window.partitionBy(period).orderBy(F.desc(rec))))
    place = F.when(F.col(column).isNotNull(), F.col(rec))
    x0, x1 = F.last(place, ignorenulls=True).over(back), F.last(place, ignorenulls=True).over(ahead)
    y0, y1 = F.last(column, ignorenulls=True).over(back), F.last(column, ignorenulls=True).over(ahead)
    value = F.when(x1 == x0, y0).otherwise(y0 + (y1 - y0) * (F.col(rec) - x0) / F.nullif(x1 - x0, F.lit(0)))
    share = 1 - F.count(column).over(_within(period)) / F.count("*").over(_within(period))
    return df.withColumn(f"{column}_i", F.when(share <= max_missing, value))


# --- rotation ---------------------------------------------------------------


def double_rotation_angles(mean_u: Column, mean_v: Column, mean_w: Column) -> tuple[Column, Column]:
    """Yaw that turns the mean wind into the first axis, and the pitch that levels it, in radians."""
    yaw = F.atan2(mean_v, mean_u)
    level = F.sqrt(mean_u * mean_u + mean_v * mean_v)
    return yaw, F.atan2(mean_w, level)


def rotate(u: Column, v: Column, w: Column, yaw: Column, pitch: Column) -> tuple[Column, Column, Column]:
    along = u * F.cos(yaw) + v * F.sin(yaw)
    across = v * F.cos(yaw) - u * F.sin(yaw)
    return along * F.cos(pitch) + w * F.sin(pitch), across, w * F.cos(pitch) - along * F.sin(pitch)


def double_rotation(df: DataFrame, period: str, u: str = "u", v: str = "v", w: str = "w") -> DataFrame:
    """Replace the wind by its rotated components; a record with any missing component is not rotated."""
    whole = F.col(u).isNotNull() & F.col(v).isNotNull() & F.col(w).isNotNull()
    over = _within(period)
    mean = [F.avg(F.when(whole, F.col(c))).over(over) for c in (u, v, w)]
    turned = rotate(F.col(u), F.col(v), F.col(w), *double_rotation_angles(*mean))
    return df.withColumns({c: F.when(whole, x).otherwise(F.col(c)) for c, x in zip((u, v, w), turned, strict=True)})


def third_rotation(df: DataFrame, period: str, v: str = "v", w: str = "w", limit_degrees: float = 10.0) -> DataFrame:
    """Roll about the mean wind that removes the covariance of v and w, applied if it is below ``limit_degrees``."""
    over = _within(period)
    spread = F.var_pop(v).over(over) - F.var_pop(w).over(over)
    roll = F.when(spread != 0, 0.5 * F.atan(2 * F.covar_pop(v, w).over(over) / spread))
    turn = F.when(F.abs(roll) < math.radians(limit_degrees), roll).otherwise(0.0)
    return df.withColumn("_roll", turn).withColumns(
        {v: F.col(v) * F.cos("_roll") + F.col(w) * F.sin("_roll"), w: F.col(w) * F.cos("_roll") - F.col(v) * F.sin("_roll")}
    ).drop("_roll")


def wind_sector(direction: Column, sectors: int, offset: float = 0.0) -> Column:
    """Number, from 1, of the equal sector that holds a direction."""
    width = 360.0 / sectors
    turned = direction - offset
    turned = turned - 360.0 * F.floor(turned / 360.0)
    return (F.floor(turned / width) + 1).cast("long")


def planar_fit(means: DataFrame, sector: str, u: str = "u", v: str = "v", w: str = "w", bias: bool = True, least: int = 3) -> DataFrame:
    """Plane w = b0 + b1 u + b2 v of the period means in each sector.

    Sums by sector, then Cramer's rule; a sector with fewer than ``least`` means,
    or a singular one, has null coefficients.
    """
    sums = means.where(F.col(u).isNotNull() & F.col(v).isNotNull() & F.col(w).isNotNull()).groupBy(sector).agg(
        F.count("*").alias("n"),
        *[F.sum(c).alias(f"s{n}") for n, c in (("u", u), ("v", v), ("w", w))],
        *[F.sum(F.col(a) * F.col(b)).alias(n) for n, a, b in (("uu", u, u), ("vv", v, v), ("uv", u, v), ("uw", u, w), ("vw", v, w))],
    )
    c = F.col
    n = c("n") if bias else F.lit(1.0)
    # Moments about the mean with bias, raw without.
    uu, vv, uv, uw, vw = (
        (c(x) - (c(f"s{x[0]}") * c(f"s{x[1]}") / n if bias else 0.0)) for x in ("uu", "vv", "uv", "uw", "vw")
    )
    det = uu * vv - uv * uv
    ok = (c("n") >= least) & (F.abs(det) > 1e-12)
    b1, b2 = F.when(ok, (uw * vv - vw * uv) / det), F.when(ok, (vw * uu - uw * uv) / det)
    b0 = F.when(ok, (c("sw") - b1 * c("su") - b2 * c("sv")) / n) if bias else F.when(ok, F.lit(0.0))
    return sums.select(sector, "n", b0.alias("b0"), b1.alias("b1"), b2.alias("b2"))


def planar_rotation(b1: Column, b2: Column) -> list[list[Column]]:
    """Rows of the rotation into the fitted plane."""
    p = F.sqrt(b1 * b1 + b2 * b2 + 1)
    p31, p32, p33 = -b1 / p, -b2 / p, 1 / p
    flat = F.sqrt(p32 * p32 + p33 * p33)
    s2, c2, s1, c1 = p31, flat, -p32 / flat, p33 / flat
    return [[c2, s2 * s1, -s2 * c1], [F.lit(0.0), c1, s1], [s2, -c2 * s1, c2 * c1]]


def borrow_sectors(fits: DataFrame, sector: str, sectors: int, clockwise: bool = True) -> DataFrame:
    """Every sector with its own plane or that of the next valid sector in the given sense.

    The table has one row per sector, at most 360.
    """
    spine = fits.sparkSession.range(1, sectors + 1).withColumnRenamed("id", "want")
    valid = fits.where("b1 is not null").withColumnRenamed(sector, "have")
    away = F.pmod((F.col("have") - F.col("want")) if clockwise else (F.col("want") - F.col("have")), F.lit(sectors))
    best = F.min(F.struct(away.alias("away"), "have", "b0", "b1", "b2"))
    near = F.broadcast(spine).join(valid, F.col("have").between(1, sectors), "left").groupBy("want").agg(best.alias("x"))
    return near.select(F.col("want").alias(sector), F.col("x.have").alias("source"), "x.b0", "x.b1", "x.b2")


# --- time lags ----------------------------------------------------------------


def lag_table(df: DataFrame, period: str, a: str, b: str, lags: range, rec: str = "rec", sample: bool = False) -> DataFrame:
    """Covariance (of the population, or of the sample) of ``a`` with ``b`` taken ``lag`` records later, for each period and lag.

    The lags become columns of one window and one aggregation, then rows.
    """
    w = _ordered(period, rec)
    shifted = df.select(period, F.col(a).alias("_a"), *[F.lead(b, k).over(w).alias(f"_l{i}") if k > 0 else F.lag(b, -k).over(w).alias(f"_l{i}") if k < 0 else F.col(b).alias(f"_l{i}") for i, k in enumerate(lags)])
    agg = shifted.groupBy(period).agg(*[(F.covar_samp if sample else F.covar_pop)("_a", f"_l{i}").alias(f"_c{i}") for i, _ in enumerate(lags)])
    pairs = F.array(*[F.struct(F.lit(k).cast("long").alias("lag"), F.col(f"_c{i}").alias("cov")) for i, k in enumerate(lags)])
    return agg.select(period, F.explode(pairs).alias("x")).select(period, "x.lag", "x.cov")


def best_lag(table: DataFrame, period: str, default: int = 0, fallback: bool = True) -> DataFrame:
    """The lag of the largest absolute covariance, the smallest of equal ones.

    With ``fallback``, a maximum at either end of the range counts as not found
    and the default lag is taken.
    """
    best = F.max(F.struct(F.abs("cov").alias("c"), (-F.col("lag")).alias("l")))
    found = table.where("cov is not null").groupBy(period).agg((-best["l"]).alias("lag"), best["c"].alias("max_cov"), F.min("lag").alias("lo"), F.max("lag").alias("hi"))
    edge = (F.col("lag") == F.col("lo")) | (F.col("lag") == F.col("hi"))
    used = F.when(edge, F.lit(default)).otherwise(F.col("lag")) if fallback else F.col("lag")
    return found.select(period, used.cast("long").alias("lag"), "max_cov", edge.alias("default_used") if fallback else F.lit(False).alias("default_used"))


def apply_lag(df: DataFrame, lags: DataFrame, period: str, columns: list[str], rec: str = "rec") -> DataFrame:
    """Shift ``columns`` by their period's lag: record r gets the values of record r + lag, null beyond the end.

    Lags differ by period, so the shift is an equi-join on period and record.
    """
    moved = df.join(lags.select(period, "lag"), period).select(period, (F.col(rec) - F.col("lag")).alias(rec), *[F.col(c).alias(f"_{c}") for c in columns])
    out = df.join(moved, [period, rec], "left")
    return out.withColumns({c: F.col(f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])


def lagged_covariances(x: np.ndarray, y: np.ndarray, lags: range) -> np.ndarray:
    """Population covariance of ``x`` with ``y`` taken each lag later, over present pairs; nan without any."""
    found, n = np.full(len(lags), np.nan), len(x)
    for i, k in enumerate(lags):
        if abs(k) < n:
            a, b = (x[: n - k], y[k:]) if k >= 0 else (x[-k:], y[:k])
            both = ~(np.isnan(a) | np.isnan(b))
            if both.any():
                a, b = a[both], b[both]
                found[i] = ((a - a.mean()) * (b - b.mean())).mean()
    return found


def moved_by(y: np.ndarray, lag: int) -> np.ndarray:
    """Record r with the value of record r + lag; nan beyond the ends."""
    out = np.full(len(y), np.nan)
    if abs(lag) < len(y):
        out[max(0, -lag) : len(y) - max(0, lag)] = y[max(0, lag) : len(y) - max(0, -lag)]
    return out


def apply_own_lags(df: DataFrame, period: str, columns: list[str], rec: str = "rec") -> DataFrame:
    """Shift each of ``columns`` by ``lag_<column>``, the same in all records of a period; a null lag shifts nothing."""

    def run(x: dict) -> None:
        for c in columns:
            lag = x[f"lag_{c}"][0]
            if not np.isnan(lag):
                x[c] = moved_by(x[c], int(lag))

    return over_periods(df, period, rec, [*columns, *[f"lag_{c}" for c in columns]], columns, {}, run)


def align_to_best_lags(df: DataFrame, period: str, anchor: str, columns: list[str], lags: range, default: int = 0, fallback: bool = True, rec: str = "rec") -> DataFrame:
    """Shift each of ``columns`` by its lag of largest absolute covariance with ``anchor``.

    The same lags as :func:`best_lag` and the same shift as :func:`apply_lag`, in
    one kernel over a period's records, numbered without gaps, instead of a join
    for each column. Adds ``lag_<column>`` and ``default_lag_<column>``, the same
    in all records of a period; a period without any covariance takes the default.
    """

    def run(x: dict) -> None:
        fixed = x[anchor]
        for c in columns:
            size = np.abs(lagged_covariances(fixed, x[c], lags))
            lag, edge = default, True
            if not np.isnan(size).all():
                best = int(np.nanargmax(size))
                known = np.flatnonzero(~np.isnan(size))
                edge = fallback and best in (known[0], known[-1])
                lag = default if edge else lags[best]
            x[c], x[f"lag_{c}"], x[f"default_lag_{c}"] = moved_by(x[c], lag), lag, bool(edge)

    more = {f"lag_{c}": "long" for c in columns} | {f"default_lag_{c}": "boolean" for c in columns}
    return over_periods(df, period, rec, [anchor, *columns], columns, more, run)


def shift(df: DataFrame, period: str, columns: list[str], lag: int, rec: str = "rec") -> DataFrame:
    """Shift ``columns`` by one lag for all periods."""
    w = _ordered(period, rec)
    return df.withColumns({c: F.lead(c, lag).over(w) if lag > 0 else F.lag(c, -lag).over(w) for c in columns}) if lag else df


# --- sonic corrections --------------------------------------------------------


def w_boost(w: Column, up: float = 1.166, down: float = 1.289) -> Column:
    """Correct a firmware's reduced vertical wind."""
    return F.when(w >= 0, w * up).otherwise(w * down)


def undo_w_boost(w: Column, up: float = 1.166, down: float = 1.289) -> Column:
    return F.when(w >= 0, w / up).otherwise(w / down)


def crosswind_temperature(ts: Column, u: Column, v: Column, a: float = 0.75, b: float = 0.75, c: float = 0.0) -> Column:
    """Sonic temperature with the crosswind's effect on the sound path restored."""
    return ts + (a * u * u + b * v * v + c * u * v) / 1209.0


def cartesian_from_polar(direction: Column, speed: Column) -> tuple[Column, Column]:
    """u and v from a wind direction in degrees and a speed."""
    return speed * F.cos(F.radians(direction)), -speed * F.sin(F.radians(direction))


def cartesian_from_axes(a1: Column, a2: Column, a3: Column) -> tuple[Column, Column, Column]:
    """u, v and w from the velocities along an anemometer's three sound paths."""
    # The maker's constants.
    return (2 * a1 - a2 - a3) / 2.1213, (a3 - a2) / 1.2247, (a1 + a2 + a3) / 2.1213


# Anemometers whose axes stand 30 degrees off the spar, those with a mirrored v, and north offsets in degrees by model.
AXIS_MODELS = ("hs_50", "hs_100", "r3_50", "r3_100", "r3a_100", "wm", "wmpro")
MIRRORED_MODELS = ("usa1_standard", "usa1_fast")
NORTH_OFFSETS = {"csi_csat3": -180.0, "csi_csat3b": -180.0, "csi_csat3a": -180.0, "csi_csat3c": -180.0, "csi_irgason_sonic": -180.0, "usoni3_cage_mp": 90.0, "usoni3_classa_mp": 90.0, "81000": -90.0, "81000v": -90.0, "81000re": -90.0, "81000vre": -90.0}


def sonic_coordinates(df: DataFrame, model: str, wind_format: str = "uvw", reference: str = "spar", offsets: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """u, v and w of a right-handed frame from what a ``model`` gives: ``uvw``, ``polar_w`` (u: direction, v: speed) or ``axis``.

    ``offsets`` are taken off records with all three components. The frame of
    models with an ``axis`` reference is turned to the spar.
    """
    u, v, w = (F.col(x) for x in ("u", "v", "w"))
    whole = u.isNotNull() & v.isNotNull() & w.isNotNull()
    out = df
    if wind_format == "polar_w":
        made = cartesian_from_polar(u, v)
        out = out.withColumns({n: F.when(u.isNotNull() & v.isNotNull(), x).otherwise(F.col(n)) for n, x in zip("uv", made, strict=True)})
    elif wind_format == "axis":
        reference = "axis"
        made = cartesian_from_axes(u, v, w)
        out = out.withColumns({n: F.when(whole, x).otherwise(F.col(n)) for n, x in zip("uvw", made, strict=True)})
    out = out.withColumns({n: F.when(whole, F.col(n) - o).otherwise(F.col(n)) for n, o in zip("uvw", offsets, strict=True)})
    sign = -1.0 if model == "r2" else 1.0
    if model == "r2" or (model in AXIS_MODELS and reference == "axis"):
        c, s, both = math.cos(math.radians(30)), math.sin(math.radians(30)), u.isNotNull() & v.isNotNull()
        out = out.withColumns({"u": F.when(both, sign * u * c - v * s).otherwise(u), "v": F.when(both, sign * u * s + v * c).otherwise(v)})
    return out.withColumn("v", -v) if model in MIRRORED_MODELS else out


def substitute_temperature(df: DataFrame, period: str, ts: str, candidates: list[str]) -> DataFrame:
    """``ts`` replaced, period by period, by the last of ``candidates`` with a mean between 220 and 340 K; list the most trusted last."""
    over = _within(period)
    fit = [F.when((F.avg(c).over(over) > 220) & (F.avg(c).over(over) < 340), F.lit(i)) for i, c in enumerate(candidates)]
    chosen = F.coalesce(*reversed(fit))
    out = df.withColumn("_chosen", chosen)
    value = F.col(ts)
    for i, c in enumerate(candidates):
        value = F.when(F.col("_chosen") == i, F.col(c)).otherwise(value)
    return out.withColumn(ts, value).drop("_chosen")


def scaled_to_reference(df: DataFrame, period: str, gas: str, reference: str) -> DataFrame:
    """A gas scaled so that its mean is the reference's, in thousandths."""
    over = _within(period)
    return df.withColumn(gas, F.col(gas) * F.avg(reference).over(over) / F.nullif(F.avg(gas).over(over), F.lit(0.0)) / 1000)


def cell_temperature(inlet: Column, outlet: Column) -> Column:
    return F.coalesce(0.2 * inlet + 0.8 * outlet, inlet, outlet)
