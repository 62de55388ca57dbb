"""Averaging periods: assignment, spine, gaps, contiguity, and joins on time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds(ts: str) -> Column:
    """A timestamp column as whole seconds since 1970, whatever the session's time zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))")


def period_start(ts: str, minutes: int) -> Column:
    """Start of the left-closed period of ``minutes`` that holds a timestamp, as seconds since 1970."""
    step = minutes * 60
    return (F.floor(seconds(ts) / step) * step).cast("long")


def spine(bounds: DataFrame, start: str, end: str, step: int, name: str = "period") -> DataFrame:
    """Every period start from ``start`` to ``end`` (seconds, both in ``bounds``), missing ones too."""
    return bounds.select(F.explode(F.sequence(F.col(start), F.col(end), F.lit(step).cast("long"))).alias(name))


def fill_gaps(periods: DataFrame, results: DataFrame, on: str = "period") -> DataFrame:
    """Every period with its results, or with nulls: the continuous dataset."""
    return periods.join(results, on, "left")


def record_numbers(df: DataFrame, period: str, order: str, name: str = "rec") -> DataFrame:
    """Position within the period, from 1. Position is time: rows are never dropped before this."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(period).orderBy(order)).cast("long"))


def contiguity(files: DataFrame, start: str, seconds: int, tolerance: int = 0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mark where a file does not follow its predecessor by ``seconds``, and number the unbroken runs.

    ``keys``: station or day columns; without them all files are put in one order,
    which suits a catalogue of files, not the records in them.
    """
    w = Window.partitionBy(*keys).orderBy(start)
    gap = F.col(start) - F.lag(start).over(w)
    broken = F.coalesce((gap > seconds + tolerance), F.lit(True))
    return files.withColumns({"gap": gap, "new_run": broken}).withColumn("run", F.sum(F.col("new_run").cast("long")).over(w))


def file_overlaps_period(file_start: Column, file_end: Column, start: Column, end: Column) -> Column:
    """Whether a file holds records of a period; both intervals are open at the end."""
    return (file_start < end) & (file_end > start)


def record_range(file_start: Column, start: Column, end: Column, hertz: float) -> tuple[Column, Column]:
    """First and last record, from 1, of a file within a period."""
    first = F.greatest(F.lit(1), F.round((start - file_start) * hertz) + 1).cast("long")
    last = F.round((end - file_start) * hertz).cast("long")
    return first, last


def range_join(left: DataFrame, right: DataFrame, ts: str, start: str, end: str, bucket: int, how: str = "inner") -> DataFrame:
    """Rows of ``right`` with ``start`` <= ``ts`` < ``end`` of ``left`` intervals, in seconds.

    Intervals are dealt to the buckets of time that they touch, so the join is an
    equi-join on the bucket and no two sides are ever crossed. With ``how``
    "left", intervals without rows stay.
    """
    first, last = F.floor(F.col(start) / bucket), F.floor((F.col(end) - 1) / bucket)
    spread = left.withColumn("_key", F.monotonically_increasing_id()) if how == "left" else left
    dealt = spread.withColumn("_bucket", F.explode(F.sequence(first, last)))
    points = right.withColumn("_bucket", F.floor(F.col(ts) / bucket))
    inside = dealt.join(points, "_bucket").where((F.col(ts) >= F.col(start)) & (F.col(ts) < F.col(end))).drop("_bucket")
    if how != "left":
        return inside
    own = [c for c in right.columns]
    return spread.join(inside.select("_key", *own), "_key", "left").drop("_key")


def as_of_join(left: DataFrame, right: DataFrame, ts: str, right_ts: str, keys: list[str], columns: list[str]) -> DataFrame:
    """Each row of ``left`` with ``columns`` of the last row of ``right`` at or before it, within ``keys``.

    One sort by key and time over the union of both sides; nothing is joined.
    Of rows of ``right`` with equal times the one with the greatest columns counts.
    """
    payload = F.struct(*[F.col(c).alias(c) for c in columns])
    a = left.select(*keys, F.col(ts).alias("_ts"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(payload.alias("x")).schema[0].dataType).alias("_of"))
    b = right.select(*keys, F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), payload.alias("_of"))
    w = Window.partitionBy(*keys).orderBy("_ts", "_side", "_of").rowsBetween(Window.unboundedPreceding, 0)
    seen = a.unionByName(b).withColumn("_of", F.last("_of", ignorenulls=True).over(w)).where("_side = 1")
    return seen.select("_row.*", *[F.col("_of")[c].alias(c) for c in columns])


def tolerance_match(points: DataFrame, series: DataFrame, ts: str, series_ts: str, seconds: int, side: str = "either") -> DataFrame:
    """For each point, the nearest series time within ``seconds``: later, strictly_later, before, strictly_before or either.

    Ties go to the earlier time. Both sides are put into buckets of ``seconds``, and
    each bucket also gets the series' last time of the bucket before and its first
    of the one after. One sort of a bucket then tells the times about each point,
    so the work grows with the rows, not with the pairs of near ones.
    """
    bucket, t = F.floor(F.col(series_ts) / seconds), F.col(series_ts)
    ends = series.where(t.isNotNull()).groupBy(bucket.alias("_bucket")).agg(F.min(t).alias("_a"), F.max(t).alias("_z"))
    beside = [F.struct((F.col("_bucket") + step).alias("_bucket"), F.col(c).alias("_t")) for step, c in ((1, "_z"), (-1, "_a"))]
    near = ends.select(F.inline(F.array(*beside)))
    times = series.where(t.isNotNull()).select(bucket.alias("_bucket"), t.alias("_t")).unionByName(near)
    # A point comes after the series' rows of its own time, or before them if these are not to count.
    own = points.select(F.floor(F.col(ts) / seconds).alias("_bucket"), F.col(ts).alias("_at"), F.lit(1).alias("_point"), F.struct(*points.columns).alias("_row")).where("_at is not null")
    both = own.unionByName(times.select("_bucket", F.col("_t").alias("_at"), F.lit(0).alias("_point"), "_t"), allowMissingColumns=True)
    at, turn = F.col("_at"), F.lit(-1 if side.startswith("strictly") else 1) * F.col("_point")
    line, back = (Window.partitionBy("_bucket").orderBy(o, turn).rowsBetween(Window.unboundedPreceding, 0) for o in (at.asc(), at.desc()))
    before, after = (F.last("_t", ignorenulls=True).over(w) for w in (line, back))
    if side not in ("either", "before", "strictly_before"):
        before = F.lit(None).cast("long")
    if side not in ("either", "later", "strictly_later"):
        after = F.lit(None).cast("long")
    known = both.withColumns({"_before": F.when(at - before <= seconds, before), "_after": F.when(after - at <= seconds, after)}).where("_point = 1")
    later = F.col("_before").isNull() | (F.col("_after") - at < at - F.col("_before"))
    known = known.withColumn("_matched", F.when(later & F.col("_after").isNotNull(), F.col("_after")).otherwise(F.col("_before"))).where("_matched is not null")
    # Equal points are one row; they lie in one bucket.
    return known.groupBy("_bucket", "_row").agg(F.first("_matched").alias("matched")).select("_row.*", "matched")


def common_step(df: DataFrame, ts: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The most frequent step between consecutive times; ties go to the smaller."""
    step = F.col(ts) - F.lag(ts).over(Window.partitionBy(*keys).orderBy(ts))
    counts = df.select(*keys, step.alias("step")).where("step is not null").groupBy(*keys, "step").count()
    best = F.max(F.struct(F.col("count"), (-F.col("step")).alias("s")))
    return counts.groupBy(*keys).agg((-best["s"]).alias("step"), best["count"].alias("n"))
