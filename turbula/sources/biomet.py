"""Slow meteorological series: reading, units, and aggregation to averaging periods."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turbula.functions import stats
from turbula.operators.periods import range_join, seconds
from turbula.sources.raw import file_timestamp

# Aggregation by the beginning of a variable's name.
AGGREGATION = {"P": "sum", "P_RAIN": "sum", "P_SNOW": "sum", "WD": "angle", "MWD": "angle"}


def label_parts(label: str) -> tuple[str, tuple[int, int, int]]:
    """Base name and position (horizontal, vertical, replicate) of NAME_h_v_r; 1, 1, 1 without it."""
    m = re.fullmatch(r"(.*?)_(\d+)_(\d+)_(\d+)", label)
    return (m[1], (int(m[2]), int(m[3]), int(m[4]))) if m else (label, (1, 1, 1))


def end_of_step(ts: Column, step_seconds: int, reference: str) -> Column:
    """Move a stamp from the begin or middle of its step to the end."""
    return ts + {"begin": step_seconds, "middle": step_seconds // 2, "end": 0}[reference]


def aggregate_periods(rows: DataFrame, periods: DataFrame, ts: str, start: str, end: str, variables: list[str], tolerance: int = 0) -> DataFrame:
    """Sum, mean or mean angle of each variable over start + tolerance <= ts < end + tolerance, all in seconds."""
    shifted = rows.withColumn(ts, F.col(ts) - tolerance)
    inside = range_join(periods.select(start, end), shifted.select(ts, *variables), ts, start, end, 1800)

    def value(name: str) -> Column:
        kind = AGGREGATION.get(label_parts(name)[0].upper(), "mean")
        return {"sum": F.sum(name), "angle": stats.circular_mean(name), "mean": F.avg(name)}[kind].alias(name)

    return periods.join(inside.groupBy(start, end).agg(*[value(v) for v in variables], F.count("*").alias("n_rows")), [start, end], "left")


def read_biomet(spark: SparkSession, path: str, columns: list[str], ts_columns: list[int], ts_pattern: str, separator: str = ",", header_rows: int = 1, label: str | None = None, step_seconds: int = 0, reference: str = "end", pattern: str = "*") -> DataFrame:
    """Rows of slow series: ``file, ts`` (seconds, at the end of the step) and one double column for each of ``columns``.

    ``ts_columns``: places, from 1, of the items whose text together matches
    ``ts_pattern`` (yyyy, mm, dd, doy, HH, MM); the others are ``columns`` in
    order. Empty items count for nothing, as separators may be repeated. Rows that
    lack ``label`` or have too few items are left out; an item that is no number
    is null, and so is a time that does not match.
    """
    lines = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path, wholetext=True)
    lines = lines.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("_line", "_text"))
    items = F.filter(F.transform(F.split("_text", re.escape({"tab": "\t", "comma": ",", "semicolon": ";", "space": " "}.get(separator, separator))), lambda x: F.trim(x)), lambda x: x != "")
    rows = lines.where(F.col("_line") >= header_rows).withColumn("_p", items)
    if label:
        rows = rows.where(F.contains(F.substring("_text", 1, 32), F.lit(label))).withColumn("_p", F.slice("_p", 2, 1 << 20))
    rows = rows.where(F.size("_p") >= len(columns) + len(ts_columns))
    places = [i for i in range(1, len(columns) + len(ts_columns) + 1) if i not in ts_columns]
    stamp = rows.withColumn("_ts", file_timestamp(F.concat(*[F.get("_p", F.lit(i - 1)) for i in ts_columns]), ts_pattern))
    values = [F.expr(f"try_cast(_p[{i - 1}] as double)").alias(c) for i, c in zip(places, columns, strict=True)]
    return stamp.select("file", end_of_step(seconds("_ts"), step_seconds, reference).alias("ts"), *values)


# Factor and addend to K, %, Pa, m, mole fractions and m/s, by a variable's nature and unit.
STANDARD_UNITS = {
    "TEMPERATURE": {"C": (1.0, 273.15), "°C": (1.0, 273.15), "F": (5 / 9, 273.15 - 160 / 9), "°F": (5 / 9, 273.15 - 160 / 9), "CK": (0.01, 0.0), "CC": (0.01, 273.15), "C°C": (0.01, 273.15), "CF": (0.05 / 9, 273.15 - 160 / 9), "C°F": (0.05 / 9, 273.15 - 160 / 9)},
    "RELATIVE_HUMIDITY": dict.fromkeys(("NUMBER", "#", "DIMENSIONLESS"), (100.0, 0.0)),
    "PRESSURE": {"HPA": (100.0, 0.0), "KPA": (1000.0, 0.0), "MMHG": (133.32, 0.0), "TORR": (133.32, 0.0), "PSI": (6894.6, 0.0), "BAR": (1e5, 0.0), "ATM": (98066.5, 0.0)},
    "LENGTH": {"NM": (1e-9, 0.0), "UM": (1e-6, 0.0), "MM": (1e-3, 0.0), "CM": (1e-2, 0.0), "KM": (1e3, 0.0)},
    "SPEED": dict.fromkeys(("CM+1S-1", "CM/S", "CMS^-1", "CMS-1"), (1e-2, 0.0)) | dict.fromkeys(("MM+1S-1", "MM/S", "MMS^-1", "MMS-1"), (1e-3, 0.0)),
}
STANDARD_UNITS["PRECIPITATION"] = STANDARD_UNITS["LENGTH"]
# Exponents of ten of the units of mole fractions, and of those that CO2, H2O and other gases are kept in.
FRACTION_UNITS = {"PPT": -3, "MMOL": -3, "PPM": -6, "UMOL": -6, "PPB": -9, "NMOL": -9}
KEPT_FRACTION = {"CO2": -6, "H2O": -3}
OTHER_FRACTION = -9
# Factor and addend from the standard units to those of network files, by base name, else by nature.
NETWORK_UNITS = {"PA": (1e-3, 0.0), "VPD": (1e-2, 0.0), "SNOW_D": (1e2, 0.0), "WATER_TABLE_DEPTH": (1e2, 0.0), "SWC": (1e2, 0.0), "RUNOFF": (1e3, 0.0), "THROUGHFALL": (1e3, 0.0), "DBH": (1e2, 0.0)}
NETWORK_NATURES = {"TEMPERATURE": (1.0, -273.15), "PRECIPITATION": (1e3, 0.0)}


def to_standard(value: Column, nature: str, unit: str, label: str = "") -> Column:
    """A slow variable in standard units; units that are not known change nothing."""
    unit = unit.strip().upper()
    if nature == "CONCENTRATION":
        own = FRACTION_UNITS.get(re.split(r"[+/]|MOL-1", unit)[0])
        kept = KEPT_FRACTION.get(label.strip().upper(), OTHER_FRACTION)
        return value if own is None or own == kept else value * 10.0 ** (own - kept)
    factor, addend = STANDARD_UNITS.get(nature, {}).get(unit, (1.0, 0.0))
    return value * factor + addend


def to_network(value: Column, nature: str, base_name: str = "") -> Column:
    """A slow variable from standard units to those of network files."""
    factor, addend = NETWORK_UNITS.get(base_name.strip().upper()) or NETWORK_NATURES.get(nature, (1.0, 0.0))
    return value * factor + addend
