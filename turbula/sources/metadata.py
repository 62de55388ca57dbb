"""Site, instrument and column metadata from INI files, and the configuration of a run."""

from __future__ import annotations

import configparser
import re
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turbula.operators.periods import as_of_join, seconds

# Analyser models by optical path.
OPEN_PATH = ("li7500", "li7500a", "li7500rs", "li7500ds", "li7700", "ec150", "irgason", "generic_open_path", "open_path_krypton", "open_path_lyman")
CLOSED_PATH = ("li6262", "li7000", "li7200", "li7200rs", "ec155", "generic_closed_path", "closed_path_krypton", "closed_path_lyman")


def path_type(model: str) -> str | None:
    """open, closed or None, by the model's base name; a trailing index is left out."""
    base = re.sub(r"_\d+$", "", model.strip().lower())
    return "open" if base in OPEN_PATH else "closed" if base in CLOSED_PATH else None


def software_version(text: str) -> tuple[int, int, int]:
    """Numbers of a version string such as 7.1.0; parts that are missing are 0."""
    found = [int(x) for x in re.findall(r"\d+", text)[:3]]
    return tuple(found + [0] * (3 - len(found)))  # type: ignore[return-value]


@dataclass(frozen=True)
class ColumnInfo:
    variable: str
    instrument: str = ""
    measure_type: str = ""
    unit_in: str = ""
    unit_out: str = ""
    conversion: str = "none"
    gain: float = 1.0
    offset: float = 0.0
    min_lag: float | None = None
    max_lag: float | None = None
    nominal_lag: float | None = None
    flag_threshold: float | None = None
    flag_side: str = ">"

    @property
    def used(self) -> bool:
        return self.variable not in ("", "ignore")


@dataclass(frozen=True)
class SiteInfo:
    altitude: float = 0.0
    latitude: float = 0.0
    longitude: float = 0.0
    canopy_height: float = 0.0
    displacement_height: float = 0.0
    roughness_length: float = 0.0
    acquisition_frequency: float = 10.0
    file_duration: float = 30.0
    header_rows: int = 0
    separator: str = ","
    columns: tuple[ColumnInfo, ...] = field(default_factory=tuple)


def read_site(text: str) -> SiteInfo:
    """Parse a metadata file's text: one section per subject, columns as col_<n>_<tag>."""
    parser = configparser.ConfigParser(strict=False, interpolation=None)
    parser.optionxform = str.lower  # type: ignore[assignment,method-assign]
    parser.read_string(text if text.lstrip().startswith("[") else "[root]\n" + text)
    tags = {k: v.strip() for s in parser.sections() for k, v in parser[s].items()}
    known = {f.name: f.type for f in fields(SiteInfo) if f.name != "columns"}
    values = {k: (v if k == "separator" else int(float(v)) if k == "header_rows" else float(v)) for k, v in tags.items() if k in known and v}
    by: dict[int, dict[str, str]] = {}
    for k, v in tags.items():
        if m := re.fullmatch(r"col_(\d+)_(\w+)", k):
            by.setdefault(int(m[1]), {})[m[2]] = v
    columns = []
    for _, c in sorted(by.items()):
        number = lambda name, c=c: float(c[name]) if c.get(name) else None
        columns.append(ColumnInfo(
            variable=c.get("variable", ""), instrument=c.get("instrument", ""), measure_type=c.get("measure_type", ""),
            unit_in=c.get("unit_in", ""), unit_out=c.get("unit_out", ""), conversion=c.get("conversion", "none") or "none",
            gain=number("a_value") or 1.0, offset=number("b_value") or 0.0, min_lag=number("min_timelag"), max_lag=number("max_timelag"),
            nominal_lag=number("nom_timelag"), flag_threshold=number("flag_threshold"), flag_side=c.get("flag_policy", ">"),
        ))
    return replace(SiteInfo(**values), columns=tuple(columns))


class MetadataProblem(ValueError):
    """A metadata file that cannot be used; ``code`` says why."""

    def __init__(self, code: str, detail: str):
        super().__init__(f"{code}: {detail}")
        self.code = code


def validate(site: SiteInfo) -> SiteInfo:
    """The same site, or a MetadataProblem."""
    if site.acquisition_frequency <= 0:
        raise MetadataProblem("frequency", "acquisition frequency must be positive")
    if site.file_duration <= 0:
        raise MetadataProblem("duration", "file duration must be positive")
    used = [c.variable for c in site.columns if c.used]
    for name in ("u", "v", "w"):
        if name not in used:
            raise MetadataProblem("wind", f"no column holds {name}")
    if len(used) != len(set(used)):
        raise MetadataProblem("columns", "a variable has two columns")
    return site


def custom_label(label: str, ordinal: int) -> str:
    """Normalised name of a custom variable's mean."""
    name = re.sub(r"^custom_", "", label.strip(), flags=re.I).lower()
    if re.fullmatch(r"\d+", name) or not name:
        return f"custom_{ordinal}_mean"
    if name == "flowrate":
        return "flowrate_li7200_1_mean"
    return name if name.endswith("_mean") else f"{name}_mean"


def custom_unit(label: str) -> str:
    """Unit inferred from a custom variable's label."""
    # Units by the beginning of a label.
    for start, unit in (("co2", "umol mol-1"), ("n2o", "umol mol-1"), ("h2o", "mmol mol-1"), ("int_t", "K"), ("int_p", "Pa"), ("flowrate", "m3 s-1")):
        if label.lower().startswith(start):
            return unit
    return "--"


def fraction(value: float, default: float) -> float:
    """0 to 1 as it is, over 1 to 100 as a percentage, else the default."""
    return value if 0 <= value <= 1 else value / 100 if 1 < value <= 100 else default


# Ends of the names of dynamic metadata that are text; others are numbers.
TEXT_TAGS = ("manufacturer", "model", "wformat", "wref", "measure_type")


def read_dynamic(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """Metadata that change with time: ``valid_from`` (seconds) and a column for each name of the header, lower case.

    ``date`` (yyyy-mm-dd) and ``time`` (HH:MM) give the time; a row without both
    is left out. What is no number is null. Displacement and roughness follow
    from the canopy's height where the file has no column of them.
    """
    df = spark.read.option("header", "true").option("sep", separator).option("mode", "PERMISSIVE").csv(path)
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    stamp = F.try_to_timestamp(F.concat_ws(" ", F.trim("date"), F.trim("time")), F.lit("yyyy-MM-dd HH:mm"))
    names = [c for c in df.columns if c not in ("date", "time")]
    values = [F.trim(c).alias(c) if c.endswith(TEXT_TAGS) else F.expr(f"try_cast(trim(`{c}`) as double)").alias(c) for c in names]
    out = df.withColumn("_ts", stamp).where("_ts is not null").select(seconds("_ts").cast("long").alias("valid_from"), *values)
    return with_canopy(out)


def with_canopy(df: DataFrame) -> DataFrame:
    """Displacement and roughness from the canopy's height, where ``df`` has no column of them."""
    # Shares of the canopy's height.
    for name, share in (("displacement_height", 0.67), ("roughness_length", 0.15)):
        if "canopy_height" in df.columns and name not in df.columns:
            df = df.withColumn(name, F.col("canopy_height") * share)
    return df


def with_dynamic(periods: DataFrame, dynamic: DataFrame, end: str, keys: list[str], static: SiteInfo | None = None) -> DataFrame:
    """``periods`` with the last metadata at or before their ``end`` (seconds), those of the site where they are null or not there yet.

    ``keys``: the station's columns, in both tables; a station's periods are put in order together.
    """
    names = [c for c in dynamic.columns if c not in (*keys, "valid_from")]
    out = as_of_join(periods, dynamic, end, "valid_from", keys, names)
    fixed = {f.name: getattr(static, f.name) for f in fields(SiteInfo) if f.name != "columns"} if static else {}
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(fixed[c])) for c in names if c in fixed})
