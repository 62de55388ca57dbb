"""Readers of raw high-frequency files, each file's records in order.

Text goes through Spark's own reader; binary formats and archives are read as
whole files by Spark and decoded with numpy in the task that holds the file.
Every reader returns ``file, rec`` (from 1) and one double column for each
variable; missing values are null.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turbula.sources.metadata import SiteInfo, read_site


def template_pattern(template: str) -> str:
    """Regular expression of a file-name template with yyyy, mm, dd, HH, MM and doy fields."""
    out = re.escape(template)
    for mark, name, digits in (("yyyy", "y", 4), ("doy", "j", 3), ("mm", "m", 2), ("dd", "d", 2), ("HH", "H", 2), ("MM", "M", 2), ("yy", "yy", 2)):
        out = out.replace(mark, rf"(?<{name}>\\d{{{digits}}})".replace("\\\\", "\\"), 1)
    return out


def file_timestamp(name: Column, template: str) -> Column:
    """Timestamp in a file name, null if the name does not match the template."""
    order = re.findall(r"yyyy|doy|mm|dd|HH|MM|yy", template)
    pattern = re.sub(r"\(\?<\w+>", "(", template_pattern(template))
    part = {mark: F.regexp_extract(name, pattern, i + 1) for i, mark in enumerate(order)}
    number = lambda mark, default: part[mark].cast("int") if mark in part else F.lit(default)
    year = number("yyyy", None) if "yyyy" in part else number("yy", 0) + 2000
    if "doy" in part:
        start = F.date_add(F.make_date(year, F.lit(1), F.lit(1)), number("doy", 1) - 1)
    else:
        start = F.make_date(year, number("mm", 1), number("dd", 1))
    seconds = number("HH", 0) * 3600 + number("MM", 0) * 60
    return F.when(name.rlike(pattern), F.to_timestamp_ntz(start.cast("string")) + F.make_dt_interval(secs=seconds.cast("decimal(18,6)")))


def list_files(spark: SparkSession, path: str, pattern: str = "*", template: str | None = None, recursive: bool = True) -> DataFrame:
    """Catalogue of files: ``path, file, length`` and, with a template, ``file_ts``; only names that match it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    out = files.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), "length")
    return out.withColumn("file_ts", file_timestamp(F.col("file"), template)).where("file_ts is not null") if template else out


def _binary(spark: SparkSession, path: str, decode: Callable[[bytes], np.ndarray], columns: list[str], pattern: str) -> DataFrame:
    """Decode whole files; ``decode`` gives a row for each record and NaN for missing values."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, content in zip(f["path"], f["content"], strict=True):
                x = decode(bytes(content))[:, : len(columns)]
                out = pd.DataFrame(np.where(np.isfinite(x), x, np.nan), columns=columns)
                out.insert(0, "rec", np.arange(1, len(out) + 1, dtype=np.int64))
                out.insert(0, "file", name.rsplit("/", 1)[-1])
                yield out

    schema = "file string, rec long, " + ", ".join(f"`{c}` double" for c in columns)
    found = files.select("path", "content").mapInPandas(run, schema)
    return found.select("file", "rec", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in columns])


def read_text(spark: SparkSession, path: str, columns: list[str], separator: str = ",", header_rows: int = 0, label: str | None = None, pattern: str = "*") -> DataFrame:
    """Delimited text. Header rows, rows without ``label`` and malformed rows are left out; ``ignore`` columns are dropped.

    A record's number counts the rows that are kept, in the order of the file.
    """
    lines = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path, wholetext=True)
    lines = lines.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("_line", "_text"))
    parts = F.split(F.trim("_text"), r"\s+" if separator in ("space", " ") else re.escape({"tab": "\t", "comma": ",", "semicolon": ";"}.get(separator, separator)))
    first = 1 if label else 0
    kept = lines.where((F.col("_line") >= header_rows) & (F.trim("_text") != "")).withColumn("_p", parts)
    if label:
        kept = kept.where(F.element_at("_p", 1) == label)
    kept = kept.where(F.size("_p") >= len(columns) + first)
    rec = F.row_number().over(Window.partitionBy("file").orderBy("_line")).cast("long")
    values = [F.expr(f"try_cast(trim(_p[{i + first}]) as double)").alias(c) for i, c in enumerate(columns) if c != "ignore"]
    return kept.select("file", rec.alias("rec"), *values)


def decode_integers(content: bytes, columns: int, size: int = 2, big_endian: bool = False, header_rows: int = 0, line_end: bytes = b"\r\n") -> np.ndarray:
    """Fixed-width signed integers, after text header rows."""
    for _ in range(header_rows):
        content = content[content.index(line_end) + len(line_end) :] if line_end in content else b""
    n = len(content) // (size * columns) * columns
    return np.frombuffer(content, f"{'>' if big_endian else '<'}i{size}", n).reshape(-1, columns).astype(float)


def read_binary(spark: SparkSession, path: str, columns: list[str], size: int = 2, big_endian: bool = False, header_rows: int = 0, pattern: str = "*") -> DataFrame:
    return _binary(spark, path, lambda b: decode_integers(b, len(columns), size, big_endian, header_rows), columns, pattern)


def fp2_values(words: np.ndarray) -> np.ndarray:
    """Two-byte floating point: sign bit, two bits of decimal places, thirteen of magnitude; 8190 and 8191 are no numbers."""
    sign = np.where(words & 0x8000, -1.0, 1.0)
    places, magnitude = (words >> 13) & 3, (words & 0x1FFF).astype(float)
    return np.where(magnitude >= 8190, np.nan, sign * magnitude / 10.0**places)


def decode_tob1(content: bytes, header_lines: int = 5) -> np.ndarray:
    """Table-oriented binary: five text lines, the last of which names each column's type.

    ULONG prefix columns are dropped; a record whose bytes are all zero ends the file.
    """
    lines = []
    for _ in range(header_lines):
        end = content.index(b"\n") + 1
        lines.append(content[:end].strip().decode("latin-1"))
        content = content[end:]
    kinds = [k.strip().strip('"').upper() for k in lines[-1].split(",")]
    width = {"ULONG": ("<u4", 4), "LONG": ("<i4", 4), "IEEE4": ("<f4", 4), "FP2": (">u2", 2)}
    layout = np.dtype([(f"c{i}", width[k][0]) for i, k in enumerate(kinds)])
    rows = np.frombuffer(content, layout, len(content) // layout.itemsize)
    kept = [i for i, k in enumerate(kinds) if k != "ULONG"]
    out = np.stack([fp2_values(rows[f"c{i}"].astype(np.int64)) if kinds[i] == "FP2" else rows[f"c{i}"].astype(float) for i in kept], 1)
    empty = np.flatnonzero((out == 0).all(1))
    return out[: empty[0]] if len(empty) else out


def read_tob1(spark: SparkSession, path: str, columns: list[str], pattern: str = "*") -> DataFrame:
    return _binary(spark, path, decode_tob1, columns, pattern)


def decode_slt(content: bytes, flavour: str = "edisol") -> np.ndarray:
    """Records of int16 whose length in bytes is the first byte; the first record is a header.

    In the "eddymeas" flavour a bit mask after the length marks columns that are
    stored as (x + 25000) / 10.
    """
    length = content[0]
    columns = length // 2
    values = np.frombuffer(content, "<i2", len(content) // length * columns, 0).reshape(-1, columns)[1:].astype(float)
    if flavour == "eddymeas":
        mask = content[1]
        for i in range(min(8, columns)):
            if mask >> i & 1:
                values[:, i] = (values[:, i] + 25000) / 10
    return values


def read_slt(spark: SparkSession, path: str, columns: list[str], flavour: str = "edisol", pattern: str = "*") -> DataFrame:
    return _binary(spark, path, lambda b: decode_slt(b, flavour), columns, pattern)


def archive_members(content: bytes) -> dict[str, bytes]:
    """Parts of a zipped logger archive: data, metadata, biomet_data, biomet_metadata."""
    out = {}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in z.namelist():
            low = name.lower()
            kind = ("biomet_" if "biomet" in low else "") + ("metadata" if low.endswith(".metadata") else "data" if low.endswith((".data", ".csv")) else "")
            if kind in ("data", "metadata", "biomet_data", "biomet_metadata"):
                out[kind] = z.read(name)
    return out


def _archive_table(parts: dict[str, bytes]) -> np.ndarray:
    site: SiteInfo = read_site(parts.get("metadata", b"").decode("latin-1"))
    rows = parts["data"].decode("latin-1").splitlines()[site.header_rows :]
    sep = {"tab": "\t", "comma": ",", "semicolon": ";", "space": None}.get(site.separator, site.separator)
    width = len(site.columns)
    table = []
    for row in rows:
        cells = row.split(sep)
        if len(cells) >= width:
            try:
                table.append([float(c) for c, k in zip(cells, site.columns, strict=False) if k.used])
            except ValueError:
                continue
    return np.array(table, float).reshape(len(table), sum(c.used for c in site.columns))


def read_archives(spark: SparkSession, path: str, columns: list[str], pattern: str = "*.ghg") -> DataFrame:
    """Zipped archives that carry their own metadata; ``columns`` names the used ones in order."""
    return _binary(spark, path, lambda b: _archive_table(archive_members(b)), columns, pattern)


#: Readers by raw file type.
READERS: dict[str, Callable[..., DataFrame]] = {
    "generic_ascii": read_text,
    "generic_bin": read_binary,
    "tob1": read_tob1,
    "edisol_bin": read_slt,
    "eddymeas_bin": lambda spark, path, columns, **k: read_slt(spark, path, columns, "eddymeas", **k),
    "licor_ghg": read_archives,
}


def read_raw(spark: SparkSession, kind: str, path: str, columns: list[str], **options) -> DataFrame:
    """Raw records of a file type."""
    return READERS[kind](spark, path, columns, **options)


def standardise(df: DataFrame, site: SiteInfo) -> DataFrame:
    """Rescale linearly and convert to m/s, K, Pa, mmol/m3, umol/mol or mmol/mol."""
    # Factor and addend by unit.
    units = {"celsius": (1.0, 273.15), "cc": (0.01, 273.15), "hpa": (100.0, 0.0), "kpa": (1000.0, 0.0), "mm_s": (0.001, 0.0), "cm_s": (0.01, 0.0), "ppt": (1.0, 0.0), "ppb": (0.001, 0.0), "lit_m": (1 / 60000, 0.0), "mg_m3_co2": (1 / 44.01, 0.0), "g_m3_h2o": (1 / 0.01802 / 1000, 0.0)}
    out = df
    for c in site.columns:
        if c.used and c.variable in df.columns:
            x = F.col(c.variable)
            if c.conversion in ("gain_offset", "zero_fullscale"):
                x = x * c.gain + c.offset
            factor, addend = units.get(c.unit_in.lower(), (1.0, 0.0))
            if c.variable == "sos":
                x = x * x / (1.4 * 287.04)
            out = out.withColumn(c.variable, x * factor + addend)
    return out


def with_time(df: DataFrame, files: DataFrame, hertz: float, stamp_is_end: bool = False, minutes: float = 30.0) -> DataFrame:
    """Each record's time from its file's timestamp and number."""
    shift = (minutes * 60 if stamp_is_end else 0.0)
    offset = (F.col("rec") - 1) / hertz - shift
    return df.join(files.select("file", "file_ts"), "file").withColumn("ts", F.col("file_ts") + F.make_dt_interval(secs=offset.cast("decimal(18,6)")))
