"""Readers on files made here byte by byte."""

import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from turbula.sources import biomet, metadata, raw, sinks


def test_text_skips_headers_and_malformed_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("h1\nh2\n1,2,x,3\n4,5\n6,NaN,y,8\n")
    rows = raw.read_text(spark, str(tmp_path), ["u", "v", "ignore", "w"], header_rows=2).orderBy("rec").collect()
    assert [(r["rec"], r["u"], r["w"]) for r in rows] == [(1, 1.0, 3.0), (2, 6.0, 8.0)]
    assert "ignore" not in rows[0].asDict()


def test_text_with_a_label(spark, tmp_path):
    (tmp_path / "a.csv").write_text("D,1,2\nE,9,9\nD,3,4\n")
    assert [r["u"] for r in raw.read_text(spark, str(tmp_path), ["u", "v"], label="D").orderBy("rec").collect()] == [1.0, 3.0]


def test_integers_of_both_orders(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"head\r\n" + struct.pack(">4h", 1, -2, 300, 4))
    rows = raw.read_binary(spark, str(tmp_path), ["u", "v"], big_endian=True, header_rows=1).orderBy("rec").collect()
    assert [(r["u"], r["v"]) for r in rows] == [(1.0, -2.0), (300.0, 4.0)]


def test_fp2():
    words = np.array([0x0001, 0x8001, 0x2000 | 1234, 0x6000 | 7, 0x1FFF], np.int64)
    got = raw.fp2_values(words)
    assert got[:4].tolist() == pytest.approx([1.0, -1.0, 123.4, 0.007]) and np.isnan(got[4])


def test_tob1(spark, tmp_path):
    head = b'"TOB1"\r\n"a","b"\r\n"u","v"\r\n"",""\r\n"ULONG","IEEE4","FP2"\r\n'
    body = struct.pack("<If", 7, 1.5) + struct.pack(">H", 0x2000 | 25) + struct.pack("<If", 0, 0.0) + struct.pack(">H", 0) + struct.pack("<If", 9, 2.0) + struct.pack(">H", 1)
    (tmp_path / "a.dat").write_bytes(head + body)
    rows = raw.read_tob1(spark, str(tmp_path), ["u", "v"]).collect()
    assert [(r["u"], r["v"]) for r in rows] == [(1.5, 2.5)]


def test_slt(spark, tmp_path):
    content = bytes([4, 1, 0, 0]) + struct.pack("<2h", -24900, 7) + struct.pack("<2h", 0, 8)
    (tmp_path / "a.slt").write_bytes(content)
    rows = raw.read_raw(spark, "eddymeas_bin", str(tmp_path), ["u", "v"]).orderBy("rec").collect()
    assert [(r["u"], r["v"]) for r in rows] == [(10.0, 7.0), (2500.0, 8.0)]


META = "[site]\naltitude=100\nacquisition_frequency=20\nheader_rows=1\nseparator=tab\ncol_1_variable=u\ncol_2_variable=ignore\ncol_3_variable=v\ncol_4_variable=w\ncol_4_a_value=2\ncol_4_conversion=gain_offset\n"


def test_archive_with_its_own_metadata(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.ghg", "w") as z:
        z.writestr("a.metadata", META)
        z.writestr("a.data", "h\n1\tx\t2\t3\n1\t0\t2\t3\nbad\n")
    rows = raw.read_archives(spark, str(tmp_path), ["u", "v", "w"]).collect()
    assert [(r["u"], r["v"], r["w"]) for r in rows] == [(1.0, 2.0, 3.0)] * 2


def test_metadata():
    site = metadata.validate(metadata.read_site(META))
    assert site.acquisition_frequency == 20 and [c.variable for c in site.columns if c.used] == ["u", "v", "w"]
    with pytest.raises(metadata.MetadataProblem):
        metadata.validate(metadata.read_site("[s]\ncol_1_variable=u\n"))
    assert metadata.software_version("v7.1") == (7, 1, 0)


@pytest.mark.parametrize("model, want", [("ec150_1", "open"), ("irgason", "open"), ("EC155", "closed"), ("li7200_2", "closed"), ("sonic", None)])
def test_path_types(model, want):
    assert metadata.path_type(model) == want


@pytest.mark.parametrize("label, want", [("CUSTOM_Foo", "foo_mean"), ("12", "custom_3_mean"), ("flowrate", "flowrate_li7200_1_mean"), ("a_mean", "a_mean")])
def test_custom_labels(label, want):
    assert metadata.custom_label(label, 3) == want


def test_fractions_and_units():
    assert [metadata.fraction(x, 0.5) for x in (0.3, 30, 300)] == [0.3, 0.3, 0.5]
    assert metadata.custom_unit("h2o_1") == "mmol mol-1" and metadata.custom_unit("int_t_1") == "K"


def test_file_names(spark):
    df = spark.createDataFrame([("site20240229_1330.csv",), ("other.csv",)], "f string")
    got = [r[0] for r in df.select(raw.file_timestamp(F.col("f"), "siteyyyymmdd_HHMM.csv").cast("string")).collect()]
    assert got == ["2024-02-29 13:30:00", None]
    df = spark.createDataFrame([("x2024060.dat",)], "f string")
    assert df.select(raw.file_timestamp(F.col("f"), "xyyyydoy.dat").cast("string")).first()[0] == "2024-02-29 00:00:00"


def test_units(spark):
    site = metadata.SiteInfo(columns=(metadata.ColumnInfo("ts", unit_in="celsius"), metadata.ColumnInfo("w", conversion="gain_offset", gain=2.0, offset=1.0)))
    row = raw.standardise(spark.createDataFrame([(20.0, 3.0)], "ts double, w double"), site).first()
    assert (row["ts"], row["w"]) == (293.15, 7.0)


def test_biomet(spark):
    assert biomet.label_parts("TA_1_2_3") == ("TA", (1, 2, 3)) and biomet.label_parts("RH") == ("RH", (1, 1, 1))
    rows = spark.createDataFrame([(0, 1.0, 2.0), (900, 3.0, 4.0), (1800, 9.0, 9.0)], "ts long, TA double, P double")
    spine = spark.createDataFrame([(0, 1800), (3600, 5400)], "a long, b long")
    got = {r["a"]: r for r in biomet.aggregate_periods(rows, spine, "ts", "a", "b", ["TA", "P"]).collect()}
    assert (got[0]["TA"], got[0]["P"], got[3600]["TA"]) == (2.0, 6.0, None)


def test_sinks(spark, tmp_path):
    spine = spark.createDataFrame([(0,), (1,)], "period long")
    results = spark.createDataFrame([(1, 2.5)], "period long, h double")
    sinks.write_full_output(results, spine, str(tmp_path / "full"), units={"h": "W m-2"})
    back = sinks.read_essentials(spark, str(tmp_path / "full" / "data"), "period long, h double")
    assert sorted((r["period"], r["h"]) for r in back.collect()) == [(0, None), (1, 2.5)]
    sinks.write_network_file(results, str(tmp_path / "net"), {"h": (10.0, 1.0)})
    assert sinks.read_essentials(spark, str(tmp_path / "net"), "period long, h double").first()["h"] == 26.0


def test_biomet_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("DATE,TIME,Ta,Rh\nD,2024-03-01,0000,10,50\nE,2024-03-01,0030,1,1\nD,,2024-03-01,0030,x,60\nD,2024-03-01\nD,nonsense,0000,3,4\n")
    df = biomet.read_biomet(spark, str(tmp_path), ["Ta", "Rh"], [1, 2], "yyyy-mm-ddHHMM", label="D", step_seconds=1800, reference="begin")
    got = sorted(((r["ts"], r["Ta"], r["Rh"]) for r in df.collect()), key=str)
    assert got == [(1709253000, 10.0, 50.0), (1709254800, None, 60.0), (None, 3.0, 4.0)]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "e.csv").write_text("only a header\n")
    assert biomet.read_biomet(spark, str(tmp_path / "b"), ["Ta"], [1], "yyyymmdd").count() == 0


@pytest.mark.parametrize("nature, unit, label, value, want", [
    ("TEMPERATURE", "CF", "", 5000.0, 283.15), ("TEMPERATURE", "K", "", 280.0, 280.0), ("RELATIVE_HUMIDITY", "#", "", 0.5, 50.0), ("PRESSURE", "ATM", "", 1.0, 98066.5),
    ("PRECIPITATION", "mm", "", 3.0, 0.003), ("SPEED", "MM/S", "", 1500.0, 1.5), ("CONCENTRATION", "PPT", "CO2", 0.4, 400.0), ("CONCENTRATION", "PPM", "N2O", 0.3, 300.0), ("ANGLE", "C", "", 5.0, 5.0),
])
def test_biomet_units(spark, nature, unit, label, value, want):
    assert spark.range(1).select(biomet.to_standard(F.lit(value), nature, unit, label)).first()[0] == pytest.approx(want)


def test_dynamic_metadata(spark, tmp_path):
    (tmp_path / "dyn.csv").write_text("Date,Time,Canopy_Height,master_sonic_model,latitude\n2024-03-01,00:00,2,csi_csat3_1,45\n2024-03-02,12:00,x,hs_50_1,\nbad,row,9,9,9\n")
    dynamic = metadata.read_dynamic(spark, str(tmp_path / "dyn.csv"))
    rows = dynamic.orderBy("valid_from").collect()
    assert [(r["valid_from"], r["canopy_height"], r["master_sonic_model"]) for r in rows] == [(1709251200, 2.0, "csi_csat3_1"), (1709380800, None, "hs_50_1")]
    assert rows[0]["displacement_height"] == pytest.approx(1.34) and rows[0]["roughness_length"] == pytest.approx(0.3)
    periods = spark.createDataFrame([("a", 1709251199), ("a", 1709251200), ("a", 1709400000)], "station string, end long")
    known = metadata.SiteInfo(latitude=40.0, canopy_height=1.0)
    got = metadata.with_dynamic(periods, dynamic.withColumn("station", F.lit("a")), "end", ["station"], known).orderBy("end").collect()
    assert [(r["canopy_height"], r["latitude"], r["master_sonic_model"]) for r in got] == [(1.0, 40.0, None), (2.0, 45.0, "csi_csat3_1"), (1.0, 40.0, "hs_50_1")]
