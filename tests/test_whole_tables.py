"""Cases in which an operator once did less than the whole job."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_catalog import SF, canonical
from turbula import catalog
from turbula.operators import spectra


@pytest.mark.parametrize("name", ["bpcf_analytic", "bpcf_closed_forms", "thermo_state"])
def test_every_event_has_its_period(spark, name):
    """A row for each event, as in the catalog's SQL."""
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{SF}/events.parquet'")
    ours = canonical(catalog.QUERIES[name](spark, SF).toPandas())
    theirs = canonical(con.execute(catalog.ORACLES[name]).df())
    assert len(ours) == con.execute("select count(*) from events").fetchone()[0]
    pd.testing.assert_frame_equal(ours, theirs, check_dtype=False, atol=2e-6, rtol=1e-9)


@pytest.mark.parametrize("n", [4095, 4097, 8191, 18_000])
def test_spectrum_of_all_records_of_a_period(spark, n):
    x = np.random.default_rng(n).normal(size=n)
    x[-n // 3 :] *= 5
    df = spark.createDataFrame(pd.DataFrame({"period": 0, "rec": np.arange(n), "x": x}))
    count, total = spectra.cospectra(df, "period", "rec", [("x", "x")], 10.0, "squared").agg(F.count("*"), F.sum("density")).first()
    assert count == n // 2 and total * 10.0 / n == pytest.approx(x.var(), rel=1e-9)
    cut = 1 << (n.bit_length() - 1)
    assert spectra.cospectra(df, "period", "rec", [("x", "x")], 10.0, cut_to_power_of_two=True).count() == cut // 2


def test_missing_share_counts_all_records(spark):
    x = np.random.default_rng(0).normal(size=6000)
    x[3500:] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"period": 0, "rec": np.arange(6000), "x": x}))
    assert spectra.cospectra(df, "period", "rec", [("x", "x")], 10.0).count() == 0


def test_periods_of_several_windows(spark):
    """The smallest table's periods are shorter than a window; the next one's hold several."""
    con = duckdb.connect()
    con.execute("create view events as select * from '/root/testdata/sf0.01/events.parquet'")
    ours = canonical(catalog.QUERIES["qc_resolution_and_dropouts"](spark, "/root/testdata/sf0.01").toPandas())
    theirs = canonical(con.execute(catalog.ORACLES["qc_resolution_and_dropouts"]).df())
    assert (ours["empty_percent"] > 0).all()
    pd.testing.assert_frame_equal(ours, theirs, check_dtype=False, atol=2e-6, rtol=1e-9)
