"""Versions of the panel: only what was committed is read."""

import datetime

import pytest
from pyspark.sql import functions as F

from saleloom.schema import DATE, PANEL, QTY
from saleloom.sources.versions import PanelVersions, VersionConflict


def panel_of(spark, years, quantity=1):
    rows = [(datetime.date(y, m, 1), s, c, quantity) for y in years for m in range(1, 13) for s in ("A", "B", "C") for c in ("Bus", "Others")]
    return spark.createDataFrame(rows, PANEL)


def total(df):
    return df.agg(F.sum(QTY)).first()[0]


@pytest.fixture
def versions(spark, tmp_path):
    return PanelVersions(spark, f"file://{tmp_path}/panel")


def test_nothing_before_the_first_save(versions):
    assert versions.latest() == 0 and versions.log().count() == 0
    with pytest.raises(LookupError):
        versions.read()


def test_save_replace_and_roll_back(spark, versions):
    assert versions.save(panel_of(spark, [2000, 2001])) == 1
    assert versions.save(panel_of(spark, [2000, 2001, 2002], 2)) == 2
    assert versions.replace_years(panel_of(spark, [2001], 7)) == 3
    assert versions.roll_back(1) == 4
    assert [total(versions.read(v)) for v in (1, 2, 3, 4)] == [144, 432, 144 + 504 + 144, 144]
    assert total(versions.read(3, years=[2001])) == 504 and versions.read(3, years=[1999]).count() == 0
    shared = {y["write"] for y in versions.entry(2)["years"]} & {y["write"] for y in versions.entry(3)["years"]}
    assert len(shared) == 1  # two years of version 3 are files of version 2
    log = {r["version"]: r for r in versions.log().collect()}
    assert [log[v]["parent"] for v in (1, 2, 3, 4)] == [0, 1, 2, 3]
    assert all(versions.damage(v).count() == 0 for v in (1, 2, 3, 4))


def test_a_save_that_dies_is_no_version(spark, versions, tmp_path):
    versions.save(panel_of(spark, [2000]))

    @F.udf("long")
    def breaks(month):
        if month == 12:
            raise ValueError("the disk is gone")
        return 5

    with pytest.raises(Exception, match="the disk is gone"):
        versions.save(panel_of(spark, [2000, 2001]).withColumn(QTY, breaks(F.month(DATE))))
    assert versions.latest() == 1 and total(versions.read()) == 72
    versions._write(panel_of(spark, [2003], 100))  # dies between the files and the commit
    assert versions.latest() == 1 and total(versions.read()) == 72
    assert len(list((tmp_path / "panel/data").iterdir())) >= 2
    assert versions.save(panel_of(spark, [2000, 2001])) == 2 and total(versions.read()) == 144


def test_a_save_never_goes_over_a_newer_one(spark, versions):
    versions.save(panel_of(spark, [2000]))
    with pytest.raises(VersionConflict):
        versions._commit(0, "save", [])
    assert versions.latest() == 1


def test_lost_files_are_noticed(spark, versions, tmp_path):
    versions.save(panel_of(spark, [2000, 2001]))
    lost = next((tmp_path / "panel/data").glob("*/year=2001/*.parquet"))
    lost.unlink()
    spark.catalog.clearCache()
    assert [r["year"] for r in versions.damage().collect()] == [2001]


def test_status_reads_no_panel(spark, versions, tmp_path):
    versions.save(panel_of(spark, [2000]))
    versions.replace_years(panel_of(spark, [2001], 3))
    for f in (tmp_path / "panel/data").glob("*/*/*.parquet"):
        f.unlink()
    row = versions.status().first()
    assert (row["rows"], row["total_quantity"], row["states"], row["categories"], row["dates"]) == (144, 72 + 216, 3, 2, 24)
    assert (row["first_date"], row["last_date"]) == (datetime.date(2000, 1, 1), datetime.date(2001, 12, 1))


def test_empty_panel_and_null_dates(spark, versions):
    assert versions.save(spark.createDataFrame([], PANEL)) == 1
    assert versions.read().count() == 0 and versions.status().first()["rows"] == 0 and versions.damage().count() == 0
    versions.save(spark.createDataFrame([(None, "A", "Bus", 4), (datetime.date(2000, 1, 1), None, None, None)], PANEL))
    assert versions.read().count() == 2 and versions.damage().count() == 0
