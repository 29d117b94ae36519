"""Versions of the panel behind a log.

A version counts from the moment its one row stands in the log, and that row is the last thing a save
writes: data files come first, then figures by month, then one file of one row. A save that dies on the way
leaves files that no version names, and readers go through the log only, so nobody meets half a version.
Nothing is overwritten: the version before stays readable as the backup, and a roll-back is a new version
that names the files of an old one. A version lists its years, each with its folder, so that replacing some
years writes these alone and shares the rest with its parent.

One writer at a time: a save notes the version it starts from and refuses to commit over a newer one.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saleloom.schema import CATEGORY, DATE, PANEL, QTY, STATE

YEAR = T.StructType([
    T.StructField("year", T.IntegerType()), T.StructField("write", T.StringType()),
    T.StructField("files", T.LongType()), T.StructField("rows", T.LongType())])
LOG = T.StructType([
    T.StructField("version", T.LongType()), T.StructField("parent", T.LongType()), T.StructField("action", T.StringType()),
    T.StructField("saved_at", T.TimestampType()), T.StructField("years", T.ArrayType(YEAR))])
MONTHS = T.StructType([
    T.StructField("year", T.IntegerType()), T.StructField("month", T.IntegerType()), T.StructField("rows", T.LongType()),
    T.StructField("first_date", T.DateType()), T.StructField("last_date", T.DateType()), T.StructField("total", T.LongType()),
    T.StructField("states", T.BinaryType()), T.StructField("categories", T.BinaryType()), T.StructField("dates", T.BinaryType())])
SKETCH_BITS = 12
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)  # standard error of an estimate, as a share of the count


class VersionConflict(RuntimeError):
    """Another save has committed since this one began."""


@dataclass(frozen=True)
class PanelVersions:
    """The versions below one folder; every writing method returns the number of the version it made."""

    spark: SparkSession
    folder: str

    # ---- the log ---------------------------------------------------------------------

    def log(self) -> DataFrame:
        """One row for each version: version, parent, action, saved_at and years."""
        try:
            return self.spark.read.schema(LOG).parquet(f"{self.folder}/log")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], LOG)

    def latest(self) -> int:
        """The newest version, 0 before the first."""
        return self.log().agg(F.coalesce(F.max("version"), F.lit(0).cast("long"))).first()[0]

    def entry(self, version: int | None = None) -> Row:
        """The log's row of a version, the newest one if none is named; it has one item for each year."""
        number = self.latest() if version is None else version
        row = self.log().filter(F.col("version") == number).first()
        if row is None:
            raise LookupError(f"version {number} was never committed")
        return row

    def _commit(self, parent: int, action: str, years: list[Row]) -> int:
        if self.latest() != parent:
            raise VersionConflict(f"version {self.latest()} was committed after version {parent}")
        row = self.spark.createDataFrame([(parent + 1, parent, action, None, years)], LOG)
        row.withColumn("saved_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.folder}/log")
        return parent + 1

    # ---- writing -----------------------------------------------------------------------

    def _write(self, panel: DataFrame) -> list[Row]:
        """Data files and figures by month; what the log is going to say about their years."""
        write = uuid.uuid4().hex
        (panel.select(DATE, STATE, CATEGORY, QTY).withColumn("year", F.year(DATE)).repartition("year", STATE)
         .sortWithinPartitions("year", STATE, CATEGORY, DATE)
         .write.partitionBy("year").parquet(f"{self.folder}/data/{write}"))
        kept = self.spark.read.schema(T.StructType([*PANEL.fields, T.StructField("year", T.IntegerType())])).parquet(
            f"{self.folder}/data/{write}")
        (kept.groupBy("year", F.month(DATE).alias("month")).agg(
            F.count(F.lit(1)).alias("rows"), F.min(DATE).alias("first_date"), F.max(DATE).alias("last_date"),
            F.sum(QTY).alias("total"), *[F.hll_sketch_agg(c, F.lit(SKETCH_BITS)).alias(name) for c, name in (
                (STATE, "states"), (CATEGORY, "categories"), (F.unix_date(DATE), "dates"))])
         .coalesce(1).write.partitionBy("year").parquet(f"{self.folder}/months/{write}"))
        by_file = kept.groupBy("year", F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("rows"))
        return (by_file.groupBy("year").agg(F.lit(write).alias("write"), F.count(F.lit(1)).alias("files"),
                                            F.sum("rows").alias("rows")).orderBy("year").collect())

    def save(self, panel: DataFrame) -> int:
        """The whole panel as a new version. An empty panel is a version without years."""
        parent = self.latest()
        return self._commit(parent, "save", self._write(panel))

    def replace_years(self, panel: DataFrame) -> int:
        """A new version in which the years of ``panel`` stand as they do there, and the others as before."""
        parent = self.latest()
        before = self.entry(parent)["years"] if parent else []
        written = self._write(panel)
        new = {y["year"] for y in written}
        return self._commit(parent, "replace years", [y for y in before if y["year"] not in new] + written)

    def roll_back(self, version: int) -> int:
        """A new version that holds what ``version`` held; no data is written."""
        parent = self.latest()
        return self._commit(parent, f"roll back to {version}", self.entry(version)["years"])

    # ---- reading -----------------------------------------------------------------------

    def _folders(self, kind: str, entry: Row, years: list[int] | None = None) -> list[str]:
        named = {None: "__HIVE_DEFAULT_PARTITION__"}
        return [f"{self.folder}/{kind}/{y['write']}/year={named.get(y['year'], y['year'])}"
                for y in entry["years"] if years is None or y["year"] in years]

    def read(self, version: int | None = None, years: list[int] | None = None) -> DataFrame:
        """The panel of a version, or some of its years; other years' files are not opened."""
        folders = self._folders("data", self.entry(version), years)
        return self.spark.read.schema(PANEL).parquet(*folders) if folders else self.spark.createDataFrame([], PANEL)

    def damage(self, version: int | None = None) -> DataFrame:
        """Years of a version whose files or rows are not those that the log names."""
        entry = self.entry(version)
        told = self.spark.createDataFrame(entry["years"], YEAR)
        there = (self.read(version).groupBy(F.year(DATE).alias("_year"), F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n"))
                 .groupBy("_year").agg(F.count(F.lit(1)).alias("found_files"), F.sum("n").alias("found_rows")))
        met = told.join(there, F.col("year").eqNullSafe(F.col("_year")), "left").drop("_year").fillna(0, ["found_files", "found_rows"])
        return met.filter("files <> found_files OR rows <> found_rows")

    def months(self, version: int | None = None) -> DataFrame:
        """The stored figures of every month of a version, sketches of its states, categories and dates among them."""
        folders = self._folders("months", self.entry(version))
        stored = T.StructType([f for f in MONTHS.fields if f.name != "year"])
        if not folders:
            return self.spark.createDataFrame([], stored)
        return self.spark.read.schema(stored).parquet(*folders)

    def status(self, version: int | None = None) -> DataFrame:
        """Row count, date range, total and distinct counts from the months' figures; the panel is not read.

        Distinct counts are estimates of merged sketches.
        """
        def distinct(name: str):
            return F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(name)), F.lit(0).cast("long")).alias(name)

        return self.months(version).agg(
            F.coalesce(F.sum("rows"), F.lit(0).cast("long")).alias("rows"), F.min("first_date").alias("first_date"),
            F.max("last_date").alias("last_date"), F.sum("total").alias("total_quantity"),
            distinct("states"), distinct("categories"), distinct("dates"))
