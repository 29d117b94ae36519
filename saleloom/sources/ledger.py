"""Which files are new: a ledger of path, size and time that a listing is held against.

The ledger is a table that only grows: each ``note`` adds the files that are new, changed or gone since the
last one, with the number of the note. What is known is the newest line of each path, so a note writes what
has happened and never the whole listing again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES = "path string, length long, modificationTime timestamp, status string, note long"


def difference(listing: DataFrame, known: DataFrame) -> DataFrame:
    """path, length, modificationTime and status of every file of both: new, changed, gone or unchanged.

    Gone files show what was known of them. A file whose size or time differs has changed.
    """
    old = known.select(F.col("path").alias("_path"), F.col("length").alias("_length"), F.col("modificationTime").alias("_time"))
    both = listing.select("path", "length", "modificationTime").dropDuplicates(["path"]).join(old, F.col("path") == F.col("_path"), "full")
    same = F.col("length").eqNullSafe(F.col("_length")) & F.col("modificationTime").eqNullSafe(F.col("_time"))
    status = (F.when(F.col("_path").isNull(), "new").when(F.col("path").isNull(), "gone")
              .when(same, "unchanged").otherwise("changed"))
    return both.select(F.coalesce("path", "_path").alias("path"), F.coalesce("length", "_length").alias("length"),
                       F.coalesce("modificationTime", "_time").alias("modificationTime"), status.alias("status"))


@dataclass(frozen=True)
class Ledger:
    """The lines below one folder."""

    spark: SparkSession
    folder: str

    def lines(self) -> DataFrame:
        try:
            return self.spark.read.schema(LINES).parquet(self.folder)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], LINES)

    def known(self) -> DataFrame:
        """path, length and modificationTime of the files that were there at the last note."""
        last = self.lines().groupBy("path").agg(F.max_by(F.struct("length", "modificationTime", "status"), "note").alias("f"))
        return last.filter("f.status <> 'gone'").select("path", "f.length", "f.modificationTime")

    def compare(self, listing: DataFrame) -> DataFrame:
        """The listing against the ledger; see ``difference``."""
        return difference(listing, self.known())

    def note(self, listing: DataFrame) -> int:
        """Write down what has happened; returns the number of the note.

        Reading ``compare`` again afterwards shows all files unchanged. A note that dies leaves nothing.
        """
        number = self.lines().agg(F.coalesce(F.max("note"), F.lit(0).cast("long")) + 1).first()[0]
        happened = self.compare(listing).filter("status <> 'unchanged'").withColumn("note", F.lit(number).cast("long"))
        happened.write.mode("append").parquet(self.folder)
        return number
