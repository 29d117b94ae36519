"""Reading the panel and its source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saleloom.operators import clean, merge
from saleloom.schema import PANEL, PANEL_KEY, QTY


def load_panel(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read panel files with a declared schema; alias columns get standard names.

    CSV columns are read as text and coerced, so a bad cell never fails the job.
    """
    if fmt == "csv":
        names = spark.read.option("header", True).csv(path).columns  # reads the header only
        text = T.StructType([T.StructField(c, T.StringType()) for c in names])
        raw = spark.read.schema(text).option("header", True).csv(path)
    else:
        raw = spark.read.format(fmt).load(path)
    named = clean.require_columns(clean.use_standard_names(raw))
    return clean.coerce_types(named).select(*[F.col(f.name).cast(f.dataType) for f in PANEL.fields])


def standardise(df: DataFrame) -> DataFrame:
    """Alias names, check columns, coerce types and sum duplicates."""
    named = clean.require_columns(clean.use_standard_names(df))
    return merge.sum_by_key(clean.coerce_types(named).select(*PANEL_KEY, QTY))


def data_files(spark: SparkSession, path: str, pattern: str = "*",
               after: str | None = None) -> DataFrame:
    """Files of a folder with size and time, office lock files (``~$``) skipped.

    ``after`` keeps files changed since that timestamp. Only file metadata is read.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
             .option("recursiveFileLookup", True).load(path)
             .select("path", "length", "modificationTime",
                     F.element_at(F.split("path", "/"), -1).alias("file")))
    files = files.filter(~F.col("file").startswith("~$"))
    if after is not None:
        files = files.filter(F.col("modificationTime") > F.lit(after).cast("timestamp"))
    return files


def without_lock_files(df: DataFrame) -> DataFrame:
    """Drop rows that were read from ``~$`` files."""
    return df.filter(~F.col("_metadata.file_name").startswith("~$"))


def read_many(spark: SparkSession, paths: list[str], fmt: str = "parquet") -> DataFrame:
    """Several panel files or folders in one scan each, united by name."""
    return merge.union_all(*[load_panel(spark, p, fmt) for p in paths])

