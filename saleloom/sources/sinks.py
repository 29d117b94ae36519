"""Writing forecasts and scored rows. Nothing is overwritten in place; ``versions`` keeps the panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleloom.schema import CATEGORY, STATE


def append_scored(scored: DataFrame, folder: str, stamp: str) -> None:
    """Append rows with their error and the time of scoring."""
    (scored.withColumn("error", F.abs(F.col("actual") - F.col("predicted")))
     .withColumn("scored_at", F.lit(stamp).cast("timestamp"))
     .write.mode("append").parquet(folder))


def write_forecast(forecast: DataFrame, folder: str) -> None:
    """One sub-folder and one file per series: a forecast has a few hundred rows of each."""
    (forecast.repartition(STATE, CATEGORY)
     .write.partitionBy(STATE, CATEGORY).parquet(folder))
