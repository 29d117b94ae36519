"""Structured Streaming forms of ingest, upsert, scoring and the live figures.

Every job takes its checkpoint folder from the caller and writes each micro-batch to
its own place, so a batch that runs again after a failure replaces its own output.
The trigger is a parameter; the default, ``availableNow``, reads what has arrived and
stops. Results do not depend on the order in which files arrive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from saleloom.operators import merge
from saleloom.operators.group_stats import attach
from saleloom.schema import DATE, PANEL, PANEL_KEY, QTY, RAW_SHEET
from saleloom.sources import sheets
from saleloom.streaming.levels import FANOUT, PartialSums


AVAILABLE_NOW = {"availableNow": True}


def start(stream: DataFrame, checkpoint: str, mode: str = "append",
          batch: Callable[[DataFrame, int], None] | None = None, sink: str | None = None,
          trigger: dict | None = None) -> StreamingQuery:
    """Start a job into ``batch`` per micro-batch or a parquet sink.

    ``trigger`` is what ``writeStream.trigger`` takes, such as ``{"processingTime": "2 seconds"}``.
    """
    writer = (stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode)
              .trigger(**(trigger or AVAILABLE_NOW)))
    if batch is not None:
        return writer.foreachBatch(batch).start()
    return writer.format("parquet").option("path", sink).start()


def run_to_end(stream: DataFrame, checkpoint: str, mode: str = "append",
               batch: Callable[[DataFrame, int], None] | None = None, sink: str | None = None) -> None:
    """Process everything that has arrived, then stop."""
    start(stream, checkpoint, mode, batch, sink).awaitTermination()


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet",
                pattern: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Files that arrive in a folder, each read once; office lock files are skipped."""
    reader = spark.readStream.schema(schema).format(fmt)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder).filter(~F.col("_metadata.file_name").startswith("~$"))


def ingest_sheets(spark: SparkSession, source: str, sink: str, checkpoint: str,
                  files_per_batch: int | None = None) -> DataFrame:
    """Sheets to long rows as files arrive. A sheet lies in one file and so in one
    batch. Input files stay where they are; the checkpoint remembers them."""
    def write(cells: DataFrame, batch_id: int) -> None:
        (sheets.months_by_position(cells).write.mode("overwrite")
         .parquet(f"{sink}/batch={batch_id}"))

    stream = file_stream(spark, source, RAW_SHEET, "csv", files_per_batch=files_per_batch)
    run_to_end(stream, checkpoint, batch=write)
    return spark.read.parquet(sink).drop("batch")


_DATED = T.StructType([*PANEL.fields, T.StructField("month", T.StringType())])


def _month() -> Column:
    return F.date_format(DATE, "yyyy-MM").alias("month")


def write_panel(panel: DataFrame, folder: str, version: int = -1) -> None:
    """Start a panel that ``upsert_months`` keeps: one folder per month, and which
    version of each month holds."""
    months = panel.select(*PANEL_KEY, QTY, _month())
    months.write.mode("overwrite").partitionBy("month").parquet(f"{folder}/version={version}")
    held = panel.sparkSession.read.schema(_DATED).parquet(f"{folder}/version={version}").select("month").distinct()
    _write_holding(held.withColumn("version", F.lit(version)), folder, version)


def _write_holding(holding: DataFrame, folder: str, version: int) -> None:
    holding.select("month", "version").coalesce(1).write.mode("overwrite").parquet(f"{folder}-months/as_of={version}")


def _holding(spark: SparkSession, folder: str, version: int) -> dict[str, int]:
    """Month -> version; one small row per calendar month."""
    rows = spark.read.schema("month string, version int").parquet(f"{folder}-months/as_of={version}").collect()
    return {r["month"]: r["version"] for r in rows}


def _months(spark: SparkSession, folder: str, held: dict[str, int]) -> DataFrame:
    paths = [f"{folder}/version={v}/month={m}" for m, v in sorted(held.items())]
    if not paths:
        return spark.createDataFrame([], PANEL)
    return spark.read.schema(PANEL).parquet(*paths)


def upsert_months(spark: SparkSession, pushes: DataFrame, folder: str, checkpoint: str,
                  order: list[str], trigger: dict | None = None) -> DataFrame:
    """Merge each batch of pushed rows into the panel, last row wins.

    Batch N reads and rewrites only the months it touches; the others keep their files.
    What it starts from is the list of month versions that batch N-1 left, so a batch
    that runs again gives the same. Returns the panel after the last batch.
    """
    def write(rows: DataFrame, batch_id: int) -> None:
        rows = rows.persist()
        try:
            held = _holding(spark, folder, batch_id - 1)
            touched = {r["month"] for r in rows.select(_month()).distinct().collect()}
            master = _months(spark, folder, {m: v for m, v in held.items() if m in touched})
            merged = merge.upsert_keep_last(master, rows, order)
            (merged.select("*", _month()).write.mode("overwrite").partitionBy("month")
             .parquet(f"{folder}/version={batch_id}"))
            held |= dict.fromkeys(touched, batch_id)
            _write_holding(spark.createDataFrame(sorted(held.items()), "month string, version int"), folder, batch_id)
        finally:
            rows.unpersist()

    start(pushes, checkpoint, batch=write, trigger=trigger).awaitTermination()
    return panel_as_of(spark, folder)


def panel_as_of(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The panel as batch ``version`` left it (-1: as it began), or as the last batch did."""
    if version is None:
        version = spark.read.parquet(f"{folder}-months").agg(F.max("as_of")).first()[0]
    return _months(spark, folder, _holding(spark, folder, version)).select(*PANEL_KEY, QTY)


def score_arrivals(events: DataFrame, means: DataFrame, key: str) -> DataFrame:
    """Stream-static join with the stored predictions (one row per key), error per row."""
    return (attach(events, means, [key])
            .withColumn("error", F.abs(F.col("actual") - F.col("predicted"))))


def score_with_model(events: DataFrame, model: PipelineModel, clock: Column | None = None) -> DataFrame:
    """Rows with the model's prediction, its error and the time of scoring.

    The pipeline makes its own inputs from the event columns, so that batch and stream
    score alike; ``clock`` is the time of the micro-batch by default.
    """
    scored = model.transform(events)
    made = [c for c in scored.columns if c not in events.columns and c != "prediction"]
    return (scored.drop(*made).withColumnRenamed("prediction", "predicted")
            .withColumn("error", F.abs(F.col("actual") - F.col("predicted")))
            .withColumn("scored_at", F.current_timestamp() if clock is None else clock))


WINDOW_SUMS = "window_start timestamp, {key} string, events long, error double, errors long, actual double, actuals long"


def window_sums(spark: SparkSession, folder: str, key: str = "vehicle_category", fanout: int = FANOUT) -> PartialSums:
    """The partial sums behind the live table."""
    return PartialSums(spark, folder, WINDOW_SUMS.format(key=key), ("window_start", key), fanout)


def live_windows(scored: DataFrame, folder: str, checkpoint: str, length: str = "5 minutes",
                 key: str = "vehicle_category", trigger: dict | None = None, fanout: int = FANOUT) -> DataFrame:
    """Count and errors per tumbling window and category, exact however late a row comes.

    Each micro-batch leaves its counts and sums per window and key; reading adds them
    up. There is no state and no row is too late. Batches that the stream has committed
    are merged in levels, so reading opens a bounded number of folders.
    """
    sums = window_sums(scored.sparkSession, folder, key, fanout)

    def write(rows: DataFrame, batch_id: int) -> None:
        sums.put(rows.groupBy(F.window("timestamp", length).alias("w"), key)
                 .agg(F.count(F.lit(1)).alias("events"), F.sum("error").alias("error"), F.count("error").alias("errors"),
                      F.sum("actual").alias("actual"), F.count("actual").alias("actuals"))
                 .select(F.col("w.start").alias("window_start"), key, "events", "error", "errors", "actual", "actuals"), batch_id)
        sums.compact(batch_id - 1)  # this batch may run again

    start(scored, checkpoint, batch=write, trigger=trigger).awaitTermination()
    return windows_so_far(scored.sparkSession, folder, key)


def windows_so_far(spark: SparkSession, folder: str, key: str = "vehicle_category") -> DataFrame:
    """The live table from the partial sums stored so far."""
    sums, zero = window_sums(spark, folder, key), F.lit(0).cast("long")
    return sums.read(sums.newest_batch()).select(
        "window_start", key, "events", (F.col("error") / F.nullif(F.col("errors"), zero)).alias("mae"),
        (F.col("actual") / F.nullif(F.col("actuals"), zero)).alias("mean_actual"))


def without_repeats(events: DataFrame, key: str, folder: str, checkpoint: str, time: str = "timestamp",
                    trigger: dict | None = None) -> DataFrame:
    """First arrival of each event, whatever its age; a repeat carries the event's own time.

    Stored rows lie by event date. A batch reads the keys of the dates it touches, drops
    what is there and adds the rest in its own place. A batch without rows leaves no file, so
    the schema of the stored rows is told, never read from them.
    """
    spark = events.sparkSession
    kept = T.StructType([*(f for f in events.schema.fields if f.name not in ("event_date", "batch")),
                         T.StructField("batch", T.LongType()), T.StructField("event_date", T.DateType())])

    def so_far() -> DataFrame:
        try:
            return spark.read.schema(kept).parquet(folder)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], kept)

    def write(rows: DataFrame, batch_id: int) -> None:
        dated = rows.withColumn("event_date", F.to_date(time)).dropDuplicates([key]).persist()
        try:
            fresh = dated
            if batch_id > 0:
                dates = [r[0] for r in dated.select("event_date").distinct().collect()]
                known = (so_far().filter((F.col("batch") < batch_id))
                         .filter(F.col("event_date").isin(dates) | F.col("event_date").isNull()).select(key))
                fresh = dated.join(known, key, "left_anti")
            fresh.write.mode("overwrite").partitionBy("event_date").parquet(f"{folder}/batch={batch_id}")
        finally:
            dated.unpersist()

    start(events, checkpoint, batch=write, trigger=trigger).awaitTermination()
    return so_far().drop("batch", "event_date")


def as_event_time(column: str) -> Column:
    """Watermarks need a zoned timestamp."""
    return F.col(column).cast("timestamp")
