"""Streaming queries. Each runs to the end of its input and equals the batch result."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saleloom.catalog import inputs
from saleloom.catalog.base import query, rounded
from saleloom.catalog.ingest import SHEET_SQL
from saleloom.catalog.panel_ops import KEY_SQL, UPSERT_SQL
from saleloom.operators import clean
from saleloom.schema import DATE
from saleloom.session import new_folder, stored
from saleloom.streaming import jobs


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, in the names of the live feed."""
    schema = inputs.table(spark, sf_dir, "events").schema
    stream = jobs.file_stream(spark, sf_dir, schema, pattern="events.parquet")
    return stream.select(F.col("event_id").alias("id"), jobs.as_event_time("ts").alias("timestamp"),
                         F.col("event_type").alias("vehicle_category"), F.col("value").alias("actual"))


def _stored_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored row per category."""
    events = inputs.table(spark, sf_dir, "events")
    return stored(events.groupBy(F.col("event_type").alias("vehicle_category"))
                  .agg(F.avg("value").alias("predicted")), "means")


@query("L1,A2,A4", SHEET_SQL)
def stream_sheet_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = new_folder(spark, "stream-sheets")
    inputs.wide_sheets(spark, sf_dir).repartition("sheet").write.csv(f"{work}/in")
    return jobs.ingest_sheets(spark, f"{work}/in", f"{work}/out", f"{work}/checkpoint", 3)


@query("L2", f'SELECT {KEY_SQL}, "EV_Sales_Quantity" FROM ({UPSERT_SQL})')
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pushes arrive as one file group per month, three files a batch."""
    work = new_folder(spark, "stream-upsert")
    start = clean.between_dates(inputs.panel(spark, sf_dir), before="2001-04-01")
    jobs.write_panel(start, f"{work}/panel")
    push = inputs.new_push(spark, sf_dir)
    push.repartition(F.trunc(DATE, "MM")).write.parquet(f"{work}/in")
    stream = jobs.file_stream(spark, f"{work}/in", push.schema, files_per_batch=3)
    return jobs.upsert_months(spark, stream, f"{work}/panel", f"{work}/checkpoint", inputs.SOURCE_ORDER)


@query("L3,A7", """SELECT id, CAST("timestamp" AS VARCHAR) AS "timestamp", vehicle_category, actual,
round(predicted, 6) AS predicted, round(error, 6) AS error FROM live_feed""")
def stream_scored_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = new_folder(spark, "stream-scored")
    scored = jobs.score_arrivals(_events(spark, sf_dir), _stored_means(spark, sf_dir), "vehicle_category")
    jobs.run_to_end(scored, f"{work}/checkpoint", sink=f"{work}/out")
    return rounded(spark.read.parquet(f"{work}/out").select(
        "id", "timestamp", "vehicle_category", "actual", "predicted", "error"))


@query("L3", """SELECT id, CAST(ts AS VARCHAR) AS "timestamp", vehicle_category, actual, round(p, 6) AS predicted,
round(abs(actual - p), 6) AS error, 1 AS scored_later FROM (SELECT event_id AS id, ts, event_type AS vehicle_category,
value AS actual, 40 + 0.5 * hour(ts) + length(event_type) AS p FROM events)""")
def stream_scored_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored pipeline scores the feed as it comes; each row carries the time of that."""
    work = new_folder(spark, "stream-model")
    inputs_of = SQLTransformer(statement="SELECT *, hour(timestamp) AS hour_of_day, length(vehicle_category) AS width FROM __THIS__")
    rule = SQLTransformer(statement="SELECT *, CAST(40 + 0.5 * hour_of_day + width AS DOUBLE) AS prediction FROM __THIS__")
    PipelineModel([inputs_of, rule]).save(f"{work}/model")
    scored = jobs.score_with_model(_events(spark, sf_dir), PipelineModel.load(f"{work}/model"))
    jobs.run_to_end(scored, f"{work}/checkpoint", sink=f"{work}/out")
    return rounded(spark.read.parquet(f"{work}/out").select(
        "id", "timestamp", "vehicle_category", "actual", "predicted", "error",
        (F.col("scored_at") >= F.col("timestamp")).cast("int").alias("scored_later")))


@query("L4,K17", """SELECT CAST(time_bucket(INTERVAL 5 MINUTE, "timestamp") AS VARCHAR) AS window_start, vehicle_category,
count(*) AS events, round(avg(error), 6) AS mae, round(avg(actual), 6) AS mean_actual FROM live_feed GROUP BY 1, 2""")
def stream_live_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = new_folder(spark, "stream-windows")
    scored = jobs.score_arrivals(_events(spark, sf_dir), _stored_means(spark, sf_dir), "vehicle_category")
    return rounded(jobs.live_windows(scored, f"{work}/out", f"{work}/checkpoint"))


@query("L5", """SELECT event_id AS id, CAST(ts AS VARCHAR) AS "timestamp", event_type AS vehicle_category, value AS actual FROM events""")
def stream_without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed arrives, then a third of it once more."""
    work = new_folder(spark, "stream-repeats")
    events = inputs.live_feed(spark, sf_dir).select("id", "timestamp", "vehicle_category", "actual")
    events.write.parquet(f"{work}/in")
    events.filter(F.col("id") % 3 == 0).write.mode("append").parquet(f"{work}/in")
    stream = jobs.file_stream(spark, f"{work}/in", events.schema, files_per_batch=1)
    once = jobs.without_repeats(stream, "id", f"{work}/out", f"{work}/checkpoint")
    return once.select("id", "timestamp", "vehicle_category", "actual")
