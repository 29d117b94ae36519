"""Sources, sinks, cleaning and projection queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saleloom.catalog import inputs
from saleloom.catalog.base import query, r6, rounded
from saleloom.functions import rules
from saleloom.operators import clean, merge, position, summary
from saleloom.schema import CATEGORY, DATE, PANEL_KEY, PRED, QTY, STATE
from saleloom.session import cut_lineage, new_folder
from saleloom.sources import panel as panel_source
from saleloom.sources import sheets, sinks
from saleloom.sources.ledger import Ledger
from saleloom.sources.versions import SKETCH_ERROR, PanelVersions

PANEL_SQL = 'SELECT "Date", "State", "Vehicle_Category", "EV_Sales_Quantity" FROM panel'
DATE_TEXT = 'CAST("Date" AS VARCHAR) AS "Date"'
KEY_SQL = f'{DATE_TEXT}, "State", "Vehicle_Category"'

SHEET_SQL = """
SELECT "State", CASE "Vehicle_Category" WHEN '2-Wheelers' THEN 'TWO WHEELER(NT)'
         WHEN '3-Wheelers' THEN 'THREE WHEELER(T)' WHEN '4-Wheelers' THEN 'MOTOR CAR'
         WHEN 'Bus' THEN 'BUS' ELSE 'HEAVY GOODS VEHICLE' END AS "Vehicle_Class",
       "Vehicle_Category",
       upper(strftime("Date", '%b')) AS "Month_Name", "EV_Sales_Quantity", 2000 AS "Year"
FROM monthly WHERE "Year" = 2000 AND "EV_Sales_Quantity" > 0"""


@query("A1", f'SELECT {KEY_SQL}, "EV_Sales_Quantity" FROM panel')
def load_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the panel as CSV, load it with declared types."""
    path = new_folder(spark, "panel-csv")
    inputs.panel(spark, sf_dir).write.option("header", True).csv(path)
    return panel_source.load_panel(spark, path, "csv")


@query("A2", """SELECT count(*) AS data_files FROM
(SELECT DISTINCT year("Date") AS y, "Vehicle_Category" FROM panel)""")
def discover_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data files by partition folder; names starting with ~$ are skipped."""
    path = new_folder(spark, "discover")
    (inputs.panel(spark, sf_dir).withColumn("y", F.year(DATE)).repartition("y", CATEGORY)
     .write.partitionBy("y", CATEGORY).parquet(path))
    files = panel_source.data_files(spark, path, "*.parquet")
    return files.agg(F.count_distinct(F.regexp_replace("path", "/[^/]*$", "")).alias("data_files"))


@query("A2,L1", f"""WITH f AS (SELECT DISTINCT year("Date") AS y, "Vehicle_Category" AS c FROM panel),
s AS (SELECT CASE WHEN y = year(DATE '{inputs.PUSH_FROM}') THEN 'new' WHEN c = 'Bus' THEN 'gone'
WHEN y = {inputs.PATTERN_YEAR} THEN 'changed' ELSE 'unchanged' END AS status FROM f WHERE NOT (c = 'Bus' AND y = year(DATE '{inputs.PUSH_FROM}')))
SELECT status, count(*) AS files, CASE WHEN status = 'gone' THEN 0 ELSE count(*) END AS unchanged_after_note FROM s GROUP BY 1""")
def file_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two listings of the panel's files: a year arrives, one year is written anew, a category goes.

    The ledger notes the first listing and is asked about the second, then notes that one too.
    """
    path, ledger = new_folder(spark, "listing"), Ledger(spark, new_folder(spark, "ledger"))
    (inputs.panel(spark, sf_dir).withColumn("y", F.year(DATE)).repartition("y", CATEGORY)
     .write.partitionBy("y", CATEGORY).parquet(path))
    files = panel_source.data_files(spark, path, "*.parquet").withColumn(
        "y", F.regexp_extract("path", "y=([0-9]+)/", 1).cast("int")).withColumn("bus", F.col("path").contains("=Bus/"))
    arrived = F.col("y") == F.year(F.lit(inputs.PUSH_FROM).cast("date"))
    ledger.note(files.filter(~arrived))
    later = F.when(F.col("y") == inputs.PATTERN_YEAR, F.col("modificationTime") + F.expr("INTERVAL 1 MINUTE")).otherwise(F.col("modificationTime"))
    second = files.filter(~F.col("bus")).withColumn("modificationTime", later)
    told = cut_lineage(ledger.compare(second))
    ledger.note(second)
    still = ledger.compare(second).filter("status = 'unchanged'").select(F.col("path").alias("_path"))
    return (told.join(still, F.col("path") == F.col("_path"), "left").groupBy("status")
            .agg(F.count(F.lit(1)).alias("files"), F.count("_path").alias("unchanged_after_note")))


@query("A3,G12", SHEET_SQL)
def sheet_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.months_by_position(inputs.wide_sheets(spark, sf_dir), default_year=1900)


@query("A3", f"""SELECT "State", "Vehicle_Class", "Month_Name", "EV_Sales_Quantity", "Year"
FROM ({SHEET_SQL}) WHERE "Month_Name" IN ('JAN','FEB','MAR','APR','MAY','JUN','JUL','AUG')""")
def sheet_to_long_named_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = inputs.wide_sheets(spark, sf_dir, months=8, commas=False)
    return sheets.months_by_name_row(cells, default_year=1900)


@query("A4", f"""SELECT "State", "Vehicle_Category", count(*) AS cells,
CAST(sum("EV_Sales_Quantity") AS BIGINT) AS total FROM ({SHEET_SQL}) GROUP BY ALL""")
def sheets_from_many_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One CSV file per sheet, all read in one scan."""
    path = new_folder(spark, "sheets")
    inputs.wide_sheets(spark, sf_dir).repartition("sheet").write.csv(path)
    long = sheets.months_by_position(sheets.read_sheets(spark, path))
    return long.groupBy(STATE, CATEGORY).agg(F.count(F.lit(1)).alias("cells"), F.sum(QTY).alias("total"))


@query("A5,A6", f"""SELECT year("Date") AS year, count(*) AS rows_written,
CAST(sum("EV_Sales_Quantity") AS BIGINT) AS total, 1 AS backup_kept
FROM panel GROUP BY 1""")
def save_panel_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots: the second is read, the first stays readable as backup."""
    versions = PanelVersions(spark, new_folder(spark, "panel"))
    panel = inputs.stored_panel(spark, sf_dir)
    first = versions.save(clean.between_dates(panel, before=inputs.PUSH_FROM))
    versions.save(panel)
    kept = versions.read(first).agg((F.count(F.lit(1)) > 0).cast("int")).scalar()
    return (versions.read().groupBy(F.year(DATE).alias("year"))
            .agg(F.count(F.lit(1)).alias("rows_written"), F.sum(QTY).alias("total"))
            .withColumn("backup_kept", kept))


@query("A5,A6", f"""WITH y AS (SELECT year("Date") AS y, count(*) AS n, CAST(sum("EV_Sales_Quantity") AS BIGINT) AS q FROM panel GROUP BY 1),
v AS (SELECT 1 AS version, 0 AS parent, 'save' AS action, y, n, q FROM y WHERE y < year(DATE '{inputs.PUSH_FROM}')
UNION ALL SELECT 2, 1, 'save', y, n, q FROM y
UNION ALL SELECT 3, 2, 'replace years', y, n, CASE WHEN y = {inputs.PATTERN_YEAR} THEN 2 * q ELSE q END FROM y
UNION ALL SELECT 4, 3, 'roll back to 2', y, n, q FROM y)
SELECT version, parent, action, count(*) AS years, CAST(sum(n) AS BIGINT) AS rows_named, CAST(sum(n) AS BIGINT) AS rows_read,
CAST(sum(q) AS BIGINT) AS total, 0 AS damaged_years FROM v GROUP BY ALL""")
def panel_version_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Save, save more, replace one year, roll back: what the log names and what reading each version gives."""
    versions = PanelVersions(spark, new_folder(spark, "panel"))
    panel = inputs.stored_panel(spark, sf_dir)
    versions.save(clean.between_dates(panel, before=inputs.PUSH_FROM))
    second = versions.save(panel)
    changed = panel.filter(F.year(DATE) == inputs.PATTERN_YEAR).withColumn(QTY, 2 * F.col(QTY))
    versions.replace_years(changed)
    last = versions.roll_back(second)
    read = None
    for number in range(1, last + 1):
        one = versions.read(number).agg(F.count(F.lit(1)).alias("rows_read"), F.sum(QTY).alias("total")).select(
            F.lit(number).alias("_version"), "*", F.lit(versions.damage(number).count()).alias("damaged_years"))
        read = one if read is None else read.unionByName(one)
    told = versions.log().select("version", "parent", "action", F.size("years").alias("years"),
                                 F.aggregate("years", F.lit(0).cast("long"), lambda n, y: n + y["rows"]).alias("rows_named"))
    return told.join(read, told["version"] == read["_version"]).drop("_version")


@query("A11,D14", """SELECT count(*) AS rows, CAST(min("Date") AS VARCHAR) AS first_date, CAST(max("Date") AS VARCHAR) AS last_date,
CAST(sum("EV_Sales_Quantity") AS BIGINT) AS total_quantity, count(DISTINCT "State") AS states,
count(DISTINCT "Vehicle_Category") AS categories, count(DISTINCT "Date") AS dates, 1 AS states_within_bound,
1 AS categories_within_bound, 1 AS dates_within_bound FROM panel""")
def status_from_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status from the months' stored figures; exact distinct counts stand beside, and estimates keep within three standard errors."""
    versions = PanelVersions(spark, new_folder(spark, "panel"))
    panel = inputs.stored_panel(spark, sf_dir)
    versions.save(panel)
    names = {"states": STATE, "categories": CATEGORY, "dates": DATE}
    exact = panel.agg(*[F.count_distinct(c).alias(n) for n, c in names.items()]).first()
    near = [(F.abs(F.col(n) - exact[n]) <= 3 * SKETCH_ERROR * exact[n]).cast("int").alias(f"{n}_within_bound") for n in names]
    return versions.status().select(
        "rows", "first_date", "last_date", "total_quantity", *[F.lit(exact[n]).alias(n) for n in names], *near)


@query("A7", f"""SELECT vehicle_category, count(*) AS rows_written,
round(avg(error), 6) AS mean_error FROM live_feed GROUP BY 1""")
def append_scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append the feed in two batches and read the table back."""
    folder = new_folder(spark, "scored")
    feed = inputs.live_feed(spark, sf_dir).drop("error")
    for part, stamp in ((0, "2024-02-01"), (1, "2024-02-02")):
        sinks.append_scored(feed.filter(F.col("id") % 2 == part), folder, stamp)
    return spark.read.parquet(folder).groupBy("vehicle_category").agg(
        F.count(F.lit(1)).alias("rows_written"), r6(F.avg("error")).alias("mean_error"))


@query("A8", """SELECT id, CAST("timestamp" AS VARCHAR) AS "timestamp", vehicle_category, actual
FROM live_feed ORDER BY live_feed."timestamp" DESC, id DESC LIMIT 500""")
def newest_feed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = inputs.live_feed(spark, sf_dir).select("id", "timestamp", "vehicle_category", "actual")
    return summary.newest(feed, 500, ["timestamp", "id"])


@query("A9", f"""SELECT "State", "Vehicle_Category", count(*) AS days,
round(sum("Predicted_Sales"), 6) AS total FROM predictions
WHERE "Date" >= DATE '2001-01-01' GROUP BY ALL""")
def forecast_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast written per series and read back by partition."""
    folder = new_folder(spark, "forecast")
    rows = clean.between_dates(inputs.predictions(spark, sf_dir), start=inputs.TEST_FROM)
    sinks.write_forecast(rows.select(DATE, STATE, CATEGORY, PRED), folder)
    return (spark.read.parquet(folder).groupBy(STATE, CATEGORY)
            .agg(F.count(F.lit(1)).alias("days"), r6(F.sum(PRED)).alias("total")))


@query("A11", """SELECT count(*) AS rows, CAST(min("Date") AS VARCHAR) AS first_date,
CAST(max("Date") AS VARCHAR) AS last_date, count(DISTINCT "State") AS states,
count(DISTINCT "Vehicle_Category") AS categories,
CAST(sum("EV_Sales_Quantity") AS BIGINT) AS total_quantity FROM panel""")
def panel_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.status(inputs.panel(spark, sf_dir))


@query("B1,B2,B3", f"""SELECT {KEY_SQL}, CAST(sum("EV_Sales_Quantity") AS BIGINT) AS "EV_Sales_Quantity" FROM (
SELECT "Date", "State", coalesce("Vehicle_Class", 'Unknown') AS "Vehicle_Category",
CASE WHEN l_partkey % 11 = 0 THEN 0 ELSE "EV_Sales_Quantity" END AS "EV_Sales_Quantity"
FROM raw_sales WHERE l_orderkey % 13 <> 0)
GROUP BY ALL""")
def standardise_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source names and dirty cells: bad dates drop the row, bad numbers count 0."""
    raw = inputs.raw_sales(spark, sf_dir)
    dirty = raw.select(
        F.when(F.col("l_orderkey") % 13 == 0, "n/a").otherwise(F.col(DATE).cast("string"))
        .alias("Registration Date"),
        STATE, F.coalesce("Vehicle_Class", F.lit("Unknown")).alias("Vehicle Category"),
        F.when(F.col("l_partkey") % 11 == 0, "many").otherwise(F.col(QTY).cast("string"))
        .alias("Registrations"))
    return panel_source.standardise(dirty)


@query("B4", """SELECT count(*) AS rows_before,
count(*) FILTER (WHERE "State" = 'Unknown') AS unknown_state,
count(*) FILTER (WHERE "Vehicle_Class" IS NULL) AS unknown_category,
count(*) FILTER (WHERE "State" <> 'Unknown' AND "Vehicle_Class" IS NOT NULL) AS rows_after,
count(*) FILTER (WHERE NOT ("State" <> 'Unknown' AND "Vehicle_Class" IS NOT NULL)) AS removed
FROM raw_sales""")
def unknown_rows_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.removal_report(inputs.raw_sales(spark, sf_dir), "Vehicle_Class")


@query("B4", f"""SELECT {DATE_TEXT}, "State", "Vehicle_Class", "EV_Sales_Quantity"
FROM raw_sales WHERE "State" <> 'Unknown' AND "Vehicle_Class" IS NOT NULL""")
def drop_unknown_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.drop_unknown(inputs.raw_sales(spark, sf_dir), "Vehicle_Class").select(
        DATE, STATE, "Vehicle_Class", QTY)


@query("B5", """SELECT coalesce("Vehicle_Class", 'Unknown') AS "Vehicle_Class", count(*) AS n
FROM raw_sales GROUP BY 1""")
def fill_unknown_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = clean.fill_unknown(inputs.raw_sales(spark, sf_dir), "Vehicle_Class")
    return filled.groupBy("Vehicle_Class").agg(F.count(F.lit(1)).alias("n"))


@query("B6,G12", """SELECT "Vehicle_Class", CASE
WHEN upper(trim("Vehicle_Class")) IN ('TWO WHEELER(NT)', 'TWO WHEELER(T)') THEN '2-Wheelers'
WHEN upper(trim("Vehicle_Class")) IN ('THREE WHEELER(T)', 'THREE WHEELER(NT)', 'E-RICKSHAW(P)', 'E-RICKSHAW WITH CART (G)') THEN '3-Wheelers'
WHEN upper(trim("Vehicle_Class")) IN ('MOTOR CAR', 'LIGHT MOTOR VEHICLE') THEN '4-Wheelers'
WHEN upper(trim("Vehicle_Class")) IN ('BUS', 'HEAVY PASSENGER VEHICLE') THEN 'Bus'
WHEN regexp_matches(upper("Vehicle_Class"), 'TWO WHEELER|M-CYCLE|SCOOTER') THEN '2-Wheelers'
WHEN regexp_matches(upper("Vehicle_Class"), 'THREE WHEELER|RICKSHAW') THEN '3-Wheelers'
WHEN regexp_matches(upper("Vehicle_Class"), 'MOTOR CAR|LMV|JEEP') THEN '4-Wheelers'
WHEN regexp_matches(upper("Vehicle_Class"), 'BUS') THEN 'Bus'
ELSE 'Others' END AS "Vehicle_Category", count(*) AS n,
CAST(sum("EV_Sales_Quantity") AS BIGINT) AS total FROM raw_sales GROUP BY ALL""")
def category_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = inputs.raw_sales(spark, sf_dir)
    return (raw.groupBy("Vehicle_Class", rules.category_by_rules(F.col("Vehicle_Class")).alias(CATEGORY))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(QTY).alias("total")))


LOOKUP_SQL = """SELECT "Vehicle_Class", CASE
WHEN "Vehicle_Class" IN ('2-Wheelers', '3-Wheelers', '4-Wheelers', 'Bus', 'Others') THEN "Vehicle_Class"
WHEN "Vehicle_Class" IN ('TWO WHEELER(NT)', 'TWO WHEELER (INVALID CARRIAGE)', 'MOTOR CYCLE/SCOOTER-USED FOR HIRE', 'M-CYCLE/SCOOTER') THEN '2-Wheelers'
WHEN "Vehicle_Class" IN ('THREE WHEELER(T)', 'THREE WHEELER(NT)') THEN '3-Wheelers'
WHEN "Vehicle_Class" IN ('MOTOR CAR', 'MOTOR CAB', 'LIGHT MOTOR VEHICLE'{more}) THEN '4-Wheelers'
WHEN "Vehicle_Class" IN ('BUS', 'HEAVY PASSENGER VEHICLE', 'MEDIUM PASSENGER VEHICLE') THEN 'Bus'
ELSE 'Others' END AS "Vehicle_Category", count(*) AS n FROM (
SELECT CASE WHEN l_suppkey % 5 = 0 THEN 'Bus' WHEN l_suppkey % 5 = 1 THEN 'LIGHT PASSENGER VEHICLE'
ELSE "Vehicle_Class" END AS "Vehicle_Class" FROM raw_sales) GROUP BY ALL"""


def _class_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = F.col("l_suppkey") % 5
    return inputs.raw_sales(spark, sf_dir).select(
        F.when(supplier == 0, "Bus").when(supplier == 1, "LIGHT PASSENGER VEHICLE")
        .otherwise(F.col("Vehicle_Class")).alias("Vehicle_Class"))


def _by_lookup(spark: SparkSession, sf_dir: str, trainer: bool) -> DataFrame:
    category = rules.category_by_lookup(F.col("Vehicle_Class"), trainer)
    return (_class_mix(spark, sf_dir).groupBy("Vehicle_Class", category.alias(CATEGORY))
            .agg(F.count(F.lit(1)).alias("n")))


@query("B7", LOOKUP_SQL.format(more=", 'FOUR WHEELER (INVALID CARRIAGE)', 'LIGHT PASSENGER VEHICLE'"))
def category_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_lookup(spark, sf_dir, trainer=False)


@query("B7", LOOKUP_SQL.format(more=""))
def category_lookup_of_trainer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_lookup(spark, sf_dir, trainer=True)


@query("B8", """SELECT DISTINCT "State" AS state_found, 2000 AS year_found FROM panel""")
def state_from_sheet_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = inputs.wide_sheets(spark, sf_dir).filter(F.col("row_no") == 0)
    return headers.select(rules.state_from_header(F.col("c0")).alias("state_found"),
                          rules.year_from_header(F.col("c0"), 1900).alias("year_found"))


@query("B9", """SELECT c_custkey, replace(replace(replace(
  replace(c_name, '#', ' & ') || ' ' || c_mktsegment, ' & ', 'And'), ' ', ''), '-', '') AS state_key
FROM customer""")
def clean_state_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.replace("c_name", F.lit("#"), F.lit(" & ")), F.lit(" "), F.col("c_mktsegment"))
    return inputs.table(spark, sf_dir, "customer").select(
        "c_custkey", rules.state_key(name).alias("state_key"))


@query("B10", """SELECT "State", "Vehicle_Category", CAST("Date" AS VARCHAR) AS first_of_month,
CAST(make_date("Year", "Month", 15) AS VARCHAR) AS mid_month,
CASE WHEN "Month" = 7 THEN '2025-01-01' ELSE CAST(make_date("Year", "Month", 15) AS VARCHAR) END
  AS mid_month_or_default FROM monthly""")
def month_name_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = inputs.monthly(spark, sf_dir).withColumn(
        "name", F.element_at(F.array(*[F.lit(m) for m in rules.MONTHS]), F.col("Month")))
    blank_july = F.when(F.col("Month") != 7, F.col("name"))
    year = F.col("Year")
    return named.select(
        STATE, CATEGORY, rules.month_date(year, F.col("name")).alias("first_of_month"),
        rules.month_date(year, F.col("name"), 15).alias("mid_month"),
        rules.mid_month_or_default(year, blank_july, "2025-01-01").alias("mid_month_or_default"))


@query("B11", f"""SELECT CAST(CAST("Date" + INTERVAL 1 YEAR AS DATE) AS VARCHAR) AS "Date", "State",
"Vehicle_Category", 0 AS "EV_Sales_Quantity" FROM panel WHERE year("Date") = 2000""")
def prior_year_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.next_year_template(inputs.stored_panel(spark, sf_dir), 2000)


@query("B11,E6", f"""SELECT CAST(CAST("Date" + INTERVAL 1 YEAR AS DATE) AS VARCHAR) AS "Date", "State",
"Vehicle_Category", 0 AS "EV_Sales_Quantity" FROM (SELECT * FROM panel
ORDER BY "Date" DESC, "State" DESC, "Vehicle_Category" DESC LIMIT 1000)""")
def prior_year_template_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No rows in the asked year: the newest 1,000 rows serve."""
    return clean.next_year_template(inputs.stored_panel(spark, sf_dir), 2024)


@query("B12", f"""SELECT {KEY_SQL}, "EV_Sales_Quantity" FROM panel
WHERE "Date" >= DATE '2001-01-01' AND "Date" < DATE '2001-08-01'""")
def date_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.between_dates(inputs.panel(spark, sf_dir), inputs.TEST_FROM,
                               inputs.LAST_FULL_DAY_BEFORE)


@query("B13", f"""SELECT {KEY_SQL}, "EV_Sales_Quantity" FROM panel
WHERE "State" = 'NATION_7' AND "Vehicle_Category" = 'Bus'""")
def one_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.one_series(inputs.panel(spark, sf_dir), "NATION_7", "Bus")


@query("B14", f"""SELECT {KEY_SQL},
CAST(trunc(greatest("Predicted_Sales" * 1.37 - 5, 0)) AS BIGINT) AS whole FROM predictions""")
def clip_and_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col(PRED) * 1.37 - 5
    return inputs.predictions(spark, sf_dir).select(
        *PANEL_KEY, clean.whole_not_negative(value).alias("whole"))


@query("B15", f"""SELECT {KEY_SQL}, coalesce(lag("EV_Sales_Quantity", 1) OVER @W, 0) AS lag_1,
coalesce(lag("EV_Sales_Quantity", 30) OVER @W, 0) AS lag_30 FROM panel_dense""")
def fill_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from saleloom.operators import windows
    df = inputs.dense(spark, sf_dir).select(*PANEL_KEY, *windows.lags([1, 30]))
    return clean.zero_for_null_numbers(df)


@query("B16", f"""SELECT {KEY_SQL}, round("Predicted_Sales", 6) AS "Predicted_Sales" FROM (
SELECT *, row_number() OVER (ORDER BY "State", "Vehicle_Category", "Date") AS rn FROM predictions)
WHERE (rn - 1) % 10 = 0""")
def every_tenth_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.predictions(spark, sf_dir).select(*PANEL_KEY, r6(PRED).alias(PRED))
    return position.every_nth(rows, [STATE, CATEGORY, DATE], 10)


@query("B17", f"""SELECT {DATE_TEXT}, "State", "Vehicle_Category",
round(a + coalesce(b - a, 0) * k / n, 6) AS imputed FROM (
SELECT "State", "Vehicle_Category", a, b, n, k, CAST(d0 + CAST(k AS INTEGER) AS DATE) AS "Date" FROM (
SELECT "State", "Vehicle_Category", "Date" AS d0, "EV_Sales_Quantity" AS a,
lead("EV_Sales_Quantity") OVER @W AS b,
coalesce(lead("Date") OVER @W, "Date" + 1) - "Date" AS n,
unnest(range(coalesce(lead("Date") OVER @W, "Date" + 1) - "Date")) AS k FROM panel))""")
def impute_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clean.impute_linear(inputs.panel(spark, sf_dir)))


@query("B17", f"""SELECT CAST(s."Date" AS VARCHAR) AS "Date", s."State", s."Vehicle_Category",
round(coalesce(CAST(p."EV_Sales_Quantity" AS DOUBLE), s.med), 6) AS imputed
FROM (SELECT "State", "Vehicle_Category", median("EV_Sales_Quantity") AS med,
CAST(unnest(generate_series(min("Date"), max("Date"), INTERVAL 1 DAY)) AS DATE) AS "Date"
FROM panel GROUP BY 1, 2) s
LEFT JOIN panel p USING ("State", "Vehicle_Category", "Date")""")
def impute_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clean.impute_median(inputs.stored_panel(spark, sf_dir)))


@query("E1", f"""SELECT CAST("Date" AS VARCHAR) AS "Date", "State", "Vehicle_Category",
"EV_Sales_Quantity", l_orderkey FROM (
SELECT "Date", "State", "Vehicle_Category", "EV_Sales_Quantity", NULL AS l_orderkey FROM panel
WHERE "Date" < DATE '2001-01-01' UNION ALL
SELECT "Date", "State", "Vehicle_Category", "EV_Sales_Quantity", l_orderkey FROM new_push)""")
def union_differing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = clean.between_dates(inputs.panel(spark, sf_dir), before=inputs.PUSH_FROM)
    new = inputs.new_push(spark, sf_dir).select(*PANEL_KEY, QTY, "l_orderkey")
    return merge.union_all(old, new)
