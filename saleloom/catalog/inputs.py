"""Panel inputs derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saleloom.functions.rules import MONTHS, category_by_rules
from saleloom.operators import clean, densify, merge, windows
from saleloom.operators.group_stats import attach_aggregates
from saleloom.schema import CATEGORY, DATE, PRED, QTY, STATE, TABLES
from saleloom.session import cut_lineage, stored

# ---- fixed values: vehicle class standing in for each part type -----------------
CLASS_OF_TYPE = {"ECONOMY": "M-CYCLE/SCOOTER", "SMALL": " two wheeler(nt) ",
                 "PROMO": "E-RICKSHAW(P)", "MEDIUM": "MOTOR CAR", "LARGE": "BUS"}

# ---- fixed values: sheet class printed for each category --------------------------
CLASS_OF_CATEGORY = {"2-Wheelers": "TWO WHEELER(NT)", "3-Wheelers": "THREE WHEELER(T)",
                     "4-Wheelers": "MOTOR CAR", "Bus": "BUS", "Others": "HEAVY GOODS VEHICLE"}

# ---- fixed values: cuts of the test data -------------------------------------------
PATTERN_YEAR = 2000
PUSH_FROM = "2001-01-01"
TRAIN_BEFORE = "2000-06-01"
TEST_FROM = "2001-01-01"
LAST_FULL_DAY_BEFORE = "2001-08-01"
HOLIDAYS = [(1, 26), (8, 15), (10, 2)]
SOURCE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def raw_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales rows before cleaning: unknown states, missing and untidy classes.

    Classes are named once a part, days and states once an order; the wide join, that with
    the orders, comes last, so its rows are not shuffled again before they are summed.
    """
    items = table(spark, sf_dir, "lineitem").select(*SOURCE_ORDER, "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    by_type = F.lit("EXCAVATOR")
    for part_type, name in CLASS_OF_TYPE.items():
        by_type = F.when(F.col("p_type") == part_type, name).otherwise(by_type)
    classes = parts.select("p_partkey", by_type.alias("_class"))
    buyers = (orders.join(customers, orders.o_custkey == customers.c_custkey)
              .join(nations, F.col("c_nationkey") == nations.n_nationkey)
              .select("o_orderkey", F.col("o_orderdate").cast("date").alias(DATE),
                      F.when(F.col("c_custkey") % 97 == 0, "Unknown").otherwise(F.col("n_name")).alias(STATE)))
    joined = (items.join(classes, items.l_partkey == classes.p_partkey)
              .join(buyers, items.l_orderkey == buyers.o_orderkey))
    return joined.select(
        DATE, STATE, F.when(F.col("l_orderkey") % 89 != 0, F.col("_class")).alias("Vehicle_Class"),
        F.col("l_quantity").cast("long").alias(QTY), *SOURCE_ORDER)


def known_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.drop_unknown(raw_sales(spark, sf_dir), "Vehicle_Class")


def clean_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = known_sales(spark, sf_dir)
    return known.select(DATE, STATE, category_by_rules(F.col("Vehicle_Class")).alias(CATEGORY),
                        QTY, *SOURCE_ORDER)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean sales by panel key. They are summed by class first: the text rules see one row a day, state and class."""
    by_class = merge.sum_by_key(known_sales(spark, sf_dir), [DATE, STATE, "Vehicle_Class"])
    return merge.sum_by_key(by_class.select(DATE, STATE, category_by_rules(F.col("Vehicle_Class")).alias(CATEGORY), QTY))


def stored_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean sales rows written once, for queries that take two parts of them."""
    return stored(clean_sales(spark, sf_dir), "sales")


def stored_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel after a lineage cut, so the sales tables are scanned once."""
    return cut_lineage(panel(spark, sf_dir))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return densify.dense_calendar(stored_panel(spark, sf_dir))


def stored_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense panel written once, for plans that read it in several branches."""
    return stored(dense(spark, sf_dir), "dense")


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.monthly_totals(dense(spark, sf_dir))


def full_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.between_dates(monthly(spark, sf_dir), before=LAST_FULL_DAY_BEFORE)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trailing_predictions(dense(spark, sf_dir))


def trailing_predictions(panel: DataFrame) -> DataFrame:
    """The dense panel with the mean of the seven rows before as prediction."""
    mean = windows.rolling([7], ["mean"], "shifted")[0].alias("_mean")
    return panel.select(DATE, STATE, CATEGORY, QTY, mean).select(
        DATE, STATE, CATEGORY, QTY, F.coalesce(F.col("_mean"), F.lit(0.0)).alias(PRED))


def new_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pushed(clean_sales(spark, sf_dir))


def pushed(sales: DataFrame) -> DataFrame:
    return clean.between_dates(sales, start=PUSH_FROM)


def holidays(spark: SparkSession) -> DataFrame:
    return densify.holiday_table(spark, 1995, 2001, HOLIDAYS)


def live_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("event_type").alias("vehicle_category"), F.col("value").alias("actual"))
    scored = attach_aggregates(events, ["vehicle_category"], [F.avg("actual").alias("predicted")])
    return scored.withColumn("error", F.abs(F.col("actual") - F.col("predicted")))


def _cells(values: list[Column]) -> list[Column]:
    padded = values + [F.lit(None)] * (14 - len(values))
    return [v.cast("string").alias(f"c{i}") for i, v in enumerate(padded)]


def wide_sheets(spark: SparkSession, sf_dir: str, months: int = 12,
                commas: bool = True) -> DataFrame:
    """Raw sheets of the pattern year, one per state: header, month row, one row per
    class, a total line without class. Zero is printed as '-'."""
    year = F.year(DATE) == PATTERN_YEAR
    month = F.month(DATE)
    amount = F.col(QTY)
    text = F.format_number(amount, 0) if commas else amount.cast("string")
    cell = F.when(amount == 0, "-").otherwise(text)
    wide = (monthly(spark, sf_dir).filter(year).groupBy(STATE, CATEGORY)
            .agg(*[F.max(F.when(month == m, cell)).alias(f"m{m}") for m in range(1, months + 1)]))
    wide = cut_lineage(wide)  # four branches read it
    classes = list(CLASS_OF_CATEGORY)
    serial, label = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, cat in enumerate(classes, 1):
        serial = F.when(F.col(CATEGORY) == cat, i).otherwise(serial)
        label = F.when(F.col(CATEGORY) == cat, CLASS_OF_CATEGORY[cat]).otherwise(label)
    sheet = F.concat(F.col(STATE), F.lit(".xlsx")).alias("sheet")
    body = wide.select(sheet, (serial + 2).alias("row_no"),
                       *_cells([serial, label] + [F.col(f"m{m}") for m in range(1, months + 1)]))
    states = wide.select(STATE).distinct()
    title = F.concat(F.lit("Vehicle Class Month Wise Data of "), F.col(STATE),
                     F.lit(f" ({PATTERN_YEAR})"))
    header = states.select(sheet, F.lit(0).alias("row_no"), *_cells([title]))
    names = states.select(sheet, F.lit(2).alias("row_no"), *_cells(
        [F.lit("S No"), F.lit("Vehicle Class")] + [F.lit(m) for m in MONTHS[:months]]))
    total = states.select(sheet, F.lit(9).alias("row_no"), *_cells([F.lit("Total")]))
    return header.unionByName(names).unionByName(body).unionByName(total)
