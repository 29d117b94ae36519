"""Wide monthly sheets, held as raw cells, to long monthly rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saleloom.functions import rules
from saleloom.operators.group_stats import attach_aggregates
from saleloom.schema import CATEGORY, QTY, RAW_SHEET, SHEET_CELLS, STATE


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """Sheet cells exported as CSV, one line per sheet row; many files in one scan."""
    return spark.read.schema(RAW_SHEET).csv(path)


def _is_digits(cell: Column) -> Column:
    return F.coalesce(F.trim(cell).rlike("^[0-9]+$"), F.lit(False))


def _located(cells: DataFrame) -> DataFrame:
    """Each row with its sheet's header text, first data row and month-name row."""
    first_cell = F.struct("row_no", "c0")
    data_row = F.when(_is_digits(F.col("c0")), F.col("row_no"))
    names = F.when(F.col("c2").isin(rules.MONTHS), F.struct("row_no", *SHEET_CELLS))
    return attach_aggregates(cells, ["sheet"], [
        F.min(first_cell)["c0"].alias("_header"), F.min(data_row).alias("_start"),
        F.min(names).alias("_names")])


def _state_and_year(default_year: int) -> list[Column]:
    state = F.coalesce(rules.state_from_header(F.col("_header")), F.lit("Unknown"))
    return [state.alias(STATE), rules.year_from_header(F.col("_header"), default_year).alias("Year")]


def _class_rows(cells: DataFrame) -> DataFrame:
    name = F.trim("c1")
    return (_located(cells).filter((F.col("row_no") >= F.col("_start")) & F.col("c0").isNotNull()
                                   & (F.coalesce(name, F.lit("")) != "")
                                   & (F.lower(name) != "nan")).withColumn("c1", name))


def months_by_position(cells: DataFrame, default_year: int = 2025) -> DataFrame:
    """Columns 2-13 are JAN..DEC. Thousands commas go, other non-digit cells drop."""
    wide = _class_rows(cells).select(
        *_state_and_year(default_year), F.col("c1").alias("Vehicle_Class"),
        *[F.col(f"c{i + 2}").alias(m) for i, m in enumerate(rules.MONTHS)])
    long = wide.unpivot([STATE, "Year", "Vehicle_Class"], rules.MONTHS, "Month_Name", "_cell")
    digits = F.trim(F.replace("_cell", F.lit(","), F.lit("")))
    return (long.filter(_is_digits(digits))
            .select(STATE, "Vehicle_Class", rules.category_by_rules(F.col("Vehicle_Class")).alias(CATEGORY),
                    "Month_Name", digits.cast("long").alias(QTY), "Year"))


def months_by_name_row(cells: DataFrame, default_year: int = 2025) -> DataFrame:
    """Columns 2-9 carry the months named in the month-name row; every data row needs
    a serial number, and only plain digits count."""
    columns = SHEET_CELLS[2:10]
    rows = _class_rows(cells).filter(_is_digits(F.col("c0")))
    pairs = F.array(*[F.struct(F.col(f"_names.{c}").alias("Month_Name"), F.col(c).alias("_cell"))
                      for c in columns])
    long = rows.select(*_state_and_year(default_year), F.col("c1").alias("Vehicle_Class"),
                       F.inline(pairs))
    return (long.filter(F.col("Month_Name").isin(rules.MONTHS) & _is_digits(F.col("_cell")))
            .select(STATE, "Vehicle_Class", "Month_Name",
                    F.trim("_cell").cast("long").alias(QTY), "Year"))
