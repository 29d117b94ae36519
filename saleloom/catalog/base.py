"""The query register.

``@query`` files a function under a name, with the survey rows it covers and the
SQL that DuckDB must answer alike. Dates and timestamps are shown as text, so that
both engines print them the same way.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saleloom.catalog.inputs_sql import with_inputs

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SURVEY_ROWS: dict[str, str] = {}


def _dates_as_text(df: DataFrame) -> DataFrame:
    shown = {f.name: F.col(f.name).cast("string") for f in df.schema.fields
             if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))}
    return df.withColumns(shown) if shown else df


def query(rows: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _dates_as_text(fn(spark, sf_dir))

        name = fn.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        SURVEY_ROWS[name] = rows
        if sql is not None:
            SQL[name] = with_inputs(sql)
        return fn

    return register


def r6(column: Column | str) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 6)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in doubles}) if doubles else df
