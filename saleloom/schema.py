"""Column names and declared schemas."""

from pyspark.sql import types as T

DATE = "Date"
STATE = "State"
CATEGORY = "Vehicle_Category"
QTY = "EV_Sales_Quantity"
PRED = "Predicted_Sales"

SERIES = [STATE, CATEGORY]
PANEL_KEY = [DATE, STATE, CATEGORY]

PANEL = T.StructType([
    T.StructField(DATE, T.DateType()),
    T.StructField(STATE, T.StringType()),
    T.StructField(CATEGORY, T.StringType()),
    T.StructField(QTY, T.LongType()),
])

# A sheet is kept as raw cells: which file, which row, and 14 text cells.
SHEET_CELLS = [f"c{i}" for i in range(14)]
RAW_SHEET = T.StructType(
    [T.StructField("sheet", T.StringType()), T.StructField("row_no", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in SHEET_CELLS]
)

# What the given tables hold; declared, so that reading one starts no job.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}
