"""The same inputs as SQL, pulled into a query's WITH list when it names them."""

from __future__ import annotations

import re

INPUTS = {
    "raw_sales": """
SELECT CAST(o_orderdate AS DATE) AS "Date",
       CASE WHEN c_custkey % 97 = 0 THEN 'Unknown' ELSE n_name END AS "State",
       CASE WHEN l_orderkey % 89 = 0 THEN NULL ELSE
         CASE p_type WHEN 'ECONOMY' THEN 'M-CYCLE/SCOOTER' WHEN 'SMALL' THEN ' two wheeler(nt) '
                     WHEN 'PROMO' THEN 'E-RICKSHAW(P)' WHEN 'MEDIUM' THEN 'MOTOR CAR'
                     WHEN 'LARGE' THEN 'BUS' ELSE 'EXCAVATOR' END END AS "Vehicle_Class",
       CAST(l_quantity AS BIGINT) AS "EV_Sales_Quantity",
       l_orderkey, l_linenumber, l_partkey, l_suppkey
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
     JOIN customer ON o_custkey = c_custkey
     JOIN nation ON c_nationkey = n_nationkey
     JOIN part ON l_partkey = p_partkey""",
    "clean_sales": """
SELECT "Date", "State",
       CASE WHEN "Vehicle_Class" IN ('M-CYCLE/SCOOTER', ' two wheeler(nt) ') THEN '2-Wheelers'
            WHEN "Vehicle_Class" = 'E-RICKSHAW(P)' THEN '3-Wheelers'
            WHEN "Vehicle_Class" = 'MOTOR CAR' THEN '4-Wheelers'
            WHEN "Vehicle_Class" = 'BUS' THEN 'Bus' ELSE 'Others' END AS "Vehicle_Category",
       "EV_Sales_Quantity", l_orderkey, l_linenumber, l_partkey, l_suppkey
FROM raw_sales WHERE "State" <> 'Unknown' AND "Vehicle_Class" IS NOT NULL""",
    "panel": """
SELECT "Date", "State", "Vehicle_Category",
       CAST(sum("EV_Sales_Quantity") AS BIGINT) AS "EV_Sales_Quantity"
FROM clean_sales GROUP BY ALL""",
    "panel_dense": """
SELECT d."Date", s."State", c."Vehicle_Category",
       coalesce(p."EV_Sales_Quantity", 0) AS "EV_Sales_Quantity"
FROM (SELECT CAST(unnest(generate_series(min("Date"), max("Date"), INTERVAL 1 DAY)) AS DATE)
             AS "Date" FROM panel) d
CROSS JOIN (SELECT DISTINCT "State" FROM panel) s
CROSS JOIN (SELECT unnest(['2-Wheelers', '3-Wheelers', '4-Wheelers', 'Bus', 'Others'])
                   AS "Vehicle_Category") c
LEFT JOIN panel p ON p."Date" = d."Date" AND p."State" = s."State"
                 AND p."Vehicle_Category" = c."Vehicle_Category\"""",
    "monthly": """
SELECT "State", "Vehicle_Category", CAST(date_trunc('month', "Date") AS DATE) AS "Date",
       year("Date") AS "Year", month("Date") AS "Month",
       CAST(sum("EV_Sales_Quantity") AS BIGINT) AS "EV_Sales_Quantity"
FROM panel_dense GROUP BY ALL""",
    "full_months": """SELECT * FROM monthly WHERE "Date" < DATE '2001-08-01'""",
    "predictions": """
SELECT "Date", "State", "Vehicle_Category", "EV_Sales_Quantity",
       coalesce(avg("EV_Sales_Quantity") OVER (PARTITION BY "State", "Vehicle_Category"
         ORDER BY "Date" ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 0) AS "Predicted_Sales"
FROM panel_dense""",
    "new_push": """SELECT * FROM clean_sales WHERE "Date" >= DATE '2001-01-01'""",
    "holidays": """
SELECT make_date(y, md[1], md[2]) AS "Date"
FROM (SELECT unnest(range(1995, 2002)) AS y)
CROSS JOIN (SELECT unnest([[1, 26], [8, 15], [10, 2]]) AS md)""",
    "live_feed": """
SELECT event_id AS id, ts AS "timestamp", event_type AS vehicle_category, value AS actual,
       avg(value) OVER (PARTITION BY event_type) AS predicted,
       abs(value - avg(value) OVER (PARTITION BY event_type)) AS error
FROM events""",
}


def with_inputs(sql: str) -> str:
    """Prefix the inputs a statement names, in dependency order.

    ``@W`` stands for the series window, ``@FRAME(k)`` for its last k rows and the
    current one, ``@BEFORE(k)`` for the k rows before the current one.
    """
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in INPUTS:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                visit(INPUTS[name])
                needed.append(name)

    visit(sql)
    body = sql.strip()
    if not needed:
        return expand(body)
    ctes = ",\n".join(f"{n} AS ({INPUTS[n].strip()}\n)" for n in needed)
    if re.match(r"WITH\b", body):
        body = ctes_join(ctes, body)
    else:
        body = f"WITH {ctes}\n{body}"
    return expand(body)


def ctes_join(ctes: str, body: str) -> str:
    recursive = re.match(r"WITH\s+RECURSIVE\b", body)
    rest = body[recursive.end():] if recursive else body[len("WITH"):]
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes},\n{rest.strip()}"


def expand(sql: str) -> str:
    sql = re.sub(r"@W\b", '(PARTITION BY "State", "Vehicle_Category" ORDER BY "Date")', sql)
    sql = re.sub(r"@FRAME\((\d+)\)",
                 r'(PARTITION BY "State", "Vehicle_Category" ORDER BY "Date" '
                 r'ROWS BETWEEN \1 PRECEDING AND CURRENT ROW)', sql)
    sql = re.sub(r"@BEFORE\((\d+)\)",
                 r'(PARTITION BY "State", "Vehicle_Category" ORDER BY "Date" '
                 r'ROWS BETWEEN \1 PRECEDING AND 1 PRECEDING)', sql)
    return sql


def r6(expression: str) -> str:
    """Round to six digits; adding 0 turns -0.0 into 0.0."""
    return f"round({expression}, 6) + 0"


# MAE, MSE, RMSE, R2 and MAPE of columns y and p
SCORES = ", ".join([
    "count(*) AS records",
    f"{r6('avg(abs(y - p))')} AS mae",
    f"{r6('avg((y - p) * (y - p))')} AS mse",
    f"{r6('sqrt(avg((y - p) * (y - p)))')} AS rmse",
    f"{r6('CASE WHEN count(*) < 2 THEN NULL ELSE 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) END')} AS r2",
    f"{r6('coalesce(avg(CASE WHEN y <> 0 THEN abs((y - p) / y) END) * 100, 0)')} AS mape",
])
