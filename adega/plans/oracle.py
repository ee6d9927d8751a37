"""DuckDB SQL twins of the catalog queries (the correctness oracle).

The common table expressions rebuild, in SQL, the statement text that
:mod:`adega.sources.driver_tables` renders with Spark, then parse it the same way.
Nothing here is taken from the code under test: masks, tiers and formats are
written out, and labels are DuckDB's own ``printf`` of the double quotient.
"""

from __future__ import annotations

CTES = """
WITH base AS (
  SELECT n.n_name AS country,
         CAST(year(o.o_orderdate) AS INTEGER) AS year,
         p.p_type AS product,
         CAST(l.l_quantity AS BIGINT) AS quantity,
         CAST(floor(l.l_extendedprice) AS BIGINT) AS value,
         l.l_returnflag AS via, r.r_name AS state, p.p_size AS group_code,
         l.l_orderkey + l.l_linenumber AS mask_key
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey
),
cells AS (
  SELECT product, year, country, via, state, group_code,
         CASE WHEN mask_key % 7 = 0 THEN NULL
              WHEN mask_key % 11 = 0 THEN 0 ELSE quantity END AS q,
         CASE WHEN mask_key % 7 = 0 THEN NULL ELSE value END AS v
  FROM base
),
raw AS (
  SELECT product, year, country,
         CASE WHEN q IS NULL THEN '-' ELSE replace(format('{:,}', q), ',', '.') END AS quantity_kg,
         CASE WHEN v IS NULL THEN '-' ELSE replace(format('{:,}', v), ',', '.') END AS value_usd
  FROM cells
  UNION ALL
  SELECT product, year, 'Total' AS country,
         replace(format('{:,}', CAST(sum(q) AS BIGINT)), ',', '.') AS quantity_kg,
         replace(format('{:,}', CAST(sum(v) AS BIGINT)), ',', '.') AS value_usd
  FROM cells WHERE q IS NOT NULL GROUP BY product, year
),
parsed AS (
  SELECT product, year, country,
         TRY_CAST(replace(quantity_kg, '.', '') AS DOUBLE) AS quantity_kg,
         TRY_CAST(replace(value_usd, '.', '') AS DOUBLE) AS value_usd
  FROM raw
),
facts AS (
  SELECT * FROM parsed
  WHERE quantity_kg IS NOT NULL AND value_usd IS NOT NULL AND country <> 'Total'
),
lines AS (
  SELECT product, year, concat_ws(',', country, quantity_kg, value_usd) AS raw_data FROM raw
),
line_fields AS (
  SELECT product, year,
         trim(split_part(raw_data, ',', 1)) AS country,
         TRY_CAST(replace(regexp_replace(split_part(raw_data, ',', 2), '[^0-9,]', '', 'g'), ',', '.') AS DOUBLE)
           AS quantity_kg,
         TRY_CAST(replace(regexp_replace(split_part(raw_data, ',', 3), '[^0-9,]', '', 'g'), ',', '.') AS DOUBLE)
           AS value_usd
  FROM lines
),
customs AS (
  SELECT country, state, group_code, via, CAST(q AS DOUBLE) AS net_kg, CAST(v AS DOUBLE) AS fob_usd
  FROM cells
),
yearly AS (
  SELECT year, country, sum(quantity_kg) AS quantity_kg, sum(value_usd) AS value_usd
  FROM facts GROUP BY year, country
)
"""


def currency(x: str) -> str:
    return f"""CASE WHEN {x} IS NULL THEN NULL
      WHEN {x} >= 1000000000 THEN printf('$%.2fB', ({x}) / 1e9)
      WHEN {x} >= 1000000 THEN printf('$%.2fM', ({x}) / 1e6)
      WHEN {x} >= 1000 THEN printf('$%.1fK', ({x}) / 1e3) ELSE printf('$%.2f', CAST({x} AS DOUBLE)) END"""


def quantity(x: str) -> str:
    return f"""CASE WHEN {x} IS NULL THEN NULL
      WHEN {x} >= 1000000 THEN printf('%.2fM Kg', ({x}) / 1e6)
      WHEN {x} >= 1000 THEN printf('%.1fK Kg', ({x}) / 1e3) ELSE printf('%.0f Kg', CAST({x} AS DOUBLE)) END"""


def value_millions(x: str) -> str:
    return f"""CASE WHEN {x} IS NULL THEN NULL
      WHEN {x} >= 1000000000 THEN printf('$%,.1fB', ({x}) / 1e9) ELSE printf('$%,.0fM', ({x}) / 1e6) END"""


def quantity_millions(x: str) -> str:
    return f"""CASE WHEN {x} IS NULL THEN NULL
      WHEN {x} >= 1000000000 THEN printf('%,.1fB Kg', ({x}) / 1e9) ELSE printf('%,.0fM Kg', ({x}) / 1e6) END"""


def axis_millions(x: str) -> str:
    return f"""CASE WHEN {x} IS NULL THEN NULL
      WHEN {x} >= 1000000000 THEN printf('$%.1fB', ({x}) / 1e9) ELSE printf('$%.0fM', ({x}) / 1e6) END"""


def grouped(x: str, style: str) -> str:
    fmt = {"value_table": "US$ %,.2f", "quantity_table": "%,.0f Kg", "value_bar": "$%,.0f", "unit_price": "US$ %.2f"}[style]
    return f"CASE WHEN {x} IS NULL THEN NULL ELSE printf('{fmt}', CAST({x} AS DOUBLE)) END"


def sql(body: str) -> str:
    return CTES + body
