"""Registered profile and filter queries (A1-A3, A11, F2-F8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescope.functions.roles import numeric_columns
from tablescope.operators import filters as FL
from tablescope.operators import profile as PR
from tablescope.plans.catalog import table
from tablescope.plans.registry import register, rounded
from tablescope.plans.standins import PASSENGER_BASIC_SQL, passengers

_LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
           "l_extendedprice", "l_discount", "l_tax"]


@register("A1_table_metrics", """
SELECT count(*) AS total_records, 'o_orderkey' AS first_numeric,
       round(avg(CAST(o_orderkey AS DOUBLE)), 6) AS first_numeric_avg,
       CAST(sum((o_orderkey IS NULL)::INT + (o_custkey IS NULL)::INT + (o_orderstatus IS NULL)::INT
           + (o_totalprice IS NULL)::INT + (o_orderdate IS NULL)::INT + (o_orderpriority IS NULL)::INT) AS BIGINT)
         AS missing_cells,
       round(sum((o_orderkey IS NULL)::INT + (o_custkey IS NULL)::INT + (o_orderstatus IS NULL)::INT
           + (o_totalprice IS NULL)::INT + (o_orderdate IS NULL)::INT + (o_orderpriority IS NULL)::INT)
           * 100.0 / (count(*) * 6), 6) AS missing_pct,
       6 AS n_columns
FROM orders HAVING count(*) > 0""")
def a1(spark, sf_dir):
    return rounded(PR.table_metrics(table(spark, sf_dir, "orders")),
                   {"first_numeric_avg": 6, "missing_pct": 6})


_P_COLS = ["passenger_id", "survived", "sex", "age", "sibsp", "parch", "fare"]


@register("A2_missing_profile", f"""
WITH p AS ({PASSENGER_BASIC_SQL})
SELECT * FROM (VALUES """ + ", ".join(
    f"('{c}', {i}, (SELECT count(*) FROM p WHERE {c} IS NULL), "
    f"round((SELECT count(*) FROM p WHERE {c} IS NULL) * 100.0 / (SELECT count(*) FROM p), 6))"
    for i, c in enumerate(_P_COLS)) + ") AS t(\"column\", position, missing_count, missing_pct)")
def a2(spark, sf_dir):
    return rounded(PR.missing_profile(passengers(spark, sf_dir)), {"missing_pct": 6})


def _describe_sql(table_name: str, cols) -> str:
    stats = [("count", "CAST(count({c}) AS DOUBLE)"), ("mean", "avg({c})"),
             ("std", "stddev_samp({c})"), ("min", "CAST(min({c}) AS DOUBLE)"),
             ("25%", "quantile_cont({c}, 0.25)"), ("50%", "quantile_cont({c}, 0.5)"),
             ("75%", "quantile_cont({c}, 0.75)"), ("max", "CAST(max({c}) AS DOUBLE)")]
    parts = []
    for name, tmpl in stats:
        vals = ", ".join(f"round_even(CAST({tmpl.format(c='CAST(' + c + ' AS DOUBLE)')} AS DOUBLE), 4) AS {c}"
                         for c in cols)
        parts.append(f"SELECT '{name}' AS stat, {vals} FROM {table_name}")
    return "\nUNION ALL\n".join(parts)


@register("A3_describe", _describe_sql("lineitem", _LI_NUM))
def a3(spark, sf_dir):
    return PR.describe(table(spark, sf_dir, "lineitem"), decimals=4)


@register("A11_cardinality", "SELECT * FROM (VALUES " + ", ".join(
    f"('{c}', {i}, (SELECT count(DISTINCT {c}) FROM lineitem))" for i, c in enumerate(_LI_NUM))
    + ") AS t(\"column\", position, n_distinct)")
def a11(spark, sf_dir):
    return PR.cardinality(table(spark, sf_dir, "lineitem"))


@register("F2_numeric_projection", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem")
def f2(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(*numeric_columns(li, 4))


_ORDERS_CAT = ["o_orderstatus", "o_orderpriority"]


@register("F3_filter_domains_categorical", """
WITH pairs AS (
  SELECT DISTINCT 0 AS position, 'o_orderstatus' AS "column", o_orderstatus AS value FROM orders WHERE o_orderstatus IS NOT NULL
  UNION ALL
  SELECT DISTINCT 1, 'o_orderpriority', o_orderpriority FROM orders WHERE o_orderpriority IS NOT NULL)
SELECT "column", position, value, value_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY position ORDER BY value) AS value_rank FROM pairs)
WHERE value_rank <= 20""")
def f3(spark, sf_dir):
    return FL.filter_domains_categorical(table(spark, sf_dir, "orders"))


@register("F3_filter_domains_customer", """
WITH pairs AS (
  SELECT DISTINCT 0 AS position, 'c_name' AS "column", c_name AS value FROM customer WHERE c_name IS NOT NULL
  UNION ALL
  SELECT DISTINCT 1, 'c_mktsegment', c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL)
SELECT "column", position, value, value_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY position ORDER BY value) AS value_rank FROM pairs)
WHERE value_rank <= 20""")
def f3_customer(spark, sf_dir):
    return FL.filter_domains_categorical(table(spark, sf_dir, "customer"))


@register("F4_filter_domains_numeric", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", {i} AS position, CAST(min({c}) AS DOUBLE) + 0.0 AS \"min\", "
    f"CAST(max({c}) AS DOUBLE) AS \"max\", CAST(floor(min({c})) AS BIGINT) AS slider_min, "
    f"CAST(ceil(max({c})) AS BIGINT) AS slider_max FROM lineitem"
    for i, c in enumerate(_LI_NUM)))
def f4(spark, sf_dir):
    return FL.filter_domains_numeric(table(spark, sf_dir, "lineitem")).drop("exact_min", "exact_max")


_FILTERS = {"l_returnflag": ["R", "A"], "l_quantity": FL.Range(10, 30), "l_linestatus": []}


@register("F5_apply_filters", """
SELECT * FROM lineitem WHERE l_returnflag IN ('R', 'A') AND l_quantity >= 10 AND l_quantity <= 30""")
def f5(spark, sf_dir):
    return table(spark, sf_dir, "lineitem", filters=_FILTERS)


@register("F6_filter_status", """
SELECT count(*) AS rows_before,
       count(*) FILTER (WHERE l_returnflag IN ('R', 'A') AND l_quantity >= 10 AND l_quantity <= 30) AS rows_after
FROM lineitem""")
def f6(spark, sf_dir):
    return FL.filter_status(table(spark, sf_dir, "lineitem"), _FILTERS)


@register("F8_apply_axis_log", """
SELECT l_orderkey, l_linenumber, l_extendedprice, round(log10(l_extendedprice), 9) AS axis_value
FROM lineitem WHERE l_extendedprice >= 5000 AND l_extendedprice <= 50000 AND l_extendedprice > 0""")
def f8(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return rounded(FL.apply_axis(li, "l_extendedprice", 5000, 50000, "log"), {"axis_value": 9})
