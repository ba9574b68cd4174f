"""Registered chart-data queries (C1-C12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescope.operators import charts as CH
from tablescope.plans.catalog import table
from tablescope.plans.q_stats import S1_SQL, hist_sql
from tablescope.plans.registry import register, rounded
from tablescope.plans.standins import passengers


@register("C1_bar", """
SELECT o_orderpriority, o_orderstatus, round(sum(o_totalprice), 2) AS value FROM orders
WHERE o_orderpriority IS NOT NULL AND o_orderstatus IS NOT NULL GROUP BY o_orderpriority, o_orderstatus""")
def c1(spark, sf_dir):
    return rounded(CH.bar(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice",
                          "o_orderstatus"), {"value": 2})


@register("C1_bar_count", """
SELECT o_orderpriority, count(*) AS value FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority""")
def c1_count(spark, sf_dir):
    return CH.bar(table(spark, sf_dir, "orders"), "o_orderpriority")


@register("C2_scatter", """
SELECT p_partkey, p_size, p_retailprice, p_brand FROM part WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL""")
def c2(spark, sf_dir):
    return CH.scatter(table(spark, sf_dir, "part"), "p_size", "p_retailprice", color="p_brand",
                      key=["p_partkey"])


@register("C3_histogram", hist_sql("lineitem", "l_extendedprice", 20))
def c3(spark, sf_dir):
    return rounded(CH.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 20),
                   {"bin_lo": 6, "bin_hi": 6})


@register("C3_histogram_color", hist_sql("lineitem", "l_extendedprice", 20, "l_returnflag, ", "l_returnflag, "))
def c3_color(spark, sf_dir):
    return rounded(CH.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 20,
                                color="l_returnflag"), {"bin_lo": 6, "bin_hi": 6})


@register("C3_histogram_text", """
SELECT o_orderpriority, count(*) AS count FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority""")
def c3_text(spark, sf_dir):
    return CH.histogram(table(spark, sf_dir, "orders"), "o_orderpriority")


@register("C4_pie", """
SELECT c_mktsegment, round(sum(c_acctbal), 2) AS value,
       round(sum(c_acctbal) / (SELECT sum(c_acctbal) FROM customer WHERE c_mktsegment IS NOT NULL), 6) AS share
FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment""")
def c4(spark, sf_dir):
    return rounded(CH.pie(table(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal"),
                   {"value": 2, "share": 6})


def _all_present(cols: str) -> str:
    return " AND ".join(f"{c.strip()} IS NOT NULL" for c in cols.split(","))


def box_sql(src: str, x: str, y: str, digits: int | None = 4) -> str:
    """``x``: one key or several, separated by commas."""
    def rnd(e):
        return f"round({e}, {digits})" if digits is not None else e
    return f"""
WITH b AS (SELECT {x}, CAST({y} AS DOUBLE) AS y FROM {src} WHERE {_all_present(x)} AND {y} IS NOT NULL),
q AS (SELECT {x}, count(y) AS n, avg(y) AS mean, quantile_cont(y, 0.25) AS q1,
             quantile_cont(y, 0.5) AS median, quantile_cont(y, 0.75) AS q3 FROM b GROUP BY {x}),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q),
w AS (SELECT {x}, min(CASE WHEN y >= lower_fence THEN y END) AS whisker_low,
             max(CASE WHEN y <= upper_fence THEN y END) AS whisker_high,
             count(*) FILTER (WHERE y < lower_fence OR y > upper_fence) AS outliers
      FROM b JOIN f USING ({x}) GROUP BY {x})
SELECT {x}, n, {rnd('mean')} AS mean, {rnd('q1')} AS q1, {rnd('median')} AS median,
       {rnd('q3')} AS q3, {rnd('lower_fence')} AS lower_fence, {rnd('upper_fence')} AS upper_fence,
       whisker_low, whisker_high, outliers
FROM f JOIN w USING ({x})"""


_BOX_SQL = box_sql("lineitem", "l_returnflag", "l_extendedprice")


@register("C5_box", _BOX_SQL)
def c5(spark, sf_dir):
    out = CH.box(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice")
    return rounded(out, {c: 4 for c in ("mean", "q1", "median", "q3", "lower_fence", "upper_fence")})


@register("C6_heatmap", S1_SQL)
def c6(spark, sf_dir):
    return rounded(CH.heatmap(passengers(spark, sf_dir).drop("passenger_id")), {"r": 6})


def violin_sql(src: str, x: str, y: str, grid: int = 50, digits: bool = True) -> str:
    def rnd(e, d):
        return f"round({e}, {d})" if digits else e
    sums = ", ".join(
        f"sum(exp(-0.5 * pow((grid_lo + {float(i)} * grid_step - y) / bandwidth, 2))) AS k{i}"
        for i in range(grid))
    points = "\nUNION ALL\n".join(
        f"SELECT {x}, n, {rnd('bandwidth', 9)} AS bandwidth, {rnd('q1', 6)} AS q1, {rnd('median', 6)} AS median, "
        f"{rnd('q3', 6)} AS q3, {i} AS point, {rnd(f'grid_lo + {float(i)} * grid_step', 6)} AS y_value, "
        f"{rnd(f'k{i} / (n * bandwidth * {CH.SQRT_2PI!r})', 9)} AS density FROM full_"
        for i in range(grid))
    return f"""
WITH b AS (SELECT {x}, CAST({y} AS DOUBLE) AS y FROM {src} WHERE {_all_present(x)} AND {y} IS NOT NULL),
s0 AS (SELECT {x}, count(y) AS n, stddev_samp(y) AS std, min(y) AS y_min, max(y) AS y_max,
              quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.5) AS median, quantile_cont(y, 0.75) AS q3
       FROM b GROUP BY {x}),
s1 AS (SELECT *, 1.059 * least(std, (q3 - q1) / 1.349) * pow(CAST(n AS DOUBLE), -0.2) AS raw_bw FROM s0),
s2 AS (SELECT *, CASE WHEN raw_bw > 0 THEN raw_bw WHEN std > 0 THEN std ELSE 1.0 END AS bandwidth FROM s1),
st AS (SELECT *, y_min - 2 * bandwidth AS grid_lo, (y_max - y_min + 4 * bandwidth) / {float(grid - 1)} AS grid_step FROM s2),
d AS (SELECT {x}, {sums} FROM b JOIN st USING ({x}) GROUP BY {x}),
full_ AS (SELECT st.*, d.* EXCLUDE ({x}) FROM st JOIN d USING ({x}))
{points}"""


@register("C7_violin", violin_sql("lineitem", "l_returnflag", "l_quantity"))
def c7(spark, sf_dir):
    out = CH.violin(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", grid=50)
    return rounded(out, {"bandwidth": 9, "q1": 6, "median": 6, "q3": 6, "y_value": 6, "density": 9})


@register("C8_line", """
SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus, round(avg(o_totalprice), 4) AS o_totalprice
FROM orders WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY 1, 2""")
def c8(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    return rounded(CH.line(o, "month", "o_totalprice", "o_orderstatus", agg="mean"), {"o_totalprice": 4})


@register("C8_line_raw", """
SELECT o_orderdate, o_orderstatus, o_totalprice FROM orders WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL""")
def c8_raw(spark, sf_dir):
    return CH.line(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", "o_orderstatus")


@register("C9_sunburst", """
SELECT CAST(2 - grouping(o_orderstatus) - grouping(o_orderpriority) AS INTEGER) AS level,
       o_orderstatus, o_orderpriority,
       CASE WHEN grouping(o_orderstatus) = 1 THEN 'total'
            WHEN grouping(o_orderpriority) = 1 THEN o_orderstatus
            ELSE o_orderstatus || '/' || o_orderpriority END AS id,
       CASE WHEN grouping(o_orderstatus) = 1 THEN NULL
            WHEN grouping(o_orderpriority) = 1 THEN 'total' ELSE o_orderstatus END AS parent,
       count(*) AS count
FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""")
def c9(spark, sf_dir):
    return CH.sunburst(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@register("C10_treemap", """
SELECT CAST(1 - grouping(c_mktsegment) AS INTEGER) AS level, c_mktsegment,
       CASE WHEN grouping(c_mktsegment) = 1 THEN 'total' ELSE c_mktsegment END AS id,
       CASE WHEN grouping(c_mktsegment) = 1 THEN NULL ELSE 'total' END AS parent,
       round(sum(c_acctbal), 2) AS value
FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY ROLLUP (c_mktsegment)""")
def c10(spark, sf_dir):
    return rounded(CH.treemap(table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_acctbal"),
                   {"value": 2})


@register("C11_scatter3d", """
SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag FROM lineitem
WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL AND l_suppkey IS NOT NULL""")
def c11(spark, sf_dir):
    return CH.scatter3d(table(spark, sf_dir, "lineitem"), color="l_returnflag")


@register("C12_area", """
SELECT yr, o_orderpriority, round(value, 2) AS value,
       round(sum(value) OVER (PARTITION BY yr ORDER BY o_orderpriority ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS stack_top,
       round(sum(value) OVER (PARTITION BY yr ORDER BY o_orderpriority ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - value, 2) AS stack_base
FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, o_orderpriority, sum(o_totalprice) AS value FROM orders
      WHERE year(o_orderdate) IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY 1, 2)""")
def c12(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("yr", F.year("o_orderdate"))
    return rounded(CH.area(o, "yr", "o_totalprice", "o_orderpriority"),
                   {"value": 2, "stack_top": 2, "stack_base": 2})


@register("C5_box_events", box_sql("events", "event_type", "value"))
def c5_events(spark, sf_dir):
    out = CH.box(table(spark, sf_dir, "events"), "event_type", "value")
    return rounded(out, {c: 4 for c in ("mean", "q1", "median", "q3", "lower_fence", "upper_fence")})


@register("C5_box_color", box_sql("lineitem", "l_returnflag, l_linestatus", "l_extendedprice"))
def c5_color(spark, sf_dir):
    out = CH.box(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", color="l_linestatus")
    return rounded(out, {c: 4 for c in ("mean", "q1", "median", "q3", "lower_fence", "upper_fence")})


@register("C7_violin_color", violin_sql("lineitem", "l_returnflag, l_linestatus", "l_extendedprice"))
def c7_color(spark, sf_dir):
    """Nearly every price is different: the binned density against the plain kernel sum."""
    out = CH.violin(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", color="l_linestatus")
    return rounded(out, {"bandwidth": 9, "q1": 6, "median": 6, "q3": 6, "y_value": 6, "density": 9})
