"""Registered statistics queries (S1-S6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescope.operators import stats as ST
from tablescope.plans.catalog import table
from tablescope.plans.registry import register, rounded
from tablescope.plans.standins import PASSENGER_BASIC_SQL, passengers

_P_NUM = ["survived", "age", "sibsp", "parch", "fare"]
_LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
           "l_extendedprice", "l_discount", "l_tax"]


def _pair_sql(a: str, b: str) -> str:
    both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
    x, y = f"CASE WHEN {both} THEN CAST({a} AS DOUBLE) END", f"CASE WHEN {both} THEN CAST({b} AS DOUBLE) END"
    r = f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"
    return f"CASE WHEN {r} IS NOT NULL THEN least(greatest({r}, -1.0), 1.0) END"


def _self_sql(a: str) -> str:
    return f"CASE WHEN count({a}) >= 2 AND stddev_pop(CAST({a} AS DOUBLE)) > 0 THEN 1.0 END"


def corr_matrix_sql(src: str, cols, digits: int | None = 6) -> str:
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            lo, hi = (a, b) if i <= j else (b, a)
            expr = _self_sql(a) if i == j else _pair_sql(lo, hi)
            r = f"round({expr}, {digits})" if digits is not None else expr
            parts.append(f"SELECT '{a}' AS a, '{b}' AS b, {i} AS pos_a, {j} AS pos_b, "
                         f"{r} AS r FROM {src}")
    return "\nUNION ALL\n".join(parts)


_P_SRC = f"({PASSENGER_BASIC_SQL}) AS p"
S1_SQL = corr_matrix_sql(_P_SRC, _P_NUM)


def _corr(spark, sf_dir):
    return ST.corr_matrix(passengers(spark, sf_dir).drop("passenger_id"))


@register("S1_corr_matrix", S1_SQL)
def s1(spark, sf_dir):
    return rounded(_corr(spark, sf_dir), {"r": 6})


@register("S2_corr_triangle", f"SELECT * FROM ({S1_SQL}) WHERE pos_a > pos_b")
def s2(spark, sf_dir):
    return rounded(ST.corr_triangle(_corr(spark, sf_dir)), {"r": 6})


_LI_CORR = corr_matrix_sql("lineitem", _LI_NUM)


@register("S3_top_correlations", f"""
SELECT a, b, pos_a, pos_b, r, abs(r) AS abs_r FROM ({_LI_CORR})
WHERE pos_a < pos_b ORDER BY abs(r) DESC NULLS LAST, pos_a, pos_b LIMIT 5""")
def s3(spark, sf_dir):
    return rounded(ST.top_correlations(table(spark, sf_dir, "lineitem"), 5), {"r": 6, "abs_r": 6})


@register("S4_target_correlation", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, {i} AS position, 'l_tax' AS target, round(abs({_pair_sql(c, 'l_tax')}), 6) AS correlation FROM lineitem"
    for i, c in enumerate(_LI_NUM[:-1])))
def s4(spark, sf_dir):
    return rounded(ST.target_correlation(table(spark, sf_dir, "lineitem")), {"correlation": 6})


_FENCES = """q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders),
f AS (SELECT q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)"""


@register("S5_outliers", f"""
WITH {_FENCES}
SELECT 'o_totalprice' AS "column", round(q1, 4) AS q1, round(q3, 4) AS q3, round(iqr, 4) AS iqr,
       round(lo, 4) AS lower_bound, round(hi, 4) AS upper_bound,
       (SELECT count(*) FROM orders, f WHERE o_totalprice < f.lo OR o_totalprice > f.hi) AS outlier_count,
       (SELECT count(o_totalprice) FROM orders) AS total_count,
       round((SELECT count(*) FROM orders, f WHERE o_totalprice < f.lo OR o_totalprice > f.hi) * 100.0
             / (SELECT count(o_totalprice) FROM orders), 6) AS outlier_pct
FROM f""")
def s5(spark, sf_dir):
    out = ST.outliers(table(spark, sf_dir, "orders"), "o_totalprice")
    return rounded(out, {"q1": 4, "q3": 4, "iqr": 4, "lower_bound": 4, "upper_bound": 4,
                         "outlier_pct": 6})


@register("S5_outlier_rows", f"""
WITH {_FENCES}
SELECT o.* FROM orders o, f WHERE o.o_totalprice < f.lo OR o.o_totalprice > f.hi""")
def s5_rows(spark, sf_dir):
    return ST.outlier_rows(table(spark, sf_dir, "orders"), "o_totalprice")


def hist_sql(src: str, col: str, bins: int, extra_select: str = "", extra_group: str = "",
             digits: int | None = 6) -> str:
    v = f"CAST({col} AS DOUBLE)"
    w = f"((r.hi - r.lo) / {float(bins)})"
    b = (f"CASE WHEN r.hi = r.lo THEN 0 ELSE least(CAST(floor(({v} - r.lo) / {w}) AS INTEGER), {bins - 1}) END")
    def rnd(e):
        return f"round({e}, {digits})" if digits is not None else e
    return (f"SELECT {extra_select}bin, {rnd(f'lo + bin * ((hi - lo) / {float(bins)})')} AS bin_lo, "
            f"{rnd(f'lo + (bin + 1) * ((hi - lo) / {float(bins)})')} AS bin_hi, count(*) AS count FROM "
            f"(SELECT {extra_select}{b} AS bin, r.lo, r.hi FROM {src}, "
            f"(SELECT min({v}) AS lo, max({v}) AS hi FROM {src}) AS r WHERE {col} IS NOT NULL) "
            f"GROUP BY {extra_group}bin, lo, hi")


@register("S6_distributions", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", {i} AS position, * FROM ({hist_sql('lineitem', c, 20)})"
    for i, c in enumerate(_LI_NUM[:4])))
def s6(spark, sf_dir):
    return rounded(ST.distributions(table(spark, sf_dir, "lineitem"), bins=20, n=4),
                   {"bin_lo": 6, "bin_hi": 6})


def _fences_sql(table_name: str, col: str) -> str:
    return f"""q AS (SELECT quantile_cont({col}, 0.25) AS q1, quantile_cont({col}, 0.75) AS q3 FROM {table_name}),
f AS (SELECT q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)"""


def _outliers_sql(table_name: str, col: str) -> str:
    return f"""
WITH {_fences_sql(table_name, col)}
SELECT '{col}' AS "column", round(q1, 4) AS q1, round(q3, 4) AS q3, round(iqr, 4) AS iqr,
       round(lo, 4) AS lower_bound, round(hi, 4) AS upper_bound,
       (SELECT count(*) FROM {table_name}, f WHERE {col} < f.lo OR {col} > f.hi) AS outlier_count,
       (SELECT count({col}) FROM {table_name}) AS total_count,
       round((SELECT count(*) FROM {table_name}, f WHERE {col} < f.lo OR {col} > f.hi) * 100.0
             / (SELECT count({col}) FROM {table_name}), 6) AS outlier_pct
FROM f"""


_OUT_ROUND = {"q1": 4, "q3": 4, "iqr": 4, "lower_bound": 4, "upper_bound": 4, "outlier_pct": 6}


@register("S5_outliers_events_value", _outliers_sql("events", "value"))
def s5_events(spark, sf_dir):
    return rounded(ST.outliers(table(spark, sf_dir, "events"), "value"), _OUT_ROUND)


@register("S5_outlier_rows_events_value", f"""
WITH {_fences_sql("events", "value")}
SELECT e.* FROM events e, f WHERE e.value < f.lo OR e.value > f.hi""")
def s5_events_rows(spark, sf_dir):
    return ST.outlier_rows(table(spark, sf_dir, "events"), "value")


@register("S5_outliers_documents_n_chars", _outliers_sql("documents", "n_chars"))
def s5_docs(spark, sf_dir):
    return rounded(ST.outliers(table(spark, sf_dir, "documents"), "n_chars"), _OUT_ROUND)
