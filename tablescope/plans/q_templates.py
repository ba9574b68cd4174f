"""Registered template queries (T1): every chart of a template in one long table."""

from __future__ import annotations

from tablescope.operators import clean as C
from tablescope.plans.q_charts import box_sql, violin_sql
from tablescope.plans.q_stats import corr_matrix_sql, hist_sql
from tablescope.plans.registry import register, rounded
from tablescope.plans.standins import CLEAN_PASSENGER_SQL, passengers
from tablescope.plans.templates import TEMPLATES, template_long

KEY = ["passenger_id"]
_NUMERIC_CLEAN = ["survived", "pclass", "age", "sibsp", "parch", "fare", "family_size"]


def _long(idx, title, ctype, dims, measures, body):
    key = "concat_ws('|', " + ", ".join(f"coalesce(CAST({d} AS VARCHAR), 'null')" for d in dims) + ")"
    return "\nUNION ALL\n".join(
        f"SELECT {idx} AS chart_index, '{title}' AS title, '{ctype}' AS chart_type, {key} AS key, "
        f"'{m}' AS measure, round(CAST({m} AS DOUBLE), 6) AS value FROM ({body})" for m in measures)


def _chart_sql(idx, spec):
    t, x, y, color = spec["type"], spec.get("x"), spec.get("y"), spec.get("color")
    title = spec["title"]
    if t == "bar":
        val = f"sum({y})" if y else "count(*)"
        return _long(idx, title, t, [x], ["value"],
                     f"SELECT {x}, {val} AS value FROM p WHERE {x} IS NOT NULL GROUP BY {x}")
    if t == "pie":
        val = f"sum({y})" if y else "count(*)"
        return _long(idx, title, t, [x], ["value", "share"],
                     f"SELECT {x}, {val} AS value, CAST({val} AS DOUBLE) / (SELECT {val} FROM p WHERE {x} IS NOT NULL) "
                     f"AS share FROM p WHERE {x} IS NOT NULL GROUP BY {x}")
    if t == "scatter":
        dims = KEY + ([color] if color else [])
        return _long(idx, title, t, dims, [x, y],
                     f"SELECT {', '.join(dict.fromkeys(dims + [x, y]))} FROM p WHERE {x} IS NOT NULL AND {y} IS NOT NULL")
    if t == "histogram":
        return _long(idx, title, t, ["bin"], ["bin_lo", "bin_hi", "count"], hist_sql("p", x, 20, digits=None))
    if t == "box":
        return _long(idx, title, t, [x], ["n", "mean", "q1", "median", "q3", "lower_fence", "upper_fence",
                                           "whisker_low", "whisker_high", "outliers"], box_sql("p", x, y, None))
    if t == "violin":
        return _long(idx, title, t, [x, "point"], ["n", "bandwidth", "q1", "median", "q3", "y_value", "density"],
                     violin_sql("p", x, y, digits=False))
    if t == "heatmap":
        return _long(idx, title, t, ["a", "b"], ["r"], corr_matrix_sql("p", _NUMERIC_CLEAN, digits=None))
    raise ValueError(t)


def _template_sql(name):
    charts = "\nUNION ALL\n".join(_chart_sql(i, s) for i, s in enumerate(TEMPLATES[name]["charts"]))
    return f"WITH p AS ({CLEAN_PASSENGER_SQL})\n{charts}"


def _template_query(name):
    def run(spark, sf_dir):
        df = C.clean(passengers(spark, sf_dir, full=True), derive=False)
        df = df.withColumn("family_size", df["sibsp"] + df["parch"] + 1)
        return rounded(template_long(df, name, key=KEY), {"value": 6})
    run.__name__ = f"t1_{name}"
    return run


for _name in TEMPLATES:
    register(f"T1_template_{_name}", _template_sql(_name))(_template_query(_name))
