"""Dashboard templates: named lists of chart specs turned into chart-data tables.

``chart_data(df, spec)`` dispatches one spec to its chart operator; ``run_template`` gives
{title: DataFrame}; ``template_long`` unions all charts of a template into one long table
(chart_index, title, chart_type, key, measure, value) so a whole dashboard is one plan.
Specs naming a column the table lacks are skipped. Bar and pie specs without y count rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.roles import is_numeric, numeric_columns
from tablescope.operators import charts as CH

# The three dashboard templates (titles, chart types and columns).
TEMPLATES = {
    "survival_analysis": {
        "charts": [
            {"type": "bar", "x": "pclass", "y": "survived", "title": "Survival by Class"},
            {"type": "pie", "x": "sex", "y": "survived", "title": "Survival by Gender"},
            {"type": "scatter", "x": "age", "y": "fare", "color": "survived", "title": "Age vs Fare Survival"},
            {"type": "box", "x": "survived", "y": "age", "title": "Age Distribution by Survival"},
        ],
    },
    "demographic_overview": {
        "charts": [
            {"type": "histogram", "x": "age", "title": "Age Distribution"},
            {"type": "bar", "x": "pclass", "title": "Passenger Class Distribution"},
            {"type": "pie", "x": "sex", "title": "Gender Distribution"},
            {"type": "bar", "x": "embarked", "title": "Embarkation Port"},
            {"type": "histogram", "x": "fare", "title": "Fare Distribution"},
        ],
    },
    "economic_analysis": {
        "charts": [
            {"type": "scatter", "x": "fare", "y": "survived", "title": "Fare vs Survival"},
            {"type": "box", "x": "pclass", "y": "fare", "title": "Fare by Class"},
            {"type": "violin", "x": "survived", "y": "fare", "title": "Fare Distribution by Survival"},
            {"type": "heatmap", "title": "Correlation Matrix"},
        ],
    },
}

CHART_TYPES = ("bar", "scatter", "histogram", "pie", "box", "heatmap", "violin", "line",
               "sunburst", "treemap", "3d_scatter", "area")


def _spec_columns(spec: Mapping) -> list[str]:
    return [spec[k] for k in ("x", "y", "color", "size") if spec.get(k)]


def chart_data(df: DataFrame, spec: Mapping, key: Sequence[str] = ()) -> DataFrame:
    """The chart table of one spec {type, x, y, color, size}. Unknown columns raise KeyError."""
    missing = [c for c in _spec_columns(spec) if c not in df.columns]
    if missing:
        raise KeyError(f"columns not in table: {missing}")
    t, x, y = spec["type"], spec.get("x"), spec.get("y")
    color, size = spec.get("color"), spec.get("size")
    if t == "bar":
        return CH.bar(df, x, y, color)
    if t == "pie":
        return CH.pie(df, x, y)
    if t == "scatter":
        return CH.scatter(df, x, y, color, size, key=key)
    if t == "histogram":
        return CH.histogram(df, x, color=color)
    if t == "box":
        return CH.box(df, x, y, color)
    if t == "violin":
        return CH.violin(df, x, y, color)
    if t == "heatmap":
        return CH.heatmap(df.drop(*key), x, y)
    if t == "line":
        return CH.line(df, x, y, color)
    if t == "sunburst":
        return CH.sunburst(df, [x, y])
    if t == "treemap":
        return CH.treemap(df, [x], y)
    if t == "3d_scatter":
        return CH.scatter3d(df, color, key, x, y)
    if t == "area":
        return CH.area(df, x, y, color)
    raise ValueError(f"unknown chart type: {t}")


def _shape(df: DataFrame, spec: Mapping, key: Sequence[str]) -> tuple[list[str], list[str]]:
    """(dimension columns, measure columns) of a chart table."""
    t, x, y = spec["type"], spec.get("x"), spec.get("y")
    color, size = spec.get("color"), spec.get("size")
    col = [color] if color and color != x else []
    if t == "bar" or (t == "heatmap" and len(numeric_columns(df.drop(*key))) < 2):
        return [x, *col], ["value"]
    if t == "pie":
        return [x], ["value", "share"]
    if t == "scatter":
        return [*key, *([color] if color else [])], [x, y, *([size] if size else [])]
    if t == "histogram":
        if is_numeric(df.schema[x].dataType):
            return [*([color] if color else []), "bin"], ["bin_lo", "bin_hi", "count"]
        return [x, *col], ["count"]
    if t == "box":
        return [x, *col], ["n", "mean", "q1", "median", "q3", "lower_fence", "upper_fence",
                           "whisker_low", "whisker_high", "outliers"]
    if t == "violin":
        return [x, *col, "point"], ["n", "bandwidth", "q1", "median", "q3", "y_value", "density"]
    if t == "heatmap":
        return ["a", "b"], ["r"]
    if t == "line":
        return [x, *col], [y]
    if t == "sunburst":
        return ["id", "parent"], ["level", "count"]
    if t == "treemap":
        return ["id", "parent"], ["level", "value"]
    if t == "3d_scatter":
        nums = numeric_columns(df, exclude=[*key, *([color] if color else [])])
        return [*key, *([color] if color else [])], nums[:3]
    if t == "area":
        return [x, *col], ["value", "stack_top", "stack_base"]
    raise ValueError(f"unknown chart type: {t}")


def chart_long(df: DataFrame, spec: Mapping, index: int, key: Sequence[str] = ()) -> DataFrame:
    data = chart_data(df, spec, key)
    dims, measures = _shape(df, spec, key)
    label = F.concat_ws("|", *[F.coalesce(F.col(f"`{d}`").cast("string"), F.lit("null")) for d in dims]) \
        if dims else F.lit("")
    title = spec.get("title", f"{spec['type'].title()} Chart")
    return data.select(F.lit(index).alias("chart_index"), F.lit(title).alias("title"),
                       F.lit(spec["type"]).alias("chart_type"), label.alias("key"),
                       F.inline(F.array(*[F.struct(F.lit(m).alias("measure"),
                                                   F.col(f"`{m}`").cast("double").alias("value"))
                                          for m in measures])))


def usable_specs(df: DataFrame, name: str) -> list[tuple[int, dict]]:
    charts = TEMPLATES[name]["charts"]
    return [(i, s) for i, s in enumerate(charts) if all(c in df.columns for c in _spec_columns(s))]


def run_template(df: DataFrame, name: str, key: Sequence[str] = ()) -> dict[str, DataFrame]:
    return {s.get("title", s["type"]): chart_data(df, s, key) for _, s in usable_specs(df, name)}


def template_long(df: DataFrame, name: str, key: Sequence[str] = (),
                  materialize_input: bool = True) -> DataFrame:
    """All charts of a template as one long table. With several charts the input is written
    once to the shared folder (``materialize``) so each chart scans it instead of re-running
    its lineage."""
    specs = usable_specs(df, name)
    if materialize_input and len(specs) > 1:
        from tablescope.session import materialize
        df = materialize(df, f"template-{name}")
    parts = [chart_long(df, s, i, key) for i, s in specs]
    if not parts:
        raise ValueError(f"no chart of template {name} fits this table")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
