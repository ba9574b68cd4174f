"""Filter panel: value domains, filters that really filter, status, axis bounds, preview."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablescope.functions.frames import col_of, long_from_row
from tablescope.functions.roles import categorical_columns, numeric_columns


def filter_domains_categorical(df: DataFrame, cols: Sequence[str] | None = None, limit: int = 20) -> DataFrame:
    """(column, position, value, value_rank): up to ``limit`` distinct non-null values per column.

    Spark has no row order, so the smallest values are listed (not the first seen). One route
    for every column: a thinned copy (one row in 1,024 by row hash) gives, where it has ``limit`` different values, an
    upper bound of the wanted ones; the full scan drops everything above it, then
    de-duplicates map-side, then ranks. A column without a bound is not filtered. The result is
    exact either way: the ``limit`` smallest values of a subset are never below the true ones.
    """
    cols = list(cols) if cols is not None else categorical_columns(df)
    if not cols:
        raise ValueError("no categorical columns")
    def pairs(frame, bounds=None):
        parts = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), col_of(c).cast("string").alias("value"))
                 for i, c in enumerate(cols)]
        out = frame.select(F.inline(F.array(*parts))).where("value is not null")
        return out if bounds is None else out.where(
            F.coalesce(F.col("value") <= F.element_at(bounds, F.col("position")), F.lit(True)))

    w = Window.partitionBy("position").orderBy("value")
    thin = df.where(F.pmod(F.xxhash64(*[col_of(c) for c in cols], F.monotonically_increasing_id()), F.lit(1024)) == 0)
    seen = pairs(thin).distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") == limit)
    bounds = seen.agg(F.map_from_entries(F.collect_list(F.struct("position", "value"))).alias("m")).scalar()   # a value per column
    distinct = pairs(df, bounds).distinct()
    return (distinct.withColumn("value_rank", F.row_number().over(w).cast("bigint"))
            .where(F.col("value_rank") <= limit)
            .select("column", "position", "value", "value_rank"))


def filter_domains_numeric(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, position, min, max, slider_min, slider_max, exact_min, exact_max); all-null columns get no row.

    The slider bounds are floor/ceil of the uncast values, so no value falls outside them. ``min`` and
    ``max`` are doubles so that one table holds every column; ``exact_min`` and ``exact_max`` are the
    same values as text in their own type (a 64-bit integer may have no double).
    """
    cols = list(cols) if cols is not None else numeric_columns(df)
    aggs = [F.struct(F.min(col_of(c)).alias("lo"), F.max(col_of(c)).alias("hi")).alias(f"c{i}") for i, c in enumerate(cols)]
    row = df.agg(*aggs)

    def whole(fn, v):
        return fn(v).cast("long")
    items = [{"column": F.lit(c), "position": F.lit(i), "min": F.col(f"c{i}.lo").cast("double"),
              "max": F.col(f"c{i}.hi").cast("double"), "slider_min": whole(F.floor, F.col(f"c{i}.lo")),
              "slider_max": whole(F.ceil, F.col(f"c{i}.hi")), "exact_min": F.col(f"c{i}.lo").cast("string"),
              "exact_max": F.col(f"c{i}.hi").cast("string")} for i, c in enumerate(cols)]
    return long_from_row(row, items).where(F.col("min").isNotNull())


@dataclass(frozen=True)
class Range:
    """Values from ``lo`` to ``hi``, both included; None leaves a side open."""

    lo: object = None
    hi: object = None


def filter_predicate(filters: Mapping[str, object]) -> Column:
    """AND of per-column conditions: a list or tuple of values -> ``isin``; a ``Range`` -> between.

    An empty list or None means no condition on that column. Nulls never pass a condition.
    """
    pred = F.lit(True)
    for col, cond in filters.items():
        c = col_of(col)
        if cond is None:
            continue
        if isinstance(cond, Range):
            if cond.lo is not None:
                pred = pred & (c >= F.lit(cond.lo))
            if cond.hi is not None:
                pred = pred & (c <= F.lit(cond.hi))
            pred = pred & c.isNotNull()
        else:
            values = list(cond)
            if not values:
                continue
            pred = pred & c.isin(*values)
    return pred


def apply_filters(df: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    """Keep the rows that meet every filter; Catalyst pushes these into the Parquet scan."""
    return df.where(filter_predicate(filters))


def filter_status(df: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    """Rows before and after filtering, counted in one pass."""
    return df.agg(F.count(F.lit(1)).alias("rows_before"),
                  F.count_if(filter_predicate(filters)).alias("rows_after"))


def apply_axis(df: DataFrame, col: str, lo: float | None = None, hi: float | None = None,
               scale: str = "linear", name: str = "axis_value") -> DataFrame:
    """Chart axis range and scale: rows inside [lo, hi]; ``log`` keeps positive values as log10."""
    c = col_of(col)
    out = df.where(c.isNotNull())
    if lo is not None:
        out = out.where(c >= F.lit(lo))
    if hi is not None:
        out = out.where(c <= F.lit(hi))
    if scale == "log":
        return out.where(c > 0).withColumn(name, F.log10(c))
    if scale != "linear":
        raise ValueError("scale must be 'linear' or 'log'")
    return out.withColumn(name, c.cast("double"))


def preview(df: DataFrame, order_by, n: int = 10, where: Column | None = None,
            columns: Sequence[str] | None = None, descending: bool = False) -> DataFrame:
    """Filter, sort and keep ``n`` rows: planned as one TakeOrderedAndProject (top-k)."""
    keys = [order_by] if isinstance(order_by, (str, Column)) else list(order_by)
    out = df.where(where) if where is not None else df
    if columns is not None:
        out = out.select(*[col_of(c) for c in columns])
    order = [k if isinstance(k, Column) else
             (F.col(f"`{k}`").desc() if descending else F.col(f"`{k}`")) for k in keys]
    return out.orderBy(*order).limit(n)


def shape(df: DataFrame) -> DataFrame:
    return long_from_row(df.agg(F.count(F.lit(1)).alias("n")),
                         [{"rows": F.col("n"), "columns": F.lit(len(df.columns))}])
