"""Table profiles: metrics, missing values, describe, distinct counts, schema view, previews.

Each profile is one scan with one wide aggregate, reshaped to rows afterwards; never a
job per column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tablescope.functions.frames import col_of, long_from_row, wide_agg
from tablescope.functions.values import round_half_even
from tablescope.functions.quantiles import quantile_scalars
from tablescope.functions.roles import numeric_columns
from tablescope.functions.text import truncate_text


def _null_flags_sum(cols: Sequence[str]):
    expr = F.lit(0)
    for c in cols:
        expr = expr + col_of(c).isNull().cast("int")
    return expr


def table_metrics(df: DataFrame) -> DataFrame:
    """rows, mean of the first numeric column, % missing cells, column count (no row if empty)."""
    cols = df.columns
    nums = numeric_columns(df, 1)
    first = nums[0] if nums else None
    out = df.agg(
        F.count(F.lit(1)).alias("total_records"),
        (F.avg(col_of(first).cast("double")) if first else F.lit(None).cast("double"))
        .alias("first_numeric_avg"),
        F.sum(_null_flags_sum(cols)).cast("long").alias("missing_cells"),
    )
    return (out.where(F.col("total_records") > 0)
            .select("total_records",
                    F.lit(first).cast("string").alias("first_numeric"),
                    "first_numeric_avg",
                    "missing_cells",
                    (F.col("missing_cells") * 100.0 / (F.col("total_records") * F.lit(len(cols))))
                    .alias("missing_pct"),
                    F.lit(len(cols)).alias("n_columns")))


def missing_profile(df: DataFrame, only_missing: bool = False) -> DataFrame:
    """(column, position, missing_count, missing_pct) sorted by percent, then position."""
    cols = df.columns
    row = wide_agg(df, {"__n": F.count(F.lit(1)),
                        **{f"m{i}": F.count_if(col_of(c).isNull()) for i, c in enumerate(cols)}},
                   dtype="bigint")
    items = [{"column": F.lit(c), "position": F.lit(i), "missing_count": F.col(f"m{i}"),
              "missing_pct": F.try_divide(F.col(f"m{i}") * 100.0, F.col("__n"))}
             for i, c in enumerate(cols)]
    out = long_from_row(row, items)
    if only_missing:
        out = out.where(F.col("missing_count") > 0)
    return out.orderBy(F.col("missing_pct").desc_nulls_last(), "position")


DESCRIBE_STATS = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")


def describe(df: DataFrame, cols: Sequence[str] | None = None, decimals: int | None = 2) -> DataFrame:
    """count, mean, sample std, min, quartiles (linear interpolation), max per numeric column.

    One row per statistic (column ``stat``) and one column per numeric input column.
    """
    cols = list(cols) if cols is not None else numeric_columns(df)
    if not cols:
        raise ValueError("no numeric columns to describe")
    aggs, widths = {}, {}
    for i, c in enumerate(cols):
        x = col_of(c).cast("double")
        for name, expr, width in ((f"count{i}", F.count(x).cast("double"), 1), (f"mean{i}", F.avg(x), 2),
                                  (f"std{i}", F.stddev_samp(x), 3), (f"min{i}", F.min(x), 1),
                                  (f"max{i}", F.max(x), 1)):
            aggs[name], widths[name] = expr, width
    row = wide_agg(df, aggs, widths)
    qs = quantile_scalars(df, cols, [0.25, 0.5, 0.75])
    pick = {"count": lambda i: F.col(f"count{i}"), "mean": lambda i: F.col(f"mean{i}"),
            "std": lambda i: F.col(f"std{i}"), "min": lambda i: F.col(f"min{i}"),
            "25%": lambda i: qs[cols[i]][0], "50%": lambda i: qs[cols[i]][1],
            "75%": lambda i: qs[cols[i]][2], "max": lambda i: F.col(f"max{i}")}

    def fmt(e):
        return round_half_even(e, decimals) if decimals is not None else e

    items = [{"stat": F.lit(s), "stat_order": F.lit(k),
              **{c: fmt(pick[s](i)) for i, c in enumerate(cols)}}
             for k, s in enumerate(DESCRIBE_STATS)]
    return long_from_row(row, items).orderBy("stat_order").drop("stat_order")


_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _distinct_key(df: DataFrame, c: str):
    """A typed key per value: integral -> bigint, float/double -> double (-0.0 folded into
    0.0), anything else -> text. Exact, and no number is formatted as text."""
    v = col_of(c)
    dtype = df.schema[c].dataType
    none_l, none_d, none_s = F.lit(None).cast("bigint"), F.lit(None).cast("double"), F.lit(None).cast("string")
    if isinstance(dtype, _INTEGRAL):
        return F.struct(v.cast("bigint").alias("l"), none_d.alias("d"), none_s.alias("s"))
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        d = v.cast("double")
        return F.struct(none_l.alias("l"), F.when(d == 0, F.lit(0.0)).otherwise(d).alias("d"),
                        none_s.alias("s"))
    return F.struct(none_l.alias("l"), none_d.alias("d"), v.cast("string").alias("s"))


def cardinality(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, position, n_distinct) over non-null values.

    The columns are unpivoted to (position, typed value) and de-duplicated with one grouped
    aggregate (combined map-side), so the cost does not multiply with the column count the
    way several ``count(DISTINCT)`` in one aggregate do (Expand copies every row per column).
    """
    cols = list(cols) if cols is not None else numeric_columns(df)
    spark = df.sparkSession
    pairs = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), col_of(c).isNull().alias("missing"),
                 _distinct_key(df, c).alias("value"))
        for i, c in enumerate(cols)])))
    counts = (pairs.where(~F.col("missing"))
              .select("position", "value").distinct()
              .groupBy("position").agg(F.count(F.lit(1)).alias("n_distinct")))
    domain = spark.createDataFrame([(i, c) for i, c in enumerate(cols)],
                                   "position int, column string")
    return (domain.join(counts, "position", "left")
            .select("column", "position", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))
            .orderBy("position"))


def explore(df: DataFrame) -> DataFrame:
    """Shape and per-column info: (position, column, dtype, non_null, rows)."""
    cols = df.columns
    row = wide_agg(df, {"__n": F.count(F.lit(1)),
                        **{f"c{i}": F.count(col_of(c)) for i, c in enumerate(cols)}},
                   dtype="bigint")
    items = [{"position": F.lit(i), "column": F.lit(c),
              "dtype": F.lit(df.schema[c].dataType.simpleString()),
              "non_null": F.col(f"c{i}"), "rows": F.col("__n")}
             for i, c in enumerate(cols)]
    return long_from_row(row, items).orderBy("position")


def report_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def _order_cols(order_by):
    return [order_by] if isinstance(order_by, str) else list(order_by)


def report_preview(df: DataFrame, order_by, n: int = 5, width: int = 50,
                   keep: int = 47) -> DataFrame:
    """First ``n`` rows by the order key, every value as text cut to ``keep`` chars + '...'."""
    keys = _order_cols(order_by)
    top = df.orderBy(*keys).limit(n)
    return top.select(*[truncate_text(col_of(c), width, keep).alias(c) for c in df.columns])


def sample_series(df: DataFrame, order_by, n: int = 20, col: str | None = None) -> DataFrame:
    """First numeric column of the first ``n`` rows by the order key, with row position.

    The top-n is taken first (TakeOrderedAndProject), the position is numbered on those n
    rows only.
    """
    keys = _order_cols(order_by)
    col = col or numeric_columns(df, 1, exclude=())[0]
    top = df.select(*keys, col_of(col).alias("value")).orderBy(*keys).limit(n)
    w = Window.orderBy(*keys)
    return top.select((F.row_number().over(w) - 1).cast("bigint").alias("position"),
                      F.lit(col).alias("column"), "value")
