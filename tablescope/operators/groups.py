"""Grouped summaries: value counts, shares, outcome rates, numeric stats by group, crosstab."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.frames import col_of
from tablescope.functions.values import round_half_even
from tablescope.functions.quantiles import grouped_quantiles, scalar_stats
from tablescope.functions.values import map_values

# Labels of a 0/1 outcome.
BINARY_LABELS = {0: "Did Not Survive", 1: "Survived"}

_STATS = {
    "mean": lambda v: F.avg(v),
    "count": lambda v: F.count(v),
    "std": lambda v: F.stddev_samp(v),
    "sum": lambda v: F.sum(v),
    "min": lambda v: F.min(v),
    "max": lambda v: F.max(v),
}


def keep_empty_groups(agg: DataFrame, by: str, labels: Sequence[str],
                      zero_cols: Sequence[str] = ()) -> DataFrame:
    """List every label of ``labels`` (in order), also the ones no row fell into.

    The label domain is a literal of len(labels) rows; groups outside it are dropped, as a
    categorical group-by does. Counts and sums of an empty group are 0, means are null.
    """
    spark = agg.sparkSession
    dom = spark.createDataFrame([(str(l), i) for i, l in enumerate(labels)],
                                f"`{by}` string, `{by}_ordinal` int")
    out = dom.join(agg, by, "left")
    if zero_cols:
        out = out.withColumns({c: F.coalesce(col_of(c), F.lit(0)) for c in zero_cols})
    return out.orderBy(col_of(f"{by}_ordinal"))


def value_counts(df: DataFrame, col: str, order: str = "key") -> DataFrame:
    """(value, count, percent) of non-null values; percent is of all rows, nulls included."""
    total = scalar_stats(df, {"n": F.count(F.lit(1))})["n"]
    counts = df.where(col_of(col).isNotNull()).groupBy(col_of(col)).agg(F.count(F.lit(1)).alias("count"))
    out = counts.withColumn("percent", F.try_divide(F.col("count") * 100.0, total))
    if order == "key":
        return out.orderBy(col_of(col))
    return out.orderBy(F.col("count").desc(), col_of(col))


def binary_share(df: DataFrame, col: str, labels=BINARY_LABELS) -> DataFrame:
    """(value, label, count, total, rate) of a 0/1 column; labels follow the value, not position."""
    total = scalar_stats(df, {"n": F.count(col_of(col))})["n"]
    counts = df.where(col_of(col).isNotNull()).groupBy(col_of(col)).agg(F.count(F.lit(1)).alias("count"))
    return counts.select(col_of(col).alias("value"), map_values(col_of(col), labels).alias("label"),
                         "count", total.alias("total"),
                         F.try_divide(F.col("count").cast("double"), total).alias("rate")) \
        .orderBy("value")


def outcome_rate(df: DataFrame, by: str, outcome: str, labels: Sequence[str] | None = None) -> DataFrame:
    """(by, total, positives, rate) of a 0/1 outcome per group; null groups dropped.

    With ``labels`` the group column is a binned category: every label is listed, empty ones
    with total 0, positives 0, rate null.
    """
    agg = (df.where(col_of(by).isNotNull()).groupBy(col_of(by))
           .agg(F.count(col_of(outcome)).alias("total"),
                F.sum(col_of(outcome)).cast("long").alias("positives"),
                F.avg(col_of(outcome).cast("double")).alias("rate")))
    if labels is None:
        return agg.orderBy(col_of(by))
    return keep_empty_groups(agg, by, labels, zero_cols=("total", "positives"))


def numeric_by_group(df: DataFrame, by: str, value: str,
                     stats: Sequence[str] = ("mean", "count", "std"),
                     decimals: int | None = 2, labels: Sequence[str] | None = None) -> DataFrame:
    """Named statistics of ``value`` per group (``<value>_<stat>``), rounded half-even."""
    base = df.where(col_of(by).isNotNull())

    def fmt(e, s):
        return round_half_even(e, decimals) if s != "count" and decimals is not None else e

    if "median" in stats:
        # exact medians with bounded memory; the other statistics ride along in pass 1
        q = grouped_quantiles(base, value, [0.5], by=[by], names=["__median"],
                              extra={f"__{s}": _STATS[s] for s in stats if s != "median"})
        agg = q.select(col_of(by), *[fmt(F.col("__median") if s == "median" else F.col(f"__{s}"), s)
                             .alias(f"{value}_{s}") for s in stats])
    else:
        v = col_of(value).cast("double")
        agg = base.groupBy(col_of(by)).agg(*[fmt(_STATS[s](v if s != "count" else col_of(value)), s)
                                     .alias(f"{value}_{s}") for s in stats])
    if labels is None:
        return agg.orderBy(col_of(by))
    zero = [f"{value}_count"] if "count" in stats else []
    return keep_empty_groups(agg, by, labels, zero_cols=zero)


def extremes(agg: DataFrame, key: str, col: str) -> DataFrame:
    """Highest and lowest value of an aggregate column with the group that holds it.

    Ties go to the largest key for the maximum and the smallest key for the minimum.
    """
    return agg.where(col_of(col).isNotNull()).agg(
        F.max(F.struct(col_of(col), col_of(key))).alias("hi"),
        F.min(F.struct(col_of(col), col_of(key))).alias("lo"),
    ).select(F.col("hi").getField(col).alias("max_value"), F.col("hi").getField(key).alias("max_key"),
             F.col("lo").getField(col).alias("min_value"), F.col("lo").getField(key).alias("min_key"))


def crosstab(df: DataFrame, a: str, b: str, values: Sequence | None = None) -> DataFrame:
    """Row counts of ``a`` x ``b`` as a wide table (one column per value of ``b``), 0 when absent.

    Pass ``values`` to skip the extra job that finds the distinct values of ``b``.
    """
    base = df.where(col_of(a).isNotNull() & col_of(b).isNotNull()).select(col_of(a), col_of(b).alias("__b"))
    pivoted = base.groupBy(col_of(a)).pivot("__b", list(values) if values is not None else None).count()
    return pivoted.withColumns({c: F.coalesce(col_of(c), F.lit(0)) for c in pivoted.columns if c != a}).orderBy(col_of(a))


def crosstab_long(df: DataFrame, a: str, b: str) -> DataFrame:
    """The same counts in long form (a, b, count): no pivot, no distinct-value job."""
    return (df.where(col_of(a).isNotNull() & col_of(b).isNotNull())
            .groupBy(col_of(a), col_of(b)).agg(F.count(F.lit(1)).alias("count")))
