"""Exact quantiles by radix selection, and scalar statistics that travel inside the plan.

``scalar_stats`` wraps a one-row aggregate as a scalar subquery: Spark runs it once
(partial + final aggregate), and the value is used like a literal in the outer plan. No
cross join and no driver round trip.

``grouped_quantiles`` is the one quantile method, whatever the number of rows and the spread of the values. It
runs jobs while the plan is built: it writes the keys and the value once, then narrows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.functions.frames import col_of, join_by_group, salts_of
from tablescope.session import discard, materialize

BITS = 12                    # bits of the image that one pass settles: 4,096 bins


def scalar_stats(df: DataFrame, exprs: Mapping[str, Column]) -> dict[str, Column]:
    """One global aggregate over ``df`` as a scalar subquery; returns a column per name."""
    names = list(exprs)
    packed = df.agg(F.struct(*[exprs[n].alias(f"s{i}") for i, n in enumerate(names)]).alias("s")).scalar()
    return {n: packed.getField(f"s{i}") for i, n in enumerate(names)}


def mode_of(df: DataFrame, col: str) -> Column:
    """Most frequent non-null value of ``col``; ties go to the smallest value (pandas ``mode()[0]``).

    Counted with a grouped aggregate (map-side combined), then reduced with ``min`` over
    (-count, value): no per-group buffer holds more than one entry.
    """
    counts = df.select(col_of(col).alias("v")).where("v is not null").groupBy("v").count()
    best = counts.agg(F.min(F.struct((-F.col("count")).alias("k"), "v")).alias("m"))
    return best.scalar().getField("v")


def with_image(rows: DataFrame, value: str, out: str) -> DataFrame:
    """Adds the order-preserving 64-bit image of a double column without NaN: its IEEE bits without the sign,
    negative for negative values. Both zeros map to 0. It is built from exponent and fraction, both exact, in
    steps of their own, so that each is computed once per row."""
    v, near, share = F.col(value), F.col("__near"), F.col("__share")
    guess = F.greatest(F.lit(-1022), F.least(F.lit(1023), F.floor(F.log2(F.abs(v))))).cast("int")
    rows = rows.withColumn("__near", F.when(F.abs(v) > 0, guess).otherwise(F.lit(-1022)))
    rows = rows.withColumn("__share", F.abs(v) / F.pow(F.lit(2.0), near.cast("double")))
    # the logarithm is rounded, so it may be one off next to a power of two
    step = F.when(share >= 2, F.lit(1)).when((share < 1) & (near > -1022), F.lit(-1)).otherwise(F.lit(0))
    fraction = share * F.when(share >= 2, F.lit(2.0 ** 51)).when((share < 1) & (near > -1022), F.lit(2.0 ** 53)).otherwise(F.lit(2.0 ** 52))
    bits = (F.when(F.abs(v) == float("inf"), F.lit(2047 << 52))
            .otherwise((near + step + 1022).cast("long") * F.lit(1 << 52) + fraction.cast("long")))
    return rows.withColumn(out, F.when(v < 0, -bits).otherwise(bits)).drop("__near", "__share")


def from_image(i: Column) -> Column:
    """The double of an image."""
    bits = F.abs(i)
    exponent = F.shiftright(bits, 52)
    fraction = (bits - F.greatest(exponent - 1, F.lit(0)) * F.lit(1 << 52)).cast("double") / F.lit(2.0 ** 52)
    size = F.when(exponent == 2047, F.lit(float("inf"))).otherwise(
        fraction * F.pow(F.lit(2.0), F.greatest(exponent - 1023, F.lit(-1022)).cast("double")))
    return F.when(i < 0, -size).otherwise(size)


def _shift(lo: Column, hi: Column) -> Column:
    """Low bits to leave out, so that lo..hi falls into about 2^BITS bins; halved, so nothing overflows."""
    width = F.shiftright(hi, 1) - F.shiftright(lo, 1)
    return F.greatest(F.lit(0), F.length(F.bin(width)) + 1 - BITS)


def grouped_quantiles(df: DataFrame, value: str, probs, by=(), names=None, extra: Mapping | None = None) -> DataFrame:
    """Quantiles of ``value`` per group: columns *by, n, <names...>, <extra...>.

    Linear interpolation between the order statistics at floor and ceil of (n-1)p, the same
    numbers as Spark ``percentile``, pandas ``quantile`` and DuckDB ``quantile_cont``.
    Null and NaN values are ignored; rows with a null group key are dropped. ``extra`` adds
    aggregates of the value column (name -> function of a Column).

    Radix selection on the 64-bit images of the values (``image``): a grouped aggregate gives n, minimum and
    maximum; then every needed rank narrows its range. A pass counts the rows of each (group, range, bin),
    where a bin is the next 12 bits that differ within the range, keeps the bin that holds the rank with its exact
    minimum and maximum, and repeats inside it until that bin has one value. A range loses 12 bits a pass,
    so there are at most 6 passes whatever the values are; few different values need one or two. Counts are combined
    map-side and shuffled on (group, range, bin), so a hot group is never one task, no
    task holds more than bins, and nothing is collected. From the third pass on only rows inside a kept bin are read.
    """
    probs = [float(p) for p in probs]
    names = list(names) if names is not None else [f"q{i}" for i in range(len(probs))]
    extra = dict(extra or {})
    by = list(by)
    keys = [f"__k{i}" for i in range(len(by))] or ["__all"]
    v, i = F.col("__v"), F.col("__i")
    parts = [col_of(b).alias(k) for b, k in zip(by, keys)] or [F.lit(0).alias("__all")]
    rows = df.select(*parts, col_of(value).cast("double").alias("__v")).where(v.isNotNull() & ~F.isnan(v)).dropna(subset=keys)
    rows = materialize(with_image(rows, "__v", "__i").select(*keys, *(["__v"] if extra else []), "__i"), "quantile-input")

    extras = [fn(v).alias(f"__x{j}") for j, fn in enumerate(extra.values())]
    stats = materialize(rows.groupBy(*keys).agg(F.count(i).alias("n"), F.min(i).alias("lo"), F.max(i).alias("hi"), *extras),
                        "quantile-groups")
    most, some = stats.agg(F.max("n"), F.bool_or(F.col("lo") < F.col("hi"))).first()
    salts = salts_of(most)
    at = [(F.col("n") - 1).cast("double") * F.lit(p) for p in probs]
    ranks = F.array_distinct(F.array(*[r for a in at for r in (F.floor(a), F.ceil(a))]))
    state = stats.select(*keys, F.explode(ranks).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("before"))
    done, open_, passes = state.where("lo = hi"), state.where("lo < hi"), 0
    while some:
        spans = open_.select(*keys, "lo", "hi").distinct().withColumn("drop", _shift(F.col("lo"), F.col("hi")))
        inside = join_by_group(rows, spans, keys, salts).where(i.between(F.col("lo"), F.col("hi")))
        if passes == 2:
            fewer = materialize(inside.select(*keys, "__i"), "quantile-rows")
            discard(rows)
            rows = fewer
            inside = join_by_group(rows, spans, keys, salts).where(i.between(F.col("lo"), F.col("hi")))
        number = F.expr("shiftright(__i, drop) - shiftright(lo, drop)")
        bins = (inside.groupBy(*keys, "lo", "hi", number.alias("bin"))
                .agg(F.count(i).alias("c"), F.min(i).alias("mn"), F.max(i).alias("mx")))
        order = Window.partitionBy(*keys, "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        bins = bins.withColumn("through", F.sum("c").over(order))
        step = (open_.join(bins, [*keys, "lo", "hi"])
                .where((F.col("rank") < F.col("before") + F.col("through"))
                       & (F.col("rank") >= F.col("before") + F.col("through") - F.col("c")))
                .select(*keys, "rank", F.col("mn").alias("lo"), F.col("mx").alias("hi"),
                        (F.col("before") + F.col("through") - F.col("c")).alias("before")))
        step = materialize(step, "quantile-ranks")
        done = done.unionByName(step.where("lo = hi"))
        open_, passes = step.where("lo < hi"), passes + 1
        some = not open_.isEmpty()
    discard(rows)
    # at most two ranks per probability and group
    values = done.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", from_image(F.col("lo"))))).alias("at"))
    found = stats.join(values, keys)
    outs = []
    for a, name in zip(at, names):
        k, k2 = F.floor(a), F.ceil(a)
        x, y = F.element_at("at", k), F.element_at("at", k2)
        outs.append(F.when((k == k2) | (x == y), x).otherwise((k2 - a) * x + (a - k) * y).alias(name))
    return found.select(*[F.col(k).alias(b) for b, k in zip(by, keys)], "n", *outs,
                        *[F.col(f"__x{i}").alias(n) for i, n in enumerate(extra)])


def column_quantiles(df: DataFrame, cols, probs, extra=None) -> DataFrame:
    """Quantiles of several columns, all narrowed in the same passes: the columns are unpivoted to
    (column position, value) and grouped by position. Columns: __pos, n, q0.., extra..."""
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("__pos"), col_of(c).cast("double").alias("__val"))
        for i, c in enumerate(cols)])))
    return grouped_quantiles(long, "__val", probs, by=["__pos"], extra=extra)


def quantile_scalars(df: DataFrame, cols, probs) -> dict[str, list[Column]]:
    """{column: [quantile per prob]} as fields of one scalar subquery (no join, no collect)."""
    q = column_quantiles(df, cols, probs)
    names = [f"q{j}" for j in range(len(probs))]
    packed = q.agg(F.struct(*[F.max(F.when(F.col("__pos") == i, F.col(nm))).alias(f"c{i}_{nm}")
                              for i in range(len(cols)) for nm in names]).alias("s")).scalar()
    return {c: [packed.getField(f"c{i}_{nm}") for nm in names] for i, c in enumerate(cols)}
