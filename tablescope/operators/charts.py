"""Chart data: the small tables behind 12 chart types, computed in Spark.

A chart library draws from these tables; no raw rows leave the cluster unless the chart is
a scatter (whose data is the rows, with an optional keyed sample).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablescope.functions.frames import col_of as _c, join_by_group, long_from_row, salts_of
from tablescope.functions.quantiles import grouped_quantiles, scalar_stats
from tablescope.functions.roles import is_numeric, numeric_columns
from tablescope.operators.stats import bin_index, corr_matrix


def _keys(x: str, color: str | None) -> list[str]:
    return [x] + ([color] if color and color != x else [])


def _present(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    cond = F.lit(True)
    for c in cols:
        cond = cond & _c(c).isNotNull()
    return df.where(cond)


def bar(df: DataFrame, x: str, y: str | None = None, color: str | None = None) -> DataFrame:
    """Bar heights: sum of y per x (and color); without y, the row count."""
    keys = _keys(x, color)
    base = _present(df, keys)
    agg = F.sum(_c(y)).alias("value") if y else F.count(F.lit(1)).alias("value")
    return base.groupBy(*[_c(k) for k in keys]).agg(agg)


def scatter(df: DataFrame, x: str, y: str, color: str | None = None, size: str | None = None,
            extra: Sequence[str] = (), key: Sequence[str] = ()) -> DataFrame:
    """Scatter rows (x, y present): key, x, y, color, size and hover columns of every row."""
    cols = list(dict.fromkeys([*key, x, y, *([color] if color else []), *([size] if size else []), *extra]))
    return _present(df, [x, y]).select(*[_c(c) for c in cols])


def histogram(df: DataFrame, x: str, bins: int = 20, color: str | None = None) -> DataFrame:
    """Counts per equal-width bin of x (per color). Text x gives counts per category."""
    dtype = df.schema[x].dataType
    if not is_numeric(dtype):
        return bar(df, x, None, color).withColumnRenamed("value", "count")
    v = _c(x).cast("double")
    rng = scalar_stats(df, {"lo": F.min(v), "hi": F.max(v)})
    keys = [color] if color else []
    base = _present(df.where(v.isNotNull()), keys).select(*[_c(k) for k in keys],
                                          bin_index(v, rng["lo"], rng["hi"], bins).alias("bin"))
    counts = base.groupBy(*[_c(k) for k in keys], "bin").count()
    width = (rng["hi"] - rng["lo"]) / F.lit(float(bins))
    return counts.select(*[_c(k) for k in keys], "bin", (rng["lo"] + F.col("bin") * width).alias("bin_lo"),
                         (rng["lo"] + (F.col("bin") + 1) * width).alias("bin_hi"), "count")


def pie(df: DataFrame, x: str, y: str | None = None) -> DataFrame:
    """Slice value (sum of y, or the row count) and share of the whole per x."""
    base = _present(df, [x])
    measure = F.sum(_c(y)) if y else F.count(F.lit(1))
    total = scalar_stats(base, {"t": measure.cast("double")})["t"]
    return base.groupBy(_c(x)).agg(measure.alias("value")).withColumn(
        "share", F.try_divide(F.col("value").cast("double"), total))


QUARTILES, QUARTILE_NAMES = [0.25, 0.5, 0.75], ["q1", "median", "q3"]
SPREAD = {"std": F.stddev_samp, "y_min": F.min, "y_max": F.max}


def box(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """Per group: n, mean, q1, median, q3, fences, whiskers (furthest points inside the
    fences) and the outlier count. Quartiles interpolate linearly, as the IQR outlier panel.

    The quartiles come from written group tables; one more scan joins the fences to the rows,
    salted, and aggregates the whiskers.
    """
    keys = _keys(x, color)
    base = _present(df, [*keys, y]).select(*[_c(k) for k in keys], _c(y).cast("double").alias("__y"))
    return box_of(base, grouped_quantiles(base, "__y", QUARTILES, by=keys, names=QUARTILE_NAMES, extra={"mean": F.avg}), keys)


def box_of(base: DataFrame, q: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The box table of rows (keys, __y), given n, mean and quartiles per group."""
    quoted = [_c(k) for k in keys]
    q = (q.select(*quoted, "n", "mean", "q1", "median", "q3")
         .withColumn("lower_fence", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")))
         .withColumn("upper_fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))))
    y_ = F.col("__y")
    whiskers = (join_by_group(base, q.select(*quoted, "lower_fence", "upper_fence"), keys, salts_of(q))
                .groupBy(*quoted)
                .agg(F.min(F.when(y_ >= F.col("lower_fence"), y_)).alias("whisker_low"),
                     F.max(F.when(y_ <= F.col("upper_fence"), y_)).alias("whisker_high"),
                     F.count_if((y_ < F.col("lower_fence")) | (y_ > F.col("upper_fence")))
                     .alias("outliers")))
    return q.join(whiskers, keys)


def heatmap(df: DataFrame, x: str | None = None, y: str | None = None) -> DataFrame:
    """Correlation matrix of the numeric columns; with fewer than 2 it falls back to a bar."""
    if len(numeric_columns(df)) >= 2:
        return corr_matrix(df)
    if x is None:
        raise ValueError("heat map needs 2 numeric columns or an x for the bar fallback")
    return bar(df, x, y)


SQRT_2PI = math.sqrt(2.0 * math.pi)
CELLS = 8                    # cells of one bandwidth, for the binned density
TERMS = 8                    # moments kept per cell
REACH = 9.0                  # bandwidths beyond which a value adds less than 3e-18 of the kernel's peak
MAX_SPAN = 2.0 ** 40         # bandwidths that the binned density spans


def _hermite(terms: int) -> list[list[int]]:
    """Coefficients of the probabilists' Hermite polynomials He_0 .. He_(terms - 1), constant term first."""
    out = [[1], [0, 1]]
    for j in range(1, terms - 1):
        up, down = [0, *out[j]], [*out[j - 1], 0, 0]
        out.append([x - j * y for x, y in zip(up, down, strict=True)])
    return out[:terms]


def _exact_density(base: DataFrame, st: DataFrame, keys: Sequence[str], grid: int) -> DataFrame:
    """(keys, __point, __sum): the kernel sum at every grid point, an exponential per different value and point."""
    quoted = [_c(k) for k in keys]
    counted = base.groupBy(*quoted, "__y").agg(F.count(F.lit(1)).cast("double").alias("__w"))
    joined = join_by_group(counted, st.select(*quoted, "bandwidth", "grid_lo", "grid_step"), keys, salts_of(st))
    sums = [F.sum(F.col("__w") * F.exp(F.lit(-0.5) * F.pow((F.col("grid_lo") + F.lit(float(i)) * F.col("grid_step") - F.col("__y"))
                                                           / F.col("bandwidth"), 2))).alias(f"k{i}") for i in range(grid)]
    wide = joined.groupBy(*quoted).agg(*sums)
    return wide.select(*quoted, F.posexplode(F.array(*[f"k{i}" for i in range(grid)])).alias("__point", "__sum"))


def _binned_density(base: DataFrame, st: DataFrame, keys: Sequence[str], grid: int) -> DataFrame:
    """(keys, __point, __sum): the kernel sum by cells of an eighth of a bandwidth.

    A cell keeps the sums of the powers 0..7 of its values' distances to its centre. A value d bandwidths off the
    centre adds exp(-(z - d)^2 / 2) = exp(-z^2 / 2) * sum of He_j(z) d^j / j! at a grid point z bandwidths away; cut
    after 8 terms with |d| <= 1/16 that is off by at most 105 / 8! / 16^8 < 7e-13 of the kernel's peak (105: the largest
    value of |He_8(z)| exp(-z^2 / 2)). Values and points more than ``REACH`` bandwidths apart are left out. So a row costs
    eight sums whatever its value, and a group has at most grid * 2 * (REACH + 1) * CELLS cells.
    """
    quoted = [_c(k) for k in keys]
    rows = join_by_group(base, st.select(*quoted, "bandwidth", "grid_lo", "grid_step"), keys, salts_of(st))
    u, gap = F.col("__u"), F.col("__gap")
    rows = rows.select(*quoted, ((F.col("__y") - F.col("grid_lo")) / F.col("bandwidth")).alias("__u"),
                       (F.col("grid_step") / F.col("bandwidth")).alias("__gap"))
    nearest = F.greatest(F.lit(0.0), F.least(F.lit(float(grid - 1)), F.rint(u / gap)))
    rows = rows.where(F.abs(u - nearest * gap) <= REACH).withColumn("__cell", F.floor(u * CELLS))
    rows = rows.withColumn("__d", u - (F.col("__cell") + 0.5) / CELLS)
    power = [F.lit(1.0)]
    for _ in range(TERMS - 1):
        power.append(power[-1] * F.col("__d"))
    cells = rows.groupBy(*quoted, "__cell").agg(F.max("__gap").alias("__gap"), *[F.sum(x).alias(f"__m{j}") for j, x in enumerate(power)])
    # the sum over j as one polynomial in z
    he = _hermite(TERMS)
    coef = [sum((F.col(f"__m{j}") * (he[j][p] / math.factorial(j)) for j in range(p + 1, TERMS) if he[j][p]),
                F.col(f"__m{p}") / math.factorial(p)) for p in range(TERMS)]
    centre = (F.col("__cell") + 0.5) / CELLS
    first = F.greatest(F.lit(0), F.ceil((centre - REACH - 1) / gap).cast("int"))
    last = F.least(F.lit(grid - 1), F.floor((centre + REACH + 1) / gap).cast("int"))
    cells = cells.select(*quoted, gap, centre.alias("__c"), *[c.alias(f"__c{p}") for p, c in enumerate(coef)],
                         first.alias("__first"), last.alias("__last")).where("__first <= __last")
    points = cells.withColumn("__point", F.explode(F.sequence("__first", "__last")))
    points = points.withColumn("__z", F.col("__point") * gap - F.col("__c"))
    value = F.col(f"__c{TERMS - 1}")
    for p in reversed(range(TERMS - 1)):
        value = value * F.col("__z") + F.col(f"__c{p}")
    return points.groupBy(*quoted, "__point").agg(F.sum(value * F.exp(F.col("__z") * F.col("__z") * -0.5)).alias("__sum"))


def violin(df: DataFrame, x: str, y: str, color: str | None = None, grid: int = 50, exact: bool = False) -> DataFrame:
    """Gaussian kernel density of y per group on ``grid`` points, plus the box numbers.

    Bandwidth (Silverman): 1.059 * min(sample std, IQR / 1.349) * n^(-1/5); when that is 0
    the sample std is used, and 1.0 when that is 0 too. The grid spans [min - 2 bw, max + 2 bw].
    Values are binned into cells with moments (``_binned_density``): constant cost per row, the density within
    7e-13 / (bandwidth * sqrt(2 pi)) of the kernel sum. ``exact=True`` sums the kernel over the different values
    instead, as does a table with a group that spans more than ``MAX_SPAN`` bandwidths, whose cells would not be exact numbers.
    """
    keys = _keys(x, color)
    base = _present(df, [*keys, y]).select(*[_c(k) for k in keys], _c(y).cast("double").alias("__y"))
    return violin_of(base, grouped_quantiles(base, "__y", QUARTILES, by=keys, names=QUARTILE_NAMES, extra=SPREAD), keys, grid, exact)


def violin_of(base: DataFrame, st: DataFrame, keys: Sequence[str], grid: int = 50, exact: bool = False) -> DataFrame:
    """The violin table of rows (keys, __y), given n, quartiles and the ``SPREAD`` per group."""
    quoted = [_c(k) for k in keys]
    st = st.select(*quoted, "n", "std", "y_min", "y_max", "q1", "median", "q3")
    raw_bw = F.lit(1.059) * F.least(F.col("std"), (F.col("q3") - F.col("q1")) / F.lit(1.349)) \
        * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    bw = F.when(raw_bw > 0, raw_bw).when(F.col("std") > 0, F.col("std")).otherwise(F.lit(1.0))
    st = st.withColumn("bandwidth", bw)
    st = st.withColumn("grid_lo", F.col("y_min") - 2 * F.col("bandwidth")) \
           .withColumn("grid_step", (F.col("y_max") - F.col("y_min") + 4 * F.col("bandwidth"))
                       / F.lit(float(grid - 1)))
    if not exact:
        span = st.agg(F.max((F.col("y_max") - F.col("y_min")) / F.col("bandwidth"))).first()[0]
        exact = span is not None and not span <= MAX_SPAN
    dens = (_exact_density if exact else _binned_density)(base, st, keys, grid)
    full = st.withColumn("__point", F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))).join(dens, [*keys, "__point"], "left")
    return full.select(*quoted, "n", "bandwidth", "q1", "median", "q3", F.col("__point").alias("point"),
                       (F.col("grid_lo") + F.col("__point") * F.col("grid_step")).alias("y_value"),
                       (F.coalesce("__sum", F.lit(0.0)) / (F.col("n") * F.col("bandwidth") * F.lit(SQRT_2PI))).alias("density"))


def line(df: DataFrame, x: str, y: str, color: str | None = None, agg: str | None = None,
         key: Sequence[str] = ()) -> DataFrame:
    """Points of y against x (per color), sorted; ``agg='mean'|'sum'|...`` aggregates per x first.

    Raw points are sorted by color, x, ``key`` and y: with a row key the range sort splits even
    when few different (color, x) pairs hold all rows."""
    keys = _keys(x, color)
    base = _present(df, [*keys, y])
    order = [_c(c) for c in ([color] if color else []) + [x]]
    if agg is None:
        return base.select(*[_c(k) for k in [*key, *keys]], _c(y)).orderBy(*order, *[_c(k) for k in key], _c(y))
    fn = {"mean": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[agg]
    return base.groupBy(*[_c(k) for k in keys]).agg(fn(_c(y)).alias(y)).orderBy(*order)


def _path_nodes(df: DataFrame, path: Sequence[str], measure: Column, name: str) -> DataFrame:
    base = df.where(_c(path[0]).isNotNull())
    groups = [F.grouping(_c(c)).alias(f"__g{i}") for i, c in enumerate(path)]
    r = base.rollup(*[_c(c) for c in path]).agg(measure.alias(name), *groups)
    level = sum((1 - F.col(f"__g{i}")) for i in range(len(path)))
    r = r.withColumn("level", level.cast("int"))
    keep = F.lit(True)
    for i, c in enumerate(path):       # a null inside the branch ends it
        keep = keep & ((F.col("level") <= i) | _c(c).isNotNull())
    r = r.where(keep)
    labels = [_c(c).cast("string") for c in path]
    node = F.lit("total")
    parent = F.lit(None).cast("string")
    for lvl in range(1, len(path) + 1):
        node = F.when(F.col("level") == lvl, F.concat_ws("/", *labels[:lvl])).otherwise(node)
        parent = F.when(F.col("level") == lvl,
                        F.concat_ws("/", *labels[:lvl - 1]) if lvl > 1 else F.lit("total")).otherwise(parent)
    return r.select("level", *[_c(c) for c in path], node.alias("id"), parent.alias("parent"), name)


def sunburst(df: DataFrame, path: Sequence[str]) -> DataFrame:
    """Row counts per node of the path hierarchy (ROLLUP): parents equal the sum of children."""
    return _path_nodes(df, path, F.count(F.lit(1)), "count")


def treemap(df: DataFrame, path: Sequence[str], y: str) -> DataFrame:
    """Sum of y per node of the path hierarchy (ROLLUP), with a root node."""
    return _path_nodes(df, path, F.sum(_c(y)), "value")


def scatter3d(df: DataFrame, color: str | None = None, key: Sequence[str] = (),
              x: str | None = None, y: str | None = None) -> DataFrame:
    """x, y, z = the first three numeric columns (key and color excluded); with fewer than
    three, a 2D scatter of x and y."""
    nums = numeric_columns(df, exclude=[*key, *([color] if color else [])])
    if len(nums) < 3:
        if not (x and y):
            raise ValueError("3D scatter needs 3 numeric columns or x and y")
        return scatter(df, x, y, color, key=key)
    a, b, c = nums[:3]
    base = _present(df, [a, b, c])
    cols = [*key, a, b, c, *([color] if color else [])]
    return base.select(*[_c(k) for k in cols])


def area(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """Stacked areas: sum of y per (x, color) and the running top of the stack within each x.

    The running sum is a window over the aggregated rows of one x value (colors per x), never
    over the base table.
    """
    keys = _keys(x, color)
    agg = _present(df, keys).groupBy(*[_c(k) for k in keys]).agg(F.sum(_c(y)).alias("value"))
    if not color:
        return agg.withColumn("stack_top", F.col("value")).withColumn("stack_base", F.lit(0.0))
    w = Window.partitionBy(_c(x)).orderBy(_c(color)).rowsBetween(Window.unboundedPreceding, 0)
    return (agg.withColumn("stack_top", F.sum("value").over(w))
            .withColumn("stack_base", F.col("stack_top") - F.col("value")))
