"""Statistics panels: correlation matrix and views of it, IQR outliers, distributions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions.frames import col_of
from tablescope.functions.quantiles import quantile_scalars, scalar_stats
from tablescope.functions.roles import numeric_columns


def _d(c: str) -> Column:
    return col_of(c).cast("double")


def _cross_products(k: int):
    """Per task: pairwise-complete counts and sums of every pair of columns, as k*k rows."""
    def run(batches):
        n, s, ss, xy = (np.zeros((k, k)) for _ in range(4))
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                x = np.column_stack([np.asarray(c.slice(at, 4096).to_numpy(zero_copy_only=False), dtype=np.float64) for c in b.columns])
                there = ~np.isnan(x)
                x[~there] = 0.0
                m = there.astype(np.float64)
                n += m.T @ m
                s += x.T @ m               # s[i, j]: sum of column i where i and j are present
                ss += (x * x).T @ m
                xy += x.T @ x
        i, j = np.divmod(np.arange(k * k), k)
        yield pa.record_batch({"i": pa.array(i.astype(np.int32)), "j": pa.array(j.astype(np.int32)), "n": pa.array(n.ravel()),
                               "si": pa.array(s.ravel()), "sj": pa.array(s.T.ravel()), "sii": pa.array(ss.ravel()),
                               "sjj": pa.array(ss.T.ravel()), "sij": pa.array(xy.ravel())})
    return run


def pair_correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(i, j, r) for every ordered pair of columns: Pearson r over the rows where both are present;
    null when either side is constant there. Clipped to [-1, 1]; NaN counts as missing.

    Two scans whatever the number of columns: the column means (a one-row aggregate that the plan
    uses as literals to centre the values), then masked cross-products per Arrow batch. A
    task hands on k*k rows of sums, which the JVM adds up.
    """
    value = {c: F.when(~F.isnan(_d(c)), _d(c)) for c in cols}
    mean = scalar_stats(df, {c: F.avg(value[c]) for c in cols})
    centred = df.select(*[(value[c] - mean[c]).alias(f"c{i}") for i, c in enumerate(cols)])
    sums = ["n", "si", "sj", "sii", "sjj", "sij"]
    parts = centred.mapInArrow(_cross_products(len(cols)), "i int, j int, " + ", ".join(f"{c} double" for c in sums))
    t = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in sums])
    vi, vj = F.expr("sii - si * si / n"), F.expr("sjj - sj * sj / n")
    # what rounding leaves of a constant column is no variance
    flat = (vi <= F.col("sii") * 1e-13) | (vj <= F.col("sjj") * 1e-13) | (F.col("n") < 2)
    r = F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.expr("sij - si * sj / n") / F.sqrt(vi * vj))
    return t.where("n > 0").select("i", "j", F.when(~flat, F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0))).alias("r"))


def corr_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Full matrix in long form (a, b, pos_a, pos_b, r); see ``pair_correlations``."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    if len(cols) < 2:
        raise ValueError("a correlation needs two numeric columns")
    cells = df.sparkSession.range(len(cols) ** 2).select(
        F.element_at(F.array(*[F.lit(c) for c in cols]), F.expr(f"cast(id div {len(cols)} as int) + 1")).alias("a"),
        F.element_at(F.array(*[F.lit(c) for c in cols]), F.expr(f"cast(id % {len(cols)} as int) + 1")).alias("b"),
        F.expr(f"cast(id div {len(cols)} as int)").alias("pos_a"), F.expr(f"cast(id % {len(cols)} as int)").alias("pos_b"))
    r = pair_correlations(df, cols).select(F.col("i").alias("pos_a"), F.col("j").alias("pos_b"), "r")
    return cells.join(r, ["pos_a", "pos_b"], "left").select("a", "b", "pos_a", "pos_b", "r")


def corr_triangle(matrix: DataFrame) -> DataFrame:
    """Lower triangle without the diagonal (the cells a masked heat map shows)."""
    return matrix.where(F.col("pos_a") > F.col("pos_b"))


def top_correlations(df: DataFrame, k: int = 5, cols: Sequence[str] | None = None) -> DataFrame:
    """The k pairs (a before b) with the largest |r|; ties by position."""
    m = corr_matrix(df, cols).where(F.col("pos_a") < F.col("pos_b"))
    return (m.orderBy(F.abs("r").desc_nulls_last(), "pos_a", "pos_b").limit(k)
            .withColumn("abs_r", F.abs("r")))


def target_correlation(df: DataFrame, target: str | None = None,
                       cols: Sequence[str] | None = None) -> DataFrame:
    """|r| of every numeric column with the target (default: the last numeric column)."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    target = target or cols[-1]
    feats = [c for c in cols if c != target]
    if not feats:
        raise ValueError("a target correlation needs two numeric columns")
    order = [*feats, target]
    r = pair_correlations(df, order).where(F.col("j") == len(feats)).select(F.col("i").alias("position"), F.abs("r").alias("correlation"))
    names = F.array(*[F.lit(c) for c in feats])
    out = df.sparkSession.range(len(feats)).select(F.col("id").cast("int").alias("position")).join(r, "position", "left")
    return out.select(F.element_at(names, F.col("position") + 1).alias("feature"), "position", F.lit(target).alias("target"),
                      "correlation").orderBy(F.col("correlation").desc_nulls_last(), "position")


def _fences(df: DataFrame, col: str, k: float):
    q1, q3 = quantile_scalars(df, [col], [0.25, 0.75])[col]
    iqr = q3 - q1
    return q1, q3, iqr, q1 - F.lit(k) * iqr, q3 + F.lit(k) * iqr


def outliers(df: DataFrame, col: str | None = None, k: float = 1.5) -> DataFrame:
    """IQR rule on one column (default: the first numeric): strict < Q1-k*IQR or > Q3+k*IQR."""
    col = col or numeric_columns(df, 1)[0]
    q1, q3, iqr, lo, hi = _fences(df, col, k)
    v = _d(col)
    counts = df.agg(F.count(v).alias("total_count"),
                    F.count_if((v < lo) | (v > hi)).alias("outlier_count"))
    return counts.select(F.lit(col).alias("column"), q1.alias("q1"), q3.alias("q3"),
                         iqr.alias("iqr"), lo.alias("lower_bound"), hi.alias("upper_bound"),
                         "outlier_count", "total_count",
                         F.try_divide(F.col("outlier_count") * 100.0, F.col("total_count"))
                         .alias("outlier_pct"))


def outlier_rows(df: DataFrame, col: str | None = None, k: float = 1.5) -> DataFrame:
    """The rows outside the fences (a filter with the fences as scalar subqueries)."""
    col = col or numeric_columns(df, 1)[0]
    _, _, _, lo, hi = _fences(df, col, k)
    v = _d(col)
    return df.where((v < lo) | (v > hi))


def bin_index(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin number in [0, bins-1]; the maximum lands in the last bin, a constant
    column in bin 0."""
    width = (hi - lo) / F.lit(float(bins))
    raw = F.floor(F.try_divide(v - lo, width)).cast("int")
    return F.when(v.isNull(), F.lit(None)).when(hi == lo, F.lit(0)) \
        .otherwise(F.least(raw, F.lit(bins - 1)))


def distributions(df: DataFrame, bins: int = 20, n: int = 4,
                  cols: Sequence[str] | None = None) -> DataFrame:
    """Histograms of the first ``n`` numeric columns: (column, position, bin, bin_lo, bin_hi, count).

    One scalar subquery finds every column's range; one scan unpivots the values and one
    grouped aggregate counts them. Bins without rows are not listed.
    """
    cols = list(cols) if cols is not None else numeric_columns(df, n)
    if not cols:
        raise ValueError("no numeric column to show")
    rng = scalar_stats(df, {f"{p}{i}": fn(_d(c)) for i, c in enumerate(cols)
                            for p, fn in (("lo", F.min), ("hi", F.max))})
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"),
                 bin_index(_d(c), rng[f"lo{i}"], rng[f"hi{i}"], bins).alias("bin"))
        for i, c in enumerate(cols)])))
    counts = long.where(F.col("bin").isNotNull()).groupBy("column", "position", "bin").count()
    lo = F.lit(None).cast("double")
    hi = F.lit(None).cast("double")
    for i in range(len(cols)):
        lo = F.when(F.col("position") == i, rng[f"lo{i}"]).otherwise(lo)
        hi = F.when(F.col("position") == i, rng[f"hi{i}"]).otherwise(hi)
    width = (hi - lo) / F.lit(float(bins))
    return counts.select("column", "position", "bin",
                         (lo + F.col("bin") * width).alias("bin_lo"),
                         (lo + (F.col("bin") + 1) * width).alias("bin_hi"), "count")
