"""Labelled and unlabelled binning with pandas ``cut`` semantics.

right=True  -> bins are (lo, hi]; the lowest edge itself falls outside.
right=False -> bins are [lo, hi); the highest edge itself falls outside.
Values outside every bin get null. This is a ``when`` chain on purpose: Spark's
Bucketizer is left-closed and keeps the lowest edge, which gives other answers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fmt(edge: float) -> str:
    return str(int(edge)) if float(edge).is_integer() else repr(float(edge))


def interval_label(lo: float, hi: float, right: bool = True) -> str:
    return f"({_fmt(lo)}, {_fmt(hi)}]" if right else f"[{_fmt(lo)}, {_fmt(hi)})"


def _labels(edges: Sequence[float], labels, right: bool) -> list[str]:
    if labels is None:
        return [interval_label(lo, hi, right) for lo, hi in zip(edges[:-1], edges[1:])]
    if len(labels) != len(edges) - 1:
        raise ValueError("need exactly one label per bin")
    return list(labels)


def _inside(c: Column, lo: float, hi: float, right: bool) -> Column:
    return ((c > F.lit(lo)) & (c <= F.lit(hi))) if right else ((c >= F.lit(lo)) & (c < F.lit(hi)))


def _as_col(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def cut(col, edges: Sequence[float], labels: Sequence[str] | None = None,
        right: bool = True) -> Column:
    """Bin label (string) of each value; null outside the bins or for null input."""
    c = _as_col(col)
    names = _labels(edges, labels, right)
    expr = None
    for (lo, hi), name in zip(zip(edges[:-1], edges[1:]), names):
        cond = _inside(c, lo, hi, right)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr


def cut_ordinal(col, edges: Sequence[float], right: bool = True) -> Column:
    """0-based bin number (int) with the same rule as :func:`cut`."""
    c = _as_col(col)
    expr = None
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        cond = _inside(c, lo, hi, right)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def bin_domain(spark: SparkSession, edges: Sequence[float], labels: Sequence[str] | None = None,
               right: bool = True, name: str = "bin") -> DataFrame:
    """All bins as a small DataFrame (name, <name>_ordinal, <name>_lo, <name>_hi).

    Its size is the number of bins, known before any job runs, so it is safe to broadcast.
    """
    names = _labels(edges, labels, right)
    rows = [(n, i, float(lo), float(hi)) for i, (n, lo, hi) in
            enumerate(zip(names, edges[:-1], edges[1:]))]
    schema = T.StructType([
        T.StructField(name, T.StringType(), False),
        T.StructField(f"{name}_ordinal", T.IntegerType(), False),
        T.StructField(f"{name}_lo", T.DoubleType(), False),
        T.StructField(f"{name}_hi", T.DoubleType(), False),
    ])
    return spark.createDataFrame(rows, schema)
