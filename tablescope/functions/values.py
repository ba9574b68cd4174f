"""Value maps and display rounding."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_values(col, mapping: Mapping) -> Column:
    """Look a value up in a small literal mapping; unmapped values and nulls give null."""
    c = F.col(col) if isinstance(col, str) else col
    expr = None
    for key, value in mapping.items():
        cond = c == F.lit(key)
        expr = F.when(cond, F.lit(value)) if expr is None else expr.when(cond, F.lit(value))
    return expr if expr is not None else F.lit(None)


def round_half_even(col, decimals: int = 2) -> Column:
    """numpy's rule: ``rint(x * 10**d) / 10**d`` in double arithmetic (ties to even).

    Spark's ``bround`` rounds the decimal text of the double instead, which gives another
    answer on values such as 79.115 (stored as 79.11499...): numpy and this give 79.11.
    """
    c = (F.col(col) if isinstance(col, str) else col).cast("double")
    if decimals >= 0:
        scale = F.lit(float(10 ** decimals))
        return F.rint(c * scale) / scale
    scale = F.lit(float(10 ** -decimals))
    return F.rint(c / scale) * scale


def round_cols(df: DataFrame, decimals: int = 2, cols=None, half_even: bool = True) -> DataFrame:
    """Round float/double/decimal columns, half-even like numpy (or half-up with half_even=False)."""
    from tablescope.functions.roles import is_numeric
    from pyspark.sql import types as T

    targets = cols if cols is not None else [
        f.name for f in df.schema.fields
        if is_numeric(f.dataType) and isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType))]
    if half_even:
        return df.withColumns({c: round_half_even(F.col(c), decimals) for c in targets})
    return df.withColumns({c: F.round(F.col(c), decimals) for c in targets})
