"""Column roles from the schema alone (no job).

numeric     = byte, short, int, long, float, double, decimal
categorical = string
other       = boolean, dates, timestamps, arrays, maps, structs, binary
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, _NUMERIC)


def role_of(dtype: T.DataType) -> str:
    if is_numeric(dtype):
        return "numeric"
    if isinstance(dtype, T.StringType):
        return "categorical"
    return "other"


def column_roles(df: DataFrame, exclude=()) -> list[tuple[str, str]]:
    """(column, role) in schema order."""
    skip = set(exclude)
    return [(f.name, role_of(f.dataType)) for f in df.schema.fields if f.name not in skip]


def numeric_columns(df: DataFrame, n: int | None = None, last: bool = False,
                    exclude=()) -> list[str]:
    """Numeric columns in schema order; ``n`` keeps the first n (or the last n with last=True)."""
    cols = [c for c, r in column_roles(df, exclude) if r == "numeric"]
    if n is None:
        return cols
    return cols[-n:] if last else cols[:n]


def categorical_columns(df: DataFrame, exclude=()) -> list[str]:
    return [c for c, r in column_roles(df, exclude) if r == "categorical"]
