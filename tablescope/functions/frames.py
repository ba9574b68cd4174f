"""Reshaping helpers: a one-row wide aggregate into a long table, without a job per column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col_of(name: str) -> Column:
    """The column of exactly this name, dots, blanks and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


SALT_ROWS = 4_000_000        # rows of one group that one task of a salted join is dealt


def salts_of(largest) -> int:
    """Parts that ``join_by_group`` deals a group into: from the rows of the largest group, a number or
    the maximum of a table's column ``n``."""
    rows = largest.agg(F.max("n")).first()[0] if isinstance(largest, DataFrame) else largest
    return max(1, -(-(rows or 0) // SALT_ROWS))


def join_by_group(rows: DataFrame, side: DataFrame, keys: Sequence[str], salts: int) -> DataFrame:
    """Inner join of rows with a per-group side table that no hot group sends to one task.

    Rows are dealt to ``salts`` parts by their number, equal rows too, and the side table, which has few
    rows per group, is repeated for each. A following aggregate on the keys gets its own exchange
    after map-side combining. Spark still broadcasts the side when it measures it small.
    """
    if salts == 1:
        return rows.join(side, list(keys))
    salted = side.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
            .join(salted, [*keys, "__salt"]).drop("__salt"))


def one_row(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """A single global aggregate, one column per named expression."""
    return df.agg(*[e.alias(n) for n, e in exprs.items()])


def long_from_row(row_df: DataFrame, items: Sequence[dict[str, Column]]) -> DataFrame:
    """Turn the columns of a (usually one-row) frame into rows.

    ``items`` holds one dict per output row: output column name -> expression over the
    row's columns. All dicts must have the same keys and compatible types. Implemented as
    ``inline(array(struct(...)))``, a generator in the same stage, not a union of jobs.
    """
    if not items:
        raise ValueError("nothing to unpivot")
    keys = list(items[0].keys())
    structs = [F.struct(*[item[k].alias(k) for k in keys]) for item in items]
    return row_df.select(F.inline(F.array(*structs)))


# Spark compiles an aggregate into one generated method only while its buffer stays under
# spark.sql.codegen.maxFields (100 by default); past that it falls back to an interpreted
# path that is several times slower. Wide profiles are therefore cut into chunks.
MAX_BUFFER_FIELDS = 90


def wide_agg(df: DataFrame, exprs: dict[str, Column], fields: dict[str, int] | int = 1,
             max_fields: int = MAX_BUFFER_FIELDS, dtype: str = "double") -> DataFrame:
    """A one-row frame holding every aggregate of ``exprs``.

    ``fields`` gives the aggregate-buffer width of each expression (or one width for all).
    When everything fits one chunk this is a plain aggregate (original types kept).
    Otherwise each chunk is its own aggregate branch of a UNION ALL (its own scan, pruned to
    the columns it reads, compiled on its own, all branches running in parallel), emitting
    its values as one array; a tiny final aggregate puts the chunks side by side. Values of
    a chunked result come back as ``dtype``. (Scalar subqueries would not do: Spark merges
    scalar subqueries over the same table back into one aggregate.)
    """
    names = list(exprs)
    width = (lambda n: fields) if isinstance(fields, int) else (lambda n: fields.get(n, 1))
    chunks, current, used = [], [], 0
    for n in names:
        w = width(n)
        if current and used + w > max_fields:
            chunks.append(current)
            current, used = [], 0
        current.append(n)
        used += w
    if current:
        chunks.append(current)
    if len(chunks) == 1:
        return df.agg(*[exprs[n].alias(n) for n in names])
    parts = [df.agg(F.lit(c).alias("__chunk"),
                    F.array(*[exprs[n].cast(dtype) for n in chunk]).alias("__v"))
             for c, chunk in enumerate(chunks)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    side = union.agg(*[F.max(F.when(F.col("__chunk") == c, F.col("__v"))).alias(f"__c{c}")
                       for c in range(len(chunks))])
    return side.select(*[F.col(f"__c{c}")[i].alias(n)
                         for c, chunk in enumerate(chunks) for i, n in enumerate(chunk)])
