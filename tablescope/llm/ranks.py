"""Exact positions of rows in a global order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tablescope.session import materialize


def ranked(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with pos (from 0, ascending by ``order`` within ``group``, nulls first) and n (rows of
    the group). Rows are range-partitioned on (group, *order), so a hot group is many tasks; only one row
    per (group, task) is summed. Rows equal in all of ``order`` get their positions in any order."""
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    dealt = materialize(dealt.withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", 33).alias("part")
    runs = dealt.groupBy(group, part).agg(F.count("*").alias("c"), F.min("at").alias("first"))
    whole, before = Window.partitionBy(group), Window.partitionBy(group).orderBy("part")
    runs = runs.select(group, "part", "first", F.sum("c").over(whole).alias("n"),
                       (F.sum("c").over(before) - F.col("c")).alias("before"))
    placed = dealt.withColumn("part", part).join(runs, [group, "part"])
    return placed.withColumn("pos", F.col("before") + F.col("at") - F.col("first")).drop("part", "before", "first", "at")
