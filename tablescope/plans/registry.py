"""Registered queries: one Spark query per inventory row, each with its DuckDB SQL oracle.

``QUERIES[name](spark, sf_dir) -> DataFrame``; ``ORACLES[name]`` is the SQL that DuckDB runs
on the same tables. Every query reads the whole driver tables. Floating results are
rounded the same way on both sides (money sums to 2 places, ratios and moments to 6).
Model fits on the passenger view have no SQL form and no oracle entry; further model queries
(closed forms, invariants, planted signals), streams and file round trips have one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return wrap


def rounded(df: DataFrame, decimals: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(F.col(f"`{c}`"), d) for c, d in decimals.items()})


# The modules below fill QUERIES / ORACLES when imported.
from tablescope.plans import q_sources, q_clean, q_profile, q_groups, q_stats, q_charts, q_templates, q_learn, q_stream, q_more  # noqa: E402,F401
