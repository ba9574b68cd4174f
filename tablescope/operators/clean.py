"""Cleaning and derived columns (fills, bins, family size, value maps, title case)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.binning import cut
from tablescope.functions.frames import col_of
from tablescope.functions.quantiles import mode_of, quantile_scalars, scalar_stats
from tablescope.functions.text import title_case
from tablescope.functions.values import map_values

# Bin edges and labels of the default derivations.
AGE_BINS = (0, 12, 18, 35, 60, 100)
AGE_LABELS = ("Child", "Teen", "Young Adult", "Adult", "Senior")
FARE_BINS = (0, 10, 30, 100, 1000)
FARE_LABELS = ("Low", "Medium", "High", "Premium")
FAMILY_BINS = (0, 1, 4, 20)
FAMILY_LABELS = ("Alone", "Small Family", "Large Family")
AGE_DECADE_BINS = tuple(range(0, 90, 10))
SURVIVAL_LABELS = {0: "Did Not Survive", 1: "Survived"}


def fill_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Nulls -> the column's exact median (see ``grouped_quantiles``); all medians come from
    one scalar subquery over written group tables (jobs run while the plan is built)."""
    if not cols:
        return df
    med = quantile_scalars(df, list(cols), [0.5])
    return df.withColumns({c: F.coalesce(col_of(c), med[c][0]) for c in cols})


def fill_mean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    if not cols:
        return df
    mean = scalar_stats(df, {c: F.avg(col_of(c)) for c in cols})
    return df.withColumns({c: F.coalesce(col_of(c), mean[c]) for c in cols})


def fill_mode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Nulls -> the most frequent value, smallest on ties."""
    return df.withColumns({c: F.coalesce(col_of(c), mode_of(df, c)) for c in cols}) if cols else df


def family_size(df: DataFrame, a: str = "sibsp", b: str = "parch",
                name: str = "family_size") -> DataFrame:
    return df.withColumn(name, col_of(a) + col_of(b) + F.lit(1))


def add_bins(df: DataFrame, col: str, edges, labels=None, right: bool = True,
             name: str | None = None) -> DataFrame:
    return df.withColumn(name or f"{col}_bin", cut(col, edges, labels, right))


# What each derived column is made from.
_SOURCES = {"age_group": ("age",), "fare_category": ("fare",), "family_size": ("sibsp", "parch"),
            "family_category": ("sibsp", "parch"), "survival_status": ("survived",), "gender": ("sex",)}


def clean(df: DataFrame, fill: bool = True, derive: bool = True, outputs: Sequence[str] | None = None) -> DataFrame:
    """The default pipeline; each step runs only when its input columns are present.

    Fills come first (median age and fare, mode of embarked), then the derived columns
    age_group, fare_category, family_size, family_category, survival_status, gender.
    With ``outputs`` only those columns are made and returned, and only the fills they need run:
    a median costs passes over the data even when its column is dropped later. An expensive input
    (joins) is best written once by the caller (``session.materialize``).
    """
    cols = set(df.columns)
    wanted = set(outputs) if outputs is not None else cols | set(_SOURCES)
    used = wanted | {c for w in wanted for c in _SOURCES.get(w, ())}
    out = df
    if fill:
        out = fill_median(out, [c for c in ("age", "fare") if c in cols and c in used])
        if "embarked" in cols and "embarked" in used:
            out = fill_mode(out, ["embarked"])
    if not derive:
        return out.select(*[col_of(c) for c in outputs]) if outputs is not None else out
    new = {}
    if "age" in cols:
        new["age_group"] = cut("age", AGE_BINS, AGE_LABELS)
    if "fare" in cols:
        new["fare_category"] = cut("fare", FARE_BINS, FARE_LABELS)
    if "sibsp" in cols and "parch" in cols:
        size = F.col("sibsp") + F.col("parch") + F.lit(1)
        new["family_size"] = size
        new["family_category"] = cut(size, FAMILY_BINS, FAMILY_LABELS)
    if "survived" in cols:
        new["survival_status"] = map_values("survived", SURVIVAL_LABELS)
    if "sex" in cols:
        new["gender"] = title_case("sex")
    new = {c: v for c, v in new.items() if c in wanted}
    out = out.withColumns(new) if new else out
    return out.select(*[col_of(c) for c in outputs]) if outputs is not None else out
