import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablescope.functions import binning, text, values
from tablescope.functions.roles import column_roles, numeric_columns
from tablescope.operators.clean import AGE_BINS, AGE_LABELS


def test_cut_right_closed_matches_pandas(spark):
    xs = [0.0, 0.5, 12.0, 12.0001, 18.0, 35.0, 60.0, 99.9, 100.0, 100.5, -1.0, None]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(binning.cut("x", AGE_BINS, AGE_LABELS)).collect()]
    want = pd.cut(pd.Series(xs, dtype=float), bins=list(AGE_BINS), labels=list(AGE_LABELS))
    assert got == [None if pd.isna(w) else w for w in want]


def test_cut_left_closed_interval_labels(spark):
    xs = [0.0, 9.99, 10.0, 79.0, 80.0, 85.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(binning.cut("x", range(0, 90, 10), right=False)).collect()]
    want = pd.cut(pd.Series(xs), bins=range(0, 90, 10), right=False).astype(str)
    assert got == [None if w == "nan" else w for w in want]


def test_cut_ordinal_and_domain(spark):
    df = spark.createDataFrame([(5.0,), (15.0,), (200.0,)], "x double")
    got = [r[0] for r in df.select(binning.cut_ordinal("x", AGE_BINS)).collect()]
    assert got == [0, 1, None]
    dom = binning.bin_domain(spark, AGE_BINS, AGE_LABELS).collect()
    assert [r["bin"] for r in dom] == list(AGE_LABELS)


@pytest.mark.parametrize("s", ["o'brien mc-donald x1y", "hello WORLD", "", "émile zola", "a_b c3po"])
def test_title_case_python_rule(spark, s):
    df = spark.createDataFrame([(s,)], "s string")
    assert df.select(text.title_case("s")).first()[0] == s.title()


def test_truncate(spark):
    df = spark.createDataFrame([("x" * 50,), ("y" * 51,), (None,)], "s string")
    got = [r[0] for r in df.select(text.truncate_text("s")).collect()]
    assert got == ["x" * 50, "y" * 47 + "...", None]


def test_map_values_unmapped_is_null(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (None,)], "v int")
    got = [r[0] for r in df.select(values.map_values("v", {0: "no", 1: "yes"})).collect()]
    assert got == ["no", "yes", None, None]


def test_round_half_even_matches_numpy(spark):
    xs = [79.115, 17.065, 4.605, 0.125, 0.375, 2.675, -1.005, 1234.5678]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got2 = [r[0] for r in df.select(values.round_half_even("x", 2)).collect()]
    got0 = [r[0] for r in df.select(values.round_half_even("x", 0)).collect()]
    assert got2 == list(np.round(xs, 2))
    assert got0 == list(np.round(xs, 0))


def test_roles(spark):
    df = spark.createDataFrame([(1, 2.0, "a", True)], "i int, d double, s string, b boolean")
    assert column_roles(df) == [("i", "numeric"), ("d", "numeric"), ("s", "categorical"), ("b", "other")]
    assert numeric_columns(df, 1) == ["i"] and numeric_columns(df, 1, last=True) == ["d"]
