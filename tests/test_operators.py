"""Operators against pandas / numpy on small hand-made frames (nulls, ties, constants)."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablescope.operators import charts as CH
from tablescope.operators import clean as C
from tablescope.operators import filters as FL
from tablescope.operators import groups as G
from tablescope.operators import profile as PR
from tablescope.operators import stats as ST

ROWS = [
    (1, 0, "male", 22.0, 1, 0, 7.25, "S"),
    (2, 1, "female", 38.0, 1, 0, 71.28, "C"),
    (3, 1, "female", None, 0, 0, 7.92, None),
    (4, 1, "female", 35.0, 1, 0, 53.1, None),
    (5, 0, "male", 35.0, 0, 0, 8.05, "S"),
    (6, 0, "male", None, 0, 0, 0.0, "Q"),
    (7, 0, "male", 54.0, 0, 0, 51.86, "Q"),
    (8, 0, "male", 2.0, 3, 1, 21.08, "C"),
]
SCHEMA = "pid int, survived int, sex string, age double, sibsp int, parch int, fare double, embarked string"


@pytest.fixture()
def people(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture()
def pdf():
    cols = [c.split()[0] for c in SCHEMA.split(", ")]
    return pd.DataFrame(ROWS, columns=cols)


def test_fill_median_and_mode(people, pdf):
    out = C.fill_mode(C.fill_median(people, ["age"]), ["embarked"]).orderBy("pid").toPandas()
    assert list(out["age"]) == list(pdf["age"].fillna(pdf["age"].median()))
    # embarked S, C and Q appear twice each: the smallest wins, as pandas mode()[0]
    assert out["embarked"][2] == out["embarked"][3] == pdf["embarked"].mode()[0] == "C"


def test_clean_pipeline_matches_pandas(people, pdf):
    out = C.clean(people).orderBy("pid").toPandas()
    ref = pdf.copy()
    ref["age"] = ref["age"].fillna(ref["age"].median())
    ref["age_group"] = pd.cut(ref["age"], bins=list(C.AGE_BINS), labels=list(C.AGE_LABELS)).astype(object)
    ref["fare_category"] = pd.cut(ref["fare"], bins=list(C.FARE_BINS), labels=list(C.FARE_LABELS)).astype(object)
    ref["family_size"] = ref["sibsp"] + ref["parch"] + 1
    ref["gender"] = ref["sex"].str.title()
    for c in ("age_group", "fare_category", "gender"):
        assert [None if pd.isna(v) else v for v in ref[c]] == [None if v is None else v for v in out[c]]
    assert list(out["family_size"]) == list(ref["family_size"])
    assert out["fare_category"][5] is None          # fare 0 is outside (0, 10]


def test_describe_matches_pandas(people, pdf):
    out = PR.describe(people, ["age", "fare"], decimals=None).toPandas().set_index("stat")
    ref = pdf[["age", "fare"]].describe()
    for stat in PR.DESCRIBE_STATS:
        for c in ("age", "fare"):
            assert out.loc[stat, c] == pytest.approx(ref.loc[stat, c], rel=1e-12)


def test_missing_profile_and_metrics(people, pdf):
    prof = PR.missing_profile(people).toPandas()
    assert prof.iloc[0]["column"] == "age" and prof.iloc[0]["missing_count"] == 2
    m = PR.table_metrics(people).first()
    assert m["total_records"] == 8 and m["first_numeric"] == "pid"
    assert m["missing_pct"] == pytest.approx(pdf.isnull().sum().sum() / (8 * 8) * 100)
    empty = people.where("pid < 0")
    assert PR.table_metrics(empty).count() == 0


def test_cardinality_matches_nunique(people, pdf):
    got = {r["column"]: r["n_distinct"] for r in PR.cardinality(people).collect()}
    assert got == {c: pdf[c].nunique() for c in got}


def test_outcome_rate_keeps_empty_bins(people, pdf):
    df = C.clean(people)
    got = G.outcome_rate(df, "age_group", "survived", C.AGE_LABELS).toPandas()
    ref = pdf.assign(age=pdf["age"].fillna(pdf["age"].median()))
    ref["age_group"] = pd.cut(ref["age"], bins=list(C.AGE_BINS), labels=list(C.AGE_LABELS))
    agg = ref.groupby("age_group", observed=False)["survived"].agg(["count", "sum", "mean"])
    assert list(got["total"]) == list(agg["count"])
    assert list(got["positives"]) == list(agg["sum"])
    for a, b in zip(got["rate"], agg["mean"]):
        assert (a is None or (isinstance(a, float) and math.isnan(a))) if pd.isna(b) else a == pytest.approx(b)


def test_value_counts_and_crosstab(people, pdf):
    vc = G.value_counts(people, "embarked").toPandas()
    ref = pdf["embarked"].value_counts().sort_index()
    assert list(vc["count"]) == list(ref) and vc["percent"].sum() == pytest.approx(6 / 8 * 100)
    ct = G.crosstab(people, "sex", "embarked").toPandas().set_index("sex")
    ref = pd.crosstab(pdf["sex"], pdf["embarked"])
    assert (ct[ref.columns].values == ref.values).all()


def test_filters(people):
    f = {"sex": ["male"], "age": FL.Range(20, 40), "embarked": []}
    assert FL.apply_filters(people, f).count() == 2
    st_ = FL.filter_status(people, f).first()
    assert (st_["rows_before"], st_["rows_after"]) == (8, 2)
    dom = FL.filter_domains_numeric(people, ["fare"]).first()
    assert (dom["min"], dom["max"], dom["slider_min"], dom["slider_max"]) == (0.0, 71.28, 0, 72)
    cats = FL.filter_domains_categorical(people, limit=2).collect()
    assert [r["value"] for r in cats if r["column"] == "embarked"] == ["C", "Q"]


def test_corr_matches_pandas_with_nulls_and_constant(people, pdf):
    df = people.withColumn("const", F.lit(1.0))
    ref = pdf.assign(const=1.0)[["age", "fare", "sibsp", "const"]].corr()
    got = ST.corr_matrix(df, ["age", "fare", "sibsp", "const"]).collect()
    for r in got:
        want = ref.loc[r["a"], r["b"]]
        if pd.isna(want):
            assert r["r"] is None
        else:
            assert r["r"] == pytest.approx(want, abs=1e-12)


def test_outliers(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    r = ST.outliers(df, "v").first()
    s = pd.Series(vals).dropna()
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    assert (r["q1"], r["q3"]) == (q1, q3)
    assert r["outlier_count"] == ((s < q1 - 1.5 * (q3 - q1)) | (s > q3 + 1.5 * (q3 - q1))).sum() == 1
    assert r["total_count"] == 6


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6)), min_size=1, max_size=40),
       st.integers(1, 12))
def test_histogram_counts_every_value(spark, xs, bins):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = CH.histogram(df, "x", bins=bins).collect()
    assert sum(r["count"] for r in got) == sum(x is not None for x in xs)
    assert all(0 <= r["bin"] < bins for r in got)


def test_box_matches_numpy(people):
    got = {r["sex"]: r for r in CH.box(people, "sex", "fare").collect()}
    fares = np.array([r[6] for r in ROWS if r[2] == "male"])
    q1, med, q3 = np.percentile(fares, [25, 50, 75])
    b = got["male"]
    assert (b["q1"], b["median"], b["q3"]) == pytest.approx((q1, med, q3))
    inside = fares[(fares >= q1 - 1.5 * (q3 - q1)) & (fares <= q3 + 1.5 * (q3 - q1))]
    assert (b["whisker_low"], b["whisker_high"]) == (inside.min(), inside.max())


def test_pie_share_and_sunburst_parents(people):
    shares = [r["share"] for r in CH.pie(people, "embarked").collect()]
    assert sum(shares) == pytest.approx(1.0)
    nodes = CH.sunburst(people, ["sex", "embarked"]).collect()
    by_id = {r["id"]: r for r in nodes}
    for r in nodes:
        kids = [k["count"] for k in nodes if k["parent"] == r["id"]]
        if kids and r["level"] == 1:
            # a null leaf ends its branch but still counts in the parent
            nulls = sum(1 for x in ROWS if x[2] == r["sex"] and x[7] is None)  # noqa: E501
            assert sum(kids) + nulls == r["count"]
    assert by_id["total"]["count"] == 8


def test_area_stacks(people):
    got = CH.area(people, "sex", "fare", "embarked").orderBy("sex", "embarked").collect()
    for sex in ("male", "female"):
        rows = [r for r in got if r["sex"] == sex]
        assert rows[-1]["stack_top"] == pytest.approx(sum(r["value"] for r in rows))


def test_violin_density_integrates_to_one(spark):
    df = spark.range(0, 400).select((F.col("id") % 37).cast("double").alias("y"), F.lit("g").alias("x"))
    pts = CH.violin(df, "x", "y", grid=200).orderBy("point").collect()
    step = pts[1]["y_value"] - pts[0]["y_value"]
    assert sum(p["density"] for p in pts) * step == pytest.approx(1.0, abs=0.02)


def test_binned_density_is_the_kernel_sum(spark):
    """Within the stated bound: normal values, a far outlier, one value only, few values, a group beyond MAX_SPAN."""
    rng = np.random.default_rng(5)
    rows = [("n", float(v)) for v in rng.normal(50, 9, 3000)] + [("n", 4000.0), ("one", 3.0)]
    rows += [("few", float(v)) for v in rng.integers(0, 4, 200)] + [("same", 7.5)] * 9 + [("n", None), (None, 1.0)]
    cols = ["x", "point", "y_value", "density", "bandwidth", "n"]

    def check(data):
        df = spark.createDataFrame(data, "x string, y double")
        a, b = (CH.violin(df, "x", "y", exact=e).select(*cols).orderBy("x", "point").collect() for e in (False, True))
        assert len(a) == len(b) == 50 * len({x for x, y in data if x is not None and y is not None})
        for p, q in zip(a, b):
            assert (p.x, p.point, p.y_value, p.n) == (q.x, q.point, q.y_value, q.n)
            assert abs(p.density - q.density) <= 1e-12 / q.bandwidth
    check(rows)
    check([*rows, *[("wide", float(v)) for v in range(20)], ("wide", 1e40)])
