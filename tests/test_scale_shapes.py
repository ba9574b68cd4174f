"""Skewed and sampled inputs: a hot group holding a third of the rows, forced brackets."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescope.functions.quantiles import grouped_quantiles
from tablescope.operators import charts as CH
from tablescope.operators import groups as G


@pytest.fixture()
def skewed(spark):
    # group 0 holds a third of all rows; values are unique doubles with ties sprinkled in
    n = 30000
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 97 + 1).alias("g"),
        (F.when(F.col("id") % 11 == 0, F.lit(5.0)).otherwise(F.sin(F.col("id")) * 1000)).alias("v"),
        (F.col("id") % 4 == 0).cast("int").alias("y"))


def test_quantiles_exact_on_hot_group(spark, skewed):
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = {r["g"]: r for r in grouped_quantiles(skewed, "v", probs, by=["g"]).collect()}
    pdf = skewed.toPandas()
    for g in (0, 1, 50):
        vals = pdf.loc[pdf.g == g, "v"].to_numpy()
        want = np.quantile(vals, probs)            # linear interpolation
        assert got[g]["n"] == len(vals)
        assert [got[g][f"q{i}"] for i in range(len(probs))] == pytest.approx(list(want), rel=1e-12, abs=1e-9)


def test_quantiles_equal_percentile(spark, skewed):
    a = grouped_quantiles(skewed, "v", [0.25, 0.75], by=["g"]).orderBy("g").collect()
    b = skewed.groupBy("g").agg(F.count("v").alias("n"), F.percentile("v", F.array(F.lit(0.25), F.lit(0.75))).alias("q")).orderBy("g").collect()
    assert [(r.g, r.n) for r in a] == [(r.g, r.n) for r in b]
    assert [x for r in a for x in (r.q0, r.q1)] == pytest.approx([x for r in b for x in r.q], rel=1e-12)


def test_quantiles_of_wild_values(spark):
    top = 1.7976931348623157e308
    data = {"wide": [-top, -1.0, 0.0, 1e-300, 2e-300, 1.0, top], "inf": [float("-inf"), 1.0, 2.0, 3.0, float("inf")],
            "same": [7.0] * 9, "one": [3.0], "nan": [float("nan"), 1.0, None, 2.0], "tiny": [5e-324 * i for i in range(20)],
            "none": [None, float("nan")]}
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs] + [(None, 1.0)], "g string, v double")
    probs = [0.0, 0.2, 0.5, 1.0]
    got = {r.g: r for r in grouped_quantiles(df, "v", probs, by=["g"], extra={"top": F.max}).collect()}
    assert set(got) == set(data) - {"none"}
    for g, vs in data.items():
        vs = [v for v in vs if v is not None and v == v]
        if not vs or g == "inf":
            continue
        assert got[g].n == len(vs) and got[g].top == max(vs)
        assert [got[g][f"q{i}"] for i in range(4)] == pytest.approx(list(np.quantile(np.array(vs, dtype=np.longdouble), probs).astype(float)), rel=1e-12)
    assert (got["inf"].q0, got["inf"].q2, got["inf"].q3) == (float("-inf"), 2.0, float("inf"))
    assert grouped_quantiles(df.limit(0), "v", probs).count() == 0


def test_no_task_reads_a_hot_group(spark, tmp_path):
    """A hot group of unique doubles: what a task reads after a shuffle is bins, not rows."""
    import json
    import subprocess
    import sys
    code = f"""
import sys; sys.path.insert(0, {str(__import__('os').getcwd())!r})
from pyspark.sql import functions as F
from tablescope.session import get_session
s = get_session("local[2]", 8, extra={{"spark.eventLog.enabled": "true", "spark.eventLog.dir": "file://{tmp_path}", "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false"}})
from tablescope.functions.quantiles import grouped_quantiles
df = s.range(0, 400000, 1, 8).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 50).alias("g"), F.rand(1).alias("v"))
grouped_quantiles(df, "v", [0.25, 0.5, 0.75], by=["g"]).collect()
s.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=200, capture_output=True)
    most = 0
    for log in tmp_path.iterdir():
        for line in log.open():
            e = json.loads(line)
            if e["Event"] == "SparkListenerTaskEnd" and e.get("Task Metrics"):
                most = max(most, e["Task Metrics"]["Shuffle Read Metrics"]["Total Records Read"])
    assert most <= 50 * 4096                      # groups x bins; the hot group alone has 268,000 rows


def test_group_rates_on_hot_key(spark, skewed):
    got = {r["g"]: r for r in G.outcome_rate(skewed, "g", "y").collect()}
    pdf = skewed.toPandas()
    hot = pdf[pdf.g == 0]
    assert got[0]["total"] == len(hot) == 10000
    assert got[0]["rate"] == pytest.approx(hot.y.mean())


def test_box_on_hot_key(spark, skewed):
    got = {r["g"]: r for r in CH.box(skewed, "g", "v").collect()}
    vals = skewed.where("g = 0").toPandas().v.to_numpy()
    q1, med, q3 = np.percentile(vals, [25, 50, 75])
    assert (got[0]["q1"], got[0]["median"], got[0]["q3"]) == pytest.approx((q1, med, q3))


def test_wide_table_profiles_match_pandas(spark):
    """20 columns: describe and 190 correlation pairs run as chunked aggregates."""
    from tablescope.operators import profile as PR
    from tablescope.operators import stats as ST
    df = spark.range(1500).select(*[(F.sin(F.col("id") * (k + 1)) * (k + 1)).alias(f"c{k}") for k in range(20)])
    pdf = df.toPandas()
    d = PR.describe(df, decimals=None).toPandas().set_index("stat")
    ref = pdf.describe()
    assert np.nanmax(np.abs(d[ref.columns].values - ref.values)) < 1e-9
    pc = pdf.corr()
    for r in ST.corr_matrix(df).collect():
        assert r["r"] == pytest.approx(pc.loc[r["a"], r["b"]], abs=1e-12)


def test_filter_domains_many_and_hot_values(spark):
    """A many-valued column, a hot smallest value and a constant all take the one route."""
    from tablescope.operators import filters as FL
    df = spark.range(60000).select((F.col("id") * 7919 % 5000).cast("string").alias("u"),
                                   F.when(F.col("id") % 3 == 0, "0").otherwise((F.col("id") * 31 % 20000).cast("string")).alias("hot"),
                                   (F.col("id") % 3).cast("string").alias("few"), F.lit("x").alias("same"))
    got = FL.filter_domains_categorical(df).collect()
    for c in df.columns:
        want = sorted(r[0] for r in df.select(c).distinct().collect())[:20]
        assert [r["value"] for r in sorted(got, key=lambda r: r["value_rank"]) if r["column"] == c] == want
    big = spark.createDataFrame([(9007199254740993, 1.5)], "`a.b` long, c double")
    row = FL.filter_domains_numeric(big, ["a.b"]).first()
    assert (row["exact_max"], row["slider_max"]) == ("9007199254740993", 9007199254740993)
    assert FL.apply_filters(df, {"few": ("0", "2")}).where("few = '1'").count() == 0


def _values(kind):
    rng = np.random.default_rng(7)
    if kind == "spread":
        return 2.0 ** rng.uniform(-999, 999, 20_000) * rng.choice([-1, 1], 20_000)
    if kind == "bits":                               # any double, subnormal ones and infinities too
        x = rng.integers(0, 2 ** 64, 20_000, dtype=np.uint64).view(np.float64)
        return np.concatenate((x[np.isfinite(x)], [0.0, -0.0, 5e-324, -5e-324, np.inf, -np.inf]))
    if kind == "close":                              # neighbours in the last bit, next to an outlier
        return np.concatenate((np.nextafter(1.0, 2) + np.arange(5000) * 2.0 ** -52, [-1e300, 1e300]))
    return rng.exponential(1, 20_000)


@pytest.mark.parametrize("kind", ["spread", "bits", "close", "exp"])
def test_quantiles_take_six_passes_at_most(spark, kind, monkeypatch):
    from tablescope.functions import frames, quantiles
    passes, write = [], quantiles.materialize
    monkeypatch.setattr(quantiles, "materialize", lambda df, name: passes.append(name) or write(df, name))
    monkeypatch.setattr(frames, "SALT_ROWS", 3000)
    x = _values(kind)
    df = spark.createDataFrame([(float(v), int(i % 2)) for i, v in enumerate(x)], "v double, g int").repartition(4)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: [r[f"q{i}"] for i in range(5)] for r in quantiles.grouped_quantiles(df, "v", probs, by=["g"]).collect()}
    assert 1 <= passes.count("quantile-ranks") <= 6
    for g in (0, 1):
        s = np.sort(x[g::2])
        for p, q in zip(probs, got[g], strict=True):
            at = (len(s) - 1) * p
            lo, hi = s[math.floor(at)], s[math.ceil(at)]
            assert q == lo if lo == hi else min(lo, hi) <= q <= max(lo, hi) or not np.isfinite(hi - lo)
            if lo != hi and np.isfinite(hi - lo):
                assert math.isclose(q, lo + (at - math.floor(at)) * (hi - lo), rel_tol=1e-9, abs_tol=1e-320)
