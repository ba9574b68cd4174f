"""Every operator on a table whose column names hold dots and blanks."""

import pytest
from pyspark.sql import functions as F

from tablescope.operators import charts as CH
from tablescope.operators import learn as LE
from tablescope.operators import clean as C
from tablescope.operators import filters as FL
from tablescope.operators import groups as G
from tablescope.operators import profile as PR
from tablescope.operators import stats as ST
from tablescope.plans import templates as TP

X, Y, K, B = "a.x", "b y", "k.key", "o`ut"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.range(60).select(
        F.when(F.col("id") % 7 > 0, F.col("id") * 1.5).alias(X), (F.col("id") % 5).alias(Y),
        F.when(F.col("id") % 11 > 0, F.concat(F.lit("g"), F.col("id") % 3)).alias(K), (F.col("id") % 2).cast("int").alias(B)).cache()


CASES = {
    "fill_median": lambda d: C.fill_median(d, [X]), "fill_mean": lambda d: C.fill_mean(d, [X]), "fill_mode": lambda d: C.fill_mode(d, [K]),
    "family_size": lambda d: C.family_size(d, Y, B), "add_bins": lambda d: C.add_bins(d, Y, (0, 2, 5), name="bin"),
    "value_counts": lambda d: G.value_counts(d, K, order="count"), "binary_share": lambda d: G.binary_share(d, B),
    "outcome_rate": lambda d: G.outcome_rate(d, K, B, labels=["g0", "g9"]),
    "numeric_by_group": lambda d: G.numeric_by_group(d, K, X, ("mean", "median", "count"), labels=["g0", "g1"]),
    "crosstab": lambda d: G.crosstab(d, K, Y), "crosstab_long": lambda d: G.crosstab_long(d, K, Y),
    "extremes": lambda d: G.extremes(G.value_counts(d, K), K, "count"),
    "describe": lambda d: PR.describe(d), "missing": lambda d: PR.missing_profile(d), "cardinality": lambda d: PR.cardinality(d),
    "metrics": lambda d: PR.table_metrics(d), "explore": lambda d: PR.explore(d),
    "domains": lambda d: FL.filter_domains_categorical(d), "ranges": lambda d: FL.filter_domains_numeric(d),
    "filters": lambda d: FL.apply_filters(d, {K: ["g1"], X: FL.Range(3, 40)}), "status": lambda d: FL.filter_status(d, {Y: FL.Range(1, None)}),
    "axis": lambda d: FL.apply_axis(d, X, 1, 50, "log"), "preview": lambda d: FL.preview(d, [X], columns=[X, K]),
    "corr": lambda d: ST.corr_matrix(d), "target": lambda d: ST.target_correlation(d), "top": lambda d: ST.top_correlations(d),
    "outliers": lambda d: ST.outliers(d, X), "outlier_rows": lambda d: ST.outlier_rows(d, X, k=0.1), "distributions": lambda d: ST.distributions(d),
    "histogram": lambda d: CH.histogram(d, X, color=K), "scatter": lambda d: CH.scatter(d, X, Y, color=K, size=B, extra=[B]),
    "line": lambda d: CH.line(d, Y, X, color=K, agg="mean"), "area": lambda d: CH.area(d, Y, X, color=K), "raw line": lambda d: CH.line(d, Y, X, K, key=[B]),
    "bar": lambda d: CH.bar(d, K, X, color=Y), "pie": lambda d: CH.pie(d, K, Y), "box": lambda d: CH.box(d, K, X, color=Y),
    "violin": lambda d: CH.violin(d, K, X), "sunburst": lambda d: CH.sunburst(d, [K, Y]), "treemap": lambda d: CH.treemap(d, [K, Y], X),
}


def test_odd_names_in_models(odd):
    """Scores and importances equal those of the same table with plain names."""
    twice = odd.select(F.col(f"`{X}`"), F.col(f"`{Y}`"), (F.col(f"`{X}`") * 2 + F.rand(3)).alias("z.z"), F.col(f"`{K}`"))
    twice = twice.union(twice).union(twice)
    plain = twice.toDF("x", "y", "z", "k")
    a, b = LE.clusters(twice, [X, "z.z"], k=2, key=[K]), LE.clusters(plain, ["x", "z"], k=2, key=["k"])
    assert a.columns == [K, X, "z.z", "cluster"] and sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)
    a, b = (LE.pca(d, 1, c, min_rows=2) for d, c in ((twice, [X, "z.z"]), (plain, ["x", "z"])))
    assert sorted(r[0] for r in a.collect()) == pytest.approx(sorted(r[0] for r in b.collect()))
    assert LE.pca_variance(twice, 1, [X, "z.z"], min_rows=2).count() == 1
    a, b = (LE.forest_importance(d, t, c, num_trees=5) for d, t, c in ((twice, "z.z", [X, Y, "z.z"]), (plain, "z", ["x", "y", "z"])))
    assert [r.feature for r in a.orderBy("rank").collect()] in ([X, Y], [Y, X]) and a.first().target == "z.z"
    assert [r.importance for r in a.orderBy("rank").collect()] == pytest.approx([r.importance for r in b.orderBy("rank").collect()])


@pytest.mark.parametrize("name", CASES)
def test_odd_names(odd, name):
    assert CASES[name](odd).count() > 0


def test_null_color_is_no_group(odd):
    for out in (CH.histogram(odd, X, color=K), CH.line(odd, Y, X, color=K), CH.area(odd, Y, X, color=K), CH.bar(odd, K, X)):
        assert out.where(F.col(f"`{K}`").isNull()).count() == 0


def test_chart_data_of_every_type(odd):
    plain = odd.toDF("x", "y", "k", "b").withColumn("z", F.col("x") * F.col("y"))
    for t in ("bar", "scatter", "histogram", "pie", "box", "heatmap", "violin", "line", "sunburst", "treemap", "scatter3d", "3d_scatter", "area"):
        spec = {"type": t, "x": "k", "y": "x", "color": "b"}
        if t in ("scatter", "line", "area", "histogram"):
            spec["x"] = "y"
        try:
            out = TP.chart_data(plain, spec)
        except ValueError:
            assert t in ("scatter3d", "3d_scatter")     # only one spelling is a chart type
            continue
        assert out.count() > 0, t
    with pytest.raises(KeyError):
        TP.chart_data(plain, {"type": "bar", "x": "none"})
    assert CH.heatmap(plain.select("k", "x"), "k", "x").columns == ["k", "value"]
    assert CH.scatter3d(plain.select("k", "x"), x="k", y="x").columns == ["k", "x"]
    assert TP.run_template(plain, "survival_analysis") == {}      # none of its columns is there
