"""Model invariants, and the refresh stream against the same batch query."""

import numpy as np
import pytest

from tablescope.operators import learn as L
from tablescope.operators.profile import table_metrics
from tablescope.plans.catalog import table
from tablescope.plans.standins import passengers
from tablescope.streaming.refresh import file_stream, latest, refresh, run_until_caught_up

from conftest import SF_SMOKE


def test_choose_target_prefers_first_binary(spark):
    p = passengers(spark, SF_SMOKE)
    r = L.choose_target(p, exclude=["passenger_id"]).first()
    assert (r["target"], r["rule"], r["n_distinct"]) == ("survived", "first binary", 2)


def test_forest_importance_sums_to_one(spark):
    p = passengers(spark, SF_SMOKE)
    imp = L.forest_importance(p, exclude=["passenger_id"], num_trees=10).collect()
    assert sum(r["importance"] for r in imp) == pytest.approx(1.0)
    assert [r["rank"] for r in imp] == list(range(1, len(imp) + 1))


def test_clusters_ids_and_sizes(spark):
    p = passengers(spark, SF_SMOKE)
    out = L.clusters(p, cols=["age", "fare"], key=["passenger_id"])
    sizes = {r["cluster"]: r["count"] for r in out.groupBy("cluster").count().collect()}
    assert set(sizes) == {0, 1, 2} and sum(sizes.values()) == p.count()


def test_pca_shares_match_numpy(spark):
    p = passengers(spark, SF_SMOKE)
    cols = ["survived", "age", "sibsp", "fare"]
    got = [r["explained_variance_ratio"] for r in L.pca_variance(p, 2, cols=cols).collect()]
    x = p.select(*cols).dropna().toPandas().to_numpy(dtype=float)
    x = (x - x.mean(0)) / x.std(0, ddof=1)
    ev = np.linalg.eigvalsh(np.cov(x, rowvar=False))[::-1]
    assert got == pytest.approx(list(ev[:2] / ev.sum()), abs=1e-6)
    scores = L.pca(p, 2, cols=cols)
    assert scores.count() == len(x)


def test_refresh_stream_equals_batch(spark, tmp_dir):
    ev = table(spark, SF_SMOKE, "events")
    stream = file_stream(spark, f"{SF_SMOKE}/events*.parquet", ev.schema)
    q = refresh(stream, table_metrics, f"{tmp_dir}/sink", f"{tmp_dir}/ckpt", available_now=True)
    run_until_caught_up(q)
    got = latest(spark, f"{tmp_dir}/sink").first().asDict()
    want = table_metrics(ev).first().asDict()
    assert got == want
    stamped = latest(spark, f"{tmp_dir}/sink", with_stamp=True)
    assert {"batch_id", "refreshed_at"} <= set(stamped.columns)


def test_forest_metrics_takes_bins_and_leaf_size(spark):
    """A label of three bands of one feature: trees with small leaves learn it, a leaf of half the rows allows no split."""
    df = spark.range(4000).selectExpr("id AS k", "CAST(id % 64 AS double) AS x", "CAST(id % 7 AS double) AS noise", "id % 64 >= 16 AND id % 64 < 40 AS label")

    def accuracy(**options):
        out = L.forest_metrics(df, "label", ["k"], cols=["x", "noise"], num_trees=5, max_depth=6, **options).collect()
        return {r["metric"]: r["value"] for r in out}["accuracy"]
    assert accuracy(max_bins=64) > 0.95
    assert accuracy(max_bins=64, min_leaf=2000) < 0.7


def test_forest_tasks_hold_a_bounded_number_of_rows(spark, monkeypatch):
    """The training rows are dealt to as many partitions as their number asks for; few rows keep the layout they had."""
    from pyspark.ml import Pipeline
    df = spark.range(6000).selectExpr("id AS k", "CAST(id % 64 AS double) AS x", "CAST(id % 7 AS double) AS noise", "CAST(id % 64 >= 16 AS int) AS label")
    seen, fit = [], Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, data: seen.append(data.rdd.getNumPartitions()) or fit(self, data))

    def run():
        seen.clear()
        L.forest_metrics(df, "label", ["k"], cols=["x", "noise"], num_trees=5)
        L.forest_importance(df, "label", cols=["x", "noise"], num_trees=5)
        return seen[0], seen[1]
    few = run()
    assert few[1] == int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(L, "TASK_BYTES", 20_000)
    metrics, importance = run()
    assert metrics >= 40 and importance >= 50


def test_shallow_forests_keep_no_node_table(spark, monkeypatch):
    """The copy of every row's node in every tree is for deep trees only; the model is the same with and without it."""
    df = spark.range(3000).selectExpr("CAST(id % 64 AS double) AS x", "CAST(id % 7 AS double) AS noise", "CAST(id % 5 AS double) AS more", "CAST(id % 64 >= 16 AND id % 7 < 5 AS int) AS label")
    kept, build = [], L.RandomForestClassifier
    monkeypatch.setattr(L, "RandomForestClassifier", lambda **o: kept.append(o["cacheNodeIds"]) or build(**o))
    shallow = L.forest_importance(df, "label", num_trees=8).collect()
    monkeypatch.setattr(L, "WALK_DEPTH", 0)
    assert L.forest_importance(df, "label", num_trees=8).collect() == shallow
    assert kept == [False, True]
