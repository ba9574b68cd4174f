"""Registered machine-learning queries (M1-M6). The fits on the passenger view have no SQL form; the
queries at the end do."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescope.functions.quantiles import scalar_stats
from tablescope.operators import learn as L
from tablescope.plans.catalog import table
from tablescope.plans.registry import register, rounded
from tablescope.plans.standins import PASSENGER_BASIC_SQL, passengers
from tablescope.session import materialize

KEY = ["passenger_id"]
_P_NUM = ["survived", "age", "sibsp", "parch", "fare"]


@register("M1_choose_target", f"""
WITH p AS ({PASSENGER_BASIC_SQL}),
c AS (SELECT * FROM (VALUES """ + ", ".join(
    f"('{c}', {i}, (SELECT count(DISTINCT {c}) FROM p))" for i, c in enumerate(_P_NUM))
    + """) AS t(col, pos, nd))
SELECT coalesce((SELECT col FROM c WHERE nd = 2 ORDER BY pos LIMIT 1), (SELECT col FROM c ORDER BY pos DESC LIMIT 1)) AS target,
       CASE WHEN EXISTS (SELECT 1 FROM c WHERE nd = 2) THEN 'first binary' ELSE 'last numeric' END AS rule,
       coalesce((SELECT nd FROM c WHERE nd = 2 ORDER BY pos LIMIT 1), (SELECT nd FROM c ORDER BY pos DESC LIMIT 1)) AS n_distinct""")
def m1(spark, sf_dir):
    return L.choose_target(passengers(spark, sf_dir), exclude=KEY)


@register("M2_forest_importance")
def m2(spark, sf_dir):
    return L.forest_importance(passengers(spark, sf_dir), exclude=KEY)


@register("M3_clusters")
def m3(spark, sf_dir):
    return L.clusters(passengers(spark, sf_dir), cols=["age", "fare"], key=KEY)


@register("M4_pca")
def m4(spark, sf_dir):
    return L.pca(passengers(spark, sf_dir), k=2, key=KEY)


@register("M4_pca_variance")
def m4_var(spark, sf_dir):
    return rounded(L.pca_variance(passengers(spark, sf_dir), k=2, key=KEY),
                   {"explained_variance_ratio": 6, "cumulative": 6})


@register("M6_forest_metrics")
def m6(spark, sf_dir):
    return L.forest_metrics(passengers(spark, sf_dir), "survived", KEY)


# Model queries whose rows SQL can give: closed forms, invariants of the fit, planted signals.

@register("M2_forest_planted", "SELECT 'n3' AS top_feature, 4 AS n_features, 1.0 AS total FROM (SELECT count(*) AS c FROM lineitem) WHERE c > 0")
def m2_planted(spark, sf_dir):
    """A target made from one feature: that feature ranks first and the importances sum to 1."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("n1"), F.col("l_extendedprice").alias("n2"), F.col("l_linenumber").cast("double").alias("n3"),
        F.col("l_discount").alias("n4"), (F.col("l_linenumber") > 3).cast("int").alias("label"))
    out = L.forest_importance(li, target="label", num_trees=20)
    return out.agg(F.max(F.when(F.col("rank") == 1, F.col("feature"))).alias("top_feature"),
                   F.count("*").cast("int").alias("n_features"), F.round(F.sum("importance"), 6).alias("total"))


@register("M3_clusters_checked", "SELECT count(*) AS n_rows, 3 AS n_clusters, 0 AS violations FROM lineitem")
def m3_checked(spark, sf_dir):
    """Every row belongs to the centre (mean of its cluster's rows) that is nearest to it, in units of the
    columns' standard deviations; a tolerance of 0.01 covers the fit's own."""
    out = materialize(L.clusters(passengers(spark, sf_dir), cols=["age", "fare"], key=KEY), "m3-clusters")
    unit = scalar_stats(out, {c: F.stddev_samp(c) for c in ("age", "fare")})
    scaled = out.select("cluster", *[(F.col(c) / unit[c]).alias(c) for c in ("age", "fare")])
    centres = scaled.groupBy("cluster").agg(F.avg("age").alias("a"), F.avg("fare").alias("f")).collect()     # k rows
    away = {c["cluster"]: F.sqrt(F.pow(F.col("age") - c["a"], F.lit(2)) + F.pow(F.col("fare") - c["f"], F.lit(2))) for c in centres}
    own = F.coalesce(*[F.when(F.col("cluster") == c, d) for c, d in away.items()])
    return scaled.select("cluster", (own > F.least(*away.values()) + 0.01).alias("bad")).agg(
        F.count("*").alias("n_rows"), F.count_distinct("cluster").cast("int").alias("n_clusters"), F.count_if("bad").cast("int").alias("violations"))


@register("M4_pca_two_columns", """
WITH s AS (SELECT avg(l_quantity) AS ma, stddev_samp(l_quantity) AS sa, avg(l_extendedprice) AS mb, stddev_samp(l_extendedprice) AS sb,
                  corr(l_quantity, l_extendedprice) AS r FROM lineitem),
z AS (SELECT l_orderkey, l_linenumber, (l_quantity - ma) / sa AS a, sign(r) * (l_extendedprice - mb) / sb AS b FROM lineitem, s)
SELECT l_orderkey, l_linenumber, round(abs(a + b) / sqrt(2), 5) AS pc1, round(abs(a - b) / sqrt(2), 5) AS pc2 FROM z""")
def m4_two(spark, sf_dir):
    """Two standardised columns have the components (1, r) and (1, -r) / sqrt(2) up to sign."""
    key = ["l_orderkey", "l_linenumber"]
    out = L.pca(table(spark, sf_dir, "lineitem"), k=2, cols=["l_quantity", "l_extendedprice"], key=key)
    return out.select(*key, F.round(F.abs("pc1"), 5).alias("pc1"), F.round(F.abs("pc2"), 5).alias("pc2"))


@register("M4_pca_two_shares", """
SELECT unnest([1, 2]) AS component, round(unnest([(1 + abs(r)) / 2, (1 - abs(r)) / 2]), 6) AS explained_variance_ratio
FROM (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem)""")
def m4_two_shares(spark, sf_dir):
    out = L.pca_variance(table(spark, sf_dir, "lineitem"), k=2, cols=["l_quantity", "l_extendedprice"], key=["l_orderkey"])
    return rounded(out, {"explained_variance_ratio": 6}).drop("cumulative")


@register("M6_forest_planted", """
SELECT unnest(['accuracy', 'f1', 'weightedPrecision', 'weightedRecall', 'areaUnderROC']) AS metric, 1.0 AS value
FROM (SELECT count(*) AS c FROM lineitem) WHERE c > 0""")
def m6_planted(spark, sf_dir):
    """A label that one feature separates is learnt without a fault on the held-out rows."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_linenumber").cast("double").alias("n"), "l_quantity",
        (F.col("l_linenumber") > 3).cast("int").alias("label"))
    out = L.forest_metrics(li, "label", ["l_orderkey", "l_linenumber"], cols=["n", "l_quantity"], num_trees=20)
    return rounded(out, {"value": 6})
