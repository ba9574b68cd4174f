"""Machine-learning panels on Spark ML: target choice, forest importance, k-means, PCA.

Each fit runs over a narrow projection (features + label) persisted MEMORY_AND_DISK for the
duration of the fit, since the estimators pass over it many times. Only model-sized
results (k centres, one importance per feature, the k x d loadings) reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PCA, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.frames import col_of
from tablescope.functions.quantiles import scalar_stats
from tablescope.functions.roles import numeric_columns
from tablescope.operators.clean import fill_mean, fill_mode
from tablescope.operators.profile import cardinality
from tablescope.session import checkpoint_root, materialize

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)

TASK_BYTES = 256 << 20       # a forest's training rows of one task, as MLlib holds them
WALK_DEPTH = 10              # up to here walking a tree costs less than keeping every row's node in every tree


def _plain(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The columns renamed f0, f1, ... (MLlib reads dots as paths) and the new name of each."""
    names = {c: f"f{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def _spread(df: DataFrame, partitions: int = 0) -> DataFrame:
    """Rows dealt by their hash to ``spark.sql.shuffle.partitions`` partitions (or more, if asked) and
    ordered inside each: neither the layout of the input nor the number of cores changes the model."""
    partitions = max(partitions, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = F.xxhash64(*[col_of(c) for c in df.columns])
    return df.withColumn("__h", key).repartition(partitions, "__h").sortWithinPartitions("__h").drop("__h")


def _forest_partitions(rows: int, num_trees: int, features: int) -> int:
    """Partitions that hold at most ``TASK_BYTES`` of MLlib's own copy of ``rows`` training rows: a row carries its
    bins and one weight per tree, four bytes each, and object headers."""
    return -(-rows * (4 * (num_trees + features) + 160) // TASK_BYTES)


def choose_target(df: DataFrame, cols: Sequence[str] | None = None, exclude=()) -> DataFrame:
    """(target, rule, n_distinct): the first numeric column with exactly 2 distinct values,
    else the last numeric column.

    "Exactly 2" needs no distinct count: minimum and maximum differ and no value lies elsewhere
    (two one-row aggregates). Distinct values are counted for the last column only.
    """
    cols = list(cols) if cols is not None else numeric_columns(df, exclude=exclude)
    ends = scalar_stats(df, {f"{p}{i}": fn(col_of(c)) for i, c in enumerate(cols) for p, fn in (("lo", F.min), ("hi", F.max))})
    between = scalar_stats(df, {f"n{i}": F.count_if((col_of(c) != ends[f"lo{i}"]) & (col_of(c) != ends[f"hi{i}"]))
                                for i, c in enumerate(cols)})
    binary = F.coalesce(*[F.when((ends[f"lo{i}"] < ends[f"hi{i}"]) & (between[f"n{i}"] == 0), F.lit(c)) for i, c in enumerate(cols)])
    last = cardinality(df, cols[-1:]).select(F.col("n_distinct"), binary.alias("b"))
    return last.select(F.coalesce("b", F.lit(cols[-1])).alias("target"),
                       F.when(F.col("b").isNotNull(), "first binary").otherwise("last numeric").alias("rule"),
                       F.when(F.col("b").isNotNull(), F.lit(2).cast("long")).otherwise(F.col("n_distinct")).alias("n_distinct"))


def target_name(df: DataFrame, cols=None, exclude=()) -> str:
    return choose_target(df, cols, exclude).first()["target"]


def _is_classification(df: DataFrame, target: str) -> bool:
    """By data type alone: whole numbers, text and booleans are classes."""
    return isinstance(df.schema[target].dataType, (*_INTEGRAL, T.StringType, T.BooleanType))


def _prepare(df: DataFrame, feats: Sequence[str], target: str) -> DataFrame:
    data = fill_mode(fill_mean(df.select(*[col_of(c) for c in (*feats, target)]), list(feats)), [target])
    return data.where(col_of(target).isNotNull())


def forest_importance(df: DataFrame, target: str | None = None, cols: Sequence[str] | None = None,
                      exclude=(), num_trees: int = 100, max_depth: int = 5, seed: int = 42,
                      max_bins: int = 32, min_leaf: int = 1) -> DataFrame:
    """(feature, importance, rank): random-forest importances, descending, summing to 1.

    Features are mean-filled, the target mode-filled. A whole-number, text or boolean target is
    classified; a fractional one gets a regression forest. Depth, bins and leaf size are the
    caller's: MLlib grows level by level, so its cost doubles with each level (at most 30). Where
    each row stands in each tree is kept between levels for deep trees only; for shallow ones that copy is larger
    than the rows and the walk from the root is short. The model is the same.
    """
    spark = df.sparkSession
    nums = list(cols) if cols is not None else numeric_columns(df, exclude=exclude)
    if len(nums) < 2:
        raise ValueError("a forest needs at least two numeric columns")
    if target is None:
        target = target_name(df, nums)
    feats = [c for c in nums if c != target]
    classify = _is_classification(df, target)
    prepared, names = _plain(_prepare(df, feats, target))
    label = names[target]
    if not classify:
        prepared = prepared.withColumn(label, F.col(label).cast("double"))
    data = _spread(prepared, _forest_partitions(df.count(), num_trees, len(feats))).persist(StorageLevel.MEMORY_AND_DISK)
    checkpoint_root(spark)
    try:
        stages = [VectorAssembler(inputCols=[names[f] for f in feats], outputCol="__features", handleInvalid="keep")]
        if classify:
            stages += [StringIndexer(inputCol=label, outputCol="__label", stringOrderType="alphabetAsc"),
                       RandomForestClassifier(featuresCol="__features", labelCol="__label", numTrees=num_trees,
                                              maxDepth=max_depth, maxBins=max_bins, minInstancesPerNode=min_leaf,
                                              seed=seed, cacheNodeIds=max_depth > WALK_DEPTH,
                                              checkpointInterval=10)]
        else:
            stages += [RandomForestRegressor(featuresCol="__features", labelCol=label, numTrees=num_trees,
                                             maxDepth=max_depth, maxBins=max_bins, minInstancesPerNode=min_leaf,
                                             seed=seed, cacheNodeIds=max_depth > WALK_DEPTH,
                                             checkpointInterval=10)]
        model = Pipeline(stages=stages).fit(data)
    finally:
        data.unpersist()
    imp = model.stages[-1].featureImportances.toArray().tolist()
    rows = sorted(((f, float(v)) for f, v in zip(feats, imp)), key=lambda t: (-t[1], t[0]))
    return spark.createDataFrame([(f, v, i + 1, target) for i, (f, v) in enumerate(rows)],
                                 "feature string, importance double, rank int, target string")


def clusters(df: DataFrame, cols: Sequence[str] | None = None, k: int = 3, seed: int = 42,
             key: Sequence[str] = (), max_iter: int = 300) -> DataFrame:
    """Cluster id per row: k-means on the first two numeric columns, mean-filled and
    standardised. Ids are renumbered by the order of the cluster centres, so they do not
    depend on initialisation order."""
    cols = list(cols) if cols is not None else numeric_columns(df, 2, exclude=key)
    if len(cols) < 2:
        raise ValueError("k-means needs two numeric columns")
    data = fill_mean(df.select(*[col_of(c) for c in (*key, *cols)]), cols)
    data, names = _plain(data)
    fit_input = _spread(data).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        pipe = Pipeline(stages=[
            VectorAssembler(inputCols=[names[c] for c in cols], outputCol="__raw"),
            StandardScaler(inputCol="__raw", outputCol="__features", withMean=True, withStd=True),
            KMeans(k=k, seed=seed, featuresCol="__features", predictionCol="__cluster", maxIter=max_iter)])
        model = pipe.fit(fit_input)
        centres = [tuple(float(v) for v in c) for c in model.stages[-1].clusterCenters()]
        order = sorted(range(len(centres)), key=lambda i: centres[i])
        relabel = F.lit(None).cast("int")
        for new, old in enumerate(order):
            relabel = F.when(F.col("__cluster") == old, F.lit(new)).otherwise(relabel)
    finally:
        fit_input.unpersist()
    return model.transform(data).select(*[F.col(names[c]).alias(c) for c in (*key, *cols)], relabel.alias("cluster"))


def _pca_fit(df: DataFrame, k: int, cols, key, min_rows: int):
    cols = list(cols) if cols is not None else numeric_columns(df, exclude=key)
    if len(cols) < 2:
        raise ValueError("PCA needs two numeric columns")
    data, names = _plain(df.select(*[col_of(c) for c in (*key, *cols)]))
    data = data.dropna(subset=[names[c] for c in cols])
    if data.limit(min_rows).count() < min_rows:
        raise ValueError(f"PCA needs {min_rows} rows without nulls")
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=[names[c] for c in cols], outputCol="__raw"),
        StandardScaler(inputCol="__raw", outputCol="__scaled", withMean=True, withStd=True),
        PCA(k=k, inputCol="__scaled", outputCol="__pcs")])
    fit_input = _spread(data).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = pipe.fit(fit_input)
    finally:
        fit_input.unpersist()
    pc = model.stages[-1].pc.toArray()               # d x k loadings
    signs = []
    for j in range(pc.shape[1]):
        col = pc[:, j]
        top = max(range(len(col)), key=lambda i: abs(col[i]))
        signs.append(1.0 if col[top] >= 0 else -1.0)
    return names, data, model, signs


def pca(df: DataFrame, k: int = 2, cols: Sequence[str] | None = None, key: Sequence[str] = (),
        min_rows: int = 10) -> DataFrame:
    """Scores on the first k principal components of the standardised numeric columns.

    Rows with any null are dropped; fewer than ``min_rows`` rows or 2 columns are refused.
    Each component's sign is fixed so that its largest loading is positive.
    """
    names, data, model, signs = _pca_fit(df, k, cols, key, min_rows)
    arr = vector_to_array(F.col("__pcs"))
    return model.transform(data).select(
        *[F.col(names[c]).alias(c) for c in key], *[(arr[j] * F.lit(signs[j])).alias(f"pc{j + 1}") for j in range(k)])


def pca_variance(df: DataFrame, k: int = 2, cols: Sequence[str] | None = None, key: Sequence[str] = (),
                 min_rows: int = 10) -> DataFrame:
    """(component, explained_variance_ratio, cumulative) of the first k components."""
    _, _, model, _ = _pca_fit(df, k, cols, key, min_rows)
    ev = model.stages[-1].explainedVariance.toArray().tolist()
    rows, run = [], 0.0
    for j, v in enumerate(ev):
        run += v
        rows.append((j + 1, float(v), float(run)))
    return df.sparkSession.createDataFrame(rows, "component int, explained_variance_ratio double, cumulative double")


def forest_metrics(df: DataFrame, target: str, key: Sequence[str], cols: Sequence[str] | None = None,
                   train_pct: int = 80, num_trees: int = 100, max_depth: int = 5, seed: int = 42,
                   max_bins: int = 32, min_leaf: int = 1) -> DataFrame:
    """(metric, value) of a classification forest on a keyed split: a row is in the test
    set when pmod(xxhash64(key), 100) >= train_pct, so the split is repeatable and needs no
    random sampling state.

    Feature means come from the training split; rows without a label are not scored. A label that
    only the test split holds counts as missed. One grouped count of (label, prediction) over
    one pass of the forest gives accuracy, f1, weightedPrecision and weightedRecall (weights: the true
    labels); with two labels areaUnderROC is added.
    """
    spark = df.sparkSession
    nums = list(cols) if cols is not None else numeric_columns(df, exclude=key)
    feats = [c for c in nums if c != target]
    bucket = F.pmod(F.xxhash64(*[col_of(c) for c in key]), F.lit(100))
    rows = df.select(*[col_of(c).cast("double").alias(f"f{i}") for i, c in enumerate(feats)],
                     col_of(target).cast("string").alias("label"), bucket.alias("bucket")).where("label is not null")
    names = [f"f{i}" for i in range(len(feats))]
    train = rows.where(F.col("bucket") < train_pct)
    mean = scalar_stats(train, {n: F.avg(n) for n in names})
    data = materialize(_spread(rows.withColumns({n: F.coalesce(n, mean[n]) for n in names})), "forest-rows")
    checkpoint_root(spark)
    indexer = StringIndexer(inputCol="label", outputCol="index", stringOrderType="alphabetAsc").fit(data)
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep"), indexer,
        RandomForestClassifier(featuresCol="features", labelCol="index", numTrees=num_trees,
                               maxDepth=max_depth, maxBins=max_bins, minInstancesPerNode=min_leaf, seed=seed,
                               cacheNodeIds=max_depth > WALK_DEPTH, checkpointInterval=10)])
    train = data.where(F.col("bucket") < train_pct)
    # The rows above are narrow, so Spark reads many of them in one task; the forest's copy of a row is much wider.
    partitions = _forest_partitions(train.count(), num_trees, len(names))
    if train.rdd.getNumPartitions() < partitions:
        train = _spread(train, partitions)
    model = pipe.fit(train)
    pred = materialize(model.transform(data.where(F.col("bucket") >= train_pct))
                       .select("index", "prediction", vector_to_array("probability").alias("p")), "forest-scores")
    # labels x labels counts: bounded by the number of classes
    cells = {(r["index"], r["prediction"]): r["count"] for r in pred.groupBy("index", "prediction").count().collect()}
    total = sum(cells.values())
    true: dict[float, int] = {}
    said: dict[float, int] = {}
    for (t, p), n in cells.items():
        true[t], said[p] = true.get(t, 0) + n, said.get(p, 0) + n
    f1 = precision = recall = 0.0
    for t, n in true.items():
        hit = cells.get((t, t), 0)
        pr, re = hit / said[t] if said.get(t) else 0.0, hit / n
        precision, recall = precision + pr * n, recall + re * n
        f1 += (2 * pr * re / (pr + re) if hit else 0.0) * n
    results = [("accuracy", sum(n for (t, p), n in cells.items() if t == p) / total), ("f1", f1 / total),
               ("weightedPrecision", precision / total), ("weightedRecall", recall / total)] if total else []
    if total and len(indexer.labels) == 2:
        ev = BinaryClassificationEvaluator(labelCol="index", rawPredictionCol="score", metricName="areaUnderROC")
        results.append(("areaUnderROC", float(ev.evaluate(pred.select("index", F.col("p")[1].alias("score"))))))
    return spark.createDataFrame(results, "metric string, value double")
