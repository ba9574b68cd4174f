"""Session helpers: a tuned builder for local runs and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job here relies on: AQE re-plans joins and coalesces partitions at run
# time (its broadcast conversion is the size check behind every small join), and skewed
# shuffle partitions are split.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tablescope", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session. On a cluster pass master=None and let spark-submit decide."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    The setting is read from the session. Where it is unset, a session with a local master gets
    a folder of its own, so ``DataFrame.checkpoint`` works in tests; on a cluster that is an error, as
    executors could not see such a folder.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        current = sc.getCheckpointDir()
        if current:
            return current
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tablescope-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder (never a machine-local temp dir)."""
    return f"{checkpoint_root(spark)}/tablescope/{name}-{uuid.uuid4().hex[:12]}"


def env_int(name: str, default: int) -> int:
    try:
        return int(os.environ.get(name, default))
    except ValueError:
        return default


# While a scratch table is written: shuffle files go when it ends, and Python workers get batches of few megabytes.
WRITE_CONF = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
              "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def materialize(df, name: str):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Used when several jobs read one expensive derived table (joins, fills): they then scan
    a columnar copy instead of re-running its lineage, and the copy survives lost
    executors (unlike a cache or a local checkpoint). The shuffle files of the write are
    of no further use and are removed when it ends.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    before = {key: spark.conf.get(key, None) for key in WRITE_CONF}
    for key, value in WRITE_CONF.items():
        spark.conf.set(key, value)
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables) -> None:
    """Delete tables that ``materialize`` wrote and that no later step reads."""
    for table in tables:
        sc = table.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
