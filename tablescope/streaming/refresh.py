"""Auto-refresh as a streaming job.

A file stream feeds a summary in complete mode: any aggregate that Spark can keep as streaming
state, e.g. ``outcome_rate``, ``missing_profile`` or ``table_metrics``; operators that run jobs while the
plan is built (box, violin, filter domains) can't. Quantiles are kept as counts per bin of the values' order-preserving
images (``binned_values``) and read off each snapshot (``quantiles_of_bins``). Each trigger writes the whole current
summary to a folder of its own, ``batch_id=N``; readers take the highest one whose write is complete
(``_SUCCESS``), so a reader or a crash in the middle of a write still finds the snapshot before. A
batch that is run again after a crash replaces its own folder. The newest ``keep`` snapshots stay. The checkpoint
location lies in the shared folder, so a restarted driver or lost executor resumes from the last
committed batch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tablescope.functions.frames import col_of
from tablescope.functions.quantiles import with_image
from tablescope.session import discard, materialize

# The refresh choices offered (seconds), default 30.
REFRESH_INTERVALS = (5, 10, 30, 60, 300)
DEFAULT_INTERVAL = 30
KEEP = 10                    # snapshots that stay
DROP_BITS = 32               # low bits of a value's image that a bin leaves out: bins 2^-20 of the value wide
PART_BITS = 10               # bins of one part, when ranks are looked up


def file_stream(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming DataFrame over the files of a folder or glob (explicit schema, no inference)."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def binned_values(stream: DataFrame, cols: Sequence[str], by: Sequence[str] = (), drop_bits: int = DROP_BITS) -> DataFrame:
    """(by, column, bin, n, lo, hi): counts and exact extremes of the values of each bin, as streaming state.

    A bin is the image of a value (``with_image``) without its low bits, so bins follow the order of the values and
    their width is a fixed share of the value; state is bounded by the bins, not by the rows. Nulls, NaN and rows with a
    null group key are left out.
    """
    long = stream.select(*[col_of(b) for b in by], F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), col_of(c).cast("double").alias("__v")) for c in cols])))
    long = long.where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    for b in by:
        long = long.where(col_of(b).isNotNull())
    keys = [*[col_of(b) for b in by], F.col("column")]
    return (with_image(long, "__v", "__i").groupBy(*keys, F.shiftright("__i", drop_bits).alias("bin"))
            .agg(F.count("__v").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi")))


def quantiles_of_bins(bins: DataFrame, probs: Sequence[float], names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, column, n, <names...>, error): quantiles, interpolated linearly, of a table of ``binned_values``.

    The first and the last value of a bin are known, so is every value of a bin whose extremes are equal; another rank gives
    the middle of its bin's extremes. ``error`` bounds the difference of any of the quantiles from the exact one, 0 where all are
    exact. Ranks are looked up among parts of 2^PART_BITS bins first, then among the bins of the parts they fall into.
    """
    keys, part = [*by, "column"], F.shiftright("bin", PART_BITS).alias("part")
    quoted = [col_of(k) for k in keys]
    parts = bins.groupBy(*quoted, part).agg(F.sum("n").alias("c"))
    through = F.sum("c").over(Window.partitionBy(*quoted).orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.withColumn("before", through - F.col("c"))
    total = parts.groupBy(*quoted).agg(F.sum("c").alias("total"))
    places = [(F.col("total") - 1).cast("double") * F.lit(float(p)) for p in probs]
    ranks = total.withColumn("rank", F.explode(F.array_distinct(F.array(*[r for a in places for r in (F.floor(a), F.ceil(a))]))))
    at = (ranks.join(parts, keys).where("rank >= before and rank < before + c").select(*quoted, "rank", "part", "before"))
    inside = bins.withColumn("part", part).join(at.select(*quoted, "part").distinct(), [*keys, "part"], "left_semi")
    within = Window.partitionBy(*quoted, "part").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("upto", F.sum("n").over(within))
    place = F.col("rank") - F.col("before") - F.col("upto") + F.col("n")        # position inside the bin
    hit = at.join(inside, [*keys, "part"]).withColumn("place", place).where("place >= 0 and place < n")
    value = (F.when(F.col("place") == 0, F.col("lo")).when(F.col("place") == F.col("n") - 1, F.col("hi"))
             .when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) / 2))
    off = F.when((F.col("place") == 0) | (F.col("place") == F.col("n") - 1) | (F.col("lo") == F.col("hi")), F.lit(0.0)).otherwise(
        (F.col("hi") - F.col("lo")) / 2)
    found = hit.groupBy(*quoted).agg(F.map_from_entries(F.collect_list(F.struct("rank", value.alias("v")))).alias("at"),   # two a probability
                                     F.max(off).alias("error"))
    outs = []
    for a, name in zip(places, names, strict=True):
        k, k2 = F.floor(a), F.ceil(a)
        x, y = F.element_at("at", k), F.element_at("at", k2)
        outs.append(F.when((k == k2) | (x == y), x).otherwise((k2 - a) * x + (a - k) * y).alias(name))
    return found.join(total, keys).select(*quoted, F.col("total").alias("n"), *outs, "error")


def _drop_old(spark: SparkSession, sink_path: str, newest: int, keep: int) -> None:
    """Delete the snapshots before the newest ``keep`` ones."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(sink_path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in fs.listStatus(path(sink_path)):
        name = f.getPath().getName()
        if name.startswith("batch_id=") and int(name.split("=")[1]) <= newest - keep:
            fs.delete(f.getPath(), True)


def refresh(stream: DataFrame, build: Callable[[DataFrame], DataFrame], sink_path: str,
            checkpoint_path: str, interval_seconds: int | None = DEFAULT_INTERVAL,
            available_now: bool = False, query_name: str | None = None,
            finish: Callable[[DataFrame], DataFrame] | None = None, keep: int = KEEP) -> StreamingQuery:
    """Start the refresh job. ``available_now`` processes what is there and stops (tests,
    scheduled runs); otherwise it triggers every ``interval_seconds``. ``finish`` turns each whole state table,
    written once per trigger, into the snapshot. After a snapshot is complete, those before the newest ``keep`` are
    deleted: a reader has ``keep`` triggers to end."""
    if keep < 1:
        raise ValueError("at least one snapshot has to stay")
    summary = build(stream)

    def write_snapshot(batch: DataFrame, batch_id: int) -> None:
        state = materialize(batch, "refresh-state") if finish else None
        out = finish(state) if finish else batch
        out.withColumn("refreshed_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{sink_path}/batch_id={batch_id}")
        if state is not None:
            discard(state)
        _drop_old(batch.sparkSession, sink_path, batch_id, keep)

    writer = (summary.writeStream.outputMode("complete").foreachBatch(write_snapshot)
              .option("checkpointLocation", checkpoint_path))
    if query_name:
        writer = writer.queryName(query_name)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif interval_seconds:
        writer = writer.trigger(processingTime=f"{int(interval_seconds)} seconds")
    return writer.start()


def run_until_caught_up(query: StreamingQuery, timeout_seconds: int = 600) -> None:
    query.awaitTermination(timeout_seconds)
    if query.isActive:
        query.processAllAvailable()
        query.stop()
    if query.exception() is not None:
        raise RuntimeError(f"refresh failed: {query.exception()}")


def latest(spark: SparkSession, sink_path: str, with_stamp: bool = False) -> DataFrame:
    """The newest complete snapshot; the batch id and time stamp are dropped unless asked for."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(sink_path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(path(sink_path))
            if f.getPath().getName().startswith("batch_id=") and fs.exists(path(f.getPath(), "_SUCCESS"))]
    if not done:
        raise FileNotFoundError(f"no complete snapshot under {sink_path}")
    snap = spark.read.parquet(f"{sink_path}/batch_id={max(done)}").withColumn("batch_id", F.lit(max(done)))
    return snap if with_stamp else snap.drop("batch_id", "refreshed_at")
