"""Registered streaming query (R1): the refresh job over events, run to completion."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescope.operators.groups import outcome_rate
from tablescope.operators.profile import missing_profile, table_metrics
from tablescope.plans.catalog import table
from tablescope.plans.registry import register, rounded
from tablescope.session import shared_dir
from tablescope.streaming.refresh import binned_values, file_stream, latest, quantiles_of_bins, refresh, run_until_caught_up


def _events_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return file_stream(spark, f"{sf_dir.rstrip('/')}/events*.parquet", schema)


def _group_rates(s):
    return s.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"),
        F.avg("value").alias("value_mean"),
        F.sum("value").alias("value_sum"),
        F.count_if(F.col("value") > 10).alias("high_value"),
        F.avg((F.col("value") > 10).cast("int")).alias("high_value_rate"))


def _run(spark, sf_dir, build, name):
    sink, ckpt = shared_dir(spark, f"{name}-sink"), shared_dir(spark, f"{name}-ckpt")
    q = refresh(_events_stream(spark, sf_dir), build, sink, ckpt, available_now=True)
    run_until_caught_up(q)
    return latest(spark, sink)


@register("R1_refresh_group_rates", """
SELECT event_type, count(*) AS events, round(avg(value), 6) AS value_mean, round(sum(value), 2) AS value_sum,
       count(*) FILTER (WHERE value > 10) AS high_value,
       round(avg(CAST(value > 10 AS INTEGER)), 6) AS high_value_rate
FROM events GROUP BY event_type""")
def r1(spark, sf_dir):
    out = _run(spark, sf_dir, _group_rates, "r1-rates")
    return rounded(out, {"value_mean": 6, "value_sum": 2, "high_value_rate": 6})


@register("R1_refresh_table_metrics", """
SELECT count(*) AS total_records, 'event_id' AS first_numeric,
       round(avg(CAST(event_id AS DOUBLE)), 6) AS first_numeric_avg,
       CAST(sum((event_id IS NULL)::INT + (ts IS NULL)::INT + (user_id IS NULL)::INT + (event_type IS NULL)::INT
           + (value IS NULL)::INT + (props IS NULL)::INT) AS BIGINT) AS missing_cells,
       round(sum((event_id IS NULL)::INT + (ts IS NULL)::INT + (user_id IS NULL)::INT + (event_type IS NULL)::INT
           + (value IS NULL)::INT + (props IS NULL)::INT) * 100.0 / (count(*) * 6), 6) AS missing_pct,
       6 AS n_columns
FROM events HAVING count(*) > 0""")
def r1_metrics(spark, sf_dir):
    out = _run(spark, sf_dir, table_metrics, "r1-metrics")
    return rounded(out, {"first_numeric_avg": 6, "missing_pct": 6})


def _several_files(spark, sf_dir, parts=4):
    """events as several files with nulls injected, streamed one file per trigger."""
    ev = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_id") % 9 > 0, F.col("value")))
    ev = ev.withColumn("high", (F.col("value") > 10).cast("int"))
    path = shared_dir(spark, "r1-events")
    ev.repartition(parts, "event_id").write.parquet(path)
    return file_stream(spark, path, spark.read.parquet(path).schema, max_files_per_trigger=1)


def _run_over_batches(spark, sf_dir, build, name, **options):
    sink, ckpt = shared_dir(spark, f"{name}-sink"), shared_dir(spark, f"{name}-ckpt")
    run_until_caught_up(refresh(_several_files(spark, sf_dir), build, sink, ckpt, available_now=True, **options))
    return latest(spark, sink)


_EV = "(SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 9 > 0 THEN value END AS value, props FROM events)"


@register("R1_refresh_missing", f"""
WITH e AS (SELECT *, CAST(value > 10 AS INTEGER) AS high FROM {_EV})
""" + "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", CAST(count(*) - count({c}) AS BIGINT) AS missing_count,
       round((count(*) - count({c})) * 100.0 / count(*), 6) AS missing_pct FROM e"""
    for c in ("event_id", "ts", "user_id", "event_type", "value", "props", "high")))
def r1_missing(spark, sf_dir):
    """Missing counts per column, kept as state over one file per trigger."""
    out = _run_over_batches(spark, sf_dir, missing_profile, "r1-missing")
    return rounded(out.select("column", "missing_count", "missing_pct"), {"missing_pct": 6})


@register("R1_refresh_outcome", f"""
WITH e AS (SELECT *, CAST(value > 10 AS INTEGER) AS high FROM {_EV})
SELECT event_type, count(high) AS total, CAST(sum(high) AS BIGINT) AS positives, round(avg(CAST(high AS DOUBLE)), 6) AS rate
FROM e WHERE event_type IS NOT NULL GROUP BY event_type""")
def r1_outcome(spark, sf_dir):
    out = _run_over_batches(spark, sf_dir, lambda s: outcome_rate(s, "event_type", "high"), "r1-outcome")
    return rounded(out, {"rate": 6})


@register("R1_refresh_quantiles", f"""
WITH q AS (SELECT event_type, 'value' AS "column", count(value) AS n, quantile_cont(value, 0.25) AS q1,
                  quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
           FROM {_EV} WHERE event_type IS NOT NULL AND value IS NOT NULL GROUP BY event_type)
SELECT event_type, "column", n, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
       round(q1 - 1.5 * (q3 - q1), 4) AS lower_fence, round(q3 + 1.5 * (q3 - q1), 4) AS upper_fence, true AS within FROM q""")
def r1_quantiles(spark, sf_dir):
    """Medians and outlier fences per group, refreshed over one file per trigger."""
    names = ["q1", "median", "q3"]
    out = _run_over_batches(spark, sf_dir, lambda s: binned_values(s, ["value"], ["event_type"]), "r1-quantiles", keep=2,
                            finish=lambda bins: quantiles_of_bins(bins, [0.25, 0.5, 0.75], names, ["event_type"]))
    iqr = F.col("q3") - F.col("q1")
    out = out.withColumns({"lower_fence": F.col("q1") - 1.5 * iqr, "upper_fence": F.col("q3") + 1.5 * iqr, "within": F.col("error") <= 1e-6})
    return rounded(out.drop("error"), {c: 4 for c in (*names, "lower_fence", "upper_fence")})
