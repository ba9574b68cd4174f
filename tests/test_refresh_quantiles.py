"""Quantiles of a stream: exact where bins tell, within their error elsewhere; old snapshots go."""

import os

import numpy as np
import pytest

from tablescope.session import shared_dir
from tablescope.streaming.refresh import (DROP_BITS, binned_values, file_stream, latest, quantiles_of_bins, refresh,
                                          run_until_caught_up)

PROBS, NAMES = [0.0, 0.25, 0.5, 0.9, 1.0], ["a", "b", "c", "d", "e"]


def test_quantiles_refresh_over_triggers(spark):
    rng = np.random.default_rng(3)
    rows = [("wide", float(v)) for v in np.exp(rng.normal(0, 40, 900)) * rng.choice([-1, 1], 900)]
    rows += [("cents", float(v) / 100) for v in rng.integers(-500, 500, 900)] + [("one", 4.5), ("zero", 0.0), ("zero", -0.0)]
    rows += [("cents", None), ("cents", float("nan")), (None, 3.0), ("null", None)]
    source, sink, ckpt = (shared_dir(spark, n) for n in ("rq-source", "rq-sink", "rq-ckpt"))
    spark.createDataFrame(rows, "g string, `a.v` double").repartition(5).write.parquet(source)
    stream = file_stream(spark, source, "g string, `a.v` double", max_files_per_trigger=1)
    for bits, exact in ((DROP_BITS, {"cents", "one", "zero"}), (0, {"wide", "cents", "one", "zero"}), (50, {"one", "zero"})):
        at, mark = f"{sink}-{bits}", f"{ckpt}-{bits}"
        q = refresh(stream, lambda s: binned_values(s, ["a.v"], ["g"], bits), at, mark, available_now=True, keep=2,
                      finish=lambda b: quantiles_of_bins(b, PROBS, NAMES, ["g"]))
        run_until_caught_up(q)
        got = {r.g: r for r in latest(spark, at).collect()}
        assert set(got) == {"wide", "cents", "one", "zero"}
        for g, r in got.items():
            v = np.array([x for k, x in rows if k == g and x is not None and not np.isnan(x)])
            assert r.n == len(v) and r.column == "a.v"
            assert (r.error == 0) or g not in exact
            for p, name in zip(PROBS, NAMES):
                want = np.quantile(v, p)
                assert abs(r[name] - want) <= r.error + 1e-9 * abs(want)
        kept = sorted(int(f.split("=")[1]) for f in os.listdir(at.removeprefix("file:")) if f.startswith("batch_id="))
        assert kept == [3, 4]


def test_a_snapshot_has_to_stay(spark):
    with pytest.raises(ValueError):
        refresh(None, None, "", "", keep=0)
