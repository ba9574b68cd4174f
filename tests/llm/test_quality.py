import zlib

import numpy as np
from pyspark.sql import functions as F

from tablescope.llm import quality
from tablescope.llm.queries import QUERIES


def test_held_out_accuracy(spark, tables):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in QUERIES["op6_quality_classifier"](spark, sf).collect()}
    assert len(rows) == 1000
    labels = [r.asDict() for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [(rows[x["doc_id"]], x["quality"]) for x in labels if rows[x["doc_id"]]["held_out"]]
    pos = np.array([r["score"] for r, q in held if q == 1])
    neg = np.array([r["score"] for r, q in held if q == 0])
    auc = (pos[:, None] > neg[None, :]).mean()
    acc = np.mean([r["predicted"] == q for r, q in held])
    print("auc", auc, "accuracy", acc, "kept of good", (pos >= .5).mean(), "rejected of bad", (neg < .5).mean())
    assert auc > 0.9 and acc > 0.95 and (pos >= .5).mean() > 0.98


def test_edges(spark):
    d = spark.createDataFrame([(1, None, 0.5), (2, "", 0.1), (None, "a b", 0.2), (3, "good words here", None)],
                              "doc_id long, text string, score double")
    lab = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (4, None), (5, 7)], "doc_id long, quality int")
    none = quality.train(quality.training_rows(d, lab.limit(0)))
    assert not none.any()
    out = quality.score(d, none).collect()
    assert len(out) == 4 and {r["score"] for r in out} == {0.5}
    rows = quality.training_rows(d, lab)
    assert [r["label"] for r in rows.collect()] in ([0], [])       # the smallest of several labels, unless held out
    assert quality.score(d.limit(0), none).count() == 0
    assert quality.score(d, none).select("row.score").where("score is null").count() == 1


def test_sample_is_bounded(spark):
    many = spark.range(3000).select(F.col("id"), F.concat(F.lit("word "), F.col("id")).alias("text"), (F.col("id") % 2).alias("label"))
    w = quality.train(many, dims=1 << 12, max_rows=200, shard_rows=100, epochs=1)
    assert w.shape == ((1 << 12) + 1,) and w.any()
