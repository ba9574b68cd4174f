import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescope.llm import shard
from tablescope.llm.queries import QUERIES


def check_slots(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    return by


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op3_histogram_sharding"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    size = defaultdict(int)
    for r in rows:
        body = docs[r["doc_id"]].encode()
        assert r["size"] == len(body) + 1 and r["text_crc32"] == zlib.crc32(body) and r["law"] == "bytes"
        size[r["shard"]] += r["size"]
    check_slots(rows)
    assert set(size) == set(range(16))
    # a boundary is off by half a document at most, so a shard by one
    assert max(size.values()) - min(size.values()) <= 2 * max(r["size"] for r in rows)
    # a group of copies lies in neighbouring shards, and most lie in one
    groups = defaultdict(set)
    for r in rows:
        groups[docs[r["doc_id"]]].add(r["shard"])
    assert sum(len(g) > 1 for g in groups.values()) <= 15


def test_hot_group_is_split(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.concat(F.lit("t"), "id")).alias("text"),
                                  F.lit(10).alias("size"), F.lit(1).alias("shard"), F.lit("x").alias("row"))
    rows = shard.shard(df, "size", "text").select("row.id", "shard", "slot").collect()
    counts = {k: len(v) for k, v in check_slots(rows).items()}
    assert len(rows) == 3000 and len(counts) == 16 and max(counts.values()) - min(counts.values()) <= 2


def test_edges(spark):
    schema = "id long, text string, size long"
    few = spark.createDataFrame([(1, None, None), (None, "a", 5), (2, "a", 5), (2, "a", 5), (3, "", 0)], schema)
    check_slots(rows := shard.shard(few, "size", "text").collect())
    assert len(rows) == 5
    same = spark.createDataFrame([(None, None, 7)] * 40, schema)
    rows = shard.shard(same, "size", "text").collect()
    check_slots(rows)
    assert len(rows) == 40 and len({r["shard"] for r in rows}) == 1
    assert shard.shard(few.limit(0), "size", "text").count() == 0
    zero = spark.createDataFrame([(i, str(i), 0) for i in range(40)], schema)
    check_slots(rows := shard.shard(zero, "size", "text").collect())
    assert len(rows) == 40


def test_locate_equals_tuple_order():
    rng = np.random.default_rng(1)
    k = rng.integers(-3, 4, (500, 2))
    bounds = np.array(sorted({tuple(x) for x in rng.integers(-3, 4, (15, 2)).tolist()}))
    want = [sum(tuple(b) <= (a, c) for b in bounds.tolist()) for a, c in k.tolist()]
    assert shard.locate(k[:, 0], k[:, 1], bounds).tolist() == want


def test_write_shards(spark, tmp_dir):
    df = spark.range(200).select("id", F.col("id").cast("string").alias("text"), F.lit(1).alias("size"))
    shard.write_shards(shard.shard(df, "size", "text", shards=4), f"{tmp_dir}/out")
    back = spark.read.parquet(f"{tmp_dir}/out")
    assert back.count() == 200 and back.select("shard").distinct().count() == 4
