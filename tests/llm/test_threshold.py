import math

import numpy as np
import pytest

from tablescope.llm import threshold
from tablescope.llm.queries import QUERIES


def brute(rows, k=5, every=50):
    """rows: (id, vector) -> sorted (query, rank, id, score)."""
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in ok:
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in ok if j != i and len(v) == len(q))
            out |= {(i, tuple(q), r + 1, j, -s) for r, (s, j) in enumerate(found[:k])}
    return sorted((i, r, j, s) for i, _, r, j, s in out)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "vec_id long, embedding array<float>, vector string, id int").repartition(3)
    v = threshold.integer_vectors(df)
    return sorted(tuple(r) for r in threshold.top_k(v, v.filter("id % 50 = 0"), **kw).collect())


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in QUERIES["op13_threshold_top_k"](spark, sf).collect()) == brute(rows)


@pytest.mark.parametrize("block_bytes", [200, 8_000_000])
def test_ties_and_blocks(spark, block_bytes):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6) / 256]) for i in range(400)]
    rows += [(1000 + i, [2 / 256] * 6) for i in range(300)]              # one vector many times
    rows += [(50, rows[7][1]), (100, rows[100][1]), (3, rows[3][1])]       # ids and rows that repeat
    got = run(spark, rows, block_bytes=block_bytes)
    ok = brute([r for n, r in enumerate(rows) if n != len(rows) - 2])      # an equal query row is one query ...
    again = brute(rows)
    assert set(got) <= set(ok) | set(again) and len(got) == len(again)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, None), (100, [None, 1.0]), (150, [nan, 1.0]), (200, [inf, 1.0]), (None, [1.0, 1.0]), (250, []), (251, []),
            (300, [1.0] * 40), (301, [-1.0] * 40), (350, [0.0, 0.0]), (1, [-1.0, 0.5]), (2, [1e30, 1.0]), (400, [5.0])]
    got = run(spark, [r for r in rows if r[0] != 2])
    assert got == brute([r for r in rows if r[0] != 2])
    assert (250, 1, 251, 0) in got and not [g for g in got if g[0] == 400]
    limits = {g[3] for g in run(spark, rows) if g[2] == 2}
    assert (1 << 63) - 1 in limits                                         # beyond a long: its limit
    assert run(spark, []) == []


def test_bound_saves_work():
    """Candidates of steeply falling size: the bound ends the search early, with the same result."""
    rng = np.random.default_rng(5)
    v = np.rint(rng.pareto(0.7, size=(6000, 3)) * 100).astype(np.int64)
    q = np.abs(rng.integers(1, 50, size=(20, 3)))
    best = threshold.Best(20, 5)
    scored = threshold.search(q, np.full(20, -1), np.arange(20), v, np.arange(6000), best)
    assert scored < 20 * 6000 / 5
    full = q @ v.T
    for i in range(20):
        want = sorted(zip(-full[i], range(6000), strict=True))[:5]
        assert list(zip(-best.score[i], best.id[i], strict=True)) == want


@pytest.mark.parametrize("size", [10, 1 << 28, 1 << 40])
def test_exact_at_every_size(size):
    rng = np.random.default_rng(size)
    v, q = rng.integers(-size, size, (300, 8)), rng.integers(-size, size, (10, 8))
    best = threshold.Best(10, 5)
    threshold.search(q, np.full(10, -1), np.arange(10), v, np.arange(300), best)
    for i in range(10):
        want = sorted((-sum(int(a) * int(b) for a, b in zip(q[i], x, strict=True)), j) for j, x in enumerate(v))[:5]
        assert [(-s, j) for s, j in zip(best.score[i], best.id[i], strict=True)] == want
