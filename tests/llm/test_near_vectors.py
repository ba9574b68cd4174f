from collections import defaultdict

import numpy as np
import pytest

from tablescope.llm import near_vectors
from tablescope.llm.queries import QUERIES


def brute(rows, threshold=0.98):
    """rows: (id, vector, label), ids not repeated."""
    ok = {}
    for i, v, lab in rows:
        if i is None or lab is None or v is None or any(x is None for x in v):
            continue
        a = np.array(v, dtype=np.float64)
        if np.isfinite(a).all() and a.any():
            ok[i] = (a, lab)
    root = {r[0]: r[0] for r in rows}
    links = defaultdict(int)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(ok)
    for p, i in enumerate(ids):
        for j in ids[p + 1:]:
            (a, la), (b, lb) = ok[i], ok[j]
            if la == lb and len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {r[0]: (links[r[0]], find(r[0])) for r in rows}


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = QUERIES["op2_embedding_near_dedup"](spark, sf).collect()
    want = brute(rows)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want and len(got) == len(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("tile", [7, 4096])
def test_edges_and_tiles(spark, tile):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(6, 16))
    rows = []
    for i in range(120):
        v = base[i % 6] + rng.normal(size=16) * 0.12
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 3 == 0)))
    rows += [(200, rows[0][1], 1), (201, rows[0][1], 1), (202, rows[0][1], None), (203, None, 1), (204, [0.0] * 16, 1),
             (205, [float("nan")] * 16, 1), (206, [None] * 16, 1), (207, [float("inf")] * 16, 1), (208, [], 1),
             (209, [1.0, 2.0], 1), (210, [1.0, 2.0], 1), (211, [2.0, 4.0], 1), (212, rows[0][1], 0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, node string, h1 int")
    got = near_vectors.near_duplicates(df, tile=tile).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == brute(rows)
    assert near_vectors.near_duplicates(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, [1.0], 1), (1, [1.0], 1), (1, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(map(repr, near_vectors.near_duplicates(odd).collect())) == sorted(map(repr, [
        *spark.createDataFrame([(None, 0, None, True), (1, 1, 1, True), (1, 1, 1, True)],
                               "vec_id long, n_links long, component_id long, kept boolean").collect()]))


def test_bound_holds():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 24))
    x[150:] = x[:150] + rng.normal(size=(150, 24)) * 0.2
    got = set()
    for u, v in near_vectors.similar_pairs(x, x, 0.98, same=True):
        got |= set(zip(u.tolist(), v.tolist(), strict=True))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = {(i, j) for i, j in zip(*np.nonzero(unit @ unit.T >= 0.98), strict=True) if i < j}
    assert got == want and want
