"""Embedding near-dedup: int8 tile products with rigorous error bounds, exact recomputation.

Vectors are compared only inside a label. Equal vectors collapse to one class first (hot groups
of copies never meet themselves), then the classes of a label are dealt to tiles of about
``tile`` vectors by hash, and every pair of tiles is one task. A unit vector x is held as
s * q with q in int8; its error norm e = |x - s q| is computed, and

    |x.y - sx sy (qx.qy)| <= ex |sy qy| + ey |sx qx| + ex ey

so a pair below the threshold by more than that can't be a link. Only the others are computed in
double precision from the full vectors. A task returns, per class, the number of
linked vectors and one edge to the smallest id of its local group: its output grows with the
tile, not with the number of pairs. Components are then joined across tiles.

The comparison of a label is quadratic in its different vectors by contract; every task is
bounded by two tiles, and a hot label is split into many of them.

Defined results: vectors that are null, empty, zero or hold null, NaN or infinite components, and
rows with a null label or id, link with nothing (0 links, their own component, kept); vectors of
different length don't link; rows that share an id are one node of the components, yet each
row counts as a vector for its partners. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.components import components
from tablescope.session import materialize

THRESHOLD = 0.98
TILE = 4096
BLOCK = 1024                 # rows of one product
EXACT_PAIRS = 65_536         # pairs recomputed at once
DIMS_EXACT = 1024            # int8 products of so many terms are exact in float32


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(q as float32 holding int8 values, scale, error norm, norm of scale * q) of unit rows."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None])
    held = q * scale[:, None]
    return (q.astype(np.int8).astype(np.float32), scale, np.linalg.norm(x - held, axis=1) * (1 + 1e-9) + 1e-12,
            np.linalg.norm(held, axis=1) * (1 + 1e-9))


def similar_pairs(x: np.ndarray, y: np.ndarray, threshold: float, same: bool):
    """Yield (rows of x, rows of y) with cosine >= threshold; x, y are float64. With ``same`` each
    unordered pair once and no row with itself."""
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    qx, sx, ex, hx = quantise(x / nx[:, None])
    qy, sy, ey, hy = quantise(y / ny[:, None])
    for i in range(0, len(x), BLOCK):
        for j in range(i if same else 0, len(y), BLOCK):
            a, b = slice(i, i + BLOCK), slice(j, j + BLOCK)
            dot = np.zeros((len(qx[a]), len(qy[b])))
            for d in range(0, x.shape[1], DIMS_EXACT):
                dot += qx[a, d:d + DIMS_EXACT] @ qy[b, d:d + DIMS_EXACT].T
            bound = (dot * sx[a, None] * sy[None, b] + ex[a, None] * hy[None, b] + hx[a, None] * ey[None, b]
                     + ex[a, None] * ey[None, b] + 1e-9)
            r, c = np.nonzero(bound >= threshold)
            r, c = r + i, c + j
            if same:
                r, c = r[r < c], c[r < c]
            for k in range(0, len(r), EXACT_PAIRS):
                u, v = r[k:k + EXACT_PAIRS], c[k:k + EXACT_PAIRS]
                cos = np.einsum("ij,ij->i", x[u], y[v]) / (nx[u] * ny[v])
                ok = cos >= threshold
                yield u[ok], v[ok]


def _local_groups(n: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id of each row's group under the links (a, b)."""
    low = ids.copy()
    while True:
        before = low.copy()
        m = np.minimum(low[a], low[b])
        np.minimum.at(low, a, m)
        np.minimum.at(low, b, m)
        if (low == before).all():
            return low


def _tile_pair(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("tile", "ascending"), ("h1", "ascending")]).combine_chunks()
        ids, count, tile = (np.asarray(table[c]) for c in ("node", "n", "tile"))
        x = np.asarray(table["embedding"].combine_chunks().flatten(), dtype=np.float64).reshape(len(ids), -1)
        cut = int(np.searchsorted(tile, tile[0], side="right"))
        same = cut == len(ids) and table["t1"][0] == table["t2"][0]
        if cut == len(ids) and not same:              # the other tile of the pair is empty
            return _none()
        links = np.zeros(len(ids), dtype=np.int64)
        found = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))]
        for u, v in similar_pairs(x[:cut], x[:cut] if same else x[cut:], threshold, same):
            v = v if same else v + cut
            np.add.at(links, u, count[v])
            np.add.at(links, v, count[u])
            found.append((u, v))
        a, b = (np.concatenate(c) for c in zip(*found, strict=True))
        low = _local_groups(len(ids), a, b, ids)
        some = np.flatnonzero(links)
        return pa.table({"label": table["label"].take(some), "h1": table["h1"].take(some), "h2": table["h2"].take(some),
                         "node": pa.array(ids[some]), "links": pa.array(links[some]), "low": pa.array(low[some])})
    return run


_OUT = "label int, h1 long, h2 long, node long, links long, low long"


def _none() -> pa.Table:
    return pa.table({"label": pa.array([], pa.int32()), **{c: pa.array([], pa.int64()) for c in ("h1", "h2", "node", "links", "low")}})


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
                    threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    e = F.col("embedding")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = (F.col("node").isNotNull() & F.col("label").isNotNull() & e.isNotNull()
              & F.coalesce(finite & F.exists(e, lambda v: v != 0), F.lit(False)))
    src = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("node"), F.col(f"`{label}`").cast("int").alias("label"),
                         F.col(f"`{embedding}`").cast("array<float>").alias("embedding"))
    src = src.withColumn("usable", usable).withColumns({
        "h1": F.xxhash64(e), "h2": F.xxhash64(F.lit("second"), e, F.size(e))})
    key = ["label", "h1", "h2"]
    classes = materialize(src.filter("usable").groupBy(*key).agg(F.min("node").alias("node"), F.count("*").alias("n"),
                                                                 F.first("embedding").alias("embedding"))
                          .withColumn("dims", F.size("embedding")), "vector-classes")
    tiles = classes.groupBy("label", "dims").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    placed = classes.join(tiles, ["label", "dims"]).withColumn("tile", F.pmod("h1", "tiles").cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select(*key, "dims", "node", "n", "embedding", "tile", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"))
    found = materialize(dealt.groupBy("label", "dims", "t1", "t2").applyInArrow(_tile_pair(threshold), _OUT), "vector-links")

    group = components(found.filter("low < node").select(F.col("node").alias("a"), F.col("low").alias("b")))
    partners = found.groupBy(*key).agg(F.sum("links").alias("links"))
    of_class = (classes.select(*key, "node", "n").join(partners, key, "left").join(group.withColumnRenamed("id", "node"), "node", "left")
                .select(*key, (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                        F.coalesce("component", "node").alias("component_id")))
    good = src.filter("usable").select("node", *key).join(of_class, key)
    rest = src.filter(~F.col("usable")).select(F.col("node").alias("vec_id"), F.lit(0).cast("long").alias("n_links"),
                                              F.col("node").alias("component_id"), F.lit(True).alias("kept"))
    return good.select(F.col("node").alias("vec_id"), "n_links", "component_id",
                       (F.col("node") == F.col("component_id")).alias("kept")).unionByName(rest)
