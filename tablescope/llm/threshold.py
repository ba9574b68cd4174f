"""Exact top-k inner products by Fagin's threshold algorithm.

Every batch of candidate vectors is indexed by one sorted list per dimension. A query reads a list from its
top where its own component is positive and from its bottom where it is negative, all lists in step; a
vector met in any list is scored in full. After a depth, no vector that was not met can score more than

    sum over dimensions of (query component * value at that depth of its list)

so a query stops as soon as its kth score is above that bound (equal is not enough: an unmet vector might
tie with a smaller id). Scores are integers and exact.

On Spark: the queries are taken in blocks of at most ``BLOCK_BYTES`` bytes, which is what is broadcast; the
candidates stay where they are and every task runs the algorithm on its own lists for all queries of the block,
which advance together. The best scores found so far go from batch to batch of a task, so later batches
stop earlier. A task returns k rows a query, the final choice is a ranked group limit. With evenly spread vectors
of many dimensions the bound stays above the kth score for long; the whole result is the same, only the saving shrinks.

Defined results: rows without id or vector, and vectors with null, NaN or infinite components, take no
part; vectors of different length have no score; a candidate with the query's id is its own
row and left out; query rows equal in id and vector are one, repeated candidates count each; components and scores
beyond the range of a long count as its limits; fewer than k candidates give fewer rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescope.session import materialize

K = 5
SCALE = 256
BLOCK_BYTES = 8_000_000      # query components broadcast at once
FIRST_DEPTH = 64             # entries read from each list before the first bound
CELLS = 2_000_000            # scores held at once
_LONG = np.iinfo(np.int64)


def integer_vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id long, vector array<long>) of the rows that take part: floor(scale * x), x as double."""
    v = F.col(f"`{embedding}`").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ints = F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    return (rows.filter(F.col(f"`{vec_id}`").isNotNull() & v.isNotNull() & fine)
            .select(F.col(f"`{vec_id}`").cast("long").alias("id"), ints.alias("vector")))


def _exact_type(q: np.ndarray, v: np.ndarray):
    """The cheapest type in which every sum of products is exact."""
    def most(x):
        return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
    bound = most(q) * most(v) * max(1, q.shape[1])
    return np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object


class Best:
    """The k best (score, id) of each query so far; scores in the exact type of the last batch."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.empty((n, k), dtype=object)
        self.id = np.zeros((n, k), dtype=np.int64)
        self.held = np.zeros(n, dtype=np.int64)

    def kth(self, rows: np.ndarray, kind) -> tuple[np.ndarray, np.ndarray]:
        """(has k scores, kth score) of the given queries."""
        full = self.held[rows] == self.k
        return full, np.where(full, self.score[rows, self.k - 1], 0).astype(kind)

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, mine: np.ndarray, kind) -> None:
        """Candidates ``ids`` with ``score`` (rows, ids); ``mine`` are the ids of the queries themselves."""
        full, low = self.kth(rows, kind)
        other = ids[None, :] != mine[:, None]
        keep = other & (~full[:, None] | (score >= low[:, None]))
        if score.shape[1] > self.k + 1 and kind is not object:
            # a score that k others of this batch beat can't stay
            at = np.partition(np.where(other, score, score.min() - 1), score.shape[1] - self.k, axis=1)[:, score.shape[1] - self.k]
            keep &= score >= at[:, None]
        r, c = np.nonzero(keep)
        if not len(r):
            return
        seen = np.flatnonzero(keep.any(axis=1))
        old = [(q, j) for q in seen for j in range(self.held[rows[q]])]
        who = np.concatenate((r, np.array([q for q, _ in old], dtype=np.int64)))
        val = np.concatenate((score[r, c], np.array([self.score[rows[q], j] for q, j in old], dtype=kind)))
        idv = np.concatenate((ids[c], np.array([self.id[rows[q], j] for q, j in old], dtype=np.int64)))
        order = np.lexsort((idv, -val)) if kind is not object else np.array(
            sorted(range(len(val)), key=lambda i: (-val[i], idv[i])), dtype=np.int64)
        order = order[np.argsort(who[order], kind="stable")]
        first = np.searchsorted(who[order], seen)
        rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        order, rank = order[rank < self.k], rank[rank < self.k]
        q = rows[who[order]]
        self.score[q, rank] = [int(x) for x in val[order]]
        self.id[q, rank] = idv[order]
        self.held[rows[seen]] = np.minimum(self.k, np.bincount(who[order], minlength=len(rows))[seen])


def search(q: np.ndarray, mine: np.ndarray, rows: np.ndarray, v: np.ndarray, ids: np.ndarray, best: Best) -> int:
    """Threshold algorithm of queries q (n, d) over candidates v (m, d); ``rows`` are the queries' places in
    ``best``. Returns how many (query, candidate) pairs were scored."""
    kind = _exact_type(q, v)
    qs, vs = q.astype(kind), v.astype(kind)
    lists = np.argsort(v, axis=0, kind="stable")
    live = np.arange(len(q))
    met = np.zeros(len(v), dtype=bool)
    depth, done, scored = FIRST_DEPTH, 0, 0
    while len(live):
        depth = min(depth, len(v))
        new = np.zeros(len(v), dtype=bool)
        if v.shape[1]:
            new[lists[done:depth].ravel()] = True
            new[lists[len(v) - depth:len(v) - done].ravel()] = True
        else:
            new[:] = True
        new = np.flatnonzero(new & ~met)
        met[new] = True
        step = max(1, CELLS // max(1, len(new)))
        for i in range(0, len(live) if len(new) else 0, step):
            some = live[i:i + step]
            best.add(rows[some], qs[some] @ vs[new].T, ids[new], mine[some], kind)
            scored += len(some) * len(new)
        if met.all():
            break
        cols = np.arange(v.shape[1])
        high, low = vs[lists[len(v) - depth], cols], vs[lists[depth - 1], cols]
        bound = np.maximum(qs[live] * high, qs[live] * low).sum(axis=1)
        full, kth = best.kth(rows[live], kind)
        live = live[~(full & (kth > bound))]
        done, depth = depth, depth * 2
    return scored


def _by_length(column) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length -> (rows, matrix) of an Arrow list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten())
    at = np.concatenate(([0], np.cumsum(size)))
    out = {}
    for d in np.unique(size).tolist():
        rows = np.flatnonzero(size == d)
        out[d] = rows, flat[at[rows][:, None] + np.arange(d)] if d else np.zeros((len(rows), 0), dtype=np.int64)
    return out


def _search(block, k: int):
    def run(batches):
        query_id, groups = block.value
        best = Best(len(query_id), k)
        for b in batches:
            ids = np.asarray(b.column("id"))
            for d, (at, v) in _by_length(b.column("vector")).items():
                if d in groups:
                    rows, q = groups[d]
                    search(q, query_id[rows], rows, v, ids[at], best)
        who = np.repeat(np.arange(len(query_id)), best.held)
        slot = np.arange(len(who)) - np.repeat(np.cumsum(best.held) - best.held, best.held)
        score = [min(max(x, _LONG.min), _LONG.max) for x in best.score[who, slot]]
        yield pa.record_batch({"q": pa.array(who), "query_id": pa.array(query_id[who]), "id": pa.array(best.id[who, slot]),
                               "score": pa.array(score, pa.int64())})
    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k candidates of highest inner product of every query, ties to the smaller id. Both tables: id long,
    vector array<long>. Returns query_id, rank (from 1), id, score."""
    spark = candidates.sparkSession
    queries = materialize(queries.select("id", "vector").distinct(), "topk-queries")
    total, widest = queries.agg(F.sum(8 * F.size("vector") + 16), F.max(F.size("vector"))).first()
    out = spark.createDataFrame([], "query_id long, rank int, id long, score long")
    blocks = -(-(total or 0) // block_bytes)
    for i in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)) == i).toArrow()
        if not own.num_rows:
            continue
        block = spark.sparkContext.broadcast((np.asarray(own["id"]), _by_length(own["vector"])))
        found = candidates.select("id", "vector").mapInArrow(_search(block, k), "q long, query_id long, id long, score long")
        order = Window.partitionBy("q").orderBy(F.col("score").desc(), "id")
        ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        out = out.union(materialize(ranked.select("query_id", "rank", "id", "score"), "topk-block"))
        block.destroy()
    return out
