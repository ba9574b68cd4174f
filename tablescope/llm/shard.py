"""Sharding by histogram sort: exact byte histograms, refined splitters, one exchange.

Rows are ordered by (hash of the group key, hash of the whole row), so rows with an equal key
lie together. The splitters between shards are found without moving rows: every round counts
the exact bytes and rows between candidate boundaries (per task, then summed per bin) and
places new candidates inside the bin that holds the target, until the bytes below a
candidate are within ``tolerance`` of the target. A group stays whole when a boundary beside
it meets the tolerance; a larger group (a third of all rows, say) is split by the second
hash. Then the rows go once to their range, are ordered there, and get their slot from the exact
row count below the range. Each shard is cut into ``pieces`` ranges with looser tolerance, so
one shard is the work of several tasks.

The driver sees at most ``shards * pieces * probes`` bins a round, whatever the table.

Defined results: null sizes count 0; null keys are one group; rows that are equal in every
column can't be told apart and stay on one side of a boundary; with fewer rows than shards
some shards are empty; an empty table gives no rows. All input columns are kept inside
``row``, so their names can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescope.session import materialize

SHARDS = 16
PIECES = 8
PROBES = 32
TOLERANCE = 0.001            # of a shard's bytes, for the boundaries between shards
PIECE_TOLERANCE = 0.25       # of a range's bytes, for the boundaries inside a shard
LOW = (-(1 << 63), -(1 << 63))
HIGH = ((1 << 63) - 1, (1 << 63) - 1)

_BINS = "bin int, bytes long, n long, lo struct<k1:long,k2:long>, hi struct<k1:long,k2:long>"


def locate(k1: np.ndarray, k2: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of the ascending (k1, k2) bounds are at or below each row."""
    if not len(bounds):
        return np.zeros(len(k1), dtype=np.int64)
    b1, b2 = bounds[:, 0], bounds[:, 1]
    out = np.searchsorted(b1, k1, side="left")
    tie = np.flatnonzero(b1[np.minimum(out, len(b1) - 1)] == k1)
    if len(tie):
        keys, group = np.unique(k1[tie], return_inverse=True)
        for g, key in enumerate(keys.tolist()):      # keys that are bounds themselves: few
            lo, hi = np.searchsorted(b1, key, side="left"), np.searchsorted(b1, key, side="right")
            rows = tie[group == g]
            out[rows] = lo + np.searchsorted(b2[lo:hi], k2[rows], side="right")
    return out


def _histogram(bounds):
    def run(batches):
        at = bounds.value
        for b in batches:
            if not b.num_rows:
                continue
            k1, k2 = (np.asarray(b.column(c)) for c in ("k1", "k2"))
            size = np.asarray(b.column("size"))
            which = locate(k1, k2, at)
            order = np.lexsort((k2, k1, which))
            which, k1, k2, size = which[order], k1[order], k2[order], size[order]
            first = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1])))
            last = np.concatenate((first[1:], [len(which)])) - 1

            def pair(i, k1=k1, k2=k2):
                return pa.StructArray.from_arrays([pa.array(k1[i]), pa.array(k2[i])], ["k1", "k2"])
            yield pa.record_batch({
                "bin": pa.array(which[first].astype(np.int32)), "bytes": pa.array(np.add.reduceat(size, first)),
                "n": pa.array(last - first + 1), "lo": pair(first), "hi": pair(last)})
    return run


def after(cut: tuple[int, int]) -> tuple[int, int]:
    """The next (k1, k2); the very last one has no next and stands for itself."""
    if cut[1] < HIGH[1]:
        return cut[0], cut[1] + 1
    return (cut[0] + 1, LOW[1]) if cut[0] < HIGH[0] else cut


@dataclass
class Splitter:
    """A boundary being refined: rows from ``lo`` to ``hi`` (both inclusive) may hold it."""

    target: float
    slack: float
    lo: tuple[int, int] = LOW
    hi: tuple[int, int] = HIGH
    cut: tuple[int, int] | None = None       # rows at or above it lie to the right
    below: tuple[int, int] = (0, 0)          # exact bytes and rows below the cut

    def probes(self, n: int) -> list[tuple[int, int]]:
        """Candidate cuts: the start of the range, ``n`` steps through it, and just after its end."""
        (a1, a2), (b1, b2) = self.lo, self.hi
        if a1 < b1:
            steps = [(a1 + (b1 - a1) * i // n, LOW[1]) for i in range(n + 1)]
            return steps + [after((b1, HIGH[1]))]
        return [(a1, LOW[1]), *((a1, a2 + (b2 - a2) * i // n) for i in range(n + 1)), after(self.hi)]


def find_splitters(keys: DataFrame, shards: int, pieces: int, tolerance: float, probes: int = PROBES) -> list[Splitter]:
    """The shards * pieces - 1 inner splitters of (k1, k2, size) rows."""
    sc = keys.sparkSession.sparkContext
    total = keys.agg(F.sum("size").alias("b"), F.count("*").alias("n")).first()
    if not total.n:
        return []
    parts = shards * pieces
    share = (total.b or 0) / parts
    every = [Splitter(share * i, tolerance * share * pieces if i % pieces == 0 else PIECE_TOLERANCE * share)
             for i in range(1, parts)]
    pending = every
    while pending:
        cuts = sorted({p for s in pending for p in s.probes(probes)})
        where = {c: i for i, c in enumerate(cuts)}
        shared = sc.broadcast(np.array(cuts, dtype=np.int64).reshape(-1, 2))
        found = (keys.mapInArrow(_histogram(shared), _BINS).groupBy("bin")
                 .agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
                 .collect())                 # at most one row per candidate
        shared.unpersist()
        by_bin = {r.bin: r for r in found}
        below = [(0, 0)]
        for i in range(len(cuts) + 1):
            r = by_bin.get(i)
            below.append((below[-1][0] + (r["bytes"] if r else 0), below[-1][1] + (r["n"] if r else 0)))
        # below[i + 1] is what lies under cut i; bin i + 1 holds the rows from cut i to the next.
        still = []
        for s in pending:
            mine = sorted(where[c] for c in s.probes(probes))
            best = min(mine, key=lambda i: abs(below[i + 1][0] - s.target))
            if s.cut is None or abs(below[best + 1][0] - s.target) < abs(s.below[0] - s.target):
                s.cut, s.below = cuts[best], below[best + 1]
            if abs(s.below[0] - s.target) <= s.slack:
                continue
            under = max((i for i in mine if below[i + 1][0] <= s.target), default=None)
            # The bin that holds the target may be cut by other splitters' candidates too.
            i = 0 if under is None else under + 1
            while i <= len(cuts) and below[i + 1][0] <= s.target:
                i += 1
            r = by_bin.get(i)
            if r is None:
                continue                     # the target is past the last row
            lo, hi = tuple(r.lo), tuple(r.hi)
            if lo == hi:                     # one row, or rows that can't be told apart
                for cut, have in ((lo, below[i]), (after(hi), below[i + 1])):
                    if abs(have[0] - s.target) < abs(s.below[0] - s.target):
                        s.cut, s.below = cut, have
                continue
            s.lo, s.hi = lo, hi
            still.append(s)
        pending = still
    for a, b in zip(every, every[1:], strict=False):     # loose inner cuts never pass a later one
        if b.cut < a.cut:
            b.cut, b.below = a.cut, a.below
    return every


def _assign(bounds):
    def run(batches):
        for b in batches:
            part = locate(np.asarray(b.column("k1")), np.asarray(b.column("k2")), bounds.value)
            yield pa.record_batch({**{c: b.column(c) for c in ("row", "k1", "k2")}, "part": pa.array(part.astype(np.int32))})
    return run


def shard(docs: DataFrame, size: str, key: str, shards: int = SHARDS, pieces: int = PIECES,
          tolerance: float = TOLERANCE) -> DataFrame:
    """row struct<all columns of docs>, shard int, slot long (gapless from 0, in key order)."""
    spark = docs.sparkSession
    cols = [F.col(f"`{c}`") for c in docs.columns]
    k1 = F.xxhash64(F.col(f"`{key}`"))
    k2 = F.xxhash64(*cols)
    keys = materialize(docs.select(k1.alias("k1"), k2.alias("k2"), F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0)).alias("size")), "shard-keys")
    splitters = find_splitters(keys, shards, pieces, tolerance)
    bounds = spark.sparkContext.broadcast(np.array([s.cut for s in splitters], dtype=np.int64).reshape(-1, 2))
    below = [0, *(s.below[1] for s in splitters)] if splitters else [0]
    start = F.array(*[F.lit(below[i] - below[i // pieces * pieces]).cast("long") for i in range(len(below))])

    src = docs.select(F.struct(*cols).alias("row"), k1.alias("k1"), k2.alias("k2"))
    placed = src.mapInArrow(_assign(bounds), f"row {src.schema['row'].dataType.simpleString()}, k1 long, k2 long, part int")
    rank = F.row_number().over(Window.partitionBy("part").orderBy("k1", "k2"))
    return placed.select("row", F.expr(f"cast(part div {pieces} as int)").alias("shard"),
                         (rank - 1 + F.get(start, F.col("part"))).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows inside each file in slot order."""
    sharded.select("row.*", "shard", "slot").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
