"""Merkle dataset manifest with SHA-256 midstates kept at every child slot.

A node's digest is SHA-256 over the hex digests of its children. A hex digest is 64 bytes, exactly
one SHA-256 block, so the hash state after j children is eight 32-bit words, and a parent can retain a
copy of it before each child slot. When one child changes, folding resumes the state of its slot and
absorbs the replacement and the siblings to its right only; what lies to the left is never hashed again.

Leaves of a group (``lang``) ascend by ``order``; runs of 8 consecutive nodes become their parent until
one node, the subroot, remains. The subroots, ordered by group, form one more such tree, whose last node is
the root. On Spark:

1. leaf digests are built-in SQL functions; texts are never shuffled;
2. exact positions come from one range exchange (``ranks.ranked``), so a hot group is many tasks;
3. four levels (at most 4,096 nodes) are one block, built in one task as numpy vectors; a block is one row
   that holds the digests of its levels and the states before every slot. Blocks of blocks follow, so
   10^12 leaves are four exchanges;
4. from the root down every block row gets the path of its own root (siblings, states, slots), and each
   leaf is folded along its block and that path.

Defined results: a null field hashes as ``-``, an empty one as ``0:``; a null group is a group of its own, before
all others; a null id comes first in its group and is never tampered with; repeated rows are leaves of their
own and get equal digests; one leaf alone is its subroot, one subroot alone the root, and a level without siblings adds nothing
to a proof; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.llm.ranks import ranked
from tablescope.session import materialize

FAN = 8
LEVELS = 4                   # levels of a block
BLOCK = FAN ** LEVELS        # nodes of a block
HEX = 64
STEP = 34                    # bytes of one step of a path: state, slot, children

_U = np.uint32


def _primes(n: int) -> list[int]:
    out: list[int] = []
    x = 2
    while len(out) < n:
        if all(x % p for p in out):
            out.append(x)
        x += 1
    return out


def _cube_root(x: int) -> int:
    r = round(x ** (1 / 3))
    while r ** 3 > x:
        r -= 1
    while (r + 1) ** 3 <= x:
        r += 1
    return r


def _fraction_of_cube_root(p: int) -> int:
    lo = _cube_root(p) << 32
    hi = lo + (1 << 32)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if mid ** 3 <= p << 96 else (lo, mid)
    return lo & 0xFFFFFFFF


# SHA-256: the first 32 bits of the fractions of the square roots of the first 8 primes and of the cube
# roots of the first 64.
START = np.array([math.isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], dtype=_U)
ROUND = np.array([_fraction_of_cube_root(p) for p in _primes(64)], dtype=_U)
_DIGITS = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> _U(n)) | (x << _U(32 - n))


def absorb(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """States (8, n) after one more 64-byte block each, given as (16, n) words."""
    w = np.empty((64, block.shape[1]), dtype=_U)
    w[:16] = block
    for t in range(16, 64):
        x, y = w[t - 15], w[t - 2]
        w[t] = (w[t - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> _U(3))) + w[t - 7]
                + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> _U(10))))
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + ((e & f) ^ (~e & g)) + ROUND[t] + w[t]
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) ^ (a & c) ^ (b & c))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack((a, b, c, d, e, f, g, h))


def words(hexes: np.ndarray) -> np.ndarray:
    """(n, 64) hex bytes as (16, n) words."""
    return np.ascontiguousarray(np.ascontiguousarray(hexes).view(">u4").astype(_U).T)


def finish(state: np.ndarray, children: np.ndarray) -> np.ndarray:
    """(n, 64) hex digests of states that have absorbed ``children`` blocks each."""
    last = np.zeros((16, state.shape[1]), dtype=_U)
    last[0] = _U(0x80000000)
    last[14] = (children.astype(np.uint64) * np.uint64(512) >> np.uint64(32)).astype(_U)
    last[15] = (children.astype(np.uint64) * np.uint64(512)).astype(_U)
    raw = np.ascontiguousarray(absorb(state, last).T).astype(">u4").view(np.uint8)
    return np.stack((_DIGITS[raw >> 4], _DIGITS[raw & 15]), axis=2).reshape(len(raw), HEX)


def parents(level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """((m, 64) digests of the runs of 8, (m, 8, 8) states before each slot) of one level."""
    m = -(-len(level) // FAN)
    size = np.minimum(FAN, len(level) - FAN * np.arange(m))
    state = np.repeat(START[:, None], m, axis=1)
    before = np.zeros((m, FAN, 8), dtype=_U)
    for j in range(FAN):
        there = np.flatnonzero(size > j)
        if not len(there):
            break
        before[there, j] = state[:, there].T
        state[:, there] = absorb(state[:, there], words(level[FAN * there + j]))
    return finish(state, size), before


def resume(state: np.ndarray, slot: np.ndarray, size: np.ndarray, own: np.ndarray, child) -> np.ndarray:
    """Digests of parents whose child at ``slot`` is ``own``: from the states before the slot on, over the
    replacement and the siblings to the right. ``child(rows, j)``: hex digests at slot j of their parents."""
    state = state.copy()
    for j in range(int(slot.min()), FAN):
        rows = np.flatnonzero((slot <= j) & (j < size))
        if len(rows):
            block = np.where((slot[rows] == j)[:, None], own[rows], child(rows, j))
            state[:, rows] = absorb(state[:, rows], words(block))
    return finish(state, size)


@dataclass
class Block:
    """The levels of one block row: digests per level (the last has one), states per level of parents."""

    levels: list[np.ndarray]
    states: list[np.ndarray]

    @staticmethod
    def read(n: int, digests: bytes, states: bytes) -> Block:
        d = np.frombuffer(digests, dtype=np.uint8).reshape(-1, HEX)
        s = np.frombuffer(states, dtype="<u4").reshape(-1, FAN, 8)
        levels, kept, at, st = [d[:n]], [], n, 0
        while at < len(d):
            n = -(-n // FAN)
            levels.append(d[at:at + n])
            kept.append(s[st:st + n])
            at, st = at + n, st + n
        return Block(levels, kept)

    def paths(self, proof: bytes, steps: bytes) -> list[tuple[bytes, bytes]]:
        """(proof, steps) of every node of the lowest level, given those of the block's root."""
        above = [(proof, steps)]
        for level, states in zip(self.levels[-2::-1], self.states[::-1], strict=True):
            raw, out = level.tobytes(), []
            for i in range(len(level)):
                up, slot = divmod(i, FAN)
                lo, hi = FAN * up, min(FAN * (up + 1), len(level))
                step = states[up, slot].astype("<u4").tobytes() + bytes((slot, hi - lo))
                out.append((raw[lo * HEX:i * HEX] + raw[(i + 1) * HEX:hi * HEX] + above[up][0], step + above[up][1]))
            above = out
        return above


def fold_leaves(blocks: list[Block], own: np.ndarray, proofs: list[bytes], steps: list[bytes]) -> np.ndarray:
    """Root digests when each leaf of the blocks, on its own, is replaced by its row of ``own`` (n, 64)."""
    count = np.array([len(b.levels[0]) for b in blocks])
    block = np.repeat(np.arange(len(blocks)), count)
    at = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    own = own.copy()
    depth = np.array([len(b.states) for b in blocks])
    for j in range(depth.max()):
        deep = [b for b in blocks if len(b.states) > j]
        level, states = np.concatenate([b.levels[j] for b in deep]), np.concatenate([b.states[j] for b in deep])
        length = np.array([len(b.levels[j]) if len(b.states) > j else 0 for b in blocks])
        runs = -(-length // FAN)
        first, first_up = np.cumsum(length) - length, np.cumsum(runs) - runs
        some = np.flatnonzero(depth[block] > j)
        up, slot, mine = at[some] // FAN, at[some] % FAN, block[some]
        own[some] = resume(np.ascontiguousarray(states[first_up[mine] + up, slot].T), slot,
                           np.minimum(FAN, length[mine] - FAN * up), own[some],
                           lambda rows, k, lev=level, lo=first[mine] + FAN * up: lev[lo[rows] + k])
        at[some] = up
    sibling = np.frombuffer(b"".join(proofs), dtype=np.uint8).reshape(-1, HEX)
    next_ = np.cumsum([0] + [len(p) // HEX for p in proofs])[:-1]
    length = np.array([len(s) // STEP for s in steps])
    for j in range(length.max()):
        here = [s[j * STEP:(j + 1) * STEP].ljust(STEP, b"\0") for s in steps]
        raw = np.frombuffer(b"".join(here), dtype=np.uint8).reshape(-1, STEP)
        state = np.ascontiguousarray(raw[:, :STEP - 2]).view("<u4").astype(_U)
        slot, size = raw[:, STEP - 2].astype(np.int64), raw[:, STEP - 1].astype(np.int64)
        some = np.flatnonzero(length[block] > j)
        mine = block[some]
        own[some] = resume(np.ascontiguousarray(state[mine].T), slot[mine], size[mine], own[some],
                           lambda rows, k, m=mine, lo=next_, s=slot: sibling[np.where(k > s[m[rows]], lo[m[rows]] + k - 1, 0)]
                           if len(sibling) else np.zeros((len(rows), HEX), np.uint8))
        next_ = next_ + np.maximum(size - 1, 0)
    return own


def _build(payload: str):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        level = np.frombuffer("".join(table["digest"].to_pylist()).encode(), dtype=np.uint8).reshape(-1, HEX)
        n, levels, states = len(level), [level], []
        for _ in range(table["depth"][0].as_py()):
            up, before = parents(levels[-1])
            levels.append(up)
            states.append(before)
        held = table["payload"].combine_chunks()
        return pa.table({
            "tree": table["tree"].slice(0, 1), "block": table["block"].slice(0, 1), "n": table["n"].slice(0, 1),
            "size": pa.array([n], pa.int32()), "digest": pa.array([levels[-1][0].tobytes().decode()]),
            "digests": pa.array([b"".join(x.tobytes() for x in levels)], pa.binary()),
            "states": pa.array([b"".join(x.astype("<u4").tobytes() for x in states)], pa.binary()),
            "payload": pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), held)})
    return run, f"tree string, block long, n long, size int, digest string, digests binary, states binary, payload array<{payload}>"


def tiers(nodes: DataFrame, name: str) -> list[DataFrame]:
    """Block tables from the leaves up to one block per tree. ``nodes``: tree, pos, n, digest, payload."""
    levels = F.expr("size(filter(transform(sequence(0, 20), x -> shiftleft(1L, 3 * x)), y -> y < n))")
    out: list[DataFrame] = []
    while True:
        t = len(out)
        own = nodes.withColumns({"block": F.expr(f"shiftright(pos, {3 * LEVELS})"),
                                 "depth": F.greatest(F.lit(0), F.least(F.lit(LEVELS), levels - LEVELS * t)).cast("int")})
        run, schema = _build(own.schema["payload"].dataType.simpleString())
        out.append(materialize(own.groupBy("tree", "block").applyInArrow(run, schema), f"{name}-{t}"))
        if (out[-1].agg(F.max("block")).first()[0] or 0) == 0:
            return out
        nodes = out[-1].select("tree", F.col("block").alias("pos"), "n", "digest", F.lit(None).cast("string").alias("payload"))


def _node_paths(batches):
    """Path of every lowest node of the given blocks."""
    for b in batches:
        for r in b.to_pylist():
            found = Block.read(r["size"], r["digests"], r["states"]).paths(r["proof"], r["steps"])
            n = len(found)
            yield pa.record_batch({
                "tree": pa.array([r["tree"]] * n, pa.string()), "pos": pa.array(r["block"] * BLOCK + np.arange(n)),
                "name": pa.array(r["payload"], pa.string()), "proof": pa.array([p for p, _ in found], pa.binary()),
                "steps": pa.array([s for _, s in found], pa.binary()), "root": pa.array([r["root"]] * n, pa.string())})


def _down(table: DataFrame) -> DataFrame:
    return table.select("tree", "block", "size", "digests", "states", "payload", "proof", "steps", "root").mapInArrow(
        _node_paths, "tree string, pos long, name string, proof binary, steps binary, root string")


def _some_leaves(rows: list[dict]) -> pa.RecordBatch:
    blocks = [Block.read(r["size"], r["digests"], r["states"]) for r in rows]
    leaf = [x.tobytes().decode() for b in blocks for x in b.levels[0]]
    held = [p for r in rows for p in r["payload"]]
    new = "".join(p["changed"] or d for p, d in zip(held, leaf, strict=True))
    folded = fold_leaves(blocks, np.frombuffer(new.encode(), dtype=np.uint8).reshape(-1, HEX),
                         [r["proof"] for r in rows], [r["steps"] for r in rows])
    return pa.record_batch({
        "id": pa.array([p["id"] for p in held], pa.int64()), "leaf": leaf,
        "subroot": [r["subroot"] for r in rows for _ in range(r["size"])], "root": [r["root"] for r in rows for _ in range(r["size"])],
        "proof": pa.array([p for r, b in zip(rows, blocks, strict=True) for p, _ in b.paths(r["proof"], r["steps"])], pa.binary()),
        "folded_root": [x.tobytes().decode() for x in folded]})


def _leaf_rows(batches):
    """Blocks are folded together, about two full ones at a time."""
    for b in batches:
        rows, held = [], 0
        for i in range(b.num_rows):
            rows += b.slice(i, 1).to_pylist()
            held += rows[-1]["size"]
            if held >= 2 * BLOCK:
                yield _some_leaves(rows)
                rows, held = [], 0
        if rows:
            yield _some_leaves(rows)


def leaf_digest(fields: list[Column]) -> Column:
    """H of the fields: ``-`` for null, else UTF-8 byte count, ``:``, value."""
    def part(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))
    return F.sha2(F.concat(*[part(c) for c in fields]), 256)


@dataclass
class Manifest:
    """``groups``: block tables of the group trees, lowest first; ``top``: those of the tree of subroots."""

    groups: list[DataFrame]
    top: list[DataFrame]


def build(leaves: DataFrame) -> Manifest:
    """Manifest of ``leaves``: id long, group string, leaf (hex digest), changed (hex digest or null)."""
    tree = F.coalesce(F.concat(F.lit("="), F.col("group")), F.lit(""))        # null first, then by bytes
    leaves = materialize(leaves.select(tree.alias("tree"), "id", "leaf", "changed"), "merkle-leaves")
    nodes = ranked(leaves, "tree", ["id", "leaf"], "merkle-order").select(
        "tree", "pos", "n", F.col("leaf").alias("digest"), F.struct("id", "changed").alias("payload"))
    groups = tiers(nodes, "merkle-group")
    roots = groups[-1].select(F.lit("").alias("all"), "tree", "digest")
    top = ranked(roots, "all", ["tree"], "merkle-roots").select(
        F.col("all").alias("tree"), "pos", "n", "digest", F.col("tree").alias("payload"))
    return Manifest(groups, tiers(top, "merkle-top"))


def fold(manifest: Manifest) -> DataFrame:
    """Per leaf: id, leaf, subroot, root, proof (sibling digests, lowest level first), folded_root (the
    root when the leaf alone is replaced by its ``changed`` digest, or by itself)."""
    none = F.lit(b"")
    at = _down(manifest.top[-1].withColumns({"proof": none, "steps": none, "root": F.col("digest")}))
    for tier in manifest.top[-2::-1]:
        at = _down(tier.join(at.drop("name").withColumnRenamed("pos", "block"), ["tree", "block"]))
    subroot = manifest.groups[-1].select("tree", F.col("digest").alias("subroot"))
    at = at.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "proof", "steps", "root")
    for tier in manifest.groups[:0:-1]:
        at = _down(tier.join(at.withColumnRenamed("pos", "block"), ["tree", "block"])).drop("name")
    lowest = manifest.groups[0].join(at.withColumnRenamed("pos", "block"), ["tree", "block"]).join(subroot, "tree")
    return (lowest.select("size", "digests", "states", "payload", "proof", "steps", "subroot", "root")
            .mapInArrow(_leaf_rows, "id long, leaf string, subroot string, root string, proof binary, folded_root string"))
