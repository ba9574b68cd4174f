"""Benchmark decontamination by a prefix-filtered set join with exact verification.

A window is ``window`` consecutive words of a benchmark item (the whole item when it is
shorter). Its set elements are its word shingles. Containment must be whole, so the prefix
that a matching document has to share is the one rarest shingle of the window, rarity being
the number of occurrences over all documents. Steps:

1. windows of all items, equal ones merged (Spark aggregate);
2. occurrences of every benchmark shingle over all documents: counted per task, summed by
   shingle; windows whose rarest shingle never occurs are out;
3. documents are probed with the prefix shingles; length and position bounds place the
   window in the document, word hashes and then the words themselves verify it.

Documents are never shuffled. The benchmark is the query set: it is taken in blocks of at
most ``BLOCK_WINDOWS`` windows, so what is broadcast has a proven bound however large the
benchmark is; more blocks mean more passes, never dropped windows.

Defined results: null text has no words; an item without words has no window; a null item
id marks words but is not listed; repeated items and documents count each; an empty
benchmark leaves every document clean.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.text import ALNUM_WORDS, ASCII_LOWER, iter_words, shingle_hash
from tablescope.session import materialize

WINDOW = 10
SHINGLE = 3
BLOCK_WINDOWS = 200_000      # about 40 MB broadcast

_WINDOW_SCHEMA = "item string, size int, words binary, shingles array<long>"


def _item_windows(window: int):
    def run(batches):
        for b in batches:
            for g in iter_words(b.column("text"), ALNUM_WORDS, ASCII_LOWER):
                out, bounds = [], g.bounds()
                for i in range(g.n_docs):
                    lo, hi = int(bounds[i]), int(bounds[i + 1])
                    if lo == hi:
                        continue
                    size = min(window, hi - lo)
                    k = min(SHINGLE, size)
                    sh = shingle_hash(g.hash, np.arange(lo, hi - k + 1), k).view(np.int64)
                    text = [g.data[g.start[j]:g.end[j]].tobytes() for j in range(lo, hi)]
                    item = b.column("item")[g.first + i].as_py()
                    out += [{"item": item, "size": size, "words": b" ".join(text[j:j + size]),
                             "shingles": sh[j:j + size - k + 1].tolist()} for j in range(hi - lo - size + 1)]
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema(
                    [("item", pa.string()), ("size", pa.int32()), ("words", pa.binary()),
                     ("shingles", pa.list_(pa.int64()))]))
    return run


def benchmark_windows(items: DataFrame, window: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """One row per different window: size, words, shingles and the ids of its items."""
    src = items.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.col(f"`{text}`").cast("string").alias("text"))
    return (src.mapInArrow(_item_windows(window), _WINDOW_SCHEMA)
            .groupBy("size", "words").agg(F.first("shingles").alias("shingles"), F.collect_set("item").alias("items")))


def _count_shingles(keys_by_k):
    """Occurrences of the benchmark shingles, one partial count per task and shingle."""
    def run(batches):
        keys = {k: v for k, v in keys_by_k.value.items() if len(v)}
        total = {k: np.zeros(len(v), dtype=np.int64) for k, v in keys.items()}
        for b in batches:
            for g in iter_words(b.column("text"), ALNUM_WORDS, ASCII_LOWER):
                for k, sorted_keys in keys.items():
                    at = np.searchsorted(sorted_keys, sh := g.shingles(k)[1])
                    hit = at[sorted_keys[np.minimum(at, len(sorted_keys) - 1)] == sh]
                    total[k] += np.bincount(hit, minlength=len(sorted_keys))
        for k, n in total.items():
            some = np.flatnonzero(n)
            yield pa.record_batch({"shingle": pa.array(keys[k][some].view(np.int64)), "n": pa.array(n[some])})
    return run


def _probe(block, carry: bool):
    def run(batches):
        probes = block.value
        for b in batches:
            out = {"n_words": [], "starts": [], "ends": [], "items": []}
            for g in iter_words(b.column("text"), ALNUM_WORDS, ASCII_LOWER):
                found = [([], [], set()) for _ in range(g.n_docs)]
                bounds = g.bounds()
                for k, (keys, rows) in probes.items():
                    at, sh = g.shingles(k)
                    pos = np.searchsorted(keys, sh)
                    hit = np.flatnonzero(keys[np.minimum(pos, len(keys) - 1)] == sh)
                    for p, key in zip(at[hit].tolist(), pos[hit].tolist(), strict=True):
                        d = int(g.doc[p])
                        for offset, size, words, items in rows[key]:
                            lo = p - offset
                            if lo < bounds[d] or lo + size > bounds[d + 1]:      # position, length
                                continue
                            have = b" ".join(g.data[g.start[j]:g.end[j]].tobytes() for j in range(lo, lo + size))
                            if have == words:
                                found[d][0].append(lo - int(bounds[d]))
                                found[d][1].append(lo + size - int(bounds[d]))
                                found[d][2].update(items)
                out["n_words"] += np.diff(bounds).tolist()
                out["starts"] += [f[0] for f in found]
                out["ends"] += [f[1] for f in found]
                out["items"] += [sorted(f[2]) for f in found]
            if carry:
                for name in ("starts", "ends", "items"):
                    out[name] = [x + y for x, y in zip(b.column(name).to_pylist(), out[name], strict=True)]
            types = {"n_words": pa.int64(), "starts": pa.list_(pa.int32()), "ends": pa.list_(pa.int32()),
                     "items": pa.list_(pa.string())}
            yield pa.record_batch({"row": b.column("row"), "text": b.column("text"),
                                   **{c: pa.array(v, t) for (c, v), t in zip(out.items(), types.values(), strict=True)}})
    return run


def _blocks(windows: DataFrame, block_windows: int):
    """Blocks of the window table, each read to the driver alone: at most about block_windows rows."""
    n = max(1, -(-windows.count() // block_windows))
    for i in range(n):
        yield windows.filter(F.pmod(F.xxhash64("words"), F.lit(n)) == i)


def mark(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id",
         item_text: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Per document: row struct<all columns of docs>, n_words, n_hit, items (sorted set of ids as text)."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    windows = materialize(benchmark_windows(items, window, item_id, item_text), "bench-windows")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    src = docs.select(row, F.col(f"`{text}`").cast("string").alias("text"))

    counts = None
    for part in _blocks(windows, block_windows):
        keys = (part.select(F.least(F.lit(SHINGLE), "size").alias("k"), F.explode("shingles").alias("s"))
                .distinct().toPandas())
        by_k = {int(k): np.sort(v["s"].to_numpy(dtype=np.int64).view(np.uint64)) for k, v in keys.groupby("k")}
        seen = src.select("text").mapInArrow(_count_shingles(sc.broadcast(by_k)), "shingle long, n long")
        seen = seen.groupBy("shingle").agg(F.sum("n").alias("n"))
        counts = seen if counts is None else counts.unionByName(seen)
    # A shingle of two blocks has the same count in both.
    counts = counts.groupBy("shingle").agg(F.max("n").alias("n"))
    prefix = materialize(
        windows.select("size", "words", "items", F.posexplode("shingles").alias("offset", "shingle"))
        .join(counts, "shingle", "left")
        .groupBy("size", "words").agg(
            F.first("items").alias("items"),
            F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset")).alias("rare"))
        .filter("rare.n > 0"), "bench-prefix")

    out, carry = src, False
    for part in _blocks(prefix, block_windows):
        probes: dict[int, dict[int, list]] = {}
        for r in part.toLocalIterator():
            probes.setdefault(min(SHINGLE, r.size), {}).setdefault(r.rare.shingle, []).append(
                (r.rare.offset, r.size, bytes(r.words), r["items"]))
        block = {}
        for k, by_key in probes.items():
            keys = np.array(list(by_key), dtype=np.int64).view(np.uint64)
            order = np.argsort(keys)
            rows = list(by_key.values())
            block[k] = (keys[order], [rows[i] for i in order])
        schema = (f"row {src.schema['row'].dataType.simpleString()}, text string, n_words long, "
                  "starts array<int>, ends array<int>, items array<string>")
        out, carry = out.mapInArrow(_probe(sc.broadcast(block), carry), schema), True
    covered = F.expr("cast(size(array_distinct(flatten(zip_with(starts, ends, (s, e) -> sequence(s, e - 1))))) as long)")
    return out.select("row", "n_words", covered.alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items"))
