"""Line dedup by pairwise alignment: shared runs of lines, patience diff, common blocks deleted.

1. Exact copies of an earlier text lose all their lines by digest; one text per class goes on.
2. Every line (outer white space apart) is hashed. A *run* is the shortest stretch of neighbouring lines
   with ``block_chars`` characters from a line on, or up to a line. Every line of a common block lies in a
   run inside that block, so only earlier documents that hold a run can take its lines.
3. Each holder of a run is aligned with the first holder of that run by patience diff on the line hashes: lines
   unique on both sides, their longest common order (of several, the one that ends first in the
   earlier document), and so on between the anchors.
4. Aligned stretches of neighbouring lines with at least ``block_chars`` characters are common blocks; they
   are deleted from the later document (larger id). Every pair is judged on the input texts.
5. Where a run has lines that no block so far covers, its next holders follow (8, 64, ... at a time), until it is
   covered or no earlier holder is left. The result is that of aligning every pair of documents.

A line in a third of all documents costs one pair per document, as its first holder settles it. What costs more
is a run that patience leaves out again and again (repeated more often in the later document, or moved): its
document is aligned with every earlier holder.

Defined results: null text is one empty line, which stays; blank lines go only inside a block;
rows that share an id, or have none, are not aligned with each other, and rows without an id
count as the last; repeated rows are treated alike. Line breaks are ``\\n``.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescope.session import materialize

BLOCK_CHARS = 40
FACTOR = 8        # so many more holders of a run in each round
ODD = 0x9E3779B97F4A7C15


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned (index in a, index in b), ascending."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        in_a, in_b = Counter(a[i:m]), Counter(b[j:n])
        at = {x: k for k, x in enumerate(b[j:n], j) if in_b[x] == 1}
        pairs = [(k, at[x]) for k, x in enumerate(a[i:m], i) if in_a[x] == 1 and x in at]
        tails: list[int] = []
        ends: list[int] = []
        back: list[int] = []
        for p, (_, y) in enumerate(pairs):          # longest run of pairs ascending on both sides
            k = bisect_left(tails, y)
            back.append(ends[k - 1] if k else -1)
            tails[k:k + 1], ends[k:k + 1] = [y], [p]
        chain, p = [], ends[-1] if ends else -1
        while p >= 0:
            chain.append(pairs[p])
            p = back[p]
        if chain:
            out += chain
            x0, y0 = i, j
            for x, y in [*chain[::-1], (m, n)]:
                todo.append((x0, x, y0, y))
                x0, y0 = x + 1, y + 1
    return sorted(out)


def common_blocks(a: list[int], b: list[int], chars: list[int], least: int) -> list[tuple[int, int]]:
    """[start, end) line ranges of ``a`` aligned with neighbouring lines of ``b``, long enough."""
    out, run = [], []
    for pair in [*patience(a, b), (-9, -9)]:
        if run and pair == (run[-1][0] + 1, run[-1][1] + 1):
            run.append(pair)
            continue
        if run and sum(chars[i] for i, _ in run) >= least:
            out.append((run[0][0], run[-1][0] + 1))
        run = [pair]
    return out


def _align(least: int):
    def run(batches):
        for b in batches:
            names = ("lines_d", "chars_d", "lines_e")
            spans = [common_blocks(x, y, c, least) for x, c, y in zip(*(b.column(n).to_pylist() for n in names), strict=True)]
            n = np.array([len(s) for s in spans])
            flat = np.array([p for s in spans for p in s], dtype=np.int32).reshape(-1, 2)
            yield pa.record_batch({
                **{c: b.column(c).take(pa.array(np.repeat(np.arange(len(n)), n))) for c in ("doc", "did", "e")},
                "s": pa.array(flat[:, 0]), "t": pa.array(flat[:, 1])})
    return run


def run_keys(lines: np.ndarray, chars: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(key, text, start, end) of the runs of a group of texts; ``bounds`` are their first lines, and the end.

    The key is a polynomial of the line hashes; runs that share one by chance only cost an alignment.
    """
    n = len(lines)
    total = np.concatenate([[0], np.cumsum(chars, dtype=np.int64)])
    at = np.arange(n)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    end = np.maximum(np.searchsorted(total, total[:-1] + least), at + 1)
    start = np.minimum(np.searchsorted(total, total[1:] - least, side="right") - 1, at)
    onward, back = end <= bounds[text + 1], start >= bounds[text]
    s, e = np.unique(np.concatenate([np.stack([at, end], 1)[onward], np.stack([start, at + 1], 1)[back]]), axis=0).T
    power, inverse = (np.full(n + 1, x, dtype=np.uint64) for x in (ODD, pow(ODD, -1, 1 << 64)))
    power[0] = inverse[0] = 1
    power, inverse = power.cumprod(dtype=np.uint64), inverse.cumprod(dtype=np.uint64)
    upto = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(lines.view(np.uint64) * power[:-1], dtype=np.uint64)])
    key = (upto[e] - upto[s]) * inverse[s] + (e - s).astype(np.uint64)
    own = text[s]
    return key.view(np.int64), own, (s - bounds[own]).astype(np.int32), (e - bounds[own]).astype(np.int32)


def _runs(least: int):
    def run(batches):
        for b in batches:
            size = np.asarray(pa.compute.list_value_length(b.column("lines")))
            bounds = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
            key, own, s, t = run_keys(np.asarray(b.column("lines").flatten()), np.asarray(b.column("chars").flatten()), bounds, least)
            rows = pa.array(own)
            yield pa.record_batch({"run": pa.array(key), **{c: b.column(c).take(rows) for c in ("doc", "did")},
                                   "s": pa.array(s), "t": pa.array(t)})
    return run


def common_spans(src: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc, did, e, s, t): lines [s, t) of a document that are a common block with the earlier document e."""
    trimmed = F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(" \t\r\f\v")))
    texts = materialize(
        src.groupBy("digest").agg(F.min(F.struct("doc", "did")).alias("r"), F.max("doc").alias("last"),
                                  F.first(F.transform(trimmed, lambda x: F.xxhash64(x))).alias("lines"),
                                  F.first(F.transform(trimmed, lambda x: F.length(x))).alias("chars"))
        .select("digest", "last", "r.doc", "r.did", "lines", "chars"), "line-texts")
    later = texts.select("doc", "did", F.col("lines").alias("lines_d"), F.col("chars").alias("chars_d"))
    earlier = texts.select(F.col("doc").alias("e"), F.col("did").alias("edid"), F.col("lines").alias("lines_e"))

    runs = texts.select("doc", "did", "lines", "chars").mapInArrow(_runs(block_chars), "run long, doc long, did long, s int, t int")
    first = (runs.groupBy("run").agg(F.min(F.struct("doc", "did")).alias("e"), F.max("doc").alias("last"))
             .filter("e.doc < last").select("run", "e"))
    shared = materialize(runs.join(first, "run"), "line-runs")
    todo = shared.filter("e.doc < doc").select("run", "doc", "did", "s", "t")      # runs that may have lines left
    picks = shared.select("run", "e").distinct()
    aligned, n = None, 1
    while True:
        pairs = todo.join(picks, "run").filter("e.doc < doc").select("doc", "did", F.col("e.doc").alias("e"), F.col("e.did").alias("edid")).distinct()
        found = materialize(
            pairs.join(later, ["doc", "did"]).join(earlier, ["e", "edid"])
            .select("doc", "did", "e", "lines_d", "chars_d", "lines_e")
            .mapInArrow(_align(block_chars), "doc long, did long, e long, s int, t int"), "line-spans")
        aligned = found if aligned is None else aligned.unionByName(found)
        more = picks.groupBy("run").agg(F.max("e").alias("after"), F.count("*").alias("n")).filter(F.col("n") == n).select("run", "after")
        spans = aligned.groupBy("doc", "did").agg(F.collect_set(F.struct("s", "t")).alias("spans"))
        left = F.exists(F.sequence(F.col("s"), F.col("t") - 1),
                        lambda i: ~F.exists("spans", lambda p: (p["s"] <= i) & (i < p["t"])))
        todo = materialize(todo.join(more, "run").filter("after.doc < doc").join(spans, ["doc", "did"], "left")
                           .filter(F.col("spans").isNull() | left).select("run", "doc", "did", "s", "t", "after"), "line-todo")
        if todo.isEmpty():
            break
        n *= FACTOR
        keys = todo.groupBy("run").agg(F.max("doc").alias("top"), F.first("after").alias("after"))
        todo = todo.drop("after")
        holders = (shared.select("run", "doc", F.struct("doc", "did").alias("e")).join(keys, "run")
                   .filter((F.col("doc") < F.col("top")) & (F.col("e") > F.col("after"))).select("run", "e").distinct())
        rank = F.row_number().over(Window.partitionBy("run").orderBy("e"))
        picks = materialize(holders.withColumn("rank", rank).filter(F.col("rank") <= n).select("run", "e"), "line-holders")

    copied = texts.filter("doc < last and exists(chars, c -> c > 0)").select("digest", F.col("doc").alias("e"))
    copies = (src.select("digest", "doc", "did").join(copied, "digest").filter("e < doc")
              .select("doc", "did", "e", F.lit(0).alias("s"), F.lit((1 << 31) - 1).alias("t")))
    return aligned.unionByName(copies)


def remove_common_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] | None = None,
                        block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per row of docs: row struct<carry columns, the id by default>, n_lines, n_removed, kept (text)."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    src = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry or (doc_id,)]).alias("row"),
        F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit((1 << 63) - 1)).alias("doc"),
        F.md5(body.cast("binary")).alias("digest"), F.xxhash64(body).alias("did"), body.alias("text"))
    spans = (common_spans(src.select("digest", "doc", "did", "text"), block_chars)
             .groupBy("doc", "did").agg(F.collect_set(F.struct("s", "t")).alias("spans")))
    out = src.select("row", "doc", "did", "text").join(spans, ["doc", "did"], "left")
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda x, i: ~F.exists("spans", lambda p: (p["s"] <= i) & (i < p["t"])))
    kept = F.when(F.col("spans").isNull(), lines).otherwise(kept)
    return out.select("row", F.size(lines).cast("long").alias("n_lines"),
                      (F.size(lines) - F.size(kept)).cast("long").alias("n_removed"), F.array_join(kept, "\n").alias("kept"))
