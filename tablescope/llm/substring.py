"""Substring dedup: repeated token k-mers, de Bruijn compaction, verified source spans.

A window is ``k`` consecutive words; a word is removed if a window over it also starts in a
document with a smaller id. Texts in which every window repeats (exact copies of an earlier
text) are settled by their digest first. For the distinct texts:

1. *seeds*: the minimizer of every window (the smallest hash of its ``SEED``-word shingles)
   is kept per document; equal windows have equal minimizers, so only windows whose seed
   occurs in two documents can repeat. Seeds are a fifth of all positions, and they are
   combined per task before they are shuffled;
2. *edges*: the windows at such seeds are the edges of a de Bruijn graph between (k-1)-word
   nodes. Per edge: the smallest and largest document that hold it. Only repeated edges stay;
3. *compaction*: joined back to their occurrences, neighbouring repeated edges of a document
   that share the node between them compact into one path while the first document is the
   same and the node does not branch; a path occurrence is one span
   (document, first word, last word, first document);
4. *verification*: the spans, as source coordinates, go back to the texts, and the words
   outside them are kept.

Equality of windows is equality of 64-bit hashes of their words in order; digests are
256-bit.

Defined results: null text has no words; a text of fewer than ``k`` words loses none; rows
with a null id come after all others and are never a source for each other's removal; rows that repeat an id
are judged like one document, so they do not remove each other's words. Only id and text are
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescope.llm.text import iter_words, shingle_hash
from tablescope.session import discard, materialize

K = 13
SEED = 5


def seed_of_windows(words, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, word index of its seed) of every k-word window of a group of texts: the
    leftmost smallest hash among the window's ``seed``-word shingles."""
    n = len(words.hash) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    at = np.arange(len(words.hash) - seed + 1)
    value = shingle_hash(words.hash, at, seed)
    low, best = value[:n].copy(), np.arange(n)
    for j in range(1, k - seed + 1):
        less = value[j:j + n] < low
        low[less] = value[j:j + n][less]
        best[less] = np.flatnonzero(less) + j
    start = np.flatnonzero(words.doc[:n] == words.doc[k - 1:])
    return start, best[start]


def _seeds(k: int, seed: int):
    """One row per text: its seeds (hash and word index), each position once."""
    def run(batches):
        for b in batches:
            for w in iter_words(b.column("text")):
                at = np.unique(seed_of_windows(w, k, seed)[1])
                bounds = w.bounds()
                cut = np.searchsorted(at, bounds).astype(np.int32)
                rows = slice(w.first, w.first + w.n_docs)
                yield pa.record_batch({
                    **{c: b.column(c)[rows] for c in ("digest", "doc", "did")},
                    "seed": pa.ListArray.from_arrays(cut, pa.array(shingle_hash(w.hash, at, seed).view(np.int64))),
                    "at": pa.ListArray.from_arrays(cut, pa.array((at - bounds[w.doc[at]]).astype(np.int32)))})
    return run


def _edges(k: int, seed: int):
    """The windows at flagged seeds: edge hash, its two nodes, document and first word.

    Nodes need 32 bits only: two nodes with one hash count as a branch, which ends a path earlier
    and leaves the words that go the same.
    """
    def run(batches):
        for b in batches:
            flagged = b.column("at")
            doc, did = (np.asarray(b.column(c)) for c in ("doc", "did"))
            for w in iter_words(b.column("text")):
                start, best = seed_of_windows(w, k, seed)
                bounds = w.bounds()
                own = flagged[w.first:w.first + w.n_docs]
                hot = np.zeros(len(w.hash) + 1, dtype=bool)
                hot[np.asarray(own.flatten()) + np.repeat(bounds[:-1], np.asarray(pa.compute.list_value_length(own)))] = True
                start = start[hot[best]]
                if not len(start):
                    continue
                row = w.doc[start]
                yield pa.record_batch({
                    "edge": pa.array(shingle_hash(w.hash, start, k).view(np.int64)),
                    "src": pa.array(shingle_hash(w.hash, start, k - 1).view(np.int64).astype(np.int32)),
                    "dst": pa.array(shingle_hash(w.hash, start + 1, k - 1).view(np.int64).astype(np.int32)),
                    "doc": pa.array(doc[w.first + row]), "did": pa.array(did[w.first + row]),
                    "pos": pa.array((start - bounds[row]).astype(np.int32))})
    return run


def _keep(k: int):
    def run(batches):
        for b in batches:
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(b.column("text"), b.column("spans"), strict=True):
                words = (text.as_py() or "").encode().split()       # splits at exactly the separators
                gone, out = 0, words
                if spans.is_valid and len(words) >= k:
                    out, last = [], 0
                    for s, e in sorted((x["s"], x["e"]) for x in spans.as_py()):
                        if e > last:
                            out += words[last:max(s, last)]
                            gone += min(e, len(words)) - max(s, last)
                            last = min(e, len(words))
                    out += words[last:]
                n_words.append(len(words))
                n_removed.append(gone)
                kept.append(b" ".join(out).decode())
            yield pa.record_batch({"row": b.column("row"), "n_words": pa.array(n_words, pa.int64()),
                                   "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.string())})
    return run


def repeated_spans(src: DataFrame, k: int = K, seed: int = SEED) -> DataFrame:
    """(doc, did, s, e, first): compacted spans of words [s, e) that repeat from document ``first``.

    ``src`` has digest, doc, did and text; ``e`` is past the end for exact copies of an earlier text.
    """
    seeds = src.mapInArrow(_seeds(k, seed), "digest string, doc long, did long, seed array<long>, at array<int>")
    texts = materialize(
        seeds.groupBy("digest").agg(F.min(F.struct("doc", "did", "seed", "at")).alias("r"), F.max("doc").alias("last"))
        .select("digest", "last", "r.*"), "substring-texts")

    sown = texts.select("doc", "did", F.inline(F.arrays_zip("seed", "at")))
    twice = sown.groupBy("seed").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a < b").select("seed")
    flagged = materialize(sown.join(twice, "seed", "left_semi").groupBy("doc", "did").agg(F.collect_list("at").alias("at")),
                          "substring-flagged")
    copied = materialize(texts.filter("doc < last").select("digest", F.col("doc").alias("first")), "substring-copied")
    discard(texts)

    found = materialize(
        src.select("doc", "did", "text").join(flagged, ["doc", "did"])
        .mapInArrow(_edges(k, seed), "edge long, src int, dst int, doc long, did long, pos int"), "substring-edges")
    discard(flagged)
    edges = (found.groupBy("edge").agg(F.min("doc").alias("first"), F.max("doc").alias("b"),
                                       F.min("src").alias("src"), F.min("dst").alias("dst"))
             .filter("first < b").select("edge", "first", "src", "dst"))
    edges = materialize(edges, "substring-graph")
    nodes = (edges.select(F.col("src").alias("node"), F.lit(1).alias("n_out"), F.lit(0).alias("n_in"))
             .unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("n_out"), F.lit(1).alias("n_in")))
             .groupBy("node").agg(F.sum("n_out").alias("n_out"), F.sum("n_in").alias("n_in")))
    plain = nodes.filter("n_out = 1 and n_in = 1").select(F.col("node").alias("src"), F.lit(True).alias("plain"))
    graph = edges.select("edge", "first", "src").join(plain, "src", "left").select("edge", "first", "plain")

    by_doc = Window.partitionBy("doc", "did").orderBy("pos")
    step = (F.col("pos") - F.lag("pos").over(by_doc) <= 1) & F.col("plain") & (F.col("first") == F.lag("first").over(by_doc))
    occurrences = found.select("edge", "doc", "did", "pos").join(graph, "edge").filter("first < doc")
    paths = (occurrences.withColumn("opens", F.when(step, 0).otherwise(1))
             .withColumn("path", F.sum("opens").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
             .groupBy("doc", "did", "path").agg(F.min("pos").alias("s"), (F.max("pos") + k).alias("e"), F.first("first").alias("first"))
             .drop("path"))

    paths = materialize(paths, "substring-paths")
    discard(found, edges)
    copies = (src.select("digest", "doc", "did").join(copied, "digest").filter("first < doc")
              .select("doc", "did", F.lit(0).alias("s"), F.lit((1 << 31) - 1).alias("e"), "first"))
    return paths.unionByName(copies)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] | None = None,
                   k: int = K, seed: int = SEED) -> DataFrame:
    """Per row of docs: row struct<carry columns, the id by default>, n_words, n_removed, kept (text)."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    src = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry or (doc_id,)]).alias("row"),
        F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit((1 << 63) - 1)).alias("doc"),
        F.md5(body.cast("binary")).alias("digest"), F.xxhash64(body).alias("did"), body.alias("text"))
    spans = (repeated_spans(src.select("digest", "doc", "did", "text"), k, seed)
             .groupBy("doc", "did").agg(F.collect_list(F.struct("s", "e")).alias("spans")))
    return (src.select("row", "doc", "did", "text").join(spans, ["doc", "did"], "left")
            .select("row", "text", "spans")
            .mapInArrow(_keep(k), f"row {src.schema['row'].dataType.simpleString()}, n_words long, n_removed long, kept string"))
