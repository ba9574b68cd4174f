"""Quality classifier: hashed word n-gram logistic regression, FTRL-proximal training.

Features are the word 1-grams and 2-grams of the whole text, hashed into ``dims`` slots; a
2-gram of twice the same word is hashed as "the same word again", whatever the word. The
value of a slot is its share of all n-grams of the text. Training runs one FTRL-proximal
learner per shard of a bounded, documented sample of the labelled rows (``max_rows``) and
averages the shard weights. Scoring is a sparse dot product over every whole text, inside
Arrow batches; the broadcast model has ``dims + 1`` floats whatever the corpus.

Defined results: a null or empty text scores the bias alone; labels other than 0 and 1 (null
included) and rows without an id take no part in training; a training set with no rows
gives the neutral score 0.5; repeated rows count each; a document without a label is scored
like any other. Only the text column is a model input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.llm.text import iter_words

DIMS = 1 << 18
MAX_ROWS = 20_000            # bound of the training sample (labelled rows)
SHARD_ROWS = 2_500           # rows of one learner, so at most 8 learners
EPOCHS = 3
# Feature shares are about 1/length; the scale brings usual texts near unit norm.
SCALE = 30.0
ALPHA, BETA, L1, L2 = 0.5, 0.1, 1e-4, 1e-4
REPEAT = np.uint64(0x5851F42D4C957F2D)


def _slots(words, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, slot) of every 1-gram and 2-gram of a group of texts."""
    at, pair = words.shingles(2)
    pair[words.hash[at] == words.hash[at + 1]] = REPEAT
    doc = np.concatenate((words.doc, words.doc[at]))
    slot = np.concatenate((words.hash, pair)) & np.uint64(dims - 1)
    return doc, slot.astype(np.int64)


def _features(dims: int):
    def run(batches):
        for b in batches:
            for w in iter_words(b.column("text")):
                doc, slot = _slots(w, dims)
                key, count = np.unique(doc * dims + slot, return_counts=True)
                cut = np.searchsorted(key, np.arange(w.n_docs + 1) * dims).astype(np.int32)
                rows = slice(w.first, w.first + w.n_docs)
                yield pa.record_batch({
                    "shard": b.column("shard")[rows], "label": b.column("label")[rows],
                    "idx": pa.ListArray.from_arrays(cut, pa.array((key % dims).astype(np.int32))),
                    "cnt": pa.ListArray.from_arrays(cut, pa.array(count.astype(np.float32)))})
    return run


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, float]], dims: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (dims + bias) after ``epochs`` passes over (slots, values, label) rows."""
    z, n = np.zeros(dims + 1), np.zeros(dims + 1)

    def weight(i):
        return np.where(np.abs(z[i]) <= L1, 0.0,
                        -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for idx, x, y in rows:
            w = weight(idx)
            g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
            z[idx] += g - (np.sqrt(n[idx] + g * g) - np.sqrt(n[idx])) / ALPHA * w
            n[idx] += g * g
    return weight(slice(None))


def _train_shard(dims: int, epochs: int):
    def run(table: pa.Table) -> pa.Table:
        rows = []
        for idx, cnt, y in zip(table["idx"], table["cnt"], table["label"].to_pylist(), strict=True):
            i = np.asarray(idx.values, dtype=np.int64)
            c = np.asarray(cnt.values, dtype=np.float64)
            x = c * (SCALE / max(c.sum(), 1.0))
            rows.append((np.append(i, dims), np.append(x, 1.0), float(y)))
        order = np.random.default_rng(0).permutation(len(rows))
        w = ftrl([rows[k] for k in order], dims, epochs)
        used = np.flatnonzero(w)
        return pa.table({"idx": used, "w": w[used]})
    return run


def train(labelled: DataFrame, dims: int = DIMS, max_rows: int = MAX_ROWS,
          shard_rows: int = SHARD_ROWS, epochs: int = EPOCHS) -> np.ndarray:
    """Fit on ``labelled`` (columns id, text, label). Returns dims + 1 weights, the bias last.

    When there are more than ``max_rows`` rows, rows are drawn by a hash of id and text, so
    the draw does not depend on the layout.
    """
    rows = labelled.filter(F.col("label").isin(0, 1) & F.col("id").isNotNull())
    total = rows.count()
    weights = np.zeros(dims + 1)
    if not total:
        return weights
    shards = -(-min(total, max_rows) // shard_rows)
    key = F.xxhash64("id", "text")
    if total > max_rows:
        rows = rows.filter(F.pmod(key, F.lit(1 << 30)) < int((1 << 30) * max_rows / total))
    rows = rows.select((F.pmod(F.xxhash64(key), F.lit(shards))).cast("int").alias("shard"),
                       F.col("label").cast("int").alias("label"), "text")
    parts = (rows.mapInArrow(_features(dims), "shard int, label int, idx array<int>, cnt array<float>")
             .groupBy("shard").applyInArrow(_train_shard(dims, epochs), "idx long, w double"))
    # At most one row per slot reaches the driver: a bound that does not grow with the data.
    summed = parts.groupBy("idx").agg(F.sum("w").alias("w")).toPandas()
    weights[summed["idx"].to_numpy(dtype=np.int64)] = summed["w"].to_numpy() / shards
    return weights


def score(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """(row struct<all columns of docs>, score double): the row order of docs is kept."""
    dims = len(weights) - 1
    model = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    # A text column is read from the row, so the text goes to the Python worker once.
    place = docs.columns.index(text) if docs.schema[text].dataType == T.StringType() else None

    def run(batches):
        w = model.value.astype(np.float64)
        for b in batches:
            out = np.empty(b.num_rows)
            for g in iter_words(pc.struct_field(b.column("row"), [place]) if place is not None else b.column("text")):
                doc, slot = _slots(g, dims)
                n = np.bincount(doc, minlength=g.n_docs)
                dot = np.bincount(doc, weights=w[slot], minlength=g.n_docs) * SCALE / np.maximum(n, 1)
                out[g.first:g.first + g.n_docs] = 1.0 / (1.0 + np.exp(-np.clip(dot + w[dims], -30, 30)))
            yield pa.record_batch({"row": b.column("row"), "score": pa.array(out)})

    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                      *([] if place is not None else [F.col(f"`{text}`").cast("string").alias("text")]))
    return src.mapInArrow(run, f"row {src.schema['row'].dataType.simpleString()}, score double")


def held_out(doc_id):
    """True where crc32 of the id as text leaves 1 modulo 3; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, text, label) of the labelled documents that are not held out.

    Several labels of one document count as the smallest of them.
    """
    one = (labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
           .groupBy("doc_id").agg(F.min("quality").alias("label")).filter(~held_out("doc_id")))
    return (docs.select(F.col("doc_id"), F.col("text")).join(one, "doc_id")
            .select(F.col("doc_id").alias("id"), "text", "label"))
