"""The ``opN_<name>`` queries and the pipeline: thin wrappers that derive the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.llm import (collocations, decontaminate, lines, merkle, near_text, near_vectors, packing, preference, quality,
                            shard, substring, threshold, warc)
from tablescope.llm.oracle_sql import ORACLES  # noqa: F401  (read by the entry module)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_hierarchical_packing(spark, sf_dir):
    pieces = packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset", "tier", "step_group")


@query
def op2_embedding_near_dedup(spark, sf_dir):
    return near_vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


@query
def op3_histogram_sharding(spark, sf_dir):
    body = F.coalesce(F.col("text"), F.lit(""))
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("text_key"))
    return shard.shard(docs, size="size", key="text_key").select(
        "row.doc_id", "row.size", "row.text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query
def op4_seekable_warc(spark, sf_dir):
    folder, index = warc.write_archives(_table(spark, sf_dir, "pages"))
    return warc.read_archives(folder, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op5_minhash_near_dedup(spark, sf_dir):
    found = near_text.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "component_id", "kept")


@query
def op6_quality_classifier(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    weights = quality.train(quality.training_rows(docs, _table(spark, sf_dir, "labels")))
    scored = quality.score(docs.select("doc_id", "text"), weights)
    return scored.select(F.col("row.doc_id").alias("doc_id"), quality.held_out("row.doc_id").alias("held_out"),
                         "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op7_substring_dedup(spark, sf_dir):
    found = substring.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op8_line_dedup(spark, sf_dir):
    found = lines.remove_common_lines(_table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op9_preference_formatting(spark, sf_dir):
    chosen, rejected = preference.last_reply_swapped(_table(spark, sf_dir, "conversations"))
    out = preference.format_pairs(chosen, rejected)

    def ranges(c):
        return F.array_join(F.transform(c, lambda x: F.concat(x["s"].cast("string"), F.lit("-"), x["e"].cast("string"))), ",").alias(c)
    return out.select("pair_id", "n_common", "prompt", "chosen", "rejected", ranges("chosen_mask"), ranges("rejected_mask"))


@query
def op10_benchmark_decontamination(spark, sf_dir):
    found = decontaminate.mark(_table(spark, sf_dir, "documents").select("doc_id", "text"),
                               _table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


@query
def op11_phrase_collocations(spark, sf_dir):
    found = collocations.collocations(_table(spark, sf_dir, "documents"))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@query
def op12_merkle_manifest(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")

    def leaf(text):
        return merkle.leaf_digest([F.col(c) for c in ("doc_id", "source", "lang", "n_chars")] + [text])
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaves = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("lang").alias("group"), leaf(F.col("text")).alias("leaf"),
                         F.when(tampered, leaf(lowered)).alias("changed"))
    found = merkle.fold(merkle.build(leaves))
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"),
                        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


@query
def op13_threshold_top_k(spark, sf_dir):
    vectors = threshold.integer_vectors(_table(spark, sf_dir, "embeddings"))
    return threshold.top_k(vectors, vectors.filter("id % 50 = 0")).select(
        "query_id", "rank", F.col("id").alias("vec_id"), "score")
