"""Training-corpus pipeline: quality, line dedup, near-dedup, decontamination, packing.

``STAGES`` lists (name, function); every function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next stage's ``docs``. All but the last
return the columns of ``docs``. ``run`` applies them to ``documents``.

``ORACLE_SQL`` is None: the classifier is trained, so SQL can't give the rows; tests hold
every stage against a brute-force version on its own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.llm import decontaminate, lines, near_text, packing, quality
from tablescope.llm.queries import tokenizer_path
from tablescope.session import materialize

ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    weights = quality.train(quality.training_rows(docs, _table(spark, sf_dir, "labels")))
    return quality.score(docs, weights).filter("score >= 0.5").select("row.*")


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Common blocks leave the later documents; a document that loses every line goes."""
    others = tuple(c for c in docs.columns if c != "text")
    out = lines.remove_common_lines(docs, carry=others).filter("n_removed < n_lines")
    out = out.select("row.*", F.col("kept").alias("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    gone = near_text.near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.mark(docs, _table(spark, sf_dir, "benchmark")).filter("n_hit = 0").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of full training sequences, with their token ids."""
    return packing.pack(docs, tokenizer_path()).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("quality", keep_quality), ("line_dedup", drop_common_lines), ("near_dedup", drop_near_duplicates),
          ("decontaminate", drop_contaminated), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
