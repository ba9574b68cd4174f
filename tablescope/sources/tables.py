"""Table scans and sinks.

Parquet keeps its own schema. CSV is read as text, the NA words become null, and the
column types are then decided in one aggregate pass (bigint, then double, then boolean,
else string) - Spark's own ``inferSchema`` keeps ``NA`` as text and turns such a column to
string. Pass ``schema=`` to skip that pass on large inputs.
"""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.frames import col_of
from tablescope.sources import csv_records

# The text that pandas' CSV reader treats as missing by default.
NA_WORDS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
            "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
            "nan", "null")

_BOOL_WORDS = ("True", "False", "TRUE", "FALSE", "true", "false")

_SUFFIX_FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".jsonl": "jsonl"}

# What counts as a number in text; Spark's own cast also takes suffixes such as 1D or 2F.
_WHOLE = r"^\s*[+-]?[0-9]+\s*$"
_NUMBER = r"(?i)^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity)\s*$"


def _format_of(path: str, fmt: str | None) -> str:
    if fmt:
        return fmt
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix not in _SUFFIX_FORMATS:
        raise ValueError(f"unsupported file type: {suffix or path}")
    return _SUFFIX_FORMATS[suffix]


def normalize_nan(df: DataFrame) -> DataFrame:
    """NaN -> null in float and double columns, so 'missing' means one thing everywhere."""
    fixes = {f.name: F.when(~F.isnan(col_of(f.name)), col_of(f.name))
             for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select(*[fixes.get(c, col_of(c)).alias(c) for c in df.columns]) if fixes else df


def _csv_types(df: DataFrame) -> dict[str, T.DataType]:
    """Decide each text column's type in one pass (bounded 1-row result: 4 flags per column)."""
    exprs = []
    for i, c in enumerate(df.columns):
        v = col_of(c)
        present = v.isNotNull()
        exprs += [
            F.count_if(present).alias(f"n{i}"),
            F.count_if(present & ~(v.rlike(_WHOLE) & v.try_cast("bigint").isNotNull())).alias(f"l{i}"),
            F.count_if(present & ~v.rlike(_NUMBER)).alias(f"d{i}"),
            F.count_if(present & ~v.isin(*_BOOL_WORDS)).alias(f"b{i}"),
        ]
    row = df.agg(*exprs).first()
    types = {}
    for i, c in enumerate(df.columns):
        if row[f"n{i}"] == 0:
            types[c] = T.DoubleType()          # all missing: pandas gives float64 NaN
        elif row[f"l{i}"] == 0:
            types[c] = T.LongType()
        elif row[f"d{i}"] == 0:
            types[c] = T.DoubleType()
        elif row[f"b{i}"] == 0:
            types[c] = T.BooleanType()
        else:
            types[c] = T.StringType()
    return types


def _cast_text(c: str, dtype: T.DataType):
    v = col_of(c)
    if isinstance(dtype, T.BooleanType):
        return F.when(F.lower(v) == "true", F.lit(True)).when(F.lower(v) == "false", F.lit(False))
    if isinstance(dtype, T.StringType):
        return v
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(v.rlike(_NUMBER), v.try_cast(dtype))
    return v.try_cast(dtype)


def _read_csv(spark: SparkSession, path: str, schema, na_words, header: bool) -> DataFrame:
    """CSV as pandas reads it: doubled quotes, line breaks inside quotes, NA words as null; short rows
    are filled with nulls; longer rows, text that is not UTF-8 and quotes that never close are refused.

    One pass looks at every line. When no line ends inside quotes, lines are records and Spark's
    reader takes them; else records are put together from the lines of all splits (``csv_records``).
    """
    options = {"header": header, "encoding": "UTF-8", "escape": '"', "inferSchema": False}
    names = spark.read.options(**options, multiLine=True).csv(path).columns
    if not names:
        return spark.createDataFrame([], T.StructType([]))
    fields = None
    if schema is not None:
        fields = schema.fields if isinstance(schema, T.StructType) else T._parse_datatype_string(schema).fields
        names = [f.name for f in fields]
    raw = T.StructType([T.StructField(n, T.StringType()) for n in names])
    seen = csv_records.shape(spark, path)
    if not seen.valid:
        raise ValueError("CSV text is not UTF-8")
    if seen.crosses:
        record = F.col("record")
        refuse = F.raise_error(F.lit("CSV row with more fields than the header")).cast("boolean")
        rows = csv_records.records(spark, path, header).where(
            F.when(csv_records.field_count(record) > len(names), refuse).otherwise(F.lit(True)))
        text = rows.select(F.from_csv(record, _ddl(names), {"escape": '"'}).alias("r")).select("r.*")
    else:
        if seen.fields > len(names):
            raise ValueError("CSV row with more fields than the header")
        text = spark.read.options(**options).schema(raw).csv(path)
    text = text.select(*[(F.when(~col_of(n).isin(*na_words), col_of(n)) if na_words else col_of(n)).alias(n) for n in names])
    types = {f.name: f.dataType for f in fields} if fields else _csv_types(text)
    return text.select(*[_cast_text(c, t).alias(c) for c, t in types.items()])


def _ddl(names: list[str]) -> str:
    return ", ".join("`" + n.replace("`", "``") + "` string" for n in names)


def read_table(spark: SparkSession, path: str, fmt: str | None = None,
               schema: T.StructType | str | None = None, na_words=NA_WORDS,
               header: bool = True, multi_line: bool = True, filters: Mapping[str, object] | None = None) -> DataFrame:
    """Read a table, picking the format from the suffix unless ``fmt`` is given.

    ``filters`` (as in ``operators.filters``) are applied to the raw scan first, where Parquet can use
    them, and again after NaN became null; a filter on a float column that is written afterwards
    can't reach the scan through that rule. CSV files are read split by split, whatever lies inside quotes.
    ``.json`` files are documents (``multi_line``), ``.jsonl`` is read line by line; an empty CSV file is a
    table without columns, which ``validate`` reports.
    """
    kind = _format_of(path, fmt)
    if kind == "parquet":
        reader = spark.read.schema(schema) if schema is not None else spark.read
        raw = reader.parquet(path)
    elif kind in ("json", "jsonl"):
        from tablescope.sources.json_records import read_json_records
        raw = read_json_records(spark, path, multi_line=multi_line and kind == "json", schema=schema)
    elif kind == "csv":
        raw = _read_csv(spark, path, schema, na_words, header)
    else:
        raise ValueError(f"unsupported format: {kind}")
    if not filters:
        return normalize_nan(raw)
    from tablescope.operators.filters import apply_filters
    return apply_filters(normalize_nan(apply_filters(raw, filters)), filters)


def validate(df: DataFrame) -> DataFrame:
    """Upload checks as rows (check, ok, detail): non-empty table, at least two columns.

    Emptiness is decided by reading at most one row per task, not by a full count.
    """
    n_cols = len(df.columns)
    probe = df.limit(1).groupBy().count().withColumnRenamed("count", "n")
    return probe.select(F.inline(F.array(
        F.struct(F.lit("non_empty").alias("check"), (F.col("n") > 0).alias("ok"),
                 F.when(F.col("n") > 0, F.lit("table has rows"))
                  .otherwise(F.lit("The uploaded file is empty")).alias("detail")),
        F.struct(F.lit("min_columns").alias("check"), F.lit(n_cols >= 2).alias("ok"),
                 F.lit(f"{n_cols} columns" if n_cols >= 2 else
                       "The file must contain at least 2 columns").alias("detail")),
    )))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", single_file: bool = False, partitions_per_file: int = 1) -> str:
    """CSV with a header row and no index column, in the dialect that ``read_table`` reads (doubled quotes). Output stays partitioned unless asked.

    ``single_file`` sends everything through one task and is for small tables. ``partitions_per_file`` gives large files
    at any size: a task reads and writes that many partitions of ``df``, so the files grow in number and not in size.
    """
    out = df
    if single_file:
        out = df.coalesce(1)
    elif partitions_per_file > 1:
        out = df.coalesce(-(-df.rdd.getNumPartitions() // partitions_per_file))
    out.write.mode(mode).options(header=True, escape='"', encoding="UTF-8", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return path


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by=None) -> str:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path
