"""JSON records with nesting.

Shape rules for a JSON document: a list gives one row per item; an object with a
``data`` key gives the rows under ``data`` (a list, or one object); else an object with a
``results`` key gives those; any other object is one row; a bare scalar is refused.
Nested objects flatten into ``parent.child`` columns; lists stay arrays.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.frames import col_of


def _leaves(dtype: T.StructType, prefix: list[str]):
    for f in dtype.fields:
        path = prefix + [f.name]
        if isinstance(f.dataType, T.StructType) and f.dataType.fields:
            yield from _leaves(f.dataType, path)
        else:
            yield path


def _path_col(path: list[str]) -> Column:
    c = col_of(path[0])
    for name in path[1:]:
        c = c.getField(name)
    return c


def flatten_structs(df: DataFrame, sep: str = ".") -> DataFrame:
    """Struct columns become one column per leaf named ``a<sep>b``; arrays are kept."""
    cols = [_path_col(p).alias(sep.join(p)) for p in _leaves(df.schema, [])]
    return df.select(*cols)


def _variant_schema_to_ddl(text: str) -> str:
    # schema_of_variant_agg writes OBJECT<...>; from_json reads STRUCT<...>.
    return text.replace("OBJECT<", "STRUCT<")


def parse_json_column(df: DataFrame, col: str, schema: str | None = None, sep: str = ".",
                      keep: list[str] | None = None) -> DataFrame:
    """Parse a JSON text column into flattened columns.

    Without ``schema`` the merged schema of all rows is found by one distributed aggregate
    (``schema_of_variant_agg``), so keys seen in any row become columns.
    """
    if schema is None:
        schema = _variant_schema_to_ddl(
            df.select(F.schema_of_variant_agg(F.parse_json(col_of(col))).alias("s")).first()["s"])
    parsed = df.withColumn(col, F.from_json(col_of(col), schema))
    others = [c for c in (keep if keep is not None else df.columns) if c != col]
    nested = [_path_col(p).alias(sep.join(p)) for p in _leaves(parsed.select(col_of(col)).schema, [])]
    return parsed.select(*[col_of(c) for c in others], *nested)


_STRINGS = re.compile(rb'"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'')
_STEP = np.zeros(256, dtype=np.int64)
_STEP[[*b"[{"]], _STEP[[*b"]}"]] = 1, -1
_SHOWS = np.ones(256, dtype=bool)       # whatever lies at its depth: values, separators and closing brackets
_SHOWS[[*b"[{ \t\r\n"]] = False


def _pieces(batches):
    """Per split of a file: the change in depth, the least depth that anything lies at, how much lies there.

    A JSON string holds no line break, so each line starts outside of strings and is looked at by itself.
    """
    now, depth, low, n, head = None, 0, None, 0, ""

    def row():
        return pa.record_batch({"file": [now[0]], "start": pa.array([now[1]], pa.int64()), "head": [head], "depth": pa.array([depth], pa.int64()),
                                "low": pa.array([low], pa.int64()), "n": pa.array([n], pa.int64())})
    for b in batches:
        for file, start, line in zip(*(b.column(c) for c in ("file", "start", "line")), strict=True):
            key, line = (file.as_py(), start.as_py()), line.as_py()
            if key != now:
                if now:
                    yield row()
                now, depth, low, n, head = key, 0, None, 0, line[0]
            text = np.frombuffer(_STRINGS.sub(b"0", line.encode()), dtype=np.uint8)
            at = depth + np.cumsum(_STEP[text])
            depth = int(at[-1])
            at = at[_SHOWS[text]]
            if len(at):
                least = int(at.min())
                same = int((at == least).sum())
                n = same + (n if low == least else 0) if low is None or least <= low else n
                low = least if low is None else min(low, least)
    if now:
        yield row()


def _top_level_kind(spark: SparkSession, path: str) -> str:
    """"list" or "object": the kind of every file's one value (one kind per folder).

    Of a file that goes on after its first value (JSON lines, concatenated documents), document mode
    would return that value only, and files of another kind would be read by the wrong rule: both are
    refused. Every file is looked at line by line, in one distributed pass.
    """
    lines = (spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                                          F.btrim("value", F.lit(" \t\r\ufeff")).alias("line"))
             .where("line <> ''"))
    pieces = lines.mapInArrow(_pieces, "file string, start long, head string, depth long, low long, n long")
    whole = pieces.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("start", "head", "depth", "low", "n"))).alias("p"))
    # n counts what lies at depth 0, where a single list or object has its closing bracket only
    state = F.aggregate("p", F.expr("named_struct('depth', 0L, 'n', 0L)"), lambda s, p: F.struct(
        (s["depth"] + p["depth"]).alias("depth"),
        (s["n"] + F.when(s["depth"] + p["low"] == 0, p["n"]).when(s["depth"] + p["low"] < 0, F.lit(2)).otherwise(F.lit(0))).alias("n")))
    head = F.col("p")[0]["head"]
    kind = F.when(head == "[", "list").when(head == "{", "object").otherwise("scalar")
    seen = (whole.select("file", kind.alias("kind"), (state["n"] > 1).alias("more"))
            .agg(F.min("kind").alias("low"), F.max("kind").alias("high"), F.min(F.when(F.col("more"), F.col("file"))).alias("more")).first())
    if seen["low"] is None:
        raise ValueError("JSON payload is empty")
    if seen["high"] == "scalar":
        raise ValueError("JSON payload must be a list or an object")
    if seen["more"] is not None:
        raise ValueError(f"{seen['more']} holds several JSON documents: read it as JSON lines (fmt='jsonl')")
    if seen["low"] != seen["high"]:
        raise ValueError("the folder holds lists and objects: read them apart")
    return seen["low"]


def read_json_records(spark: SparkSession, path: str, multi_line: bool = True,
                      sep: str = ".", schema=None) -> DataFrame:
    """Read JSON documents (multi_line=True) or JSON lines (multi_line=False) as flat rows.

    Records that are not JSON are refused when they are read. ``schema`` is that of the records.
    """
    reader = spark.read.option("multiLine", multi_line).option("mode", "FAILFAST")
    if not multi_line:
        return flatten_structs(reader.schema(schema).json(path) if schema is not None else reader.json(path), sep)
    if _top_level_kind(spark, path) == "list":
        return flatten_structs(reader.schema(schema).json(path) if schema is not None else reader.json(path), sep)
    raw = reader.json(path)
    for key in ("data", "results"):
        if key in raw.columns:
            dtype = raw.schema[key].dataType
            if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType):
                raw = raw.select(F.inline(col_of(key)))
            elif isinstance(dtype, T.StructType):
                raw = raw.select(F.col(f"{key}.*"))
            else:
                raw = raw.select(col_of(key))
            break
    out = flatten_structs(raw, sep)
    if schema is not None:
        fields = schema.fields if isinstance(schema, T.StructType) else T._parse_datatype_string(schema).fields
        out = out.select(*[(col_of(f.name) if f.name in out.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
    return out
