"""CSV text that every file split reads on its own, line breaks inside quotes included.

Whether a line starts inside a quoted field depends on all lines before it. Each line is a step from
(outside, inside) to (outside, inside), found by two patterns; steps compose, so a split of a file is one step too, and
a prefix over the splits of a file, one row each, tells every split how it starts. Lines are then put together to records inside
each split; a record that crosses splits is joined from one fragment per split. Nothing is read by one task because
of its quotes, and no row of text is shuffled but those fragments.

A quote opens a field only at the field's start; elsewhere in an unquoted field it is text. A field may hold
doubled quotes. Records end with LF or CRLF; what is inside quotes comes back as it is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_REST = r'[^"]*+(?:""[^"]*+)*+'                              # of a quoted field, without its closing quote
_FIELDS = rf'(?:(?:"{_REST}"[^,]*+|(?!")[^,]*+),)*+'         # whole fields
_OPENS = rf'^{_FIELDS}"{_REST}\z'
_STAYS = rf'^{_REST}(?:\z|"[^,]*+,{_FIELDS}"{_REST}\z)'


def field_count(record: Column) -> Column:
    """Fields of one record."""
    bare = F.when(record.contains('"'), F.regexp_replace(record, rf'(^|,)"{_REST}"', "$1")).otherwise(record)
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def _lines(spark: SparkSession, path: str) -> DataFrame:
    line = F.col("line")
    raw = spark.read.text(path, lineSep="\n").select(F.xxhash64("_metadata.file_path").alias("file"),
                                       F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))
    quoted = line.contains('"')
    return raw.select("file", "start", "line", (quoted & line.rlike(_OPENS)).alias("opens"),
                      (~quoted | line.rlike(_STAYS)).alias("stays"))


def _states(opens: np.ndarray, stays: np.ndarray, inside: bool) -> np.ndarray:
    """Inside quotes before each line and after the last, from the state before the first."""
    fixed = opens == stays
    last = np.maximum.accumulate(np.where(fixed, np.arange(len(opens)), -1))
    swaps = np.cumsum(opens & ~stays)
    base = np.where(last >= 0, opens[last], inside)
    since = swaps - np.where(last >= 0, swaps[last], 0)
    return np.concatenate(([inside], base ^ (since % 2 == 1)))


def _runs(batch):
    """Slices of a batch that lie in one split: ((file, start), opens, stays, lines)."""
    file, start = np.asarray(batch.column("file")), np.asarray(batch.column("start"))
    opens, stays = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("opens", "stays"))
    cut = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1
    for lo, hi in zip(np.concatenate(([0], cut)), np.append(cut, len(file)), strict=True):
        if lo < hi:
            lines = batch.column("line").slice(lo, hi - lo) if "line" in batch.schema.names else None
            yield (int(file[lo]), int(start[lo])), opens[lo:hi], stays[lo:hi], lines


def _steps(batches):
    """One row per split: where it ends when it starts outside, and inside, of quotes."""
    now, ends = None, [False, True]

    def row():
        return pa.record_batch({"file": pa.array([now[0]]), "start": pa.array([now[1]]), "outside": [ends[0]], "inside": [ends[1]]})
    for b in batches:
        for key, opens, stays, _ in _runs(b):
            if key != now:
                if now:
                    yield row()
                now, ends = key, [False, True]
            ends = [bool(_states(opens, stays, e)[-1]) for e in ends]
    if now:
        yield row()


_RECORD = "file long, start long, kind int, head boolean, record string"
WHOLE, FIRST, MIDDLE, LAST = 0, 1, 2, 3


def _assemble(splits, header: bool):
    """Records of each split; what crosses splits comes as its first, middle and last parts."""
    def run(batches):
        known = splits.value
        now, held, kind, head = None, [], WHOLE, False

        def rows(kinds, heads, records):
            n = len(records)
            return pa.record_batch({"file": pa.array([now[0]] * n, pa.int64()), "start": pa.array([now[1]] * n, pa.int64()),
                                    "kind": pa.array(kinds, pa.int32()), "head": pa.array(heads, pa.bool_()), "record": records})

        def rest():
            if held:
                yield rows([FIRST if kind == WHOLE else MIDDLE], [head], pa.array(["\n".join(held)], pa.string()))
        for b in batches:
            for key, opens, stays, lines in _runs(b):
                if key != now:
                    if now:
                        yield from rest()
                    now, held, inside = key, [], known[key]
                    kind, head = LAST if inside else WHOLE, header and key[1] == 0 and not inside
                state = _states(opens, stays, inside)
                inside = bool(state[-1])
                begins = np.flatnonzero(~state[:-1])
                cut = int(begins[0]) if len(begins) else len(lines)
                if cut or held:                              # lines of a record that is open
                    held += lines.slice(0, cut).to_pylist()
                    if not len(begins) and inside:
                        continue
                    yield rows([kind], [head], pa.array(["\n".join(held)], pa.string()))
                    head = head and not "".join(held).strip()
                    held, kind = [], WHOLE
                    if not len(begins):
                        continue
                ends = np.append(begins, len(lines)).astype(np.int32)
                if inside:                                   # the last record goes on
                    held = lines.slice(int(begins[-1])).to_pylist()
                    ends = ends[:-1]
                if len(ends) > 1:
                    records = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), lines), "\n")
                    heads = np.zeros(len(records), dtype=bool)
                    if head:
                        text = np.flatnonzero(np.asarray(pc.utf8_length(pc.utf8_trim_whitespace(records))) > 0)
                        heads[:int(text[0]) + 1 if len(text) else 0] = True
                        head = not len(text)
                    yield rows([WHOLE] * len(records), heads, records)
        if now:
            yield from rest()
    return run


@dataclass
class Shape:
    """What one pass over the lines of a table tells: is all text UTF-8, does any field hold a line break, how many
    fields has the longest line."""

    valid: bool
    crosses: bool
    fields: int


def shape(spark: SparkSession, path: str) -> Shape:
    """One aggregate over all lines, each looked at by itself."""
    lines = _lines(spark, path)
    r = lines.agg(F.bool_and(F.is_valid_utf8("line")), F.bool_or(F.col("opens") | F.rtrim("line", F.lit("\r")).contains("\r")), F.max(field_count(F.col("line")))).first()
    return Shape(r[0] is not False, bool(r[1]), r[2] or 0)


def records(spark: SparkSession, path: str, header: bool) -> DataFrame:
    """One row (record) per CSV record, the header of each file left out.

    The states of the splits, one row each, go through the driver, which planned those splits.
    """
    steps = _lines(spark, path).select("file", "start", "opens", "stays").mapInArrow(
        _steps, "file long, start long, outside boolean, inside boolean")
    known, inside, file = {}, False, None
    for r in steps.orderBy("file", "start").toLocalIterator():
        if r.file != file:
            if inside:
                raise ValueError("CSV text ends inside quotes")
            file, inside = r.file, False
        known[r.file, r.start] = inside
        inside = r.inside if inside else r.outside
    if inside:
        raise ValueError("CSV text ends inside quotes")
    parts = _lines(spark, path).mapInArrow(_assemble(spark.sparkContext.broadcast(known), header), _RECORD)
    whole = parts.where((F.col("kind") == WHOLE) & ~F.col("head")).select("record")
    # a record is numbered by the split that holds its first part
    order = Window.partitionBy("file").orderBy("start", F.col("kind") == FIRST)
    crossing = parts.where(F.col("kind") != WHOLE).withColumn("of", F.sum((F.col("kind") == FIRST).cast("int")).over(order))
    joined = crossing.groupBy("file", "of").agg(F.bool_or("head").alias("head"), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("start", "record"))), lambda x: x["record"]), "\n").alias("record"))
    out = whole.union(joined.where(~F.col("head")).select("record"))
    return out.select(F.regexp_replace("record", r"\r\z", "").alias("record")).where(F.btrim("record") != "")
