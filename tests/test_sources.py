import json
import os

import pytest

from tablescope.sources import tables as S
from tablescope.sources.json_records import parse_json_column, read_json_records


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_csv_na_words_and_types(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "t.csv"), "a,b,c,d,e\n1,1.5,x,True,NA\n2,NA,y,false,\nNA,3,n/a,TRUE,\n")
    df = S.read_table(spark, p)
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "string", "d": "boolean", "e": "double"}
    rows = [tuple(r) for r in df.orderBy("b").collect()]
    assert (None, 3.0, None, True, None) in rows and (2, None, "y", False, None) in rows


def test_unsupported_suffix(spark, tmp_dir):
    with pytest.raises(ValueError):
        S.read_table(spark, os.path.join(tmp_dir, "x.xlsx"))


def test_validate(spark):
    empty = spark.createDataFrame([], "a int, b int")
    one = spark.createDataFrame([(1,)], "a int")
    ok = {r["check"]: r["ok"] for r in S.validate(empty).collect()}
    assert ok == {"non_empty": False, "min_columns": True}
    ok = {r["check"]: r["ok"] for r in S.validate(one).collect()}
    assert ok == {"non_empty": True, "min_columns": False}


def test_csv_round_trip(spark, tmp_dir):
    df = spark.createDataFrame([(1, "a", 2.5), (2, "b", None)], "k bigint, s string, v double")
    out = S.write_csv(df, os.path.join(tmp_dir, "out"))
    back = S.read_table(spark, out, fmt="csv")
    assert sorted(map(tuple, back.collect()), key=lambda r: r[0]) == [(1, "a", 2.5), (2, "b", None)]


@pytest.mark.parametrize("payload,rows,cols", [
    ([{"id": 1, "a": {"b": 2}}, {"id": 2, "a": {"b": 3}}], 2, {"id", "a.b"}),
    ({"data": [{"x": 1}, {"x": 2}], "meta": {"n": 2}}, 2, {"x"}),
    ({"results": [{"x": 1}]}, 1, {"x"}),
    ({"data": {"x": 1}}, 1, {"x"}),
    ({"x": 1, "y": {"z": 2}}, 1, {"x", "y.z"}),
    ({"id": 1, "c": [1, 2]}, 1, {"id", "c"}),
])
def test_json_shapes(spark, tmp_dir, payload, rows, cols):
    p = _write(os.path.join(tmp_dir, "p.json"), json.dumps(payload))
    df = read_json_records(spark, p)
    assert df.count() == rows and set(df.columns) == cols
    if "c" in cols:
        assert df.first()["c"] == [1, 2]


def test_json_scalar_refused(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "s.json"), "3")
    with pytest.raises(Exception):
        read_json_records(spark, p).collect()


def test_parse_json_column_merges_keys(spark):
    df = spark.createDataFrame([(1, '{"k": 1}'), (2, '{"k": 2, "m": {"n": "x"}}')], "id int, props string")
    out = parse_json_column(df, "props")
    assert set(out.columns) == {"id", "props.k", "props.m.n"}
    assert {tuple(r) for r in out.collect()} == {(1, 1, None), (2, 2, "x")}


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "v double")
    assert S.normalize_nan(df).where("v IS NULL").count() == 1
