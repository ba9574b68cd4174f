"""Reader dialects: what pandas' readers accept, refuse and keep."""

import csv
import os

import pytest
from pyspark.sql import functions as F

from tablescope.operators.filters import Range
from tablescope.sources import tables as S


def put(tmp_dir, name, data):
    path = f"{tmp_dir}/{name}"
    with open(path, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())
    return path


def test_csv_dialect(spark, tmp_dir):
    df = S.read_table(spark, put(tmp_dir, "a.csv", 'a.b,c d,n\n"say ""hi"", ok",1D,1\n"two\nlines",2F,\nshort\n'))
    assert df.dtypes == [("a.b", "string"), ("c d", "string"), ("n", "bigint")]
    assert sorted(map(tuple, df.collect()), key=str) == [('say "hi", ok', "1D", 1), ("short", None, None), ("two\nlines", "2F", None)]
    with pytest.raises(Exception, match="more fields"):
        S.read_table(spark, put(tmp_dir, "b.csv", "a,b\n1,2\n3,4,5\n")).collect()
    with pytest.raises(Exception, match="UTF-8"):
        S.read_table(spark, put(tmp_dir, "c.csv", b"a,b\nx,\xff\xfe\n")).collect()
    empty = S.read_table(spark, put(tmp_dir, "d.csv", ""))
    assert empty.columns == [] and [r.ok for r in S.validate(empty).collect()] == [False, False]
    typed = S.read_table(spark, put(tmp_dir, "e.csv", "x,y\n1,1e3\nNA,2D\n"), schema="x int, y double")
    assert sorted(map(tuple, typed.collect()), key=str) == [(1, 1000.0), (None, None)]
    S.write_csv(df, f"{tmp_dir}/back")
    assert sorted(S.read_table(spark, f"{tmp_dir}/back", fmt="csv").collect(), key=str) == sorted(df.collect(), key=str)


def test_json(spark, tmp_dir):
    lines = S.read_table(spark, put(tmp_dir, "a.jsonl", '{"id":1,"a":{"b":2.5}}\n{"id":2}\n{"id":3,"a":{"b":null}}\n'))
    assert lines.columns == ["a.b", "id"] and sorted((r["id"], r["a.b"]) for r in lines.collect()) == [(1, 2.5), (2, None), (3, None)]
    one = S.read_table(spark, put(tmp_dir, "b.json", '[{"id":1,"a":{"b":2.5}},\n {"id":2}]'))
    assert sorted((r["id"], r["a.b"]) for r in one.collect()) == [(1, 2.5), (2, None)]
    typed = S.read_table(spark, put(tmp_dir, "c.json", '{"data": [{"id": 1, "x": "y"}]}'), schema="id int, z string")
    assert typed.dtypes == [("id", "int"), ("z", "string")] and typed.collect() == [(1, None)]
    assert S.read_table(spark, put(tmp_dir, "c.jsonl", '{"id": 1}\n'), schema="id string").collect() == [("1",)]
    with pytest.raises(ValueError, match="several JSON documents"):
        S.read_table(spark, put(tmp_dir, "d.json", '{"id":1}\n{"id":2}\n'))
    for bad in ("3", ""):
        with pytest.raises(ValueError):
            S.read_table(spark, put(tmp_dir, f"bad{len(bad)}.json", bad))


def test_json_folders(spark, tmp_dir):
    """Every file of a folder holds one value; what document mode would leave out is refused."""
    def folder(name, *files):
        os.mkdir(f"{tmp_dir}/{name}")
        for i, data in enumerate(files):
            put(f"{tmp_dir}/{name}", f"{i}.json", data)
        return f"{tmp_dir}/{name}"
    whole = '{"id": 1}\n'
    bad = [whole + '{"id": 2}\n', '{\n"id": 1\n}\n{\n"id": 2\n}\n', '{"id": 1} {"id": 2}', '{"id": 1}\n3\n', '{"a": "}", "id": 1}]', '{\n"id": 1}{"id": 2\n}']
    for i, data in enumerate(bad):
        for k, files in enumerate(((whole, data), (data, whole), (data,))):
            with pytest.raises(ValueError, match="several JSON documents"):
                S.read_table(spark, folder(f"bad{i}_{k}", *files), fmt="json")
    with pytest.raises(ValueError, match="several JSON documents"):
        S.read_table(spark, folder("lists", '[{"id": 1}]', '[{"id": 2}]\n[{"id": 3}]'), fmt="json")
    with pytest.raises(ValueError, match="lists and objects"):
        S.read_table(spark, folder("mixed", whole, '[{"id": 2}]'), fmt="json")
    good = folder("good", '\ufeff{"id": 1, "t": "} ] \\" {"}', '{\n "id": 2,\n "t": "it\'s {"\n}\n\n', "{'id': 3, 't': '\"}{'}", "\n")
    assert sorted(r["id"] for r in S.read_table(spark, good, fmt="json").collect()) == [1, 2, 3]
    items = ",\n".join('{"id": %d, "t": [{"u": "]"}]}' % i for i in range(3000))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")        # files in several splits
    try:
        assert S.read_table(spark, folder("split", f"[{items}]", f"[\n{items}\n]\n"), fmt="json").count() == 6000
        with pytest.raises(ValueError, match="several JSON documents"):
            S.read_table(spark, folder("split2", f"[{items}]", f"[{items}]\n[\n{items}]\n"), fmt="json")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_parquet_nan_and_push_down(spark, tmp_dir):
    path = f"{tmp_dir}/t.parquet"
    spark.createDataFrame([(1.0, float("nan")), (20.0, 1.0), (float("nan"), 2.0)], "q double, v double").write.parquet(path)
    got = S.read_table(spark, path, filters={"q": Range(0.5, None)})
    assert sorted(map(tuple, got.collect()), key=str) == [(1.0, None), (20.0, 1.0)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(q,0.5)" in plan
    assert S.read_table(spark, path).where(F.col("q").isNull()).count() == 1


@pytest.fixture()
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "50")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_csv_split_equals_multi_line(spark, tmp_dir, small_splits):
    """Quoted line breaks, quotes in the middle of a field, records longer than several splits."""
    import random
    rng = random.Random(4)
    bits = ["a", "b c", '""', "\n", "\r\n", "\r", ",", "\n\n", "é", "12", "�", " "]
    loose = ["x", 'five" pipe', "", "7", "a b", 'tail"']
    os.mkdir(f"{tmp_dir}/many")
    for f in range(4):
        rows = ['"first\nname",n,"t"']
        for i in range(60):
            body = "".join(rng.choice(bits) for _ in range(rng.choice([0, 3, 10, 10, 400])))
            rows.append(",".join([f'"{body}"', rng.choice(loose), str(i)][:rng.choice([3, 3, 3, 2])]))
        rows += ["", "   ", '"",,"z"', '"' + "long\n" * 900 + '",,']
        put(f"{tmp_dir}/many", f"{f}.csv", rng.choice(["\n", "\r\n"]).join(rows) + rng.choice(["", "\n"]))
    got = S.read_table(spark, f"{tmp_dir}/many", fmt="csv", na_words=())
    assert got.columns == ["first\nname", "n", "t"]
    want = []
    for f in range(4):
        with open(f"{tmp_dir}/many/{f}.csv", encoding="utf-8", newline="") as text:
            rows = [r for r in csv.reader(text) if len(r) > 1 or "".join(r).strip()][1:]
        want += [tuple(x or None for x in (r + [None, None])[:3]) for r in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and len(want) == 4 * 62
    from tablescope.sources import csv_records
    assert csv_records.records(spark, f"{tmp_dir}/many", True).rdd.getNumPartitions() > 20


def test_csv_refusals(spark, tmp_dir, small_splits):
    good = S.read_table(spark, put(tmp_dir, "a.csv", 'a,b\n"� ok","x\ny"\n'))
    assert good.collect() == [("� ok", "x\ny")]
    for i, extra in enumerate(["3,4,", "5,6,,7", '"a\nb",6,']):
        with pytest.raises(Exception, match="more fields"):
            S.read_table(spark, put(tmp_dir, f"b{i}.csv", f'a,b\n1,2\n{extra}\n')).collect()
    for i, body in enumerate(['1,"x\ny,2\n', '"', '1,2\n"a""\n' + "z\n" * 900]):
        with pytest.raises(ValueError, match="inside quotes"):
            S.read_table(spark, put(tmp_dir, f"c{i}.csv", f"a,b\n{body}")).collect()
    with pytest.raises(Exception, match="UTF-8"):
        S.read_table(spark, put(tmp_dir, "d.csv", b'a,b\n"x\n\xff",2\n')).collect()


def test_large_csv_files_have_a_bounded_part_of_the_table(spark, tmp_dir):
    """A task writes four partitions whatever the size of the table, and the rows come back whole."""
    from tablescope.plans.registry import QUERIES
    rows = [(i, f'line {i}\nof "text", here', "en", i * 3, "web") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, source string")
    df.repartition(16).write.parquet(f"{tmp_dir}/documents.parquet")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "1000")
        assert spark.read.parquet(f"{tmp_dir}/documents.parquet").rdd.getNumPartitions() >= 16
        out = QUERIES["L1_csv_split"](spark, tmp_dir)
        files = out.inputFiles()
        got = sorted(map(tuple, out.collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(set(files)) >= 4
    assert got == [(d, f'{t}\n\n"{s}",\n', lang, n) for d, t, lang, n, s in rows]
