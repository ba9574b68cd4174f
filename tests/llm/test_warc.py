import hashlib

import pytest

from tablescope.llm import warc
from tablescope.llm.queries import QUERIES


def brute(rows):
    body = [(i, (t or "").encode()) for i, t in rows]
    best = {}
    for i, b in body:
        if len(b) >= 1000 and i is not None:
            best[b] = max(best.get(b, i), i)
    out = []
    for i, b in body:
        ref = best.get(b) if i is not None and best.get(b, i) > i else None
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "response" if ref is None else "revisit", ref))
    return sorted(out, key=repr)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = QUERIES["op4_seekable_warc"](spark, sf).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


@pytest.mark.parametrize("frame, bundle", [(1, 1), (5000, 20_000), (1 << 20, 1 << 20)])
def test_edges_round_trip_and_seek(spark, tmp_dir, frame, bundle):
    big = "<p>é\r\n\r\nWARC/1.1</p>" * 100
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, None), (4, "x y\r\nz", ""), (None, "u", big), (5, "http://c", "small"),
            (6, "http://d", "small"), (7, "", "y" * 400_000), (7, "", "y" * 400_000), (8, "e", big), (8, "e", big), (9, "", "x" * 1000), (10, "", "x" * 1000)]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, digest string, size int").repartition(2)
    folder, index = warc.write_archives(df, f"{tmp_dir}/w{frame}", frame, bundle)
    records = warc.read_archives(folder, index).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records), key=repr)
    assert got == brute([(i, t) for i, _, t in rows])
    html = {(i, (t or "").encode()) for i, _, t in rows}
    assert all((r.page_id, bytes(r.payload)) in html for r in records if r.record_type == "response")
    assert index.count() == len(rows)
    for e in index.collect():
        (_, size, head, _), = warc.parse_records(warc.read_one(folder, e))
        assert size == e.record_size and head["WARC-Record-ID"] == f"<urn:page:{'none' if e.page_id is None else e.page_id}>"


def test_empty_and_stray_files(spark, tmp_dir):
    df = spark.createDataFrame([(1, "u", "t")], "page_id long, url string, html string")
    folder, index = warc.write_archives(df.limit(0), f"{tmp_dir}/none")
    assert warc.read_archives(folder, index).count() == 0
    folder, index = warc.write_archives(df, f"{tmp_dir}/some")
    with open(f"{folder}/data/part-99999-left-by-a-lost-task.warc.zst", "wb") as f:
        f.write(b"cut off")
    assert warc.read_archives(folder, index).count() == 1
