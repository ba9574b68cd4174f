import hashlib
import re

import pytest

from tablescope.llm import substring
from tablescope.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k=13):
    first = {}
    split = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - k + 1):
            key = tuple(w[i:i + k])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i:i + k])] < d:
                gone.update(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = brute(rows)
    assert sorted(map(tuple, QUERIES["op7_substring_dedup"](spark, sf_dir).collect())) == want
    assert any(r[2] for r in want)


def test_edges(spark):
    w = [f"w{i}" for i in range(60)]
    rows = [(5, " ".join(w)), (9, "x " + "\t".join(w[10:40]) + "\n y"), (9, "x " + " ".join(w[10:40]) + " y"),
            (7, " ".join(w[3:15])), (2, " ".join(w[20:33])), (8, " ".join(w)), (8, " ".join(w)), (1, None), (3, ""),
            (4, "a " * 40), (6, "a " * 300), (10, "   ".join(w[:30])), (11, " ".join(w[:30]) + " " + " ".join(w[:30])),
            (12, "é" * 100_000), (13, " ".join(w[40:53])), (14, " ".join(w[40:52]))]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, n_words int, row string").repartition(3)
    got = substring.remove_repeats(df).select("row.doc_id", "n_words", "n_removed", "kept").collect()
    got = sorted((a, b, c, hashlib.sha256(d.encode()).hexdigest()) for a, b, c, d in got)
    assert got == brute(rows)
    null_id = spark.createDataFrame([(None, " ".join(w)), (None, " ".join(w)), (1, " ".join(w))], "doc_id long, text string")
    assert sorted((r.row.doc_id or -1, r.n_removed) for r in substring.remove_repeats(null_id).collect()) == [(-1, 60), (-1, 60), (1, 0)]
    assert substring.remove_repeats(df.limit(0)).count() == 0
