import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tablescope.llm import decontaminate
from tablescope.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    wins = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[i:i + n]), set()).add(item)
    sizes = {len(k) for k in wins}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i:i + n])) in wins:
                    hit.update(range(i, i + n))
                    found |= wins[key]
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_query_equals_brute_force(spark, tables, sf):
    got = QUERIES["op10_benchmark_decontamination"](spark, sf).collect()
    want = brute([(r["doc_id"], r["text"]) for r in tables("documents")],
                 [(r["item_id"], r["text"]) for r in tables("benchmark")])
    assert sorted(map(tuple, got), key=repr) == want
    assert any(r[-1] for r in want) and not all(r[-1] for r in want)


@pytest.mark.parametrize("block", [3, 1000])
def test_edge_cases_in_blocks(spark, block):
    long = " ".join(f"w{i}" for i in range(30))
    items = [(1, long), (2, "Short Item"), (3, None), (4, ""), (5, long), (None, "null id item"), (6, "one")]
    docs = [(1, "x " + " ".join(f"W{i}" for i in range(5, 17)) + " y"), (2, None), (3, ""), (4, "a short-item b"),
            (None, "null id item"), (5, "shortitem"), (6, "one"), (6, "one"), (7, "éa " * 50000 + long), (8, "w1 w2 w3")]
    d = spark.createDataFrame([(i, t, 1, "z") for i, t in docs], "doc_id long, text string, n_words int, row string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.mark(d, b, block_windows=block).select("row.doc_id", "n_words", "n_hit", "items")
    got = [(r[0], r[1], r[2], len(r[3]), hashlib.sha256(",".join(r[3]).encode()).hexdigest(), r[2] > 0) for r in got.collect()]
    assert sorted(got, key=repr) == brute(docs, items)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.mark(d.limit(0), b).count() == 0
    assert decontaminate.mark(d, b.limit(0)).select("n_words", "n_hit", F.size("items")).collect()[0] == (2, 0, 0)
