import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tablescope.llm import collocations
from tablescope.llm.queries import QUERIES

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, least, top=2000):
    """rows: (text, lang) -> sorted result rows."""
    f = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 6):
                f[lang if lang is not None else "und"].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        n = sum(a for p, a in count.items() if len(p) == 1)
        cand = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i:i + k]] = max(inside[p[i:i + k]], a)
        found = []
        for p, a in cand.items():
            if 100 * inside[p] >= 100 * a:
                continue
            s, k = min((1000 * a * n // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            found.append((-s, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        found.sort()
        out += [(lang, i + 1, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(found[:top])]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "text string, lang string, n int, key string").repartition(4)
    return sorted(tuple(r) for r in collocations.collocations(df, **kw).collect())


@pytest.mark.parametrize("kw", [{}, {"block_words": 7, "block_phrases": 90}, {"top": 3}])
def test_against_brute_force(spark, kw):
    rng = np.random.default_rng(1)
    words = ["a", "B", "c", "Den", "é", "ÉÉ", "x1", "y\x00", "long" * 30, "中文", " ", "f"]
    rows = []
    for i in range(150):
        text = ""
        for w in rng.zipf(1.4, 60):
            text += words[int(w) % len(words)] + " \t.,;:!?\n\r\x0b\x0c"[int(rng.choice(12, p=[.7, .1, *[.02] * 10]))]
        rows.append((text, [None, "und", "en", "de"][i % 4]))
    rows += [(None, "en"), ("", "en"), (" \t\n..", "fr"), (rows[0][0], rows[0][1]), (rows[0][0], rows[0][1]), ("a b a b a b " * 2000, "en")]
    assert run(spark, rows, least=6, **kw) == brute(rows, 6, kw.get("top", 2000))


def test_edges(spark):
    assert run(spark, []) == []
    assert run(spark, [("a b c", "en")] * 99) == []
    assert run(spark, [(None, None), ("", None)]) == []
    assert run(spark, [("a b. c", "en")] * 100) == [("en", 1, "a b", 100, 100, 100, 300, 3000)]


def test_query_on_repeated_texts(spark, tables, tmp_dir):
    rows = [(r["text"], r["lang"]) for r in tables("documents")]
    rows = rows * 4
    spark.createDataFrame(rows, "text string, lang string").write.parquet(f"{tmp_dir}/documents.parquet")
    got = sorted(tuple(r) for r in QUERIES["op11_phrase_collocations"](spark, tmp_dir).collect())
    assert got == brute(rows, 100) and got


@pytest.mark.parametrize("symbols", [3, 500])
def test_double_array(symbols):
    rng = np.random.default_rng(symbols)
    for n in (1, 2, 4):
        rows = np.unique(np.minimum(rng.zipf(1.2, (3000, n)), symbols).astype(np.int32), axis=0)
        keep = np.sort(rng.choice(len(rows), max(1, len(rows) * 2 // 3), replace=False))
        trie = collocations.double_array(rows[keep])
        at = {tuple(r): i for i, r in enumerate(rows[keep].tolist())}
        flat = np.concatenate((rows.ravel(), np.zeros(5, np.int32)))
        got = trie.ends(flat, len(flat) - 5)
        assert got.tolist() == [at.get(tuple(flat[i:i + n].tolist()), -1) for i in range(len(flat) - 5)]


def test_tasks_name_no_window_that_others_have_named(spark, monkeypatch):
    """Frequent windows stand in every task; the rows that name them are about as many as the different ones."""
    rng = np.random.default_rng(5)
    rows = [(" ".join(f"w{x}" for x in rng.integers(0, 12, 40)), "en") for _ in range(1500)]
    named, emit = spark.sparkContext.accumulator(0), collocations._emit

    def counted(*args):
        run = emit(*args)

        def count(batches):
            for b in run(batches):
                named.add(b.num_rows)
                yield b
        return count
    monkeypatch.setattr(collocations, "_emit", counted)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(30)
    plain = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(64 << 20))         # a task a file
    try:
        got = sorted(tuple(r) for r in collocations.collocations(df, least=20, longest=3).collect())
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", plain)
    different = 12 * 12 + 12 ** 3
    assert [r for r in got if r[2].count(" ") < 2] and different <= named.value < 4 * different


@pytest.mark.parametrize("limits", [{"HELD_WINDOWS": 5}, {"FIRST_SHARE": 1}, {"FIRST_SHARE": 1 << 20}, {"KNOWN_TRIES": 0}])
def test_candidates_are_whole_at_any_limit(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(collocations, k, v)
    rng = np.random.default_rng(6)
    rows = [(" ".join(f"w{x}" for x in rng.integers(0, 4, 20)), ["en", "de"][i % 2]) for i in range(60)]
    assert run(spark, rows, least=6) == brute(rows, 6)


def test_filter_grows_with_the_windows(spark, monkeypatch):
    """More windows than a filter of 2^22 buckets can tell apart: those named stay few, the counts are exact."""
    rng = np.random.default_rng(7)
    words, ids = 60_000, rng.integers(0, 60_000, (600, 10_000))
    named, emit = spark.sparkContext.accumulator(0), collocations._emit

    def counted(*args):
        run = emit(*args)

        def count(batches):
            for b in run(batches):
                named.add(b.num_rows)
                yield b
        return count
    monkeypatch.setattr(collocations, "_emit", counted)
    spell = np.array([f"w{i}" for i in range(words)], dtype=object)
    df = spark.createDataFrame([(" ".join(spell[x]), "en") for x in ids], "text string, lang string").repartition(8)
    got = {r["phrase"]: r["a"] for r in collocations.collocations(df, least=2, longest=2, top=ids.size).collect()}
    pair, a = np.unique(ids[:, :-1] * words + ids[:, 1:], return_counts=True)
    want = {f"w{p // words} w{p % words}": int(n) for p, n in zip(pair[a > 1], a[a > 1])}
    assert got == want and len(want) > 1000
    assert named.value < ids.size // 20
