import hashlib
from collections import Counter, defaultdict

from tablescope.llm import lines
from tablescope.llm.queries import QUERIES

SPACE = " \t\r\f\v"


def plain_patience(a, b):
    """Recursive textbook form."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    if head or tail:
        inner = plain_patience(a[head:len(a) - tail], b[head:len(b) - tail])
        return ([(i, i) for i in range(head)] + [(i + head, j + head) for i, j in inner]
                + [(len(a) - i, len(b) - i) for i in range(tail, 0, -1)])
    if not a or not b:
        return []
    ca, cb = Counter(a), Counter(b)
    pairs = [(i, b.index(x)) for i, x in enumerate(a) if ca[x] == 1 and cb[x] == 1]
    best = []

    def rank(chain):                  # ties: the one that ends first in b
        return len(chain), -chain[-1][1]
    for p in range(len(pairs)):
        prev = max((c for c in best if c[-1][1] < pairs[p][1]), key=rank, default=[])
        best.append([*prev, pairs[p]])
    chain = max(best, key=rank, default=[])
    if not chain:
        return []
    out, x0, y0 = list(chain), 0, 0
    for x, y in [*chain, (len(a), len(b))]:
        out += [(i + x0, j + y0) for i, j in plain_patience(a[x0:x], b[y0:y])]
        x0, y0 = x + 1, y + 1
    return sorted(out)


def brute(rows, least=40):
    """doc_id, n_lines, n_removed, digest of what is kept; only pairs without a common line are left out."""
    split = [(d, t or "", (t or "").split("\n")) for d, t in rows]
    first_text = {}
    for d, t, _ in split:
        first_text[t] = min(first_text.get(t, d), d)
    texts = {(d, t): [x.strip(SPACE) for x in ls] for d, t, ls in split if first_text[t] == d}
    holders = defaultdict(set)
    for key, ls in texts.items():
        for x in filter(None, ls):
            holders[x].add(key)
    gone = defaultdict(set)
    for d, ls in texts.items():
        for e in {e for x in set(ls) for e in holders.get(x, ()) if e[0] < d[0]}:
            run = []
            for p in [*plain_patience(ls, texts[e]), (-9, -9)]:
                if run and p == (run[-1][0] + 1, run[-1][1] + 1):
                    run.append(p)
                    continue
                if run and sum(len(ls[i]) for i, _ in run) >= least:
                    gone[d].update(i for i, _ in run)
                run = [p]
    out = []
    for d, t, ls in split:
        cut = gone[d, t] if first_text[t] == d else (set(range(len(ls))) if any(x.strip(SPACE) for x in ls) else set())
        kept = "\n".join(x for i, x in enumerate(ls) if i not in cut)
        out.append((d, len(ls), len(cut), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(rows)
    assert sorted(map(tuple, QUERIES["op8_line_dedup"](spark, sf).collect())) == want
    assert any(0 < r[2] < r[1] for r in want)


def test_edges(spark):
    long = [f"this is line number {i} of the shared passage" for i in range(12)]
    notice = "Licensed under the terms of a well known public licence, see the file"
    rows = [(1, "\n".join(long)), (2, "own start\n" + "\n".join(long[3:8]) + "\nown end"), (3, "\n".join(long)), (3, "\n".join(long)),
            (4, None), (5, ""), (6, "\n\n"), (7, "\n\n"), (8, "short\nlines"), (9, "short\nlines too"),
            (10, "\n".join(reversed(long))), (11, "a\n" * 3000), (12, "a\n" * 3001), (13, "x" * 100_000),
            *((100 + i, f"text {i} is its own thing here\n{notice}\nand ends as {i}") for i in range(20)),
            (2, "\r\n".join(long[:4]))]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, n_lines int, e string").repartition(3)
    got = lines.remove_common_lines(df).select("row.doc_id", "n_lines", "n_removed", "kept").collect()
    got = sorted((a, b, c, hashlib.sha256(t.encode()).hexdigest()) for a, b, c, t in got)
    assert got == brute(rows)
    by = {r[0]: r for r in got}
    assert by[3][2] == 12 and by[7][2] == 0 and by[9][2] == 0 and by[119][2] == 1 and by[100][2] == 0
    none = spark.createDataFrame([(None, "\n".join(long)), (None, "\n".join(long)), (1, "\n".join(long))], "doc_id long, text string")
    assert sorted((r.row.doc_id or -1, r.n_removed) for r in lines.remove_common_lines(none).collect()) == [(-1, 12), (-1, 12), (1, 0)]
    assert lines.remove_common_lines(df.limit(0)).count() == 0
