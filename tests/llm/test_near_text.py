import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tablescope.llm import near_text
from tablescope.llm.queries import QUERIES


def plain_distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def brute_groups(docs, threshold=0.8):
    """Groups by edit similarity of words, over every pair that could reach the threshold."""
    seqs = {d: (t or "").split() for d, t in docs}
    bags = {d: Counter(w) for d, w in seqs.items()}
    ids = sorted(d for d in seqs if seqs[d])
    root = {d: d for d in seqs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    by_size = sorted(ids, key=lambda d: len(seqs[d]))
    for p, a in enumerate(by_size):
        for b in by_size[p + 1:]:
            n = len(seqs[b])
            if n - len(seqs[a]) > 0.2 * n + 1e-9:
                break
            if find(a) != find(b) and sum((bags[a] & bags[b]).values()) >= threshold * n - 1e-9:
                if seqs[a] == seqs[b] or plain_distance(seqs[a], seqs[b]) <= 0.2 * n + 1e-9:
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {d: find(d) for d in seqs}


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op5_minhash_near_dedup"](spark, sf).collect()
    want = brute_groups(docs)
    found = {r["doc_id"]: r["component_id"] for r in got}
    assert all(want[d] == want[c] for d, c in found.items())               # no link that brute force lacks
    grouped = [d for d, c in want.items() if c != d]
    assert sum(found[d] == want[d] for d in grouped) >= 0.99 * len(grouped)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got) and len(got) == len(docs)
    first = {}
    for d, t in sorted(docs):
        first.setdefault(t, d)
    assert all(r["class_id"] == first[dict(docs)[r["doc_id"]]] for r in got)
    print("groups", sum(v > 1 for v in Counter(want.values()).values()))


def test_alignment_against_dynamic_programming():
    rng = random.Random(3)
    for _ in range(1500):
        a = [rng.randrange(rng.choice((3, 40))) for _ in range(rng.randrange(0, 40))]
        b = list(a) if rng.random() < 0.8 else [rng.randrange(40) for _ in range(rng.randrange(0, 40))]
        for _ in range(rng.randrange(9)):
            at = rng.randrange(len(b) + 1)
            b[at:at + rng.randrange(3)] = [rng.randrange(40) for _ in range(rng.randrange(3))]
        want = plain_distance(a, b)
        for most in (0, 1, 3, 8, 60):
            assert near_text.edit_distance(a, b, most) == min(want, most + 1)
        for share in (0.2, 0.5):
            got = near_text.compare(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64), share)
            longer = max(len(a), len(b))
            right = want / longer if a and b else 2.0
            assert got == (right if right <= share + 1e-9 else 2.0)


def test_chain_groups_and_edges(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    chain = [(10, base)]
    for i in range(11, 40):                     # a chain: neighbours are similar, the ends are not
        t = list(chain[-1][1])
        for j in range(3):
            t[(i * 37 + j) % 120] = f"x{i}"
        chain.append((i, t))
    docs = [(i, " ".join(t)) for i, t in chain]
    docs += [(1, None), (2, ""), (3, "  "), (4, "one two"), (5, "one  two"), (6, "one three"), (None, " ".join(base)),
             (50, " ".join(base)), (50, " ".join(base)), (60, "a " * 5000), (61, "a " * 5100), (62, "b" * 100_000),
             (70, "p q r s t u"), (71, "p q r s t u")]
    docs += [(100 + i, " ".join(rng.choice("abcdefghij") + str(rng.randrange(500)) for _ in range(60))) for i in range(30)]
    df = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, kept int, digest string").repartition(3)
    got = near_text.near_duplicates(df).collect()
    assert len(got) == len(docs)
    want = brute_groups([d for d in docs if d[0] is not None])
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert want[39] == 10 and want[50] == 10 and want[5] == 4 and want[61] == 60 and want[2] == 2
    assert [r["kept"] for r in got if r["doc_id"] is None] == [True]
    assert near_text.near_duplicates(df.limit(0)).count() == 0


def test_common_passage_and_large_groups(spark):
    """Texts that share little but a passage, groups of near copies among them: what elections leave is found by rare words."""
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(60)]
    docs = []
    for i in range(120):
        own = [f"w{rng.randrange(4000)}" for _ in range(70)]
        docs.append((i, [*own[:35], *passage, *own[35:]]))
    for i in range(200, 260):                   # copies of five of them, two words changed
        t = list(docs[i % 5 * 7][1])
        for _ in range(2):
            t[rng.randrange(len(t))] = f"x{rng.randrange(9)}"
        docs.append((i, t))
    docs = [(d, " ".join(t)) for d, t in docs]
    want = brute_groups(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in near_text.near_duplicates(df).collect()}
    assert got == want and len(set(want.values())) == 120
    body = spark.createDataFrame([d for d in docs if d[0] < 200] + [(d, t) for d, t in docs if d in (200, 201)], "doc long, text string")
    roles = body.select("doc", F.lit(1).alias("active"), F.col("doc").alias("g"))
    bags = body.select("doc", F.array_repeat(F.lit(0), near_text.BAG).alias("bag"))
    pairs = {tuple(r) for r in near_text.prefix_pairs(body, roles, bags, 0.8).collect()}
    assert {(0, 200), (7, 201)} <= pairs and len(pairs) < 120 * 119 / 8       # not all pairs of the passage's holders


def test_no_pair_of_high_shingle_similarity_is_missed(spark):
    """Labelled-shingle similarity 0.8 and edit similarity 0.8: one component, without exception."""
    sf = "/root/testdata/sf0.01"
    seqs = {r["doc_id"]: (r["text"] or "").split() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = {r["doc_id"]: r["component_id"] for r in QUERIES["op5_minhash_near_dedup"](spark, sf).collect()}
    sets, holders = {}, {}
    for d, w in seqs.items():
        count, sets[d] = Counter(), set()
        for i in range(len(w) - 4):
            g = tuple(w[i:i + 5])
            sets[d].add((g, count[g]))
            count[g] += 1
        for g in sets[d]:
            holders.setdefault(g, []).append(d)
    pairs = {(a, b) for own in holders.values() for i, b in enumerate(own) for a in own[:i]}
    high = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    high = [(a, b) for a, b in high if plain_distance(seqs[a], seqs[b]) <= 0.2 * max(len(seqs[a]), len(seqs[b])) + 1e-9]
    assert high and all(found[a] == found[b] for a, b in high)
    print("pairs", len(high), "not exact copies", sum(seqs[a] != seqs[b] for a, b in high))


def test_words_repeated_in_many_texts_do_not_join_once_an_occurrence(spark, monkeypatch):
    """Texts made of one word pair, over and over, and words of their own: few rows of the join, and no similar pair lost."""
    rng = random.Random(17)
    docs = []
    for i in range(80):
        own = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(25, 36))]
        docs.append((i, [*own, *["is", "on"] * rng.randrange(40, 60)]))
    for i in range(100, 130):                   # copies with a few words changed, repeated pairs dropped
        t = list(docs[i % 80][1])[:-2 * rng.randrange(6) or None]
        for _ in range(rng.randrange(12)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(9)}"
        docs.append((i, t))
    body = spark.createDataFrame([(d, " ".join(t)) for d, t in docs], "doc long, text string")
    roles = body.select("doc", F.lit(1).alias("active"), F.col("doc").alias("g"))
    bags = body.select("doc", F.array_repeat(F.lit(0), near_text.BAG).alias("bag"))
    made, first = [], near_text.first_shared
    monkeypatch.setattr(near_text, "first_shared", lambda prefix, t: made.append((prefix, first(prefix, t))) or made[-1][1])
    pairs = {tuple(r) for r in near_text.prefix_pairs(body, roles, bags, 0.8).collect()}
    similar = {(a, b) for a, x in docs for b, y in docs if a < b and len(set(x) & set(y)) > 2
               and plain_distance(x, y) <= 0.2 * max(len(x), len(y)) + 1e-9}
    assert similar <= pairs and len(similar) >= 20
    (prefix, rows), = made
    every = sum(m * (m - 1) // 2 for m, in prefix.groupBy("token").count().select("count").collect())
    assert len(pairs) <= rows.count() <= 2 * len(pairs) + 50 and rows.count() < every / 2
