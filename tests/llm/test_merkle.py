import hashlib
import zlib
from collections import defaultdict

import numpy as np

from tablescope.llm import merkle
from tablescope.llm.queries import QUERIES


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes):
    """All levels of one tree, lowest first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i:i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def walk(levels, at, node):
    """(siblings, root) when the lowest node at ``at`` is replaced by ``node``."""
    proof = []
    for level in levels[:-1]:
        lo = at // 8 * 8
        run = level[lo:lo + 8]
        proof += [x for i, x in enumerate(run) if lo + i != at]
        run[at - lo] = node
        node, at = sha(*run), at // 8
    return proof, node


def brute(rows):
    """rows: (id, group, leaf, changed) -> sorted (id, leaf, subroot, root, proof, folded)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    keys = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in keys:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        trees[g] = climb([r[2] for r in groups[g]])
    top = climb([trees[g][-1][0] for g in keys])
    out = []
    for k, g in enumerate(keys):
        for i, r in enumerate(groups[g]):
            proof, node = walk(trees[g], i, r[3] or r[2])
            more, node = walk(top, k, node)
            out.append((r[0], r[2], trees[g][-1][0], top[-1][0], "".join(proof + more), node))
    return out


def order(rows):
    return sorted(rows, key=repr)


def test_states_are_sha256():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 8, 9, 64, 77):
        hexes = [hashlib.sha256(rng.bytes(9)).hexdigest() for _ in range(n)]
        level = np.frombuffer("".join(hexes).encode(), np.uint8).reshape(-1, 64)
        up, before = merkle.parents(level)
        assert [x.tobytes().decode() for x in up] == [sha(*hexes[i:i + 8]) for i in range(0, n, 8)]
        slot = np.array([min(3, n - 1)])
        new = np.frombuffer(sha("new").encode(), np.uint8).reshape(1, 64)
        got = merkle.resume(np.ascontiguousarray(before[0, slot].T), slot, np.array([min(n, 8)]), new, lambda rows, j: level[[j]])
        assert got[0].tobytes().decode() == sha(*[sha("new") if i == slot[0] else x for i, x in enumerate(hexes[:8])])


def test_trees_of_every_size(spark):
    rows, n = [], 0
    for g, size in enumerate([1, 2, 8, 9, 64, 65, 600, 4095, 4097, 4700]):
        for i in range(size):
            rows.append((n, f"g{g:02d}", sha(str(n)), sha("x", str(n)) if i % 3 == 0 else None))
            n += 1
    df = spark.createDataFrame(rows, "id long, group string, leaf string, changed string").repartition(5)
    got = [(r.id, r.leaf, r.subroot, r.root, r.proof.decode(), r.folded_root) for r in merkle.fold(merkle.build(df)).collect()]
    assert order(got) == order(brute(rows))


def test_many_groups_and_edges(spark):
    rows = [(i, f"l{i:04d}é", sha(str(i)), None) for i in range(600)]
    rows += [(None, None, sha("a"), None), (None, "", sha("b"), sha("c")), (None, "", sha("b"), sha("c")), (5, None, sha("a"), None)]
    df = spark.createDataFrame(rows, "id long, group string, leaf string, changed string")
    got = [(r.id, r.leaf, r.subroot, r.root, r.proof.decode(), r.folded_root) for r in merkle.fold(merkle.build(df)).collect()]
    assert order(got) == order(brute(rows))
    assert merkle.fold(merkle.build(df.limit(0))).collect() == []
    one = merkle.fold(merkle.build(df.filter("group = 'l0001é'"))).first()
    assert one.leaf == one.root == one.folded_root == one.subroot and one.proof == b""


def test_query_on_odd_rows(spark, tmp_dir):
    rows = [(1, "Abc É", "en", "s", 5, "x"), (2, None, None, None, None, None), (None, "", "", "", 0, "y"), (3, "A" * 100_000, "en", "s", 1, "z"),
            (3, "A" * 100_000, "en", "s", 1, "z"), (4, "lower", "de", "Quelle", 5, "x"), (30, "UPPER", "de", "s", 5, "x"), (6, "UPPER", "de", "s", 5, "x"), (7, "Upper", "de", "s", 5, "x"), (8, "UppeR", "de", "s", 5, "x"), (9, "UPP", "de", "s", 5, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, leaf string").write.parquet(f"{tmp_dir}/documents.parquet")
    leaves = []
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for i, text, lang, source, n, _ in rows:
        head = "".join(field(x) for x in (i, source, lang, n))
        hit = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        leaves.append((i, lang, sha(head + field(text)), sha(head + field(text and text.translate(low))) if hit else None))
    want = [(i, leaf, sub, root, hashlib.sha256(p.encode()).hexdigest(), f, f == root) for i, leaf, sub, root, p, f in brute(leaves)]
    got = QUERIES["op12_merkle_manifest"](spark, tmp_dir).collect()
    assert order(tuple(r) for r in got) == order(want)
    assert any(not w[-1] for w in want)
