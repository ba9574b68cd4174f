import zlib
from collections import defaultdict

import numpy as np
import pytest

from tablescope.llm import packing
from tablescope.llm.queries import QUERIES, tokenizer_path


def library_ids(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path())
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], dtype="<u4") for x in texts]


def check(rows, docs):
    """docs: doc_id -> ids. Every id in one piece, sequences gapless and without padding."""
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append(r)
    assert set(pieces) == set(docs)
    for doc, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(docs[doc])
            assert r["ids_crc32"] == zlib.crc32(docs[doc][at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(docs[doc])
    for own in seqs.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and at & (at - 1) == 0 and at == own[0]["tier"]
    return seqs


def test_query(spark, sf, tables):
    docs = tables("documents")
    ids = library_ids([r["text"] for r in docs])
    check(QUERIES["op1_hierarchical_packing"](spark, sf).collect(), {r["doc_id"]: i for r, i in zip(docs, ids, strict=True)})


@pytest.mark.parametrize("chunk", [300, 5000, 10**6])
def test_edges_and_chunks(spark, chunk):
    from pyspark.sql import functions as F
    texts = [None, "", "a", "hello <|endoftext|> world", "it's 'quoted'  \n\n  x" * 40, "word " * 9000, "é" * 3000,
             "a" * 250_000, " " * 5000, *("some text here " * n for n in range(1, 60))]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, length int, tier int").repartition(2)
    out = packing.pack(df, tokenizer_path(), chunk_tokens=chunk).withColumn("ids_crc32", F.crc32("ids")).collect()
    seqs = check(out, dict(enumerate(library_ids(texts))))
    groups = defaultdict(set)
    for own in seqs.values():
        groups[own[0]["step_group"]].add((own[0]["tier"], own[0]["sequence_id"]))
    assert all(len({t for t, _ in g}) == 1 and len(g) <= packing.GROUP for g in groups.values())


def test_repeated_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert packing.pack(df, tokenizer_path()).count() >= 3
    assert packing.pack(df.limit(0), tokenizer_path()).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, tokenizer_path(), tiers=(100, 200))
