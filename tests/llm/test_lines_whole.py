"""Line dedup against an alignment of every pair of documents, whatever lines they share."""

import hashlib
import random

from tablescope.llm import lines
from .test_lines import brute as every_pair


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lines.remove_common_lines(df, **options).select("row.doc_id", "n_lines", "n_removed", "kept").collect()
    return sorted((a, b, c, hashlib.sha256(t.encode()).hexdigest()) for a, b, c, t in got)


def test_block_of_lines_with_different_first_holders(spark):
    one, two = "x" * 25, "y" * 25
    rows = [(1, f"{one}\nfirst"), (2, f"own\n{one}\n{two}\nend"), (3, f"other\n{one}\n{two}\nlast")]
    rows += [(10 + i, f"{i}\n{one}") for i in range(20)]
    got = found(spark, rows)
    assert got == every_pair(rows)
    assert {r[0]: r[2] for r in got}[3] == 2


def test_outcome_of_a_pair_does_not_depend_on_other_holders(spark):
    line = "this line stands in many of the documents here"
    for more in (0, 40):
        # the first holders have the line twice, which patience does not align; the one before the last has it once
        rows = [(i, f"{i} a\n{line}\n{i} b\n{line}\n{i} c") for i in range(more + 3)]
        rows += [(900, f"p\n{line}\nq"), (901, f"r\n{line}\ns")]
        got = found(spark, rows)
        assert got == every_pair(rows)
        assert got[-1][2] == 1


def test_repeated_short_lines(spark):
    # the lines that start alike, and the lines that end alike with the empty one after them
    rows = [(1, "a\n" * 3000), (2, "a\n" * 3001), (3, "b\n" + "a\n" * 50)]
    assert [r[2] for r in found(spark, rows)] == [0, 3000, 51]


def test_random_texts(spark):
    for seed in range(4):
        r = random.Random(seed)
        pool = ["", "", " ", "a", "bb", "ccc c", *(f"{'z' * r.randrange(1, 9)}{i}" for i in range(14))]
        rows = [(r.randrange(60), "\n".join(r.choice(pool) if r.random() < 0.8 else f"u{r.random()}" for _ in range(r.randrange(14)))) for _ in range(90)]
        assert found(spark, rows, block_chars=8) == every_pair(rows, least=8)
