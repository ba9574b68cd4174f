import __spark_entry__ as entry
import corpus_pipeline
from tablescope.llm import decontaminate
from .test_decontaminate import brute as brute_windows
from .test_lines import brute as brute_lines
from .test_near_text import brute_groups
from .test_packing import check, library_ids

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark, tmp_dir):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.dtypes
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_dir}/{name}")
        out = spark.read.parquet(f"{tmp_dir}/{name}")
        if name != "pack":
            assert out.dtypes == columns
            after = {r.doc_id: r for r in out.collect()}
            assert set(after) <= set(before) and out.count() == len(after)
            gone = set(before) - set(after)
        if name == "quality":
            known = [i for i in before if i in labels]
            assert sum((i in after) == (labels[i] == 1) for i in known) > 0.97 * len(known)
            assert all(after[i] == before[i] for i in after)
        elif name == "line_dedup":
            want = {d: (n, cut) for d, n, cut, _ in brute_lines([(r.doc_id, r.text) for r in before.values()])}
            assert gone == {d for d, (n, cut) in want.items() if n == cut}
            assert all(len((r.text or "").split("\n")) == want[i][0] - want[i][1] and r.n_chars == len(r.text) for i, r in after.items())
        elif name == "near_dedup":
            group = brute_groups([(r.doc_id, r.text) for r in before.values()])
            roots = {i for i, g in group.items() if i == g}
            assert roots <= set(after) and len(after) <= 1.01 * len(roots)
        elif name == "decontaminate":
            want = {r[0]: r[5] for r in brute_windows([(r.doc_id, r.text) for r in before.values()], items)}
            assert gone == {i for i, hit in want.items() if hit} and gone
        else:
            ids = dict(zip(before, library_ids([r.text for r in before.values()]), strict=True))
            check(out.collect(), ids)
            break
        docs, before = out, after


def test_run_and_registration(spark, sf):
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert "pipeline" not in entry.oracle_sql()
    rows = corpus_pipeline.run(spark, sf)
    assert rows.count() > 0 and {"doc_id", "sequence_id", "ids"} <= set(rows.columns)
    numbers = sorted(int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op"))
    assert numbers == list(range(1, 14))


def test_stages_on_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some text here", "en", None, 3), (3, "same words again " * 30, "en", "s", 1),
            (3, "same words again " * 30, "en", "s", 1), (4, "x" * 50_000, "de", "s", 5)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES[1:]:
            out = stage(spark, docs, "/root/testdata/sf0.001")
            assert out.count() >= 0
    assert decontaminate.mark(docs, docs.select("doc_id", "text").withColumnRenamed("doc_id", "item_id")).count() == 0
