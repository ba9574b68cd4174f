"""The same operators on the other driver tables (text, events, conversations)."""

from __future__ import annotations

from tablescope.operators import charts as CH
from tablescope.operators import filters as FL
from tablescope.operators import groups as G
from tablescope.operators import profile as PR
from tablescope.plans.catalog import table
from tablescope.plans.q_stats import hist_sql
from tablescope.plans.registry import register, rounded

_DOC_COLS = ["doc_id", "text", "lang", "source", "n_chars"]


@register("A2_missing_profile_documents", "SELECT * FROM (VALUES " + ", ".join(
    f"('{c}', {i}, (SELECT count(*) FROM documents WHERE {c} IS NULL), "
    f"round((SELECT count(*) FROM documents WHERE {c} IS NULL) * 100.0 / (SELECT count(*) FROM documents), 6))"
    for i, c in enumerate(_DOC_COLS)) + ") AS t(\"column\", position, missing_count, missing_pct)")
def a2_docs(spark, sf_dir):
    return rounded(PR.missing_profile(table(spark, sf_dir, "documents")), {"missing_pct": 6})


@register("A4_value_counts_conversations_role", """
SELECT role, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM conversations), 6) AS percent
FROM conversations WHERE role IS NOT NULL GROUP BY role""")
def a4_conv(spark, sf_dir):
    return rounded(G.value_counts(table(spark, sf_dir, "conversations"), "role"), {"percent": 6})


@register("A11_cardinality_events", "SELECT * FROM (VALUES " + ", ".join(
    f"('{c}', {i}, (SELECT count(DISTINCT {c}) FROM events))" for i, c in enumerate(["event_id", "user_id", "value"]))
    + ") AS t(\"column\", position, n_distinct)")
def a11_events(spark, sf_dir):
    return PR.cardinality(table(spark, sf_dir, "events"))


@register("C3_histogram_documents_n_chars", hist_sql("documents", "n_chars", 20))
def c3_docs(spark, sf_dir):
    return rounded(CH.histogram(table(spark, sf_dir, "documents"), "n_chars", 20), {"bin_lo": 6, "bin_hi": 6})


@register("F3_filter_domains_documents", """
WITH pairs AS (""" + "\nUNION ALL\n".join(
    f"SELECT DISTINCT {i} AS position, '{c}' AS \"column\", {c} AS value FROM documents WHERE {c} IS NOT NULL"
    for i, c in enumerate(["text", "lang", "source"])) + """)
SELECT "column", position, value, value_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY position ORDER BY value) AS value_rank FROM pairs)
WHERE value_rank <= 20""")
def f3_docs(spark, sf_dir):
    return FL.filter_domains_categorical(table(spark, sf_dir, "documents"))


@register("A6_outcome_rate_labels_by_lang", """
SELECT d.lang, count(l.quality) AS total, CAST(sum(l.quality) AS BIGINT) AS positives,
       round(avg(CAST(l.quality AS DOUBLE)), 6) AS rate
FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE d.lang IS NOT NULL GROUP BY d.lang""")
def a6_labels(spark, sf_dir):
    """Quality rate per language: labels joined to documents on doc_id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    joined = table(spark, sf_dir, "labels").join(docs, "doc_id")
    return rounded(G.outcome_rate(joined, "lang", "quality"), {"rate": 6})
