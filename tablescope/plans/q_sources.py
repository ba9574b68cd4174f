"""Registered source, sink and validation queries (L1-L11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescope.operators import filters as FL
from tablescope.operators import profile as PR
from tablescope.plans.catalog import table
from tablescope.plans.registry import register
from tablescope.session import shared_dir
from tablescope.sources import tables as S
from tablescope.sources.json_records import parse_json_column


@register("L1_csv_scan", "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def l1(spark, sf_dir):
    """customer -> CSV in the shared folder -> read back with NA words and type decisions."""
    path = shared_dir(spark, "l1-customer-csv")
    S.write_csv(table(spark, sf_dir, "customer"), path)
    return S.read_table(spark, path, fmt="csv")


@register("L6_csv_sink", "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier")
def l6(spark, sf_dir):
    """supplier written as CSV (header, no index column) and read back."""
    path = shared_dir(spark, "l6-supplier-csv")
    S.write_csv(table(spark, sf_dir, "supplier"), path)
    return S.read_table(spark, path, fmt="csv")


@register("L3_json_flatten", """
SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS "props.k" FROM events""")
def l3(spark, sf_dir):
    """events.props (JSON text) parsed with a schema merged over all rows, flattened to props.k."""
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    return parse_json_column(ev, "props")


_TURNS_SQL = """SELECT conv_id, turn, role, text, CAST(turn AS DOUBLE) / 4 AS "at.share", conv_id + turn AS "at.sum" FROM conversations"""


def _turns(spark, sf_dir):
    """conversations with a nested object that holds a double and a whole number."""
    return table(spark, sf_dir, "conversations").select(
        F.struct("conv_id", "turn", "role", "text",
                 F.struct((F.col("turn").cast("double") / 4).alias("share"), (F.col("conv_id") + F.col("turn")).alias("sum")).alias("at")).alias("r"))


def _documents(spark, sf_dir, name, wrap):
    """JSON documents of 100 conversations each, one a file, written and read back."""
    path = shared_dir(spark, name) + ".json"
    rows = _turns(spark, sf_dir).groupBy(F.expr("r.conv_id div 100").alias("g")).agg(F.collect_list("r").alias("rows"))
    rows.select(wrap(F.to_json("rows"))).write.option("maxRecordsPerFile", 1).text(path)
    return S.read_table(spark, path).select("conv_id", "turn", "role", "text", F.col("`at.share`"), F.col("`at.sum`"))


@register("L3_json_lines", _TURNS_SQL)
def l3_lines(spark, sf_dir):
    """conversations as JSON lines with a nested object: every record comes back, flattened."""
    path = shared_dir(spark, "l3-lines") + ".jsonl"
    _turns(spark, sf_dir).select("r.*").write.json(path)
    return S.read_table(spark, path).select("conv_id", "turn", "role", "text", F.col("`at.share`"), F.col("`at.sum`"))


@register("L3_json_list", _TURNS_SQL)
def l3_list(spark, sf_dir):
    return _documents(spark, sf_dir, "l3-list", lambda j: j)


@register("L3_json_data", _TURNS_SQL)
def l3_data(spark, sf_dir):
    return _documents(spark, sf_dir, "l3-data", lambda j: F.concat(F.lit('{"data": '), j, F.lit(', "n": 1}')))


@register("L3_json_results", _TURNS_SQL)
def l3_results(spark, sf_dir):
    return _documents(spark, sf_dir, "l3-results", lambda j: F.concat(F.lit('{"count": 2, "results": '), j, F.lit("}")))


@register("L1_csv_quotes", """
SELECT doc_id, text, '"' || lang || '", "' || source || '"' AS quoted FROM documents""")
def l1_quotes(spark, sf_dir):
    """documents as CSV: line breaks, commas and doubled quotes inside fields survive the round trip."""
    path = shared_dir(spark, "l1-documents-csv")
    S.write_csv(table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.concat(F.lit('"'), "lang", F.lit('", "'), "source", F.lit('"')).alias("quoted")), path)
    return S.read_table(spark, path, fmt="csv")


@register("L1_csv_split", """
SELECT doc_id, text || chr(10) || chr(10) || '"' || source || '",' || chr(10) AS note, lang, n_chars FROM documents""")
def l1_split(spark, sf_dir):
    """documents as large CSV files (one, if the table is four partitions or fewer) with line breaks, quotes and commas in
    their fields, each file read by many tasks."""
    path = shared_dir(spark, "l1-split-csv")
    note = F.concat("text", F.lit('\n\n"'), "source", F.lit('",\n'))
    S.write_csv(table(spark, sf_dir, "documents").select("doc_id", note.alias("note"), "lang", "n_chars"), path, partitions_per_file=4)
    return S.read_table(spark, path, fmt="csv")


@register("L7_nan", """
SELECT l_orderkey, l_linenumber, l_quantity,
       CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_extendedprice END AS price
FROM lineitem WHERE l_quantity BETWEEN 10 AND 30""")
def l7_nan(spark, sf_dir):
    """lineitem with NaN in a double column, written as Parquet and read with a filter on another:
    the filter reaches the scan, NaN comes back as null."""
    path = shared_dir(spark, "l7-nan") + ".parquet"
    li = table(spark, sf_dir, "lineitem")
    price = F.when(F.col("l_partkey") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("l_extendedprice"))
    li.select("l_orderkey", "l_linenumber", "l_quantity", price.alias("price")).write.parquet(path)
    return S.read_table(spark, path, filters={"l_quantity": FL.Range(10, 30)})


@register("L4_validate", """
SELECT 'non_empty' AS "check", (SELECT count(*) FROM lineitem) > 0 AS ok,
       CASE WHEN (SELECT count(*) FROM lineitem) > 0 THEN 'table has rows' ELSE 'The uploaded file is empty' END AS detail
UNION ALL
SELECT 'min_columns', true, '11 columns'""")
def l4(spark, sf_dir):
    return S.validate(table(spark, sf_dir, "lineitem"))


@register("L7_parquet_scan", """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'""")
def l7(spark, sf_dir):
    """Parquet scan through read_table: the filter and the 4-column projection reach the scan."""
    df = S.read_table(spark, f"{sf_dir}/lineitem.parquet")
    return (df.where(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
            .select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"))


@register("L8_preview", """
SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")
def l8(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return FL.preview(o, [F.col("o_totalprice").desc(), F.col("o_orderkey")], n=10,
                      where=F.col("o_orderstatus") == "F")


@register("L8_shape", "SELECT count(*) AS rows, 6 AS columns FROM orders")
def l8_shape(spark, sf_dir):
    return FL.shape(table(spark, sf_dir, "orders"))


@register("L9_explore", """
SELECT * FROM (VALUES
 (0, 'o_orderkey', 'bigint', (SELECT count(o_orderkey) FROM orders), (SELECT count(*) FROM orders)),
 (1, 'o_custkey', 'bigint', (SELECT count(o_custkey) FROM orders), (SELECT count(*) FROM orders)),
 (2, 'o_orderstatus', 'string', (SELECT count(o_orderstatus) FROM orders), (SELECT count(*) FROM orders)),
 (3, 'o_totalprice', 'double', (SELECT count(o_totalprice) FROM orders), (SELECT count(*) FROM orders)),
 (4, 'o_orderdate', 'timestamp_ntz', (SELECT count(o_orderdate) FROM orders), (SELECT count(*) FROM orders)),
 (5, 'o_orderpriority', 'string', (SELECT count(o_orderpriority) FROM orders), (SELECT count(*) FROM orders))
) AS t(position, "column", dtype, non_null, rows)""")
def l9(spark, sf_dir):
    return PR.explore(table(spark, sf_dir, "orders"))


@register("L10_report_summary", "SELECT count(*) AS n_rows, 5 AS n_columns FROM documents")
def l10_summary(spark, sf_dir):
    return PR.report_summary(table(spark, sf_dir, "documents"))


def _cut_sql(c: str) -> str:
    return f"CASE WHEN length(CAST({c} AS VARCHAR)) > 50 THEN substr(CAST({c} AS VARCHAR), 1, 47) || '...' ELSE CAST({c} AS VARCHAR) END"


@register("L10_report_preview", "SELECT " + ", ".join(
    f"{_cut_sql(c)} AS {c}" for c in ("doc_id", "text", "lang", "source", "n_chars"))
    + " FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 5)")
def l10_preview(spark, sf_dir):
    return PR.report_preview(table(spark, sf_dir, "documents"), "doc_id", n=5)


@register("L10_truncate_all", f"SELECT doc_id, {_cut_sql('text')} AS text_cut FROM documents")
def l10_all(spark, sf_dir):
    """The 47 + '...' cut over every document (whole texts are read)."""
    from tablescope.functions.text import truncate_text
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", truncate_text("text").alias("text_cut"))


@register("L11_sample_series", """
SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position, 'o_orderkey' AS "column",
       o_orderkey AS value
FROM (SELECT o_orderdate, o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20)""")
def l11(spark, sf_dir):
    return PR.sample_series(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"], n=20)
