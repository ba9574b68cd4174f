"""Registered cleaning queries (P1-P10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescope.functions.binning import cut, cut_ordinal
from tablescope.functions.text import title_case
from tablescope.functions.values import map_values, round_cols
from tablescope.operators import clean as C
from tablescope.plans.catalog import table
from tablescope.plans.registry import register, rounded
from tablescope.plans.standins import PASSENGER_BASIC_SQL, PASSENGER_SQL, passengers


@register("P1_fill_median", f"""
WITH p AS ({PASSENGER_BASIC_SQL}),
m AS (SELECT quantile_cont(age, 0.5) AS ma, quantile_cont(fare, 0.5) AS mf FROM p)
SELECT passenger_id, coalesce(age, (SELECT ma FROM m)) AS age,
       round(coalesce(fare, (SELECT mf FROM m)), 6) AS fare FROM p""")
def p1(spark, sf_dir):
    p = C.fill_median(passengers(spark, sf_dir), ["age", "fare"])
    return rounded(p.select("passenger_id", "age", "fare"), {"fare": 6})


@register("P2_fill_mode", """
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_mktsegment END AS seg FROM customer),
mo AS (SELECT seg FROM c WHERE seg IS NOT NULL GROUP BY seg ORDER BY count(*) DESC, seg LIMIT 1)
SELECT c_custkey, coalesce(seg, (SELECT seg FROM mo)) AS seg FROM c""")
def p2(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 10 == 0, F.lit(None))
        .otherwise(F.col("c_mktsegment")).alias("seg"))
    return C.fill_mode(c, ["seg"])


@register("P3_fill_mean", f"""
WITH p AS ({PASSENGER_BASIC_SQL})
SELECT passenger_id, round(coalesce(age, (SELECT avg(age) FROM p)), 6) AS age,
       round(coalesce(fare, (SELECT avg(fare) FROM p)), 6) AS fare FROM p""")
def p3(spark, sf_dir):
    p = C.fill_mean(passengers(spark, sf_dir), ["age", "fare"])
    return rounded(p.select("passenger_id", "age", "fare"), {"age": 6, "fare": 6})


def _right_cut_sql(col, edges, labels):
    whens = " ".join(f"WHEN {col} > {lo} AND {col} <= {hi} THEN '{lab}'"
                     for lo, hi, lab in zip(edges[:-1], edges[1:], labels))
    return f"CASE {whens} END"


def _right_ord_sql(col, edges):
    whens = " ".join(f"WHEN {col} > {lo} AND {col} <= {hi} THEN {i}"
                     for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])))
    return f"CASE {whens} END"


@register("P4_cut_right", f"""
WITH p AS ({PASSENGER_BASIC_SQL})
SELECT passenger_id, {_right_cut_sql("age", C.AGE_BINS, C.AGE_LABELS)} AS age_group,
       {_right_ord_sql("age", C.AGE_BINS)} AS age_group_ordinal,
       {_right_cut_sql("fare", C.FARE_BINS, C.FARE_LABELS)} AS fare_category,
       {_right_cut_sql("sibsp + parch + 1", C.FAMILY_BINS, C.FAMILY_LABELS)} AS family_category
FROM p""")
def p4(spark, sf_dir):
    p = passengers(spark, sf_dir)
    return p.select("passenger_id",
                    cut("age", C.AGE_BINS, C.AGE_LABELS).alias("age_group"),
                    cut_ordinal("age", C.AGE_BINS).alias("age_group_ordinal"),
                    cut("fare", C.FARE_BINS, C.FARE_LABELS).alias("fare_category"),
                    cut(F.col("sibsp") + F.col("parch") + 1, C.FAMILY_BINS, C.FAMILY_LABELS)
                    .alias("family_category"))


@register("P5_cut_left", f"""
WITH p AS ({PASSENGER_BASIC_SQL})
SELECT passenger_id, CASE """ + " ".join(
    f"WHEN age >= {lo} AND age < {lo + 10} THEN '[{lo}, {lo + 10})'" for lo in range(0, 80, 10))
    + " END AS age_bin FROM p")
def p5(spark, sf_dir):
    p = passengers(spark, sf_dir)
    return p.select("passenger_id", cut("age", C.AGE_DECADE_BINS, right=False).alias("age_bin"))


@register("P6_family_size", f"""
WITH p AS ({PASSENGER_BASIC_SQL}) SELECT passenger_id, sibsp + parch + 1 AS family_size FROM p""")
def p6(spark, sf_dir):
    return C.family_size(passengers(spark, sf_dir)).select("passenger_id", "family_size")


@register("P7_map_values", """
SELECT doc_id, CASE quality WHEN 0 THEN 'Did Not Survive' WHEN 1 THEN 'Survived' END AS survival_status
FROM labels""")
def p7(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    return lab.select("doc_id", map_values("quality", C.SURVIVAL_LABELS).alias("survival_status"))


@register("P8_title_case", """
SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(p_name, '([A-Za-z]+|[^A-Za-z]+)'),
       lambda t: upper(t[1]) || lower(t[2:])), '') AS p_name_title,
       upper(c[1]) || lower(c[2:]) AS p_type_title
FROM (SELECT p_partkey, p_name, p_type AS c FROM part)""")
def p8(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", title_case("p_name").alias("p_name_title"),
                       title_case("p_type").alias("p_type_title"))


@register("P9_clean", f"""
WITH p AS ({PASSENGER_SQL}),
m AS (SELECT quantile_cont(age, 0.5) AS ma, quantile_cont(fare, 0.5) AS mf FROM p),
mo AS (SELECT embarked AS me FROM p WHERE embarked IS NOT NULL GROUP BY embarked ORDER BY count(*) DESC, embarked LIMIT 1),
f AS (SELECT passenger_id, survived, pclass, sex, coalesce(age, (SELECT ma FROM m)) AS age, sibsp, parch,
             coalesce(fare, (SELECT mf FROM m)) AS fare, coalesce(embarked, (SELECT me FROM mo)) AS embarked, class
      FROM p)
SELECT passenger_id, survived, pclass, sex, age, sibsp, parch, round(fare, 6) AS fare, embarked, class,
       {_right_cut_sql("age", C.AGE_BINS, C.AGE_LABELS)} AS age_group,
       {_right_cut_sql("fare", C.FARE_BINS, C.FARE_LABELS)} AS fare_category,
       sibsp + parch + 1 AS family_size,
       {_right_cut_sql("sibsp + parch + 1", C.FAMILY_BINS, C.FAMILY_LABELS)} AS family_category,
       CASE survived WHEN 0 THEN 'Did Not Survive' WHEN 1 THEN 'Survived' END AS survival_status,
       upper(sex[1]) || lower(sex[2:]) AS gender
FROM f""")
def p9(spark, sf_dir):
    return rounded(C.clean(passengers(spark, sf_dir, full=True)), {"fare": 6})


@register("P10_round", """
SELECT l_orderkey, l_linenumber,
       round_even(l_extendedprice / 1000, 2) AS fare_2, round_even(l_discount * l_quantity, 1) AS disc_1
FROM lineitem""")
def p10(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 1000).alias("fare_2"),
        (F.col("l_discount") * F.col("l_quantity")).alias("disc_1"))
    out = round_cols(li, 2, cols=["fare_2"])
    return round_cols(out, 1, cols=["disc_1"])
