"""Registered grouped summaries (A4-A10, A12), including the flagship outcome rate."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescope.operators import clean as C
from tablescope.operators import groups as G
from tablescope.plans.catalog import table
from tablescope.plans.registry import register, rounded
from tablescope.plans.standins import PASSENGER_BASIC_SQL, PASSENGER_SQL, passengers
from tablescope.functions.binning import cut


def _age_groups_sql(col: str = "age") -> str:
    return f"""CASE WHEN {col} > 0 AND {col} <= 12 THEN 'Child'
            WHEN {col} > 12 AND {col} <= 18 THEN 'Teen'
            WHEN {col} > 18 AND {col} <= 35 THEN 'Young Adult'
            WHEN {col} > 35 AND {col} <= 60 THEN 'Adult'
            WHEN {col} > 60 AND {col} <= 100 THEN 'Senior' END"""


def _domain_sql(name: str, labels) -> str:
    rows = ", ".join(f"('{l}', {i})" for i, l in enumerate(labels))
    return f"(VALUES {rows}) AS d({name}, {name}_ordinal)"


def flagship(spark, sf_dir):
    """Outcome rate by age group on the cleaned passenger view, empty age groups listed."""
    p = C.clean(passengers(spark, sf_dir), outputs=["age_group", "survived"])
    return rounded(G.outcome_rate(p, "age_group", "survived", labels=C.AGE_LABELS), {"rate": 6})


FLAGSHIP_SQL = f"""
WITH p AS ({PASSENGER_BASIC_SQL}),
med AS (SELECT quantile_cont(age, 0.5) AS m FROM p),
c AS (SELECT survived, {_age_groups_sql("coalesce(age, (SELECT m FROM med))")} AS age_group FROM p),
g AS (SELECT age_group, count(survived) AS total, CAST(sum(survived) AS BIGINT) AS positives,
             avg(CAST(survived AS DOUBLE)) AS rate
      FROM c WHERE age_group IS NOT NULL GROUP BY age_group)
SELECT d.age_group, d.age_group_ordinal, coalesce(g.total, 0) AS total,
       coalesce(g.positives, 0) AS positives, round(g.rate, 6) AS rate
FROM {_domain_sql("age_group", C.AGE_LABELS)} LEFT JOIN g ON d.age_group = g.age_group
"""

register("A6_outcome_rate_age_group", FLAGSHIP_SQL)(flagship)


@register("A6_outcome_rate_sex", f"""
WITH p AS ({PASSENGER_BASIC_SQL})
SELECT sex, count(survived) AS total, CAST(sum(survived) AS BIGINT) AS positives,
       round(avg(CAST(survived AS DOUBLE)), 6) AS rate
FROM p WHERE sex IS NOT NULL GROUP BY sex""")
def a6_sex(spark, sf_dir):
    return rounded(G.outcome_rate(passengers(spark, sf_dir), "sex", "survived"), {"rate": 6})


@register("A6_outcome_rate_class", f"""
WITH p AS ({PASSENGER_SQL})
SELECT class, count(survived) AS total, CAST(sum(survived) AS BIGINT) AS positives,
       round(avg(CAST(survived AS DOUBLE)), 6) AS rate
FROM p WHERE class IS NOT NULL GROUP BY class""")
def a6_class(spark, sf_dir):
    return rounded(G.outcome_rate(passengers(spark, sf_dir, full=True), "class", "survived"),
                   {"rate": 6})


@register("A6_outcome_rate_embarked", f"""
WITH p AS ({PASSENGER_SQL}),
mo AS (SELECT embarked AS m FROM p WHERE embarked IS NOT NULL GROUP BY embarked
       ORDER BY count(*) DESC, embarked LIMIT 1),
c AS (SELECT survived, coalesce(embarked, (SELECT m FROM mo)) AS embarked FROM p)
SELECT embarked, count(survived) AS total, CAST(sum(survived) AS BIGINT) AS positives,
       round(avg(CAST(survived AS DOUBLE)), 6) AS rate
FROM c WHERE embarked IS NOT NULL GROUP BY embarked""")
def a6_embarked(spark, sf_dir):
    p = C.fill_mode(passengers(spark, sf_dir, full=True), ["embarked"])
    return rounded(G.outcome_rate(p, "embarked", "survived"), {"rate": 6})


@register("A6_outcome_rate_family", f"""
WITH p AS ({PASSENGER_BASIC_SQL}),
c AS (SELECT survived, CASE WHEN sibsp + parch + 1 > 0 AND sibsp + parch + 1 <= 1 THEN 'Alone'
                            WHEN sibsp + parch + 1 > 1 AND sibsp + parch + 1 <= 4 THEN 'Small Family'
                            WHEN sibsp + parch + 1 > 4 AND sibsp + parch + 1 <= 20 THEN 'Large Family'
                       END AS family_category FROM p),
g AS (SELECT family_category, count(survived) AS total, CAST(sum(survived) AS BIGINT) AS positives,
             avg(CAST(survived AS DOUBLE)) AS rate
      FROM c WHERE family_category IS NOT NULL GROUP BY family_category)
SELECT d.family_category, d.family_category_ordinal, coalesce(g.total, 0) AS total,
       coalesce(g.positives, 0) AS positives, round(g.rate, 6) AS rate
FROM {_domain_sql("family_category", C.FAMILY_LABELS)} LEFT JOIN g
  ON d.family_category = g.family_category""")
def a6_family(spark, sf_dir):
    p = C.clean(passengers(spark, sf_dir), fill=False)
    return rounded(G.outcome_rate(p, "family_category", "survived", labels=C.FAMILY_LABELS),
                   {"rate": 6})


@register("A4_value_counts", """
SELECT o_orderpriority, count(*) AS count,
       round(count(*) * 100.0 / (SELECT count(*) FROM orders), 6) AS percent
FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority""")
def a4(spark, sf_dir):
    return rounded(G.value_counts(table(spark, sf_dir, "orders"), "o_orderpriority"), {"percent": 6})


@register("A5_binary_share", """
SELECT quality AS value,
       CASE quality WHEN 0 THEN 'Did Not Survive' WHEN 1 THEN 'Survived' END AS label,
       count(*) AS count, (SELECT count(quality) FROM labels) AS total,
       round(count(*) / (SELECT count(quality) FROM labels), 6) AS rate
FROM labels WHERE quality IS NOT NULL GROUP BY quality""")
def a5(spark, sf_dir):
    return rounded(G.binary_share(table(spark, sf_dir, "labels"), "quality"), {"rate": 6})


_AGE_BIN_LABELS = [f"[{lo}, {lo + 10})" for lo in range(0, 80, 10)]


def _age_bin_sql(col: str) -> str:
    whens = " ".join(f"WHEN {col} >= {lo} AND {col} < {lo + 10} THEN '[{lo}, {lo + 10})'"
                     for lo in range(0, 80, 10))
    return f"CASE {whens} END"


def _fare_by_age_bin(spark, sf_dir):
    p = C.clean(passengers(spark, sf_dir), outputs=["age", "fare"])
    p = p.withColumn("age_bin", cut("age", C.AGE_DECADE_BINS, right=False))
    return G.numeric_by_group(p, "age_bin", "fare", ("mean", "count", "std"), decimals=2,
                              labels=_AGE_BIN_LABELS)


_FARE_BY_AGE_BIN_SQL = f"""
WITH p AS ({PASSENGER_BASIC_SQL}),
med AS (SELECT quantile_cont(age, 0.5) AS ma, quantile_cont(fare, 0.5) AS mf FROM p),
c AS (SELECT coalesce(fare, (SELECT mf FROM med)) AS fare,
             {_age_bin_sql("coalesce(age, (SELECT ma FROM med))")} AS age_bin FROM p),
g AS (SELECT age_bin, round_even(avg(fare), 2) AS fare_mean, count(fare) AS fare_count,
             round_even(stddev_samp(fare), 2) AS fare_std
      FROM c WHERE age_bin IS NOT NULL GROUP BY age_bin)
SELECT d.age_bin, d.age_bin_ordinal, g.fare_mean, coalesce(g.fare_count, 0) AS fare_count, g.fare_std
FROM {_domain_sql("age_bin", _AGE_BIN_LABELS)} LEFT JOIN g ON d.age_bin = g.age_bin"""


@register("A7_numeric_by_group", _FARE_BY_AGE_BIN_SQL)
def a7(spark, sf_dir):
    return _fare_by_age_bin(spark, sf_dir)


@register("A8_numeric_by_outcome", f"""
WITH p AS ({PASSENGER_BASIC_SQL})
SELECT survived, round(avg(fare), 6) AS fare_mean, round(quantile_cont(fare, 0.5), 6) AS fare_median,
       round(stddev_samp(fare), 6) AS fare_std
FROM p WHERE survived IS NOT NULL GROUP BY survived""")
def a8(spark, sf_dir):
    out = G.numeric_by_group(passengers(spark, sf_dir), "survived", "fare",
                             ("mean", "median", "std"), decimals=None)
    return rounded(out, {"fare_mean": 6, "fare_median": 6, "fare_std": 6})


@register("A9_empty_bins_fare_category", f"""
WITH p AS ({PASSENGER_BASIC_SQL}),
c AS (SELECT survived, CASE WHEN fare > 0 AND fare <= 10 THEN 'Low' WHEN fare > 10 AND fare <= 30 THEN 'Medium'
                            WHEN fare > 30 AND fare <= 100 THEN 'High' WHEN fare > 100 AND fare <= 1000 THEN 'Premium'
                       END AS fare_category FROM p),
g AS (SELECT fare_category, count(survived) AS total, CAST(sum(survived) AS BIGINT) AS positives,
             avg(CAST(survived AS DOUBLE)) AS rate
      FROM c WHERE fare_category IS NOT NULL GROUP BY fare_category)
SELECT d.fare_category, d.fare_category_ordinal, coalesce(g.total, 0) AS total,
       coalesce(g.positives, 0) AS positives, round(g.rate, 6) AS rate
FROM {_domain_sql("fare_category", C.FARE_LABELS)} LEFT JOIN g ON d.fare_category = g.fare_category""")
def a9(spark, sf_dir):
    p = C.clean(passengers(spark, sf_dir), fill=False)
    return rounded(G.outcome_rate(p, "fare_category", "survived", labels=C.FARE_LABELS), {"rate": 6})


@register("A10_extremes", f"""
WITH a AS ({_FARE_BY_AGE_BIN_SQL}),
hi AS (SELECT fare_mean, age_bin FROM a WHERE fare_mean IS NOT NULL ORDER BY fare_mean DESC, age_bin DESC LIMIT 1),
lo AS (SELECT fare_mean, age_bin FROM a WHERE fare_mean IS NOT NULL ORDER BY fare_mean ASC, age_bin ASC LIMIT 1)
SELECT hi.fare_mean AS max_value, hi.age_bin AS max_key, lo.fare_mean AS min_value, lo.age_bin AS min_key
FROM hi, lo""")
def a10(spark, sf_dir):
    return G.extremes(_fare_by_age_bin(spark, sf_dir), "age_bin", "fare_mean")


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@register("A12_crosstab", "SELECT o_orderstatus, " + ", ".join(
    f"CAST(count(*) FILTER (WHERE o_orderpriority = '{v}') AS BIGINT) AS \"{v}\"" for v in _PRIORITIES)
    + " FROM orders WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY o_orderstatus")
def a12(spark, sf_dir):
    return G.crosstab(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority",
                      values=_PRIORITIES)


@register("A12_crosstab_long", """
SELECT o_orderstatus, o_orderpriority, count(*) AS count FROM orders
WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY o_orderstatus, o_orderpriority""")
def a12_long(spark, sf_dir):
    return G.crosstab_long(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")
