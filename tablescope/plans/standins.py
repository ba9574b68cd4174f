"""Stand-in views that give the driver tables the passenger-table shape.

Passenger column <- driver column (same rule in the SQL oracles, see ``PASSENGER_SQL``):

    passenger_id  l_orderkey * 10 + l_linenumber
    survived      l_returnflag = 'R' as int
    pclass        first digit of o_orderpriority            (needs orders)
    sex           l_linestatus
    age           l_quantity, null where l_orderkey % 10 = 0
    sibsp         l_linenumber
    parch         0
    fare          l_extendedprice / 1000, null where l_partkey % 7 = 0
    embarked      c_mktsegment, null where l_suppkey % 13 = 0  (needs orders, customer)
    class         o_orderpriority                           (needs orders)

The null rules inject missing values (the driver tables hold none); no row is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.plans.catalog import table

BASIC_COLUMNS = ("passenger_id", "survived", "sex", "age", "sibsp", "parch", "fare")
FULL_COLUMNS = ("passenger_id", "survived", "pclass", "sex", "age", "sibsp", "parch", "fare",
                "embarked", "class")


def passengers(spark: SparkSession, sf_dir: str, full: bool = False) -> DataFrame:
    """The passenger view over lineitem (and, with ``full``, orders and customer).

    The joins follow the foreign keys: lineitem -> orders on the order key, orders ->
    customer on the customer key. Spark shuffles both sides on the key (sort-merge join)
    or, when AQE measures one side small at run time, broadcasts it.
    """
    li = table(spark, sf_dir, "lineitem")
    cols = {
        "passenger_id": F.col("l_orderkey") * 10 + F.col("l_linenumber"),
        "survived": (F.col("l_returnflag") == "R").cast("int"),
        "sex": F.col("l_linestatus"),
        "age": F.when(F.col("l_orderkey") % 10 == 0, F.lit(None)).otherwise(F.col("l_quantity")),
        "sibsp": F.col("l_linenumber"),
        "parch": F.lit(0),
        "fare": F.when(F.col("l_partkey") % 7 == 0, F.lit(None))
                 .otherwise(F.col("l_extendedprice") / 1000),
    }
    if not full:
        return li.select(*[cols[c].alias(c) for c in BASIC_COLUMNS])
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    joined = (li.join(orders, li.l_orderkey == orders.o_orderkey)
              .join(customer, F.col("o_custkey") == customer.c_custkey))
    cols.update({
        "pclass": F.substring(F.col("o_orderpriority"), 1, 1).cast("int"),
        "embarked": F.when(F.col("l_suppkey") % 13 == 0, F.lit(None)).otherwise(F.col("c_mktsegment")),
        "class": F.col("o_orderpriority"),
    })
    return joined.select(*[cols[c].alias(c) for c in FULL_COLUMNS])


PASSENGER_BASIC_SQL = """
SELECT l_orderkey * 10 + l_linenumber AS passenger_id,
       CAST(l_returnflag = 'R' AS INTEGER) AS survived,
       l_linestatus AS sex,
       CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_quantity END AS age,
       l_linenumber AS sibsp,
       0 AS parch,
       CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_extendedprice / 1000 END AS fare
FROM lineitem
"""

PASSENGER_SQL = """
SELECT l.l_orderkey * 10 + l.l_linenumber AS passenger_id,
       CAST(l.l_returnflag = 'R' AS INTEGER) AS survived,
       CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) AS pclass,
       l.l_linestatus AS sex,
       CASE WHEN l.l_orderkey % 10 = 0 THEN NULL ELSE l.l_quantity END AS age,
       l.l_linenumber AS sibsp,
       0 AS parch,
       CASE WHEN l.l_partkey % 7 = 0 THEN NULL ELSE l.l_extendedprice / 1000 END AS fare,
       CASE WHEN l.l_suppkey % 13 = 0 THEN NULL ELSE c.c_mktsegment END AS embarked,
       o.o_orderpriority AS class
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
"""

# The default cleaning pipeline over PASSENGER_SQL (fills first, then derived columns).
CLEAN_PASSENGER_SQL = f"""
WITH p0 AS ({PASSENGER_SQL}),
m AS (SELECT quantile_cont(age, 0.5) AS ma, quantile_cont(fare, 0.5) AS mf FROM p0),
mo AS (SELECT embarked AS me FROM p0 WHERE embarked IS NOT NULL GROUP BY embarked ORDER BY count(*) DESC, embarked LIMIT 1),
f AS (SELECT passenger_id, survived, pclass, sex, coalesce(age, (SELECT ma FROM m)) AS age, sibsp, parch,
             coalesce(fare, (SELECT mf FROM m)) AS fare, coalesce(embarked, (SELECT me FROM mo)) AS embarked, class
      FROM p0)
SELECT *, sibsp + parch + 1 AS family_size FROM f
"""
