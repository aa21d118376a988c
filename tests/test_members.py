import datetime as dt

import duckdb
import oracle
from conftest import rows
from pyspark.sql import functions as F

from riskflow.operators import members
from riskflow.plans import ORACLES, QUERIES
from riskflow.session import shared_folder


def test_spans_of_any_size_are_counted_exactly(spark):
    old, new = range(30_000), range(20_000, 60_000)
    given = spark.createDataFrame([(d, k) for d, keys in ((1, old), (2, new), (2, new[:9]), (4, [1])) for k in keys], "day int, who long")
    made = members.flow(given, F.col("day"), F.col("day") + 1, "who", "day")
    assert rows(made) == [(1, 0, 30_000, 0, 30_000, 0), (2, 30_000, 40_000, 10_000, 30_000, 20_000), (4, 0, 1, 0, 1, 0)]
    assert members.flow(given.limit(0), F.col("day"), F.col("day") + 1, "who").count() == 0


def test_missing_keys_are_one_member_that_never_stays(spark):
    given = spark.createDataFrame([(1, 7), (1, None), (1, None), (2, 7), (2, None), (3, None), (None, 7), (None, None)], "day int, who long")
    made = members.flow(given, F.col("day"), F.col("day") + 1, "who", "day")
    assert rows(made) == [(1, 0, 2, 0, 2, 0), (2, 2, 2, 1, 1, 1), (3, 2, 1, 0, 1, 2), (None, 0, 2, 0, 2, 0)]


def test_customer_flow_matches_sql_beyond_a_sketch(spark):
    """More customers a quarter than a sketch of 2^14 entries tells apart, and orders without customer or date."""
    sf = shared_folder(spark)
    day = F.lit(dt.datetime(1997, 1, 1)).cast("timestamp_ntz")
    orders = spark.range(120_000).select(
        F.col("id").alias("o_orderkey"),
        F.when(F.col("id") % 9973 != 0, F.col("id") % 27_000).alias("o_custkey"),
        F.lit("O").alias("o_orderstatus"),
        F.lit(100.5).alias("o_totalprice"),
        F.when(F.col("id") % 997 != 1, day + F.make_dt_interval((F.col("id") / 320).cast("int"))).alias("o_orderdate"),
        F.lit("3-MEDIUM").alias("o_orderpriority"),
    )
    orders.coalesce(1).write.parquet(f"{sf}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{sf}/orders.parquet/*.parquet')")
    assert oracle.check(QUERIES["customer_flow"](spark, sf), con, ORACLES["customer_flow"]) == []
