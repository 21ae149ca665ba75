"""The driver's tables in the shapes that the queries read, in Spark and in SQL.

TR: events as tracks, one match per user, ordered by frame. MH: lineitem as match history, A against B.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match_id, frame, event_id, ts, event_type, x, y, conf, player."""
    e = table(spark, sf_dir, "events")
    y = F.get_json_object("props", "$.k").cast("int")
    frame = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    out = e.select(F.col("user_id").alias("match_id"), frame.alias("frame"), "event_id", "ts", "event_type", F.col("value").alias("x"), y.alias("y"))
    return out.withColumns({"conf": F.col("y") / 100.0, "player": (F.col("event_id") % 2).cast("int")})


TR = """tr AS (SELECT user_id AS match_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS frame, event_id, ts, event_type, value AS x,
 CAST(regexp_extract(props, '"k": *(\\d+)', 1) AS INTEGER) AS y, CAST(regexp_extract(props, '"k": *(\\d+)', 1) AS INTEGER) / 100.0::DOUBLE AS conf, CAST(event_id % 2 AS INTEGER) AS player FROM events)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey, l_linenumber, day, a, b, a_won, score. Line numbers repeat within an order, so lines are numbered anew."""
    li = table(spark, sf_dir, "lineitem")
    line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_shipdate", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    li = li.withColumn("l_linenumber", F.row_number().over(line))
    out = li.select(
        "l_orderkey", "l_linenumber", F.col("l_shipdate").alias("day"), F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 100 + 1).alias("b"),
        F.when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("a_won"), F.col("l_quantity").alias("score"), "l_discount", "l_tax", "l_returnflag", "l_linestatus",
    )
    return out.filter("a <> b")


MH = """ln AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_suppkey, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS INTEGER) AS line FROM lineitem),
 mh AS (SELECT l_orderkey, line AS l_linenumber, l_shipdate AS day, l_suppkey AS a, l_partkey % 100 + 1 AS b, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS a_won, l_quantity AS score,
 l_discount, l_tax, l_returnflag, l_linestatus FROM ln WHERE l_suppkey <> l_partkey % 100 + 1)"""

#: The plain-SQL sequence clauses that many oracles repeat.
BY_FRAME = "PARTITION BY match_id ORDER BY frame"
