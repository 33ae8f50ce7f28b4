"""The fixtures: clustered outcomes made from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line(spark, sf_dir):
    t = read(spark, sf_dir, "lineitem")
    return t.select(F.col("l_suppkey").alias("provider"), (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") / 50).alias("quantity"), (F.col("l_discount") * 10).alias("discount"))


LINE = "SELECT l_suppkey AS pid, (l_returnflag = 'R')::DOUBLE AS y, 1.0::DOUBLE AS n, l_quantity / 50 AS z1, l_discount * 10 AS z2, l_suppkey % 4 AS block FROM lineitem"


def orders(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    g = o.join(c, o.o_custkey == c.c_custkey).groupBy("c_nationkey", "o_orderpriority")
    return g.agg(F.sum((F.col("o_orderstatus") == "F").cast("int")).alias("y"), F.count("*").alias("n"), (F.avg("o_totalprice") / 1e5).alias("price")).withColumnRenamed("c_nationkey", "provider").drop("o_orderpriority")


ORDERS = "SELECT c_nationkey AS pid, count(*) FILTER (o_orderstatus = 'F')::DOUBLE AS y, count(*)::DOUBLE AS n, avg(o_totalprice) / 1e5 AS z1, 0 AS block FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, o_orderpriority"


def labels(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    x = d.join(read(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    return x.select(F.col("source").alias("provider"), F.col("toxic").alias("y"), F.log1p("n_chars").alias("length"))


LABELS = "SELECT source AS pid, toxic::DOUBLE AS y, 1.0::DOUBLE AS n, ln(1 + n_chars) AS z1, 0 AS block FROM documents JOIN labels USING (doc_id)"


def events(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_type", "value")
    return e.select(F.col("user_id").alias("provider"), (F.col("event_type") == "error").cast("int").alias("y"), (F.col("value") / 100).alias("value"))


EVENTS = "SELECT user_id AS pid, (event_type = 'error')::DOUBLE AS y, 1.0::DOUBLE AS n, coalesce(value, 0) / 100 AS z1, 0 AS block FROM events"
