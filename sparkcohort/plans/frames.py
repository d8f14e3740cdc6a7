"""Frames of the driver's tables in the role of records, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an order, in the role of a record."""
    o, c, n = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return joined.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").cast("date").alias("event_date"),
        F.col("n_name").alias("location"),
        F.when(F.col("n_regionkey") <= 2, "Rural").otherwise("Peri_urban").alias("zone"),
        F.col("c_mktsegment").alias("segment"),
        F.col("n_nationkey").cast("double").alias("latitude"),
        F.col("n_regionkey").cast("double").alias("longitude"),
        F.col("n_nationkey").cast("bigint").alias("nation"),
        F.col("n_regionkey").cast("bigint").alias("cluster"),
        F.col("c_custkey").alias("customer"),
        F.col("o_totalprice").alias("total"),
        F.col("c_acctbal").alias("balance"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y"),
        F.when(F.col("n_regionkey") != 4, "train").otherwise("test").alias("split"),
        (F.col("o_orderkey") % 5).cast("int").alias("fold"),
    )


R = """r AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS event_date, n_name AS location,
  CASE WHEN n_regionkey <= 2 THEN 'Rural' ELSE 'Peri_urban' END AS zone, c_mktsegment AS segment,
  CAST(n_nationkey AS DOUBLE) AS latitude, CAST(n_regionkey AS DOUBLE) AS longitude, CAST(n_nationkey AS BIGINT) AS nation,
  CAST(n_regionkey AS BIGINT) AS cluster, c_custkey AS customer, o_totalprice AS total, c_acctbal AS balance,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, CASE WHEN n_regionkey <> 4 THEN 'train' ELSE 'test' END AS split,
  CAST(o_orderkey % 5 AS INTEGER) AS fold
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def climate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an order that has lines, in the role of its climate."""
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_quantity").alias("rain"), F.max("l_quantity").alias("most"), F.count("*").alias("days"))


C = "c AS (SELECT l_orderkey AS id, sum(l_quantity) AS rain, max(l_quantity) AS most, count(*) AS days FROM lineitem GROUP BY l_orderkey)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a line; lines have no key."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        F.floor(F.col("l_extendedprice") / 1000).cast("double").alias("age"),
        F.col("l_quantity").alias("tmax"),
        F.col("l_tax").alias("tax"),
        F.col("l_discount").alias("discount"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
        F.col("l_shipdate").cast("date").alias("shipped"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"),
    )


L = """l AS (SELECT CAST(floor(l_extendedprice / 1000) AS DOUBLE) AS age, l_quantity AS tmax, l_tax AS tax, l_discount AS discount,
  l_extendedprice AS price, l_returnflag AS flag, l_linestatus AS status, CAST(l_shipdate AS DATE) AS shipped,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with three made-up models' predictions."""
    d, lab = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    i = F.col("doc_id")
    return d.select("doc_id", "n_chars").join(lab, "doc_id").select(
        i.alias("id"),
        F.col("quality").alias("y"),
        ((i * 7919) % 1000 / F.lit(999.0)).alias("p1"),
        ((i * 104729) % 997 / F.lit(996.0)).alias("p2"),
        F.least(F.lit(1.0), F.col("n_chars") / F.lit(20000.0)).alias("p3"),
        (i % 5).cast("int").alias("fold"),
    )


D = """d AS (SELECT documents.doc_id AS id, quality AS y, CAST((documents.doc_id * 7919) % 1000 AS DOUBLE) / 999 AS p1,
  CAST((documents.doc_id * 104729) % 997 AS DOUBLE) / 996 AS p2, least(CAST(1 AS DOUBLE), CAST(n_chars AS DOUBLE) / 20000) AS p3,
  CAST(documents.doc_id % 5 AS INTEGER) AS fold FROM documents JOIN labels ON documents.doc_id = labels.doc_id)"""
