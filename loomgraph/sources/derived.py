"""Graphs derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def _top(pairs: DataFrame, most: int = 3) -> DataFrame:
    """The heaviest targets of each source; ties go to smaller ids."""
    order = Window.partitionBy("src").orderBy(F.desc("w"), "dst")
    return pairs.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select("src", "dst")


def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier nation -> its three main customer nations."""
    line, orders, cust, supp = _read(spark, sf_dir, "lineitem", "orders", "customer", "supplier")
    rows = line.select("l_orderkey", "l_suppkey").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(cust.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(supp.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = rows.where("s_nationkey <> c_nationkey").groupBy(F.col("s_nationkey").cast("long").alias("src"), F.col("c_nationkey").cast("long").alias("dst")).agg(F.count("*").alias("w"))
    return _top(pairs)


def supplier_edges(spark: SparkSession, sf_dir: str, most: int = 3) -> DataFrame:
    """Supplier -> the suppliers (three, or `most`) that most often share an order with it."""
    (line,) = _read(spark, sf_dir, "lineitem")
    a, b = line.select("l_orderkey", F.col("l_suppkey").alias("src")), line.select("l_orderkey", F.col("l_suppkey").alias("dst"))
    pairs = a.join(b, "l_orderkey").where("src <> dst").select("src", "dst").repartition("src")  # once for counts and window
    pairs = pairs.groupBy("src", "dst").agg(F.count("*").alias("w"))
    return _top(pairs, most)


def favourite_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier -> the supplier that most often shares an order with it."""
    return supplier_edges(spark, sf_dir, 1)


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part -> the next part within an order."""
    (line,) = _read(spark, sf_dir, "lineitem")
    following = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    return line.select(F.col("l_partkey").alias("src"), following.alias("dst")).where("dst is not null and src <> dst").distinct()
