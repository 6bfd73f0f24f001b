"""How the test tables become logs, runs, batches and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_log(spark: SparkSession, sf_dir: str, upto: int | None = None) -> DataFrame:
    """Events as versions of users: an error deletes. A bound on seq goes to the scan as one on event_id."""
    e = table(spark, sf_dir, "events")
    if upto is not None:
        e = e.filter(F.col("event_id") <= upto - 1)
    gone = F.col("event_type") == "error"
    return e.select(F.col("user_id").alias("key"), (F.col("event_id") + 1).alias("seq"), F.when(gone, 0).otherwise(1).alias("op"), F.when(~gone, F.col("value")).alias("value"))


def run_of(seq: Column) -> Column:
    return F.floor((seq - 1) / 1000)


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    gone = F.col("o_orderstatus") == "F"
    return o.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.when(gone, 0).otherwise(1).alias("op"), F.when(~gone, F.col("o_totalprice")).alias("value"))


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files of two levels, staggered so that they overlap in part."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    one = o.select(F.lit(1).alias("level"), F.floor(F.col("key") / 1000).alias("num"), "key")
    two = o.select(F.lit(2).alias("level"), F.floor((F.col("key") + 500) / 2000).alias("num"), "key")
    return one.unionByName(two).groupBy("level", "num").agg(F.min("key").alias("smallest"), F.max("key").alias("largest"), (F.count("*") * 100).alias("file_size"))
