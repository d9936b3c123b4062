"""Fixture tables as samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.schema import series_key


def _ms(column: str) -> Column:
    """Milliseconds of a timestamp without zone; the session's zone must be UTC. Fractions are cut off."""
    return F.expr(f"unix_micros(cast({column} as timestamp)) div 1000")


def _samples(df: DataFrame, metric: Column, labels: dict[str, Column], ts: Column, value: Column, seq: Column) -> DataFrame:
    pairs = [x for k, v in labels.items() for x in (F.lit(k), v.cast("string"))]
    df = df.select(metric.alias("metric"), F.create_map(*pairs).alias("labels"), ts.alias("ts"), value.cast("double").alias("value"), seq.cast("long").alias("seq"))
    return df.withColumn("series_key", series_key(F.col("metric"), F.col("labels")))


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Metric is the event type, one series per user."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    return _samples(e, F.col("event_type"), {"user_id": F.col("user_id")}, _ms("ts"), F.col("value"), F.col("event_id"))


def orders(spark: SparkSession, sf: str) -> DataFrame:
    """Order prices by status and priority; several orders of one time are rewrites, the greatest key is the last."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return _samples(o, F.lit("o_totalprice"), {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority")}, _ms("o_orderdate"), F.col("o_totalprice"), F.col("o_orderkey"))


def lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """Prices by return flag and line status, without a valid order of writes: for aggregates that need none."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    return _samples(li, F.lit("l_extendedprice"), {"returnflag": F.col("l_returnflag"), "linestatus": F.col("l_linestatus")}, _ms("l_shipdate"), F.col("l_extendedprice"), F.lit(0))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """The dirty samples table; rows without a value are no samples."""
    s = spark.read.parquet(f"{sf}/samples.parquet").where(F.col("value").isNotNull())
    s = s.withColumn("labels", F.coalesce("labels", F.create_map().cast("map<string,string>")))
    return s.select("metric", "labels", series_key(F.col("metric"), F.col("labels")).alias("series_key"), "ts", "value", "seq")
