"""Market tables derived from the star schema: bars, quotes and contract bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: a brand's line items of a ship date, in order of their keys, as its trades of that day."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    trades = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    price, at = F.col("l_extendedprice") / F.col("l_quantity"), F.struct("l_orderkey", "l_linenumber")
    return trades.groupBy(F.col("p_brand").alias("ticker"), F.to_date("l_shipdate").alias("date")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.sum("l_quantity").alias("volume")
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes: an event's type is the symbol and its value the bid."""
    events = table(spark, sf_dir, "events")
    return events.select("ts", F.col("event_type").alias("symbol"), F.col("value").alias("bid"), (F.col("value") * 1.001).alias("ask"), "user_id")


def contract_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of four instruments, by the event's user."""
    t = ticks(spark, sf_dir).withColumn("iid", F.col("user_id") % 4)
    return t.groupBy(F.date_trunc("hour", "ts").alias("ts"), "iid").agg(
        F.min_by("bid", "ts").alias("open"), F.max("bid").alias("high"), F.min("bid").alias("low"), F.max_by("bid", "ts").alias("close"), F.sum(F.col("bid")).alias("volume")
    )
