"""Joins by interval and by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def interval(patterns: DataFrame, bars: DataFrame, days: int = 64) -> DataFrame:
    """Patterns with the bars from their start to their end, as b_ columns.

    Both sides are cut in blocks of ``days`` days and joined by ticker and block, so that a ticker is many keys.
    """
    block = lambda c: F.floor(F.unix_date(c) / days)
    b = bars.select(F.col("ticker").alias("b_ticker"), block("date").alias("b_block"), *[F.col(c).alias(f"b_{c}") for c in ("date", "open", "high", "low", "close", "volume")])
    asked = patterns.withColumn("__block", F.explode(F.sequence(block("start_date"), block("end_date"))))
    on = (F.col("ticker") == F.col("b_ticker")) & (F.col("__block") == F.col("b_block")) & F.col("b_date").between(F.col("start_date"), F.col("end_date"))
    return asked.join(b, on).drop("__block", "b_block", "b_ticker")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], forward: bool = False) -> DataFrame:
    """``left`` with the values of the latest right row at or before its time (or earliest at or after).

    Both sides are put in one sequence and the last known value is carried on: one shuffle by key and one sort.
    """
    side = F.lit(1 if not forward else 0)
    l = left.select(*[F.col(k) for k in keys], F.col(left_time).cast("timestamp").alias("__t"), side.alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("__v"))  # noqa: E741
    r = right.select(*[F.col(k) for k in keys], F.col(right_time).cast("timestamp").alias("__t"), F.lit(0 if not forward else 1).alias("__side"), F.lit(None).cast(l.schema["__row"].dataType).alias("__row"), F.struct(*values).alias("__v"))
    w = Window.partitionBy(*keys).orderBy("__t", "__side")
    carried = F.first("__v", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)) if forward else F.last("__v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    both = l.unionByName(r).withColumn("__c", carried).where("__row IS NOT NULL")
    return both.select("__row.*", *[F.col(f"__c.{v}").alias(v) for v in values])


def latest(left: DataFrame, right: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """``left`` with its newest right row, if there is one."""
    newest = right.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("__v"))
    return left.join(newest, key, "left").select(*left.columns, *[F.col(f"__v.{v}").alias(v) for v in values])


def needing(left: DataFrame, made: DataFrame) -> DataFrame:
    """Rows of ``left`` (key) with no made row, or whose newest isn't of the newest day of all."""
    newest = made.groupBy("key").agg(F.max("made").alias("made"))
    every = made.agg(F.max("made").alias("__latest"))  # one row
    return left.join(newest, "key", "left").join(F.broadcast(every)).where(F.col("made").isNull() | (F.col("made") != F.col("__latest"))).drop("__latest")


def market_cap(bars: DataFrame, shares: DataFrame, bounds: tuple[float, ...] = (1e6, 3e6, 6e6)) -> DataFrame:
    """Shares times the price of the day, and its tier."""
    df = bars.join(shares, "ticker").withColumn("market_cap", F.col("close") * F.col("shares"))
    tier = F.when(F.col("market_cap") < bounds[0], "nano").when(F.col("market_cap") < bounds[1], "micro").when(F.col("market_cap") < bounds[2], "small").otherwise("large")
    return df.withColumn("tier", tier)


def dilution(filings: DataFrame) -> DataFrame:
    """Per ticker the growth of shares in the year to its latest filing: against the newest 300 to 420 days before it, or
    else the one nearest to 365 days of those 180 to 540 days before."""
    latest_ = filings.groupBy("ticker").agg(F.max("date").alias("last"), F.max_by("shares", "date").alias("last_shares"))
    age = F.datediff("last", "date")
    j = filings.join(latest_, "ticker").withColumn("age", age)
    year = F.max_by(F.when(F.col("age").between(300, 420), F.col("shares")), F.when(F.col("age").between(300, 420), F.col("date")))
    near = F.min_by(F.when(F.col("age").between(180, 540), F.col("shares")), F.when(F.col("age").between(180, 540), F.abs(F.col("age") - 365) * 10 + (F.col("age") > 365).cast("int")))
    out = j.groupBy("ticker", "last", "last_shares").agg(F.coalesce(year, near).alias("then"))
    return out.select("ticker", F.col("last").alias("date"), (F.col("last_shares") / F.nullif(F.col("then"), F.lit(0.0)) - 1).alias("dilution"))
