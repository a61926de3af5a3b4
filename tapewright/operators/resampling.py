"""Bars of other lengths, and continuous contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tick_bars(ticks: DataFrame, length: str = "5 minutes") -> DataFrame:
    """Bid bars of a length of time with the number of ticks; empty ones are left out."""
    t = ticks.groupBy("symbol", F.window("ts", length)).agg(F.min_by("bid", "ts").alias("open"), F.max("bid").alias("high"), F.min("bid").alias("low"), F.max_by("bid", "ts").alias("close"), F.count("*").alias("volume"))
    return t.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def week_end(date: str):
    """The Friday on which the date's week ends."""
    return F.expr(f"date_add({date}, CAST(pmod(4 - weekday({date}), 7) AS INT))")


def weekly(bars: DataFrame) -> DataFrame:
    """Weeks up to Friday, partial ones too, with the last day that was traded."""
    out = bars.groupBy("ticker", week_end("date").alias("week")).agg(F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume"), F.max("date").alias("last_day"), F.count("*").alias("days"))
    return out


def front_month(contracts: DataFrame) -> DataFrame:
    """At each time the contract of most volume (of least id on ties), with the volume of all."""
    at = Window.partitionBy("ts")
    ranked = contracts.withColumns({"place": F.row_number().over(at.orderBy(F.desc("volume"), "iid")), "all_volume": F.sum("volume").over(at)})
    return ranked.where("place = 1").drop("place")


def roll_days(contracts: DataFrame) -> DataFrame:
    """Days on which the front contract that most bars have differs from the day before's."""
    per_day = front_month(contracts).groupBy(F.to_date("ts").alias("day"), "iid").count()
    modal = per_day.withColumn("place", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("count"), "iid"))).where("place = 1")
    # one row a day for all contracts together: a calendar, of bounded size
    return modal.withColumn("before", F.lag("iid").over(Window.orderBy("day"))).where("before IS NOT NULL AND iid <> before").select("day", "before", "iid")


def quantised(df: DataFrame, columns: tuple[str, ...], tick: float = 0.25) -> DataFrame:
    """Prices on a grid, halves to even."""
    return df.withColumns({c: F.bround(F.col(c) / tick) * tick for c in columns})


def hour_baseline(contracts: DataFrame, days: int = 10) -> DataFrame:
    """Volume against the median of the same hour on the ``days`` bars before, or the next one known, at least 1."""
    at = Window.partitionBy("iid", F.hour("ts")).orderBy("ts")
    df = contracts.withColumn("__m", F.percentile("volume", F.lit(0.5)).over(at.rowsBetween(-days, -1)))
    known = F.coalesce("__m", F.first("__m", ignorenulls=True).over(at.rowsBetween(1, Window.unboundedFollowing)), F.lit(1.0))
    return df.withColumn("baseline", F.greatest(known, F.lit(1.0))).drop("__m")


def expiry_rolls(first: str, last: str, bars: DataFrame) -> DataFrame:
    """Days of ``bars`` that are the Thursday before the third Friday of March, June, September or December."""
    months = bars.sparkSession.sql(f"SELECT explode(sequence(date '{first}', date '{last}', interval 1 month)) AS m").where("month(m) % 3 = 0")
    friday = F.expr("date_add(m, CAST(pmod(4 - weekday(m), 7) AS INT) + 14)")
    return bars.join(months.select(F.date_sub(friday, 1).alias("date")), "date", "left_semi")
