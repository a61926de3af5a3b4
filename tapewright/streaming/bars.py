"""Bars from a stream of quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tick_bars(quotes: DataFrame, width: str = "5 minutes", late: str | None = "10 minutes") -> DataFrame:
    """Bars of bids by symbol and window of event time; empty windows give none.

    On a stream a bar is final, and given once, when the watermark has passed its end by ``late``; later quotes are
    dropped. On a table the same plan gives all bars.
    """
    q = quotes.withWatermark("ts", late) if late and quotes.isStreaming else quotes
    out = q.groupBy("symbol", F.window("ts", width).alias("w")).agg(F.min_by("bid", "ts").alias("open"), F.max("bid").alias("high"), F.min("bid").alias("low"), F.max_by("bid", "ts").alias("close"), F.count("*").alias("volume"))
    return out.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def danger_monitor(outcomes: DataFrame, width: str = "30 days", late: str | None = "1 day") -> DataFrame:
    """Share of failures by window of event time, and the alarm that more than .4 of at least ten patterns raise."""
    q = outcomes.withWatermark("ts", late) if late and outcomes.isStreaming else outcomes
    out = q.groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.avg(F.col("failed").cast("double")).alias("danger"))
    return out.select(F.col("w.start").alias("ts"), "n", "danger", ((F.col("n") >= 10) & (F.col("danger") > 0.4)).alias("alarm"))
