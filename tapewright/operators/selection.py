"""More filters of patterns: anchors of events, physics, zombies, survivorship and priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.rolling import low, mean, ratio, rolling
from tapewright.operators.filters import chained
from tapewright.operators.joins import interval


def event_anchors(patterns: DataFrame, bars: DataFrame, near: float = 0.98, loud: float = 1.8) -> DataFrame:
    """The row that a pattern turns at: its last spring (a low under the five before, closed above them), else its last
    ignition (a high near the upper bound, its volume large to the mean of 20 rows with itself), else its middle
    (compression). Neither lies in the first five rows. Gives kind, its place and a score by priority, then place."""
    loudness = F.coalesce(F.when(mean("volume", 20, 5) > 0, ratio("volume", mean("volume", 20, 5))), F.lit(1.0))
    b = bars.withColumns({"spring": (F.col("low") < low("low", 5, back=1)) & (F.col("close") > low("low", 5, back=1)), "loudness": loudness})
    extra = b.select(F.col("ticker").alias("e_ticker"), F.col("date").alias("e_date"), "spring", "loudness")
    j = interval(patterns, bars)
    w = Window.partitionBy("pattern_id").orderBy("b_date")
    j = j.withColumns({"at": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy("pattern_id"))})
    j = j.join(extra, (F.col("ticker") == F.col("e_ticker")) & (F.col("b_date") == F.col("e_date")))
    late = F.col("at") > 5
    ignition = late & (F.col("b_high") >= near * F.col("upper")) & (F.col("loudness") > loud)
    out = j.groupBy("pattern_id").agg(F.max(F.when(late & F.col("spring"), F.col("at"))).alias("s"), F.max(F.when(ignition, F.col("at"))).alias("i"), F.max("n").alias("n"))
    kind = F.when(F.col("s").isNotNull(), "spring").when(F.col("i").isNotNull(), "ignition").otherwise("compression")
    place = F.coalesce("s", "i", F.floor(F.col("n") / 2) + 1)
    priority = F.when(kind == "spring", 3).when(kind == "ignition", 2).otherwise(1)
    return out.select("pattern_id", kind.alias("kind"), place.alias("place"), (priority * 1000 + place).alias("score"))


def best_anchor(patterns: DataFrame, bars: DataFrame, days: int = 10) -> DataFrame:
    """Of each cluster of patterns the one with the best anchor."""
    df = chained(patterns, days).join(event_anchors(patterns, bars), "pattern_id")
    best = Window.partitionBy("ticker", "cluster").orderBy(F.desc("score"), "pattern_id")
    return df.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")


def physics(patterns: DataFrame, least_width: float, most_width: float, least_money: float, turnover: Column | None = None, least_turnover: float = 0.0) -> DataFrame:
    """Patterns of a width within bounds and enough money; a turnover that isn't known passes."""
    df = patterns.where(F.col("box_width").between(least_width, most_width) & (F.col("money") >= least_money))
    return df if turnover is None else df.where(F.coalesce(turnover >= least_turnover, F.lit(True)))


def zombies(patterns: DataFrame, bars: DataFrame, least_rows: int = 5, idle_run: int = 3, extension: float = 10.0) -> DataFrame:
    """Why a pattern is no living market: too few rows, trades without volume, a long run without volume, or a close far
    from its mean of 200 rows. Null for living ones."""
    ext = bars.select(F.col("ticker").alias("x_ticker"), F.col("rn").alias("x_rn"), ratio("close", mean("close", 200)).alias("x_ext"))
    j = interval(patterns, bars)
    w = Window.partitionBy("pattern_id").orderBy("b_date")
    idle = F.col("b_volume") <= 0
    j = j.withColumn("__g", F.sum(F.when(idle, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = j.groupBy("pattern_id", "__g").agg(F.count("*").alias("k"), F.count_if(idle).alias("run"), F.count_if(idle & (F.col("b_high") != F.col("b_low"))).alias("ghosts"))
    sums = runs.groupBy("pattern_id").agg(F.sum("k").alias("rows"), F.max("run").alias("idle_run"), F.sum("ghosts").alias("ghosts"))
    out = patterns.join(sums, "pattern_id", "left").join(ext, (F.col("ticker") == F.col("x_ticker")) & (F.col("end_rn") == F.col("x_rn")), "left")
    reason = F.when(F.coalesce("rows", F.lit(0)) < least_rows, "few_rows").when(F.col("ghosts") > 0, "ghosts").when(F.col("idle_run") > idle_run, "idle").when((F.col("x_ext") > extension) | (F.col("x_ext") < 1 / extension), "extended")
    return out.select("pattern_id", "rows", "idle_run", F.col("x_ext").alias("extension"), reason.alias("reason"))


def last_view(patterns: DataFrame, base: Column, order: str) -> DataFrame:
    """The last pattern of each base."""
    w = Window.partitionBy(base).orderBy(F.desc(order), "pattern_id")
    return patterns.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def priority(patterns: DataFrame, ignition: Column, coil: Column, recency: Column) -> DataFrame:
    """Half ignition, .35 coil and .15 recency over what is known of the three."""
    parts = F.filter(F.array(*[F.struct(F.lit(w).alias("w"), v.cast("double").alias("v")) for w, v in ((0.5, ignition), (0.35, coil), (0.15, recency))]), lambda x: x["v"].isNotNull())
    total = lambda f: F.aggregate(parts, F.lit(0.0), lambda a, x: a + f(x))
    return patterns.withColumn("priority", total(lambda x: x["w"] * x["v"]) / F.nullif(total(lambda x: x["w"]), F.lit(0.0)))


def survivorship(patterns: DataFrame, bars: DataFrame, delisted: DataFrame, near_days: int = 180, young_days: int = 365, ahead_days: int = 100) -> DataFrame:
    """Flags of patterns that end near a delisting, soon after the first row, or with too few days after them."""
    spans = bars.groupBy("ticker").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    df = patterns.join(spans, "ticker").join(delisted, "ticker", "left")
    near = F.coalesce(F.datediff("delisting_date", "end_date").between(0, near_days), F.lit(False))
    flags = {"near_delisting": near, "young": F.datediff("end_date", "first_date") < young_days, "incomplete": F.datediff("last_date", "end_date") < ahead_days}
    return df.withColumns(flags).withColumn("clean", ~(F.col("near_delisting") | F.col("young") | F.col("incomplete")))


def signals(bars: DataFrame, least_volume: float = 1.5, least_roc: float = 0.0, most_rsi: float = 70.0) -> DataFrame:
    """Rows with large volume, rising over ten rows, not overbought, in the upper half of their 20-row range."""
    from tapewright.operators.indicators import rsi

    df = rsi(bars).withColumns({"volume_ratio": ratio("volume", mean("volume", 20, back=1)), "roc_10": ratio("close", F.lag("close", 10).over(Window.partitionBy("ticker").orderBy("date"))) - 1, "place": ratio(F.col("close") - low("low", 20), rolling(F.max, "high", 20) - low("low", 20))})
    return df.where((F.col("volume_ratio") > least_volume) & (F.col("roc_10") > least_roc) & (F.col("rsi_simple") < most_rsi) & (F.col("place") > 0.5))


def stale(tickers: DataFrame, known: DataFrame, at: str, today: str, most_days: int) -> DataFrame:
    """Tickers of which nothing is known that is at most so many days old."""
    fresh = known.where(F.datediff(F.lit(today).cast("date"), at) <= most_days).select("ticker").distinct()
    return tickers.join(fresh, "ticker", "left_anti")


def sampled(snapshots: DataFrame, key: str, percent: int = 20) -> DataFrame:
    """The same share of rows in every run, by a hash of the key."""
    return snapshots.where(F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(100)) < percent)
