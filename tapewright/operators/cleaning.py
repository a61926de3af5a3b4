"""Cleaning of bars and reports on their quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.positions import percentiles
from tapewright.functions.rolling import by_date, correlation, deviation, lag, mean, ratio

#: Names that mean the same as a standard column, lower-cased and without blanks.
ALIASES = {"timestamp": "date", "datetime": "date", "time": "date", "index": "date", "adj close": "adj_close", "adjclose": "adj_close", "symbol": "ticker", "vol": "volume", "o": "open", "h": "high", "l": "low", "c": "close", "v": "volume"}
PRICES = ("open", "high", "low", "close")


def normalised_columns(df: DataFrame) -> DataFrame:
    """Columns in lower case under their standard names; the first of those that mean the same stays."""
    seen: dict[str, str] = {}
    for c in df.columns:
        plain = c.strip().lower()
        seen.setdefault(ALIASES.get(plain, plain.replace(" ", "_")), c)
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in seen.items()])


def between_dates(bars: DataFrame, first: str, last: str) -> DataFrame:
    return bars.where(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def latest_rows(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row of each key: the first in the given order."""
    return df.withColumn("__place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__place = 1").drop("__place")


def above_price(bars: DataFrame, least: float) -> DataFrame:
    return bars.where(F.least(*PRICES) >= least)


def eligible(bars: DataFrame, least_price: float, least_rows: int, completeness: float) -> DataFrame:
    """Bars of tickers with enough rows, a mean close of some height and few missing days of 5 in 7."""
    span = F.datediff(F.max("date"), F.min("date")) + 1
    good = bars.groupBy("ticker").agg(F.count("*").alias("n"), F.avg("close").alias("p"), span.alias("days"))
    good = good.where((F.col("n") >= least_rows) & (F.col("p") >= least_price) & (F.col("n") / (F.col("days") * 5 / 7) >= completeness))
    return bars.join(good.select("ticker"), "ticker", "left_semi")


def unit_jumps(bars: DataFrame, low: float = 95, high: float = 105, factor: float = 100.0) -> DataFrame:
    """Prices quoted in another unit for a while, rescaled to that of the ticker's longest segment.

    A jump of close to its predecessor by about the factor, or its inverse, starts a segment; segments whose median is
    50 to 200 times the longest one's are divided, those .005 to .02 times are multiplied.
    """
    move = ratio("close", lag("close"))
    jump = move.between(low, high) | (1 / F.nullif(move, F.lit(0.0))).between(low, high)
    df = bars.withColumn("segment", F.sum(F.when(jump, 1).otherwise(0)).over(by_date().rowsBetween(Window.unboundedPreceding, 0)))
    segments = df.groupBy("ticker", "segment").agg(F.percentile("close", F.lit(0.5)).alias("median"), F.count("*").alias("n"))
    base = segments.groupBy("ticker").agg(F.max_by("median", F.struct(F.col("n"), -F.col("segment"))).alias("base"))
    off = segments.join(base, "ticker").withColumn("off", ratio("median", "base"))
    scale = F.when(F.col("off").between(50, 200), 1 / factor).when(F.col("off").between(0.005, 0.02), factor).otherwise(1.0)
    scaled = df.join(off.select("ticker", "segment", scale.alias("scale")), ["ticker", "segment"])
    return scaled.withColumns({c: F.col(c) * F.col("scale") for c in PRICES})


def spikes(bars: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows that move by more than ``least`` and back as far get their neighbours' mean in each price."""
    into, out = ratio("close", lag("close")) - 1, ratio(F.lead("close").over(by_date()), "close") - 1
    spike = (F.abs(into) > least) & (F.abs(out) > least) & (F.signum(into) != F.signum(out))
    df = bars.withColumn("spike", F.coalesce(spike, F.lit(False)))
    return df.withColumns({c: F.when(F.col("spike"), (lag(c) + F.lead(c).over(by_date())) / 2).otherwise(F.col(c)) for c in PRICES})


def quality(bars: DataFrame, zero_share: float = 0.5, least_rows: int = 100) -> DataFrame:
    """Per ticker: rows, share without volume, largest return, and whether to exclude it."""
    out = bars.groupBy("ticker").agg(F.count("*").alias("n"), F.avg(F.when(F.col("volume") <= 0, 1.0).otherwise(0.0)).alias("zero_share"), F.max(F.abs("ret")).alias("largest"))
    return out.withColumn("exclude", (F.col("zero_share") > zero_share) | (F.col("n") < least_rows))


def consistency(bars: DataFrame) -> DataFrame:
    """Per ticker: bars that contradict themselves."""
    outside = lambda c: (F.col(c) > F.col("high")) | (F.col(c) < F.col("low"))
    return bars.groupBy("ticker").agg(F.count_if(F.least(*PRICES) < 0).alias("negative"), F.count_if(F.col("high") < F.col("low")).alias("inverted"), F.count_if(outside("open")).alias("open_outside"), F.count_if(outside("close")).alias("close_outside"))


def outliers(bars: DataFrame, split: float = 0.4, z: float = 2.0, n: int = 20) -> DataFrame:
    """Rows with moves like a split's, or returns far from those of the last n rows."""
    df = bars.withColumn("z", ratio(F.col("ret") - mean("ret", n), deviation("ret", n)))
    return df.withColumns({"like_split": F.abs("ret") > split, "outlier": F.abs("z") > z}).where("like_split OR outlier")


def gaps(bars: DataFrame, most: int = 10) -> DataFrame:
    """Per ticker: longest gap in days, gaps above ``most``, repeated dates."""
    df = bars.withColumn("gap", F.datediff("date", lag("date")))
    return df.groupBy("ticker").agg(F.max("gap").alias("longest"), F.count_if(F.col("gap") > most).alias("long_gaps"), (F.count("*") - F.count_distinct("date")).alias("repeated"))


def halts(bars: DataFrame, days: int = 2) -> DataFrame:
    """Per ticker: gaps of more than twice the days and four."""
    df = bars.withColumns({"gap": F.datediff("date", lag("date")), "before": lag("date")}).where(F.col("gap") > 2 * days + 4)
    return df.groupBy("ticker").agg(F.count("*").alias("halts"), F.max("gap").alias("longest"), F.sum("gap").alias("days"), F.array_join(F.array_sort(F.collect_list(F.col("before").cast("string"))), ",").alias("since"))


def made_up(bars: DataFrame) -> DataFrame:
    """Per ticker: signs of synthetic data."""
    whole = lambda c, k=1: F.every(F.col(c) % k == 0)
    return bars.groupBy("ticker").agg((F.stddev_pop("volume") == 0).alias("flat_volume"), (F.stddev_pop("close") == 0).alias("flat_price"), whole("close").alias("whole_prices"), whole("volume", 1000).alias("round_volumes"), (correlation("close", F.col("rn").cast("double")) > 0.999).alias("linear"))


def statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: count, mean, deviation, extremes, quartiles."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select("x.*")
    plain = long.groupBy("column").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("least"), F.max("value").alias("most"))
    return plain.join(percentiles(long, "value", ["column"], {"q25": 0.25, "q50": 0.5, "q75": 0.75}), "column", "left").select("column", "n", "mean", "std", "least", "q25", "q50", "q75", "most")
