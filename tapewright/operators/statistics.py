"""Statistics over flags and patterns, market regimes, temporal splits, sequences and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.positions import percentiles
from tapewright.functions.rolling import by_date, mean, ratio, rows


def method_effectiveness(flagged: DataFrame, methods: tuple[str, ...], gain: str, success: float = 0.1) -> DataFrame:
    """Per method: flagged rows, mean and median gain after them, and how often it was a success."""
    long = flagged.select(F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("on")) for m in methods])).alias("x"), gain).where("x.on")
    long = long.select(F.col("x.method").alias("method"), gain)
    medians = percentiles(long, gain, ["method"], {"median_gain": 0.5})
    return medians.join(long.groupBy("method").agg(F.count("*").alias("n"), F.avg(gain).alias("mean_gain"), F.avg((F.col(gain) >= success).cast("double")).alias("success")), "method", "right").select("method", "n", "mean_gain", "median_gain", "success")


def method_agreement(flagged: DataFrame, methods: tuple[str, ...], gain: str) -> DataFrame:
    """Rows by how many methods flag them."""
    agreeing = sum((F.col(m).cast("int") for m in methods[1:]), F.col(methods[0]).cast("int"))
    return flagged.groupBy(agreeing.alias("methods")).agg(F.count("*").alias("n"), F.avg(gain).alias("mean_gain"))


def seasonality(bars: DataFrame, value: str) -> DataFrame:
    """Mean of a value by month, by quarter and by weekday in one pass of grouping sets."""
    df = bars.select(F.col(value).alias("v"), F.month("date").alias("month"), F.quarter("date").alias("quarter"), F.weekday("date").alias("weekday"))
    grouped = df.groupingSets([["month"], ["quarter"], ["weekday"]], "month", "quarter", "weekday")
    return grouped.agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))


def risk_reward(rows_: DataFrame, key: str, gain: str) -> DataFrame:
    """Per key: profit factor, expectancy, Kelly share within 0 to .25, Sharpe ratio, value at risk."""
    g = F.col(gain)
    won, lost = F.sum(F.when(g > 0, g).otherwise(0.0)), -F.sum(F.when(g < 0, g).otherwise(0.0))
    rate, win, loss = F.avg((g > 0).cast("double")), F.avg(F.when(g > 0, g)), -F.avg(F.when(g <= 0, g))
    out = rows_.groupBy(key).agg(F.count(g).alias("n"), ratio(won, lost).alias("profit_factor"), F.avg(g).alias("expectancy"), ratio(F.avg(g), F.stddev_samp(g)).alias("sharpe"), F.percentile(g, F.lit(0.05)).alias("var_5"), rate.alias("rate"), win.alias("win"), loss.alias("loss"))
    kelly = F.col("rate") - ratio(1 - F.col("rate"), ratio("win", "loss"))
    return out.withColumn("kelly", F.least(F.greatest(kelly, F.lit(0.0)), F.lit(0.25)))


def drawdown(bars: DataFrame) -> DataFrame:
    """Per ticker: the deepest fall below the highest close so far, and the longest run of falling rows."""
    peak = F.max("close").over(by_date().rowsBetween(Window.unboundedPreceding, 0))
    falling = F.col("close") < F.col("pc")
    group = F.sum(F.when(falling, 0).otherwise(1)).over(by_date().rowsBetween(Window.unboundedPreceding, 0))
    df = bars.withColumns({"dd": F.col("close") / peak - 1, "g": group})
    runs = df.groupBy("ticker", "g").agg(F.count_if(falling).alias("run"), F.min("dd").alias("dd"))
    return runs.groupBy("ticker").agg(F.min("dd").alias("max_drawdown"), F.max("run").alias("longest_fall"))


def sweep(patterns: DataFrame, column: str, value: str, bounds: list[float]) -> DataFrame:
    """What is left of the patterns under each bound of a column, all bounds in one pass."""
    each = F.explode(F.filter(F.array(*map(F.lit, bounds)), lambda b: F.col(column) <= b))
    return patterns.withColumn("bound", each).groupBy("bound").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def hierarchy(patterns: DataFrame, levels: tuple[str, ...], value: str) -> DataFrame:
    """Counts and means by each level and those above it."""
    return patterns.rollup(*levels).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def two_sample_t(rows_: DataFrame, flag: str, value: str, key: str) -> DataFrame:
    """Per key: Welch's t and Cohen's d of the value where the flag holds against where it doesn't."""
    on, off = F.when(F.col(flag), F.col(value)), F.when(~F.col(flag), F.col(value))
    s = rows_.groupBy(key).agg(F.count(on).alias("n1"), F.count(off).alias("n0"), F.avg(on).alias("m1"), F.avg(off).alias("m0"), F.var_samp(on).alias("v1"), F.var_samp(off).alias("v0"))
    t = ratio(F.col("m1") - F.col("m0"), F.sqrt(ratio("v1", F.col("n1").cast("double")) + ratio("v0", F.col("n0").cast("double"))))
    return s.select(key, "n1", "n0", t.alias("t"), ratio(F.col("m1") - F.col("m0"), F.sqrt((F.col("v1") + F.col("v0")) / 2)).alias("d"))


def hysteresis(bars: DataFrame, fast: int = 50, slow: int = 200, band: float = 0.05) -> DataFrame:
    """Phase 1 once the fast mean is so far above the slow one, 0 once it is so far below, else as before."""
    df = bars.withColumns({"fast_ma": mean("close", fast), "slow_ma": mean("close", slow)})
    latch = F.when(F.col("fast_ma") > F.col("slow_ma") * (1 + band), 1).when(F.col("fast_ma") < F.col("slow_ma") * (1 - band), 0)
    seed = F.when(F.col("slow_ma").isNotNull(), (F.col("fast_ma") > F.col("slow_ma")).cast("int"))
    sofar = by_date().rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("phase", F.coalesce(F.last(latch, ignorenulls=True).over(sofar), F.first(seed, ignorenulls=True).over(sofar)))
    changed = F.coalesce(F.col("phase") != F.lag("phase").over(by_date()), F.col("phase").isNotNull())
    df = df.withColumn("crossover_date", F.last(F.when(changed, F.col("date")), ignorenulls=True).over(sofar))
    return df.withColumn("days_in_phase", F.datediff("date", "crossover_date"))


def breadth(bars: DataFrame, n: int = 200) -> DataFrame:
    """Per date: share of tickers above their mean of n rows."""
    return bars.withColumn("__m", mean("close", n)).where("__m IS NOT NULL").groupBy("date").agg(F.avg((F.col("close") > F.col("__m")).cast("double")).alias("breadth"), F.count("*").alias("n"))


def split_by_dates(df: DataFrame, date: str, train_end: str, test_start: str) -> DataFrame:
    """train up to a date, test from another, and an embargo between."""
    d = F.col(date)
    return df.withColumn("split", F.when(d <= F.lit(train_end).cast("date"), "train").when(d >= F.lit(test_start).cast("date"), "test").otherwise("embargo"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights: all rows by classes and rows of the class."""
    counts = df.groupBy(label).count()
    every = counts.agg(F.sum("count").alias("all"), F.count("*").alias("classes"))  # one row
    return counts.join(F.broadcast(every)).select(label, "count", (F.col("all") / (F.col("classes") * F.col("count"))).alias("weight"))


def sequences(bars: DataFrame, n: int = 20, stride: int = 10) -> DataFrame:
    """Windows of n closes relative to their first, every ``stride`` rows."""
    df = bars.withColumn("window", F.collect_list("close").over(rows(1 - n, 0))).where((F.col("rn") >= n) & ((F.col("rn") - n) % stride == 0))
    return df.withColumn("window", F.transform("window", lambda x: x / F.get("window", F.lit(0)) - 1))


def precision_at(df: DataFrame, score: str, hit: str, key: str, shares=(0.1, 0.25)) -> DataFrame:
    """Per key: share of hits among the best so many percent, one at least."""
    best = Window.partitionBy(key)
    ranked = df.withColumns({"place": F.row_number().over(best.orderBy(F.desc(score), "pattern_id")), "n": F.count("*").over(best)})
    at = lambda s: F.avg(F.when(F.col("place") <= F.greatest(F.lit(1), F.floor(F.col("n") * s)), F.col(hit).cast("double")))
    return ranked.groupBy(key).agg(F.count("*").alias("n"), *[at(s).alias(f"precision_{int(100 * s)}") for s in shares])


def calibration(df: DataFrame, probability: str, hit: str, bins: int = 10) -> DataFrame:
    """Per bin of equal width: rows, mean probability, share of hits, and the gap weighted by rows."""
    bin_ = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1))
    out = df.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg(probability).alias("mean_probability"), F.avg(F.col(hit).cast("double")).alias("hits"))
    return out.withColumn("gap", F.abs(F.col("mean_probability") - F.col("hits")) * F.col("n"))


def stability_index(df: DataFrame, value: str, later: Column, bins: int = 10) -> DataFrame:
    """Population stability of a value, later rows against earlier ones, in bins of the earlier rows' quantiles."""
    edges = percentiles(df.where(~later), value, [], {f"e{i}": i / bins for i in range(bins + 1)})  # one row
    edges = edges.select(F.array(*[f"e{i}" for i in range(bins + 1)]).alias("edges"))
    inside = df.join(F.broadcast(edges)).withColumn("bin", F.size(F.filter("edges", lambda e: e <= F.col(value))))
    kept = inside.withColumn("bin", F.when(F.col(value) == F.element_at("edges", -1), bins).otherwise(F.col("bin")))
    shares = kept.groupBy("bin").agg(F.count_if(~later).alias("a"), F.count_if(later).alias("b"))
    whole = df.agg(F.count_if(~later).alias("na"), F.count_if(later).alias("nb"))
    p, q = F.greatest(F.col("a") / F.col("na"), F.lit(1e-4)), F.greatest(F.col("b") / F.col("nb"), F.lit(1e-4))
    return shares.where((F.col("bin") >= 1) & (F.col("bin") <= bins)).join(F.broadcast(whole)).agg(F.sum((q - p) * F.ln(q / p)).alias("psi"), F.count("*").alias("bins"))
