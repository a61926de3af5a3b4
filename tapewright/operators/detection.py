"""Detection of consolidations: flags by day, and windows as a table of patterns. Every threshold is a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.rolling import by_date, high, low, mean, quantile, ratio, rolling, rows, total

def whole():
    """All rows of a ticker."""
    return Window.partitionBy("ticker")

METHODS = ("method1", "method2", "method3", "method4")


def four_methods(bars: DataFrame, share: float = 0.3, range_ratio: float = 0.65, atr_share: float = 0.04, volume_ratio: float = 0.35, horizons=(20, 40)) -> DataFrame:
    """Four flags of a tight market by day, and the largest gain and loss over the rows after it (fwd_ columns).

    Windows may be partial here. Narrow bands and small ranges are measured against the ticker's own quantile.
    """
    w20, w14 = rows(-19, 0), rows(-13, 0)
    prev = F.coalesce("pc", "close")
    true_range = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
    df = bars.withColumns({
        "bbw": ratio(2 * F.stddev_samp("close").over(w20), F.avg("close").over(w20)), "atr_share": ratio(F.avg(true_range).over(w14), "close"),
        "range_ratio": ratio(F.col("high") - F.col("low"), F.avg(F.col("high") - F.col("low")).over(w20)), "volume_ratio": ratio("volume", F.avg("volume").over(w20)),
    })
    df = df.withColumns({"bbw_cut": F.percentile("bbw", F.lit(share)).over(whole()), "atr_cut": F.percentile("atr_share", F.lit(share)).over(whole())})
    flags = {
        "method1": F.col("bbw") < F.col("bbw_cut"), "method2": (F.col("range_ratio") < range_ratio) & (F.col("atr_share") < atr_share),
        "method3": F.col("volume_ratio") < volume_ratio, "method4": F.col("atr_share") < F.col("atr_cut"),
    }
    ahead = {f"fwd_gain_{n}": ratio(F.max("high").over(rows(1, n)), "close") - 1 for n in horizons} | {f"fwd_loss_{n}": ratio(F.min("low").over(rows(1, n)), "close") - 1 for n in horizons}
    return df.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()} | ahead)


def forward_metrics(bars: DataFrame, horizons=(20, 40)) -> DataFrame:
    """Close at a horizon, largest gain and loss up to it; null where it is past the last row."""
    out = {}
    for n in horizons:
        ahead = F.lead("close", n).over(by_date())
        out |= {f"fwd_close_{n}": ahead, f"fwd_max_{n}": F.when(ahead.isNotNull(), ratio(F.max("high").over(rows(1, n)), "close") - 1), f"fwd_min_{n}": F.when(ahead.isNotNull(), ratio(F.min("low").over(rows(1, n)), "close") - 1)}
    return bars.withColumns(out)


def islands(flagged: DataFrame, flag: str, least: int = 5) -> DataFrame:
    """Runs of at least ``least`` flagged rows: start, end, length, bounds and mean volume."""
    group = F.col("rn") - F.sum(F.col(flag).cast("int")).over(by_date().rowsBetween(Window.unboundedPreceding, 0))
    runs = flagged.withColumn("__g", group).where(F.col(flag)).groupBy("ticker", "__g")
    out = runs.agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.max("rn").alias("end_rn"), F.count("*").alias("days"), F.max("high").alias("upper"), F.min("low").alias("lower"), F.avg("volume").alias("mean_volume"))
    return out.where(F.col("days") >= least).drop("__g")


def latest_status(flagged: DataFrame, flag: str, n: int = 30) -> DataFrame:
    """Each ticker's last row: whether it is flagged, and how many of its last n rows are."""
    df = flagged.withColumns({"__last": F.row_number().over(whole().orderBy(F.desc("date"))), "days": F.sum(F.col(flag).cast("int")).over(rows(1 - n, 0))})
    return df.where("__last = 1").select("ticker", "date", F.col(flag).alias("now"), "days", "close")


def grid_patterns(bars: DataFrame, n: int = 20, every: int = 10, share: float = 0.3, warm_up: int = 60) -> DataFrame:
    """Windows of n rows that end at every tenth row and are among the ticker's narrowest ``share``.

    Gives pattern_id, ticker, start and end, upper, lower and trigger price, box width, mean volume and money.
    """
    df = bars.withColumns({"upper": high("high", n), "lower": low("low", n), "start_date": F.lag("date", n - 1).over(by_date()), "mean_volume": mean("volume", n), "money": mean(F.col("close") * F.col("volume"), n)})
    df = df.where((F.col("rn") >= warm_up) & (F.col("rn") % every == 0)).withColumn("box_width", ratio(F.col("upper") - F.col("lower"), "lower"))
    narrow = df.withColumn("__cut", F.percentile("box_width", F.lit(share)).over(whole())).where("box_width <= __cut")
    return narrow.select(F.concat_ws("-", "ticker", "rn").alias("pattern_id"), "ticker", "start_date", F.col("date").alias("end_date"), F.col("rn").alias("end_rn"), "upper", "lower", "box_width", "close", "mean_volume", "money")


def sleepers(bars: DataFrame, n: int = 60, wick: float = 5.0, body: float = 3.0, trigger: float = 1.05, least_money: float = 0.0, idle_rows: int = 4, fast: int = 50, slow: int = 200) -> DataFrame:
    """Rows whose last n rows are tight by quantiles of highs, lows and closes, with the close above the fast average and
    that above the slow one, and liquid: enough mean money of 20 rows and few rows without volume."""
    q = lambda c, p: quantile(c, p, n)
    df = bars.withColumns({"upper": q("high", 0.95), "lower": q("low", 0.1), "__b1": q("close", 0.95), "__b0": q("close", 0.1), "__fast": mean("close", fast), "__slow": mean("close", slow), "money": mean(F.col("close") * F.col("volume"), 20), "idle": total(F.when(F.col("volume") <= 0, 1).otherwise(0), 20)})
    df = df.withColumns({"wick_width": ratio(F.col("upper") - F.col("lower"), "lower"), "body_width": ratio(F.col("__b1") - F.col("__b0"), "__b0"), "trigger": F.col("upper") * trigger})
    tight, rising = (F.col("wick_width") < wick) & (F.col("body_width") < body), (F.col("close") > F.col("__fast")) & (F.col("__fast") > F.col("__slow"))
    return df.where(tight & rising & (F.col("idle") <= idle_rows) & (F.col("money") >= least_money)).drop("__b1", "__b0", "__fast", "__slow")


def accumulation_days(bars: DataFrame, n: int = 90, times: float = 3.0, still: float = 0.025) -> DataFrame:
    """How many of the last n rows have very large volume and hardly move."""
    quiet = (F.col("volume") > times * mean("volume", 50)) & (F.abs("ret") < still)
    return bars.withColumn("__q", F.coalesce(quiet, F.lit(False)).cast("int")).withColumn("accumulation", F.sum("__q").over(rows(1 - n, 0))).drop("__q")


def money_tiers(bars: DataFrame, bounds=(10_000.0, 30_000.0, 60_000.0, 100_000.0)) -> DataFrame:
    """Each ticker's tier by the median of its 40-row mean money."""
    df = bars.withColumn("__m", mean(F.col("close") * F.col("volume"), 40)).groupBy("ticker").agg(F.percentile("__m", F.lit(0.5)).alias("money"))
    names = ("nano", "micro", "small", "mid")
    tier = F.when(F.col("money") < bounds[0], names[0])
    for name, bound in zip(names[1:], bounds[1:], strict=True):
        tier = tier.when(F.col("money") < bound, name)
    return df.withColumn("tier", tier.otherwise("large"))


def coils(bars: DataFrame, n: int = 40, width: float = 0.06, cheap_width: float = 0.15, cheap: float = 1.0, direction: float = 20.0, rvol: float = 0.5) -> DataFrame:
    """Rows with a narrow range of n rows (wider below a price), no direction and low relative volume."""
    from tapewright.operators.features import relative_volume

    df = relative_volume(bars).withColumns({"coil_range": ratio(high("high", n) - low("low", n), low("low", n)), "support": low("low", n)})
    narrow = F.col("coil_range") <= F.when(F.col("close") < cheap, cheap_width).otherwise(width)
    return df.where(narrow & (F.col("adx_filled") <= direction) & (F.col("rvol") <= rvol))


def accumulation_score(bars: DataFrame) -> DataFrame:
    """Points of each ticker's last row: contraction, buying volume, strong closes, distance from the yearly low."""
    span = F.col("high") - F.col("low")
    df = bars.withColumns({
        "__c": ratio(mean(span, 10), rolling(F.avg, span, 10, back=10)), "__up": total(F.when(F.col("ret") > 0, F.col("volume")).otherwise(0.0), 20), "__dn": total(F.when(F.col("ret") < 0, F.col("volume")).otherwise(0.0), 20),
        "__strong": mean(F.when(F.col("close") >= F.col("high") - 0.4 * span, 1.0).otherwise(0.0), 20), "__far": ratio("close", F.min("low").over(rows(-251, 0))) - 1,
        "__last": F.row_number().over(whole().orderBy(F.desc("date"))),
    }).where("__last = 1")
    buying = F.when(F.col("__dn") > 0, F.col("__up") / F.col("__dn")).otherwise(10.0)
    points = F.when(F.col("__c") < 0.6, 30).otherwise(0) + F.when(buying > 1.5, 25).otherwise(0) + F.when(F.col("__strong") > 0.6, 25).otherwise(0) + F.when(F.col("__far") < 0.5, 20).otherwise(0)
    return df.select("ticker", "date", F.col("__c").alias("contraction"), buying.alias("buying"), F.col("__strong").alias("strong"), F.col("__far").alias("distance"), points.alias("points"), (points >= 70).alias("signal"))


def is_domestic(ticker: Column) -> Column:
    """Whether a ticker has no exchange suffix."""
    return ~ticker.rlike(r"\.[A-Z]{1,3}$")


def multi_duration(bars: DataFrame, shortest: int = 10, longest: int = 60, every: int = 5, first: int = 60, after: int = 30, power: float = 1.005, bbw: float = 0.3, volume: float = 0.35, width: float = 0.65, trend: float = 32.0, least: float = 0.6) -> DataFrame:
    """From every few rows on the shortest window, its length growing by ``every``, in which at least ``least`` of four
    checks hold: a small median of ``bbw``, small means of ``volume_ratio``, ``range_ratio`` and ``adx``.

    Starts lie every max(5, shortest // 2) rows after the first ``first`` ones, and ``after`` rows follow each window.
    Means come from running sums, bounds from minima and maxima over powers of two rows: one order of a ticker's rows
    serves all lengths.
    """
    step, lengths = max(5, shortest // 2), list(range(shortest, longest + 1, every))
    ordered = by_date()
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    means = ("volume_ratio", "range_ratio", "adx")
    df = bars.withColumns({f"__s_{c}": F.sum(F.coalesce(c, F.lit(0.0))).over(upto) for c in means} | {f"__n_{c}": F.count(c).over(upto) for c in means} | {"__rows": F.count("*").over(whole())})
    df = df.withColumns({"__hi0": F.col("high"), "__lo0": F.col("low"), "__bbw": F.collect_list(F.struct("rn", "bbw")).over(ordered.rowsBetween(0, longest - 1))})
    for k in range(1, longest.bit_length()):
        half = 1 << (k - 1)
        df = df.withColumns({f"__hi{k}": F.greatest(f"__hi{k - 1}", F.lead(f"__hi{k - 1}", half).over(ordered)), f"__lo{k}": F.least(f"__lo{k - 1}", F.lead(f"__lo{k - 1}", half).over(ordered))})
    made = {}
    for d in lengths:
        k = d.bit_length() - 1
        rest = d - (1 << k)
        made[f"__u{d}"], made[f"__l{d}"] = F.greatest(f"__hi{k}", F.lead(f"__hi{k}", rest).over(ordered)), F.least(f"__lo{k}", F.lead(f"__lo{k}", rest).over(ordered))
        made[f"__e{d}"] = F.lead("date", d - 1).over(ordered)
        for c in means:
            total, n = F.lead(f"__s_{c}", d - 1).over(ordered) - F.coalesce(F.lag(f"__s_{c}").over(ordered), F.lit(0.0)), F.lead(f"__n_{c}", d - 1).over(ordered) - F.coalesce(F.lag(f"__n_{c}").over(ordered), F.lit(0))
            made[f"__m{d}_{c}"] = ratio(total, n.cast("double"))
    starts = df.withColumns(made).where((F.col("rn") > first) & ((F.col("rn") - 1 - first) % step == 0) & (F.col("rn") - 1 < F.col("__rows") - after))
    windows = []
    for d in lengths:
        seen = F.array_sort(F.filter(F.transform(F.slice("__bbw", 1, d), lambda x: x.bbw), lambda x: x.isNotNull()))
        size = F.size(seen)
        median = F.when(size > 0, (F.get(seen, F.floor((size - 1) / 2).cast("int")) + F.get(seen, F.floor(size / 2).cast("int"))) / 2)
        checks = [median < bbw, F.col(f"__m{d}_volume_ratio") < volume, F.col(f"__m{d}_range_ratio") < width, F.col(f"__m{d}_adx") < trend]
        quality = sum((F.coalesce(c.cast("int"), F.lit(0)) for c in checks[1:]), F.coalesce(checks[0].cast("int"), F.lit(0))) / 4
        fits = F.lit(d) <= F.col("__rows") - (F.col("rn") - 1) - after
        windows.append(F.when(fits & (quality >= least), F.struct(F.lit(d).alias("duration"), F.col(f"__e{d}").alias("end_date"), F.col(f"__u{d}").alias("upper"), F.col(f"__l{d}").alias("lower"), median.alias("mean_bbw"), *[F.col(f"__m{d}_{c}").alias(f"mean_{c}") for c in means], quality.alias("quality"))))
    found = starts.select("ticker", F.col("date").alias("start_date"), F.col("rn").alias("start_rn"), F.coalesce(*windows).alias("w")).where("w IS NOT NULL")
    return found.select("ticker", "start_date", "start_rn", "w.*", (F.col("w.upper") * power).alias("power"), (ratio(F.col("w.upper") - F.col("w.lower"), "w.lower") * 100).alias("range_pct"))
