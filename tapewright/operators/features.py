"""Feature sets over bars and over the windows of patterns. Features look back only, but for those of outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.rolling import by_date, clip, correlation, high, lag, low, mean, quantile, ratio, rolling, rows, slope, total
from tapewright.operators.indicators import log_ratio
from tapewright.operators.joins import interval
from tapewright.operators.labels import after


def run_length(flag: Column, most: int = 5) -> Column:
    """How many rows in a row up to this one hold, ``most`` at most."""
    last = F.max(F.when(flag, F.lit(0)).otherwise(F.col("rn"))).over(by_date().rowsBetween(Window.unboundedPreceding, 0))
    return F.when(flag, F.least(F.col("rn") - last, F.lit(most))).otherwise(0)


def candles(bars: DataFrame) -> DataFrame:
    """Shape of each bar: body, shadows, positions, candle kinds, runs of rising and falling bars, range expansion."""
    span, body = F.col("high") - F.col("low"), F.col("close") - F.col("open")
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    df = bars.withColumns({
        "body": body, "body_share": ratio(F.abs(body), span), "upper_shadow": ratio(F.col("high") - top, span), "lower_shadow": ratio(bottom - F.col("low"), span),
        "close_place": ratio(F.col("close") - F.col("low"), span), "open_place": ratio(F.col("open") - F.col("low"), span), "range_expansion": ratio(span, mean(span, 20)),
    })
    before = F.lag("body").over(by_date())
    small = F.col("body_share") < 0.3
    flags = {
        "doji": F.col("body_share") < 0.1, "hammer": small & (F.col("lower_shadow") > 0.6) & (F.col("close_place") > 0.7), "shooting_star": small & (F.col("upper_shadow") > 0.6) & (F.col("close_place") < 0.3),
        "bullish_engulfing": (F.col("body") > 0) & (before < 0) & (F.abs("body") > 1.2 * F.abs(before)), "bearish_engulfing": (F.col("body") < 0) & (before > 0) & (F.abs("body") > 1.2 * F.abs(before)),
    }
    df = df.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})
    return df.withColumns({"shadow_balance": F.col("upper_shadow") - F.col("lower_shadow"), "rising_run": run_length(F.col("close") > F.col("open")), "falling_run": run_length(F.col("close") < F.col("open"))})


def intrabar(bars: DataFrame) -> DataFrame:
    """Opening gap, reversal within the bar, momentum carried over from the bar before, inside and outside bars."""
    gap, now = ratio(F.col("open") - F.col("pc"), "pc"), ratio(F.col("close") - F.col("open"), "open")
    span = F.col("high") - F.col("low")
    wicks = (F.least("open", "close") - F.col("low")) + (F.col("high") - F.greatest("open", "close"))
    flags = {
        "gap_up": gap > 0.005, "gap_down": gap < -0.005, "persists": F.signum("ret") == F.signum(now), "above_high": F.col("close") > lag("high"), "below_low": F.col("close") < lag("low"),
        "inside_bar": (F.col("high") <= lag("high")) & (F.col("low") >= lag("low")), "outside_bar": (F.col("high") > lag("high")) & (F.col("low") < lag("low")),
    }
    return bars.withColumns({"opening_gap": gap, "reversal": ratio(wicks, span), "acceleration": ratio(now, "ret")} | {k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})


def pressure(bars: DataFrame, n: int = 20) -> DataFrame:
    """Volume by where in its bar the price closed: buying and selling pressure, and volume to range."""
    span = F.col("high") - F.col("low")
    up, down = F.col("volume") * ratio(F.col("close") - F.col("low"), span), F.col("volume") * ratio(F.col("high") - F.col("close"), span)
    df = bars.withColumns({"buying": F.coalesce(up, F.lit(0.0)), "selling": F.coalesce(down, F.lit(0.0)), "range_per_volume": ratio(span, F.col("volume") / mean("volume", n))})
    at_high, at_low = F.when(ratio(F.col("close") - F.col("low"), span) > 0.8, F.col("volume")).otherwise(0.0), F.when(ratio(F.col("close") - F.col("low"), span) < 0.2, F.col("volume")).otherwise(0.0)
    return df.withColumns({"net_pressure": ratio(total("buying", n) - total("selling", n), total("volume", n)), "volume_at_high": ratio(total(at_high, n), total("volume", n)), "volume_at_low": ratio(total(at_low, n), total("volume", n))})


def efficiency(bars: DataFrame, n: int = 20) -> DataFrame:
    """How straight the price went: its way to the sum of its steps, turning points, alternation and smoothness."""
    df = bars.withColumn("step", F.col("close") - F.col("pc"))
    df = df.withColumn("turn", (F.signum("step") * F.signum(lag("step")) < 0).cast("double"))
    way = F.abs(F.col("close") - lag("close", n))
    return df.withColumns({"path_efficiency": ratio(way, total(F.abs("step"), n)), "turning_points": total("turn", n), "alternation": mean("turn", n), "smoothness": 1 / (1 + ratio(rolling(F.stddev_samp, "step", n), mean(F.abs("step"), n)))})


def volume_build_up(bars: DataFrame) -> DataFrame:
    """Short means of volume, rows above its mean, momentum, and strength over 7 and 10 rows."""
    df = bars.withColumn("volume_20", mean("volume", 20))
    above = (F.col("volume") > F.col("volume_20")).cast("double")
    return df.withColumns({"volume_3": mean("volume", 3), "volume_5": mean("volume", 5), "rows_above_5": total(above, 5), "volume_momentum": ratio(mean("volume", 3), mean("volume", 10)) - 1, "strength_7": ratio(mean("volume", 7), "volume_20"), "strength_10": ratio(mean("volume", 10), "volume_20"), "volume_trend": F.signum(F.round(slope("volume", 10), 6))})


def against_baseline(bars: DataFrame, n: int = 30, back: int = 20) -> DataFrame:
    """Range, volume and deviation of the last rows against means of n rows that end ``back`` rows before."""
    df = bars.withColumns({"bbw": ratio(4 * rolling(F.stddev_samp, "close", 20), mean("close", 20)), "span_share": ratio(F.col("high") - F.col("low"), "close")})
    out = {f"{c}_compression": ratio(mean(c, 20), mean(c, n, back=back)) for c in ("bbw", "volume", "span_share")}
    df = df.withColumns(out)
    kept = F.filter(F.array(*[F.col(c) for c in out]), lambda x: x.isNotNull())
    score = F.aggregate(kept, F.lit(0.0), lambda a, x: a + F.greatest(F.lit(0.0), 1 - x)) / F.nullif(F.size(kept).cast("double"), F.lit(0.0))
    return df.withColumn("compression_score", score)


def weekly_set(weeks: DataFrame) -> DataFrame:
    """Band width in percent, means of 20 and 50 weeks and the close to each, over weekly bars."""
    return weeks.withColumns({"bbw": ratio(4 * rolling(F.stddev_samp, "close", 20), mean("close", 20)) * 100, "sma_20": mean("close", 20), "sma_50": mean("close", 50), "to_20": ratio("close", mean("close", 20)), "to_50": ratio("close", mean("close", 50))})


def relative_volume(bars: DataFrame, n: int = 30) -> DataFrame:
    """Volume to its mean of n rows, money, and the simple directional index with 50 where it is not known."""
    from tapewright.operators.indicators import adx_simple

    return adx_simple(bars).withColumns({"rvol": ratio("volume", mean("volume", n)), "money": F.col("close") * F.col("volume"), "adx_filled": F.coalesce("adx_simple", F.lit(50.0))})


def log_differences(bars: DataFrame) -> DataFrame:
    """Volume of 5 rows against 60, and the range of 5 rows against 60, as differences of logarithms."""
    span = F.col("high") - F.col("low")
    df = bars.withColumns({"__v5": mean("volume", 5), "__v60": mean("volume", 60), "__r5": mean(span, 5), "__r60": mean(span, 60)})
    known = F.col("__v60").isNotNull()
    return df.withColumns({"volume_log_diff": F.when(known, log_ratio(F.col("__v5"), F.col("__v60"))), "range_log_diff": F.when(known, log_ratio(F.col("__r5"), F.col("__r60")))}).drop("__v5", "__v60", "__r5", "__r60")


def boundary_slopes(bars: DataFrame, n: int = 20, last: int = 5, most: float = 3.0) -> DataFrame:
    """Slopes of the last highs and lows, in heights of the box of n rows per ``last`` rows."""
    box = (high("high", n) - low("low", n)) / last
    return bars.withColumns({"upper_slope": clip(ratio(slope("high", last), box), -most, most), "lower_slope": clip(ratio(slope("low", last), box), -most, most)})


def hurst(bars: DataFrame, n: int = 50, lags: int = 20) -> DataFrame:
    """Twice the log-log slope of the root of the deviation of lagged differences over the lag, lags from 2.

    The differences of each lag are a column, whose deviation over its own frame is a window aggregate.
    """
    ks = range(2, lags)
    df = bars.withColumns({f"__d{k}": F.col("close") - lag("close", k) for k in ks})
    df = df.withColumns({f"__s{k}": F.ln(F.sqrt(F.sqrt(F.nullif(F.var_pop(f"__d{k}").over(rows(1 - n + k, 0)), F.lit(0.0))))) for k in ks})
    known = lambda k, x: F.when(F.col(f"__s{k}").isNotNull(), x).otherwise(0.0)
    add = lambda f: sum((f(k) for k in ks[1:]), f(ks[0]))
    from math import log

    m, sx, sxx = add(lambda k: known(k, 1.0)), add(lambda k: known(k, log(k))), add(lambda k: known(k, log(k) ** 2))
    sy, sxy = add(lambda k: known(k, F.col(f"__s{k}"))), add(lambda k: known(k, F.col(f"__s{k}") * log(k)))
    full = F.count("close").over(rows(1 - n, 0)) >= n
    return df.withColumn("hurst", F.when(full & (m >= 2), 2 * ratio(m * sxy - sx * sy, m * sxx - sx * sx))).drop(*[f"__{c}{k}" for k in ks for c in "ds"])


# windows of patterns


def _inside(patterns: DataFrame, bars: DataFrame) -> DataFrame:
    """Pattern rows with their place from the start (at, from 1), how many there are (n), and the close before."""
    w = Window.partitionBy("pattern_id").orderBy("b_date")
    df = interval(patterns, bars)
    return df.withColumns({"at": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy("pattern_id")), "b_prev": F.lag("b_close").over(w), "b_ret": F.col("b_close") / F.nullif(F.lag("b_close").over(w), F.lit(0.0)) - 1})


def _share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def place_in_range(patterns: DataFrame, bars: DataFrame) -> DataFrame:
    """Position in the box, time in its zones, touches of its bounds (within 0.5 %), and rows since the last of them."""
    height = F.col("upper") - F.col("lower")
    at = ratio(F.col("b_close") - F.col("lower"), height)
    top, bottom = F.col("b_close") >= F.col("upper") - 0.25 * height, F.col("b_close") <= F.col("lower") + 0.25 * height
    up, down = F.col("b_high") >= F.col("upper") * 0.995, F.col("b_low") <= F.col("lower") * 1.005
    last = lambda c: F.coalesce(F.max("n") - F.max(F.when(c, F.col("at"))), F.max("n"))
    out = _inside(patterns, bars).groupBy("pattern_id").agg(F.avg(at).alias("mean_position"), _share(top).alias("time_high"), _share(bottom).alias("time_low"), _share(~top & ~bottom).alias("time_middle"), F.max_by(at, "at").alias("final_position"), F.count_if(up).alias("upper_touches"), F.count_if(down).alias("lower_touches"), last(up).alias("rows_since_upper"), last(down).alias("rows_since_lower"), F.count("*").alias("n"))
    both = F.col("upper_touches") + F.col("lower_touches")
    return out.withColumns({"touch_ratio": both / F.col("n"), "touch_balance": F.coalesce(ratio(F.col("upper_touches").cast("double"), both.cast("double")), F.lit(0.5))})


def volume_and_volatility(patterns: DataFrame, bars: DataFrame) -> DataFrame:
    """Trend, variation, contraction and spikes of volume; moments of returns, range and true range, in the window."""
    df = _inside(patterns, bars)
    every = Window.partitionBy("pattern_id")
    spike = F.col("b_volume") > F.avg("b_volume").over(every) + 2 * F.stddev_pop("b_volume").over(every)
    true_range = F.when(F.col("at") > 1, F.greatest(F.col("b_high") - F.col("b_low"), F.abs(F.col("b_high") - F.col("b_prev")), F.abs(F.col("b_low") - F.col("b_prev"))))
    span = (F.col("b_high") - F.col("b_low")) / F.nullif(F.col("b_low"), F.lit(0.0)) * 100
    df = df.withColumns({"__spike": spike, "__tr": true_range, "__span": span})
    late, early = F.avg(F.when(F.col("at") > F.col("n") - 10, F.col("b_volume"))), F.avg(F.when(F.col("at") <= 10, F.col("b_volume")))
    out = df.groupBy("pattern_id").agg(
        F.regr_slope("b_volume", F.col("at").cast("double")).alias("volume_slope"), ratio(F.stddev_pop("b_volume"), F.avg("b_volume")).alias("volume_cv"), F.when(F.max("n") >= 20, ratio(late, early)).alias("volume_contraction"), F.count_if("__spike").alias("volume_spikes"),
        F.avg("b_ret").alias("ret_mean"), F.stddev_pop("b_ret").alias("ret_std"), F.skewness("b_ret").alias("ret_skew"), F.avg("__span").alias("mean_range"), F.stddev_pop("__span").alias("range_std"), F.avg("__tr").alias("mean_true_range"), (ratio(F.avg("__tr"), F.avg("b_close")) * 100).alias("atr_percent"),
    )
    return out


def quality(patterns: DataFrame, bars: DataFrame) -> DataFrame:
    """Tightness, consistency, compression of the second half against the first, balance, and the mean of these."""
    half = F.floor(F.col("n") / 2)
    out_of = (F.col("b_high") > F.col("upper") * 1.01) | (F.col("b_low") < F.col("lower") * 0.99)
    above = F.col("b_close") > (F.col("upper") + F.col("lower")) / 2
    df = _inside(patterns, bars).withColumns({"__first": F.when((F.col("at") <= half) & (F.col("at") > 1), F.col("b_ret")), "__second": F.when(F.col("at") > half + 1, F.col("b_ret"))})
    tight = 1 / (ratio(F.first("upper") - F.first("lower"), F.first("lower")) * 100)
    out = df.groupBy("pattern_id").agg(tight.alias("tightness"), (1 - _share(out_of)).alias("consistency"), F.coalesce(ratio(F.stddev_pop("__second"), F.stddev_pop("__first")), F.lit(1.0)).alias("compression"), (1 - F.abs(_share(above) - _share(~above))).alias("balance"))
    return out.withColumn("overall", (F.least(F.col("tightness") * 10, F.lit(1.0)) + F.col("consistency") + F.col("balance") + (1 - F.least("compression", F.lit(1.0)))) / 4)


def gaps(patterns: DataFrame, bars: DataFrame, least: float = 0.01) -> DataFrame:
    """Opening gaps above ``least`` in the window: how many up and down, their mean size, the share filled that day."""
    gap = F.col("b_open") / F.nullif(F.col("b_prev"), F.lit(0.0)) - 1
    up, down = gap > least, gap < -least
    filled = (up & (F.col("b_low") <= F.col("b_prev"))) | (down & (F.col("b_high") >= F.col("b_prev")))
    out = _inside(patterns, bars).groupBy("pattern_id").agg(F.count_if(up).alias("gaps_up"), F.count_if(down).alias("gaps_down"), F.avg(F.when(up | down, F.abs(gap))).alias("mean_gap"), F.avg(F.when(up | down, filled.cast("double"))).alias("fill_rate"))
    return out


def coil_at_end(patterns: DataFrame, bars: DataFrame, danger: float = 0.3) -> DataFrame:
    """At the pattern's last row: price position, volume shock, band width and its slope, and how coiled it is."""
    df = bars.withColumns({"c_bbw": ratio(4 * rolling(F.stddev_samp, "close", 20), mean("close", 20)), "c_shock": ratio(high("volume", 3), mean("volume", 20, back=3)), "c_trend": ratio(mean("volume", 5), mean("volume", 20)) - 1})
    df = df.withColumn("c_slope", slope("c_bbw", 5)).select(F.col("ticker").alias("c_ticker"), F.col("rn").alias("c_rn"), "c_bbw", "c_shock", "c_trend", "c_slope")
    joined = patterns.join(df, (F.col("ticker") == F.col("c_ticker")) & (F.col("end_rn") == F.col("c_rn")))
    at = ratio(F.col("close") - F.col("lower"), F.col("upper") - F.col("lower"))
    coil = (F.least(F.greatest(1 - at, F.lit(0.0)), F.lit(1.0)) + F.when(F.col("c_slope") < 0, 1.0).otherwise(0.0) + F.when(F.col("c_trend") < 0, 1.0).otherwise(0.0)) / 3
    return joined.select("pattern_id", at.alias("price_position"), (at <= danger).alias("in_danger"), F.col("c_shock").alias("volume_shock"), F.col("c_bbw").alias("bbw"), F.col("c_slope").alias("bbw_slope"), F.col("c_trend").alias("volume_trend"), coil.alias("coil_intensity"))


def time_to_peak(patterns: DataFrame, bars: DataFrame, n: int = 100) -> DataFrame:
    """When the highest and the lowest of n closes come (the pattern's last row is day 0 and their base), how fast, how
    much of the gain stays at the end, and how steadily it rose (fwd_ columns). With fewer rows all are 0."""
    own = Window.partitionBy("pattern_id")
    j = after(patterns, bars, n - 1, first=0)
    j = j.withColumns({"peak_day": F.min_by("day", F.struct(-F.col("b_close"), F.col("day"))).over(own), "b_ret": F.col("b_close") / F.lag("b_close").over(own.orderBy("day")) - 1})
    up = F.col("day").between(1, F.col("peak_day"))
    out = j.groupBy("pattern_id", "close", "peak_day").agg(
        F.count("*").alias("k"), F.max("b_close").alias("peak"), F.min("b_close").alias("least"), F.min_by("day", F.struct("b_close", "day")).alias("trough_day"), F.max_by("b_close", "day").alias("last"),
        F.min(F.when(F.col("day") >= F.col("peak_day"), F.col("b_close"))).alias("low_after"), F.count_if(up & (F.col("b_ret") > 0)).alias("rising"), F.stddev_pop(F.when(up, F.col("b_ret"))).alias("spread"),
    )
    gain, end, at = F.col("peak") / F.col("close") - 1, F.col("last") / F.col("close") - 1, F.col("peak_day")
    fall = F.when(at < n - 1, F.col("low_after") / F.col("peak") - 1).otherwise(0.0)
    stays = F.when(gain > 0, end / gain).otherwise(0.0)
    recovery = F.when((fall < -0.05) & (F.col("last") > F.col("peak") * 0.95), 1.0).when((fall < -0.05) & (F.col("last") > F.col("peak") * 0.9), 0.5).otherwise(0.0)
    velocity, ratio_, whole = F.when(at > 0, gain / at).otherwise(0.0), at / (n - 1), F.col("k") >= n
    values = {
        "peak_day": at, "trough_day": F.col("trough_day"), "fwd_gain": gain, "fwd_loss": F.col("least") / F.col("close") - 1, "fwd_end": end, "fwd_velocity": velocity, "fwd_sustainability": stays,
        "fwd_retention": clip(stays, 0.0, 1.0), "fwd_fall": fall, "fwd_recovery": recovery, "fwd_consistency": F.when(at > 1, F.col("rising") / at).otherwise(0.0), "fwd_spread": F.when(at > 1, F.col("spread")).otherwise(0.0),
        "explosive": ((velocity > 0.03) & (at <= 30) & (gain >= 0.4)).cast("int"), "grind": ((at > 60) & (gain >= 0.4)).cast("int"), "peak_at": ratio_,
    }
    timing = F.when(~whole, "unknown").when(ratio_ < 0.33, "early").when(ratio_ < 0.66, "mid").otherwise("late")
    return out.select("pattern_id", *[F.when(whole, v).otherwise(0).alias(k) for k, v in values.items()], timing.alias("timing"))


def move_class(timed: DataFrame) -> DataFrame:
    """Ordered rules over :func:`time_to_peak`: the first that holds names the move and its score."""
    gain, speed, stays = F.col("fwd_gain"), F.col("fwd_velocity"), F.col("fwd_sustainability")
    fast = (speed > 0.025) & (gain >= 0.4)
    rules = (
        ("explosive_high_quality", 1.0, fast & (stays > 0.7)), ("explosive_reversal", 0.5, fast & (stays < 0.5)), ("slow_grind", 0.3, (F.col("peak_day") > 60) & (gain >= 0.4)),
        ("moderate_quality", 0.6, (speed > 0.015) & (gain >= 0.25) & (stays > 0.6)), ("failed", 0.0, gain < 0.15),
    )
    name, score = F.when(F.lit(False), ""), F.when(F.lit(False), 0.0)
    for move, value, holds in rules:
        name, score = name.when(holds, move), score.when(holds, value)
    return timed.withColumns({"move": name.otherwise("mixed"), "move_score": score.otherwise(0.4)})


def ignition(bars: DataFrame, n: int = 20, threshold: float = 0.5) -> DataFrame:
    """Score of the last row: position .40, volume .30, band width turning up .15, a rising bar .10, direction .05."""
    df = relative_volume(bars).withColumns({"__bbw": ratio(4 * rolling(F.stddev_samp, "close", n), mean("close", n)), "__at": ratio(F.col("close") - low("low", n), high("high", n) - low("low", n))})
    df = df.withColumn("__slope", slope("__bbw", 5))
    inside = lambda x: clip(x, 0.0, 1.0)
    score = 0.4 * inside(F.col("__at")) + 0.3 * inside((F.col("rvol") - 1) / 2) + 0.15 * (F.col("__slope") > 0).cast("double") + 0.1 * (F.col("close") > F.col("open")).cast("double") + 0.05 * inside(F.col("adx_filled") / 50)
    return df.withColumn("ignition", score).withColumn("ignites", F.col("ignition") >= threshold).drop("__bbw", "__at", "__slope")


def relative_strength(bars: DataFrame, n: int = 20, least: int = 3) -> DataFrame:
    """Return of n rows less the day's median over all tickers, the last known one where too few have any."""
    df = bars.withColumn("ret_n", ratio("close", lag("close", n)) - 1)
    days = df.groupBy("date").agg(F.percentile("ret_n", F.lit(0.5)).alias("m"), F.count("ret_n").alias("k"))
    # one row a day: few, whatever the number of tickers
    filled = days.withColumn("cohort", F.last(F.when(F.col("k") >= least, F.col("m")), ignorenulls=True).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))
    return df.join(filled.select("date", "cohort"), "date").withColumn("relative", F.col("ret_n") - F.col("cohort"))


#: The ranges to which values of the context vector are clipped and scaled.
CONTEXT_RANGES = {"box_width": (0.0, 30.0), "to_sma_200": (0.0, 3.0), "to_high_252": (0.0, 1.0), "money_log": (0.0, 20.0), "volume_log_diff": (-3.0, 3.0), "range_log_diff": (-3.0, 3.0), "ret_20": (-1.0, 3.0), "bbw": (0.0, 4.0), "position": (0.0, 1.0), "vol_decay": (-0.5, 0.5)}


def context_vector(patterns: DataFrame, bars: DataFrame) -> DataFrame:
    """Values at the pattern's last row, clipped to fixed ranges and scaled to 0 to 1; .5 where not known."""
    df = log_differences(bars).withColumns({"c_sma": mean("close", 200), "c_high": high("high", 252, least=1), "c_ret": ratio("close", lag("close", 20)) - 1, "c_bbw": ratio(4 * rolling(F.stddev_samp, "close", 20), mean("close", 20)), "c_decay": slope(F.log1p("volume"), 20)})
    df = df.select(F.col("ticker").alias("c_ticker"), F.col("rn").alias("c_rn"), "c_sma", "c_high", "c_ret", "c_bbw", "c_decay", F.col("volume_log_diff").alias("c_vol"), F.col("range_log_diff").alias("c_range"))
    j = patterns.join(df, (F.col("ticker") == F.col("c_ticker")) & (F.col("end_rn") == F.col("c_rn")))
    value = {"box_width": F.col("box_width"), "to_sma_200": ratio("close", "c_sma"), "to_high_252": ratio("close", "c_high"), "money_log": F.log1p("money"), "volume_log_diff": F.col("c_vol"), "range_log_diff": F.col("c_range"), "ret_20": F.col("c_ret"), "bbw": F.col("c_bbw"), "position": ratio(F.col("close") - F.col("lower"), F.col("upper") - F.col("lower")), "vol_decay": F.col("c_decay")}
    scaled = {k: F.coalesce((clip(value[k], *CONTEXT_RANGES[k]) - CONTEXT_RANGES[k][0]) / (CONTEXT_RANGES[k][1] - CONTEXT_RANGES[k][0]), F.lit(0.5)) for k in CONTEXT_RANGES}
    return j.select("pattern_id", *[v.alias(k) for k, v in scaled.items()])


def interaction_importance(df: DataFrame, features: list[str], target: str, top: int = 10) -> DataFrame:
    """Products of two features, and each by its absolute correlation with the target; the ``top`` ones."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    products = df.select(target, *[(F.col(a) * F.col(b)).alias(f"{a}*{b}") for a, b in pairs])
    names = [f"{a}*{b}" for a, b in pairs]
    one = products.agg(*[F.abs(correlation(f"`{n}`", target)).alias(n) for n in names])
    return one.unpivot([], [F.col(f"`{n}`") for n in names], "feature", "importance").orderBy(F.desc("importance"), "feature").limit(top)


def quartile_profile(bars: DataFrame, n: int = 20) -> DataFrame:
    """Vol-of-vol of the band width: deviation, smoothness, slope, range and position of its last n values."""
    df = bars.withColumn("bbw", ratio(4 * rolling(F.stddev_samp, "close", 20), mean("close", 20)))
    df = df.withColumn("__d", F.abs(F.col("bbw") - F.lag("bbw").over(by_date())))
    return df.withColumns({"bbw_std": rolling(F.stddev_samp, "bbw", n), "bbw_smooth": 1 / (1 + ratio(mean("__d", n), mean("bbw", n))), "bbw_slope": slope("bbw", n), "bbw_range": high("bbw", n) - low("bbw", n), "bbw_position": ratio(F.col("bbw") - low("bbw", n), high("bbw", n) - low("bbw", n))}).drop("__d")


def regime_shifts(bars: DataFrame, n: int = 20, bound: float = 2.0) -> DataFrame:
    """Rows where the band width lies so many deviations off its mean, which way, and rows since the last one."""
    df = quartile_profile(bars, n).withColumn("z", ratio(F.col("bbw") - mean("bbw", n, back=1), rolling(F.stddev_samp, "bbw", n, back=1)))
    df = df.withColumn("shift", F.coalesce(F.abs("z") > bound, F.lit(False)))
    last = F.last(F.when(F.col("shift"), F.col("rn")), ignorenulls=True).over(by_date().rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumns({"regime": F.when(F.col("z") > bound, 1).when(F.col("z") < -bound, -1).otherwise(0), "rows_since_shift": F.col("rn") - last})
