"""Technical indicators: each function takes prepared bars and returns them with more columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.rolling import by_date, clip, correlation, deviation, ewm, high, lag, low, mean, quantile, ratio, rolling, rows, slope, spread, total

SOFT = 1e-10


def moving_averages(bars: DataFrame, periods=(5, 20, 50)) -> DataFrame:
    return bars.withColumns({f"sma_{n}": mean("close", n) for n in periods})


def bollinger(bars: DataFrame, n: int = 20) -> DataFrame:
    """Width in percent, its leak-safe variant, and the position between the bands."""
    df = bars.withColumns({"__m": mean("close", n), "__s": deviation("close", n), "__pm": mean("close", n, back=1), "__ps": deviation("close", n, back=1)})
    lower, upper = F.col("__m") - 2 * F.col("__s"), F.col("__m") + 2 * F.col("__s")
    return df.withColumns({"bbw": ratio(4 * F.col("__s"), "__m") * 100, "bbw_safe": ratio(4 * F.col("__ps"), "__pm"), "bb_position": ratio(F.col("close") - lower, upper - lower)}).drop("__m", "__s", "__pm", "__ps")


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """Average true range: simple mean (a missing previous close counts as the close), and Wilder's."""
    prev = F.coalesce("pc", "close")
    simple = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
    return ewm(bars.withColumn("atr_simple", mean(simple, n, least=1)), {"atr_wilder": ("tr", 1 / n)})


def moving_exponentials(bars: DataFrame, spans=(12, 26)) -> DataFrame:
    return ewm(bars, {f"ema_{n}": ("close", 2 / (n + 1)) for n in spans})


def directional_movement(bars: DataFrame) -> DataFrame:
    """plus_dm and minus_dm; 0 in the first row."""
    up, down = F.col("high") - lag("high"), lag("low") - F.col("low")
    df = bars.withColumns({"__up": F.coalesce(up, F.lit(0.0)), "__down": F.coalesce(down, F.lit(0.0))})
    plus = F.when((F.col("__up") > F.col("__down")) & (F.col("__up") > 0), F.col("__up")).otherwise(0.0)
    minus = F.when((F.col("__down") > F.col("__up")) & (F.col("__down") > 0), F.col("__down")).otherwise(0.0)
    return df.withColumns({"plus_dm": plus, "minus_dm": minus}).drop("__up", "__down")


def adx(bars: DataFrame, n: int = 14) -> DataFrame:
    """Wilder's: all means are exponential with 1/n."""
    df = ewm(directional_movement(bars), {"__p": ("plus_dm", 1 / n), "__m": ("minus_dm", 1 / n), "__a": ("tr", 1 / n)})
    df = df.withColumns({"plus_di": 100 * F.col("__p") / (F.col("__a") + SOFT), "minus_di": 100 * F.col("__m") / (F.col("__a") + SOFT)})
    df = df.withColumn("__dx", 100 * F.abs(F.col("plus_di") - F.col("minus_di")) / (F.col("plus_di") + F.col("minus_di") + SOFT))
    return ewm(df, {"adx": ("__dx", 1 / n)}).drop("__p", "__m", "__a", "__dx")


def adx_simple(bars: DataFrame, n: int = 14) -> DataFrame:
    """With plain means instead."""
    df = directional_movement(bars).withColumns({"__p": mean("plus_dm", n), "__m": mean("minus_dm", n), "__a": mean("tr", n)})
    plus, minus = 100 * ratio("__p", "__a"), 100 * ratio("__m", "__a")
    df = df.withColumn("__dx", 100 * ratio(F.abs(plus - minus), plus + minus))
    return df.withColumn("adx_simple", mean("__dx", n)).drop("__p", "__m", "__a", "__dx")


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """Wilder's and simple-mean variant."""
    d = F.col("close") - F.col("pc")
    df = bars.withColumns({"__g": F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))), "__l": F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0)))})
    df = ewm(df, {"__eg": ("__g", 1 / n), "__el": ("__l", 1 / n)}).withColumns({"__sg": mean("__g", n), "__sl": mean("__l", n)})
    index = lambda g, x: 100 - 100 / (1 + F.col(g) / (F.col(x) + SOFT))
    return df.withColumns({"rsi": index("__eg", "__el"), "rsi_simple": index("__sg", "__sl")}).drop("__g", "__l", "__eg", "__el", "__sg", "__sl")


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    df = ewm(bars, {"__f": ("close", 2 / (fast + 1)), "__s": ("close", 2 / (slow + 1))}).withColumn("macd", F.col("__f") - F.col("__s"))
    df = ewm(df, {"macd_signal": ("macd", 2 / (signal + 1))}).withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))
    return df.withColumn("macd_cross", F.signum("macd_hist").cast("int")).drop("__f", "__s")


def stochastic(bars: DataFrame, n: int = 14) -> DataFrame:
    df = bars.withColumns({"__lo": low("low", n), "__hi": high("high", n)})
    df = df.withColumn("stoch_k", 100 * ratio(F.col("close") - F.col("__lo"), F.col("__hi") - F.col("__lo")))
    return df.withColumns({"stoch_d": mean("stoch_k", 3), "williams_r": F.col("stoch_k") - 100}).drop("__lo", "__hi")


def cci(bars: DataFrame, n: int = 20) -> DataFrame:
    """Mean absolute deviations are from the window's own mean."""
    df = bars.withColumn("__tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    df = df.withColumns({"__m": mean("__tp", n), "__w": F.collect_list("__tp").over(rows(1 - n, 0))})
    spread_ = F.aggregate("__w", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("__m"))) / n
    return df.withColumn("cci", (F.col("__tp") - F.col("__m")) / (0.015 * spread_ + SOFT)).drop("__tp", "__m", "__w")


def volume_lines(bars: DataFrame) -> DataFrame:
    """On-balance volume, accumulation/distribution, volume-price trend: running sums."""
    sofar = by_date().rowsBetween(Window.unboundedPreceding, 0)
    span = F.col("high") - F.col("low")
    flow = F.when(span > 0, ((F.col("close") - F.col("low")) - (F.col("high") - F.col("close"))) / span).otherwise(0.0) * F.col("volume")
    signed = F.coalesce(F.signum(F.col("close") - F.col("pc")), F.lit(0.0)) * F.col("volume")
    return bars.withColumns({"obv": F.sum(signed).over(sofar), "ad_line": F.sum(flow).over(sofar), "vpt": F.sum(F.coalesce("ret", F.lit(0.0)) * F.col("volume")).over(sofar)})


def money_flow(bars: DataFrame, n: int = 14) -> DataFrame:
    """Chaikin oscillator of the accumulation line, and the money-flow index."""
    df = ewm(volume_lines(bars), {"__a": ("ad_line", 2 / 4), "__b": ("ad_line", 2 / 11)}).withColumn("chaikin", F.col("__a") - F.col("__b"))
    df = df.withColumn("__tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    change, flow = F.col("__tp") - lag("__tp"), F.col("__tp") * F.col("volume")
    df = df.withColumns({"__up": F.when(change > 0, flow).otherwise(0.0), "__dn": F.when(change < 0, flow).otherwise(0.0)})
    up, down = total("__up", n), total("__dn", n)
    return df.withColumn("mfi", 100 - 100 / (1 + up / (down + SOFT))).drop("__a", "__b", "__tp", "__up", "__dn")


def returns(bars: DataFrame, periods=(1, 5, 20)) -> DataFrame:
    return bars.withColumns({f"roc_{n}": ratio("close", lag("close", n)) - 1 for n in periods} | {"log_return": F.ln(ratio("close", "pc"))})


def volatility(bars: DataFrame, periods=(5, 20)) -> DataFrame:
    """Annualised deviation of returns, and its ratio to its mean of 50 rows."""
    df = bars.withColumns({f"vol_{n}": deviation("ret", n) * 252**0.5 for n in periods})
    return df.withColumns({f"vol_ratio_{n}": ratio(f"vol_{n}", mean(f"vol_{n}", 50)) for n in periods})


def channels(bars: DataFrame) -> DataFrame:
    """Position in the Keltner channel, and SMA10 plus two simple ATRs."""
    df = bars.withColumns({"__m": mean("close", 20), "__a": mean("tr", 10), "__m10": mean("close", 10), "__a14": mean("tr", 14)})
    return df.withColumns({"keltner": ratio(F.col("close") - (F.col("__m") - 2 * F.col("__a")), 4 * F.col("__a")), "supertrend": F.col("__m10") + 2 * F.col("__a14")}).drop("__m", "__a", "__m10", "__a14")


def aroon(bars: DataFrame, n: int = 14) -> DataFrame:
    """Of the last n + 1 rows; the latest of equal extremes counts."""
    frame, full = rows(-n, 0), F.count("*").over(rows(-n, 0)) > n
    at = lambda best: (F.lit(n) - (F.col("rn") - best.over(frame))) * 100.0 / n
    up, down = at(F.max_by("rn", F.struct("high", "rn"))), at(F.max_by("rn", F.struct(-F.col("low"), F.col("rn"))))
    df = bars.withColumns({"aroon_up": F.when(full, up), "aroon_down": F.when(full, down)})
    return df.withColumn("aroon_osc", F.col("aroon_up") - F.col("aroon_down"))


def vwap(bars: DataFrame) -> DataFrame:
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    df = bars.withColumns({"__cv": F.col("close") * F.col("volume"), "__tv": tp * F.col("volume")})
    sofar = by_date().rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"vwap_20": ratio(total("__cv", 20), total("volume", 20)), "vwap_tp_5": ratio(total("__tv", 5), total("volume", 5)), "vwap_all": ratio(F.sum("__tv").over(sofar), F.sum("volume").over(sofar))}).drop("__cv", "__tv")


def volume_ratios(bars: DataFrame, n: int = 20) -> DataFrame:
    """Volume to its mean, with and without the row itself, and the mean of 3 rows before to that of 20."""
    return bars.withColumns({"volume_ratio": ratio("volume", mean("volume", n)), "volume_ratio_safe": ratio("volume", mean("volume", n, back=1)), "dry_up": ratio(mean("volume", 3, back=1), mean("volume", n, back=1))})


def daily_range(bars: DataFrame, n: int = 20) -> DataFrame:
    df = bars.withColumn("range", F.col("high") - F.col("low"))
    return df.withColumns({"range_share": ratio("range", "close"), "range_ratio": ratio("range", mean("range", n))})


def percentile_rank(bars: DataFrame, column: str, n: int = 100, out: str = "pct_rank") -> DataFrame:
    """Share of the last n values that are less; over fewer rows of those that there are, and .5 in the first row."""
    df = bars.withColumn("__w", F.collect_list(column).over(rows(1 - n, 0)))
    less = F.size(F.filter("__w", lambda x: x < F.col(column)))
    return df.withColumn(out, F.when(F.col(column).isNull(), None).when(F.col("rn") == 1, 0.5).otherwise(less / F.size("__w"))).drop("__w")


def average_rank(bars: DataFrame, column: str, n: int = 100, least: int = 50, out: str = "avg_rank") -> DataFrame:
    """Share of the last n values up to this one, equal ones counted half and itself whole."""
    df = bars.withColumn("__w", F.collect_list(column).over(rows(1 - n, 0)))
    less, same = F.size(F.filter("__w", lambda x: x < F.col(column))), F.size(F.filter("__w", lambda x: x == F.col(column)))
    return df.withColumn(out, F.when(F.col(column).isNotNull() & (F.size("__w") >= least), (less + (same + 1) / 2) / F.size("__w"))).drop("__w")


def distribution(bars: DataFrame, n: int = 20) -> DataFrame:
    """Quartiles, z-score and bias-corrected skewness of the last n closes."""
    df = bars.withColumns({"q25": quantile("close", 0.25, n), "q75": quantile("close", 0.75, n), "zscore": ratio(F.col("close") - mean("close", n), deviation("close", n))})
    skew = rolling(F.skewness, "close", n) * F.lit((n * (n - 1)) ** 0.5 / (n - 2))
    return df.withColumns({"iqr": F.col("q75") - F.col("q25"), "skew": skew})


def autocorrelation(bars: DataFrame, n: int = 20, lags=(1, 5)) -> DataFrame:
    for k in lags:
        frame = rows(1 - n + k, 0)
        bars = bars.withColumn("__l", lag("ret", k))
        both = F.count(F.when(F.col("__l").isNotNull(), F.col("ret"))).over(frame) == n - k
        bars = bars.withColumn(f"autocorr_{k}", F.when(both, correlation("ret", "__l", frame))).drop("__l")
    return bars


def slopes(bars: DataFrame, periods=(5, 20)) -> DataFrame:
    return bars.withColumns({f"slope_{n}": slope("close", n) for n in periods} | {"vol_decay": clip(slope(F.log1p("volume"), 20), -0.5, 0.5)})


def levels(bars: DataFrame) -> DataFrame:
    """Pivot, first resistance and support of the row before, breaks of the 20 rows before, higher high, lower low, doji."""
    pivot = (lag("high") + lag("low") + F.col("pc")) / 3
    df = bars.withColumn("pivot_level", pivot)
    return df.withColumns({
        "r1": 2 * F.col("pivot_level") - lag("low"), "s1": 2 * F.col("pivot_level") - lag("high"),
        "break_up": F.col("close") > high("high", 20, back=1), "break_down": F.col("close") < low("low", 20, back=1),
        "higher_high": F.col("high") > lag("high"), "lower_low": F.col("low") < lag("low"),
        "doji": F.abs(F.col("close") - F.col("open")) <= 0.1 * (F.col("high") - F.col("low")),
        "engulfing": (F.col("close") > F.col("open")) & (F.col("pc") < lag("open")) & (F.col("close") > lag("open")) & (F.col("open") < F.col("pc")),
    })


def log_ratio(a: Column, b: Column) -> Column:
    return F.log1p(F.greatest(a, F.lit(0.0))) - F.log1p(F.greatest(b, F.lit(0.0)))


def composites(bars: DataFrame) -> DataFrame:
    """Volume-adjusted return, squared-return energy and signed volume share, the first two squashed."""
    df = bars.withColumns({"__r20": ratio("close", lag("close", 20)) - 1, "__vz": ratio(F.col("volume") - mean("volume", 20), deviation("volume", 20)), "__e": F.col("ret") * F.col("ret") * F.col("volume"), "__sv": F.signum("ret") * F.col("volume")})
    energy = ratio(F.col("__e") - mean("__e", 10), deviation("__e", 10))
    return df.withColumns({"var_score": F.tanh(F.col("__vz") * (1 + F.col("__r20"))), "nes_score": F.tanh(energy), "lpf_score": ratio(total("__sv", 14), total(F.when(F.col("ret").isNotNull(), F.col("volume")), 14))}).drop("__r20", "__vz", "__e", "__sv")


def bundle(bars: DataFrame) -> DataFrame:
    """Many rolling columns over one sort: sums, means, median volume, 52-week high, money means."""
    df = bars.withColumn("__dv", F.col("close") * F.col("volume"))
    median = quantile("volume", 0.5, 126)
    return df.withColumns({f"volume_sum_{n}": total("volume", n) for n in (5, 60)} | {"volume_median_126": F.when(median == 0, 1.0).otherwise(median), "sma_200": mean("close", 200), "high_252": high("high", 252), "money_20": mean("__dv", 20), "money_60": mean("__dv", 60)}).drop("__dv")


def trend_quality(bars: DataFrame, n: int = 20) -> DataFrame:
    """Moving statistics over whatever rows there are, R² of the trend, and the compression of the range."""
    frame = rows(1 - n, 0)
    r2 = F.regr_r2("close", F.col("rn").cast("double")).over(frame)
    recent, baseline = mean("tr", 10), mean("tr", 50)
    return bars.withColumns({"part_mean": F.avg("close").over(frame), "part_std": F.stddev_pop("close").over(frame), "part_median": F.percentile("close", F.lit(0.5)).over(frame), "trend_r2": F.when(F.count("close").over(frame) >= n, r2), "compression": recent / F.greatest(baseline, F.lit(1e-4))})


def rank_in_window(bars: DataFrame, n: int = 60) -> DataFrame:
    """Spread-based cross-window measures: slope agreement over several windows, and the reversal flag."""
    df = bars.withColumns({f"__s{k}": slope("close", k) for k in (5, 10, 20)})
    three = F.array("__s5", "__s10", "__s20")
    avg = (F.col("__s5") + F.col("__s10") + F.col("__s20")) / 3
    dev = F.sqrt(F.aggregate(three, F.lit(0.0), lambda a, x: a + (x - avg) * (x - avg)) / 3)
    return df.withColumns({"slope_agreement": 1 / (1 + ratio(dev, F.abs(avg))), "slope_divergence": F.col("__s5") - F.col("__s20"), "reversal": F.signum("__s5") != F.signum("__s20")}).drop("__s5", "__s10", "__s20")


def obv_divergence(bars: DataFrame, n: int = 21) -> DataFrame:
    """Logarithmic difference of the normalised slopes of on-balance volume and price; falling ones count as flat."""
    df = volume_lines(bars)
    norm = lambda c: ratio(slope(c, n), spread(c, n))
    return df.withColumn("obv_divergence", clip(F.when(norm("obv").isNotNull() & norm("close").isNotNull(), log_ratio(norm("obv"), norm("close"))), -5.0, 5.0)).drop("ad_line", "vpt")


def parabolic_stop(bars: DataFrame, step: float = 0.02, most: float = 0.2) -> DataFrame:
    """The parabolic stop-and-reverse of each row, and whether the close is above it; null in the first row.

    Long or short, a stop moves towards the extreme price so far by an acceleration that grows with each new extreme,
    never past the last two rows; where a row crosses it, sides change and the extreme becomes the stop. A row's state
    depends on all before, so that a ticker's rows are folded in order, inside the JVM. Starts short if the second row
    falls by more than it rises.
    """
    state = "struct<long: boolean, sar: double, ep: double, af: double, hi: double, lo: double, out: array<double>>"
    make = lambda long, sar, ep, af, out: f"CAST(named_struct('long', {long}, 'sar', {sar}, 'ep', {ep}, 'af', {af}, 'hi', x.high, 'lo', x.low, 'out', {out}) AS {state})"
    up = lambda sar: f"greatest({sar}, s.hi, x.high)"
    down = lambda sar: f"least({sar}, s.lo, x.low)"
    bind = lambda value, name, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    turn_short = bind(up("s.ep"), "t", make("false", up(f"t + {step}D * (x.low - t)"), "x.low", f"{step}D", "concat(s.out, array(t))"))
    turn_long = bind(down("s.ep"), "t", make("true", down(f"t + {step}D * (x.high - t)"), "x.high", f"{step}D", "concat(s.out, array(t))"))
    faster = f"least(s.af + {step}D, {most}D)"
    go = lambda new, ep, keep: bind(f"struct(IF({new}, {ep}, s.ep) AS ep, IF({new}, {faster}, s.af) AS af)", "e", make("s.long", keep("s.sar + e.af * (e.ep - s.sar)"), "e.ep", "e.af", "concat(s.out, array(s.sar))"))
    long = f"IF(x.low <= s.sar, {turn_short}, {go('x.high > s.ep', 'x.high', down)})"
    short = f"IF(x.high >= s.sar, {turn_long}, {go('x.low < s.ep', 'x.low', up)})"
    a, b = "series[0]", "series[1]"
    falls = f"({a}.low - {b}.low > 0 AND {a}.low - {b}.low > {b}.high - {a}.high)"
    begin = f"CAST(named_struct('long', NOT {falls}, 'sar', IF({falls}, {a}.high, {a}.low), 'ep', IF({falls}, {b}.low, {b}.high), 'af', {step}D, 'hi', {b}.high, 'lo', {b}.low, 'out', array(CAST(NULL AS DOUBLE))) AS {state})"
    fold = f"IF(size(series) > 1, aggregate(slice(series, 2, size(series)), {begin}, (s, x) -> IF(s.long, {long}, {short}), s -> s.out), array(CAST(NULL AS DOUBLE)))"
    series = F.array_sort(F.collect_list(F.struct(F.col("rn").cast("int").alias("rn"), F.col("high").cast("double").alias("high"), F.col("low").cast("double").alias("low"))))
    made = bars.groupBy("ticker").agg(series.alias("series")).select("ticker", F.posexplode(F.expr(fold)).alias("__i", "sar"))
    made = made.select(F.col("ticker").alias("__t"), (F.col("__i") + 1).alias("__rn"), "sar")
    out = bars.join(made, (F.col("ticker") == F.col("__t")) & (F.col("rn") == F.col("__rn"))).drop("__t", "__rn", "__i")
    return out.withColumn("sar_position", F.when(F.col("sar").isNotNull(), F.when(F.col("close") > F.col("sar"), 1).otherwise(-1)))
