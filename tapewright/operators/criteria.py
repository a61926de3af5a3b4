"""Criteria of a consolidation by day, the state machine that follows them, and what is derived from a detected window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.rolling import by_date, deviation, lag, mean, quantile, ratio, rolling, rows, spread, total
from tapewright.operators.indicators import adx, average_rank, percentile_rank
from tapewright.operators.labels import after


def measured(bars: DataFrame, n: int = 20) -> DataFrame:
    """What the criteria look at: percentile of the band width, Wilder's ADX, volume and range to their means."""
    df = adx(bars).withColumns({"bbw": ratio(4 * rolling(F.stddev_samp, "close", n), mean("close", n)), "volume_ratio": ratio("volume", mean("volume", n)), "range_ratio": ratio(F.col("high") - F.col("low"), mean(F.col("high") - F.col("low"), n))})
    return percentile_rank(df, "bbw", out="bbw_rank")


def strict(bbw: float = 0.3, adx_: float = 32.0, volume: float = 0.35, span: float = 0.65) -> Column:
    """All four criteria hold; unknown values fail."""
    return F.coalesce((F.col("bbw_rank") < bbw) & (F.col("adx") < adx_) & (F.col("volume_ratio") < volume) & (F.col("range_ratio") < span), F.lit(False))


def relaxed(bbw: float = 0.3, adx_: float = 32.0, volume: float = 0.35, span: float = 0.65) -> Column:
    """The band width and at least two of the other three."""
    others = sum((F.coalesce(c, F.lit(False)).cast("int") for c in (F.col("volume_ratio") < volume, F.col("range_ratio") < span)), F.coalesce(F.col("adx") < adx_, F.lit(False)).cast("int"))
    return F.coalesce(F.col("bbw_rank") < bbw, F.lit(False)) & (others >= 2)


def consolidations(bars: DataFrame, meets: str, qualifying: int = 10, timeout: int = 90, power: float = 0.005, quantiles: tuple[float, float] | None = None, least_width: float = 0.0) -> DataFrame:
    """Patterns of a machine that waits for a row that ``meets``, then for ``qualifying`` rows that all do, takes its
    bounds from these, and is active until the close leaves them or the time is over.

    The bounds are the largest high and smallest low of the qualifying rows, or with ``quantiles`` those quantiles of
    them; a pattern narrower than ``least_width`` isn't begun. A row that fails ends the qualification and starts no new
    one. One pattern at a time; one that is active at the last row isn't given. A ticker's rows are folded in order in
    one array, where each row waits for what those before it led to.
    """
    state = "struct<phase: int, start: int, days: int, highs: array<double>, lows: array<double>, upper: double, lower: double>"
    pattern = "struct<start_rn: int, active_rn: int, end_rn: int, upper: double, lower: double, days: int, exit: string>"
    none = f"CAST(struct(0, 0, 0, array(), array(), 0D, 0D) AS {state})"

    def bound(values: str, p: float | None, extreme: str) -> str:
        if p is None:
            return f"array_{extreme}({values})"
        at = f"((size({values}) - 1) * {p}D)"
        value = lambda f: f"element_at(array_sort({values}), CAST({f}({at}) AS INT) + 1)"
        return f"({value('floor')} + ({value('ceil')} - {value('floor')}) * ({at} - floor({at})))"

    up, down = (None, None) if quantiles is None else quantiles
    grown = "struct(1 AS phase, s.start AS start, s.days + 1 AS days, concat(s.highs, array(x.high)) AS highs, concat(s.lows, array(x.low)) AS lows, 0D AS upper, 0D AS lower)"
    bounds = lambda g: f"struct(2 AS phase, {g}.start AS start, {g}.days AS days, {g}.highs AS highs, {g}.lows AS lows, {bound(f'{g}.highs', up, 'max')} AS upper, {bound(f'{g}.lows', down, 'min')} AS lower)"
    bind = lambda value, name, then: f"element_at(transform(array({value}), {name} -> {then}), 1)"
    begun = bind(bounds("g"), "t", f"CASE WHEN t.upper >= t.lower * {1 + least_width}D THEN CAST(t AS {state}) ELSE {none} END")
    qualify = f"CASE WHEN NOT x.meets THEN {none} ELSE {bind(grown, 'g', f'CASE WHEN g.days >= {qualifying} THEN {begun} ELSE CAST(g AS {state}) END')} END"
    leaves = f"CASE WHEN x.close > s.upper * {1 + power}D THEN 'UP' WHEN x.close < s.lower THEN 'DOWN' WHEN s.days + 1 > {timeout} THEN 'TIMEOUT' END"
    active = f"CASE WHEN {leaves} IS NOT NULL THEN {none} ELSE CAST(struct(2 AS phase, s.start AS start, s.days + 1 AS days, s.highs, s.lows, s.upper, s.lower) AS {state}) END"
    first = f"CASE WHEN x.meets THEN CAST(struct(1, x.rn, 0, array(), array(), 0D, 0D) AS {state}) ELSE {none} END"
    step = f"CASE s.phase WHEN 0 THEN {first} WHEN 1 THEN {qualify} ELSE {active} END"
    gives = f"CASE WHEN s.phase = 2 AND {leaves} IS NOT NULL THEN array(CAST(struct(s.start, s.start + {qualifying}, x.rn, s.upper, s.lower, s.days + 1, {leaves}) AS {pattern})) ELSE CAST(array() AS array<{pattern}>) END"
    fold = f"aggregate(series, struct({none} AS s, CAST(array() AS array<{pattern}>) AS out), (a, x) -> {bind('a.s', 's', f'struct({step} AS s, concat(a.out, {gives}) AS out)')}, a -> a.out)"
    series = F.array_sort(F.collect_list(F.struct(F.col("rn").cast("int").alias("rn"), F.col("high").cast("double").alias("high"), F.col("low").cast("double").alias("low"), F.col("close").cast("double").alias("close"), F.coalesce(meets, F.lit(False)).alias("meets"))))
    found = bars.groupBy("ticker").agg(series.alias("series")).select("ticker", F.explode(F.expr(fold)).alias("p"))
    return found.select("ticker", "p.*")


def method_bounds(bars: DataFrame, share: float = 0.3, range_ratio: float = 0.65, adx: float = 32.0, volume_ratio: float = 0.35, volatility: float = 0.4, m2_width: float = 0.15, m3_width: float = 0.12, atrs: float = 1.5, power: float = 1.005) -> DataFrame:
    """Four methods by day, each with the box that it sees: bounds are null where the method doesn't hold.

    1: the band width ranks low among 100 rows; 2: a small daily range and no trend, in a narrow box of 11 rows; 3: small
    volume in a narrow box of 16 rows; 4: the average true range ranks low and volatility is small, bounds so many of it
    off the close but within the last 21 rows. Methods 1 and 4 need 100 rows before, the others 20.
    """
    dm_up, dm_down = F.col("high") - lag("high"), lag("low") - F.col("low")
    df = bars.withColumns({
        "bb_width": ratio(4 * deviation("close", 20, 15), mean("close", 20, 15)), "atr_14": mean("tr", 14, 10), "volatility_20": deviation("ret", 20, 15) * 252**0.5,
        "volume_ratio_20": ratio("volume", mean("volume", 20, 15)), "daily_range": ratio(F.col("high") - F.col("low"), "close"),
        "__up": F.when(dm_up > dm_down, F.greatest(dm_up, F.lit(0.0))).otherwise(0.0), "__down": F.when(dm_down > dm_up, F.greatest(dm_down, F.lit(0.0))).otherwise(0.0),
    })
    df = df.withColumns({"range_ratio_20": ratio("daily_range", mean("daily_range", 20, 15)), "__p": 100 * ratio(mean("__up", 14, 10), "atr_14"), "__m": 100 * ratio(mean("__down", 14, 10), "atr_14")})
    dx = F.when(F.col("__p") + F.col("__m") > 0, 100 * F.abs(F.col("__p") - F.col("__m")) / (F.col("__p") + F.col("__m")))
    df = df.withColumn("__dx", dx).withColumn("adx_10", mean("__dx", 14, 10))
    df = average_rank(average_rank(df, "bb_width", out="bb_rank"), "atr_14", out="atr_rank")
    box = {n: (F.max("high").over(rows(-n, 0)), F.min("low").over(rows(-n, 0))) for n in (20, 10, 15)}
    df = df.withColumns({f"__{side}{n}": pair[k] for n, pair in box.items() for k, side in enumerate(("top", "bottom"))})
    width = lambda n: (F.col(f"__top{n}") - F.col(f"__bottom{n}")) / F.col("close")
    long, short, priced = F.col("rn") > 100, F.col("rn") > 20, F.col("close") > 0
    holds = {
        1: long & (F.col("bb_rank") < share), 2: short & (F.col("range_ratio_20") < range_ratio) & (F.col("adx_10") < adx) & priced & (width(10) < m2_width),
        3: short & (F.col("volume_ratio_20") < volume_ratio) & priced & (width(15) < m3_width), 4: long & (F.col("atr_rank") < share) & (F.col("volatility_20") < volatility) & (F.col("atr_14") > 0),
    }
    upper = {k: F.col(f"__top{n}") for k, n in ((1, 20), (2, 10), (3, 15))} | {4: F.least(F.col("close") + atrs * F.col("atr_14"), F.col("__top20"))}
    lower = {k: F.col(f"__bottom{n}") for k, n in ((1, 20), (2, 10), (3, 15))} | {4: F.greatest(F.col("close") - atrs * F.col("atr_14"), F.col("__bottom20"))}
    out = {}
    for k, condition in holds.items():
        out |= {f"m{k}": F.coalesce(condition, F.lit(False)), f"m{k}_upper": F.when(condition, upper[k]), f"m{k}_lower": F.when(condition, lower[k]), f"m{k}_power": F.when(condition, upper[k] * power)}
    return df.withColumns(out).drop(*[c for c in df.columns if c.startswith("__")])


def candidate_rows(bars: DataFrame, n: int = 60, wick: float = 5.0, body: float = 3.0) -> DataFrame:
    """Rows whose last n rows are narrow by quantiles of highs and lows, and of closes: the cheap test before others."""
    q = lambda c, p: quantile(c, p, n)
    df = bars.withColumns({"upper": q("high", 0.95), "lower": q("low", 0.1), "top": q("close", 0.95), "bottom": q("close", 0.1)})
    df = df.withColumns({"wick_width": ratio(F.col("upper") - F.col("lower"), "lower"), "body_width": ratio(F.col("top") - F.col("bottom"), "bottom")})
    return df.where((F.col("wick_width") < wick) & (F.col("body_width") < body))


def body_zscore(bars: DataFrame, n: int = 60, look_back: int = 70) -> DataFrame:
    """Width of the closes' body against its last values, this one included, in population deviations."""
    df = bars.withColumn("body_width", ratio(quantile("close", 0.95, n) - quantile("close", 0.1, n), quantile("close", 0.1, n)))
    return df.withColumn("body_z", ratio(F.col("body_width") - mean("body_width", look_back, least=20), spread("body_width", look_back, least=20)))


def float_turnover(bars: DataFrame, shares: DataFrame, least: float = 0.5, n: int = 20) -> DataFrame:
    """Volume of n rows to the ticker's shares, and whether it is enough; tickers without shares pass."""
    df = bars.withColumn("volume_n", total("volume", n)).join(shares, "ticker", "left").withColumn("turnover", ratio("volume_n", "shares"))
    return df.withColumn("passes", F.coalesce(F.col("turnover") >= least, F.lit(True)))


def emitted(candidates: DataFrame, bars: DataFrame, n: int = 20, ahead: int = 100) -> DataFrame:
    """Candidate rows (ticker, rn, upper, lower) as patterns: start, entry, stop and risk; only where more than ``ahead``
    rows follow."""
    b = bars.select("ticker", "rn", F.lag("date", n - 1).over(by_date()).alias("start_date"), F.col("date").alias("end_date"), F.lead("rn", ahead + 1).over(by_date()).isNotNull().alias("followed"))
    j = candidates.select("ticker", "rn", "upper", "lower").join(b, ["ticker", "rn"]).where("followed AND start_date IS NOT NULL")
    return j.select(F.concat_ws("-", "ticker", "rn").alias("pattern_id"), "ticker", "start_date", "end_date", "upper", "lower", (F.col("upper") + 0.01).alias("entry"), (F.col("lower") * 0.98).alias("stop"), (F.col("upper") + 0.01 - F.col("lower") * 0.98).alias("risk"))


def widest_tier(bars: DataFrame, bounds: tuple[float, ...] = (1e4, 3e4, 6e4, 1e5), n: int = 20, first: int = 10) -> DataFrame:
    """The highest money tier (0 is the lowest) over the first rows of the window of n rows that ends here."""
    money = F.col("close") * F.col("volume")
    tier = F.when(money < bounds[0], 0)
    for i, bound in enumerate(bounds[1:], 1):
        tier = tier.when(money < bound, i)
    df = bars.withColumn("tier", tier.otherwise(len(bounds)))
    return df.withColumn("widest_tier", F.when(F.col("rn") >= n, F.max("tier").over(rows(1 - n, first - n))))


def boundary_state(patterns: DataFrame, bars: DataFrame, n: int = 20) -> DataFrame:
    """Rows after a pattern against its fixed bounds: breakout, breakdown or inside, and the position in the box."""
    j = after(patterns, bars, n)
    state = F.when(F.col("b_close") > F.col("upper"), "breakout").when(F.col("b_close") < F.col("lower"), "breakdown").otherwise("inside")
    return j.select("pattern_id", "day", state.alias("state"), ratio(F.col("b_close") - F.col("lower"), F.col("upper") - F.col("lower")).alias("position"), ratio(F.col("upper") - F.col("b_close"), "b_close").alias("to_upper"), ratio(F.col("b_close") - F.col("lower"), "b_close").alias("to_lower"))


def bonds(patterns: DataFrame, bars: DataFrame, milestones: tuple[int, ...] = (50, 150, 300), tolerance: float = 0.005, floor_rows: int = 40, ceiling_rows: int = 50, closes: int = 2, lows: int = 5) -> DataFrame:
    """State of a pattern over the rows after it: broken if a close leaves its bounds by more than ``tolerance`` before
    the first milestone; at each milestone reached the floor rises to the lowest low of the rows before it and the
    ceiling falls to the highest high; then a breakout, or a breakdown that several closes or lows confirm."""
    longest = milestones[-1] + 1
    j = after(patterns, bars, longest)
    days = j.groupBy("pattern_id").agg(F.count("*").alias("days"))
    reached = F.lit(0)
    for m in milestones:
        reached = F.when(F.col("days") >= m, m).otherwise(reached)
    j = j.join(days.withColumn("milestone", reached), "pattern_id")
    within = lambda k: (F.col("day") <= F.col("milestone")) & (F.col("day") > F.col("milestone") - k)
    leaves = (F.col("b_close") > F.col("upper") * (1 + tolerance)) | (F.col("b_close") < F.col("lower") * (1 - tolerance))
    bounds = j.groupBy("pattern_id", "upper", "lower", "days", "milestone").agg(
        F.min(F.when(leaves & (F.col("day") <= milestones[0]), F.col("day"))).alias("break_day"), F.min(F.when(within(floor_rows), F.col("b_low"))).alias("low_n"), F.max(F.when(within(ceiling_rows), F.col("b_high"))).alias("high_n"), F.max_by("b_close", "day").alias("last_close")
    )
    held = (F.col("milestone") > 0) & F.col("break_day").isNull()
    bounds = bounds.withColumns({"floor": F.when(held, F.greatest("lower", "low_n")).otherwise(F.col("lower")), "ceiling": F.when(held, F.least("upper", "high_n")).otherwise(F.col("upper"))})
    last = j.select("pattern_id", "day", "b_close", "b_low", "days").join(bounds.select("pattern_id", "floor"), "pattern_id").groupBy("pattern_id").agg(
        F.count_if((F.col("day") > F.col("days") - closes) & (F.col("b_close") < F.col("floor"))).alias("closes_below"), F.count_if((F.col("day") > F.col("days") - 10) & (F.col("b_low") < F.col("floor"))).alias("lows_below")
    )
    out = bounds.join(last, "pattern_id")
    late = held & (F.col("days") > milestones[0])
    status = F.when(F.col("break_day").isNotNull(), "BROKEN").when(late & (F.col("last_close") > F.col("ceiling") * (1 + tolerance)), "BREAKOUT").when(late & ((F.col("closes_below") >= closes) | (F.col("lows_below") >= lows)), "BREAKDOWN").otherwise("ACTIVE")
    return out.select("pattern_id", "days", "milestone", "break_day", "floor", "ceiling", "closes_below", "lows_below", status.alias("status"))


def latest_checks(df: DataFrame, bbw: float = 0.3, adx_: float = 32.0, volume: float = 0.35, span: float = 0.65, least: int = 3) -> DataFrame:
    """Of each ticker's last row: how many of the four criteria hold, whether that is enough, and their share."""
    last = Window.partitionBy("ticker").orderBy(F.desc("date"))
    checks = sum((F.coalesce(c, F.lit(False)).cast("int") for c in (F.col("adx") < adx_, F.col("volume_ratio") < volume, F.col("range_ratio") < span)), F.coalesce(F.col("bbw_rank") < bbw, F.lit(False)).cast("int"))
    return df.withColumn("__last", F.row_number().over(last)).where("__last = 1").select("ticker", "date", checks.alias("checks"), (checks >= least).alias("consolidates"), (checks / 4).alias("strength"))


def kept_patterns(patterns: DataFrame, least_quality: float, least_days: int) -> DataFrame:
    """Patterns of enough quality (1 less the box width over the widest) that last long enough."""
    days = F.datediff("end_date", "start_date")
    return patterns.withColumns({"quality": 1 / (1 + F.col("box_width")), "days": days}).where((F.col("quality") >= least_quality) & (F.col("days") >= least_days))
