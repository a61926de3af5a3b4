"""Outcomes of patterns by what the price did afterwards. All results are fwd_ or label columns, never features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.rolling import ratio


def after(patterns: DataFrame, bars: DataFrame, n: int, first: int = 1) -> DataFrame:
    """Patterns with the bars of the rows from ``first`` to n after their end: day, and b_ columns.

    A join on the ticker and a range of row numbers: bars that were cut in blocks of rows, and patterns that ask for
    the blocks that they reach, so that both sides are joined by equality and no ticker is one task's alone.
    """
    size = max(n, 1)
    block = F.floor((F.col("rn") - 1) / size)
    b = bars.select(F.col("ticker").alias("b_ticker"), block.alias("b_block"), *[F.col(c).alias(f"b_{c}") for c in ("rn", "date", "open", "high", "low", "close", "volume")], F.lead("open").over(_order()).alias("b_next_open"))
    reach = F.sequence(F.floor((F.col("end_rn") + first - 1) / size), F.floor((F.col("end_rn") + n - 1) / size))
    asked = patterns.withColumn("__block", F.explode(reach))
    on = (F.col("ticker") == F.col("b_ticker")) & (F.col("__block") == F.col("b_block")) & F.col("b_rn").between(F.col("end_rn") + first, F.col("end_rn") + n)
    return asked.join(b, on).withColumn("day", F.col("b_rn") - F.col("end_rn")).drop("__block", "b_block", "b_ticker")


def _order():
    from tapewright.functions.rolling import by_date

    return by_date()


def first_day(condition: Column) -> Column:
    """The first day on which a condition holds."""
    return F.min(F.when(condition, F.col("day")))


def gain_class(gain: Column, broken: Column | None = None, bounds=(0.05, 0.15, 0.35, 0.75)) -> Column:
    """0 to 4 by gain, 5 if broken."""
    out = F.when(broken, 5) if broken is not None else F.when(F.lit(False), 0)
    for k, bound in enumerate(bounds):
        out = out.when(gain < bound, k)
    return F.when(gain.isNotNull(), out.otherwise(len(bounds)))


def by_pattern(joined: DataFrame, *aggregates: Column) -> DataFrame:
    return joined.groupBy("pattern_id").agg(*aggregates)


def unified(patterns: DataFrame, bars: DataFrame, n: int = 30) -> DataFrame:
    """Largest gain and final gain against the upper bound, largest loss against the lower; the first close above it all:
    calendar days to it, and its volume to the pattern's mean."""
    j = after(patterns, bars, n)
    above = F.col("b_close") > F.col("upper") * 1.05
    gain, loss, end = F.max(F.col("b_high") / F.col("upper") - 1), F.min(F.col("b_low") / F.col("lower") - 1), F.max_by(F.col("b_close") / F.col("upper") - 1, "day")
    volume = F.min_by(F.when(above, ratio("b_volume", "mean_volume")), F.when(above, F.col("day")))
    out = by_pattern(j, gain.alias("fwd_gain"), loss.alias("fwd_loss"), end.alias("fwd_end"), F.min(F.when(above, F.datediff("b_date", "end_date"))).alias("breakout_day"), volume.alias("breakout_volume"))
    return out.withColumn("label", gain_class(F.col("fwd_gain"), F.col("fwd_loss") < -0.5))


def path(patterns: DataFrame, bars: DataFrame, n: int = 40, buffer: float = 0.02, times: float = 3.0) -> DataFrame:
    """Stop below the lower bound, target so many risks above the close; the stop wins a day, and the target needs the
    next open too. 0 stopped, 2 target, 1 neither."""
    risked = patterns.withColumns({"stop": F.col("lower") * (1 - buffer), "target": F.col("close") + times * (F.col("lower") * buffer)})
    j = after(risked, bars, n)
    out = by_pattern(j, first_day(F.col("b_low") <= F.col("stop")).alias("stop_day"), first_day((F.col("b_close") >= F.col("target")) & (F.col("b_next_open") >= F.col("target"))).alias("target_day"))
    label = F.when(F.col("target_day") < F.coalesce("stop_day", F.lit(1 << 30)), 2).when(F.col("stop_day").isNotNull(), 0).otherwise(1)
    return out.withColumn("label", label)


def structural(patterns: DataFrame, bars: DataFrame, n: int = 60, tick: float = 0.01, times: float = 3.0, share_of_box: float = 1.0) -> DataFrame:
    """Entry at the trigger or the next open above it; risk from the trigger to the lower bound, or a share of the box (.75
    with 2 risks for weekly patterns); the floor wins ties."""
    j = after(patterns.withColumn("trigger", F.col("upper") + tick), bars, n)
    j = j.withColumn("next_open", F.min_by("b_open", "day").over(Window.partitionBy("pattern_id")))
    risk = F.col("trigger") - F.col("lower") if share_of_box == 1 else (F.col("upper") - F.col("lower")) * share_of_box
    j = j.withColumns({"entry": F.greatest("trigger", "next_open"), "risk": risk})
    out = j.groupBy("pattern_id", "entry", "risk", "trigger").agg(
        first_day(F.col("b_low") < F.col("lower")).alias("stop_day"), first_day(F.col("b_high") >= F.col("entry") + times * F.col("risk")).alias("target_day"), F.max((F.col("b_high") - F.col("entry")) / F.nullif(F.col("risk"), F.lit(0.0))).alias("fwd_best_r")
    )
    label = F.when(F.col("target_day") < F.coalesce("stop_day", F.lit(1 << 30)), 2).when(F.col("stop_day").isNotNull(), 0).otherwise(1)
    return out.withColumns({"label": label, "untradeable": F.col("entry") > F.col("trigger") + 0.5 * F.col("risk"), "gap_r": ratio(F.col("entry") - F.col("trigger"), "risk")})


def triple_barrier(patterns: DataFrame, bars: DataFrame, days: int = 150, up: float = 1.0, down: float = 0.5) -> DataFrame:
    """Barriers at shares of the close over calendar days; the lower wins ties, none hit is 1."""
    b = bars.select(F.col("ticker").alias("b_ticker"), F.floor(F.unix_date("date") / days).alias("b_block"), F.col("date").alias("b_date"), F.col("high").alias("b_high"), F.col("low").alias("b_low"), F.col("close").alias("b_close"))
    at = F.unix_date("end_date")
    asked = patterns.withColumn("__block", F.explode(F.sequence(F.floor((at + 1) / days), F.floor((at + days) / days))))
    gone = F.datediff("b_date", "end_date")
    j = asked.join(b, (F.col("ticker") == F.col("b_ticker")) & (F.col("__block") == F.col("b_block")) & gone.between(1, days)).withColumn("day", gone)
    out = by_pattern(j, first_day(F.col("b_high") >= F.col("close") * (1 + up)).alias("up_day"), first_day(F.col("b_low") <= F.col("close") * (1 - down)).alias("down_day"), F.max(F.col("b_high") / F.col("close") - 1).alias("fwd_max"), F.min(F.col("b_low") / F.col("close") - 1).alias("fwd_min"), F.max_by(F.col("b_close") / F.col("close") - 1, "b_date").alias("fwd_final"))
    label = F.when(F.col("up_day") < F.coalesce("down_day", F.lit(1 << 30)), 2).when(F.col("down_day").isNotNull(), 0).otherwise(1)
    return out.withColumns({"label": label, "hit_day": F.least("up_day", "down_day")})


def first_breach(patterns: DataFrame, bars: DataFrame, n: int = 100, drop: float = 0.1, k4: float = 0.75, k3: float = 0.35) -> DataFrame:
    """The pattern's last row and the next n: 5 if it first falls by ``drop`` under the lower bound, 4 or 3 if it first
    rises so far above the upper, in this order on one day; else by the largest gain."""
    j = after(patterns, bars, n, first=0)
    rise = F.col("b_high") / F.col("upper") - 1
    out = by_pattern(j, first_day(F.col("b_low") <= F.col("lower") * (1 - drop)).alias("k5_day"), first_day(rise >= k4).alias("k4_day"), first_day(rise >= k3).alias("k3_day"), F.max(rise).alias("fwd_gain"))
    never = F.lit(1 << 30)
    five, four, three = (F.coalesce(c, never) for c in ("k5_day", "k4_day", "k3_day"))
    label = F.when((five <= four) & (five <= three) & (five < never), 5).when((four <= three) & (four < never), 4).when(three < never, 3).otherwise(gain_class(F.col("fwd_gain")))
    return out.withColumn("label", label)


def race(patterns: DataFrame, bars: DataFrame, n: int = 100, drop: float = 0.1) -> DataFrame:
    """The best class before the fall, or 5 if there is none; one of 3 or more may still rise after the fall."""
    j = after(patterns, bars, n, first=0)
    fall = F.when(F.col("b_low") <= F.col("lower") * (1 - drop), F.col("day"))
    j = j.withColumn("k5_day", F.min(fall).over(Window.partitionBy("pattern_id")))
    rise = F.col("b_high") / F.col("upper") - 1
    before = F.when(F.col("k5_day").isNull() | (F.col("day") < F.col("k5_day")), rise)
    out = j.groupBy("pattern_id", "k5_day").agg(F.max(before).alias("fwd_gain"), F.max(rise).alias("__all"))
    out = out.withColumn("class", gain_class(F.col("fwd_gain")))
    upgraded = F.when(F.col("class") >= 3, gain_class(F.col("__all"))).otherwise(F.col("class"))
    return out.withColumn("label", F.when(F.col("k5_day").isNotNull() & (F.coalesce("class", F.lit(0)) < 1), 5).otherwise(upgraded)).drop("__all")


def crash_aware(patterns: DataFrame, bars: DataFrame, n: int = 60, crash: float = 0.3) -> DataFrame:
    """4 if it doubles before a crash, else by the largest gain up to the crash."""
    j = after(patterns, bars, n)
    falls = by_pattern(j, first_day(F.col("b_low") <= F.col("close") * (1 - crash)).alias("crash_day"))
    upto = j.join(falls, "pattern_id").where(F.col("crash_day").isNull() | (F.col("day") <= F.col("crash_day")))
    out = upto.groupBy("pattern_id", "crash_day").agg(F.max(F.col("b_high") / F.col("close") - 1).alias("fwd_gain"), first_day(F.col("b_high") >= F.col("close") * 2).alias("double_day"))
    doubled = F.col("double_day").isNotNull() & (F.col("crash_day").isNull() | (F.col("double_day") < F.col("crash_day")))
    return out.withColumn("label", F.when(doubled, 4).otherwise(gain_class(F.col("fwd_gain"))))


def horizons(patterns: DataFrame, bars: DataFrame, days=(5, 20, 60)) -> DataFrame:
    """Largest gain and loss, and close, at several horizons in rows."""
    j = after(patterns, bars, max(days))
    at = lambda n, x: F.when(F.col("day") <= n, x)
    out = []
    for n in days:
        out += [F.max(at(n, F.col("b_high") / F.col("close") - 1)).alias(f"fwd_max_{n}"), F.min(at(n, F.col("b_low") / F.col("close") - 1)).alias(f"fwd_min_{n}"), F.max(F.when(F.col("day") == n, F.col("b_close"))).alias(f"fwd_close_{n}")]
    return by_pattern(j, *out)


def adaptive_window(width: Column, least: int = 10, most: int = 60) -> Column:
    """Rows that a pattern of such a width is watched for."""
    return F.least(F.greatest(F.floor(1 / (width + 1e-6)).cast("long"), F.lit(least)), F.lit(most))
