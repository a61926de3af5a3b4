"""More outcomes of patterns: other stops, dynamic barriers, graceful breaches, breakouts and relabelling. All results
are fwd_ or label columns, never features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.rolling import deviation, lag, mean, ratio, rows
from tapewright.operators.labels import after, by_pattern, first_day, gain_class

NEVER = 1 << 30


def _race(target: str, stop: str) -> Column:
    """2 if the target comes first, 0 if the stop does or both on one day, else 1."""
    return F.when(F.col(target) < F.coalesce(stop, F.lit(NEVER)), 2).when(F.col(stop).isNotNull(), 0).otherwise(1)


#: What a class by gain (5: broken) is worth.
CLASS_VALUES = {0: -2.0, 1: -0.2, 2: 1.0, 3: 3.0, 4: 10.0, 5: -10.0}
#: What danger, noise and target are worth in a bear (0), bull (1) and sideways (2) market.
PHASE_VALUES = {0: (-2.0, -0.2, 3.0), 1: (-2.0, -0.1, 5.0), 2: (-2.0, -0.15, 4.0)}


def class_value(label: Column) -> Column:
    out = F.when(F.lit(False), 0.0)
    for k, v in CLASS_VALUES.items():
        out = out.when(label == k, v)
    return out


def phase_value(label: Column, phase: Column) -> Column:
    """Worth of danger (0), noise (1) and target (2) in a phase; a phase that isn't known counts as a bull's."""
    out = F.when(F.lit(False), 0.0)
    for p, values in PHASE_VALUES.items():
        for k, v in enumerate(values):
            out = out.when((label == k) & (F.coalesce(phase, F.lit(1)) == p), v)
    return out


def _wilder(value: str, n: int, reach: int) -> Column:
    """Wilder's mean of the last ``reach`` rows alone, of which the first weighs 1; null without any."""
    seen = F.collect_list(value).over(rows(1 - reach, 0))
    return F.aggregate(F.slice(seen, 2, reach), F.get(seen, F.lit(0)), lambda m, x: m + (x - m) / n)


def atr_path(patterns: DataFrame, bars: DataFrame, n: int = 40, stop: float = 2.0, target: float = 5.0, atr: int = 14) -> DataFrame:
    """Stop so many average true ranges below the lower bound, target above the close: Wilder's mean of the 2 * ``atr``
    rows up to the pattern's last. Patterns without a positive one have no row."""
    a = bars.select(F.col("ticker").alias("a_ticker"), F.col("rn").alias("a_rn"), _wilder("tr", atr, 2 * atr).alias("atr"))
    p = patterns.join(a, (F.col("ticker") == F.col("a_ticker")) & (F.col("end_rn") == F.col("a_rn"))).drop("a_ticker", "a_rn").where("atr > 0")
    j = after(p.withColumns({"stop": F.col("lower") - stop * F.col("atr"), "target": F.col("close") + target * F.col("atr")}), bars, n)
    out = by_pattern(j, first_day(F.col("b_low") <= F.col("stop")).alias("stop_day"), first_day((F.col("b_close") >= F.col("target")) & (F.col("b_next_open") >= F.col("target"))).alias("target_day"))
    return out.withColumn("label", _race("target_day", "stop_day"))


def profiled_path(patterns: DataFrame, bars: DataFrame, profiles: DataFrame, n: int = 40) -> DataFrame:
    """Stop below the lower bound by the tier's buffer, target so many of the tier's risks above the close.

    ``profiles`` has tier, buffer and times, a few rows; patterns have a tier.
    """
    p = patterns.join(profiles, "tier").withColumns({"stop": F.col("lower") * (1 - F.col("buffer")), "target": F.col("close") + F.col("times") * F.col("lower") * F.col("buffer")})
    j = after(p, bars, n)
    out = by_pattern(j, first_day(F.col("b_low") <= F.col("stop")).alias("stop_day"), first_day((F.col("b_close") >= F.col("target")) & (F.col("b_next_open") >= F.col("target"))).alias("target_day"))
    return out.withColumn("label", _race("target_day", "stop_day"))


def volume_confirmed(patterns: DataFrame, bars: DataFrame, n: int = 60, run: int = 3, times: float = 2.0, money: float = 50_000.0, usual: int = 20) -> DataFrame:
    """Whether ``run`` rows in a row after the end have enough money and more volume than ``times`` the mean of the
    pattern's last row and the ``usual`` ones before it, which stays fixed; and the day that first completes them."""
    m = bars.select(F.col("ticker").alias("m_ticker"), F.col("rn").alias("m_rn"), mean("volume", usual + 1, least=1).alias("usual_volume"))
    p = patterns.join(m, (F.col("ticker") == F.col("m_ticker")) & (F.col("end_rn") == F.col("m_rn"))).drop("m_ticker", "m_rn")
    loud = (F.col("b_volume") > times * F.col("usual_volume")) & (F.col("b_close") * F.col("b_volume") >= money)
    last = Window.partitionBy("pattern_id").orderBy("day").rowsBetween(1 - run, 0)
    j = after(p, bars, n).withColumn("__loud", F.sum(F.coalesce(loud, F.lit(False)).cast("int")).over(last))
    return by_pattern(j, first_day(F.col("__loud") >= run).alias("confirmed_day")).withColumn("confirmed", F.col("confirmed_day").isNotNull())


def dynamic_barriers(patterns: DataFrame, volatility: Column, up: float = 0.3, down: float = 0.15, floor: float = 0.01) -> DataFrame:
    """Barriers by money tier and volatility: wider for small and for unsteady tickers, never below ``floor``."""
    tier = F.when(F.col("money") < 30_000, 1.5).when(F.col("money") < 60_000, 1.0).otherwise(0.7)
    steady = F.when(volatility > 2, 1.4).when(volatility < 0.5, 0.8).otherwise(1.0)
    return patterns.withColumns({"up_barrier": F.round(F.greatest(up * tier * steady, F.lit(floor)), 4), "down_barrier": F.round(F.greatest(down * tier * steady, F.lit(floor)), 4)})


def historic_features(patterns: DataFrame, bars: DataFrame) -> DataFrame:
    """Volatility, means, return and volume ratio of the rows strictly before a pattern's last one."""
    h = bars.select(F.col("ticker").alias("h_ticker"), F.col("rn").alias("h_rn"), deviation("ret", 20, back=1).alias("hist_vol_20"), mean("close", 50, back=1).alias("hist_sma_50"), (ratio(lag("close", 1), lag("close", 21)) - 1).alias("hist_ret_20"), ratio(lag("volume"), mean("volume", 20, back=1)).alias("hist_volume_ratio"))
    return patterns.join(h, (F.col("ticker") == F.col("h_ticker")) & (F.col("end_rn") == F.col("h_rn"))).select("pattern_id", "hist_vol_20", "hist_sma_50", "hist_ret_20", "hist_volume_ratio")


def respected(patterns: DataFrame, bars: DataFrame, first: int = 15, n: int = 100, above: float = 0.001, below: float = 0.1) -> DataFrame:
    """Patterns whose first rows afterwards keep near the bounds; bounds refined from rows 5 to ``first``, and the gain
    and class over the next n rows against the refined upper bound. Longest run of closes below it makes it anxious."""
    j = after(patterns, bars, first + n)
    early, mid, late = F.col("day") <= first, F.col("day").between(5, first), F.col("day") > first
    leaves = (F.col("b_high") > F.col("upper") * (1 + above)) | (F.col("b_low") < F.col("lower") * (1 - below))
    kept = j.groupBy("pattern_id", "upper", "lower").agg(F.count_if(early & leaves).alias("left"), F.max(F.when(mid, F.col("b_high"))).alias("high_m"), F.min(F.when(mid, F.col("b_low"))).alias("low_m"))
    kept = kept.where("left = 0").select("pattern_id", F.least("upper", F.coalesce("high_m", "upper")).alias("refined_upper"), F.greatest("lower", F.coalesce("low_m", "lower")).alias("refined_lower"))
    w = Window.partitionBy("pattern_id").orderBy("day")
    rest = j.select("pattern_id", "day", "b_high", "b_low", "b_close").join(kept, "pattern_id").where(late)
    rest = rest.withColumn("__low", (F.col("b_close") < F.col("refined_lower")).cast("int"))
    rest = rest.withColumn("__g", F.sum(1 - F.col("__low")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = rest.withColumn("__run", F.sum("__low").over(Window.partitionBy("pattern_id", "__g")))
    gain = F.max(F.col("b_high") / F.col("refined_upper") - 1)
    out = run.groupBy("pattern_id", "refined_upper", "refined_lower").agg(gain.alias("fwd_gain"), F.max("__run").alias("rows_below"), first_day(F.col("b_low") < F.col("refined_lower") * (1 - below)).alias("broken_day"))
    return out.withColumns({"anxious": F.col("rows_below") >= 7, "label": gain_class(F.col("fwd_gain"))})


def graceful_breach(patterns: DataFrame, bars: DataFrame, n: int = 100, drop: float = 0.1, run: int = 7, k4: float = 0.75, k3: float = 0.35) -> DataFrame:
    """The first day on which a deep fall under the lower bound (5) or a rise above the upper one (4, 3; in this order on
    one day) decides; without one, the class by the largest gain. Up to that day: the first close below the lower bound,
    the longest run of such closes, and whether ``run`` of them came without a deep fall (anxious)."""
    j = after(patterns, bars, n, first=0)
    rise, deep = F.col("b_high") / F.col("upper") - 1, F.col("b_low") <= F.col("lower") * (1 - drop)
    days = by_pattern(j, first_day(deep).alias("k5"), first_day(rise >= k4).alias("k4"), first_day(rise >= k3).alias("k3"))
    upto = j.join(days.withColumn("breach_day", F.least("k5", "k4", "k3")), "pattern_id").where(F.col("breach_day").isNull() | (F.col("day") <= F.col("breach_day")))
    upto = upto.withColumns({"__low": (F.col("b_close") < F.col("lower")).cast("int"), "__shallow": (~deep).cast("int")})
    w = Window.partitionBy("pattern_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    own = Window.partitionBy("pattern_id", "__g")
    runs = upto.withColumn("__g", F.sum(1 - F.col("__low")).over(w)).withColumns({"__run": F.sum("__low").over(own), "__quiet": F.sum(F.col("__low") * F.col("__shallow")).over(own)})
    first = F.col("breach_day").isNotNull()
    out = runs.groupBy("pattern_id", "k5", "k4", "k3", "breach_day").agg(first_day(F.col("__low") == 1).alias("first_below"), F.max("__run").alias("longest_below"), F.max("__quiet").alias("__quiet"), F.max(rise).alias("fwd_gain"))
    label = F.when(first & (F.col("k5") == F.col("breach_day")), 5).when(first & (F.col("k4") == F.col("breach_day")), 4).when(first, 3).otherwise(gain_class(F.col("fwd_gain")))
    return out.withColumns({"anxious": F.col("__quiet") >= run, "label": label}).drop("k5", "k4", "k3", "__quiet")


def best_of_group(labelled: DataFrame, key: str, order: str, label: str = "label") -> DataFrame:
    """All rows of a key get its best class (4 first, 5 last), unless the first in order is 5: then that."""
    w = Window.partitionBy(key)
    rank = F.when(F.col(label) == 5, -1).otherwise(F.col(label))
    first = F.first(label).over(w.orderBy(order))
    best = F.max(rank).over(w)
    return labelled.withColumn("group_label", F.when(first == 5, 5).otherwise(F.when(best == -1, 5).otherwise(best)))


def evolution(labelled: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Keys with how many rows, how many different classes, and whether the class changes."""
    return labelled.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(label).alias("classes")).withColumn("changes", F.col("classes") > 1)


def mismatches(labelled: DataFrame, own: str, group: str) -> DataFrame:
    """How often a row's own class is that of its group, by class."""
    return labelled.groupBy(own).agg(F.count("*").alias("n"), F.count_if(F.col(own) != F.col(group)).alias("mismatched"))


def coil_trades(patterns: DataFrame, bars: DataFrame, n: int = 60, buffer: float = 0.02, surge: float = 2.0, target: float = 0.5, days: int = 40) -> DataFrame:
    """Filled on the first day whose low comes near the lower bound; then the first of a target with surging volume, a
    close below the bound, the target alone, or the time."""
    j = after(patterns, bars, n)
    fills = by_pattern(j, first_day(F.col("b_low") <= F.col("lower") * (1 + buffer)).alias("fill_day"))
    k = j.join(fills.where("fill_day IS NOT NULL"), "pattern_id").where("day > fill_day AND day <= fill_day + " + str(days))
    goal = F.col("lower") * (1 + buffer) * (1 + target)
    hit, loud = F.col("b_high") >= goal, F.col("b_volume") >= surge * F.col("mean_volume")
    out = k.groupBy("pattern_id").agg(first_day(hit & loud).alias("surge_day"), first_day(F.col("b_close") < F.col("lower")).alias("stop_day"), first_day(hit).alias("target_day"), F.max("day").alias("last_day"))
    out = fills.join(out, "pattern_id", "left")
    days_ = [F.coalesce(c, F.lit(NEVER)) for c in ("surge_day", "stop_day", "target_day")]
    first = F.least(*days_)
    reason = F.when(F.col("fill_day").isNull(), "unfilled").when(F.col("last_day").isNull() | (first == NEVER), "time").when(days_[1] == first, "stop").when(days_[0] == first, "surge").otherwise("target")
    return out.select("pattern_id", "fill_day", F.when(first < NEVER, first).alias("exit_day"), reason.alias("reason"))


def breakouts(patterns: DataFrame, bars: DataFrame, n: int = 60, run: int = 3) -> DataFrame:
    """First close outside the box: direction and day; whether ``run`` closes of the first ten hold outside, the first
    return inside within 20 rows (a fake-out), and how many rows of 5 to 49 touch the bound again."""
    j = after(patterns, bars, n)
    out = F.when(F.col("b_close") > F.col("upper"), 1).when(F.col("b_close") < F.col("lower"), -1).otherwise(0)
    j = j.withColumn("side", out)
    first = j.where("side <> 0").groupBy("pattern_id").agg(F.min_by("side", "day").alias("direction"), F.min("day").alias("break_day"))
    k = j.join(first, "pattern_id").withColumn("since", F.col("day") - F.col("break_day"))
    back = F.when(F.col("direction") == 1, F.col("b_close") < F.col("upper")).otherwise(F.col("b_close") > F.col("lower"))
    touch = F.when(F.col("direction") == 1, F.col("b_low") <= F.col("upper") * 1.02).otherwise(F.col("b_high") >= F.col("lower") * 0.98)
    w = Window.partitionBy("pattern_id").orderBy("day").rowsBetween(1 - run, 0)
    held = F.sum(F.when((F.col("since") >= 0) & ~back, 1).otherwise(0)).over(w)
    k = k.withColumn("__held", held)
    edge = F.when(F.col("direction") == 1, F.col("upper")).otherwise(F.col("lower"))
    got = k.groupBy("pattern_id", "direction", "break_day").agg(
        F.max(F.when(F.col("since").between(0, 9), F.col("__held"))).alias("most_held"), F.min(F.when(F.col("since").between(1, 20) & back, F.col("since"))).alias("fake_out_after"), F.count_if(F.col("since").between(5, 49) & touch).alias("retests"),
        F.max(F.when(F.col("since") == 0, F.abs(F.col("b_close") / edge - 1))).alias("strength"), F.avg(F.when(F.col("since").between(1, 20), (~back).cast("double"))).alias("sustained"),
    )
    return got.withColumns({"confirmed": F.col("most_held") >= run, "fake_out": F.col("fake_out_after").isNotNull()}).drop("most_held")


def breakout_summary(broken: DataFrame) -> DataFrame:
    """By direction: how many, how often fake, confirmed and strong, and mean strength."""
    return broken.groupBy("direction").agg(F.count("*").alias("n"), F.avg(F.col("fake_out").cast("double")).alias("fake_rate"), F.avg(F.col("confirmed").cast("double")).alias("confirmed_rate"), F.avg((F.col("strength") > 0.5).cast("double")).alias("strong_rate"), F.avg("strength").alias("mean_strength"))


def re_entries(patterns: DataFrame, bars: DataFrame, n: int = 60) -> DataFrame:
    """Returns into the box: how many, and how many rows each stay outside had lasted in the mean."""
    w = Window.partitionBy("pattern_id").orderBy("day")
    j = after(patterns, bars, n).withColumn("inside", F.col("b_close").between(F.col("lower"), F.col("upper")))
    j = j.withColumns({"__was": F.lag("inside").over(w), "__exit": F.last(F.when(F.col("inside"), F.col("day")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))})
    enters = F.col("inside") & ~F.col("__was")
    return j.groupBy("pattern_id").agg(F.count_if(enters).alias("re_entries"), F.avg(F.when(enters & F.col("__exit").isNotNull(), F.col("day") - F.col("__exit") - 1)).alias("rows_outside"))


def risk_metrics(patterns: DataFrame, bars: DataFrame, n: int = 60, buffer: float = 0.02) -> DataFrame:
    """Best and worst close in multiples of the risk from the close to the stop below the lower bound, and what was
    achieved: -1 if the stop was passed, else the best. All are 0 where there is no risk."""
    p = patterns.withColumn("risk", F.col("close") - F.col("lower") * (1 - buffer))
    r = lambda x: F.when(F.col("risk") <= 0, 0.0).otherwise((x - F.col("close")) / F.col("risk"))
    out = by_pattern(after(p, bars, n), F.max(F.greatest("risk", F.lit(0.0))).alias("risk"), F.max(r(F.col("b_close"))).alias("fwd_max_r"), F.min(r(F.col("b_close"))).alias("fwd_min_r"), F.count("*").alias("rows"))
    return out.withColumn("achieved_r", F.when(F.col("fwd_min_r") < -1, -1.0).otherwise(F.col("fwd_max_r")))


def merged_class(label: Column) -> Column:
    """Four classes of six: 3 big winner (3, 4), 2 winner (2), 1 none (0, 1), 0 failed (5)."""
    return F.when(label.isin(3, 4), 3).when(label == 2, 2).when(label.isin(0, 1), 1).when(label == 5, 0)


def signed_class(gain: Column) -> Column:
    """Class by the signed gain: a loss of more than a twentieth is 5."""
    return F.when(gain < -0.05, 5).when(gain < 0.05, 0).when(gain < 0.15, 1).when(gain < 0.35, 2).when(gain < 0.75, 3).when(gain.isNotNull(), 4)


def ripeness(patterns: DataFrame, reference: str, last: DataFrame) -> DataFrame:
    """Whether a pattern's own window (as :func:`labels.adaptive_window`, in calendar days) is over at a date, and whether
    it is a zombie: more than 150 days old, with no row after its end. ``last`` has ticker and last_date."""
    from tapewright.operators.labels import adaptive_window

    age = F.datediff(F.lit(reference).cast("date"), "end_date")
    df = patterns.join(last, "ticker").withColumns({"window": adaptive_window(F.col("box_width") / 100), "age": age})
    return df.select("pattern_id", "window", "age", (F.col("age") >= F.col("window")).alias("ripe"), ((F.col("age") > 150) & (F.col("last_date") <= F.col("end_date"))).alias("zombie"))
