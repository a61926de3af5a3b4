"""Regimes of the market: transitions, scores, and what patterns' outcomes say with the lag at which they are known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.positions import running
from tapewright.functions.rolling import by_date, clip, deviation, lag, mean, ratio


def transitions(phases: DataFrame) -> DataFrame:
    """Phases with the date that each began, how many days it lasted, and the one before."""
    changed = F.coalesce(F.col("phase") != F.lag("phase").over(by_date()), F.col("phase").isNotNull())
    starts = phases.where("phase IS NOT NULL").withColumn("__new", changed).where("__new")
    nxt = F.lead("date").over(by_date())
    return starts.select("ticker", F.col("date").alias("since"), "phase", F.lag("phase").over(by_date()).alias("before"), F.datediff(nxt, "date").alias("days"))


def phase_statistics(changes: DataFrame) -> DataFrame:
    return changes.groupBy("phase").agg(F.count("*").alias("n"), F.avg("days").alias("mean_days"), F.max("days").alias("longest"))


def plain_cross(bars: DataFrame, fast: int = 20, slow: int = 60) -> DataFrame:
    """Phase by whether the fast mean is above the slow one, and the date that this last changed."""
    df = bars.withColumns({"f": mean("close", fast), "s": mean("close", slow)}).withColumn("phase", F.when(F.col("s").isNotNull(), (F.col("f") > F.col("s")).cast("int")))
    changed = F.coalesce(F.col("phase") != F.lag("phase").over(by_date()), F.lit(False))
    return df.withColumn("crossed", F.last(F.when(changed, F.col("date")), ignorenulls=True).over(by_date().rowsBetween(Window.unboundedPreceding, 0)))


def volatility_level(value: Column) -> Column:
    """A volatility index as a market: (regime, confidence). 15, 20, 25 and 30."""
    known = value.isNotNull()
    regime = F.when(value < 20, "BULL").when(value < 25, "SIDEWAYS").when(known, "BEAR")
    return F.struct(regime.alias("regime"), F.when(value < 15, 0.9).when(value < 20, 0.7).when(value < 25, 0.6).when(value < 30, 0.7).when(known, 0.9).alias("confidence"))


def barrier_regime(value: Column) -> Column:
    """The market that barriers are set for, by a volatility index. 12, 18, 25 and 35."""
    return F.when(value >= 35, "crisis").when(value >= 25, "high_volatility").when(value >= 18, "bearish").when(value >= 12, "neutral").when(value.isNotNull(), "bullish")


def trend_regime(price: Column, fast: Column, slow: Column, value: Column | None = None) -> Column:
    """The same by the order of price and means; a volatility index of 25 or more goes before."""
    out = F.when(value >= 35, "crisis").when(value >= 25, "high_volatility") if value is not None else F.when(F.lit(False), "")
    return out.when((price > fast) & (fast > slow), "bullish").when((price < fast) & (fast < slow), "bearish").when(price > slow, "neutral").when(slow.isNotNull(), "bearish")


def regime_score(bars: DataFrame, fast: int = 50, slow: int = 200, steps: int = 20, calm: float = 15.0, wild: float = 25.0) -> DataFrame:
    """Four weighted factors: price to the slow mean (.30), order of price and means (.25), the slow mean's slope a year
    (.25) and realised volatility (.20), summed to a score from -1 to 1; bull above .3, bear below -.3, else sideways.
    Null until there are ``slow + steps`` rows."""
    df = bars.withColumns({"__f": mean("close", fast), "__s": mean("close", slow), "__v": deviation("ret", steps) * (252**0.5 * 100)})
    df = df.withColumn("__was", lag("__s", steps - 1))
    to, sl = (F.col("close") / F.col("__s") - 1) * 100, (F.col("__s") / F.col("__was") - 1) * 100 * (252 / steps)
    price = F.when(to > 5, 0.3).when(to < -5, -0.3).otherwise(0.0)
    order = F.when((F.col("close") > F.col("__f")) & (F.col("__f") > F.col("__s")), 0.25).when((F.col("close") < F.col("__f")) & (F.col("__f") < F.col("__s")), -0.25).otherwise(0.0)
    rising = F.when(sl > 10, 0.25).when(sl > 0, 0.125).when(sl < -10, -0.25).when(sl < 0, -0.125).otherwise(0.0)
    steady = F.when(F.col("__v") < calm, 0.2).when(F.col("__v") > wild, -0.2).otherwise(0.0)
    score = F.when(F.col("rn") >= slow + steps, F.round(price + order + rising + steady, 6))
    df = df.withColumn("score", score)
    s = F.col("score")
    regime = F.when(s > 0.3, "BULL").when(s < -0.3, "BEAR").when(s.isNotNull(), "SIDEWAYS").otherwise("UNKNOWN")
    sure = F.when(F.abs(s) > 0.3, F.least(F.lit(1.0), (F.abs(s) - 0.3) / 0.7 + 0.5)).when(s.isNotNull(), 1 - F.abs(s) / 0.3).otherwise(0.0)
    return df.withColumns({"regime": regime, "confidence": sure}).drop("__f", "__s", "__v", "__was")


def danger_rate(labelled: DataFrame, key: str, least: int = 10, bull: float = 0.4, bear: float = 0.55, targets: float = 0.12, label: str = "label") -> DataFrame:
    """By key the shares of dangers (0) and targets (2), and the market that they show: a bull with few dangers and
    enough targets, a bear with many dangers, unknown with too few patterns."""
    out = labelled.groupBy(key).agg(F.count("*").alias("n"), F.avg((F.col(label) == 0).cast("double")).alias("danger"), F.avg((F.col(label) == 2).cast("double")).alias("target"))
    d = F.col("danger")
    regime = F.when(F.col("n") < least, "UNKNOWN").when((d < bull) & (F.col("target") > targets), "BULL").when(d > bear, "BEAR").otherwise("SIDEWAYS")
    sure = F.when(regime == "UNKNOWN", 0.0).when(regime == "BULL", F.least(F.lit(1.0), (bull - d) / 0.15 + 0.5)).when(regime == "BEAR", F.least(F.lit(1.0), (d - bear) / 0.15 + 0.5)).otherwise(0.5)
    return out.withColumns({"regime": regime, "confidence": sure})


#: Below .40 dangers and above .12 targets a market is a bull, surely so below .30 and above .15; above .55
#: dangers it is a bear, surely so above .60. At least ten patterns must be known.
LEAST, BULL, TARGETS, BEAR = 10, 0.4, 0.12, 0.55


def live_regime(n: Column, danger: Column, target: Column) -> Column:
    """(regime, confidence) by how many of the last patterns there are and the shares of dangers and targets."""
    bull, bear = (danger < BULL) & (target > TARGETS), danger > BEAR
    regime = F.when(F.coalesce(n, F.lit(0)) < LEAST, "UNKNOWN").when(bull, "BULL").when(bear, "BEAR").otherwise("SIDEWAYS")
    sure = F.when(F.coalesce(n, F.lit(0)) < LEAST, "NONE").when(bull & (danger < 0.3) & (target > 0.15), "HIGH").when(~bull & (danger > 0.6), "HIGH").otherwise("MEDIUM")
    return F.struct(regime.alias("regime"), sure.alias("confidence"))


def _known(labelled: DataFrame, lag_days: int, label: str, key: list[str]) -> DataFrame:
    """Patterns with the first day on which their outcome counts, and running counts of them all, dangers and targets."""
    df = labelled.withColumn("known", F.date_add("end_date", lag_days + 1))
    return running(df, "known", ["pattern_id"], {"dangers": (F.col(label) == 0).cast("int"), "targets": (F.col(label) == 2).cast("int")}, key)


def _rates(known: DataFrame, asked: DataFrame, most: int, key: list[str]) -> DataFrame:
    """``asked`` (key, day, upto: how many outcomes are known) with the shares of the last ``most`` of them."""
    at = known.select(*key, "place", "dangers", "targets")
    last = at.select(*[F.col(k).alias(f"__l{k}") for k in key], F.col("place").alias("__last"), F.col("dangers").alias("__d1"), F.col("targets").alias("__t1"))
    first = at.select(*[F.col(k).alias(f"__f{k}") for k in key], F.col("place").alias("__first"), F.col("dangers").alias("__d0"), F.col("targets").alias("__t0"))
    same = lambda side: [F.col(k) == F.col(f"__{side}{k}") for k in key]
    j = asked.join(last, [F.col("upto") == F.col("__last"), *same("l")], "left").join(first, [F.col("upto") - most == F.col("__first"), *same("f")], "left")
    n = F.least("upto", F.lit(most))
    share = lambda c: ratio((F.coalesce(f"__{c}1", F.lit(0)) - F.coalesce(f"__{c}0", F.lit(0))).cast("double"), n.cast("double"))
    j = j.select(*key, "day", n.alias("n"), share("d").alias("danger"), share("t").alias("target"))
    told = live_regime(F.col("n"), F.col("danger"), F.col("target"))
    return j.withColumns({"regime": told["regime"], "confidence": told["confidence"]})


def lagged_history(labelled: DataFrame, first: str, last: str, step: int = 7, lag_days: int = 60, most: int = 100, label: str = "label") -> DataFrame:
    """Every ``step`` days the market by the last ``most`` patterns whose outcome was known: those that ended more than
    ``lag_days`` before. Labels are 0 danger, 1 noise, 2 target.

    Patterns get running counts by day and part of a day; a day then needs the counts at two places.
    """
    known = _known(labelled, lag_days, label, [])
    days = labelled.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr(f"INTERVAL {step} DAYS"))).alias("day"), F.lit(1).alias("asks"), F.lit(0).cast("long").alias("k"))
    counts = known.groupBy(F.col("known").alias("day")).agg(F.count("*").alias("k")).select("day", F.lit(0).alias("asks"), "k")
    upto = F.sum("k").over(Window.orderBy("day", "asks"))  # a row for each date, and one for each that is asked for
    return _rates(known, counts.unionByName(days).withColumn("upto", upto).where("asks = 1").select("day", "upto"), most, [])


def regime_alerts(labelled: DataFrame, key: str, lag_days: int = 60, most: int = 100, label: str = "label") -> DataFrame:
    """By key the days on which the market, by the last ``most`` outcomes known, is another than on the day before that
    had outcomes: the one before, the new one, and whether trading opens or closes. A first day gives no alert."""
    known = _known(labelled, lag_days, label, [key])
    asked = known.groupBy(key, F.col("known").alias("day")).agg(F.max("place").alias("upto"))
    was = F.lag("regime").over(Window.partitionBy(key).orderBy("day"))  # a row for each day of a key
    out = _rates(known, asked, most, [key]).withColumn("before", was).where(F.col("before") != F.col("regime"))
    window = F.when((F.col("regime") == "BULL") & F.col("before").isin("BEAR", "SIDEWAYS"), "OPEN").when((F.col("before") == "BULL") & F.col("regime").isin("BEAR", "SIDEWAYS"), "CLOSED")
    return out.select(key, "day", "before", "regime", "n", "danger", "target", window.alias("trading"))


def index_features(bars: DataFrame) -> DataFrame:
    """Close to the mean of 200 rows, gain over the last 20 rows and whether above the mean of 50; 1, 0 and 1 until there
    are 200 rows."""
    known = F.col("rn") >= 200
    to, gain = clip(ratio("close", mean("close", 200)), 0.8, 1.3), clip(ratio("close", lag("close", 19)) - 1, -0.15, 0.15)
    return bars.withColumns({"to_200": F.when(known, F.coalesce(to, F.lit(1.0))).otherwise(1.0), "momentum_20": F.when(known, F.coalesce(gain, F.lit(0.0))).otherwise(0.0), "above_50": F.when(known, (F.col("close") > mean("close", 50)).cast("double")).otherwise(1.0)})


#: An example, for the years of the given tables: which market a calendar year counts as.
YEAR_REGIMES = {1995: "bull", 1996: "bull", 1997: "bull", 1998: "volatile", 1999: "bull", 2000: "bear", 2001: "bear"}


def year_regime(date: Column, years: dict[int, str] | None = None) -> Column:
    """The market that a date's year counts as, by ``years``; unknown for others."""
    out = F.when(F.lit(False), "")
    for year, name in (YEAR_REGIMES if years is None else years).items():
        out = out.when(F.year(date) == year, name)
    return out.otherwise("unknown")
