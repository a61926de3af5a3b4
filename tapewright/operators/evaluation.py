"""Scores of predictions, sizes of positions and plans of orders. Predictions have pattern_id, p0, p1 and p2: the
probabilities of danger, noise and target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.positions import cumulative, percentiles
from tapewright.functions.rolling import correlation, ratio
from tapewright.operators.labels import after, first_day

#: What danger, noise and target are worth, in multiples of risk.
VALUES = (-2.0, -0.1, 5.0)


def expected_value(predictions: DataFrame, danger: float = 0.5) -> DataFrame:
    """ev, and a signal: STRONG from 5, GOOD from 3, MODERATE from 1; AVOID below, and where danger is too likely."""
    ev = sum((F.col(f"p{i}") * v for i, v in enumerate(VALUES[1:], 1)), F.col("p0") * VALUES[0])
    df = predictions.withColumn("ev", ev)
    return df.withColumn("signal", F.when(F.col("p0") > danger, "AVOID").when(F.col("ev") >= 5, "STRONG").when(F.col("ev") >= 3, "GOOD").when(F.col("ev") >= 1, "MODERATE").otherwise("AVOID"))


def sized(plan: DataFrame, risk: float = 250.0, capital: float = 50_000.0, share_of_money: float = 0.1, offset: float = 0.01) -> DataFrame:
    """Whole shares by risk, capital and a share of the mean money traded, in tranches of 50, 25 and 25 % sold at 3, 5
    and 10 risks. The order is triggered above the upper bound and limited to half a risk above that.

    Rows have upper, lower and money; one without risk gets no shares, one without money isn't held by that bound.
    """
    entry = F.col("upper") + offset
    one = entry - F.col("lower")
    shares = F.least(F.floor(F.lit(risk) / one), F.floor(F.lit(capital) / entry), F.when(F.col("money") > 0, F.floor(F.col("money") * share_of_money / entry)))
    df = plan.withColumns({"entry": entry, "limit": entry + 0.5 * F.greatest(one, F.lit(0.0)), "risk": one, "shares": F.when(one > 0, F.greatest(shares, F.lit(0))).otherwise(0).cast("long")})
    first, second = F.floor(F.col("shares") * 0.5), F.floor(F.col("shares") * 0.25)
    return df.withColumns({"tranche_1": first, "tranche_2": second, "tranche_3": F.col("shares") - first - second, "sell_1": entry + 3 * one, "sell_2": entry + 5 * one, "sell_3": entry + 10 * one})


def execution_plan(predictions: DataFrame, patterns: DataFrame, per_group: int = 3, group: str = "ticker", least: float = 0.0, **limits: float) -> DataFrame:
    """Predictions with their patterns, sized (within ``limits``), ranked by expected value, and so many a group in that
    order."""
    df = sized(expected_value(predictions).join(patterns, "pattern_id"), **limits).where((F.col("ev") > least) & (F.col("signal") != "AVOID") & (F.col("shares") > 0))
    best = Window.partitionBy(group).orderBy(F.desc("ev"), "pattern_id")
    return df.withColumn("place", F.row_number().over(best)).where(F.col("place") <= per_group)


def gap_adjusted(patterns: DataFrame, bars: DataFrame, n: int = 20) -> DataFrame:
    """Gap from the close to the next open in multiples of risk, and the final result less that."""
    risk = F.col("close") - F.col("lower")
    j = after(patterns, bars, n).groupBy("pattern_id").agg(F.min_by(ratio(F.col("b_open") - F.col("close"), risk), "day").alias("gap_r"), F.max_by(ratio(F.col("b_close") - F.col("close"), risk), "day").alias("final_r"))
    return j.withColumns({"penalty": F.greatest("gap_r", F.lit(0.0)), "realised_r": F.col("final_r") - F.greatest("gap_r", F.lit(0.0))})


def at_thresholds(scored: DataFrame, hit: str, bounds: list[float]) -> DataFrame:
    """Rows of at least each expected value, how many hit, and their mean value."""
    each = F.explode(F.filter(F.array(*map(F.lit, bounds)), lambda b: F.col("ev") >= b))
    return scored.withColumn("bound", each).groupBy("bound").agg(F.count("*").alias("n"), F.count_if(F.col(hit)).alias("hits"), F.avg("ev").alias("mean_ev"))


def ev_calibration(scored: DataFrame, actual: str, bins: int = 10) -> DataFrame:
    """Mean expected and actual value by bins of equal numbers of rows.

    The bins' edges are exact quantiles from counts of distinct values in parts.
    """
    edges = percentiles(scored, "ev", [], {f"e{i}": i / bins for i in range(1, bins)})  # one row
    edges = edges.select(F.array_distinct(F.array(*[f"e{i}" for i in range(1, bins)])).alias("__e"))
    df = scored.join(F.broadcast(edges)).withColumn("bin", F.size(F.filter("__e", lambda e: e < F.col("ev"))))
    return df.groupBy("bin").agg(F.count("*").alias("n"), F.avg("ev").alias("mean_ev"), F.avg(actual).alias("mean_actual"))


def ev_correlation(scored: DataFrame, actual: str, key: str) -> DataFrame:
    """Per key: Pearson and Spearman correlation of expected and actual value, mean errors, and how often signs agree."""
    w = Window.partitionBy(key)
    rank = lambda c: F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy(key, c)) - 1) / 2
    df = scored.withColumns({"__re": rank("ev"), "__ra": rank(actual)})
    e = F.col("ev") - F.col(actual)
    return df.groupBy(key).agg(correlation("ev", actual).alias("pearson"), correlation("__re", "__ra").alias("spearman"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg((F.signum("ev") == F.signum(actual)).cast("double")).alias("sign_agrees"))


def target_and_danger(scored: DataFrame, label: str) -> DataFrame:
    """Recall of targets and precision of dangers, by the likeliest class (the lowest on ties)."""
    best = F.when((F.col("p0") >= F.col("p1")) & (F.col("p0") >= F.col("p2")), 0).when(F.col("p1") >= F.col("p2"), 1).otherwise(2)
    df = scored.withColumn("__best", best)
    hit = lambda k: F.count_if((F.col("__best") == k) & (F.col(label) == k))
    return df.agg(F.count("*").alias("n"), ratio(hit(2).cast("double"), F.count_if(F.col(label) == 2).cast("double")).alias("target_recall"), ratio(hit(0).cast("double"), F.count_if(F.col("__best") == 0).cast("double")).alias("danger_precision"))


def by_signal(scored: DataFrame, label: str) -> DataFrame:
    return scored.groupBy("signal").agg(F.count("*").alias("n"), F.avg((F.col(label) == 2).cast("double")).alias("targets"), F.avg((F.col(label) == 0).cast("double")).alias("dangers"), F.avg("ev").alias("mean_ev"))


def confusion(scored: DataFrame, label: str) -> DataFrame:
    """Per class: precision, recall and their harmonic mean, by the likeliest class."""
    best = F.when((F.col("p0") >= F.col("p1")) & (F.col("p0") >= F.col("p2")), 0).when(F.col("p1") >= F.col("p2"), 1).otherwise(2)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("class"), (F.col(label) == k).alias("is"), (best == k).alias("said")) for k in range(3)]))
    out = scored.select(each.alias("x")).groupBy("x.class").agg(F.count_if("x.is").alias("support"), F.count_if(F.col("x.is") & F.col("x.said")).alias("tp"), F.count_if("x.said").alias("said"))
    out = out.withColumns({"precision": ratio(F.col("tp").cast("double"), F.col("said").cast("double")), "recall": ratio(F.col("tp").cast("double"), F.col("support").cast("double"))})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def brier(scored: DataFrame, label: str) -> DataFrame:
    """Mean squared error of the three probabilities, summed over classes."""
    error = sum(((F.col(f"p{k}") - (F.col(label) == k).cast("double")) * (F.col(f"p{k}") - (F.col(label) == k).cast("double")) for k in (1, 2)), (F.col("p0") - (F.col(label) == 0).cast("double")) * (F.col("p0") - (F.col(label) == 0).cast("double")))
    return scored.agg(F.count("*").alias("n"), F.avg(error).alias("brier"))


def ensemble_uncertainty(members: DataFrame, key: str) -> DataFrame:
    """Per key over members' rows: means and population deviations, mean and interval of the expected value, entropies,
    and how many members agree with the mean's likeliest class."""
    ev = sum((F.col(f"p{i}") * v for i, v in enumerate(VALUES[1:], 1)), F.col("p0") * VALUES[0])
    entropy = lambda *ps: -sum((p * F.ln(F.greatest(p, F.lit(1e-12))) for p in ps[1:]), ps[0] * F.ln(F.greatest(ps[0], F.lit(1e-12))))
    p = [F.col(f"p{k}") for k in range(3)]
    best = F.when((p[0] >= p[1]) & (p[0] >= p[2]), 0).when(p[1] >= p[2], 1).otherwise(2)
    df = members.withColumns({"__ev": ev, "__h": entropy(*p), "__b": best})
    out = df.groupBy(key).agg(*[F.avg(f"p{k}").alias(f"mean_{k}") for k in range(3)], *[F.stddev_pop(f"p{k}").alias(f"std_{k}") for k in range(3)], F.avg("__ev").alias("ev_mean"), F.stddev_pop("__ev").alias("ev_std"), F.percentile("__ev", F.lit(0.05)).alias("ev_low"), F.percentile("__ev", F.lit(0.95)).alias("ev_high"), F.avg("__h").alias("aleatoric"), *[F.count_if(F.col("__b") == k).alias(f"__n{k}") for k in range(3)])
    n = [F.col(f"__n{k}") for k in range(3)]
    most = F.greatest(*n)
    out = out.withColumn("modal", F.when(n[0] == most, 0).when(n[1] == most, 1).otherwise(2))
    agree = most / (n[0] + n[1] + n[2])
    epistemic = sum((F.col(f"std_{k}") * F.col(f"std_{k}") for k in (1, 2)), F.col("std_0") * F.col("std_0")) / 3
    return out.withColumns({"agreement": agree, "epistemic": epistemic}).drop(*[f"__n{k}" for k in range(3)])


def importance_ranks(runs: DataFrame) -> DataFrame:
    """Mean importance of each feature over runs, and its rank."""
    out = runs.groupBy("feature").agg(F.avg("importance").alias("importance"), F.count("*").alias("runs"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))


def signal_exits(patterns: DataFrame, bars: DataFrame, n: int = 100, stop: float = 0.3, target: float = 1.0) -> DataFrame:
    """Entry at the next open; out at the first of stop, target and the last row: reason, day and gain."""
    j = after(patterns, bars, n)
    entry = j.groupBy("pattern_id").agg(F.min_by("b_open", "day").alias("entry"))
    k = j.join(entry, "pattern_id")
    out = k.groupBy("pattern_id", "entry").agg(first_day(F.col("b_low") <= F.col("entry") * (1 - stop)).alias("stop_day"), first_day(F.col("b_high") >= F.col("entry") * (1 + target)).alias("target_day"), F.max("day").alias("last_day"), F.max_by("b_close", "day").alias("last_close"))
    never = F.lit(1 << 30)
    s, t = F.coalesce("stop_day", never), F.coalesce("target_day", never)
    reason = F.when((s <= t) & (s < never), "stop").when(t < never, "target").otherwise("timeout")
    gain = F.when(reason == "stop", F.lit(-stop)).when(reason == "target", F.lit(target)).otherwise(ratio("last_close", "entry") - 1)
    return out.select("pattern_id", reason.alias("reason"), F.least(s, t, F.col("last_day")).alias("exit_day"), gain.alias("fwd_pnl"))


def class_drift(labelled: DataFrame, early: Column, label: str) -> DataFrame:
    """Kullback-Leibler divergence of the later rows' classes from the earlier ones'."""
    n = labelled.groupBy(label).agg(F.count_if(early).alias("a"), F.count_if(~early).alias("b"))
    every = Window.partitionBy()  # one row a class
    p, q = F.greatest(F.col("a") / F.sum("a").over(every), F.lit(1e-6)), F.greatest(F.col("b") / F.sum("b").over(every), F.lit(1e-6))
    return n.select(p.alias("p"), q.alias("q")).agg((F.sum(F.col("q") * F.ln(F.col("q") / F.col("p")))).alias("kl"), F.count("*").alias("classes"))


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution, by a rational approximation of the error function; to 1e-7."""
    #: The approximation's coefficients.
    a = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    z = F.abs(x) / 2**0.5
    t = 1 / (1 + 0.3275911 * z)
    series = t * (a[0] + t * (a[1] + t * (a[2] + t * (a[3] + t * a[4]))))
    half = 0.5 * (1 - series * F.exp(-z * z))
    return 0.5 + F.signum(x) * half


def normality(df: DataFrame, features: dict[str, tuple[float, float]], terms: int = 100) -> DataFrame:
    """By feature: how far its values' distribution is from the normal one of a reference's mean and deviation.

    The Kolmogorov-Smirnov distance, its asymptotic probability, and whether that is below .05. Places of all values
    come from counts of distinct ones (nulls don't count), so that no task sees a feature's all.
    """
    each = [F.struct(F.lit(k).alias("feature"), ((F.col(k) - mu) / sd).cast("double").alias("z")) for k, (mu, sd) in features.items() if sd]
    c = cumulative(df.select(F.explode(F.array(*each)).alias("x")).select("x.*"), "z", ["feature"])
    phi, n = normal_cdf(F.col("z")), F.col("total")
    away = F.greatest(F.abs((F.col("before") + F.col("count")) / n - phi), F.abs(F.col("before") / n - phi))
    out = c.groupBy("feature").agg(F.max(n).alias("n"), F.max(away).alias("distance"))
    x = F.col("n") * F.col("distance") * F.col("distance")
    tail = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2 * k * k * x))
    p = F.when(x < 0.04, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), tail)))
    return out.withColumn("p_value", p).withColumn("drifts", F.col("p_value") < 0.05)
