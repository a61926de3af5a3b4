"""Tables over patterns and their outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.positions import percentiles
from tapewright.functions.rolling import correlation, ratio
from tapewright.functions.stored import cut_table


def best(flagged: DataFrame, gain: str, least: float, top: int = 50) -> DataFrame:
    """The rows of largest gain, from ``least`` on."""
    return flagged.where(F.col(gain) >= least).orderBy(F.desc(gain), "ticker", "date").limit(top)


def by_quartile(df: DataFrame, key: str, column: str, value: str) -> DataFrame:
    """Per key and quartile of a column (half open, so that the largest row is in none): rows and mean value."""
    edges = df.groupBy(key).agg(F.percentile(column, F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0)))).alias("__e"))
    j = df.join(edges, key).withColumn("quartile", F.size(F.filter("__e", lambda e: e <= F.col(column))))
    return j.where("quartile BETWEEN 1 AND 4").groupBy(key, "quartile").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def bucketed(df: DataFrame, column: str, bounds: list[float], value: str) -> DataFrame:
    """Rows and mean value by buckets of a column: bucket k holds what is above k of the bounds."""
    bucket = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: F.col(column) > b))
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def performance(df: DataFrame, keys: list[Column], gain: str) -> DataFrame:
    """Per key: mean, Sharpe and Sortino ratios, value at risk and the mean beyond it, expectancy and Kelly share."""
    g = F.col(gain)
    df = df.withColumn("__k", F.struct(*keys))
    cut = F.percentile(g, F.lit(0.05)).over(Window.partitionBy("__k"))
    df = df.withColumn("__cut", cut)
    down = F.sqrt(F.avg(F.when(g < 0, g * g).otherwise(0.0)))
    win, loss, rate = F.avg(F.when(g > 0, g)), -F.avg(F.when(g < 0, g)), F.avg((g > 0).cast("double"))
    out = df.groupBy("__k").agg(F.count(g).alias("n"), F.avg(g).alias("mean"), ratio(F.avg(g), F.stddev_samp(g)).alias("sharpe"), ratio(F.avg(g), down).alias("sortino"), F.first("__cut").alias("var_5"), F.avg(F.when(g <= F.col("__cut"), g)).alias("cvar_5"), rate.alias("rate"), win.alias("win"), loss.alias("loss"))
    kelly = F.col("rate") - ratio(1 - F.col("rate"), ratio("win", "loss"))
    return out.withColumns({"expectancy": F.col("rate") * F.coalesce("win", F.lit(0.0)) - (1 - F.col("rate")) * F.coalesce("loss", F.lit(0.0)), "kelly": F.least(F.greatest(kelly, F.lit(0.0)), F.lit(0.25))}).select("__k.*", *[c for c in out.columns if c != "__k"], "expectancy", "kelly")


def compounded_drawdown(df: DataFrame, key: str, order: str, gain: str) -> DataFrame:
    """Per key: the product of 1 + gain in order, and its deepest fall below its highest value so far."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.where(F.col(gain) > -1).withColumn("__log", F.sum(F.log1p(gain)).over(w))
    df = df.withColumn("__dd", F.exp(F.col("__log") - F.greatest(F.max("__log").over(w), F.lit(0.0))) - 1)
    return df.groupBy(key).agg(F.max_by("__log", order).alias("log_growth"), F.min("__dd").alias("max_drawdown"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson's statistic of two classes' table, its degrees of freedom, and Cramér's V."""
    cells = df.groupBy(a, b).count()
    row, column, every = Window.partitionBy(a), Window.partitionBy(b), Window.partitionBy()  # a row for each cell
    e = F.sum("count").over(row) * F.sum("count").over(column) / F.sum("count").over(every)
    t = cells.withColumn("__e", e).withColumn("__x", F.col("count") * F.col("count") / F.col("__e"))
    out = t.agg(F.sum("count").alias("n"), (F.sum("__x") - F.sum("count")).alias("chi2"), F.count_distinct(a).alias("r"), F.count_distinct(b).alias("c"))
    # cells that no row is in add nothing to the sum above, as it is of squares over expectations less n
    return out.withColumns({"df": (F.col("r") - 1) * (F.col("c") - 1), "v": F.sqrt(F.col("chi2") / (F.col("n") * (F.least("r", "c") - 1)))}).drop("r", "c")


def winners_ranges(df: DataFrame, features: list[str], won: str) -> DataFrame:
    """Per feature: correlation with winning (NaN if all rows win or none), and the middle half of the winners' values."""
    wide = cut_table(df.select(F.col(won).alias("won"), *[F.col(f).cast("double").alias(f) for f in features]))  # percentiles read it often
    plain = [F.struct(F.lit(f).alias("feature"), correlation(f, F.col("won").cast("double")).alias("correlation"), F.avg(F.when(F.col("won"), F.col(f))).alias("mean")) for f in features]
    middle = percentiles(wide.where("won").unpivot([], features, "feature", "value"), "value", ["feature"], {"q25": 0.25, "q75": 0.75})
    return wide.agg(F.array(*plain).alias("__f")).select(F.inline("__f")).join(middle, "feature", "left").select("feature", "correlation", "q25", "q75", "mean")


def heat_map(df: DataFrame, x: str, y: str, xs: list[float], ys: list[float], value: str) -> DataFrame:
    cell = lambda c, bounds: F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: F.col(c) > b))
    return df.groupBy(cell(x, xs).alias("x"), cell(y, ys).alias("y")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def at_calendar_days(patterns: DataFrame, bars: DataFrame, days: tuple[int, ...] = (5, 10, 20, 50)) -> DataFrame:
    """Mean gain at exact calendar days after the end; dates without a bar are skipped."""
    asked = patterns.select("pattern_id", "ticker", "close", F.explode(F.array(*[F.struct(F.lit(d).alias("day"), F.date_add("end_date", d).alias("on")) for d in days])).alias("d")).select("pattern_id", "ticker", F.col("close").alias("before"), "d.day", F.col("d.on").alias("date"))
    j = asked.join(bars.select("ticker", "date", F.col("close").alias("then")), ["ticker", "date"])
    return j.groupBy("day").agg(F.count("*").alias("n"), F.avg(F.col("then") / F.col("before") - 1).alias("mean_gain"))


def top_per_class(labelled: DataFrame, label: str, order: str, top: int = 3) -> DataFrame:
    w = Window.partitionBy(label).orderBy(F.desc(order), "pattern_id")
    return labelled.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairwise correlations of columns, one row a pair."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[correlation(a, b).alias(f"{a}/{b}") for a, b in pairs])
    return one.unpivot([], [F.col(f"`{a}/{b}`") for a, b in pairs], "pair", "correlation")


def strategy_score(measured: DataFrame) -> DataFrame:
    """0 to 10: up to two points each for rate, sharpe, profit_factor, max_drawdown and expectancy."""
    score = F.lit(0)
    for c, two, one in (("rate", 0.3, 0.2), ("sharpe", 1.5, 1.0), ("profit_factor", 2.0, 1.5), ("max_drawdown", -0.15, -0.25), ("expectancy", 0.05, 0.02)):
        score = score + F.when(F.col(c) > two, 2).when(F.col(c) > one, 1).otherwise(0)
    return measured.withColumn("score", score)


