"""Sequences of rows inside patterns: windows, relative prices, scaled volume, scaling and padding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.positions import percentiles
from tapewright.functions.rolling import by_date, quantile
from tapewright.operators.joins import interval

PRICES = ("open", "high", "low", "close")


def inside(patterns: DataFrame, bars: DataFrame, n: int = 10, stride: int = 5) -> DataFrame:
    """Windows of n rows inside each pattern, every ``stride`` rows: pattern_id, first row's place, and a list of steps.

    A window of rows with unknown prices or volume isn't given.
    """
    ref = bars.select(F.col("ticker").alias("r_ticker"), F.col("date").alias("r_date"), quantile("volume", 0.5, 126, least=1).alias("r_volume"))
    j = interval(patterns, bars).join(ref, (F.col("ticker") == F.col("r_ticker")) & (F.col("b_date") == F.col("r_date")))
    w = Window.partitionBy("pattern_id").orderBy("b_date")
    step = F.struct(*[F.col(f"b_{c}").alias(c) for c in (*PRICES, "volume")])
    j = j.withColumns({"at": F.row_number().over(w), "steps": F.collect_list(step).over(w.rowsBetween(1 - n, 0)), "reference": F.first("r_volume").over(w.rowsBetween(1 - n, 0))})
    out = j.where((F.col("at") >= n) & ((F.col("at") - n) % stride == 0) & (F.size("steps") == n))
    whole = F.forall("steps", lambda s: s["close"].isNotNull() & s["open"].isNotNull() & s["high"].isNotNull() & s["low"].isNotNull() & s["volume"].isNotNull())
    return out.where(whole).select("pattern_id", (F.col("at") - n + 1).alias("first"), "steps", "reference")


def relative(windows: DataFrame, least: float = -4.0, most: float = 6.0) -> DataFrame:
    """Prices of the steps as shares of the window's first close less one, volume as the logarithm of its ratio to the
    reference (or the first volume), clipped."""
    first = F.get("steps", F.lit(0))["close"]
    base = F.coalesce(F.nullif(F.col("reference"), F.lit(0.0)), F.nullif(F.get("steps", F.lit(0))["volume"], F.lit(0.0)), F.lit(1.0))
    clipped = lambda x: F.least(F.greatest(x, F.lit(least)), F.lit(most))
    step = lambda s: F.struct(*[(s[c] / first - 1).alias(c) for c in PRICES], clipped(F.ln((s["volume"] + 1) / (base + 1))).alias("volume"))
    return windows.withColumn("steps", F.transform("steps", step))


def scaled(df: DataFrame, columns: list[str], train: str, method: str = "standard") -> DataFrame:
    """Columns scaled by parameters of the training rows only: standard, minmax or robust. The parameters are one row."""
    on = lambda c: F.when(F.col(train), F.col(c))
    if method == "standard":
        low, span = (lambda c: F.avg(on(c))), (lambda c: F.stddev_pop(on(c)))
    elif method == "minmax":
        low, span = (lambda c: F.min(on(c))), (lambda c: F.max(on(c)) - F.min(on(c)))
    else:
        return scaled_by(df, columns, robust_parameters(df.where(F.col(train)), columns))
    params = df.agg(*[low(c).alias(f"__low_{c}") for c in columns], *[span(c).alias(f"__span_{c}") for c in columns])
    out = df.join(F.broadcast(params))
    safe = lambda c: F.when(F.col(f"__span_{c}") < 1e-6, 1.0).otherwise(F.col(f"__span_{c}"))
    return out.select(*[((F.col(c) - F.col(f"__low_{c}")) / safe(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def scaled_by(df: DataFrame, columns: list[str], params: DataFrame) -> DataFrame:
    """Columns less their median, by their IQR: ``params`` has column, median and iqr, a row for each of ``columns``."""
    one = params.agg(*[F.max(F.when(F.col("column") == c, F.col(x))).alias(f"__{x}_{c}") for c in columns for x in ("median", "iqr")])  # one row
    out = df.join(F.broadcast(one))
    return out.select(*[((F.col(c) - F.col(f"__median_{c}")) / F.col(f"__iqr_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])


def _long(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    each = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]
    return df.select(*keep, F.explode(F.array(*each)).alias("x")).select(*keep, "x.*").where("value IS NOT NULL AND NOT isnan(value)")


def _parameters(quartiles: DataFrame) -> DataFrame:
    """An IQR below a millionth counts as 1."""
    iqr = F.col("q3") - F.col("q1")
    return quartiles.withColumn("iqr", F.when(iqr < 1e-6, 1.0).otherwise(iqr))


def robust_parameters(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact medians and IQRs of columns over all rows; values that are null or no number don't count."""
    return _parameters(percentiles(_long(df, columns), "value", ["column"], {"q1": 0.25, "median": 0.5, "q3": 0.75})).select("column", "median", "iqr", "q1", "q3")


def sketched(df: DataFrame, columns: list[str], by: list[str] | None = None, k: int = 800) -> DataFrame:
    """A quantile sketch of each column (for each value of ``by``): a table of some kilobytes a row, made in one pass.

    Sketches of new rows can be kept beside those of earlier ones, and are merged when parameters are asked for. Larger
    ``k`` means closer ranks: 800 errs by about .4 %.
    """
    by = by or []
    return _long(df, columns, *by).groupBy(*by, "column").agg(F.kll_sketch_agg_double("value", k).alias("sketch"))


def sketched_parameters(sketches: DataFrame) -> DataFrame:
    """Medians and IQRs of all that the sketches of a column have seen, and how many values that were."""
    merged = sketches.groupBy("column").agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    q = lambda p: F.kll_sketch_get_quantile_double("sketch", F.lit(p))
    return _parameters(merged.select("column", q(0.5).alias("median"), q(0.25).alias("q1"), q(0.75).alias("q3"), F.kll_sketch_get_n_double("sketch").alias("n"))).select("column", "median", "iqr", "q1", "q3", "n")


def padded(df: DataFrame, column: str, n: int, value: float = 0.0, front: bool = True) -> DataFrame:
    """Lists of exactly n values: the last n of longer ones, padded before (or after) the shorter."""
    size = F.size(column)
    cut = F.when(size > n, F.slice(column, size - n + 1, F.lit(n))).otherwise(F.col(column))
    pad = F.array_repeat(F.lit(value), F.greatest(F.lit(n) - size, F.lit(0)))
    return df.withColumn(column, F.concat(pad, cut) if front else F.concat(cut, pad))


def look_back(snapshots: DataFrame, bars: DataFrame, columns: list[str], days: int = 50, warm_up: int = 20) -> DataFrame:
    """Each snapshot's last ``days`` calendar days, the snapshot's included: ``steps``, a list of values a day, and ``mask``.

    A day has the values of the last bar up to it; it is masked (0, with zeros) before the ticker has ``warm_up`` bars
    and where its values sum to 0; null values are 0. Snapshots have pattern_id, ticker and snapshot_date; one without
    bars is masked whole. No bar after a snapshot is read.

    A bar stands for the days up to the next one, so that a snapshot meets bars, not days, by ticker and block of days;
    then each bar is spread over its days.
    """
    until = snapshots.agg(F.max("snapshot_date").alias("__until"))  # one row
    day = F.unix_date("date")
    values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    known = (F.col("rn") >= warm_up) & (total != 0)
    zeros = F.array(*[F.lit(0.0)] * len(columns))
    b = bars.join(F.broadcast(until)).select(
        F.col("ticker").alias("b_ticker"), day.alias("b_from"), F.coalesce(F.lead(day).over(by_date()) - 1, F.greatest(F.unix_date("__until"), day)).alias("b_to"), F.when(known, values).otherwise(zeros).alias("b_values"), known.cast("int").alias("b_mask")
    )
    b = b.withColumn("b_block", F.explode(F.sequence(F.floor(F.col("b_from") / days), F.floor(F.col("b_to") / days))))
    last = F.unix_date("snapshot_date")
    asked = snapshots.select("pattern_id", "ticker", last.alias("s_to")).withColumn("s_block", F.explode(F.sequence(F.floor((F.col("s_to") - days + 1) / days), F.floor(F.col("s_to") / days))))
    first, end = F.greatest("b_from", F.col("s_to") - days + 1), F.least("b_to", "s_to")
    # a bar and a snapshot may share two blocks: they meet in the first
    both = F.greatest(F.floor(F.col("b_from") / days), F.floor((F.col("s_to") - days + 1) / days))
    met = asked.join(b, (F.col("ticker") == F.col("b_ticker")) & (F.col("s_block") == F.col("b_block")) & (first <= end) & (F.col("s_block") == both))
    spread = met.select("pattern_id", F.explode(F.sequence(first, end)).alias("d"), "b_values", "b_mask")
    found = spread.groupBy("pattern_id").agg(F.array_sort(F.collect_list(F.struct("d", "b_values", "b_mask"))).alias("__f"))
    out = snapshots.join(found, "pattern_id", "left").withColumn("__f", F.coalesce("__f", F.expr("CAST(array() AS array<struct<d: int, b_values: array<double>, b_mask: int>>)")))
    missing = F.lit(days) - F.size("__f")  # days before the first bar
    return out.withColumns({"steps": F.concat(F.array_repeat(zeros, missing), F.col("__f.b_values")), "mask": F.concat(F.array_repeat(F.lit(0), missing), F.col("__f.b_mask"))}).drop("__f")
