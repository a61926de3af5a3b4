"""Rolling expressions over rows of a ticker in order of date.

A frame of n rows gives null until it has ``least`` values (n by default), as an incomplete window says nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

def by_date():
    """Rows of a ticker in order of date. (Window specifications need a running session, so they are made when used.)"""
    return Window.partitionBy("ticker").orderBy("date")


def rows(first: int, last: int):
    """The frame from ``first`` to ``last`` rows after the current one."""
    return by_date().rowsBetween(first, last)


def rolling(agg: Callable[[Column], Column], value: str | Column, n: int, least: int | None = None, back: int = 0) -> Column:
    """``agg`` over the last n rows, or over those that end ``back`` rows before; leak-safe with ``back`` = 1."""
    value = F.col(value) if isinstance(value, str) else value
    frame = rows(1 - n - back, -back)
    return F.when(F.count(value).over(frame) >= (n if least is None else least), agg(value).over(frame))


def mean(value, n, least=None, back=0) -> Column:
    return rolling(F.avg, value, n, least, back)


def total(value, n, least=None, back=0) -> Column:
    return rolling(F.sum, value, n, least, back)


def low(value, n, least=None, back=0) -> Column:
    return rolling(F.min, value, n, least, back)


def high(value, n, least=None, back=0) -> Column:
    return rolling(F.max, value, n, least, back)


def deviation(value, n, least=None, back=0) -> Column:
    """Sample standard deviation."""
    return rolling(F.stddev_samp, value, n, least, back)


def spread(value, n, least=None, back=0) -> Column:
    """Population standard deviation."""
    return rolling(F.stddev_pop, value, n, least, back)


def quantile(value, p: float, n: int, least=None, back=0) -> Column:
    return rolling(lambda v: F.percentile(v, F.lit(p)), value, n, least, back)


def slope(value: str | Column, n: int) -> Column:
    """Least-squares slope of the last n values against their row numbers."""
    value = F.col(value) if isinstance(value, str) else value
    frame = rows(1 - n, 0)
    return F.when(F.count(value).over(frame) >= n, F.regr_slope(value, F.col("rn").cast("double")).over(frame))


def lag(value: str, k: int = 1) -> Column:
    return F.lag(value, k).over(by_date())


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return a / F.nullif(b, F.lit(0.0))


def correlation(x: Column | str, y: Column | str, over: WindowSpec | None = None) -> Column:
    """Pearson's correlation of the rows that have both: NaN where x or y doesn't vary (``F.corr`` divides by zero there,
    an error in ANSI mode), null without such rows."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    own = lambda agg: agg if over is None else agg.over(over)
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    r = F.try_divide(own(F.covar_pop(x, y)), own(F.stddev_pop(x)) * own(F.stddev_pop(y)))
    return F.when(own(F.count(x)) > 0, F.coalesce(r, F.lit(float("nan"))))


def clip(x: Column, least: float, most: float) -> Column:
    """x within bounds; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(least)), F.lit(most)))


def prepared(bars: DataFrame) -> DataFrame:
    """Bars with the row number in their ticker (rn, from 1), previous close (pc), simple return and true range."""
    df = bars.withColumns({"rn": F.row_number().over(by_date()), "pc": lag("close")})
    true_range = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("pc")), F.abs(F.col("low") - F.col("pc")))
    return df.withColumns({"ret": ratio("close", "pc") - 1, "tr": F.when(F.col("pc").isNotNull(), true_range)})


def ewm(df: DataFrame, values: dict[str, tuple[str, float]]) -> DataFrame:
    """``df`` with exponentially weighted means: name -> (column, alpha), as y = (1 - alpha) y' + alpha x.

    The first value of a column weighs 1; nulls before it stay null. Rows are numbered from the first value on and cut
    in blocks so long that what a block inherits from before the previous one is below double precision: a row's mean
    is the weighted sum of its own block, rebased to the block's first row, and the decayed end of the block before.
    """
    for name, (column, alpha) in values.items():
        block = max(2, int(-37.0 / _ln(1 - alpha)))
        x = F.col(column)
        seen = F.count(x).over(by_date().rowsBetween(Window.unboundedPreceding, 0))
        df = df.withColumn("__k", F.when(x.isNotNull() | (seen > 0), F.sum(F.when(seen > 0, 1).otherwise(0)).over(by_date().rowsBetween(Window.unboundedPreceding, 0)) - 1))
        df = df.withColumn("__block", F.floor(F.col("__k") / block)).withColumn("__at", (F.col("__k") % block).cast("double"))
        weight = F.when(F.col("__k") == 0, F.lit(1.0)).otherwise(F.lit(alpha))
        inside = Window.partitionBy("ticker", "__block").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        powered = F.sum(weight * x * F.pow(F.lit(1 - alpha), -F.col("__at"))).over(inside)
        df = df.withColumn("__in", powered * F.pow(F.lit(1 - alpha), F.col("__at")))
        last = F.last(F.when(F.col("__at") == block - 1, F.col("__in")), ignorenulls=True).over(by_date().rowsBetween(Window.unboundedPreceding, -1))
        carried = F.when(F.col("__block") > 0, F.pow(F.lit(1 - alpha), F.col("__at") + 1) * last).otherwise(0.0)
        df = df.withColumn(name, F.when(F.col("__k").isNotNull(), F.col("__in") + carried)).drop("__k", "__block", "__at", "__in")
    return df


def _ln(x: float) -> float:
    from math import log

    return log(x)
