"""Positions and running sums over all rows without a task that sees them all.

Rows are ordered by a column, then by a hash. Rows of one value are cut in parts by the hash's first digits, so that a
value that many rows share is no task's alone; sums of the parts before are added to those inside a part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mark(*identity: str) -> Column:
    """What orders rows of one value: the MD5 of their identity, the same in any SQL engine that has it."""
    return F.md5(F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identity]).cast("binary"))


def running(df: DataFrame, order: str, identity: list[str], sums: dict[str, Column], by: list[str] | None = None, digits: int = 2) -> DataFrame:
    """``df`` with ``place`` (from 1) and the running sums of ``sums`` (whole numbers), for each value of ``by``.

    The order is ``order``, then the hash of ``identity``. The windows between parts see one row for each value of
    ``order`` and part, those inside a part the part's rows.
    """
    by = by or []
    df = df.withColumn("__mark", mark(*identity)).withColumn("__part", F.substring("__mark", 1, digits))
    keys = [*by, order, "__part"]
    values = {"place": F.lit(1), **sums}
    parts = df.groupBy(*keys).agg(*[F.sum(v).alias(f"__all_{k}") for k, v in values.items()])
    before = Window.partitionBy(*by).orderBy(order, "__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, *[F.coalesce(F.sum(f"__all_{k}").over(before), F.lit(0)).alias(f"__before_{k}") for k in values])
    inside = Window.partitionBy(*keys).orderBy("__mark").rowsBetween(Window.unboundedPreceding, 0)
    joined = df.join(parts.select(*[F.col(k).alias(f"__j{i}") for i, k in enumerate(keys)], *[f"__before_{k}" for k in values]), [F.col(k).eqNullSafe(F.col(f"__j{i}")) for i, k in enumerate(keys)])
    return joined.withColumns({k: (F.col(f"__before_{k}") + F.sum(v).over(inside)).cast("long") for k, v in values.items()}).drop("__mark", "__part", *[f"__before_{k}" for k in values], *[f"__j{i}" for i in range(len(keys))])


def cumulative(df: DataFrame, value: str, by: list[str], parts: int = 64) -> DataFrame:
    """Distinct non-null values of ``value`` with ``count``, ``before`` (how many rows are less) and ``total``, by ``by``.

    Values are counted first, so that a frequent one is one row; then they are cut at sketched quantiles in parts, of
    which the counts before are added. No task sees all rows, nor all distinct values.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("count"))
    edges = counted.groupBy(*by).agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 10_000).alias("__edges"))
    edges = edges.select(*[F.col(k).alias(f"__e{i}") for i, k in enumerate(by)], "__edges")  # a row for each ``by``
    cut = counted.join(edges, [F.col(k).eqNullSafe(F.col(f"__e{i}")) for i, k in enumerate(by)] or F.lit(True))
    cut = cut.withColumn("__part", F.size(F.filter("__edges", lambda e: e < F.col(value)))).drop("__edges", *[f"__e{i}" for i in range(len(by))])
    sums = cut.groupBy(*by, "__part").agg(F.sum("count").alias("__n"))
    own = Window.partitionBy(*by)
    sums = sums.select(*[F.col(k).alias(f"__s{i}") for i, k in enumerate(by)], F.col("__part").alias("__p"), (F.sum("__n").over(own.orderBy("__part")) - F.col("__n")).alias("__before"), F.sum("__n").over(own).alias("total"))
    joined = cut.join(sums, [F.col("__part") == F.col("__p"), *[F.col(k).eqNullSafe(F.col(f"__s{i}")) for i, k in enumerate(by)]])
    inside = F.sum("count").over(Window.partitionBy(*by, "__part").orderBy(value))
    return joined.withColumn("before", F.col("__before") + inside - F.col("count")).select(*by, value, "count", "before", "total")


def percentiles(df: DataFrame, value: str, by: list[str], shares: dict[str, float]) -> DataFrame:
    """Exact percentiles, interpolated between neighbours: a row for each ``by``, a column for each of ``shares``.

    A percentile needs the values at two places of the order, which the cumulative counts tell. Groups without a value
    have no row.
    """
    c = cumulative(df, value, by)
    at = lambda p: p * (F.col("total") - 1)
    held = lambda place: F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("count")), F.col(value)))
    found = c.groupBy(*by).agg(F.max("total").alias("total"), *[held(F.floor(at(p))).alias(f"__lo_{k}") for k, p in shares.items()], *[held(F.ceil(at(p))).alias(f"__hi_{k}") for k, p in shares.items()])
    part = lambda p: at(p) - F.floor(at(p))
    return found.where("total > 0").select(*by, *[(F.col(f"__lo_{k}") + part(p) * (F.col(f"__hi_{k}") - F.col(f"__lo_{k}"))).alias(k) for k, p in shares.items()])
