"""Filters of patterns, and removal of those that say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.positions import percentiles

#: Names of lenders, terms of financing and words of shells that a filing is screened for.
LENDERS = (
    "streeterville capital", "jmj financial", r"st\.?\s*george investments", "auctus fund", "adar bays", "commonwealth investment", "crown bridge", "eagle equities", "ema financial", "firstfire",
    "geneva roth", r"grey\s*wood", "gs capital", "gsummit", "ironridge", "jefferson street", "kingsbrook", "labrys", "lincoln park capital", "magna group", "mammoth corporation", "maxim group",
    "mercer promotion", "morningview", "power up lending", "redstart", "sbi investments", "southridge", "tangiers capital", "tonaquint", "triton funds", "typenex", "vis vires", "vystar", "yorkville advisors",
)
TERMS = {
    "floorless_conversion": r"(?is)(conversion\s+price|convertible\s+at).{0,50}(discount|percentage).{0,50}(lowest|average|closing|trading\s+price|vwap)",
    "variable_rate": r"(?i)(variable|floating).{0,30}(conversion\s+rate|conversion\s+price)",
    "no_floor": r"(?i)(no\s+floor|without\s+a\s+floor).{0,100}(conversion|price)",
    "death_spiral": r"(?i)death\s+spiral|toxic\s+convert|dilutive\s+financing",
}
SHELLS = ("nominal operations", "shell company", "blank check", "seeking a business combination", "no revenue", "development stage", "no operating history")
#: Kinds of filings in which terms of financing are looked for.
FINANCING_FILINGS = ("8-K", "10-Q", "10-K", "S-1", "S-3", "424B")
FILING_PATTERNS = {"lender": "(?i)" + "|".join(LENDERS), **TERMS, "shell": "(?i)" + "|".join(SHELLS)}


def chained(patterns: DataFrame, days: int = 10) -> DataFrame:
    """Patterns with the number of their cluster: a start more than ``days`` after the one before opens a new one."""
    order = Window.partitionBy("ticker").orderBy("start_date", "pattern_id")
    new = F.coalesce(F.datediff("start_date", F.lag("start_date").over(order)) > days, F.lit(True))
    return patterns.withColumn("__new", new.cast("int")).withColumn("cluster", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def highlander(patterns: DataFrame, days: int = 10) -> DataFrame:
    """The narrowest pattern of each cluster."""
    best = Window.partitionBy("ticker", "cluster").orderBy("box_width", "start_date", "pattern_id")
    return chained(patterns, days).withColumn("__place", F.row_number().over(best)).where("__place = 1").drop("__place")


def trinity(patterns: DataFrame, days: int = 10) -> DataFrame:
    """Of clusters of three or more the earliest, the narrowest and the middle; of others the narrowest."""
    cluster = Window.partitionBy("ticker", "cluster")
    df = chained(patterns, days).withColumns({"n": F.count("*").over(cluster), "__early": F.row_number().over(cluster.orderBy("start_date", "pattern_id")), "__narrow": F.row_number().over(cluster.orderBy("box_width", "start_date", "pattern_id"))})
    three = (F.col("n") >= 3) & ((F.col("__early") == 1) | (F.col("__narrow") == 1) | (F.col("__early") == F.floor(F.col("n") / 2) + 1))
    return df.where(three | ((F.col("n") < 3) & (F.col("__narrow") == 1))).drop("__early", "__narrow")


def heartbeat(patterns: DataFrame, bars: DataFrame, most: float = 0.8) -> DataFrame:
    """Patterns with the variation of their volume; noise if it is too large."""
    from tapewright.operators.joins import interval

    cv = F.stddev_pop("b_volume") / F.nullif(F.avg("b_volume"), F.lit(0.0))
    out = interval(patterns, bars).groupBy("pattern_id").agg(cv.alias("volume_cv"), F.count("*").alias("n"))
    return out.withColumn("is_noise", F.col("volume_cv") > most)


def duplication(patterns: DataFrame, places: int = 2) -> DataFrame:
    """Per ticker: patterns, different signatures, and their ratio."""
    signature = F.struct("ticker", "end_date", F.bround("upper", places), F.bround("lower", places))
    return patterns.groupBy("ticker").agg(F.count("*").alias("n"), F.count_distinct(signature).alias("different")).withColumn("ratio", F.col("n") / F.col("different"))


def cross_ticker(patterns: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Of patterns of the same date and nearly the same bounds, to a share of them, the one of most money, then of the
    first ticker. Bounds are rounded on a grid of logarithms, so that the tolerance is relative."""
    from math import log

    grid = lambda c: F.bround(F.ln(c) / log(1 + tolerance), 0)
    best = Window.partitionBy("end_date", grid("upper"), grid("lower")).orderBy(F.desc("money"), "ticker", "pattern_id")
    return patterns.withColumn("__place", F.row_number().over(best)).where("__place = 1").drop("__place")


def overlapping(patterns: DataFrame, days: int = 30) -> DataFrame:
    """Greedy: a cluster reaches ``days`` from its own first date; its narrowest pattern stays.

    Which cluster a pattern is in depends on all before it, so a ticker's dates are folded in order in one array (of at
    most as many values as the ticker has patterns).
    """
    dates = patterns.groupBy("ticker").agg(F.array_sort(F.collect_set("end_date")).alias("dates"))
    fold = F.aggregate("dates", F.array().cast("array<date>"), lambda a, d: F.when((F.size(a) == 0) | (F.datediff(d, F.element_at(a, -1)) > days), F.concat(a, F.array(d))).otherwise(a))
    anchors = dates.select("ticker", fold.alias("anchors"))
    anchor = F.array_max(F.filter("anchors", lambda d: d <= F.col("end_date")))
    df = patterns.join(anchors, "ticker").withColumn("anchor", anchor).drop("anchors")
    best = Window.partitionBy("ticker", "anchor").orderBy("box_width", "end_date", "pattern_id")
    return df.withColumn("__place", F.row_number().over(best)).where("__place = 1").drop("__place")


def oversampled(patterns: DataFrame, score: str, share: float = 0.2, copies: int = 3) -> DataFrame:
    """Each of the best ``share`` so many times, all others once."""
    cut = percentiles(patterns, score, [], {"__cut": 1 - share})  # one row
    n = F.when(F.col(score) >= F.col("__cut"), copies).otherwise(1)
    return patterns.join(F.broadcast(cut)).withColumn("copy", F.explode(F.sequence(F.lit(1), n))).drop("__cut")


def filings(docs: DataFrame, text: str = "text", kind: str = "filing_type") -> DataFrame:
    """Filings with a flag per kind of trouble that their text speaks of, the flags' names, and whether they pass.

    A lender anywhere, and terms in filings whose kind contains one of FINANCING_FILINGS, fail a filing; a shell only
    warns. Null texts and kinds have no flags.
    """
    flags = {k: F.coalesce(F.col(text).rlike(p), F.lit(False)) for k, p in FILING_PATTERNS.items()}
    financing = F.coalesce(F.upper(kind).rlike("|".join(FINANCING_FILINGS)), F.lit(False))
    df = docs.withColumns({k: v & financing if k in TERMS else v for k, v in flags.items()})
    critical = F.col("lender")
    for k in TERMS:
        critical = critical | F.col(k)
    return df.withColumns({"flags": F.array_join(F.array_compact(F.array(*[F.when(F.col(k), k) for k in FILING_PATTERNS])), ","), "passes": ~critical})


