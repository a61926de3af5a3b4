"""Splits by time without leaks, and checks that there are none."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.positions import running
from tapewright.functions.rolling import correlation


def by_cutoffs(df: DataFrame, date: str, train_end: str, val_end: str) -> DataFrame:
    """train up to one date, val up to another, test after it."""
    d = F.col(date)
    return df.withColumn("split", F.when(d <= F.lit(train_end).cast("date"), "train").when(d <= F.lit(val_end).cast("date"), "val").when(d.isNotNull(), "test"))


def strict(df: DataFrame, date: str, train_share: float = 0.6, val_share: float = 0.2, gap_days: int = 30) -> DataFrame:
    """Splits at dates that leave these shares of the rows before them, with ``gap_days`` between: no date is in two.

    The cut dates are found in the counts by date, one row a date.
    """
    days = df.groupBy(date).count()
    every = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    shares = days.select(F.col(date), (F.sum("count").over(every) / F.sum("count").over(Window.partitionBy())).alias("share"))
    cuts = shares.agg(F.min(F.when(F.col("share") >= train_share, F.col(date))).alias("__t"), F.min(F.when(F.col("share") >= train_share + val_share, F.col(date))).alias("__v"))
    d = F.col(date)
    split = F.when(d <= F.col("__t"), "train").when((d > F.date_add("__t", gap_days)) & (d <= F.col("__v")), "val").when(d > F.date_add("__v", gap_days), "test").otherwise("gap")
    return df.join(F.broadcast(cuts)).withColumn("split", split).drop("__t", "__v")


def by_clusters(df: DataFrame, cluster: list[str], date: str, train_end: str, val_end: str) -> DataFrame:
    """All rows of a cluster go where its first date falls, so that no cluster is in two splits."""
    first = F.min(date).over(Window.partitionBy(*cluster))
    return by_cutoffs(df.withColumn("__first", first), "__first", train_end, val_end).drop("__first")


def spanning_clusters(split: DataFrame, cluster: list[str]) -> DataFrame:
    """Clusters that are in more than one split: none, if the split is right."""
    return split.groupBy(*cluster).agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def walk_forward(df: DataFrame, date: str, first: str, days: int = 180, test_days: int = 60, windows: int = 8) -> DataFrame:
    """Expanding windows: window k trains on all before first + k * ``days`` and tests on the ``test_days`` after it."""
    bounds = [F.date_add(F.lit(first).cast("date"), k * days) for k in range(windows)]
    d = F.col(date)
    which = F.array(*[F.struct(F.lit(k).alias("window"), F.when(d < b, "train").when(d < F.date_add(b, test_days), "test").alias("role")) for k, b in enumerate(bounds)])
    return df.withColumn("w", F.explode(F.filter(which, lambda x: x["role"].isNotNull()))).select(*df.columns, "w.window", "w.role")


def first_predictions(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Of several windows' predictions for the same keys, that of the first window."""
    return predictions.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("window"))).where("__n = 1").drop("__n")


def purged_folds(df: DataFrame, key: str, order: list[str], folds: int = 5, purge: int = 5) -> DataFrame:
    """Each row's role in each fold of its key's rows in order: test in its own, purged within ``purge`` rows of it, else
    train."""
    w = Window.partitionBy(key)
    df = df.withColumns({"__i": F.row_number().over(w.orderBy(*order)) - 1, "__n": F.count("*").over(w)})
    each = F.transform(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: F.struct(k.alias("fold"), F.floor(F.col("__n") * k / folds).alias("a"), F.floor(F.col("__n") * (k + 1) / folds).alias("b")))
    df = df.withColumn("__f", F.explode(each))
    i, a, b = F.col("__i"), F.col("__f.a"), F.col("__f.b")
    role = F.when((i >= a) & (i < b), "test").when((i >= a - purge) & (i < b + purge), "purged").otherwise("train")
    return df.withColumns({"fold": F.col("__f.fold"), "role": role}).drop("__i", "__n", "__f")


def coverage(df: DataFrame, key: str, date: str, per_year: float = 252.0) -> DataFrame:
    """Rows of a key to those that its span of days should have."""
    out = df.groupBy(key).agg(F.count("*").alias("n"), (F.datediff(F.max(date), F.min(date)) + 1).alias("days"))
    return out.withColumn("coverage", F.col("n") / (F.col("days") * per_year / 365))


def regime_coverage(split: DataFrame, regime: str) -> DataFrame:
    """Rows of each split and regime, and their share of the split."""
    n = split.groupBy("split", regime).count()
    return n.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy("split")))


def leaks(df: DataFrame, features: list[str], target: str, most: float = 0.7) -> DataFrame:
    """Features that are named like an outcome, or go with the target too well."""
    one = df.agg(*[correlation(F.col(f).cast("double"), F.col(target).cast("double")).alias(f) for f in features])
    long = one.unpivot([], features, "feature", "correlation")
    named = F.col("feature").rlike("^(fwd_|label|outcome|future)|(_gain|_day)$")
    return long.withColumns({"named": named, "correlated": F.coalesce(F.abs("correlation") > most, F.lit(False))}).withColumn("leaks", F.col("named") | F.col("correlated"))


def order_of_splits(split: DataFrame, date: str) -> DataFrame:
    """Whether each split begins after the one before it ends."""
    ends = split.groupBy("split").agg(F.min(date).alias("first"), F.max(date).alias("last"), F.count("*").alias("n"))
    return ends.withColumn("in_order", F.coalesce(F.col("first") > F.lag("last").over(Window.orderBy("first")), F.lit(True)))


def power(split: DataFrame, label: str, target: int, least: int = 30) -> DataFrame:
    """Per split: rows, rows of the target class, its share, and whether they are enough."""
    out = split.groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col(label) == target).alias("targets"))
    return out.withColumns({"share": F.col("targets") / F.col("n"), "enough": F.col("targets") >= least})


def unseen(split: DataFrame, key: str) -> DataFrame:
    """Test rows of keys that training has none of."""
    return split.where("split = 'test'").join(split.where("split = 'train'").select(key).distinct(), key, "left_anti")


def stratified(df: DataFrame, label: str, key: str, test_share: float = 0.2, val_share: float = 0.2) -> DataFrame:
    """A draw by a hash of the key within each class, for where time plays no part.

    Places in a class come from parts of it by the hash; classes' sizes are a row each.
    """
    placed = running(df, label, [key], {}, [label])
    sizes = df.groupBy(F.col(label).alias("__class")).agg(F.count("*").alias("__n"))
    df = placed.join(sizes, F.col(label).eqNullSafe(F.col("__class")))
    place = (F.col("place") - 1) / F.col("__n")
    return df.withColumn("split", F.when(place < test_share, "test").when(place < test_share + val_share, "val").otherwise("train")).drop("place", "__class", "__n")
