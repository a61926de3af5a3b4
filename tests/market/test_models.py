"""Models, calibration, percentiles and sketches against plain computations."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.functions import positions
from tapewright.functions.rolling import correlation, prepared
from tapewright.operators import cleaning, evaluation, features, indicators, models, sequences, splits, tabulation

DAY = dt.date(2020, 1, 1)


def pooled(points):
    """Isotonic values of (x, y, w) by pooling adjacent violators."""
    ties = {}
    for x, y, w in points:
        total, weight = ties.get(x, (0.0, 0.0))
        ties[x] = total + y * w, weight + w
    xs, blocks = sorted(ties), []
    for x in xs:
        blocks.append([*ties[x], 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2] + last[2]]
    values = [b[0] / b[1] for b in blocks for _ in range(b[2])]
    return xs, values


def test_calibration_is_pooling_of_violators(spark):
    rng = random.Random(4)
    rows = [(i, round(rng.random(), 2), rng.randrange(3)) for i in range(300)] + [(300 + i, 0.5, 2) for i in range(20)]
    df = spark.createDataFrame(rows, "i int, p0 double, y int").withColumns({"p1": (1 - F.col("p0")) / 2, "p2": (1 - F.col("p0")) / 2})
    fitted = models.fit_isotonic(df, ["p0", "p1", "p2"], "y")
    got = {r.i: (r.p0, r.p1, r.p2) for r in models.calibrate(df, fitted).collect()}
    curves = []
    for k, p in enumerate((lambda x: x, lambda x: (1 - x) / 2, lambda x: (1 - x) / 2)):
        curves.append(pooled([(math.floor(p(x) * 10_000 + 0.5) / 10_000, float(y == k), 1.0) for _, x, y in rows]))
    for i, x, _ in rows:
        raw = [max(1e-8, np.interp(math.floor(p * 10_000 + 0.5) / 10_000, *c)) for p, c in zip((x, (1 - x) / 2, (1 - x) / 2), curves, strict=True)]
        assert got[i] == pytest.approx([r / sum(raw) for r in raw], abs=1e-9)
    outside = models.calibrate(spark.createDataFrame([(1.5, -1.0, None)], "p0 double, p1 double, p2 double"), fitted).first()
    assert outside.p2 is None and outside.p0 is None  # nothing to sum up to
    constant = models.fit_isotonic(df.withColumn("y", F.lit(0)), ["p0", "p1", "p2"], "y")
    assert models.calibrate(df, constant).agg(F.min("p0")).first()[0] == pytest.approx(1, abs=1e-6)


def training(spark, n=400):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        x, z = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((f"p{i}", DAY + dt.timedelta(days=i // 4), None if i % 50 == 0 else x, z, int(x + 0.5 * z + rng.gauss(0, 0.3) > 0.8), 2 + 3 * x - z + rng.gauss(0, 0.1)))
    return spark.createDataFrame(rows, "pattern_id string, end_date date, x double, z double, label int, gain double")


def test_models_learn_from_the_older_rows_alone(spark):
    df = models.weighted(models.split_by_time(training(spark), "end_date", "pattern_id"), F.col("label") == 1).cache()
    train = df.where("train")
    assert train.count() == 320 and train.agg(F.max("end_date")).first()[0] <= df.where("NOT train").agg(F.min("end_date")).first()[0]
    sums = train.groupBy("target").agg(F.sum("weight")).collect()
    assert sums[0][1] == pytest.approx(sums[1][1])
    for fit in (lambda d, f: models.fit_boosted(d, f, iterations=5, least=5), models.fit_logistic):
        scored = models.score(fit(df, ["x", "z"]), df).collect()
        metrics = {r.train: r for r in models.classifier_metrics(spark.createDataFrame(scored), top=0.1).collect()}
        assert metrics[False].auc > 0.9 and metrics[False].lift > 2
        own = sorted(((r.p_target, r.target) for r in scored if not r.train), reverse=True)
        wins = sum((a > b) + 0.5 * (a == b) for a, s in own if s for b, t in own if not t)
        assert metrics[False].auc == pytest.approx(wins / (sum(t for _, t in own) * sum(1 - t for _, t in own)))
        assert metrics[False].log_loss == pytest.approx(-sum(math.log(p if t else 1 - p) for p, t in own) / len(own))
    # labels of the newer rows don't matter
    other = models.score(models.fit_logistic(df.withColumn("target", F.when(F.col("train"), F.col("target")).otherwise(0.0)), ["x", "z"]), df)
    same = models.score(models.fit_logistic(df, ["x", "z"]), df)
    assert other.agg(F.sum("p_target")).first()[0] == pytest.approx(same.agg(F.sum("p_target")).first()[0])


def test_least_squares(spark):
    df = models.split_by_time(training(spark), "end_date", "pattern_id")
    got = [r.coefficient for r in models.linear_regression(df, ["x", "z"], "gain").collect()]
    rows = df.where("train AND x IS NOT NULL").collect()
    want = np.linalg.lstsq(np.array([[1, r.x, r.z] for r in rows]), np.array([r.gain for r in rows]), rcond=None)[0]
    assert got == pytest.approx(want.tolist())


def test_planted_clusters_are_found(spark):
    rng = random.Random(2)
    rows = [(i, 10.0 * (i % 3) + rng.gauss(0, 0.5), 5.0 * (i % 3 == 1) + rng.gauss(0, 0.2)) for i in range(150)]
    df = spark.createDataFrame(rows, "i int, a double, b double").repartition(3)
    found, profiles = models.cluster_profiles(df, ["a", "b"], most=5)
    assert {(r.i % 3, r.profile) for r in found.collect()} == {(0, 0), (1, 1), (2, 2)}
    assert [(r.n, r["name"]) for r in profiles.orderBy("profile").collect()] == [(50, "low a"), (50, "high b"), (50, "high a")]
    assert models.cluster_profiles(df, ["a", "b"], most=5)[1].orderBy("profile").collect() == profiles.orderBy("profile").collect()


def test_percentiles_are_exact(spark):
    rng = random.Random(1)
    rows = [("a", rng.gauss(0, 1)) for _ in range(500)] + [("b", float(i % 3)) for i in range(100)] + [("c", 7.0)] * 50 + [(None, 1.0), (None, 3.0), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    shares = {"lo": 0.1, "mid": 0.5, "hi": 0.93, "all": 1.0}
    for parts in (2, 64):
        assert positions.cumulative(df, "v", ["k"], parts).where("before + count > total").count() == 0
    got = {r.k: r for r in positions.percentiles(df, "v", ["k"], shares).collect()}
    assert set(got) == {"a", "b", "c", None}
    for k, r in got.items():
        values = [v for key, v in rows if key == k]
        assert [r[c] for c in shares] == pytest.approx([np.percentile(values, 100 * p) for p in shares.values()])
    assert positions.percentiles(df.where("false"), "v", [], shares).count() == 0


def test_running_sums_and_places(spark):
    rows = [(f"p{i}", i % 4, i % 3) for i in range(300)]
    got = positions.running(spark.createDataFrame(rows, "id string, d int, x int"), "d", ["id"], {"s": F.col("x")}).orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 301)) and [r.d for r in got] == sorted(r[1] for r in rows)
    assert [r.s for r in got] == np.cumsum([r.x for r in got]).tolist()


def test_distance_from_a_normal_law(spark):
    rng = random.Random(6)
    values = [rng.gauss(1, 2) for _ in range(400)] + [1.0] * 40
    df = spark.createDataFrame([(v, None if i % 2 else v + 3) for i, v in enumerate(values)], "a double, b double")
    got = {r.feature: r for r in evaluation.normality(df, {"a": (1.0, 2.0), "b": (1.0, 2.0)}).collect()}
    phi = lambda z: 0.5 * (1 + math.erf(z / 2**0.5))
    for name, own in (("a", values), ("b", [v + 3 for i, v in enumerate(values) if i % 2 == 0])):
        own = sorted((v - 1) / 2 for v in own)
        n = len(own)
        want = max(max(abs(sum(x <= v for x in own) / n - phi(v)), abs(sum(x < v for x in own) / n - phi(v))) for v in own)
        assert got[name].n == n and got[name].distance == pytest.approx(want, abs=1e-6)
    assert not got["a"].drifts and got["b"].drifts


def test_sketches_merge_and_stay_near(spark):
    rng = random.Random(3)
    rows = [(i % 5, rng.lognormvariate(0, 1), 2.0) for i in range(20_000)] + [(0, None, None), (1, float("nan"), 2.0)]
    df = spark.createDataFrame(rows, "part int, v double, flat double").repartition(4)
    sketches = sequences.sketched(df, ["v", "flat"], ["part"])
    assert sketches.count() == 10
    got = {r.column: r for r in sequences.sketched_parameters(sketches).collect()}
    ordered = sorted(v for _, v, _ in rows if v is not None and v == v)
    for name, share in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        assert abs(np.searchsorted(ordered, got["v"][name]) / len(ordered) - share) < 0.01
    assert got["v"].n == 20_000 and got["flat"].iqr == 1.0 and got["flat"].median == 2.0
    exact = {r.column: r for r in sequences.robust_parameters(df, ["v", "flat"]).collect()}
    assert exact["v"].median == pytest.approx(np.median(ordered)) and exact["flat"].iqr == 1.0
    scaled = sequences.scaled_by(df, ["v"], sequences.robust_parameters(df, ["v"])).where("v IS NOT NULL AND NOT isnan(v)").agg(F.percentile("v", F.lit(0.5))).first()[0]
    assert scaled == pytest.approx(0, abs=1e-12)


def counted_rows(spark, n, columns):
    """(``n`` rows of ``columns``, by their id; how often one of them was computed)."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def once(x):
        seen.add(1)
        return x

    once = once.asNondeterministic()  # else the optimizer may copy it
    return spark.range(n).select(once("id").alias("id")).select(F.col("id").cast("string").alias("pattern_id"), *columns), seen


def test_clusters_compute_their_input_once(spark):
    df, seen = counted_rows(spark, 60, [(F.col("id") % 3 * 10.0 + F.col("id") / 100).alias("a"), (F.col("id") % 3 * -7.0).alias("b")])
    rows, shown = models.cluster_profiles(df, ["a", "b"], most=4)
    assert shown.agg(F.sum("n")).first()[0] == 60 and rows.count() == 60
    assert seen.value == 60


def test_calibration_computes_its_input_once(spark):
    df, seen = counted_rows(spark, 40, [(F.col("id") / 50).alias("p0"), (1 - F.col("id") / 50).alias("p1"), (F.col("id") % 2).cast("int").alias("cls")])
    assert set(models.fit_isotonic(df, ["p0", "p1"], "cls")) == {"p0", "p1"}
    assert seen.value == 40


def test_winners_ranges_compute_their_input_once(spark):
    df, seen = counted_rows(spark, 40, [F.col("id").alias("x"), (F.col("id") % 4).alias("y"), (F.col("id") % 2 == 0).alias("won")])
    found = {r["feature"]: r for r in tabulation.winners_ranges(df, ["x", "y"], "won").collect()}
    assert (found["x"]["q25"], found["x"]["q75"], found["x"]["mean"]) == (9.5, 28.5, 19.0) and found["y"]["q75"] == 2.0
    assert seen.value == 40


def test_winners_ranges_without_winners_or_losers(spark):
    ranges = lambda won, n=40: {r["feature"]: r for r in tabulation.winners_ranges(spark.range(n).select(F.col("id").alias("x"), F.lit(2.5).alias("flat"), won.alias("won")), ["x", "flat"], "won").collect()}
    none, every = ranges(F.lit(False)), ranges(F.lit(True))
    assert math.isnan(none["x"]["correlation"]) and (none["x"]["q25"], none["x"]["q75"], none["x"]["mean"]) == (None, None, None)
    assert math.isnan(every["x"]["correlation"]) and (every["x"]["q25"], every["x"]["q75"], every["x"]["mean"]) == (9.75, 29.25, 19.5)
    some = ranges(F.col("id") >= 20)
    assert some["x"]["correlation"] == pytest.approx(np.corrcoef(range(40), [i >= 20 for i in range(40)])[0][1]) and math.isnan(some["flat"]["correlation"])
    assert {f: (r["correlation"], r["q25"], r["mean"]) for f, r in ranges(F.lit(True), 0).items()} == {"x": (None, None, None), "flat": (None, None, None)}


def test_correlations_of_values_that_do_not_vary(spark):
    rows = [("both", 1.0, 2.0), ("both", 2.0, 5.0), ("both", 4.0, 6.0), ("both", None, 9.0), ("flat", 1.0, 3.0), ("flat", 2.0, 3.0), ("one", 1.0, 2.0), ("one", 7.0, None), ("none", None, 1.0)]
    df = spark.createDataFrame(rows, "ticker string, ev double, actual double")
    got = {r["ticker"]: r["r"] for r in df.groupBy("ticker").agg(correlation("ev", "actual").alias("r")).collect()}
    assert got["both"] == pytest.approx(np.corrcoef([1, 2, 4], [2, 5, 6])[0][1]) and got["none"] is None
    assert math.isnan(got["flat"]) and math.isnan(got["one"])
    by_key = {r.ticker: r.pearson for r in evaluation.ev_correlation(df.where("ev IS NOT NULL AND actual IS NOT NULL"), "actual", "ticker").collect()}
    assert by_key["both"] == pytest.approx(got["both"]) and math.isnan(by_key["flat"]) and math.isnan(by_key["one"])
    flat = df.where("ticker = 'flat'")
    assert math.isnan(tabulation.correlations(flat, ["ev", "actual"]).first().correlation)
    assert math.isnan(splits.leaks(flat, ["ev"], "actual").first().correlation)
    assert math.isnan(features.interaction_importance(flat, ["actual"], "ev").first().importance)


def test_prices_that_stand_still_have_no_autocorrelation(spark):
    bars = prepared(spark.createDataFrame([("A", DAY + dt.timedelta(i), 10.0, 10.0, 10.0, 10.0 + max(0, i - 29) ** 2, 5.0) for i in range(40)], "ticker string, date date, open double, high double, low double, close double, volume double"))
    got = [r.autocorr_1 for r in indicators.autocorrelation(bars).orderBy("date").collect()]
    assert got[:20] == [None] * 20 and all(math.isnan(r) for r in got[20:30])  # 19 pairs end at the 21st row
    ret = [None] + [(10 + max(0, i - 29) ** 2) / (10 + max(0, i - 30) ** 2) - 1 for i in range(1, 40)]
    assert got[39] == pytest.approx(np.corrcoef(ret[21:40], ret[20:39])[0][1])
    flat = cleaning.made_up(bars.where("rn <= 20")).first()
    assert flat.flat_price and flat.linear  # as in SQL, where NaN is more than any number
