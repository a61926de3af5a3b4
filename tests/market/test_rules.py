"""Labels, values, regimes and screens on hand-made rows: each case tells the rule from a near one."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapewright.functions.rolling import prepared
from tapewright.operators import criteria, evaluation, features, filters, outcomes, regimes, selection, tabulation

DAY = dt.date(2020, 1, 1)
SCHEMA = "ticker string, date date, open double, high double, low double, close double, volume double"


def bars(spark, rows):
    """Rows of (high, low, close[, volume]) or closes."""
    made = []
    for i, r in enumerate(rows):
        h, lo, c, v = (*r, 100.0)[:4] if isinstance(r, tuple) else (r + 0.5, r - 0.5, r, 100.0)
        made.append(("A", DAY + dt.timedelta(days=i), float(c), float(h), float(lo), float(c), float(v)))
    return prepared(spark.createDataFrame(made, SCHEMA))


def pattern(spark, end_rn=3, upper=11.0, lower=9.0, close=10.0, **more):
    row = {"pattern_id": "A-1", "ticker": "A", "start_date": DAY, "end_date": DAY + dt.timedelta(days=end_rn - 1), "end_rn": end_rn, "upper": upper, "lower": lower, "box_width": (upper - lower) / lower, "close": close, "mean_volume": 100.0, "money": 1000.0} | more
    return spark.createDataFrame([row])


def test_values_of_classes(spark):
    df = spark.range(7).select(F.col("id").alias("k"), outcomes.class_value(F.col("id")).alias("v"))
    assert [r.v for r in df.orderBy("k").collect()] == [-2.0, -0.2, 1.0, 3.0, 10.0, -10.0, None]
    phases = spark.createDataFrame([(2, 0), (2, 1), (2, 2), (1, 2), (0, 0), (2, None)], "label int, phase int")
    assert [r.v for r in phases.select(outcomes.phase_value(F.col("label"), F.col("phase")).alias("v")).collect()] == [3.0, 5.0, 4.0, -0.15, -2.0, 5.0]


def test_atr_stop_hangs_off_the_lower_bound(spark):
    flat = [(11, 9, 10)] * 30  # true range 2, so stop 9 - 4 and target 10 + 10
    p = pattern(spark, end_rn=30)
    assert outcomes.atr_path(p, bars(spark, [*flat, (10, 5.5, 10), (21, 20, 20), (21, 20, 20)]), 5).first().label == 2
    assert outcomes.atr_path(p, bars(spark, [*flat, (10, 4.9, 10), (21, 20, 20), (21, 20, 20)]), 5).first().label == 0
    assert outcomes.atr_path(p, bars(spark, [(10, 10, 10)] * 33), 3).count() == 0
    # one range of 20 at the end weighs a fourteenth
    spread = outcomes.atr_path(pattern(spark, end_rn=30, lower=9.0), bars(spark, [*flat[:29], (20, 0, 10), (12, 9 - 2 * (2 + 18 / 14) + 0.01, 10)]), 3).first()
    assert spread.stop_day is None


def test_volume_is_measured_against_the_days_before(spark):
    quiet = [(11, 9, 10, 100)] * 21
    run = lambda *vs: outcomes.volume_confirmed(pattern(spark, end_rn=21), bars(spark, [*quiet, *[(11, 9, 10, v) for v in vs]]), money=0.0).first()
    assert run(250, 250, 250).confirmed_day == 3  # a moving mean would rise with the surge
    assert not run(250, 250, 100, 250, 250).confirmed and not run(200, 200, 200).confirmed
    assert not outcomes.volume_confirmed(pattern(spark, end_rn=21), bars(spark, quiet + [(11, 9, 10, 250)] * 3)).first().confirmed  # too little money


def test_first_breach_decides(spark):
    label = lambda *days: outcomes.graceful_breach(pattern(spark, end_rn=1), bars(spark, [(10, 10, 10), *days]), n=20).first()
    assert label((20, 10, 15), (10, 5, 6)).label == 4  # the later fall doesn't matter
    assert label((15, 10, 12), (20, 10, 12)).label == 3  # nor does the later rise
    assert label((20, 5, 12)).label == 5  # the fall wins a day
    assert label((12.8, 10, 12)).label == 2 and label((10, 9, 10)).label == 0
    below = [(9, 8.5, 8.8)] * 7
    assert label(*below).anxious and not label(*below[:6]).anxious
    assert not label(*below[:6], (9, 8, 8.5)).anxious  # the seventh is deep
    assert label(*below[:6], (9, 8, 8.5)).longest_below == 7


def test_signed_classes(spark):
    gains = [-0.06, -0.05, 0.049, 0.05, 0.15, 0.35, 0.75, None]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(gains)], "i int, g double")
    assert [r.k for r in df.orderBy("i").select(outcomes.signed_class(F.col("g")).alias("k")).collect()] == [5, 0, 0, 1, 2, 3, 4, None]


def test_risk_is_from_the_stop_and_by_closes(spark):
    r = outcomes.risk_metrics(pattern(spark, end_rn=1), bars(spark, [10, (30, 10, 12.36), (12, 9, 10)]), buffer=0.02).first()
    assert (r.fwd_max_r, r.fwd_min_r, r.achieved_r) == pytest.approx((2.0, 0.0, 2.0))
    assert outcomes.risk_metrics(pattern(spark, end_rn=1), bars(spark, [10, 12.0, 8.0])).first().achieved_r == -1
    r = outcomes.risk_metrics(pattern(spark, end_rn=1, lower=11.0), bars(spark, [10, 12.0])).first()
    assert (r.risk, r.fwd_max_r, r.achieved_r) == (0, 0, 0)


def test_boxes_of_methods(spark):
    wide = [(100 + i % 7, 90 - i % 5, 95 + (i * 31) % 9, 100) for i in range(119)]
    last = criteria.method_bounds(bars(spark, [*wide, (95.5, 94.9, 95, 10)])).where("rn = 120").first()
    assert not last.m2 and not last.m3  # small range and volume in boxes of more than 15 and 12 %
    narrow = [(100.4 + 0.1 * (i % 3), 99.6 - 0.1 * (i % 2), 100 + 0.2 * ((i * 7) % 3 - 1), 100) for i in range(119)]
    last = criteria.method_bounds(bars(spark, [*narrow, (100.1, 99.9, 100, 10)]), adx=101.0).where("rn = 120").first()
    assert last.m2 and last.m3 and last.m2_upper == pytest.approx(100.6) and last.m2_lower == pytest.approx(99.5) and last.m2_power == pytest.approx(100.6 * 1.005)
    calm = [(105, 95, 100 + 3 * (i % 2)) for i in range(100)] + [(100.2, 99.8, 100)] * 25
    last = criteria.method_bounds(bars(spark, calm)).where("rn = 125").first()
    assert last.m1 and (last.m1_upper, last.m1_lower) == (100.2, 99.8)
    assert last.m4 and (last.m4_upper, last.m4_lower) == (100.2, 99.8)  # 100 +- .6 is cut to what was seen
    assert not criteria.method_bounds(bars(spark, calm)).where("rn <= 100 AND (m1 OR m4)").count()


def test_signals_and_sizes(spark):
    p = spark.createDataFrame([(0.0, 0.0, 1.0), (0.1, 0.25, 0.65), (0.2, 0.5, 0.3), (0.3, 0.5, 0.2), (0.6, 0.0, 0.4)], "p0 double, p1 double, p2 double")
    assert [r.signal for r in evaluation.expected_value(p).collect()] == ["STRONG", "GOOD", "MODERATE", "AVOID", "AVOID"]
    plan = spark.createDataFrame([(9.99, 8.0, 1e9), (9.99, 8.0, 2000.0), (9.99, 8.0, 0.0), (9.99, 11.0, 1e9), (99.99, 99.0, 1e9)], "upper double, lower double, money double")
    rows = evaluation.sized(plan).collect()
    assert [r.shares for r in rows] == [125, 20, 125, 0, 250]
    assert rows[0].limit == pytest.approx(11.0) and rows[0].sell_2 == pytest.approx(20.0) and (rows[0].tranche_1, rows[0].tranche_2, rows[0].tranche_3) == (62, 31, 32)
    assert evaluation.sized(plan, capital=100.0).first().shares == 10


def test_market_scores(spark):
    rising = regimes.regime_score(bars(spark, [100 * 1.002**i for i in range(260)])).orderBy("rn").collect()
    assert rising[218].regime == "UNKNOWN" and rising[259].score == pytest.approx(1.0) and (rising[259].regime, rising[259].confidence) == ("BULL", 1.0)
    falling = regimes.regime_score(bars(spark, [100 * 0.98**i for i in range(260)])).where("rn = 260").first()
    assert falling.score == pytest.approx(-0.6) and falling.regime == "BEAR" and falling.confidence == pytest.approx(0.3 / 0.7 + 0.5)  # steady, so .2 speaks against
    flat = regimes.regime_score(bars(spark, [100.0] * 260)).where("rn = 260").first()
    assert (flat.score, flat.regime) == (0.2, "SIDEWAYS") and flat.confidence == pytest.approx(1 / 3)
    levels = spark.createDataFrame([(x,) for x in (10.0, 15.0, 20.0, 25.0, 30.0, 35.0, None)], "v double")
    got = [(*r[0], r[1]) for r in levels.select(regimes.volatility_level(F.col("v")), regimes.barrier_regime(F.col("v"))).collect()]
    assert got == [("BULL", 0.9, "bullish"), ("BULL", 0.7, "neutral"), ("SIDEWAYS", 0.6, "bearish"), ("BEAR", 0.7, "high_volatility"), ("BEAR", 0.9, "high_volatility"), ("BEAR", 0.9, "crisis"), (None, None, None)]
    trend = spark.createDataFrame([(3.0, 2.0, 1.0, 10.0), (1.0, 2.0, 3.0, 10.0), (3.0, 1.0, 2.0, 30.0), (1.0, 3.0, 2.0, 40.0)], "p double, f double, s double, v double")
    assert [tuple(r) for r in trend.select(regimes.trend_regime(*map(F.col, "pfs")), regimes.trend_regime(*map(F.col, "pfsv"))).collect()] == [("bullish", "bullish"), ("bearish", "bearish"), ("neutral", "high_volatility"), ("bearish", "crisis")]


def test_markets_by_dangers(spark):
    rows = [("bull", k) for k in [0] * 3 + [1] * 5 + [2] * 2] + [("few", 2)] * 9 + [("bear", k) for k in [0] * 6 + [1] * 4] + [("none", k) for k in [0] * 3 + [1] * 8]
    got = {r.key: (r.regime, round(r.confidence, 4)) for r in regimes.danger_rate(spark.createDataFrame(rows, "key string, label int"), "key").collect()}
    assert got == {"bull": ("BULL", 1.0), "few": ("UNKNOWN", 0.0), "bear": ("BEAR", 0.8333), "none": ("SIDEWAYS", 0.5)}  # none: no targets


def test_index_features(spark):
    rows = regimes.index_features(bars(spark, [100.0] * 199 + [150.0])).orderBy("rn").collect()
    assert (rows[198].to_200, rows[198].momentum_20, rows[198].above_50) == (1.0, 0.0, 1.0)
    assert (rows[199].to_200, rows[199].momentum_20, rows[199].above_50) == (1.3, 0.15, 1.0)
    assert regimes.index_features(bars(spark, [100.0] * 180 + [98.0] + [99.0] * 19)).where("rn = 200").first().momentum_20 == pytest.approx(99 / 98 - 1)  # 19 rows back


def test_moves(spark):
    def move(*closes):
        made = [10.0, *closes] + [closes[-1]] * (99 - len(closes))
        return features.move_class(features.time_to_peak(pattern(spark, end_rn=1), bars(spark, made))).first()

    kept = move(12.0, 15.0, 14.5)
    assert (kept.move, kept.move_score, kept.peak_day, kept.timing, kept.explosive) == ("explosive_high_quality", 1.0, 2, "early", 1)
    assert kept.fwd_sustainability == pytest.approx(0.9) and kept.fwd_consistency == 1.0 and kept.fwd_fall == pytest.approx(14.5 / 15 - 1)
    assert move(12.0, 15.0, 11.0).move == "explosive_reversal" and move(15.0, 12.9).move == "mixed" and move(11.0).move == "failed"
    slow = move(*[10 + 0.06 * i for i in range(1, 81)])
    assert (slow.move, slow.grind, slow.timing, slow.fwd_recovery) == ("slow_grind", 1, "late", 0.0)
    assert move(*[10 + 0.2 * i for i in range(1, 16)]).move == "moderate_quality"
    short = features.time_to_peak(pattern(spark, end_rn=1), bars(spark, [10.0, 20.0])).first()
    assert (short.fwd_gain, short.timing) == (0, "unknown")


def test_strategies(spark):
    rows = [(0.31, 1.6, 2.1, -0.1, 0.06), (0.3, 1.5, 2.0, -0.15, 0.05), (0.2, 1.0, 1.5, -0.25, 0.02), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "rate double, sharpe double, profit_factor double, max_drawdown double, expectancy double")
    assert [r.score for r in tabulation.strategy_score(df).collect()] == [10, 5, 0, 0]


def test_anchors(spark):
    flat = [(10.5, 9.5, 10)] * 8
    p = pattern(spark, end_rn=10)
    kinds = lambda rows: selection.event_anchors(p, bars(spark, rows)).select("kind", "place", "score").first()
    assert tuple(kinds([*flat, (10.5, 9, 9.8), (10.5, 9.5, 10)])) == ("spring", 9, 3009)
    assert tuple(kinds([*flat, (10.9, 9.5, 10, 300), (10.5, 9.5, 10)])) == ("ignition", 9, 2009)  # 300 to a mean of 122.2
    assert tuple(kinds([*flat, (10.9, 9.5, 10, 180), (10.5, 9.5, 10)])) == ("compression", 6, 1006)  # 1.65, 1.8 without itself
    assert kinds([(10.5, 9.5, 10)] * 3 + [(10.5, 9, 9.8)] + [(10.5, 9.5, 10)] * 6).kind == "compression"  # too early


def test_zombies_of_each_kind(spark):
    p = pattern(spark, end_rn=10)
    reason = lambda *rows: selection.zombies(p, bars(spark, [*[(10.5, 9.5, 10)] * (10 - len(rows)), *rows]), idle_run=2).first().reason
    assert reason((10.5, 9.5, 10, 0)) == "ghosts" and reason(*[(10, 10, 10, 0)] * 3) == "idle" and reason(*[(10, 10, 10, 0)] * 2) is None
    assert selection.zombies(pattern(spark, end_rn=3), bars(spark, [10.0] * 3)).first().reason == "few_rows"
    assert selection.zombies(pattern(spark, end_rn=210), bars(spark, [10.0] * 209 + [300.0])).first().reason == "extended"


def test_filings(spark):
    rows = [
        ("8-K", "sold to St. George Investments LLC"), ("8-K", "Acme Capital LLC is our partner"), ("10-Q", "Conversion price at a discount of 40% to the\nlowest trading price"), ("8-K/A", "a variable conversion rate"),
        ("424B5", "with no floor on the price"), ("DEF 14A", "a death spiral"), ("10-K", "a shell company with no revenue"), (None, "dilutive financing"), ("S-1", None), ("S-3", "an at-the-market offering"),
    ]
    got = [(r.flags, r.passes) for r in filters.filings(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, filing_type string, text string")).orderBy("i").collect()]
    assert got == [("lender", False), ("", True), ("floorless_conversion", False), ("variable_rate", False), ("no_floor", False), ("", True), ("shell", True), ("", True), ("", True), ("", True)]
