"""Trailing operators never look ahead, exponential means are the recursion, and weeks are the hand-made one."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tapewright.functions.rolling import ewm, prepared
from tapewright.operators import cleaning, detection, filters, indicators, resampling


@pytest.fixture(scope="module")
def bars(spark):
    random.seed(1)
    rows, day = [], datetime.date(2020, 1, 6)
    for t in ("A", "B"):
        price = 100.0
        for i in range(160):
            price *= random.uniform(0.95, 1.06)
            high, low = price * random.uniform(1, 1.03), price * random.uniform(0.97, 1)
            rows.append((t, day + datetime.timedelta(days=i), price * random.uniform(0.99, 1.01), high, low, price, float(random.randint(1, 9) * 100)))
    return spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double").cache()


TRAILING = [
    indicators.moving_averages, indicators.bollinger, indicators.atr, indicators.adx, indicators.rsi, indicators.macd, indicators.cci, indicators.aroon, indicators.volatility, indicators.slopes,
    lambda b: indicators.percentile_rank(b, "close"), detection.accumulation_days,
]


@pytest.mark.parametrize("operator", TRAILING)
def test_truncation_changes_nothing(bars, operator):
    until = datetime.date(2020, 4, 20)
    whole = operator(prepared(bars)).where(F.col("date") == until)
    cut = operator(prepared(bars.where(F.col("date") <= until))).where(F.col("date") == until)
    for a, b in zip(*(df.orderBy("ticker").collect() for df in (whole, cut)), strict=True):
        assert a.asDict() == pytest.approx(b.asDict())


def test_exponential_means_over_many_blocks(spark):
    random.seed(2)
    values = [None, None] + [random.uniform(-5, 5) for _ in range(400)]
    df = spark.createDataFrame([("A", i, x) for i, x in enumerate(values)], "ticker string, date int, x double")
    got = [r.y for r in ewm(df, {"y": ("x", 0.4)}).orderBy("date").collect()]
    mean = None
    for x, y in zip(values, got, strict=True):
        mean = x if mean is None else 0.6 * mean + 0.4 * x
        assert (y is None) == (mean is None) and (y is None or y == pytest.approx(mean, rel=1e-12))


def test_week_by_hand(spark):
    day = datetime.date(2024, 1, 1)
    rows = [("A", day + datetime.timedelta(days=i), 100.0 + i, h, lo, 105.0 + i, 1000.0 * (i + 1)) for i, (h, lo) in enumerate([(110.0, 95.0), (115.0, 98.0), (120.0, 97.0), (118.0, 96.0), (112.0, 99.0)])]
    df = spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double")
    week = resampling.weekly(df).first()
    assert (week.open, week.high, week.low, week.close, week.volume, week.week) == (100.0, 120.0, 95.0, 109.0, 15000.0, datetime.date(2024, 1, 5))


def test_aliases_keep_the_first_of_equal_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "Timestamp int, date int, `Adj Close` int")
    assert cleaning.normalised_columns(df).columns == ["date", "adj_close"]


def test_overlaps_are_anchored_not_chained(spark):
    day = datetime.date(2024, 1, 1)
    rows = [(f"p{i}", "A", day + datetime.timedelta(days=20 * i), float(9 - i)) for i in range(4)]
    df = spark.createDataFrame(rows, "pattern_id string, ticker string, end_date date, box_width double")
    assert sorted(r.pattern_id for r in filters.overlapping(df, 30).collect()) == ["p1", "p3"]
