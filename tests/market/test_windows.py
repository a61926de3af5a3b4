"""Windows of many lengths, stops and look-back sequences against plain loops."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tapewright.functions.rolling import prepared
from tapewright.operators import detection, indicators, sequences

DAY = dt.date(2020, 1, 1)
SCHEMA = "ticker string, date date, open double, high double, low double, close double, volume double"


def walk(n, ticker="A", seed=1, quiet=None):
    rng, close, rows = random.Random(seed), 100.0, []
    for i in range(n):
        size = 0.2 if quiet and quiet[0] <= i < quiet[1] else 2.0
        close = max(5.0, close + rng.uniform(-size, size))
        rows.append((ticker, DAY + dt.timedelta(days=i + i // 5 * 2), close, close + rng.uniform(0, size), close - rng.uniform(0, size), close, float(rng.randint(50, 150))))
    return rows


def test_windows_of_all_lengths(spark):
    rng = random.Random(5)
    rows = walk(170) + walk(130, "B", 2) + walk(50, "C", 3)
    extra = {(r[0], r[1]): (None if rng.random() < 0.05 else rng.uniform(0, 0.6), rng.uniform(0, 0.7), None if rng.random() < 0.05 else rng.uniform(0, 1.3), rng.uniform(10, 50)) for r in rows}
    df = prepared(spark.createDataFrame(rows, SCHEMA))
    more = spark.createDataFrame([(*k, *v) for k, v in extra.items()], "ticker string, date date, bbw double, volume_ratio double, range_ratio double, adx double")
    got = {(r.ticker, r.start_rn): r for r in detection.multi_duration(df.join(more, ["ticker", "date"]), 10, 40).collect()}
    want = {}
    for ticker in "ABC":
        own = [r for r in rows if r[0] == ticker]
        for i in range(60, len(own) - 30, 5):
            for d in range(10, min(40, len(own) - i - 30) + 1, 5):
                window = own[i : i + d]
                seen = [[x for x in (extra[r[0], r[1]][k] for r in window) if x is not None] for k in range(4)]
                values = [statistics.median(seen[0]), *[sum(x) / len(x) for x in seen[1:]]]
                quality = sum(v < limit for v, limit in zip(values, (0.3, 0.35, 0.65, 32.0), strict=True)) / 4
                if quality >= 0.6:
                    want[ticker, i + 1] = (d, window[-1][1], max(r[3] for r in window), min(r[4] for r in window), *values, quality)
                    break
    assert set(got) == set(want) and len(want) > 5
    for k, w in want.items():
        r = got[k]
        assert (r.duration, r.end_date) == w[:2] and (r.upper, r.lower, r.mean_bbw, r.mean_volume_ratio, r.mean_range_ratio, r.mean_adx, r.quality) == pytest.approx(w[2:])


def stops(rows, step=0.02, most=0.2):
    high, low, out = [r[3] for r in rows], [r[4] for r in rows], [None]
    if len(rows) < 2:
        return out
    falls = low[0] - low[1] > 0 and low[0] - low[1] > high[1] - high[0]
    long, sar, extreme, pace = not falls, high[0] if falls else low[0], low[1] if falls else high[1], step
    for i in range(1, len(rows)):
        a, b = max(i - 1, 1), i  # the first comparison knows one row only
        if (low[i] <= sar) if long else (high[i] >= sar):
            long = not long
            sar = min(extreme, low[a], low[b]) if long else max(extreme, high[a], high[b])
            out.append(sar)
            pace, extreme = step, high[i] if long else low[i]
        else:
            out.append(sar)
            new = high[i] > extreme if long else low[i] < extreme
            extreme, pace = (high[i] if long else low[i], min(pace + step, most)) if new else (extreme, pace)
        sar += pace * (extreme - sar)
        sar = min(sar, low[a], low[b]) if long else max(sar, high[a], high[b])
    return out


def test_stops_follow_a_plain_loop_and_look_back_only(spark):
    series = [walk(120), walk(80, "B", 2), walk(1, "C"), walk(2, "D", 7)]
    rows = [r for own in series for r in own]
    got = indicators.parabolic_stop(prepared(spark.createDataFrame(rows, SCHEMA))).orderBy("ticker", "rn").collect()
    want = [x for own in series for x in stops(own)]
    assert [r.sar for r in got] == [x if x is None else pytest.approx(x) for x in want] and {r.sar_position for r in got} == {None, 1, -1}
    cut = indicators.parabolic_stop(prepared(spark.createDataFrame(series[0][:70], SCHEMA))).orderBy("rn").collect()
    assert [r.sar for r in cut] == [r.sar for r in got[:70]]


def test_look_back_sequences(spark):
    rows = walk(90) + [("B", DAY + dt.timedelta(days=40 + 30 * i), 1.0, 2.0, 0.5, 1.0 + i, 0.0) for i in range(4)]
    shots = [("p1", "A", DAY + dt.timedelta(days=60)), ("p2", "A", DAY + dt.timedelta(days=3)), ("p3", "A", DAY + dt.timedelta(days=400)), ("p4", "B", DAY + dt.timedelta(days=110)), ("p5", "none", DAY), ("p6", "A", DAY - dt.timedelta(days=1))]
    df = prepared(spark.createDataFrame(rows, SCHEMA))
    snapshots = spark.createDataFrame(shots, "pattern_id string, ticker string, snapshot_date date")
    for days, warm_up in ((50, 20), (7, 2)):
        got = {r.pattern_id: r for r in sequences.look_back(snapshots, df, ["close", "ret"], days, warm_up).collect()}
        for name, ticker, last in shots:
            own = [r for r in rows if r[0] == ticker]
            for step in range(days):
                day = last - dt.timedelta(days=days - 1 - step)
                upto = [r for r in own if r[1] <= day]
                values = [upto[-1][5], upto[-1][5] / upto[-2][5] - 1 if len(upto) > 1 else 0.0] if upto else [0.0, 0.0]
                mask = int(len(upto) >= warm_up and sum(values) != 0)
                assert got[name]["mask"][step] == mask and got[name].steps[step] == pytest.approx(values if mask else [0.0, 0.0])
    later = df.withColumn("close", F.when(F.col("date") > DAY + dt.timedelta(days=60), 0.0).otherwise(F.col("close")))
    assert sequences.look_back(snapshots.where("pattern_id = 'p1'"), later, ["close"]).first() == sequences.look_back(snapshots.where("pattern_id = 'p1'"), df, ["close"]).first()
