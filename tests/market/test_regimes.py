"""Markets by outcomes: the operator on tables against a plain fold, and the stream against the operator."""

import datetime as dt
import hashlib
import random

import pytest

from tapewright.operators import regimes
from tapewright.streaming import regimes as live

DAY = dt.date(2020, 1, 1)
SCHEMA = "pattern_id string, key string, end_date date, label int"


def outcomes(n, seed=1, keys="AB"):
    rng, rows = random.Random(seed), []
    for i in range(n):
        day = rng.randrange(120)
        bad = 0.8 if 40 < day < 80 else 0.15
        rows.append((f"p{i}", rng.choice(keys), DAY + dt.timedelta(days=day), 0 if rng.random() < bad else rng.choice([1, 2])))
    return rows + [(f"same{i}", keys[0], DAY + dt.timedelta(days=60), i % 3) for i in range(n // 3)]  # a third on one day


def status(labels):
    n = len(labels)
    danger, target = (labels.count(0) / n, labels.count(2) / n) if n else (None, None)
    return ("UNKNOWN" if n < 10 else "BULL" if danger < 0.4 and target > 0.12 else "BEAR" if danger > 0.55 else "SIDEWAYS"), n, danger, target


def ordered(rows):
    return sorted(rows, key=lambda r: (r[2], hashlib.md5(r[0].encode()).hexdigest()))


def folded(rows, most, lag):
    out = []
    for key in sorted({r[1] for r in rows}):
        own, was = ordered([r for r in rows if r[1] == key]), None
        for day in sorted({r[2] for r in own}):
            now, n, danger, target = status([r[3] for r in own if r[2] <= day][-most:])
            if was not in (None, now):
                out.append((key, day + dt.timedelta(days=lag + 1), was, now, n, round(danger, 9), round(target, 9)))
            was = now
    return out


def found(df):
    return sorted((r.key, r.day, r.before, r.regime, r.n, round(r.danger, 9), round(r.target, 9)) for r in df.collect())


def test_history_is_a_plain_count(spark):
    rows = outcomes(150, keys="A")
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.day: (r.regime, r.n, r.danger, r.target) for r in regimes.lagged_history(df, "2020-02-01", "2020-08-01", 7, 30, 40).collect()}
    assert len(got) == 27
    for day, said in got.items():
        want = status([r[3] for r in ordered(rows) if r[2] < day - dt.timedelta(days=30)][-40:])
        assert said[:2] == want[:2] and (want[1] == 0 or said[2:] == pytest.approx(want[2:]))
    assert {r[0] for r in got.values()} >= {"UNKNOWN", "BULL", "SIDEWAYS"}


def test_alerts_are_a_plain_fold(spark):
    rows = outcomes(200)
    alerts = regimes.regime_alerts(spark.createDataFrame(rows, SCHEMA), "key", lag_days=5, most=25)
    assert found(alerts) == folded(rows, 25, 5) and len(folded(rows, 25, 5)) > 5
    assert {r.trading for r in alerts.collect()} == {"OPEN", "CLOSED", None}
    assert regimes.regime_alerts(spark.createDataFrame([], SCHEMA), "key").count() == 0


def test_stream_gives_the_same_alerts_after_a_restart(spark, tmp_path):
    rows = outcomes(200)
    random.Random(2).shuffle(rows)
    rows.sort(key=lambda r: (r[2] - DAY).days // 30)  # in any order within a month
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    last = [("end", "end", DAY + dt.timedelta(days=4000), 1)]
    third = len(rows) // 3
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    for part in (rows[:third], rows[third:], last):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        alerts = live.regime_alerts(stream, "key", lag_days=5, most=25, late="40 days")
        alerts.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    got = found(spark.read.parquet(target))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == found(regimes.regime_alerts(spark.createDataFrame(rows, SCHEMA), "key", lag_days=5, most=25)) == folded(rows, 25, 5)
