"""Hand-made series, truncation, files and streams of the market side."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapewright.functions.rolling import prepared
from tapewright.operators import criteria, evaluation, features, filters, labels, outcomes, selection, splits
from tapewright.sources import files
from tapewright.streaming import bars as stream_bars

DAY = dt.date(2020, 1, 1)
SCHEMA = "ticker string, date date, open double, high double, low double, close double, volume double"


def series(closes, ticker="A", spread=0.5, volume=100.0):
    closes = [float(c) for c in closes]
    return [(ticker, DAY + dt.timedelta(days=i), c, c + spread, c - spread, c, volume) for i, c in enumerate(closes)]


def noisy(n=160, ticker="A"):
    return series([100 + 7 * ((i * 37) % 11) - (i % 5) for i in range(n)], ticker, 1.5)


@pytest.mark.parametrize("name", ["candles", "intrabar", "pressure", "efficiency", "volume_build_up", "against_baseline", "boundary_slopes", "log_differences", "hurst", "ignition", "quartile_profile", "regime_shifts"])
def test_features_look_back_only(spark, name):
    rows = noisy()
    function = getattr(features, name)
    whole = function(prepared(spark.createDataFrame(rows, SCHEMA))).where("rn <= 120").orderBy("rn").collect()
    cut = function(prepared(spark.createDataFrame(rows[:120], SCHEMA))).orderBy("rn").collect()
    assert [r.asDict() for r in whole] == [pytest.approx(r.asDict(), nan_ok=True) for r in cut]


def test_the_machine_follows_a_hand_made_series(spark):
    # row 1 meets, rows 2-4 qualify, row 6 leaves upwards; row 8 meets, row 9 fails; row 10 on qualifies and falls out
    meets = [True, True, True, True, False, False, False, True, False, True, True, True, True, True, True]
    closes = [10, 10, 10, 10, 10.2, 12, 12, 12, 12, 12, 12, 12, 12, 11.8, 5]
    df = prepared(spark.createDataFrame(series(closes), SCHEMA)).withColumn("meets", F.element_at(F.array(*map(F.lit, meets)), F.col("rn")))
    found = [tuple(r) for r in criteria.consolidations(df, F.col("meets"), qualifying=3, timeout=50).orderBy("start_rn").collect()]
    assert found == [("A", 1, 4, 6, 10.5, 9.5, 5, "UP"), ("A", 10, 13, 15, 12.5, 11.5, 5, "DOWN")]
    slow = criteria.consolidations(df.withColumn("close", F.lit(10.0)).withColumn("high", F.lit(10.5)).withColumn("low", F.lit(9.5)).withColumn("meets", F.lit(True)), F.col("meets"), qualifying=3, timeout=5)
    assert [(r.start_rn, r.end_rn, r.exit) for r in slow.orderBy("start_rn").collect()] == [(1, 7, "TIMEOUT"), (8, 14, "TIMEOUT")]


def pattern(spark, end_rn=3, upper=11.0, lower=9.0, close=10.0):
    return spark.createDataFrame([("A-3", "A", DAY, DAY + dt.timedelta(days=end_rn - 1), end_rn, upper, lower, (upper - lower) / lower, close, 100.0, 1000.0)], "pattern_id string, ticker string, start_date date, end_date date, end_rn int, upper double, lower double, box_width double, close double, mean_volume double, money double")


def test_labels_on_hand_made_paths(spark):
    rise = prepared(spark.createDataFrame(series([10, 10, 10, 10.2, 11.5, 12, 16, 20, 20]), SCHEMA))
    fall = prepared(spark.createDataFrame(series([10, 10, 10, 10.2, 8, 7, 6, 5, 5]), SCHEMA))
    p = pattern(spark)
    assert outcomes.breakouts(p, rise).first().direction == 1 and outcomes.breakouts(p, fall).first().direction == -1
    assert outcomes.breakouts(p, rise).first().break_day == 2 and outcomes.breakouts(p, rise).first().confirmed
    assert outcomes.graceful_breach(p, fall, drop=0.1).first().label == 5 and outcomes.graceful_breach(p, rise).first().label == 3  # 35 % come before 75 %
    assert labels.structural(p, fall).first().label == 0 and labels.structural(p, rise, times=2.0).first().label == 2
    assert outcomes.volume_confirmed(p, rise).first().confirmed is False
    assert outcomes.re_entries(p, spark.createDataFrame(prepared(spark.createDataFrame(series([10, 10, 10, 12, 12, 10, 10, 12, 10]), SCHEMA)).collect(), rise.schema)).first().re_entries == 2
    exits = evaluation.signal_exits(p, fall, stop=0.2).first()
    assert (exits.reason, exits.fwd_pnl) == ("stop", -0.2)


def test_clusters_stay_together_and_folds_are_purged(spark):
    rows = [(f"{c}-{v}", c, DAY + dt.timedelta(days=30 * c + v)) for c in range(10) for v in range(3)]
    df = spark.createDataFrame(rows, "pattern_id string, cluster int, start_date date")
    split = splits.by_clusters(df, ["cluster"], "start_date", str(DAY + dt.timedelta(days=121)), str(DAY + dt.timedelta(days=200)))
    assert splits.spanning_clusters(split, ["cluster"]).count() == 0
    assert splits.spanning_clusters(splits.by_cutoffs(df, "start_date", str(DAY + dt.timedelta(days=121)), "2021-01-01"), ["cluster"]).count() == 1
    folds = splits.purged_folds(df.withColumn("k", F.lit(1)), "k", ["start_date"], 5, 2).where("fold = 1").orderBy("start_date").collect()
    assert [r.role for r in folds] == ["train"] * 4 + ["purged"] * 2 + ["test"] * 6 + ["purged"] * 2 + ["train"] * 16
    strict = splits.strict(df, "start_date", 0.5, 0.3, 10)
    ends = {r.split: (r.a, r.b) for r in strict.groupBy("split").agg(F.min("start_date").alias("a"), F.max("start_date").alias("b")).collect()}
    assert (ends["val"][0] - ends["train"][1]).days > 10 and (ends["test"][0] - ends["val"][1]).days > 10


def test_filings_and_cross_ticker(spark):
    docs = spark.createDataFrame([(1, "8-K", "toxic convertible notes"), (2, "DEF 14A", "toxic convertible notes"), (3, "10-K", "sold to Auctus Fund LLC"), (4, "8-K", "a shell company"), (5, None, None)], "doc_id int, filing_type string, text string")
    assert {r.doc_id: r.passes for r in filters.filings(docs).collect()} == {1: False, 2: True, 3: False, 4: True, 5: True}
    p = pattern(spark)
    twin = p.withColumns({"ticker": F.lit("B"), "pattern_id": F.lit("B-3"), "upper": F.col("upper") * 1.0001, "money": F.lit(5000.0)})
    far = p.withColumns({"ticker": F.lit("C"), "pattern_id": F.lit("C-3"), "upper": F.col("upper") * 1.5})
    assert sorted(r.pattern_id for r in filters.cross_ticker(p.unionByName(twin).unionByName(far)).collect()) == ["B-3", "C-3"]
    assert selection.sampled(p, "pattern_id", 100).count() == 1


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame(noisy(40) + noisy(30, "B"), SCHEMA)
    (tmp_path / "csv").mkdir()
    for ticker in "AB":
        rows = df.where(F.col("ticker") == ticker).orderBy("date").collect()
        text = "open,high,low,close,volume,date\n" + "\n".join(f"{r.open},{r.high},{r.low},{r.close},{r.volume},{r.date}" for r in rows)
        (tmp_path / "csv" / f"{ticker}.csv").write_text(text)
    back = files.read_ticker_csv(spark, str(tmp_path / "csv"), "open double, high double, low double, close double, volume double, date date")
    assert sorted(map(tuple, back.select(df.columns).collect())) == sorted(map(tuple, df.collect()))
    files.write(df, str(tmp_path / "by"), by=["ticker"], compression="zstd")
    pruned = files.read_parquet(spark, str(tmp_path / "by"), ["date", "close"], F.col("ticker") == "B")
    assert pruned.count() == 30 and "PartitionFilters: [isnotnull(ticker" in pruned._jdf.queryExecution().toString()
    for kind in ("json", "csv"):
        files.convert(spark, str(tmp_path / "by"), "parquet", str(tmp_path / f"as-{kind}"), kind)
        got = files.read_patterns(spark, str(tmp_path / f"as-{kind}"), kind, {"ticker": ["A", "X"]}, schema="date date, open double, high double, low double, close double, volume double, ticker string")
        assert got.count() == 40
    files.compact(spark, str(tmp_path / "by"), str(tmp_path / "one"), 1)
    assert len(list((tmp_path / "one").glob("part-*"))) == 1
    assert files.query(spark, str(tmp_path / "one"), "close > 150", str(tmp_path / "q")).count() == spark.read.parquet(str(tmp_path / "q")).count()
    both = files.merge([df.select("ticker", "close"), df.select("ticker", "open")])
    assert both.count() == 140 and both.where("close IS NULL").count() == 70


def test_stream_gives_the_batchs_bars(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(seconds=97 * i), "EUR" if i % 3 else "USD", 1.0 + (i * 7 % 13)) for i in range(400)]
    df = spark.createDataFrame(rows, "ts timestamp, symbol string, bid double")
    df.where("ts < '2024-01-01 06:00:00'").write.parquet(str(tmp_path / "in"))
    df.where("ts >= '2024-01-01 06:00:00'").write.mode("append").parquet(str(tmp_path / "in"))
    quotes = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = stream_bars.tick_bars(quotes).writeStream.format("memory").queryName("bars_out").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {tuple(r) for r in spark.table("bars_out").collect()}
    batch = {tuple(r) for r in stream_bars.tick_bars(df).collect()}
    assert got <= batch and len(got) >= len(batch) - 8  # the last windows wait for the watermark
