"""Registered queries over sources, cleaning and resampling, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.operators import cleaning, resampling
from tapewright.plans import sqltext as S
from tapewright.plans.indicator_queries import bars, rounded
from tapewright.plans.sqltext import rnd
from tapewright.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
BAR_COLUMNS = ["ticker", "date", "open", "high", "low", "close", "volume"]
DAY = "CAST(date AS VARCHAR) AS date"
SQL_BAR = f"ticker, {DAY}, " + ", ".join(f"{rnd(c)} AS {c}" for c in BAR_COLUMNS[2:])


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(query(spark, sf_dir))
    SQL[name] = sql


def with_bars(body: str, more: str = "") -> str:
    return f"WITH RECURSIVE {S.PREPARED}{',' if more else ''}\n{more}\n{body}"


plain = tables.bars
add("src2_bars", lambda s, d: plain(s, d).select(BAR_COLUMNS), with_bars(f"SELECT {SQL_BAR} FROM bars"))
add(
    "src5_columns", lambda s, d: cleaning.normalised_columns(plain(s, d).withColumnsRenamed({"date": "Timestamp", "close": "Close", "volume": "Vol", "ticker": "Symbol"})).select(BAR_COLUMNS), with_bars(f"SELECT {SQL_BAR} FROM bars"),
)
add("src6_dates", lambda s, d: cleaning.between_dates(plain(s, d), "1997-01-01", "1998-06-30").select(BAR_COLUMNS), with_bars(f"SELECT {SQL_BAR} FROM bars WHERE date BETWEEN DATE '1997-01-01' AND DATE '1998-06-30'"))
add(
    "src7_latest", lambda s, d: cleaning.latest_rows(tables.ticks(s, d).withColumn("minute", F.date_trunc("hour", "ts")), ["symbol", "minute"], [F.desc("ts")]).select("symbol", "minute", "bid"),
    f"WITH {S.TICKS} SELECT symbol, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS minute, {rnd('arg_max(bid, ts)')} AS bid FROM ticks GROUP BY symbol, date_trunc('hour', ts)",
)
add("src8_least_price", lambda s, d: cleaning.above_price(plain(s, d), 1000.0).select(BAR_COLUMNS), with_bars(f"SELECT {SQL_BAR} FROM bars WHERE least(open, high, low, close) >= 1000"))
add(
    "src9_eligible", lambda s, d: cleaning.eligible(plain(s, d), 1000.0, 100, 0.05).groupBy("ticker").agg(F.count("*").alias("n")),
    with_bars("SELECT ticker, count(*) AS n FROM bars GROUP BY ticker HAVING count(*) >= 100 AND avg(close) >= 1000 AND count(*) / ((date_diff('day', min(date), max(date)) + 1) * 5.0 / 7) >= 0.05"),
)
add(
    "cln1_unit_jumps", lambda s, d: cleaning.unit_jumps(plain(s, d), 20, 500, 100.0).select("ticker", "date", "segment", "scale", "close"),
    with_bars(f"""SELECT ticker, {DAY}, segment, {rnd('scale')} AS scale, {rnd('close * scale')} AS close FROM
      (SELECT g.*, CASE WHEN off BETWEEN 50 AND 200 THEN 0.01 WHEN off BETWEEN 0.005 AND 0.02 THEN 100 ELSE 1 END AS scale FROM g JOIN o USING (ticker, segment))""",
      f"""j AS (SELECT *, close / nullif({S.lag('close')}, 0) AS move FROM bars),
g AS (SELECT *, CAST({S.sofar('sum(CASE WHEN move BETWEEN 20 AND 500 OR 1 / nullif(move, 0) BETWEEN 20 AND 500 THEN 1 ELSE 0 END)')} AS BIGINT) AS segment FROM j),
s AS (SELECT ticker, segment, quantile_cont(close, 0.5) AS median, count(*) AS n FROM g GROUP BY 1, 2),
o AS (SELECT *, median / first_value(median) OVER (PARTITION BY ticker ORDER BY n DESC, segment) AS off FROM s)"""),
)
_in, _out = f"close / nullif({S.lag('close')}, 0) - 1", f"lead(close) OVER ({S.BY_DATE}) / nullif(close, 0) - 1"
add(
    "cln2_spikes", lambda s, d: cleaning.spikes(plain(s, d)).select(*BAR_COLUMNS, "spike"),
    with_bars(f"SELECT ticker, {DAY}, " + ", ".join(f"{rnd(f'CASE WHEN spike THEN ({S.lag(c)} + lead({c}) OVER ({S.BY_DATE})) / 2 ELSE {c} END')} AS {c}" for c in ("open", "high", "low", "close")) + f", {rnd('volume')} AS volume, CAST(spike AS INTEGER) AS spike FROM x",
      f"x AS (SELECT *, coalesce(abs({_in}) > 0.5 AND abs({_out}) > 0.5 AND sign({_in}) <> sign({_out}), false) AS spike FROM bars)"),
)
add(
    "cln3_quality", lambda s, d: cleaning.quality(bars(s, d)),
    with_bars(f"SELECT ticker, count(*) AS n, {rnd('avg(CASE WHEN volume <= 0 THEN 1.0 ELSE 0 END)')} AS zero_share, {rnd('max(abs(ret))')} AS largest, CAST(avg(CASE WHEN volume <= 0 THEN 1.0 ELSE 0 END) > 0.5 OR count(*) < 100 AS INTEGER) AS exclude FROM b GROUP BY ticker"),
)
add(
    "cln4_consistency", lambda s, d: cleaning.consistency(plain(s, d).withColumn("high", F.col("high") * 0.999)),
    with_bars("SELECT ticker, count(*) FILTER (WHERE least(open, h, low, close) < 0) AS negative, count(*) FILTER (WHERE h < low) AS inverted, count(*) FILTER (WHERE open > h OR open < low) AS open_outside, count(*) FILTER (WHERE close > h OR close < low) AS close_outside FROM (SELECT *, high * 0.999 AS h FROM bars) GROUP BY ticker"),
)
add(
    "cln5_outliers", lambda s, d: cleaning.outliers(bars(s, d)).select("ticker", "date", "z", "like_split", "outlier"),
    with_bars(f"SELECT ticker, {DAY}, {rnd('z')} AS z, CAST(abs(ret) > 0.4 AS INTEGER) AS like_split, CAST(abs(z) > 2 AS INTEGER) AS outlier FROM x WHERE abs(ret) > 0.4 OR abs(z) > 2",
      f"x AS (SELECT *, {S.div('ret - (' + S.over('avg', 'ret', 20) + ')', S.over('stddev_samp', 'ret', 20))} AS z FROM b)"),
)
_gap = f"date_diff('day', {S.lag('date')}, date)"
add(
    "cln6_gaps", lambda s, d: cleaning.gaps(plain(s, d)),
    with_bars("SELECT ticker, CAST(max(gap) AS INTEGER) AS longest, count(*) FILTER (WHERE gap > 10) AS long_gaps, count(*) - count(DISTINCT date) AS repeated FROM x GROUP BY ticker", f"x AS (SELECT *, {_gap} AS gap FROM bars)"),
)
add(
    "cln7_made_up", lambda s, d: cleaning.made_up(bars(s, d)),
    with_bars("""SELECT ticker, CAST(stddev_pop(volume) = 0 AS INTEGER) AS flat_volume, CAST(stddev_pop(close) = 0 AS INTEGER) AS flat_price, CAST(bool_and(close % 1 = 0) AS INTEGER) AS whole_prices,
      CAST(bool_and(volume % 1000 = 0) AS INTEGER) AS round_volumes, CAST(corr(close, rn) > 0.999 AS INTEGER) AS linear FROM b GROUP BY ticker"""),
)
add(
    "cln8_halts", lambda s, d: cleaning.halts(plain(s, d), 1),
    with_bars("SELECT ticker, count(*) AS halts, CAST(max(gap) AS INTEGER) AS longest, CAST(sum(gap) AS BIGINT) AS days, string_agg(CAST(before AS VARCHAR), ',' ORDER BY before) AS since FROM x WHERE gap > 6 GROUP BY ticker", f"x AS (SELECT *, {_gap} AS gap, {S.lag('date')} AS before FROM bars)"),
)
add(
    "cln11_statistics", lambda s, d: cleaning.statistics(plain(s, d), ["open", "close", "volume"]),
    with_bars(f"""SELECT "column", count(v) AS n, {rnd('avg(v)')} AS mean, {rnd('stddev_samp(v)')} AS std, {rnd('min(v)')} AS least, {rnd('quantile_cont(v, 0.25)')} AS q25, {rnd('quantile_cont(v, 0.5)')} AS q50, {rnd('quantile_cont(v, 0.75)')} AS q75, {rnd('max(v)')} AS most
      FROM (SELECT 'open' AS "column", open AS v FROM bars UNION ALL SELECT 'close', close FROM bars UNION ALL SELECT 'volume', volume FROM bars) GROUP BY 1"""),
)
_five = "time_bucket(INTERVAL '5 minutes', ts)"
add(
    "bar1_tick_bars", lambda s, d: resampling.tick_bars(tables.ticks(s, d)),
    f"WITH {S.TICKS} SELECT symbol, strftime({_five}, '%Y-%m-%d %H:%M:%S') AS ts, {rnd('arg_min(bid, ticks.ts)')} AS open, {rnd('max(bid)')} AS high, {rnd('min(bid)')} AS low, {rnd('arg_max(bid, ticks.ts)')} AS close, count(*) AS volume FROM ticks GROUP BY symbol, {_five}",
)
_week = "date + CAST((4 - (isodow(date) - 1) + 7) % 7 AS INTEGER)"
add(
    "bar2_weekly", lambda s, d: resampling.weekly(plain(s, d)),
    with_bars(f"SELECT ticker, CAST(week AS VARCHAR) AS week, {rnd('arg_min(open, date)')} AS open, {rnd('max(high)')} AS high, {rnd('min(low)')} AS low, {rnd('arg_max(close, date)')} AS close, {rnd('sum(volume)')} AS volume, CAST(max(date) AS VARCHAR) AS last_day, count(*) AS days FROM (SELECT *, CAST({_week} AS DATE) AS week FROM bars) GROUP BY ticker, week"),
)
_contracts = """contracts AS (SELECT date_trunc('hour', ts) AS ts, user_id % 4 AS iid, arg_min(value, events.ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, events.ts) AS close, sum(value) AS volume FROM events GROUP BY date_trunc('hour', ts), user_id % 4)"""
_front = "front AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY volume DESC, iid) AS place, sum(volume) OVER (PARTITION BY ts) AS all_volume FROM contracts) WHERE place = 1)"
_ts = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"
add("bar5_front_month", lambda s, d: resampling.front_month(tables.contract_bars(s, d)), f"WITH {_contracts}, {_front} SELECT {_ts}, iid, " + ", ".join(f"{rnd(c)} AS {c}" for c in ("open", "high", "low", "close", "volume", "all_volume")) + " FROM front")
add(
    "bar6_roll_days", lambda s, d: resampling.roll_days(tables.contract_bars(s, d)),
    f"""WITH {_contracts}, {_front}, p AS (SELECT CAST(ts AS DATE) AS day, iid, count(*) AS n FROM front GROUP BY 1, 2),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, iid) AS place FROM p) WHERE place = 1)
SELECT CAST(day AS VARCHAR) AS day, before, iid FROM (SELECT *, lag(iid) OVER (ORDER BY day) AS before FROM m) WHERE iid <> before""",
)
add(
    "bar7_expiry_rolls", lambda s, d: resampling.expiry_rolls("1995-01-01", "2001-12-01", plain(s, d)).select("ticker", "date", "close"),
    with_bars(f"SELECT ticker, {DAY}, {rnd('close')} AS close FROM bars WHERE month(date + 1) % 3 = 0 AND isodow(date) = 4 AND day(date + 1) BETWEEN 15 AND 21"),
)
add("bar8_quantised", lambda s, d: resampling.quantised(tables.ticks(s, d), ("bid",)).groupBy("symbol", "bid").agg(F.count("*").alias("n")), f"WITH {S.TICKS} SELECT symbol, {rnd('q')} AS bid, count(*) AS n FROM (SELECT symbol, round_even(bid / 0.25, 0) * 0.25 AS q FROM ticks) GROUP BY symbol, q")
_same = "PARTITION BY iid, hour(ts) ORDER BY ts"
add(
    "bar9_hour_baseline", lambda s, d: resampling.hour_baseline(tables.contract_bars(s, d)).select("ts", "iid", "baseline"),
    f"""WITH {_contracts}, m AS (SELECT *, quantile_cont(volume, 0.5) OVER ({_same} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS m FROM contracts)
SELECT {_ts}, iid, {rnd(f'greatest(coalesce(m, first_value(m IGNORE NULLS) OVER ({_same} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1), 1)')} AS baseline FROM m""",
)
