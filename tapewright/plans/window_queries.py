"""Registered queries over windows of many lengths, stops and look-back sequences, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.operators import detection as det
from tapewright.operators import indicators as ind
from tapewright.operators import sequences as seq
from tapewright.plans import sqltext as S
from tapewright.plans.bar_queries import with_bars
from tapewright.plans.criteria_queries import MEASURED, measured
from tapewright.plans.indicator_queries import bars, rounded
from tapewright.plans.pattern_queries import PATTERNS, cols, patterns

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(query(spark, sf_dir))
    SQL[name] = sql


_limits = dict(bbw=2.5, volume=1.05, width=1.05, trend=20.0)
_checks = " + ".join(f"CAST(coalesce({x} < {v}, false) AS INTEGER)" for x, v in (("mb", 2.5), ("mv", 1.05), ("mr", 1.05), ("ma", 20.0)))
add(
    "det9_multi_duration", lambda s, d: det.multi_duration(measured(s, d), **_limits),
    with_bars(f"""SELECT ticker, CAST(start_date AS VARCHAR) AS start_date, start_rn, d AS duration, CAST(end_date AS VARCHAR) AS end_date, {cols('upper=u;lower=l;mean_bbw=mb;mean_volume_ratio=mv;mean_range_ratio=mr;mean_adx=ma;quality=q / 4.0;power=u * 1.005;range_pct=(u - l) / nullif(l, 0) * 100')}
      FROM (SELECT *, row_number() OVER (PARTITION BY ticker, start_rn ORDER BY d) AS place FROM (SELECT *, {_checks} AS q FROM (
        SELECT s.ticker, s.rn AS start_rn, s.date AS start_date, d, max(y.date) AS end_date, max(y.high) AS u, min(y.low) AS l, quantile_cont(y.bbw, 0.5) AS mb, avg(y.volume_ratio) AS mv, avg(y.range_ratio) AS mr, avg(y.adx) AS ma
        FROM (SELECT ticker, rn, date, count(*) OVER (PARTITION BY ticker) AS total FROM mm) AS s JOIN (SELECT unnest(range(10, 61, 5)) AS d) ON d <= total - (rn - 1) - 30 JOIN mm AS y ON y.ticker = s.ticker AND y.rn BETWEEN s.rn AND s.rn + d - 1
        WHERE s.rn > 60 AND (s.rn - 61) % 5 = 0 AND s.rn - 1 < total - 30 GROUP BY ALL)) WHERE q / 4.0 >= 0.6) WHERE place = 1""", MEASURED),
)
_up, _down = (lambda v: f"greatest({v}, e.hi, x.high)"), (lambda v: f"least({v}, e.lo, x.low)")
_faster = "least(e.af + 0.02, 0.2)"
SAR = f"""e AS (
  SELECT b2.ticker, b2.rn, NOT falls AS long, CASE WHEN falls THEN hi1 ELSE lo1 END AS sar, CASE WHEN falls THEN low ELSE high END AS ep, CAST(0.02 AS DOUBLE) AS af, high AS hi, low AS lo, CAST(NULL AS DOUBLE) AS shown
  FROM (SELECT *, lo1 - low > 0 AND lo1 - low > high - hi1 AS falls FROM (SELECT *, {S.lag('high')} AS hi1, {S.lag('low')} AS lo1 FROM b) WHERE rn = 2) AS b2
  UNION ALL
  SELECT x.ticker, x.rn, CASE WHEN turns THEN NOT e.long ELSE e.long END,
    CASE WHEN turns AND e.long THEN {_up(f"{_up('e.ep')} + 0.02 * (x.low - {_up('e.ep')})")} WHEN turns THEN {_down(f"{_down('e.ep')} + 0.02 * (x.high - {_down('e.ep')})")}
         WHEN e.long THEN {_down(f"e.sar + (CASE WHEN x.high > e.ep THEN {_faster} ELSE e.af END) * (greatest(x.high, e.ep) - e.sar)")} ELSE {_up(f"e.sar + (CASE WHEN x.low < e.ep THEN {_faster} ELSE e.af END) * (least(x.low, e.ep) - e.sar)")} END,
    CASE WHEN turns AND e.long THEN x.low WHEN turns THEN x.high WHEN e.long THEN greatest(x.high, e.ep) ELSE least(x.low, e.ep) END,
    CASE WHEN turns THEN 0.02 WHEN e.long AND x.high > e.ep OR NOT e.long AND x.low < e.ep THEN {_faster} ELSE e.af END, x.high, x.low,
    CASE WHEN turns AND e.long THEN {_up('e.ep')} WHEN turns THEN {_down('e.ep')} ELSE e.sar END
  FROM e JOIN b AS x ON x.ticker = e.ticker AND x.rn = CASE WHEN e.shown IS NULL THEN 2 ELSE e.rn + 1 END, LATERAL (SELECT CASE WHEN e.long THEN x.low <= e.sar ELSE x.high >= e.sar END AS turns))"""
add(
    "ind40_parabolic_stop", lambda s, d: ind.parabolic_stop(bars(s, d)).select("ticker", "date", "sar", "sar_position"),
    with_bars(f"SELECT b.ticker, CAST(b.date AS VARCHAR) AS date, {cols('sar=shown')}, CASE WHEN shown IS NULL THEN NULL WHEN close > shown THEN 1 ELSE -1 END AS sar_position FROM b LEFT JOIN (SELECT * FROM e WHERE shown IS NOT NULL) AS e USING (ticker, rn)", SAR),
)


def _look_back(s: SparkSession, d: str) -> DataFrame:
    df = seq.look_back(patterns(s, d).select("pattern_id", "ticker", F.date_add("end_date", 3).alias("snapshot_date")), bars(s, d), ["close", "ret", "volume"])
    each = df.select("pattern_id", "mask", F.posexplode("steps").alias("step", "v"))
    return each.select("pattern_id", "step", F.get("mask", F.col("step")).alias("mask"), *[F.get("v", F.lit(i)).alias(c) for i, c in enumerate(("close", "ret", "volume"))])


add(
    "seq5_look_back", _look_back,
    with_bars(f"""SELECT pattern_id, step, CAST(ok AS INTEGER) AS mask, {cols('close=CASE WHEN ok THEN close ELSE 0 END;ret=CASE WHEN ok THEN coalesce(ret, 0) ELSE 0 END;volume=CASE WHEN ok THEN volume ELSE 0 END')} FROM (
      SELECT sn.pattern_id, CAST(step AS INTEGER) AS step, y.*, coalesce(y.rn >= 20 AND y.close + coalesce(y.ret, 0) + y.volume <> 0, false) AS ok
      FROM (SELECT pattern_id, ticker AS tk, step, CAST(end_date + CAST(3 - 49 + step AS INTEGER) AS DATE) AS day FROM p, range(0, 50) AS r(step)) AS sn ASOF LEFT JOIN b AS y ON y.ticker = sn.tk AND y.date <= sn.day)""", PATTERNS),
)
