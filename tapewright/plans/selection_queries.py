"""Registered queries over further filters, joins and regimes, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.functions.rolling import deviation, mean
from tapewright.operators import filters as flt
from tapewright.operators import joins as jon
from tapewright.operators import regimes as reg
from tapewright.operators import selection as sel
from tapewright.operators import statistics as st
from tapewright.plans import sqltext as S
from tapewright.plans.bar_queries import DAY, with_bars
from tapewright.plans.evaluation_queries import WITH_LABEL, with_label
from tapewright.plans.indicator_queries import bars, rounded
from tapewright.plans.pattern_queries import CHAINED, PATTERNS, cols, patterns
from tapewright.plans.sqltext import div, over
from tapewright.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(query(spark, sf_dir))
    SQL[name] = sql


_l5 = over("min", "low", 5, back=1)
ANCHORS = f"""{PATTERNS}, ev AS (SELECT *, low < ({_l5}) AND close > ({_l5}) AS spring, coalesce(CASE WHEN ({over('avg', 'volume', 20, 5)}) > 0 THEN volume / ({over('avg', 'volume', 20, 5)}) END, 1) AS loudness FROM b),
ij AS (SELECT p.*, y.date AS b_date, y.high AS b_high, y.low AS b_low, y.volume AS b_volume, y.spring, y.loudness FROM p JOIN ev AS y ON y.ticker = p.ticker AND y.date BETWEEN p.start_date AND p.end_date),
ik AS (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY b_date) AS pl, count(*) OVER (PARTITION BY pattern_id) AS n FROM ij),
an0 AS (SELECT pattern_id, max(CASE WHEN pl > 5 AND spring THEN pl END) AS s, max(CASE WHEN pl > 5 AND b_high >= 0.98 * upper AND loudness > 1.8 THEN pl END) AS i, max(n) AS n FROM ik GROUP BY 1),
an AS (SELECT pattern_id, CASE WHEN s IS NOT NULL THEN 'spring' WHEN i IS NOT NULL THEN 'ignition' ELSE 'compression' END AS kind, coalesce(s, i, n // 2 + 1) AS place, CASE WHEN s IS NOT NULL THEN 3 WHEN i IS NOT NULL THEN 2 ELSE 1 END * 1000 + coalesce(s, i, n // 2 + 1) AS score FROM an0)"""
add("flt3_event_anchors", lambda s, d: sel.event_anchors(patterns(s, d), bars(s, d)), with_bars("SELECT pattern_id, kind, place, score FROM an", ANCHORS))
add("flt4_best_anchor", lambda s, d: sel.best_anchor(patterns(s, d), bars(s, d)).select("pattern_id", "cluster", "kind", "score"), with_bars("SELECT pattern_id, cluster, kind, score FROM (SELECT *, row_number() OVER (PARTITION BY ticker, cluster ORDER BY score DESC, pattern_id) AS rk FROM c JOIN an USING (pattern_id)) WHERE rk = 1", f"{ANCHORS}, {CHAINED}"))
add("flt5_physics", lambda s, d: sel.physics(patterns(s, d), 5.0, 20.0, 50_000.0, F.col("mean_volume") / F.col("end_rn"), 0.02).select("pattern_id", "box_width"), with_bars(f"SELECT pattern_id, {cols('box_width=box_width')} FROM p WHERE box_width BETWEEN 5 AND 20 AND money >= 50000 AND coalesce(mean_volume / end_rn >= 0.02, true)", PATTERNS))
add(
    "flt6_zombies", lambda s, d: sel.zombies(patterns(s, d), bars(s, d), extension=1.5),
    with_bars(f"""SELECT pattern_id, n AS rows, idle_run, {cols('extension=ext')}, CASE WHEN coalesce(n, 0) < 5 THEN 'few_rows' WHEN ghosts > 0 THEN 'ghosts' WHEN idle_run > 3 THEN 'idle' WHEN ext > 1.5 OR ext < 1 / 1.5 THEN 'extended' END AS reason
      FROM p LEFT JOIN (SELECT pattern_id, CAST(sum(k) AS BIGINT) AS n, max(run) AS idle_run, sum(ghosts) AS ghosts FROM (SELECT pattern_id, gr, count(*) AS k, count(*) FILTER (b_volume <= 0) AS run, count(*) FILTER (b_volume <= 0 AND b_high <> b_low) AS ghosts
        FROM (SELECT *, sum(CASE WHEN b_volume <= 0 THEN 0 ELSE 1 END) OVER (PARTITION BY pattern_id ORDER BY b_date ROWS UNBOUNDED PRECEDING) AS gr FROM (SELECT p.*, y.date AS b_date, y.high AS b_high, y.low AS b_low, y.volume AS b_volume FROM p JOIN b AS y ON y.ticker = p.ticker AND y.date BETWEEN p.start_date AND p.end_date)) GROUP BY 1, 2) GROUP BY 1) USING (pattern_id)
      LEFT JOIN (SELECT ticker, rn AS end_rn, {div('close', over('avg', 'close', 200))} AS ext FROM b) USING (ticker, end_rn)""", PATTERNS),
)
add(
    "flt9_cross_ticker", lambda s, d: flt.cross_ticker(patterns(s, d).withColumn("end_date", F.trunc("end_date", "month")), 3.0).select("pattern_id", "ticker"),
    with_bars("SELECT pattern_id, ticker FROM (SELECT *, row_number() OVER (PARTITION BY date_trunc('month', end_date), round_even(ln(upper) / ln(4.0), 0), round_even(ln(lower) / ln(4.0), 0) ORDER BY money DESC, ticker, pattern_id) AS pl FROM p) WHERE pl = 1", PATTERNS),
)
_month = lambda p: p.withColumn("month", F.trunc("end_date", "month"))
add("flt12_last_view", lambda s, d: sel.last_view(patterns(s, d).withColumn("year", F.year("end_date")), F.concat_ws("-", "ticker", "year"), "end_date").select("pattern_id", "ticker", "year"), with_bars("SELECT pattern_id, ticker, year FROM (SELECT *, CAST(year(end_date) AS INTEGER) AS year, row_number() OVER (PARTITION BY ticker, year(end_date) ORDER BY end_date DESC, pattern_id) AS pl FROM p) WHERE pl = 1", PATTERNS))
add(
    "flt13_priority", lambda s, d: sel.priority(patterns(s, d), 1 / (1 + F.col("box_width")), F.when(F.col("end_rn") % 20 == 0, F.col("end_rn") / 2000), F.col("money") / 1e6).select("pattern_id", "priority"),
    with_bars(f"SELECT pattern_id, {cols('priority=CASE WHEN end_rn % 20 = 0 THEN 0.5 / (1 + box_width) + 0.35 * end_rn / 2000.0 + 0.15 * money / 1e6 ELSE (0.5 / (1 + box_width) + 0.15 * money / 1e6) / 0.65 END')} FROM p", PATTERNS),
)


def _delisted(s: SparkSession, d: str) -> DataFrame:
    return tables.table(s, d, "part").where("p_size % 10 = 0").groupBy(F.col("p_brand").alias("ticker")).agg(F.date_add(F.lit("1996-01-01").cast("date"), F.max("p_size").cast("int") * 20).alias("delisting_date"))


add(
    "flt15_survivorship", lambda s, d: sel.survivorship(patterns(s, d), bars(s, d), _delisted(s, d)).select("pattern_id", "near_delisting", "young", "incomplete", "clean"),
    with_bars("SELECT pattern_id, CAST(nd AS INTEGER) AS near_delisting, CAST(yo AS INTEGER) AS young, CAST(ic AS INTEGER) AS incomplete, CAST(NOT (nd OR yo OR ic) AS INTEGER) AS clean FROM (SELECT pattern_id, coalesce(date_diff('day', end_date, dd) BETWEEN 0 AND 180, false) AS nd, date_diff('day', fd, end_date) < 365 AS yo, date_diff('day', end_date, ld) < 100 AS ic FROM p JOIN (SELECT ticker, min(date) AS fd, max(date) AS ld FROM b GROUP BY 1) USING (ticker) LEFT JOIN (SELECT p_brand AS ticker, CAST(DATE '1996-01-01' + CAST(max(p_size) * 20 AS INTEGER) AS DATE) AS dd FROM part WHERE p_size % 10 = 0 GROUP BY 1) USING (ticker))", PATTERNS),
)
_rsi = f"100 - 100 / (1 + ({over('avg', 'g', 14)}) / (({over('avg', 'lo', 14)}) + 1e-10))"
add(
    "flt16_signals", lambda s, d: sel.signals(bars(s, d)).select("ticker", "date", "volume_ratio", "roc_10", "place"),
    with_bars(f"SELECT ticker, {DAY}, {cols('volume_ratio=vr;roc_10=rc;place=pl')} FROM (SELECT *, {_rsi} AS rs, {div('volume', over('avg', 'volume', 20, back=1))} AS vr, {div('close', S.lag('close', 10))} - 1 AS rc, {div('close - (' + over('min', 'low', 20) + ')', f'(({over("max", "high", 20)}) - ({over("min", "low", 20)}))')} AS pl FROM xg) WHERE vr > 1.5 AND rc > 0 AND rs < 70 AND pl > 0.5",
              "xg AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(close - pc, 0) END AS g, CASE WHEN pc IS NOT NULL THEN greatest(pc - close, 0) END AS lo FROM b)"),
)
add("flt17_stale", lambda s, d: sel.stale(bars(s, d).select("ticker").distinct(), patterns(s, d), "end_date", "2001-11-04", 30).select("ticker"), with_bars("SELECT DISTINCT ticker FROM b WHERE ticker NOT IN (SELECT ticker FROM p WHERE date_diff('day', end_date, DATE '2001-11-04') <= 30)", PATTERNS))
add("flt18_sampled", lambda s, d: sel.sampled(patterns(s, d), "pattern_id").select("pattern_id"), with_bars("SELECT pattern_id FROM p WHERE CAST('0x' || substr(md5(pattern_id), 1, 8) AS BIGINT) % 100 < 20", PATTERNS))
add(
    "flt11_all_deduplicated", lambda s, d: flt.overlapping(flt.cross_ticker(patterns(s, d), 3.0), 30).select("pattern_id", "ticker", "anchor"),
    with_bars("SELECT pattern_id, ticker, CAST(anchor AS VARCHAR) AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY ticker, anchor ORDER BY box_width, end_date, pattern_id) AS pl FROM q2) WHERE pl = 1",
              f"""{PATTERNS}, p2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY end_date, round_even(ln(upper) / ln(4.0), 0), round_even(ln(lower) / ln(4.0), 0) ORDER BY money DESC, ticker, pattern_id) AS pl0 FROM p) WHERE pl0 = 1),
a2 AS (SELECT ticker, min(end_date) AS anchor FROM p2 GROUP BY ticker UNION ALL SELECT a2.ticker, (SELECT min(end_date) FROM p2 WHERE p2.ticker = a2.ticker AND date_diff('day', a2.anchor, p2.end_date) > 30) FROM a2 WHERE EXISTS (SELECT 1 FROM p2 WHERE p2.ticker = a2.ticker AND date_diff('day', a2.anchor, p2.end_date) > 30)),
q2 AS (SELECT p2.*, (SELECT max(anchor) FROM a2 WHERE a2.ticker = p2.ticker AND a2.anchor <= p2.end_date) AS anchor FROM p2)"""),
)

# joins
add("jon5_tradeable", lambda s, d: patterns(s, d).join(with_label(s, d).where("label <> 5").select("pattern_id", "label"), "pattern_id").select("pattern_id", "label"), with_bars("SELECT pattern_id, label FROM wl WHERE label <> 5", WITH_LABEL))
add(
    "jon7_needs_prediction", lambda s, d: jon.needing(tables.table(s, d, "customer").select(F.col("c_custkey").alias("key")), tables.table(s, d, "orders").select(F.col("o_custkey").alias("key"), F.to_date("o_orderdate").alias("made"))).select("key", "made"),
    "SELECT c_custkey AS key, CAST(m AS VARCHAR) AS made FROM customer LEFT JOIN (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE m IS NULL OR m <> (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)",
)
_shares = lambda s, d: tables.table(s, d, "part").groupBy(F.col("p_brand").alias("ticker")).agg(F.sum("p_size").cast("double").alias("shares"))
add("jon8_market_cap", lambda s, d: jon.market_cap(bars(s, d), _shares(s, d)).select("ticker", "date", "market_cap", "tier"), with_bars(f"SELECT ticker, {DAY}, {cols('market_cap=close * sh')}, CASE WHEN close * sh < 1e6 THEN 'nano' WHEN close * sh < 3e6 THEN 'micro' WHEN close * sh < 6e6 THEN 'small' ELSE 'large' END AS tier FROM b JOIN (SELECT p_brand AS ticker, CAST(sum(p_size) AS DOUBLE) AS sh FROM part GROUP BY 1) USING (ticker)"))
add(
    "jon9_dilution", lambda s, d: jon.dilution(patterns(s, d).select("ticker", F.col("end_date").alias("date"), F.col("money").alias("shares"))),
    with_bars(f"SELECT ticker, CAST(ld AS VARCHAR) AS date, {cols('dilution=ls / nullif(coalesce(a, z), 0) - 1')} FROM (SELECT ticker, ld, any_value(ls) AS ls, arg_max(money, end_date) FILTER (date_diff('day', end_date, ld) BETWEEN 300 AND 420) AS a, arg_min(money, abs(date_diff('day', end_date, ld) - 365) * 10 + CAST(date_diff('day', end_date, ld) > 365 AS INTEGER)) FILTER (date_diff('day', end_date, ld) BETWEEN 180 AND 540) AS z FROM p JOIN (SELECT ticker, max(end_date) AS ld, arg_max(money, end_date) AS ls FROM p GROUP BY 1) USING (ticker) GROUP BY 1, 2)", PATTERNS),
)

# regimes
PHASES = f"x AS (SELECT *, {over('avg', 'close', 20)} AS f, {over('avg', 'close', 60)} AS s FROM b), y AS (SELECT *, CASE WHEN s IS NOT NULL THEN CAST(f > s AS INTEGER) END AS phase FROM x), z AS (SELECT *, {S.lag('phase')} AS lp FROM y)"
add("reg3_plain_cross", lambda s, d: reg.plain_cross(bars(s, d)).select("ticker", "date", "phase", "crossed"), with_bars(f"SELECT ticker, {DAY}, phase, CAST(last_value(CASE WHEN coalesce(phase <> lp, false) THEN date END IGNORE NULLS) OVER ({S.BY_DATE} ROWS UNBOUNDED PRECEDING) AS VARCHAR) AS crossed FROM z", PHASES))
TRANSITIONS = f"{PHASES}, t0 AS (SELECT ticker, date, phase FROM z WHERE phase IS NOT NULL AND coalesce(phase <> lp, true)), tr AS (SELECT ticker, date, phase, lag(phase) OVER w AS before, date_diff('day', date, lead(date) OVER w) AS days FROM t0 WINDOW w AS ({S.BY_DATE}))"
add("reg2_transitions", lambda s, d: reg.transitions(reg.plain_cross(bars(s, d))), with_bars("SELECT ticker, CAST(date AS VARCHAR) AS since, phase, before, CAST(days AS INTEGER) AS days FROM tr", TRANSITIONS))
add("reg2_phase_statistics", lambda s, d: reg.phase_statistics(reg.transitions(reg.plain_cross(bars(s, d)))), with_bars(f"SELECT phase, count(*) AS n, {cols('mean_days=avg(days)')}, CAST(max(days) AS INTEGER) AS longest FROM tr GROUP BY 1", TRANSITIONS))
_to, _sl = "(close / m2 - 1) * 100", "(m2 / was - 1) * 100 * (252.0 / 20)"
_score = f"CASE WHEN {_to} > 5 THEN 0.3 WHEN {_to} < -5 THEN -0.3 ELSE 0 END + CASE WHEN close > m1 AND m1 > m2 THEN 0.25 WHEN close < m1 AND m1 < m2 THEN -0.25 ELSE 0 END + CASE WHEN {_sl} > 10 THEN 0.25 WHEN {_sl} > 0 THEN 0.125 WHEN {_sl} < -10 THEN -0.25 WHEN {_sl} < 0 THEN -0.125 ELSE 0 END + CASE WHEN v < 15 THEN 0.2 WHEN v > 25 THEN -0.2 ELSE 0 END"
_means = f"r0 AS (SELECT *, {over('avg', 'close', 50)} AS m1, {over('avg', 'close', 200)} AS m2, ({over('stddev_samp', 'ret', 20)}) * sqrt(252) * 100 AS v FROM b), r1 AS (SELECT *, {S.lag('m2', 19)} AS was FROM r0)"
add(
    "reg6_score", lambda s, d: reg.regime_score(bars(s, d)).select("ticker", "date", "score", "regime", "confidence"),
    with_bars(f"SELECT ticker, {DAY}, {cols('score=s;confidence=CASE WHEN abs(s) > 0.3 THEN least(1, (abs(s) - 0.3) / 0.7 + 0.5) WHEN s IS NOT NULL THEN 1 - abs(s) / 0.3 ELSE 0 END')}, CASE WHEN s > 0.3 THEN 'BULL' WHEN s < -0.3 THEN 'BEAR' WHEN s IS NOT NULL THEN 'SIDEWAYS' ELSE 'UNKNOWN' END AS regime FROM (SELECT *, CASE WHEN rn >= 220 THEN round(CAST({_score} AS DOUBLE), 6) END AS s FROM r1)", _means),
)


def _volatility_regimes(s: SparkSession, d: str) -> DataFrame:
    """A ticker's realised volatility, a year and in percent, as its volatility index."""
    df = bars(s, d).withColumns({"v": deviation("ret", 20) * (252**0.5 * 100), "m1": mean("close", 50), "m2": mean("close", 200)})
    v, level = F.col("v"), reg.volatility_level(F.col("v"))
    return df.select("ticker", "date", "v", level["regime"].alias("regime"), level["confidence"].alias("confidence"), reg.barrier_regime(v).alias("barriers"), reg.trend_regime(F.col("close"), F.col("m1"), F.col("m2")).alias("trend"), reg.trend_regime(F.col("close"), F.col("m1"), F.col("m2"), v).alias("trend_of_calm"))


_trend = "WHEN close > m1 AND m1 > m2 THEN 'bullish' WHEN close < m1 AND m1 < m2 THEN 'bearish' WHEN close > m2 THEN 'neutral' WHEN m2 IS NOT NULL THEN 'bearish' END"
add(
    "reg7_volatility_level", _volatility_regimes,
    with_bars(f"SELECT ticker, {DAY}, {cols('v=v;confidence=CASE WHEN v < 15 THEN 0.9 WHEN v < 20 THEN 0.7 WHEN v < 25 THEN 0.6 WHEN v < 30 THEN 0.7 WHEN v IS NOT NULL THEN 0.9 END')}, CASE WHEN v < 20 THEN 'BULL' WHEN v < 25 THEN 'SIDEWAYS' WHEN v IS NOT NULL THEN 'BEAR' END AS regime, CASE WHEN v >= 35 THEN 'crisis' WHEN v >= 25 THEN 'high_volatility' WHEN v >= 18 THEN 'bearish' WHEN v >= 12 THEN 'neutral' WHEN v IS NOT NULL THEN 'bullish' END AS barriers, CASE {_trend} AS trend, CASE WHEN v >= 35 THEN 'crisis' WHEN v >= 25 THEN 'high_volatility' {_trend} AS trend_of_calm FROM r1", _means),
)
_three = lambda df: df.withColumn("cls", F.when(F.col("label") == 5, 0).when(F.col("label").isin(3, 4), 2).otherwise(1))
add(
    "reg8_danger_rate", lambda s, d: reg.danger_rate(_three(with_label(s, d)), "ticker", label="cls"),
    with_bars(f"SELECT ticker, n, {cols('danger=dg;target=tg;confidence=CASE regime WHEN \'UNKNOWN\' THEN 0 WHEN \'BULL\' THEN least(1, (0.4 - dg) / 0.15 + 0.5) WHEN \'BEAR\' THEN least(1, (dg - 0.55) / 0.15 + 0.5) ELSE 0.5 END')}, regime FROM (SELECT *, CASE WHEN n < 10 THEN 'UNKNOWN' WHEN dg < 0.4 AND tg > 0.12 THEN 'BULL' WHEN dg > 0.55 THEN 'BEAR' ELSE 'SIDEWAYS' END AS regime FROM (SELECT ticker, count(*) AS n, avg(CAST(label = 5 AS INTEGER)) AS dg, avg(CAST(label IN (3, 4) AS INTEGER)) AS tg FROM wl GROUP BY 1))", WITH_LABEL),
)
KNOWN = f"""{WITH_LABEL}, kn0 AS (SELECT *, end_date + 61 AS known, CASE WHEN label = 5 THEN 0 WHEN label IN (3, 4) THEN 2 ELSE 1 END AS cls FROM wl),
kn AS (SELECT *, md5(pattern_id) AS mk FROM kn0)"""
_told = "CASE WHEN n < 10 THEN 'UNKNOWN' WHEN danger < 0.4 AND target > 0.12 THEN 'BULL' WHEN danger > 0.55 THEN 'BEAR' ELSE 'SIDEWAYS' END AS regime"
_sure = "CASE WHEN n < 10 THEN 'NONE' WHEN danger < 0.3 AND target > 0.15 THEN 'HIGH' WHEN danger > 0.6 AND NOT (danger < 0.4 AND target > 0.12) THEN 'HIGH' ELSE 'MEDIUM' END AS confidence"
_lasts = "SELECT {k}day, count(mk) AS n, avg(CAST(cls = 0 AS INTEGER)) AS danger, avg(CAST(cls = 2 AS INTEGER)) AS target FROM (SELECT {a}dy.day, mk, cls, row_number() OVER (PARTITION BY {a}dy.day ORDER BY kn.known DESC, mk DESC) AS rk FROM {days} AS dy LEFT JOIN kn ON {on}kn.known <= dy.day) WHERE rk <= {most} GROUP BY ALL"
_weeks = "(SELECT CAST(DATE '1996-01-01' + CAST(k * 7 AS INTEGER) AS DATE) AS day FROM range(0, 209) AS r(k))"
add(
    "reg9_lagged_history", lambda s, d: reg.lagged_history(_three(with_label(s, d)), "1996-01-01", "1999-12-31", label="cls"),
    with_bars(f"SELECT CAST(day AS VARCHAR) AS day, n, {cols('danger=danger;target=target')}, {_told}, {_sure} FROM ({_lasts.format(k='', a='', on='', days=_weeks, most=100)})", KNOWN),
)
add(
    "reg12_regime_alerts", lambda s, d: reg.regime_alerts(_three(with_label(s, d)), "ticker", most=20, label="cls"),
    with_bars(f"SELECT ticker, CAST(day AS VARCHAR) AS day, before, regime, n, {cols('danger=danger;target=target')}, CASE WHEN regime = 'BULL' AND before IN ('BEAR', 'SIDEWAYS') THEN 'OPEN' WHEN before = 'BULL' AND regime IN ('BEAR', 'SIDEWAYS') THEN 'CLOSED' END AS trading FROM (SELECT *, lag(regime) OVER (PARTITION BY ticker ORDER BY day) AS before FROM (SELECT *, {_told} FROM ({_lasts.format(k='ticker, ', a='dy.ticker, ', on='kn.ticker = dy.ticker AND ', days='(SELECT DISTINCT ticker, known AS day FROM kn)', most=20)}))) WHERE before <> regime", KNOWN),
)
_ix = {"to_200": S.clip(div("close", over("avg", "close", 200)), 0.8, 1.3), "momentum_20": S.clip(div("close", S.lag("close", 19)) + " - 1", -0.15, 0.15), "above_50": f"CAST(close > ({over('avg', 'close', 50)}) AS INTEGER)"}
add("reg10_index_features", lambda s, d: reg.index_features(bars(s, d)).select("ticker", "date", *_ix), with_bars(f"SELECT ticker, {DAY}, {cols(';'.join(f'{k}=CASE WHEN rn >= 200 THEN coalesce({x}, {n}) ELSE {n} END' for (k, x), n in zip(_ix.items(), (1, 0, 1), strict=True)))} FROM b"))
_years = " ".join(f"WHEN {y} THEN '{n}'" for y, n in reg.YEAR_REGIMES.items())
add("reg11_year_regime", lambda s, d: patterns(s, d).select("pattern_id", reg.year_regime(F.col("end_date")).alias("regime")), with_bars(f"SELECT pattern_id, CASE year(end_date) {_years} ELSE 'unknown' END AS regime FROM p", PATTERNS))
