"""Registered queries over criteria, the state machine and derived windows, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.operators import criteria as cri
from tapewright.operators import detection as det
from tapewright.operators import resampling
from tapewright.plans import indicator_queries
from tapewright.plans import sqltext as S
from tapewright.plans.bar_queries import DAY, with_bars
from tapewright.plans.indicator_queries import bars, rounded
from tapewright.plans.pattern_queries import PATTERNS, after_sql, cols, patterns
from tapewright.plans.sqltext import div, frame, over
from tapewright.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Prices here jump from day to day, so that thresholds are wide enough for results.
LIMITS = dict(bbw=0.6, adx_=25.0, volume=1.2, span=1.2)


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(query(spark, sf_dir))
    SQL[name] = sql


def measured(s: SparkSession, d: str) -> DataFrame:
    return cri.measured(bars(s, d))


_bbw = div("4 * (" + over("stddev_samp", "close", 20) + ")", over("avg", "close", 20))
MEASURED = f"""{indicator_queries._dm},
{S.ewm('e1', 'm', {'p': ('plus_dm', 1 / 14), 'q': ('minus_dm', 1 / 14), 'a': ('tr', 1 / 14)})},
e2 AS (SELECT ticker, rn, 100 * p / (a + 1e-10) AS pd, 100 * q / (a + 1e-10) AS md FROM e1),
e3 AS (SELECT ticker, rn, 100 * abs(pd - md) / (pd + md + 1e-10) AS dx FROM e2),
{S.ewm('e4', 'e3', {'adx': ('dx', 1 / 14)})},
mm0 AS (SELECT b.*, adx, {_bbw} AS bbw, {div('volume', over('avg', 'volume', 20))} AS volume_ratio, {div('high - low', over('avg', '(high - low)', 20))} AS range_ratio FROM b JOIN e4 USING (ticker, rn)),
mm AS (SELECT *, CASE WHEN bbw IS NULL THEN NULL WHEN rn = 1 THEN 0.5 ELSE len([v FOR v IN list(bbw) FILTER (bbw IS NOT NULL) OVER {frame(-99, 0)} IF v < bbw]) / CAST(len(list(bbw) FILTER (bbw IS NOT NULL) OVER {frame(-99, 0)}) AS DOUBLE) END AS bbw_rank FROM mm0)"""
STRICT = "coalesce(bbw_rank < 0.6 AND adx < 25.0 AND volume_ratio < 1.2 AND range_ratio < 1.2, false)"
OTHERS = "CAST(coalesce(adx < 25.0, false) AS INTEGER) + CAST(coalesce(volume_ratio < 1.2, false) AS INTEGER) + CAST(coalesce(range_ratio < 1.2, false) AS INTEGER)"
RELAXED = f"(coalesce(bbw_rank < 0.6, false) AND {OTHERS} >= 2)"
add("det1_strict_criteria", lambda s, d: measured(s, d).select("ticker", "date", "bbw_rank", "adx", "volume_ratio", "range_ratio", cri.strict(**LIMITS).alias("meets")), with_bars(f"SELECT ticker, {DAY}, {cols('bbw_rank=bbw_rank;adx=adx;volume_ratio=volume_ratio;range_ratio=range_ratio')}, CAST({STRICT} AS INTEGER) AS meets FROM mm", MEASURED))
add("det2_relaxed_criteria", lambda s, d: measured(s, d).select("ticker", "date", cri.relaxed(**LIMITS).alias("meets")), with_bars(f"SELECT ticker, {DAY}, CAST({RELAXED} AS INTEGER) AS meets FROM mm", MEASURED))


def machine_sql(qualifying: int, timeout: int, up: str, down: str, least_width: float = 0.0) -> str:
    """A recursive table that goes through each ticker's rows in order."""
    grown = "list_append(s.highs, x.high)", "list_append(s.lows, x.low)"
    hi, lo = up.format(grown[0]), down.format(grown[1])
    leaves = f"CASE WHEN x.close > s.upper * 1.005 THEN 'UP' WHEN x.close < s.lower THEN 'DOWN' WHEN s.days + 1 > {timeout} THEN 'TIMEOUT' END"
    done = f"(s.phase = 1 AND x.meets AND s.days + 1 >= {qualifying})"
    begun = f"({done} AND {hi} >= {lo} * {1 + least_width})"
    return f"""ms AS (SELECT ticker, rn, high, low, close, {RELAXED} AS meets FROM mm),
st AS (
  SELECT ticker, rn, CASE WHEN meets THEN 1 ELSE 0 END AS phase, CASE WHEN meets THEN rn ELSE 0 END AS start, CAST(0 AS BIGINT) AS days, CAST([] AS DOUBLE[]) AS highs, CAST([] AS DOUBLE[]) AS lows, CAST(0 AS DOUBLE) AS upper, CAST(0 AS DOUBLE) AS lower, CAST(NULL AS VARCHAR) AS exit, CAST(0 AS DOUBLE) AS gu, CAST(0 AS DOUBLE) AS gl, CAST(0 AS BIGINT) AS gs, CAST(0 AS BIGINT) AS gd FROM ms WHERE rn = 1
  UNION ALL
  SELECT x.ticker, x.rn,
    CASE WHEN s.phase = 0 THEN CASE WHEN x.meets THEN 1 ELSE 0 END WHEN s.phase = 1 THEN CASE WHEN NOT x.meets THEN 0 WHEN {begun} THEN 2 WHEN {done} THEN 0 ELSE 1 END ELSE CASE WHEN {leaves} IS NULL THEN 2 ELSE 0 END END,
    CASE WHEN s.phase = 0 THEN x.rn ELSE s.start END, CASE WHEN s.phase = 0 THEN 0 ELSE s.days + 1 END,
    CASE WHEN s.phase = 1 THEN {grown[0]} WHEN s.phase = 0 THEN [] ELSE s.highs END, CASE WHEN s.phase = 1 THEN {grown[1]} WHEN s.phase = 0 THEN [] ELSE s.lows END,
    CASE WHEN {begun} THEN {hi} ELSE s.upper END, CASE WHEN {begun} THEN {lo} ELSE s.lower END,
    CASE WHEN s.phase = 2 THEN {leaves} END, s.upper, s.lower, s.start, s.days + 1
  FROM st AS s JOIN ms AS x ON x.ticker = s.ticker AND x.rn = s.rn + 1)"""


def machine(name: str, kwargs: dict, up: str, down: str) -> None:
    add(
        name, lambda s, d: cri.consolidations(measured(s, d), cri.relaxed(**LIMITS), **kwargs),
        with_bars(f"SELECT ticker, CAST(gs AS INTEGER) AS start_rn, CAST(gs + {kwargs['qualifying']} AS INTEGER) AS active_rn, CAST(rn AS INTEGER) AS end_rn, {cols('upper=gu;lower=gl')}, CAST(gd AS INTEGER) AS days, exit FROM st WHERE exit IS NOT NULL",
                  f"{MEASURED},\n{machine_sql(kwargs['qualifying'], kwargs['timeout'], up, down, kwargs.get('least_width', 0.0))}"),
    )


machine("det18_machine", dict(qualifying=3, timeout=12), "list_max({})", "list_min({})")
machine("det19_machine_quantiles", dict(qualifying=3, timeout=12, quantiles=(0.9, 0.1), least_width=0.003), "list_aggregate({}, 'quantile_cont', 0.9)", "list_aggregate({}, 'quantile_cont', 0.1)")
_top, _bot = (lambda n: f"max(high) OVER {S.frame(-n, 0)}"), (lambda n: f"min(low) OVER {S.frame(-n, 0)}")
_rank = lambda c: f"CASE WHEN {c} IS NOT NULL AND len({c}_w) >= 50 THEN (len([v FOR v IN {c}_w IF v < {c}]) + (len([v FOR v IN {c}_w IF v = {c}]) + 1) / 2.0) / len({c}_w) END"
_seen = lambda c: f"[v FOR v IN list({c}) OVER {S.frame(-99, 0)} IF v IS NOT NULL]"
METHOD_BOUNDS = f"""mb0 AS (SELECT *, high - {S.lag('high')} AS du, {S.lag('low')} - low AS dd, {div('4 * (' + over('stddev_samp', 'close', 20, 15) + ')', over('avg', 'close', 20, 15))} AS bw, {over('avg', 'tr', 14, 10)} AS tv, ({over('stddev_samp', 'ret', 20, 15)}) * sqrt(252) AS vo,
  {div('volume', over('avg', 'volume', 20, 15))} AS vr, {div('high - low', 'close')} AS dr FROM b),
mb1 AS (SELECT *, CASE WHEN du > dd THEN greatest(du, 0) ELSE 0 END AS up, CASE WHEN dd > du THEN greatest(dd, 0) ELSE 0 END AS dn, {div('dr', over('avg', 'dr', 20, 15))} AS rr, {_seen('bw')} AS bw_w, {_seen('tv')} AS tv_w FROM mb0),
mb2 AS (SELECT *, 100 * {div(over('avg', 'up', 14, 10), 'tv')} AS pd, 100 * {div(over('avg', 'dn', 14, 10), 'tv')} AS md, {_rank('bw')} AS br, {_rank('tv')} AS ar FROM mb1),
mb3 AS (SELECT *, CASE WHEN pd + md > 0 THEN 100 * abs(pd - md) / (pd + md) END AS dx FROM mb2),
mb4 AS (SELECT *, {over('avg', 'dx', 14, 10)} AS ax, {_top(20)} AS t20, {_bot(20)} AS b20, {_top(10)} AS t10, {_bot(10)} AS b10, {_top(15)} AS t15, {_bot(15)} AS b15 FROM mb3),
mb AS (SELECT *, coalesce(rn > 100 AND br < 0.3, false) AS m1, coalesce(rn > 20 AND rr < 0.65 AND ax < 32 AND close > 0 AND (t10 - b10) / close < 1.5, false) AS m2,
  coalesce(rn > 20 AND vr < 0.35 AND close > 0 AND (t15 - b15) / close < 2.4, false) AS m3, coalesce(rn > 100 AND ar < 0.3 AND vo < 20 AND tv > 0, false) AS m4 FROM mb4)"""
_mb = {"m1": ("t20", "b20"), "m2": ("t10", "b10"), "m3": ("t15", "b15"), "m4": ("least(close + 1.5 * tv, t20)", "greatest(close - 1.5 * tv, b20)")}
_mc = ";".join(f"{k}_upper=CASE WHEN {k} THEN {u} END;{k}_lower=CASE WHEN {k} THEN {lo} END;{k}_power=CASE WHEN {k} THEN {u} * 1.005 END" for k, (u, lo) in _mb.items())
add(
    "det4_method_bounds", lambda s, d: cri.method_bounds(bars(s, d), volatility=20.0, m2_width=1.5, m3_width=2.4).select("ticker", "date", *[f"{k}{x}" for k in _mb for x in ("", "_upper", "_lower", "_power")]),
    with_bars(f"SELECT ticker, {DAY}, {', '.join(f'CAST({k} AS INTEGER) AS {k}' for k in _mb)}, {cols(_mc)} FROM mb", METHOD_BOUNDS),
)
_q60 = lambda c, p: over(f"quantile_cont({{}}, {p})", c, 60)
CANDIDATES = f"ca0 AS (SELECT *, {_q60('high', 0.95)} AS upper, {_q60('low', 0.1)} AS lower, {_q60('close', 0.95)} AS t1, {_q60('close', 0.1)} AS t0 FROM b), ca AS (SELECT *, (upper - lower) / nullif(lower, 0) AS wick_width, (t1 - t0) / nullif(t0, 0) AS body_width FROM ca0)"
LOOSE = dict(wick=60.0, body=30.0)
add("det10_candidates", lambda s, d: cri.candidate_rows(bars(s, d), **LOOSE).select("ticker", "date", "upper", "lower", "wick_width", "body_width"), with_bars(f"SELECT ticker, {DAY}, {cols('upper=upper;lower=lower;wick_width=wick_width;body_width=body_width')} FROM ca WHERE wick_width < 60 AND body_width < 30", CANDIDATES))
add("det12_body_zscore", lambda s, d: cri.body_zscore(bars(s, d)).select("ticker", "date", "body_width", "body_z"), with_bars(f"SELECT ticker, {DAY}, {cols(f'body_width=body_width;body_z={div('body_width - (' + over('avg', 'body_width', 70, 20) + ')', over('stddev_pop', 'body_width', 70, 20))}')} FROM ca", CANDIDATES))
add(
    "det13_float_turnover", lambda s, d: cri.float_turnover(bars(s, d), tables.table(s, d, "part").groupBy(F.col("p_brand").alias("ticker")).agg(F.sum("p_size").cast("double").alias("shares"))).select("ticker", "date", "turnover", "passes"),
    with_bars(f"SELECT ticker, {DAY}, {cols('turnover=t')}, CAST(coalesce(t >= 0.5, true) AS INTEGER) AS passes FROM (SELECT *, v / nullif(shares, 0) AS t FROM (SELECT *, {over('sum', 'volume', 20)} AS v FROM b) LEFT JOIN (SELECT p_brand AS ticker, CAST(sum(p_size) AS DOUBLE) AS shares FROM part GROUP BY 1) USING (ticker))"),
)
add(
    "det15_emitted", lambda s, d: cri.emitted(cri.candidate_rows(bars(s, d), **LOOSE), bars(s, d)),
    with_bars(f"SELECT ticker || '-' || rn AS pattern_id, ticker, CAST(sd AS VARCHAR) AS start_date, CAST(date AS VARCHAR) AS end_date, {cols('upper=upper;lower=lower;entry=upper + 0.01;stop=lower * 0.98;risk=upper + 0.01 - lower * 0.98')} FROM (SELECT *, lag(date, 19) OVER ({S.BY_DATE}) AS sd, lead(rn, 101) OVER ({S.BY_DATE}) AS fl FROM ca) WHERE wick_width < 60 AND body_width < 30 AND fl IS NOT NULL AND sd IS NOT NULL", CANDIDATES),
)
add("det16_widest_tier", lambda s, d: cri.widest_tier(bars(s, d)).select("ticker", "date", "widest_tier"), with_bars(f"SELECT ticker, {DAY}, CASE WHEN rn >= 20 THEN max(CASE WHEN close * volume < 1e4 THEN 0 WHEN close * volume < 3e4 THEN 1 WHEN close * volume < 6e4 THEN 2 WHEN close * volume < 1e5 THEN 3 ELSE 4 END) OVER {frame(-19, -10)} END AS widest_tier FROM b"))
add("det20_boundary_state", lambda s, d: cri.boundary_state(patterns(s, d), bars(s, d)), with_bars(f"SELECT pattern_id, day, CASE WHEN b_close > upper THEN 'breakout' WHEN b_close < lower THEN 'breakdown' ELSE 'inside' END AS state, {cols('position=(b_close - lower) / nullif(upper - lower, 0);to_upper=(upper - b_close) / nullif(b_close, 0);to_lower=(b_close - lower) / nullif(b_close, 0)')} FROM j", f"{PATTERNS}, {after_sql(20)}"))
add(
    "det21_bonds", lambda s, d: cri.bonds(patterns(s, d), bars(s, d), milestones=(5, 10, 20), tolerance=0.5, floor_rows=4, ceiling_rows=5),
    with_bars(f"""SELECT pattern_id, days, milestone, break_day, {cols('floor=fl;ceiling=ce')}, closes_below, lows_below, CASE WHEN break_day IS NOT NULL THEN 'BROKEN' WHEN held AND days > 5 AND lc > ce * 1.5 THEN 'BREAKOUT' WHEN held AND days > 5 AND (closes_below >= 2 OR lows_below >= 5) THEN 'BREAKDOWN' ELSE 'ACTIVE' END AS status
      FROM (SELECT g.*, count(*) FILTER (day > days - 2 AND b_close < fl) AS closes_below, count(*) FILTER (day > days - 10 AND b_low < fl) AS lows_below FROM g JOIN j USING (pattern_id) GROUP BY ALL)""",
      f"""{PATTERNS}, {after_sql(21)},
d1 AS (SELECT pattern_id, count(*) AS days, CAST(CASE WHEN count(*) >= 20 THEN 20 WHEN count(*) >= 10 THEN 10 WHEN count(*) >= 5 THEN 5 ELSE 0 END AS INTEGER) AS milestone FROM j GROUP BY 1),
d2 AS (SELECT pattern_id, upper, lower, days, milestone, min(CASE WHEN (b_close > upper * 1.5 OR b_close < lower * 0.5) AND day <= 5 THEN day END) AS break_day, min(b_low) FILTER (day <= milestone AND day > milestone - 4) AS ln, max(b_high) FILTER (day <= milestone AND day > milestone - 5) AS hn, arg_max(b_close, day) AS lc FROM j JOIN d1 USING (pattern_id) GROUP BY 1, 2, 3, 4, 5),
g AS (SELECT pattern_id, days, milestone, break_day, lc, milestone > 0 AND break_day IS NULL AS held, CASE WHEN milestone > 0 AND break_day IS NULL THEN greatest(lower, ln) ELSE lower END AS fl, CASE WHEN milestone > 0 AND break_day IS NULL THEN least(upper, hn) ELSE upper END AS ce FROM d2)"""),
)
_four = f"(CAST(coalesce(bbw_rank < 0.6, false) AS INTEGER) + {OTHERS})"
add("det24_latest_checks", lambda s, d: cri.latest_checks(measured(s, d), **LIMITS), with_bars(f"SELECT ticker, {DAY}, {_four} AS checks, CAST({_four} >= 3 AS INTEGER) AS consolidates, {cols(f'strength={_four} / 4.0')} FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS last FROM mm) WHERE last = 1", MEASURED))
add("det27_kept_patterns", lambda s, d: cri.kept_patterns(patterns(s, d), 0.08, 25).select("pattern_id", "quality", "days"), with_bars(f"SELECT pattern_id, {cols('quality=1 / (1 + box_width)')}, CAST(date_diff('day', start_date, end_date) AS INTEGER) AS days FROM p WHERE 1 / (1 + box_width) >= 0.08 AND date_diff('day', start_date, end_date) >= 25", PATTERNS))
WEEKS = "wk0 AS (SELECT ticker, CAST(date + CAST((12 - isodow(date)) % 7 AS INTEGER) AS DATE) AS date, max(date) AS last_day, arg_max(close, date) AS close, max(high) AS high, min(low) AS low, sum(volume) AS volume FROM b GROUP BY 1, 2)"
_w30 = lambda c, p: over(f"quantile_cont({{}}, {p})", c, 30)
add(
    "det25_weekly_sleepers", lambda s, d: det.sleepers(resampling.weekly(bars(s, d)).withColumnRenamed("week", "date"), n=30, wick=1000.0, body=500.0, fast=20, slow=50).select("ticker", "last_day", "upper", "lower", "wick_width", "body_width"),
    with_bars(f"SELECT ticker, CAST(last_day AS VARCHAR) AS last_day, {cols('upper=u;lower=l;wick_width=(u - l) / nullif(l, 0);body_width=(t1 - t0) / nullif(t0, 0)')} FROM (SELECT *, {_w30('high', 0.95)} AS u, {_w30('low', 0.1)} AS l, {_w30('close', 0.95)} AS t1, {_w30('close', 0.1)} AS t0, {over('avg', 'close', 20)} AS s1, {over('avg', 'close', 50)} AS s2, {over('avg', 'close * volume', 20)} AS mo, {over('sum', '(CASE WHEN volume <= 0 THEN 1 ELSE 0 END)', 20)} AS idle FROM wk0) WHERE (u - l) / nullif(l, 0) < 1000 AND (t1 - t0) / nullif(t0, 0) < 500 AND idle <= 4 AND close > s1 AND s1 > s2 AND mo >= 0", WEEKS),
)
