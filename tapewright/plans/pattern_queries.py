"""Registered queries over detection, labels, filters and joins, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.operators import detection as det
from tapewright.operators import filters as flt
from tapewright.operators import joins as jon
from tapewright.operators import labels as lab
from tapewright.plans import indicator_queries
from tapewright.plans import sqltext as S
from tapewright.plans.bar_queries import DAY, with_bars
from tapewright.plans.indicator_queries import bars, rounded
from tapewright.plans.sqltext import div, frame, over, rnd
from tapewright.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(query(spark, sf_dir))
    SQL[name] = sql


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.grid_patterns(bars(spark, sf_dir))


def cols(text: str, raw: str = "") -> str:
    """name=expression pairs, semicolon-separated, rounded; those of ``raw`` as they are."""
    shown = [f"{rnd(x)} AS {n}" for n, x in (p.split("=", 1) for p in text.split(";") if p)]
    return ", ".join(shown + [f"{x} AS {n}" for n, x in (p.split("=", 1) for p in raw.split(";") if p)])


# detection
_true = "greatest(high - low, abs(high - coalesce(pc, close)), abs(low - coalesce(pc, close)))"
FLAGS = f"""f0 AS (SELECT *, {div(f'2 * stddev_samp(close) OVER {frame(-19, 0)}', f'avg(close) OVER {frame(-19, 0)}')} AS bbw, {div(f'avg({_true}) OVER {frame(-13, 0)}', 'close')} AS atr_share,
    {div('high - low', f'avg(high - low) OVER {frame(-19, 0)}')} AS range_ratio, {div('volume', f'avg(volume) OVER {frame(-19, 0)}')} AS volume_ratio FROM b),
f1 AS (SELECT *, quantile_cont(bbw, 0.3) OVER (PARTITION BY ticker) AS bbw_cut, quantile_cont(atr_share, 0.3) OVER (PARTITION BY ticker) AS atr_cut FROM f0),
f AS (SELECT *, coalesce(bbw < bbw_cut, false) AS method1, coalesce(range_ratio < 0.65 AND atr_share < 0.5, false) AS method2, coalesce(volume_ratio < 0.35, false) AS method3, coalesce(atr_share < atr_cut, false) AS method4,
    {', '.join(f"{div(f'max(high) OVER {frame(1, n)}', 'close')} - 1 AS fwd_gain_{n}, {div(f'min(low) OVER {frame(1, n)}', 'close')} - 1 AS fwd_loss_{n}" for n in (20, 40))} FROM f1)"""


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.four_methods(bars(spark, sf_dir), atr_share=0.5)


_methods = ", ".join(f"CAST({m} AS INTEGER) AS {m}" for m in det.METHODS)
add(
    "det3_four_methods", lambda s, d: flagged(s, d).select("ticker", "date", "bbw", "atr_share", "range_ratio", "volume_ratio", *det.METHODS, "fwd_gain_20", "fwd_loss_20", "fwd_gain_40", "fwd_loss_40"),
    with_bars(f"SELECT ticker, {DAY}, {cols('bbw=bbw;atr_share=atr_share;range_ratio=range_ratio;volume_ratio=volume_ratio;fwd_gain_20=fwd_gain_20;fwd_loss_20=fwd_loss_20;fwd_gain_40=fwd_gain_40;fwd_loss_40=fwd_loss_40')}, {_methods} FROM f", FLAGS),
)
_fm = ";".join(f"fwd_close_{n}=lead(close, {n}) OVER w;fwd_max_{n}=CASE WHEN lead(close, {n}) OVER w IS NOT NULL THEN max(high) OVER {frame(1, n)} / nullif(close, 0) - 1 END;fwd_min_{n}=CASE WHEN lead(close, {n}) OVER w IS NOT NULL THEN min(low) OVER {frame(1, n)} / nullif(close, 0) - 1 END" for n in (20, 40))
add("det5_forward_metrics", lambda s, d: det.forward_metrics(bars(s, d)).select("ticker", "date", *[f"fwd_{k}_{n}" for n in (20, 40) for k in ("close", "max", "min")]), with_bars(f"SELECT ticker, {DAY}, {cols(_fm)} FROM b WINDOW w AS ({S.BY_DATE})"))
add(
    "det6_islands", lambda s, d: det.islands(flagged(s, d), "method1", 3),
    with_bars(f"SELECT ticker, CAST(min(date) AS VARCHAR) AS start_date, CAST(max(date) AS VARCHAR) AS end_date, max(rn) AS end_rn, count(*) AS days, {cols('upper=max(high);lower=min(low);mean_volume=avg(volume)')} FROM (SELECT *, rn - sum(CAST(method1 AS INTEGER)) OVER ({S.BY_DATE} ROWS UNBOUNDED PRECEDING) AS g FROM f) WHERE method1 GROUP BY ticker, g HAVING count(*) >= 3", FLAGS),
)
add(
    "det7_latest_status", lambda s, d: det.latest_status(flagged(s, d), "method4"),
    with_bars(f"SELECT ticker, {DAY}, CAST(method4 AS INTEGER) AS now, days, {cols('close=close')} FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS last, CAST(sum(CAST(method4 AS INTEGER)) OVER {frame(-29, 0)} AS BIGINT) AS days FROM f) WHERE last = 1", FLAGS),
)
PATTERNS = f"""p0 AS (SELECT *, {over('max', 'high', 20)} AS upper, {over('min', 'low', 20)} AS lower, lag(date, 19) OVER ({S.BY_DATE}) AS start_date, {over('avg', 'volume', 20)} AS mean_volume, {over('avg', 'close * volume', 20)} AS money FROM b),
p1 AS (SELECT *, {div('upper - lower', 'lower')} AS box_width FROM p0 WHERE rn >= 60 AND rn % 10 = 0),
p AS (SELECT ticker || '-' || rn AS pattern_id, ticker, start_date, date AS end_date, rn AS end_rn, upper, lower, box_width, close, mean_volume, money
      FROM (SELECT *, quantile_cont(box_width, 0.3) OVER (PARTITION BY ticker) AS cut FROM p1) WHERE box_width <= cut)"""
_pat = "pattern_id, ticker, CAST(start_date AS VARCHAR) AS start_date, CAST(end_date AS VARCHAR) AS end_date, end_rn, " + cols("upper=upper;lower=lower;box_width=box_width;close=close;mean_volume=mean_volume;money=money")
add("det8_grid_patterns", patterns, with_bars(f"SELECT {_pat} FROM p", PATTERNS))
_q60 = lambda c, p: over(f"quantile_cont({{}}, {p})", c, 60)
add(
    "det11_sleepers", lambda s, d: det.sleepers(bars(s, d), wick=60.0, body=30.0, least_money=30_000.0).select("ticker", "date", "upper", "lower", "wick_width", "body_width", "trigger", "money"),
    with_bars(f"SELECT ticker, {DAY}, {cols('upper=upper;lower=lower;wick_width=(upper - lower) / nullif(lower, 0);body_width=(b1 - b0) / nullif(b0, 0);trigger=upper * 1.05;money=money')} FROM x WHERE (upper - lower) / nullif(lower, 0) < 60 AND (b1 - b0) / nullif(b0, 0) < 30 AND idle <= 4 AND close > s50 AND s50 > s200 AND money >= 30000",
      f"x AS (SELECT *, {_q60('high', 0.95)} AS upper, {_q60('low', 0.1)} AS lower, {_q60('close', 0.95)} AS b1, {_q60('close', 0.1)} AS b0, {over('avg', 'close', 50)} AS s50, {over('avg', 'close', 200)} AS s200, {over('avg', 'close * volume', 20)} AS money, {over('sum', '(CASE WHEN volume <= 0 THEN 1 ELSE 0 END)', 20)} AS idle FROM b)"),
)
add(
    "det14_accumulation", lambda s, d: det.accumulation_days(bars(s, d), times=2.0, still=0.5).select("ticker", "date", "accumulation"),
    with_bars(f"SELECT ticker, {DAY}, CAST(sum(q) OVER {frame(-89, 0)} AS BIGINT) AS accumulation FROM (SELECT *, CASE WHEN volume > 2 * ({over('avg', 'volume', 50)}) AND abs(ret) < 0.5 THEN 1 ELSE 0 END AS q FROM b)"),
)
add(
    "det17_money_tiers", lambda s, d: det.money_tiers(bars(s, d)),
    with_bars(f"SELECT ticker, {cols('money=m')}, CASE WHEN m < 10000 THEN 'nano' WHEN m < 30000 THEN 'micro' WHEN m < 60000 THEN 'small' WHEN m < 100000 THEN 'mid' ELSE 'large' END AS tier FROM (SELECT ticker, quantile_cont(x, 0.5) AS m FROM (SELECT ticker, {over('avg', 'close * volume', 40)} AS x FROM b) GROUP BY ticker)"),
)
_dx = div("abs(pd - md)", "pd + md")
add(
    "det22_coils", lambda s, d: det.coils(bars(s, d), width=40.0, cheap_width=60.0, cheap=1000.0, direction=30.0).select("ticker", "date", "coil_range", "rvol", "support", "adx_filled"),
    with_bars(f"SELECT ticker, {DAY}, {cols('coil_range=r;rvol=v;support=l;adx_filled=ad')} FROM (SELECT *, (h - l) / nullif(l, 0) AS r FROM (SELECT *, {over('max', 'high', 40)} AS h, {over('min', 'low', 40)} AS l, {div('volume', over('avg', 'volume', 30))} AS v, coalesce({over('avg', 'dx', 14)}, 50) AS ad FROM z3)) WHERE r <= CASE WHEN close < 1000 THEN 60 ELSE 40 END AND v <= 0.5 AND ad <= 30",
      f"""{indicator_queries._dm}, z1 AS (SELECT *, {over('avg', 'plus_dm', 14)} AS pp, {over('avg', 'minus_dm', 14)} AS qq, {over('avg', 'tr', 14)} AS aa FROM m), z2 AS (SELECT *, 100 * {div('pp', 'aa')} AS pd, 100 * {div('qq', 'aa')} AS md FROM z1), z3 AS (SELECT *, 100 * {_dx} AS dx FROM z2)"""),
)
add("det26_domestic", lambda s, d: tables.table(s, d, "part").select("p_partkey", det.is_domestic(F.concat("p_brand", F.when(F.col("p_size") % 2 == 0, ".DE").otherwise(""))).alias("domestic")), "SELECT p_partkey, CAST(NOT (p_size % 2 = 0) AS INTEGER) AS domestic FROM part")
add(
    "det28_accumulation_score", lambda s, d: det.accumulation_score(bars(s, d)),
    with_bars(f"""SELECT ticker, {DAY}, {cols('contraction=c;buying=u;strong=st;distance=far')}, pts AS points, CAST(pts >= 70 AS INTEGER) AS signal FROM
      (SELECT *, CAST(CASE WHEN c < 0.6 THEN 30 ELSE 0 END + CASE WHEN u > 1.5 THEN 25 ELSE 0 END + CASE WHEN st > 0.6 THEN 25 ELSE 0 END + CASE WHEN far < 0.5 THEN 20 ELSE 0 END AS INTEGER) AS pts FROM
        (SELECT *, CASE WHEN dn > 0 THEN up / dn ELSE 10 END AS u FROM x WHERE last = 1))""",
      f"""x AS (SELECT *, {div(over('avg', '(high - low)', 10), over('avg', '(high - low)', 10, back=10))} AS c, {over('sum', '(CASE WHEN ret > 0 THEN volume ELSE 0 END)', 20)} AS up, {over('sum', '(CASE WHEN ret < 0 THEN volume ELSE 0 END)', 20)} AS dn,
        {over('avg', '(CASE WHEN close >= high - 0.4 * (high - low) THEN 1.0 ELSE 0 END)', 20)} AS st, close / nullif(min(low) OVER {frame(-251, 0)}, 0) - 1 AS far, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS last FROM b)"""),
)


# labels
def after_sql(n: int, first: int = 1, source: str = "p", extra: str = "") -> str:
    return f"j AS (SELECT p.*, y.rn - p.end_rn AS day, y.date AS b_date, y.open AS b_open, y.high AS b_high, y.low AS b_low, y.close AS b_close, y.nx AS b_next_open{extra} FROM {source} AS p JOIN (SELECT *, lead(open) OVER ({S.BY_DATE}) AS nx FROM b) AS y ON y.ticker = p.ticker AND y.rn BETWEEN p.end_rn + {first} AND p.end_rn + {n})"


def gain_sql(gain: str, broken: str = "false") -> str:
    return f"CASE WHEN ({gain}) IS NULL THEN NULL WHEN {broken} THEN 5 WHEN {gain} < 0.05 THEN 0 WHEN {gain} < 0.15 THEN 1 WHEN {gain} < 0.35 THEN 2 WHEN {gain} < 0.75 THEN 3 ELSE 4 END"


def two_sql(target: str, stop: str) -> str:
    return f"CASE WHEN {target} < coalesce({stop}, 1073741824) THEN 2 WHEN {stop} IS NOT NULL THEN 0 ELSE 1 END"


def label(name: str, function: Callable, body: str, *ctes: str) -> None:
    add(name, lambda s, d: function(patterns(s, d), bars(s, d)), with_bars(body, ",\n".join([PATTERNS, *ctes])))


label(
    "lab3_unified", lab.unified, f"SELECT pattern_id, {cols('fwd_gain=g;fwd_loss=l;fwd_end=e;breakout_volume=v')}, CAST(k AS INTEGER) AS breakout_day, {gain_sql('g', 'l < -0.5')} AS label FROM o",
    after_sql(30, extra=", y.volume AS b_volume"), "o AS (SELECT pattern_id, max(b_high / upper - 1) AS g, min(b_low / lower - 1) AS l, arg_max(b_close / upper - 1, day) AS e, min(CASE WHEN b_close > upper * 1.05 THEN date_diff('day', end_date, b_date) END) AS k, arg_min(b_volume / nullif(mean_volume, 0), day) FILTER (b_close > upper * 1.05) AS v FROM j GROUP BY pattern_id)",
)
label(
    "lab4_path", lab.path, f"SELECT pattern_id, s AS stop_day, t AS target_day, {two_sql('t', 's')} AS label FROM o",
    after_sql(40), "o AS (SELECT pattern_id, min(CASE WHEN b_low <= lower * 0.98 THEN day END) AS s, min(CASE WHEN b_close >= close + 3 * (lower * 0.02) AND b_next_open >= close + 3 * (lower * 0.02) THEN day END) AS t FROM j GROUP BY pattern_id)",
)
label(
    "lab7_structural", lab.structural,
    f"SELECT pattern_id, {cols('entry=entry;risk=risk;trigger=trig;fwd_best_r=best;gap_r=(entry - trig) / nullif(risk, 0)')}, s AS stop_day, t AS target_day, {two_sql('t', 's')} AS label, CAST(entry > trig + 0.5 * risk AS INTEGER) AS untradeable FROM o",
    after_sql(60), "e AS (SELECT pattern_id, arg_min(b_open, day) AS nx FROM j GROUP BY pattern_id)",
    "i AS (SELECT j.*, upper + 0.01 AS trig, greatest(upper + 0.01, nx) AS entry, upper + 0.01 - lower AS risk FROM j JOIN e USING (pattern_id))",
    "o AS (SELECT pattern_id, entry, risk, trig, min(CASE WHEN b_low < lower THEN day END) AS s, min(CASE WHEN b_high >= entry + 3 * risk THEN day END) AS t, max((b_high - entry) / nullif(risk, 0)) AS best FROM i GROUP BY pattern_id, entry, risk, trig)",
)
label(
    "lab11_triple_barrier", lab.triple_barrier,
    f"SELECT pattern_id, u AS up_day, l AS down_day, {cols('fwd_max=mx;fwd_min=mn;fwd_final=fin')}, {two_sql('u', 'l')} AS label, least(u, l) AS hit_day FROM o",
    "j AS (SELECT p.*, y.high AS b_high, y.low AS b_low, y.close AS b_close, y.date AS b_date, CAST(date_diff('day', p.end_date, y.date) AS INTEGER) AS day FROM p JOIN b AS y ON y.ticker = p.ticker AND date_diff('day', p.end_date, y.date) BETWEEN 1 AND 150)",
    "o AS (SELECT pattern_id, min(CASE WHEN b_high >= close * 2 THEN day END) AS u, min(CASE WHEN b_low <= close * 0.5 THEN day END) AS l, max(b_high / close - 1) AS mx, min(b_low / close - 1) AS mn, arg_max(b_close / close - 1, b_date) AS fin FROM j GROUP BY pattern_id)",
)
_never = "coalesce({}, 1073741824)"
_five, _four, _three = (_never.format(c) for c in ("k5", "k4", "k3"))
label(
    "lab14_first_breach", lab.first_breach,
    f"SELECT pattern_id, k5 AS k5_day, k4 AS k4_day, k3 AS k3_day, {cols('fwd_gain=g')}, CASE WHEN k5 IS NOT NULL AND {_five} <= {_four} AND {_five} <= {_three} THEN 5 WHEN k4 IS NOT NULL AND {_four} <= {_three} THEN 4 WHEN k3 IS NOT NULL THEN 3 ELSE {gain_sql('g')} END AS label FROM o",
    after_sql(100, 0), "o AS (SELECT pattern_id, min(CASE WHEN b_low <= lower * (1 - 0.1) THEN day END) AS k5, min(CASE WHEN b_high / upper - 1 >= 0.75 THEN day END) AS k4, min(CASE WHEN b_high / upper - 1 >= 0.35 THEN day END) AS k3, max(b_high / upper - 1) AS g FROM j GROUP BY pattern_id)",
)
label(
    "lab15_race", lab.race, f"SELECT pattern_id, k5 AS k5_day, {cols('fwd_gain=g')}, {gain_sql('g')} AS class, CASE WHEN k5 IS NOT NULL AND coalesce({gain_sql('g')}, 0) < 1 THEN 5 WHEN {gain_sql('g')} >= 3 THEN {gain_sql('ga')} ELSE {gain_sql('g')} END AS label FROM o",
    after_sql(100, 0), "k AS (SELECT pattern_id, min(CASE WHEN b_low <= lower * (1 - 0.1) THEN day END) AS k5 FROM j GROUP BY pattern_id)",
    "o AS (SELECT pattern_id, k5, max(CASE WHEN k5 IS NULL OR day < k5 THEN b_high / upper - 1 END) AS g, max(b_high / upper - 1) AS ga FROM j JOIN k USING (pattern_id) GROUP BY pattern_id, k5)",
)
label(
    "lab7_structural_weekly", lambda p, b: lab.structural(p, b, times=2.0, share_of_box=0.75).select("pattern_id", "entry", "risk", "stop_day", "target_day", "label"),
    f"SELECT pattern_id, {cols('entry=entry;risk=risk')}, s AS stop_day, t AS target_day, {two_sql('t', 's')} AS label FROM o",
    after_sql(60), "e AS (SELECT pattern_id, arg_min(b_open, day) AS nx FROM j GROUP BY pattern_id)",
    "i AS (SELECT j.*, greatest(upper + 0.01, nx) AS entry, (upper - lower) * 0.75 AS risk FROM j JOIN e USING (pattern_id))",
    "o AS (SELECT pattern_id, entry, risk, min(CASE WHEN b_low < lower THEN day END) AS s, min(CASE WHEN b_high >= entry + 2 * risk THEN day END) AS t FROM i GROUP BY pattern_id, entry, risk)",
)
label(
    "lab18_crash_aware", lab.crash_aware, f"SELECT pattern_id, c AS crash_day, {cols('fwd_gain=g')}, d AS double_day, CASE WHEN d IS NOT NULL AND (c IS NULL OR d < c) THEN 4 ELSE {gain_sql('g')} END AS label FROM o",
    after_sql(60), "k AS (SELECT pattern_id, min(CASE WHEN b_low <= close * (1 - 0.3) THEN day END) AS c FROM j GROUP BY pattern_id)",
    "o AS (SELECT pattern_id, c, max(b_high / close - 1) AS g, min(CASE WHEN b_high >= close * 2 THEN day END) AS d FROM j JOIN k USING (pattern_id) WHERE c IS NULL OR day <= c GROUP BY pattern_id, c)",
)
_hz = ";".join(f"fwd_max_{n}=max(CASE WHEN day <= {n} THEN b_high / close - 1 END);fwd_min_{n}=min(CASE WHEN day <= {n} THEN b_low / close - 1 END);fwd_close_{n}=max(CASE WHEN day = {n} THEN b_close END)" for n in (5, 20, 60))
label("lab24_horizons", lab.horizons, f"SELECT pattern_id, {cols(_hz)} FROM j GROUP BY pattern_id", after_sql(60))
add(
    "lab8_adaptive_window", lambda s, d: patterns(s, d).select("pattern_id", lab.adaptive_window(F.col("box_width") / 100).alias("window")),
    with_bars("SELECT pattern_id, least(greatest(CAST(floor(1 / (box_width / 100 + 1e-6)) AS BIGINT), 10), 60) AS window FROM p", PATTERNS),
)

# filters
CHAINED = "c0 AS (SELECT *, coalesce(date_diff('day', lag(start_date) OVER w, start_date) > 10, true) AS new FROM p WINDOW w AS (PARTITION BY ticker ORDER BY start_date, pattern_id)), c AS (SELECT *, CAST(sum(CAST(new AS INTEGER)) OVER (PARTITION BY ticker ORDER BY start_date, pattern_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM c0)"
add("flt1_highlander", lambda s, d: flt.highlander(patterns(s, d)).select("pattern_id", "ticker", "cluster", "box_width"), with_bars(f"SELECT pattern_id, ticker, cluster, {cols('box_width=box_width')} FROM (SELECT *, row_number() OVER (PARTITION BY ticker, cluster ORDER BY box_width, start_date, pattern_id) AS place FROM c) WHERE place = 1", f"{PATTERNS}, {CHAINED}"))
add(
    "flt2_trinity", lambda s, d: flt.trinity(patterns(s, d), 20).select("pattern_id", "ticker", "cluster", "n"),
    with_bars("""SELECT pattern_id, ticker, cluster, n FROM (SELECT *, count(*) OVER k AS n, row_number() OVER (PARTITION BY ticker, cluster ORDER BY start_date, pattern_id) AS e, row_number() OVER (PARTITION BY ticker, cluster ORDER BY box_width, start_date, pattern_id) AS b FROM c WINDOW k AS (PARTITION BY ticker, cluster))
      WHERE n >= 3 AND (e = 1 OR b = 1 OR e = n // 2 + 1) OR n < 3 AND b = 1""", f"{PATTERNS}, {CHAINED.replace('> 10', '> 20')}"),
)
_iv = "i AS (SELECT p.*, y.volume AS b_volume, y.close AS b_close FROM p JOIN b AS y ON y.ticker = p.ticker AND y.date BETWEEN p.start_date AND p.end_date)"
add("flt7_heartbeat", lambda s, d: flt.heartbeat(patterns(s, d), bars(s, d), 0.5), with_bars(f"SELECT pattern_id, {cols('volume_cv=cv')}, n, CAST(cv > 0.5 AS INTEGER) AS is_noise FROM (SELECT pattern_id, stddev_pop(b_volume) / nullif(avg(b_volume), 0) AS cv, count(*) AS n FROM i GROUP BY pattern_id)", f"{PATTERNS}, {_iv}"))
add("flt8_duplication", lambda s, d: flt.duplication(patterns(s, d).unionByName(patterns(s, d).where("end_rn % 20 = 0"))), with_bars(f"SELECT ticker, count(*) AS n, count(DISTINCT pattern_id) AS different, {cols('ratio=count(*) / count(DISTINCT pattern_id)')} FROM (SELECT * FROM p UNION ALL SELECT * FROM p WHERE end_rn % 20 = 0) GROUP BY ticker", PATTERNS))
add(
    "flt10_overlapping", lambda s, d: flt.overlapping(patterns(s, d), 30).select("pattern_id", "ticker", "anchor", "box_width"),
    with_bars(f"SELECT pattern_id, ticker, CAST(anchor AS VARCHAR) AS anchor, {cols('box_width=box_width')} FROM (SELECT *, row_number() OVER (PARTITION BY ticker, anchor ORDER BY box_width, end_date, pattern_id) AS place FROM q) WHERE place = 1",
      f"""{PATTERNS}, a AS (SELECT ticker, min(end_date) AS anchor FROM p GROUP BY ticker UNION ALL SELECT a.ticker, (SELECT min(end_date) FROM p WHERE p.ticker = a.ticker AND date_diff('day', a.anchor, p.end_date) > 30) FROM a WHERE EXISTS (SELECT 1 FROM p WHERE p.ticker = a.ticker AND date_diff('day', a.anchor, p.end_date) > 30)),
q AS (SELECT p.*, (SELECT max(anchor) FROM a WHERE a.ticker = p.ticker AND a.anchor <= p.end_date) AS anchor FROM p)"""),
)
add(
    "flt14_oversampled", lambda s, d: flt.oversampled(patterns(s, d).withColumn("tight", -F.col("box_width")), "tight").select("pattern_id", "copy"),
    with_bars("SELECT pattern_id, unnest(range(1, k + 1)) AS copy FROM (SELECT pattern_id, CASE WHEN -box_width >= (SELECT quantile_cont(-box_width, 0.8) FROM p) THEN 3 ELSE 1 END AS k FROM p)", PATTERNS),
)
_kind = "CASE doc_id % 4 WHEN 0 THEN '8-K' WHEN 1 THEN '424B5' WHEN 2 THEN 'DEF 14A' END"
_flags = {k: f"coalesce(regexp_matches(text, '{p}'){' AND filing_type IS DISTINCT FROM ' + chr(39) + 'DEF 14A' + chr(39) + ' AND filing_type IS NOT NULL' if k in flt.TERMS else ''}, false)" for k, p in flt.FILING_PATTERNS.items()}
_filed = lambda: F.when(F.col("doc_id") % 4 == 0, "8-K").when(F.col("doc_id") % 4 == 1, "424B5").when(F.col("doc_id") % 4 == 2, "DEF 14A")
add(
    "flt19_filings", lambda s, d: flt.filings(tables.table(s, d, "documents").withColumn("filing_type", _filed())).select("doc_id", *flt.FILING_PATTERNS, "flags", "passes"),
    "SELECT doc_id, " + ", ".join(f"CAST({x} AS INTEGER) AS {k}" for k, x in _flags.items()) + ", concat_ws(',', " + ", ".join(f"CASE WHEN {x} THEN '{k}' END" for k, x in _flags.items()) + ") AS flags, CAST(NOT (" + " OR ".join(x for k, x in _flags.items() if k != "shell") + f") AS INTEGER) AS passes FROM (SELECT *, {_kind} AS filing_type FROM documents)",
)

# joins
add("jon1_interval", lambda s, d: jon.interval(patterns(s, d), bars(s, d)).groupBy("pattern_id").agg(F.count("*").alias("n"), F.avg("b_close").alias("mean_close")), with_bars(f"SELECT pattern_id, count(*) AS n, {cols('mean_close=avg(b_close)')} FROM i GROUP BY pattern_id", f"{PATTERNS}, {_iv}"))
add("jon2_rows_after", lambda s, d: lab.after(patterns(s, d), bars(s, d), 10).select("pattern_id", "day", "b_close"), with_bars(f"SELECT pattern_id, day, {cols('b_close=b_close')} FROM j", f"{PATTERNS}, {after_sql(10)}"))


def shifted(s: SparkSession, d: str) -> DataFrame:
    return patterns(s, d).select("pattern_id", "ticker", F.date_add("end_date", 3).alias("moment"))


for _name, _forward, _asof in (("jon3_as_of", False, ">="), ("jon4_as_of_forward", True, "<=")):
    add(
        _name, lambda s, d, f=_forward: jon.as_of(shifted(s, d), bars(s, d).select("ticker", "date", "close"), ["ticker"], "moment", "date", ["date", "close"], f),
        with_bars(f"SELECT pattern_id, ticker, CAST(moment AS VARCHAR) AS moment, CAST(date AS VARCHAR) AS date, {cols('close=close')} FROM (SELECT t.pattern_id, t.ticker, t.moment, y.date, y.close FROM (SELECT pattern_id, ticker, CAST(end_date + 3 AS DATE) AS moment FROM p) AS t ASOF LEFT JOIN bars AS y ON t.ticker = y.ticker AND t.moment {_asof} y.date)", PATTERNS),
    )
add(
    "jon6_latest", lambda s, d: jon.latest(tables.table(s, d, "customer").select("c_custkey"), tables.table(s, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "o_orderkey", ["o_orderkey", "o_totalprice"]),
    f"SELECT c_custkey, k AS o_orderkey, {cols('o_totalprice=v')} FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS k, arg_max(o_totalprice, o_orderkey) AS v FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey",
)
