"""Registered queries over tables of outcomes, sequences, files and streams, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.operators import sequences as seq
from tapewright.operators import statistics as st
from tapewright.operators import tabulation as tab
from tapewright.plans import sqltext as S
from tapewright.plans.bar_queries import DAY, with_bars
from tapewright.plans.evaluation_queries import TRAIN, WITH_LABEL, with_label
from tapewright.plans.indicator_queries import bars, rounded
from tapewright.plans.pattern_queries import FLAGS, PATTERNS, cols, flagged, patterns
from tapewright.plans.sqltext import over, rnd
from tapewright.sources import tables
from tapewright.streaming import bars as stream_bars

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(query(spark, sf_dir))
    SQL[name] = sql


add("agg3_best", lambda s, d: tab.best(flagged(s, d).where("method1"), "fwd_gain_20", 0.2).select("ticker", "date", "fwd_gain_20"), with_bars(f"SELECT ticker, {DAY}, {cols('fwd_gain_20=fwd_gain_20')} FROM (SELECT * FROM f WHERE method1 AND fwd_gain_20 >= 0.2 ORDER BY fwd_gain_20 DESC, ticker, date LIMIT 50)", FLAGS))
add("agg5_by_quartile", lambda s, d: tab.by_quartile(flagged(s, d), "ticker", "bbw", "fwd_gain_20"), with_bars(f"SELECT ticker, CAST(len([x FOR x IN e IF x <= bbw]) AS INTEGER) AS quartile, count(*) AS n, {cols('mean=avg(fwd_gain_20)')} FROM f JOIN (SELECT ticker, quantile_cont(bbw, [0, 0.25, 0.5, 0.75, 1]) AS e FROM f GROUP BY 1) USING (ticker) WHERE bbw IS NOT NULL AND len([x FOR x IN e IF x <= bbw]) BETWEEN 1 AND 4 GROUP BY 1, 2", FLAGS))
_db = [20.0, 25.0, 30.0, 35.0, 40.0]
_days = lambda df: df.withColumn("days", F.datediff("end_date", "start_date"))
add("agg6_durations", lambda s, d: tab.bucketed(_days(with_label(s, d)), "days", _db, "fwd_gain"), with_bars(f"SELECT CAST(len([x FOR x IN {_db} IF date_diff('day', start_date, end_date) > x]) AS INTEGER) AS bucket, count(*) AS n, {cols('mean=avg(fwd_gain)')} FROM wl GROUP BY 1", WITH_LABEL))
PERFORMANCE = """g0 AS (SELECT *, ret AS g, quantile_cont(ret, 0.05) OVER (PARTITION BY {key}) AS cut FROM b), g1 AS (SELECT {key} AS key, count(g) AS n, avg(g) AS mean, avg(g) / nullif(stddev_samp(g), 0) AS sharpe, avg(g) / nullif(sqrt(avg(CASE WHEN g < 0 THEN g * g ELSE 0 END)), 0) AS sortino, any_value(cut) AS var_5, avg(g) FILTER (g <= cut) AS cvar_5, avg(CASE WHEN g > 0 THEN 1.0 WHEN g <= 0 THEN 0 END) AS rate, avg(g) FILTER (g > 0) AS win, -avg(g) FILTER (g < 0) AS loss FROM g0 GROUP BY 1)"""
_shown = "mean=mean;sharpe=sharpe;sortino=sortino;var_5=var_5;cvar_5=cvar_5;rate=rate;win=win;loss=loss;expectancy=rate * coalesce(win, 0) - (1 - rate) * coalesce(loss, 0);kelly=least(greatest(rate - (1 - rate) / nullif(win / nullif(loss, 0), 0), 0), 0.25)"
add("agg10_performance", lambda s, d: tab.performance(bars(s, d), [F.col("ticker")], "ret"), with_bars(f"SELECT key AS ticker, n, {cols(_shown)} FROM g1", PERFORMANCE.format(key="ticker")))
add("agg12_monthly", lambda s, d: tab.performance(bars(s, d), [F.trunc("date", "month").alias("month")], "ret").select("month", "n", "mean", "rate", "kelly"), with_bars(f"SELECT CAST(key AS VARCHAR) AS month, n, {cols('mean=mean;rate=rate;kelly=least(greatest(rate - (1 - rate) / nullif(win / nullif(loss, 0), 0), 0), 0.25)')} FROM g1", PERFORMANCE.format(key="CAST(date_trunc('month', date) AS DATE)")))
add(
    "agg31_strategy_score", lambda s, d: tab.strategy_score(st.risk_reward(bars(s, d), "ticker", "ret").join(tab.compounded_drawdown(bars(s, d), "ticker", "date", "ret"), "ticker")).select("ticker", "rate", "profit_factor", "score"),
    with_bars(f"""SELECT ticker, {cols('rate=rate;profit_factor=pf')}, {' + '.join(f'CASE WHEN {c} > {x} THEN 2 WHEN {c} > {y} THEN 1 ELSE 0 END' for c, x, y in (('rate', 0.3, 0.2), ('sharpe', 1.5, 1.0), ('pf', 2.0, 1.5), ('dd', -0.15, -0.25), ('e', 0.05, 0.02)))} AS score FROM
      (SELECT ticker, sum(CASE WHEN ret > 0 THEN ret ELSE 0 END) / nullif(-sum(CASE WHEN ret < 0 THEN ret ELSE 0 END), 0) AS pf, avg(ret) AS e, avg(ret) / nullif(stddev_samp(ret), 0) AS sharpe, avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret <= 0 THEN 0 END) AS rate FROM b GROUP BY 1)
      JOIN (SELECT ticker, min(exp(lg - greatest(mx, 0)) - 1) AS dd FROM (SELECT *, max(lg) OVER ({S.BY_DATE} ROWS UNBOUNDED PRECEDING) AS mx FROM (SELECT ticker, date, sum(ln(1 + ret)) OVER ({S.BY_DATE} ROWS UNBOUNDED PRECEDING) AS lg FROM b WHERE ret > -1)) GROUP BY 1) USING (ticker)"""),
)
add(
    "agg13_compounded", lambda s, d: tab.compounded_drawdown(bars(s, d), "ticker", "date", "ret"),
    with_bars(f"SELECT ticker, {cols('log_growth=arg_max(lg, date);max_drawdown=min(exp(lg - greatest(mx, 0)) - 1)')} FROM (SELECT *, max(lg) OVER ({S.BY_DATE} ROWS UNBOUNDED PRECEDING) AS mx FROM (SELECT ticker, date, sum(ln(1 + ret)) OVER ({S.BY_DATE} ROWS UNBOUNDED PRECEDING) AS lg FROM b WHERE ret > -1)) GROUP BY 1"),
)
add(
    "agg14_chi_square", lambda s, d: tab.chi_square(with_label(s, d).withColumn("early", (F.col("end_date") <= F.lit(TRAIN).cast("date")).cast("int")), "early", "label"),
    with_bars(f"SELECT CAST(n AS BIGINT) AS n, {cols('chi2=x;v=sqrt(x / (n * (least(r, c) - 1)))')}, (r - 1) * (c - 1) AS df FROM (SELECT sum(k) AS n, sum(k * k / e) - sum(k) AS x, count(DISTINCT early) AS r, count(DISTINCT label) AS c FROM (SELECT *, sum(k) OVER (PARTITION BY early) * sum(k) OVER (PARTITION BY label) / sum(k) OVER () AS e FROM (SELECT CAST(end_date <= DATE '{TRAIN}' AS INTEGER) AS early, label, count(*) AS k FROM wl GROUP BY 1, 2)))", WITH_LABEL),
)
_fs = ["box_width", "close", "money"]
add("agg16_winners_ranges", lambda s, d: tab.winners_ranges(with_label(s, d).withColumn("won", F.col("label") == 4), _fs, "won"), with_bars(" UNION ALL ".join(f"SELECT '{f}' AS feature, {cols(f'correlation=corr({f}, CAST(label = 4 AS INTEGER));q25=quantile_cont({f}, 0.25) FILTER (label = 4);q75=quantile_cont({f}, 0.75) FILTER (label = 4);mean=avg({f}) FILTER (label = 4)')} FROM wl" for f in _fs), WITH_LABEL))
_xs, _ys = [5.0, 10.0, 20.0], [30_000.0, 60_000.0]
add("agg19_heat_map", lambda s, d: tab.heat_map(with_label(s, d), "box_width", "money", _xs, _ys, "fwd_gain"), with_bars(f"SELECT CAST(len([v FOR v IN {_xs} IF box_width > v]) AS INTEGER) AS x, CAST(len([v FOR v IN {_ys} IF money > v]) AS INTEGER) AS y, count(*) AS n, {cols('mean=avg(fwd_gain)')} FROM wl GROUP BY 1, 2", WITH_LABEL))
add("agg23_width_buckets", lambda s, d: tab.bucketed(with_label(s, d).withColumn("won", (F.col("label") == 4).cast("double")), "box_width", _xs, "won"), with_bars(f"SELECT CAST(len([v FOR v IN {_xs} IF box_width > v]) AS INTEGER) AS bucket, count(*) AS n, {cols('mean=avg(CAST(label = 4 AS INTEGER))')} FROM wl GROUP BY 1", WITH_LABEL))
add("agg24_universe", lambda s, d: with_label(s, d).groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("ticker").alias("tickers")), with_bars("SELECT label, count(*) AS n, count(DISTINCT ticker) AS tickers FROM wl GROUP BY 1", WITH_LABEL))
add("agg26_top_per_class", lambda s, d: tab.top_per_class(with_label(s, d), "label", "fwd_gain").select("label", "place", "pattern_id"), with_bars("SELECT label, place, pattern_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY fwd_gain DESC, pattern_id) AS place FROM wl) WHERE place <= 3", WITH_LABEL))
_pairs = [(a, b) for i, a in enumerate(_fs) for b in _fs[i + 1 :]]
add("agg26_correlations", lambda s, d: tab.correlations(patterns(s, d), _fs), with_bars(" UNION ALL ".join(f"SELECT '{a}/{b}' AS pair, {cols(f'correlation=corr({a}, {b})')} FROM p" for a, b in _pairs), PATTERNS))
add("agg29_calendar_days", lambda s, d: tab.at_calendar_days(patterns(s, d), bars(s, d)), with_bars(f"SELECT CAST(k AS INTEGER) AS day, count(*) AS n, {cols('mean_gain=avg(y.close / p.close - 1)')} FROM p, (SELECT unnest([5, 10, 20, 50]) AS k) JOIN b AS y ON y.ticker = p.ticker AND y.date = p.end_date + CAST(k AS INTEGER) GROUP BY k", PATTERNS))

# sequences
_ref = over("quantile_cont({}, 0.5)", "volume", 126, 1)
WINDOWS = f"""{PATTERNS}, rv AS (SELECT ticker, date, open, high, low, close, volume, {_ref} AS r FROM b), sw0 AS (SELECT p.pattern_id, y.date AS b_date, y.open, y.high, y.low, y.close, y.volume, y.r FROM p JOIN rv AS y ON y.ticker = p.ticker AND y.date BETWEEN p.start_date AND p.end_date),
sw AS (SELECT pattern_id, row_number() OVER q AS pl, list({{'o': open, 'h': high, 'l': low, 'c': close, 'v': volume}}) OVER w AS st, first_value(r) OVER w AS rf FROM sw0 WINDOW q AS (PARTITION BY pattern_id ORDER BY b_date), w AS (PARTITION BY pattern_id ORDER BY b_date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
sx AS (SELECT pattern_id, pl - 9 AS first, st, rf FROM sw WHERE pl >= 10 AND (pl - 10) % 5 = 0)"""
add(
    "seq1_inside_patterns", lambda s, d: seq.relative(seq.inside(patterns(s, d), bars(s, d))).select("pattern_id", "first", F.posexplode("steps").alias("t", "x")).select("pattern_id", "first", "t", "x.*"),
    with_bars(f"SELECT pattern_id, first, CAST(k AS INTEGER) AS t, {cols(';'.join(f'{n}=st[k + 1].{c} / st[1].c - 1' for n, c in (('open', 'o'), ('high', 'h'), ('low', 'l'), ('close', 'c'))) + ';volume=least(greatest(ln((st[k + 1].v + 1) / (coalesce(nullif(rf, 0), nullif(st[1].v, 0), 1) + 1)), -4), 6)')} FROM sx, range(10) AS r(k)", WINDOWS),
)
for _m, _low, _span in (("standard", "avg({0})", "stddev_pop({0})"), ("minmax", "min({0})", "max({0}) - min({0})"), ("robust", "quantile_cont({0}, 0.5)", "quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25)")):
    _par = ", ".join(f"{_low.format(c)} AS l_{c}, {_span.format(c)} AS s_{c}" for c in ("box_width", "money"))
    add(
        f"seq7_scaled_{_m}", lambda s, d, m=_m: seq.scaled(patterns(s, d).withColumn("train", F.col("end_date") <= F.lit(TRAIN).cast("date")), ["box_width", "money"], "train", m).select("pattern_id", "box_width", "money"),
        with_bars(f"SELECT pattern_id, {cols(';'.join(f'{c}=({c} - l_{c}) / CASE WHEN s_{c} < 1e-6 THEN 1 ELSE s_{c} END' for c in ('box_width', 'money')))} FROM p, (SELECT {_par} FROM p WHERE end_date <= DATE '{TRAIN}')", PATTERNS),
    )
add(
    "seq8_padded", lambda s, d: seq.padded(bars(s, d).groupBy("ticker", F.trunc("date", "month").alias("month")).agg(F.transform(F.array_sort(F.collect_list(F.struct("date", "close"))), lambda x: x["close"]).alias("x")), "x", 12).select("ticker", "month", F.posexplode("x").alias("t", "value")),
    with_bars(f"SELECT ticker, CAST(month AS VARCHAR) AS month, CAST(k AS INTEGER) AS t, {rnd('CASE WHEN len(x) >= 12 THEN x[len(x) - 11 + k] WHEN k < 12 - len(x) THEN 0 ELSE x[k + 1 - (12 - len(x))] END')} AS value FROM (SELECT ticker, CAST(date_trunc('month', date) AS DATE) AS month, list(close ORDER BY date) AS x FROM b GROUP BY 1, 2), range(12) AS r(k)"),
)

# streams: the same plan over the table
add(
    "bar10_stream_bars", lambda s, d: stream_bars.tick_bars(tables.ticks(s, d), "1 hour"),
    f"WITH {S.TICKS} SELECT symbol, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS ts, {cols('open=arg_min(bid, ts);high=max(bid);low=min(bid);close=arg_max(bid, ts)')}, count(*) AS volume FROM ticks GROUP BY symbol, date_trunc('hour', ts)",
)
