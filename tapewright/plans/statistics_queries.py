"""Registered queries over statistics, regimes, splits, sequences and evaluation, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.operators import detection as det
from tapewright.operators import labels as lab
from tapewright.operators import statistics as st
from tapewright.plans import sqltext as S
from tapewright.plans.bar_queries import DAY, with_bars
from tapewright.plans.indicator_queries import bars, rounded
from tapewright.plans.pattern_queries import FLAGS, PATTERNS, after_sql, cols, flagged, patterns
from tapewright.plans.sqltext import frame, over, rnd

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DAYS_PAST = "1998-06-30"


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(query(spark, sf_dir))
    SQL[name] = sql


def outcomes(s: SparkSession, d: str) -> DataFrame:
    """Patterns with their gain after 20 rows."""
    return patterns(s, d).join(lab.horizons(patterns(s, d), bars(s, d), (20,)), "pattern_id").withColumn("year", F.year("end_date"))


OUTCOMES = f"{PATTERNS}, {after_sql(20)}, h AS (SELECT pattern_id, max(b_high / close - 1) AS fwd_max_20 FROM j GROUP BY pattern_id), u AS (SELECT p.*, h.fwd_max_20, year(end_date) AS year FROM p JOIN h USING (pattern_id))"
_long = " UNION ALL ".join(f"SELECT '{m}' AS method, fwd_gain_20 AS g FROM f WHERE {m}" for m in det.METHODS)
add("agg1_method_effectiveness", lambda s, d: st.method_effectiveness(flagged(s, d), det.METHODS, "fwd_gain_20"), with_bars(f"SELECT method, count(*) AS n, {cols('mean_gain=avg(g);median_gain=quantile_cont(g, 0.5);success=avg(CASE WHEN g >= 0.1 THEN 1.0 WHEN g < 0.1 THEN 0 END)')} FROM ({_long}) GROUP BY method", FLAGS))
_sum = " + ".join(f"CAST({m} AS INTEGER)" for m in det.METHODS)
add("agg2_method_agreement", lambda s, d: st.method_agreement(flagged(s, d), det.METHODS, "fwd_gain_20"), with_bars(f"SELECT {_sum} AS methods, count(*) AS n, {cols('mean_gain=avg(fwd_gain_20)')} FROM f GROUP BY 1", FLAGS))
add(
    "agg4_seasonality", lambda s, d: st.seasonality(bars(s, d), "ret"),
    with_bars(f"SELECT month, quarter, weekday, count(ret) AS n, {cols('mean=avg(ret);std=stddev_samp(ret)')} FROM (SELECT ret, CAST(month(date) AS INTEGER) AS month, CAST(quarter(date) AS INTEGER) AS quarter, CAST(isodow(date) - 1 AS INTEGER) AS weekday FROM b) GROUP BY GROUPING SETS ((month), (quarter), (weekday))"),
)
add(
    "agg9_risk_reward", lambda s, d: st.risk_reward(bars(s, d), "ticker", "ret"),
    with_bars(f"""SELECT ticker, n, {cols('profit_factor=won / nullif(lost, 0);expectancy=e;sharpe=e / nullif(sd, 0);var_5=v;rate=rate;win=win;loss=loss;kelly=least(greatest(rate - (1 - rate) / nullif(win / nullif(loss, 0), 0), 0), 0.25)')} FROM
      (SELECT ticker, count(ret) AS n, sum(CASE WHEN ret > 0 THEN ret ELSE 0 END) AS won, -sum(CASE WHEN ret < 0 THEN ret ELSE 0 END) AS lost, avg(ret) AS e, stddev_samp(ret) AS sd, quantile_cont(ret, 0.05) AS v,
        avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret <= 0 THEN 0 END) AS rate, avg(CASE WHEN ret > 0 THEN ret END) AS win, -avg(CASE WHEN ret <= 0 THEN ret END) AS loss FROM b GROUP BY ticker)"""),
)
add(
    "agg11_drawdown", lambda s, d: st.drawdown(bars(s, d)),
    with_bars(f"SELECT ticker, {cols('max_drawdown=min(dd)')}, max(run) AS longest_fall FROM (SELECT ticker, g, count(*) FILTER (WHERE close < pc) AS run, min(dd) AS dd FROM (SELECT *, close / {S.sofar('max(close)')} - 1 AS dd, {S.sofar('sum(CASE WHEN close < pc THEN 0 ELSE 1 END)')} AS g FROM b) GROUP BY ticker, g) GROUP BY ticker"),
)
_bounds = [5.0, 10.0, 20.0, 40.0]
add("agg18_sweep", lambda s, d: st.sweep(outcomes(s, d), "box_width", "fwd_max_20", _bounds), with_bars(f"SELECT {rnd('bound')} AS bound, count(*) AS n, {cols('mean=avg(fwd_max_20)')} FROM u JOIN (SELECT unnest({_bounds}) AS bound) ON box_width <= bound GROUP BY bound", OUTCOMES))
add("agg20_hierarchy", lambda s, d: st.hierarchy(outcomes(s, d), ("ticker", "year"), "fwd_max_20"), with_bars(f"SELECT ticker, CAST(year AS INTEGER) AS year, count(*) AS n, {cols('mean=avg(fwd_max_20)')} FROM u GROUP BY ROLLUP (ticker, year)", OUTCOMES))
add(
    "agg15_two_sample_t", lambda s, d: st.two_sample_t(flagged(s, d), "method4", "fwd_gain_20", "ticker"),
    with_bars(f"""SELECT ticker, n1, n0, {cols('t=(m1 - m0) / nullif(sqrt(v1 / nullif(n1, 0) + v0 / nullif(n0, 0)), 0);d=(m1 - m0) / nullif(sqrt((v1 + v0) / 2), 0)')} FROM (SELECT ticker, count(CASE WHEN method4 THEN fwd_gain_20 END) AS n1, count(CASE WHEN NOT method4 THEN fwd_gain_20 END) AS n0,
      avg(CASE WHEN method4 THEN fwd_gain_20 END) AS m1, avg(CASE WHEN NOT method4 THEN fwd_gain_20 END) AS m0, var_samp(CASE WHEN method4 THEN fwd_gain_20 END) AS v1, var_samp(CASE WHEN NOT method4 THEN fwd_gain_20 END) AS v0 FROM f GROUP BY ticker)""", FLAGS),
)
add(
    "reg1_hysteresis", lambda s, d: st.hysteresis(bars(s, d), 20, 60).select("ticker", "date", "phase", "fast_ma", "slow_ma", "crossover_date", "days_in_phase"),
    with_bars(f"SELECT ticker, {DAY}, phase, {cols('fast_ma=f;slow_ma=s')}, CAST(x AS VARCHAR) AS crossover_date, CAST(date_diff('day', x, date) AS INTEGER) AS days_in_phase FROM (SELECT *, last_value(CASE WHEN coalesce(phase <> lp, phase IS NOT NULL) THEN date END IGNORE NULLS) OVER ({S.BY_DATE} ROWS UNBOUNDED PRECEDING) AS x FROM z)",
      f"""x AS (SELECT *, {over('avg', 'close', 20)} AS f, {over('avg', 'close', 60)} AS s FROM b),
y AS (SELECT *, coalesce(last_value(CASE WHEN f > s * 1.05 THEN 1 WHEN f < s * 0.95 THEN 0 END IGNORE NULLS) OVER w, first_value(CASE WHEN s IS NOT NULL THEN CAST(f > s AS INTEGER) END IGNORE NULLS) OVER w) AS phase FROM x WINDOW w AS ({S.BY_DATE} ROWS UNBOUNDED PRECEDING)),
z AS (SELECT *, {S.lag('phase')} AS lp FROM y)"""),
)
add("reg4_breadth", lambda s, d: st.breadth(bars(s, d), 100), with_bars(f"SELECT {DAY}, {cols('breadth=avg(CASE WHEN close > m THEN 1.0 ELSE 0 END)')}, count(*) AS n FROM (SELECT *, {over('avg', 'close', 100)} AS m FROM b) WHERE m IS NOT NULL GROUP BY date"))
add(
    "spl2_embargo", lambda s, d: st.split_by_dates(patterns(s, d), "end_date", DAYS_PAST, "1998-09-30").groupBy("split").agg(F.count("*").alias("n"), F.min("end_date").alias("first"), F.max("end_date").alias("last")),
    with_bars(f"SELECT CASE WHEN end_date <= DATE '{DAYS_PAST}' THEN 'train' WHEN end_date >= DATE '1998-09-30' THEN 'test' ELSE 'embargo' END AS split, count(*) AS n, CAST(min(end_date) AS VARCHAR) AS first, CAST(max(end_date) AS VARCHAR) AS last FROM p GROUP BY 1", PATTERNS),
)
add("spl13_class_weights", lambda s, d: st.class_weights(patterns(s, d).withColumn("label", F.col("end_rn") % 3), "label"), with_bars(f"SELECT end_rn % 3 AS label, count(*) AS count, {cols('weight=sum(count(*)) OVER () / (count(*) OVER () * count(*))')} FROM p GROUP BY 1", PATTERNS))
add(
    "seq1_sequences", lambda s, d: st.sequences(bars(s, d)).select("ticker", "date", F.posexplode("window").alias("t", "x")),
    with_bars(f"SELECT ticker, {DAY}, CAST(k AS INTEGER) AS t, {rnd('w[k + 1] / w[1] - 1')} AS x FROM (SELECT *, list(close) OVER {frame(-19, 0)} AS w FROM b), range(20) AS r(k) WHERE rn >= 20 AND (rn - 20) % 10 = 0"),
)
add(
    "evl6_precision", lambda s, d: st.precision_at(outcomes(s, d).withColumn("hit", F.col("fwd_max_20") > 5), "money", "hit", "ticker"),
    with_bars(f"SELECT ticker, count(*) AS n, " + cols(";".join(f"precision_{int(100 * x)}=avg(CASE WHEN place <= greatest(1, floor(n * {x})) THEN CASE WHEN fwd_max_20 > 5 THEN 1.0 ELSE 0 END END)" for x in (0.1, 0.25))) + " FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY money DESC, pattern_id) AS place, count(*) OVER (PARTITION BY ticker) AS n FROM u) GROUP BY ticker", OUTCOMES),
)
add(
    "evl11_calibration", lambda s, d: st.calibration(outcomes(s, d).withColumns({"p": F.col("box_width") / (1 + F.col("box_width")), "hit": F.col("fwd_max_20") > 5}), "p", "hit"),
    with_bars(f"SELECT CAST(least(floor(q * 10), 9) AS BIGINT) AS bin, count(*) AS n, {cols('mean_probability=avg(q);hits=avg(k);gap=abs(avg(q) - avg(k)) * count(*)')} FROM (SELECT box_width / (1 + box_width) AS q, CASE WHEN fwd_max_20 > 5 THEN 1.0 ELSE 0 END AS k FROM u) GROUP BY 1", OUTCOMES),
)
add(
    "evl13_stability", lambda s, d: st.stability_index(bars(s, d), "volume", F.col("date") > F.lit(DAYS_PAST).cast("date")),
    with_bars(f"""SELECT {cols('psi=sum((q - p) * ln(q / p))')}, count(*) AS bins FROM (SELECT greatest(CAST(a AS DOUBLE) / (SELECT count(*) FROM b WHERE date <= DATE '{DAYS_PAST}'), 1e-4) AS p, greatest(CAST(z AS DOUBLE) / (SELECT count(*) FROM b WHERE date > DATE '{DAYS_PAST}'), 1e-4) AS q
      FROM (SELECT CASE WHEN volume = e[11] THEN 10 ELSE len([x for x in e if x <= volume]) END AS bin, count(*) FILTER (WHERE date <= DATE '{DAYS_PAST}') AS a, count(*) FILTER (WHERE date > DATE '{DAYS_PAST}') AS z FROM b, w GROUP BY 1) WHERE bin BETWEEN 1 AND 10)""",
      f"w AS (SELECT quantile_cont(volume, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) AS e FROM b WHERE date <= DATE '{DAYS_PAST}')"),
)
