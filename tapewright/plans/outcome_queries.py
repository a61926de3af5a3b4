"""Registered queries over further outcomes of patterns, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.operators import labels as lab
from tapewright.operators import outcomes as out
from tapewright.plans import sqltext as S
from tapewright.plans.bar_queries import with_bars
from tapewright.plans.indicator_queries import bars, rounded
from tapewright.plans.pattern_queries import PATTERNS, after_sql, cols, gain_sql, patterns, two_sql
from tapewright.plans.sqltext import div, over

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
REFERENCE = "1998-06-30"


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(query(spark, sf_dir))
    SQL[name] = sql


def label(name: str, query: Callable, body: str, *ctes: str) -> None:
    add(name, lambda s, d: query(patterns(s, d), bars(s, d)), with_bars(body, ",\n".join([PATTERNS, *ctes])))


LABELLED = f"o14 AS (SELECT pattern_id, ticker, end_rn, min(CASE WHEN b_low <= lower * 0.9 THEN day END) AS k5, max(b_high / upper - 1) AS g FROM j GROUP BY 1, 2, 3), l AS (SELECT *, {gain_sql('g', 'k5 IS NOT NULL')} AS label FROM o14)"


def labelled(p: DataFrame, b: DataFrame) -> DataFrame:
    """Patterns with a class by the rows after them."""
    j = lab.after(p, b, 20)
    o = j.groupBy("pattern_id", "ticker", "end_rn").agg(lab.first_day(F.col("b_low") <= F.col("lower") * 0.9).alias("k5"), F.max(F.col("b_high") / F.col("upper") - 1).alias("g"))
    return o.withColumn("label", lab.gain_class(F.col("g"), F.col("k5").isNotNull()))


_value = " ".join(f"WHEN {k} THEN {v}" for k, v in out.CLASS_VALUES.items())
label("lab2_class_value", lambda p, b: labelled(p, b).select("pattern_id", "label", out.class_value(F.col("label")).alias("value")), f"SELECT pattern_id, label, {cols(f'value=CASE label {_value} END')} FROM l", after_sql(20), LABELLED)
label(
    "lab5_atr_path", out.atr_path, f"SELECT pattern_id, s AS stop_day, t AS target_day, {two_sql('t', 's')} AS label FROM o",
    f"ta AS (SELECT ticker, rn, list_reduce([x FOR x IN list(tr) OVER {S.frame(-27, 0)} IF x IS NOT NULL], lambda m, x: m + (x - m) / 14) AS atr FROM b WHERE rn > 1), pa AS (SELECT p.*, atr FROM p JOIN ta ON ta.ticker = p.ticker AND ta.rn = p.end_rn WHERE atr > 0)", after_sql(40, source="pa"),
    "o AS (SELECT pattern_id, min(CASE WHEN b_low <= lower - 2 * atr THEN day END) AS s, min(CASE WHEN b_close >= close + 5 * atr AND b_next_open >= close + 5 * atr THEN day END) AS t FROM j GROUP BY pattern_id)",
)


def _profiled(p: DataFrame, b: DataFrame) -> DataFrame:
    profiles = p.sparkSession.createDataFrame([("small", 0.1, 2.0), ("large", 0.02, 5.0)], "tier string, buffer double, times double")
    return out.profiled_path(p.withColumn("tier", F.when(F.col("money") < 60_000, "small").otherwise("large")), b, profiles)


label(
    "lab6_profiled_path", _profiled, f"SELECT pattern_id, s AS stop_day, t AS target_day, {two_sql('t', 's')} AS label FROM o",
    "pt AS (SELECT *, CASE WHEN money < 60000 THEN 0.1 ELSE 0.02 END AS buf, CASE WHEN money < 60000 THEN 2.0 ELSE 5.0 END AS tm FROM p)", after_sql(40, source="pt"),
    "o AS (SELECT pattern_id, min(CASE WHEN b_low <= lower * (1 - buf) THEN day END) AS s, min(CASE WHEN b_close >= close + tm * lower * buf AND b_next_open >= close + tm * lower * buf THEN day END) AS t FROM j GROUP BY pattern_id)",
)
label(
    "lab10_volume_confirmed", lambda p, b: out.volume_confirmed(p, b, run=2, times=1.2, money=10_000.0), "SELECT pattern_id, k AS confirmed_day, CAST(k IS NOT NULL AS INTEGER) AS confirmed FROM o",
    f"uv AS (SELECT ticker, rn, avg(volume) OVER {S.frame(-20, 0)} AS usual FROM b), pu AS (SELECT p.*, usual FROM p JOIN uv ON uv.ticker = p.ticker AND uv.rn = p.end_rn)", after_sql(60, source="pu", extra=", y.volume AS b_volume"),
    "o0 AS (SELECT pattern_id, day, sum(CASE WHEN b_volume > 1.2 * usual AND b_close * b_volume >= 10000 THEN 1 ELSE 0 END) OVER (PARTITION BY pattern_id ORDER BY day ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS rl FROM j), o AS (SELECT pattern_id, min(CASE WHEN rl >= 2 THEN day END) AS k FROM o0 GROUP BY pattern_id)",
)
_tier, _steady = "CASE WHEN money < 30000 THEN 1.5 WHEN money < 60000 THEN 1.0 ELSE 0.7 END", "CASE WHEN box_width > 2 THEN 1.4 WHEN box_width < 0.5 THEN 0.8 ELSE 1.0 END"
label("lab12_dynamic_barriers", lambda p, b: out.dynamic_barriers(p, F.col("box_width")).select("pattern_id", "up_barrier", "down_barrier"), f"SELECT pattern_id, {cols(f'up_barrier=round(greatest(0.3 * {_tier} * {_steady}, 0.01), 4);down_barrier=round(greatest(0.15 * {_tier} * {_steady}, 0.01), 4)')} FROM p")
label(
    "lab13_historic_features", out.historic_features, f"SELECT pattern_id, {cols('hist_vol_20=hv;hist_sma_50=hs;hist_ret_20=hr;hist_volume_ratio=hq')} FROM p JOIN h ON h.ticker = p.ticker AND h.rn = p.end_rn",
    f"h AS (SELECT ticker, rn, {over('stddev_samp', 'ret', 20, back=1)} AS hv, {over('avg', 'close', 50, back=1)} AS hs, {div(S.lag('close', 1), S.lag('close', 21))} - 1 AS hr, {div(S.lag('volume'), over('avg', 'volume', 20, back=1))} AS hq FROM b)",
)
label(
    "lab16_respected", lambda p, b: out.respected(p, b, first=8, n=40, above=2.0, below=0.9),
    f"SELECT pattern_id, {cols('refined_upper=ru;refined_lower=rl;fwd_gain=g')}, rb AS rows_below, bd AS broken_day, CAST(rb >= 7 AS INTEGER) AS anxious, {gain_sql('g')} AS label FROM z",
    after_sql(48), "k0 AS (SELECT pattern_id, upper, lower, count(*) FILTER (day <= 8 AND (b_high > upper * 3 OR b_low < lower * (1 - 0.9))) AS lf, max(b_high) FILTER (day BETWEEN 5 AND 8) AS hm, min(b_low) FILTER (day BETWEEN 5 AND 8) AS lm FROM j GROUP BY 1, 2, 3)",
    "k1 AS (SELECT pattern_id, least(upper, coalesce(hm, upper)) AS ru, greatest(lower, coalesce(lm, lower)) AS rl FROM k0 WHERE lf = 0)",
    "k2 AS (SELECT j.pattern_id, day, b_high, b_low, b_close, ru, rl, CAST(b_close < rl AS INTEGER) AS lo FROM j JOIN k1 USING (pattern_id) WHERE day > 8)",
    "k3 AS (SELECT *, sum(1 - lo) OVER (PARTITION BY pattern_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS gr FROM k2), k4 AS (SELECT *, CAST(sum(lo) OVER (PARTITION BY pattern_id, gr) AS BIGINT) AS run FROM k3)",
    "z AS (SELECT pattern_id, ru, rl, max(b_high / ru - 1) AS g, max(run) AS rb, min(CASE WHEN b_low < rl * (1 - 0.9) THEN day END) AS bd FROM k4 GROUP BY 1, 2, 3)",
)
label(
    "lab17_graceful_breach", lambda p, b: out.graceful_breach(p, b, 40, 0.5, 2),
    f"SELECT pattern_id, breach_day, first_below, longest_below, {cols('fwd_gain=g')}, CAST(quiet >= 2 AS INTEGER) AS anxious, CASE WHEN k5 = breach_day THEN 5 WHEN k4 = breach_day THEN 4 WHEN breach_day IS NOT NULL THEN 3 ELSE {gain_sql('g')} END AS label FROM z",
    after_sql(40, 0), "k0 AS (SELECT *, least(k5, k4, k3) AS breach_day FROM (SELECT pattern_id, min(CASE WHEN b_low <= lower * 0.5 THEN day END) AS k5, min(CASE WHEN b_high / upper - 1 >= 0.75 THEN day END) AS k4, min(CASE WHEN b_high / upper - 1 >= 0.35 THEN day END) AS k3 FROM j GROUP BY 1))",
    "k1 AS (SELECT j.*, k5, k4, breach_day, CAST(b_close < lower AS INTEGER) AS lo, CAST(b_low > lower * 0.5 AS INTEGER) AS sh FROM j JOIN k0 USING (pattern_id) WHERE breach_day IS NULL OR day <= breach_day)",
    "k2 AS (SELECT *, sum(1 - lo) OVER (PARTITION BY pattern_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS gr FROM k1), k3 AS (SELECT *, CAST(sum(lo) OVER (PARTITION BY pattern_id, gr) AS BIGINT) AS run, CAST(sum(lo * sh) OVER (PARTITION BY pattern_id, gr) AS BIGINT) AS qu FROM k2)",
    "z AS (SELECT pattern_id, k5, k4, breach_day, max(qu) AS quiet, min(CASE WHEN lo = 1 THEN day END) AS first_below, max(run) AS longest_below, max(b_high / upper - 1) AS g FROM k3 GROUP BY 1, 2, 3, 4)",
)
_group = "ticker || '-' || CAST(end_rn // 100 AS VARCHAR)"
GROUPED = f"gl AS (SELECT *, {_group} AS grp FROM l), gg AS (SELECT *, CASE WHEN first_value(label) OVER (PARTITION BY grp ORDER BY end_rn) = 5 THEN 5 WHEN max(CASE WHEN label = 5 THEN -1 ELSE label END) OVER (PARTITION BY grp) = -1 THEN 5 ELSE max(CASE WHEN label = 5 THEN -1 ELSE label END) OVER (PARTITION BY grp) END AS group_label FROM gl)"


def grouped(p: DataFrame, b: DataFrame) -> DataFrame:
    with_key = labelled(p, b).withColumn("grp", F.concat_ws("-", "ticker", F.floor(F.col("end_rn") / 100)))
    return out.best_of_group(with_key, "grp", "end_rn")


label("lab19_best_of_group", lambda p, b: grouped(p, b).select("pattern_id", "label", "group_label"), "SELECT pattern_id, label, group_label FROM gg", after_sql(20), LABELLED, GROUPED)
label("lab20_mismatches", lambda p, b: out.mismatches(grouped(p, b), "label", "group_label"), "SELECT label, count(*) AS n, count(*) FILTER (label <> group_label) AS mismatched FROM gg GROUP BY 1", after_sql(20), LABELLED, GROUPED)
label("lab20_evolution", lambda p, b: out.evolution(grouped(p, b), "grp"), "SELECT grp, count(*) AS n, count(DISTINCT label) AS classes, CAST(count(DISTINCT label) > 1 AS INTEGER) AS changes FROM gg GROUP BY 1", after_sql(20), LABELLED, GROUPED)
label(
    "lab21_coil_trades", lambda p, b: out.coil_trades(p, b, buffer=0.5),
    "SELECT pattern_id, fill_day, CASE WHEN f < 1073741824 THEN f END AS exit_day, CASE WHEN fill_day IS NULL THEN 'unfilled' WHEN last_day IS NULL OR f = 1073741824 THEN 'time' WHEN coalesce(st, 1073741824) = f THEN 'stop' WHEN coalesce(su, 1073741824) = f THEN 'surge' ELSE 'target' END AS reason FROM (SELECT *, least(coalesce(su, 1073741824), coalesce(st, 1073741824), coalesce(ta, 1073741824)) AS f FROM z)",
    after_sql(60, extra=", y.volume AS b_volume"), "k0 AS (SELECT pattern_id, min(CASE WHEN b_low <= lower * 1.5 THEN day END) AS fill_day FROM j GROUP BY 1)",
    "k1 AS (SELECT pattern_id, min(CASE WHEN b_high >= lower * 1.5 * 1.5 AND b_volume >= 2 * mean_volume THEN day END) AS su, min(CASE WHEN b_close < lower THEN day END) AS st, min(CASE WHEN b_high >= lower * 1.5 * 1.5 THEN day END) AS ta, max(day) AS last_day FROM j JOIN k0 USING (pattern_id) WHERE day > fill_day AND day <= fill_day + 40 GROUP BY 1)",
    "z AS (SELECT * FROM k0 LEFT JOIN k1 USING (pattern_id))",
)
BREAKS = """k0 AS (SELECT *, CASE WHEN b_close > upper THEN 1 WHEN b_close < lower THEN -1 ELSE 0 END AS side FROM j),
k1 AS (SELECT pattern_id, arg_min(side, day) AS direction, min(day) AS break_day FROM k0 WHERE side <> 0 GROUP BY 1),
k2 AS (SELECT k0.*, direction, break_day, day - break_day AS since, CASE WHEN direction = 1 THEN b_close < upper ELSE b_close > lower END AS back, CASE WHEN direction = 1 THEN b_low <= upper * 1.02 ELSE b_high >= lower * 0.98 END AS touch, CASE WHEN direction = 1 THEN upper ELSE lower END AS edge FROM k0 JOIN k1 USING (pattern_id)),
k3 AS (SELECT *, sum(CASE WHEN since >= 0 AND NOT back THEN 1 ELSE 0 END) OVER (PARTITION BY pattern_id ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS held FROM k2),
bo AS (SELECT pattern_id, direction, break_day, min(since) FILTER (since BETWEEN 1 AND 20 AND back) AS fake_out_after, count(*) FILTER (since BETWEEN 5 AND 49 AND touch) AS retests, max(abs(b_close / edge - 1)) FILTER (since = 0) AS strength, avg(CAST(NOT back AS INTEGER)) FILTER (since BETWEEN 1 AND 20) AS sustained, CAST(max(held) FILTER (since BETWEEN 0 AND 9) >= 3 AS INTEGER) AS confirmed FROM k3 GROUP BY 1, 2, 3)"""
label("lab22_breakouts", out.breakouts, f"SELECT pattern_id, direction, break_day, fake_out_after, retests, {cols('strength=strength;sustained=sustained')}, confirmed, CAST(fake_out_after IS NOT NULL AS INTEGER) AS fake_out FROM bo", after_sql(60), BREAKS)
label("lab29_breakout_summary", lambda p, b: out.breakout_summary(out.breakouts(p, b)), f"SELECT direction, count(*) AS n, {cols('fake_rate=avg(CAST(fake_out_after IS NOT NULL AS INTEGER));confirmed_rate=avg(confirmed);strong_rate=avg(CAST(strength > 0.5 AS INTEGER));mean_strength=avg(strength)')} FROM bo GROUP BY 1", after_sql(60), BREAKS)
label(
    "lab23_re_entries", out.re_entries, f"SELECT pattern_id, count(*) FILTER (ins AND NOT was) AS re_entries, {cols('rows_outside=avg(day - ex - 1) FILTER (ins AND NOT was AND ex IS NOT NULL)')} FROM k1 GROUP BY 1",
    after_sql(60), "k0 AS (SELECT *, b_close BETWEEN lower AND upper AS ins FROM j), k1 AS (SELECT *, lag(ins) OVER (PARTITION BY pattern_id ORDER BY day) AS was, last_value(CASE WHEN ins THEN day END IGNORE NULLS) OVER (PARTITION BY pattern_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ex FROM k0)",
)
label("lab26_signed_class", lambda p, b: lab.horizons(p, b, (40,)).select("pattern_id", out.signed_class(F.col("fwd_max_40")).alias("label"), out.signed_class(F.col("fwd_close_40") / F.col("fwd_close_40") * F.col("fwd_min_40")).alias("worst")), "SELECT pattern_id, " + ", ".join(f"CASE WHEN {g} < -0.05 THEN 5 WHEN {g} < 0.05 THEN 0 WHEN {g} < 0.15 THEN 1 WHEN {g} < 0.35 THEN 2 WHEN {g} < 0.75 THEN 3 WHEN {g} IS NOT NULL THEN 4 END AS {n}" for g, n in (("g", "label"), ("w", "worst"))) + " FROM (SELECT pattern_id, max(b_high / close - 1) AS g, CASE WHEN max(day) = 40 THEN min(b_low / close - 1) END AS w FROM j GROUP BY 1)", after_sql(40))
label(
    "lab27_risk_metrics", out.risk_metrics, f"SELECT pattern_id, {cols('risk=greatest(r, 0);fwd_max_r=hi;fwd_min_r=lo;achieved_r=CASE WHEN lo < -1 THEN -1 ELSE hi END')}, n AS rows FROM (SELECT *, CASE WHEN r <= 0 THEN 0 ELSE (most - close) / r END AS hi, CASE WHEN r <= 0 THEN 0 ELSE (worst - close) / r END AS lo FROM (SELECT pattern_id, close, close - lower * 0.98 AS r, max(b_close) AS most, min(b_close) AS worst, count(*) AS n FROM j GROUP BY 1, 2, 3))",
    after_sql(60),
)
label("lab28_merged_class", lambda p, b: labelled(p, b).groupBy(out.merged_class(F.col("label")).alias("merged")).agg(F.count("*").alias("n")), "SELECT CASE WHEN label IN (3, 4) THEN 3 WHEN label = 2 THEN 2 WHEN label IN (0, 1) THEN 1 WHEN label = 5 THEN 0 END AS merged, count(*) AS n FROM l GROUP BY 1", after_sql(20), LABELLED)
label(
    "lab8_ripeness", lambda p, b: out.ripeness(p, REFERENCE, b.groupBy("ticker").agg(F.max("date").alias("last_date"))),
    f"SELECT pattern_id, w AS window, age, CAST(age >= w AS INTEGER) AS ripe, CAST(age > 150 AND last_date <= end_date AS INTEGER) AS zombie FROM (SELECT p.*, last_date, least(greatest(CAST(floor(1 / (box_width / 100 + 1e-6)) AS BIGINT), 10), 60) AS w, CAST(date_diff('day', end_date, DATE '{REFERENCE}') AS INTEGER) AS age FROM p JOIN (SELECT ticker, max(date) AS last_date FROM b GROUP BY 1) USING (ticker))",
)
