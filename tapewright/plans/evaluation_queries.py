"""Registered queries over splits and evaluation, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.operators import evaluation as evl
from tapewright.operators import filters as flt
from tapewright.operators import splits as spl
from tapewright.plans import sqltext as S
from tapewright.plans.bar_queries import with_bars
from tapewright.plans.indicator_queries import bars, rounded
from tapewright.plans.outcome_queries import LABELLED, labelled
from tapewright.plans.pattern_queries import CHAINED, PATTERNS, after_sql, cols, patterns

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TRAIN, VAL = "1997-12-31", "1999-06-30"


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(query(spark, sf_dir))
    SQL[name] = sql


def split_sql(date: str) -> str:
    return f"CASE WHEN {date} <= DATE '{TRAIN}' THEN 'train' WHEN {date} <= DATE '{VAL}' THEN 'val' WHEN {date} IS NOT NULL THEN 'test' END"


def by_date(s: SparkSession, d: str) -> DataFrame:
    return spl.by_cutoffs(patterns(s, d), "end_date", TRAIN, VAL)


SPLIT = f"{PATTERNS}, sp AS (SELECT *, {split_sql('end_date')} AS split FROM p)"
add("spl1_cutoffs", lambda s, d: by_date(s, d).select("pattern_id", "split"), with_bars("SELECT pattern_id, split FROM sp", SPLIT))
add(
    "spl3_strict", lambda s, d: spl.strict(patterns(s, d), "end_date").select("pattern_id", "split"),
    with_bars("SELECT pattern_id, CASE WHEN end_date <= t THEN 'train' WHEN end_date > CAST(t + INTERVAL 30 DAY AS DATE) AND end_date <= v THEN 'val' WHEN end_date > CAST(v + INTERVAL 30 DAY AS DATE) THEN 'test' ELSE 'gap' END AS split FROM p, cu",
              f"{PATTERNS}, sh AS (SELECT end_date, sum(n) OVER (ORDER BY end_date) / sum(n) OVER () AS share FROM (SELECT end_date, count(*) AS n FROM p GROUP BY 1)), cu AS (SELECT min(end_date) FILTER (share >= 0.6) AS t, min(end_date) FILTER (share >= 0.6 + 0.2) AS v FROM sh)"),
)
_clusters = ["ticker", "cluster"]
CLUSTERED = f"{PATTERNS}, {CHAINED}, cf AS (SELECT *, min(start_date) OVER (PARTITION BY ticker, cluster) AS first FROM c), cs AS (SELECT *, {split_sql('first')} AS split FROM cf)"
add("spl4_clusters", lambda s, d: spl.by_clusters(flt.chained(patterns(s, d)), _clusters, "start_date", TRAIN, VAL).select("pattern_id", "cluster", "split"), with_bars("SELECT pattern_id, cluster, split FROM cs", CLUSTERED))
add(
    "spl4_spanning_clusters", lambda s, d: spl.spanning_clusters(spl.by_cutoffs(flt.chained(patterns(s, d), 200), "start_date", TRAIN, VAL), _clusters),
    with_bars(f"SELECT ticker, cluster, count(DISTINCT split) AS splits FROM (SELECT *, {split_sql('start_date')} AS split FROM c) GROUP BY 1, 2 HAVING count(DISTINCT split) > 1", f"{PATTERNS}, {CHAINED.replace('> 10', '> 200')}"),
)
add(
    "spl5_walk_forward", lambda s, d: spl.walk_forward(patterns(s, d), "end_date", "1996-01-01").groupBy("window", "role").agg(F.count("*").alias("n"), F.min("end_date").alias("first"), F.max("end_date").alias("last")),
    with_bars("SELECT CAST(k AS INTEGER) AS window, CASE WHEN end_date < bd THEN 'train' ELSE 'test' END AS role, count(*) AS n, CAST(min(end_date) AS VARCHAR) AS first, CAST(max(end_date) AS VARCHAR) AS last FROM p, (SELECT k, CAST(DATE '1996-01-01' + CAST(k * 180 AS INTEGER) AS DATE) AS bd FROM range(8) AS r(k)) WHERE end_date < bd + 60 GROUP BY 1, 2", PATTERNS),
)
add(
    "spl6_first_predictions", lambda s, d: spl.first_predictions(spl.walk_forward(patterns(s, d), "end_date", "1996-01-01", test_days=400).where("role = 'test'"), ["ticker", "end_date"]).select("pattern_id", "window"),
    with_bars("SELECT pattern_id, CAST(min(k) AS INTEGER) AS window FROM p, (SELECT k, CAST(DATE '1996-01-01' + CAST(k * 180 AS INTEGER) AS DATE) AS bd FROM range(8) AS r(k)) WHERE end_date >= bd AND end_date < bd + 400 GROUP BY 1", PATTERNS),
)
add(
    "spl7_purged_folds", lambda s, d: spl.purged_folds(patterns(s, d), "ticker", ["end_date"]).groupBy("ticker", "fold", "role").agg(F.count("*").alias("n"), F.sum("end_rn").alias("rows")),
    with_bars("SELECT ticker, CAST(k AS INTEGER) AS fold, CASE WHEN i >= a AND i < z THEN 'test' WHEN i >= a - 5 AND i < z + 5 THEN 'purged' ELSE 'train' END AS role, count(*) AS n, CAST(sum(end_rn) AS BIGINT) AS rows FROM (SELECT *, floor(n * k / 5.0) AS a, floor(n * (k + 1) / 5.0) AS z FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY end_date) - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n FROM p), range(5) AS r(k)) GROUP BY 1, 2, 3", PATTERNS),
)
add("spl8_regime_coverage", lambda s, d: spl.regime_coverage(by_date(s, d).withColumn("regime", F.year("end_date")), "regime"), with_bars(f"SELECT split, regime, n AS count, {cols('share=n / sum(n) OVER (PARTITION BY split)')} FROM (SELECT split, CAST(year(end_date) AS INTEGER) AS regime, count(*) AS n FROM sp GROUP BY 1, 2)", SPLIT))
add("spl9_coverage", lambda s, d: spl.coverage(bars(s, d), "ticker", "date"), with_bars(f"SELECT ticker, count(*) AS n, CAST(date_diff('day', min(date), max(date)) + 1 AS INTEGER) AS days, {cols('coverage=count(*) / ((date_diff(\'day\', min(date), max(date)) + 1) * 252.0 / 365)')} FROM b GROUP BY 1"))
_features = ["box_width", "close", "money", "fwd_gain"]


def with_label(s: SparkSession, d: str) -> DataFrame:
    return patterns(s, d).join(labelled(patterns(s, d), bars(s, d)).select("pattern_id", "label", F.col("g").alias("fwd_gain")), "pattern_id")


WITH_LABEL = f"{PATTERNS}, {after_sql(20)}, {LABELLED}, wl AS (SELECT p.*, l.label, l.g AS fwd_gain FROM p JOIN l USING (pattern_id))"
add(
    "spl10_leaks", lambda s, d: spl.leaks(with_label(s, d), _features, "fwd_gain"),
    with_bars("SELECT feature, " + cols("correlation=correlation", "named=CAST(named AS INTEGER);correlated=CAST(abs(correlation) > 0.7 AS INTEGER);leaks=CAST(named OR abs(correlation) > 0.7 AS INTEGER)") + " FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, corr({f}, fwd_gain) AS correlation, {f.startswith('fwd_')} AS named FROM wl" for f in _features) + ")", WITH_LABEL),
)
add("spl10_order", lambda s, d: spl.order_of_splits(by_date(s, d), "end_date"), with_bars("SELECT split, CAST(f AS VARCHAR) AS first, CAST(l AS VARCHAR) AS last, n, CAST(coalesce(f > lag(l) OVER (ORDER BY f), true) AS INTEGER) AS in_order FROM (SELECT split, min(end_date) AS f, max(end_date) AS l, count(*) AS n FROM sp GROUP BY 1)", SPLIT))
add("spl11_power", lambda s, d: spl.power(spl.by_cutoffs(with_label(s, d), "end_date", TRAIN, VAL), "label", 4), with_bars(f"SELECT split, n, targets, {cols('share=targets / CAST(n AS DOUBLE)')}, CAST(targets >= 30 AS INTEGER) AS enough FROM (SELECT {split_sql('end_date')} AS split, count(*) AS n, count(*) FILTER (label = 4) AS targets FROM wl GROUP BY 1)", WITH_LABEL))
add("spl12_unseen", lambda s, d: spl.unseen(by_date(s, d).where("split = 'test' OR ticker < 'Brand#3'"), "ticker").select("pattern_id", "ticker"), with_bars("SELECT pattern_id, ticker FROM sp WHERE split = 'test' AND ticker NOT IN (SELECT ticker FROM sp WHERE split = 'train' AND ticker < 'Brand#3')", SPLIT))
add(
    "spl14_stratified", lambda s, d: spl.stratified(with_label(s, d), "label", "pattern_id").select("pattern_id", "label", "split"),
    with_bars("SELECT pattern_id, label, CASE WHEN pl < 0.2 THEN 'test' WHEN pl < 0.2 + 0.2 THEN 'val' ELSE 'train' END AS split FROM (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY md5(pattern_id), pattern_id) - 1) / CAST(count(*) OVER (PARTITION BY label) AS DOUBLE) AS pl FROM wl)", WITH_LABEL),
)

# evaluation: probabilities from box width and money, classes from the rows after


def predictions(s: SparkSession, d: str) -> DataFrame:
    w = 1 / (1 + F.col("box_width") / 10)
    df = patterns(s, d).withColumns({"x0": 1 - w, "x1": F.lit(0.3), "x2": w + F.col("close") / (F.col("close") + 2000)})
    total = F.col("x0") + F.col("x1") + F.col("x2")
    return df.select("pattern_id", *[(F.col(f"x{k}") / total).alias(f"p{k}") for k in range(3)])


_x = ("1 - 1 / (1 + box_width / 10)", "0.3", "1 / (1 + box_width / 10) + close / (close + 2000)")
_sum = " + ".join(f"({x})" for x in _x)
_ev = "p0 * -2.0 + p1 * -0.1 + p2 * 5.0"
_signal = "CASE WHEN p0 > 0.5 THEN 'AVOID' WHEN ev >= 5 THEN 'STRONG' WHEN ev >= 3 THEN 'GOOD' WHEN ev >= 1 THEN 'MODERATE' ELSE 'AVOID' END"
PREDICTED = f"{WITH_LABEL}, pr0 AS (SELECT *, {', '.join(f'({x}) / ({_sum}) AS p{k}' for k, x in enumerate(_x))} FROM wl), pr1 AS (SELECT *, {_ev} AS ev, CASE WHEN label = 5 THEN 0 WHEN label = 4 THEN 2 ELSE 1 END AS cls FROM pr0), pr AS (SELECT *, {_signal} AS signal, CASE cls WHEN 0 THEN -2.0 WHEN 1 THEN -0.1 ELSE 5.0 END AS actual FROM pr1)"


def scored(s: SparkSession, d: str) -> DataFrame:
    cls = F.when(F.col("label") == 5, 0).when(F.col("label") == 4, 2).otherwise(1)
    df = evl.expected_value(predictions(s, d)).join(with_label(s, d), "pattern_id").withColumn("cls", cls)
    return df.withColumn("actual", F.when(F.col("cls") == 0, -2.0).when(F.col("cls") == 1, -0.1).otherwise(5.0))


add("evl1_expected_value", lambda s, d: scored(s, d).select("pattern_id", "ev", "signal"), with_bars(f"SELECT pattern_id, {cols('ev=ev')}, signal FROM pr", PREDICTED))
_sh = "CAST(greatest(floor(least(250.0 / (upper + 0.01 - lower), 50000.0 / (upper + 0.01), money * 0.1 / (upper + 0.01))), 0) AS BIGINT)"
add(
    "evl2_sized", lambda s, d: evl.sized(patterns(s, d)).select("pattern_id", "entry", "limit", "risk", "shares", "tranche_1", "tranche_2", "tranche_3", "sell_1", "sell_3"),
    with_bars(f"SELECT pattern_id, {cols('entry=entry;limit=entry + 0.5 * risk;risk=risk;sell_1=entry + 3 * risk;sell_3=entry + 10 * risk')}, shares, CAST(floor(shares * 0.5) AS BIGINT) AS tranche_1, CAST(floor(shares * 0.25) AS BIGINT) AS tranche_2, CAST(shares - floor(shares * 0.5) - floor(shares * 0.25) AS BIGINT) AS tranche_3 FROM (SELECT *, upper + 0.01 AS entry, upper + 0.01 - lower AS risk, {_sh} AS shares FROM p)", PATTERNS),
)
add(
    "evl3_execution_plan", lambda s, d: evl.execution_plan(predictions(s, d), patterns(s, d), risk=100_000.0, capital=1_000_000.0, share_of_money=10.0).select("pattern_id", "ticker", "place", "ev", "shares"),
    with_bars(f"SELECT pattern_id, ticker, place, {cols('ev=ev')}, shares FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ev DESC, pattern_id) AS place FROM (SELECT *, {_signal} AS signal FROM (SELECT *, {_ev} AS ev, CAST(greatest(floor(least(100000.0 / (upper + 0.01 - lower), 1000000.0 / (upper + 0.01), money * 10.0 / (upper + 0.01))), 0) AS BIGINT) AS shares FROM (SELECT *, {', '.join(f'({x}) / ({_sum}) AS p{k}' for k, x in enumerate(_x))} FROM p))) WHERE ev > 0 AND signal <> 'AVOID' AND shares > 0) WHERE place <= 3", PATTERNS),
)
add(
    "evl5_gap_adjusted", lambda s, d: evl.gap_adjusted(patterns(s, d), bars(s, d)),
    with_bars(f"SELECT pattern_id, {cols('gap_r=g;final_r=f;penalty=greatest(g, 0);realised_r=f - greatest(g, 0)')} FROM (SELECT pattern_id, arg_min((b_open - close) / nullif(close - lower, 0), day) AS g, arg_max((b_close - close) / nullif(close - lower, 0), day) AS f FROM j WHERE close <> lower GROUP BY 1 UNION ALL SELECT DISTINCT pattern_id, NULL, NULL FROM j WHERE close = lower)", f"{PATTERNS}, {after_sql(20)}"),
)
_bounds = [0.0, 1.0, 2.0, 3.0, 4.0]
add("evl7_at_thresholds", lambda s, d: evl.at_thresholds(scored(s, d).withColumn("hit", F.col("cls") == 2), "hit", _bounds), with_bars(f"SELECT {cols('bound=bound')}, count(*) AS n, count(*) FILTER (cls = 2) AS hits, {cols('mean_ev=avg(ev)')} FROM pr JOIN (SELECT unnest({_bounds}) AS bound) ON ev >= bound GROUP BY bound", PREDICTED))
add(
    "evl8_ev_calibration", lambda s, d: evl.ev_calibration(scored(s, d), "actual"),
    with_bars(f"SELECT CAST(len([e FOR e IN es IF e < ev]) AS INTEGER) AS bin, count(*) AS n, {cols('mean_ev=avg(ev);mean_actual=avg(actual)')} FROM pr, (SELECT quantile_cont(ev, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS es FROM pr) GROUP BY 1", PREDICTED),
)
add(
    "evl9_ev_correlation", lambda s, d: evl.ev_correlation(scored(s, d), "actual", "ticker"),
    with_bars(f"SELECT ticker, {cols('pearson=corr(ev, actual);spearman=corr(re, ra);mae=avg(abs(ev - actual));rmse=sqrt(avg((ev - actual) * (ev - actual)));sign_agrees=avg(CAST(sign(ev) = sign(actual) AS INTEGER))')} FROM (SELECT *, rank() OVER (PARTITION BY ticker ORDER BY ev) + (count(*) OVER (PARTITION BY ticker, ev) - 1) / 2.0 AS re, rank() OVER (PARTITION BY ticker ORDER BY actual) + (count(*) OVER (PARTITION BY ticker, actual) - 1) / 2.0 AS ra FROM pr) GROUP BY 1", PREDICTED),
)
_best = "CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END"
add("evl10_target_and_danger", lambda s, d: evl.target_and_danger(scored(s, d), "cls"), with_bars(f"SELECT count(*) AS n, {cols('target_recall=count(*) FILTER (bs = 2 AND cls = 2) / nullif(CAST(count(*) FILTER (cls = 2) AS DOUBLE), 0);danger_precision=count(*) FILTER (bs = 0 AND cls = 0) / nullif(CAST(count(*) FILTER (bs = 0) AS DOUBLE), 0)')} FROM (SELECT *, {_best} AS bs FROM pr)", PREDICTED))
add("evl10_by_signal", lambda s, d: evl.by_signal(scored(s, d), "cls"), with_bars(f"SELECT signal, count(*) AS n, {cols('targets=avg(CAST(cls = 2 AS INTEGER));dangers=avg(CAST(cls = 0 AS INTEGER));mean_ev=avg(ev)')} FROM pr GROUP BY 1", PREDICTED))
add(
    "evl12_confusion", lambda s, d: evl.confusion(scored(s, d), "cls"),
    with_bars(f"SELECT class, support, tp, said, {cols('precision=pc;recall=rc;f1=2 * pc * rc / nullif(pc + rc, 0)')} FROM (SELECT *, tp / nullif(CAST(said AS DOUBLE), 0) AS pc, tp / nullif(CAST(support AS DOUBLE), 0) AS rc FROM (SELECT CAST(k AS INTEGER) AS class, count(*) FILTER (cls = k) AS support, count(*) FILTER (cls = k AND bs = k) AS tp, count(*) FILTER (bs = k) AS said FROM (SELECT *, {_best} AS bs FROM pr), range(3) AS r(k) GROUP BY 1))", PREDICTED),
)
add("evl11_brier", lambda s, d: evl.brier(scored(s, d), "cls"), with_bars(f"SELECT count(*) AS n, {cols('brier=avg(' + ' + '.join(f'(p{k} - CAST(cls = {k} AS INTEGER)) * (p{k} - CAST(cls = {k} AS INTEGER))' for k in range(3)) + ')')} FROM pr", PREDICTED))
add(
    "evl15_class_drift", lambda s, d: evl.class_drift(with_label(s, d), F.col("end_date") <= F.lit(TRAIN).cast("date"), "label"),
    with_bars(f"SELECT {cols('kl=sum(q * ln(q / pp))')}, count(*) AS classes FROM (SELECT greatest(a / sum(a) OVER (), 1e-6) AS pp, greatest(z / sum(z) OVER (), 1e-6) AS q FROM (SELECT label, count(*) FILTER (end_date <= DATE '{TRAIN}') AS a, count(*) FILTER (end_date > DATE '{TRAIN}') AS z FROM wl GROUP BY 1))", WITH_LABEL),
)
add(
    "evl18_signal_exits", lambda s, d: evl.signal_exits(patterns(s, d), bars(s, d)),
    with_bars(f"SELECT pattern_id, reason, least(coalesce(sd, 1073741824), coalesce(td, 1073741824), ld) AS exit_day, {cols('fwd_pnl=CASE reason WHEN \'stop\' THEN -0.3 WHEN \'target\' THEN 1.0 ELSE lc / nullif(entry, 0) - 1 END')} FROM (SELECT *, CASE WHEN coalesce(sd, 1073741824) <= coalesce(td, 1073741824) AND sd IS NOT NULL THEN 'stop' WHEN td IS NOT NULL THEN 'target' ELSE 'timeout' END AS reason FROM (SELECT pattern_id, entry, min(CASE WHEN b_low <= entry * (1 - 0.3) THEN day END) AS sd, min(CASE WHEN b_high >= entry * 2 THEN day END) AS td, max(day) AS ld, arg_max(b_close, day) AS lc FROM j JOIN (SELECT pattern_id, arg_min(b_open, day) AS entry FROM j GROUP BY 1) USING (pattern_id) GROUP BY 1, 2))", f"{PATTERNS}, {after_sql(100)}"),
)
_h = "-(" + " + ".join(f"p{k} * ln(greatest(p{k}, 1e-12))" for k in range(3)) + ")"
add(
    "evl20_ensemble", lambda s, d: evl.ensemble_uncertainty(scored(s, d), "ticker").select("ticker", "mean_0", "std_2", "ev_mean", "ev_std", "ev_low", "ev_high", "aleatoric", "epistemic", "agreement", "modal"),
    with_bars(f"SELECT ticker, {cols(f'mean_0=avg(p0);std_2=stddev_pop(p2);ev_mean=avg(ev);ev_std=stddev_pop(ev);ev_low=quantile_cont(ev, 0.05);ev_high=quantile_cont(ev, 0.95);aleatoric=avg({_h});epistemic=(var_pop(p0) + var_pop(p1) + var_pop(p2)) / 3;agreement=max(nb) / CAST(count(*) AS DOUBLE)')}, arg_min(bs, (-nb, bs)) AS modal FROM (SELECT *, count(*) OVER (PARTITION BY ticker, bs) AS nb FROM (SELECT *, {_best} AS bs FROM pr)) GROUP BY 1".replace("arg_min(bs, (-nb, bs))", "arg_min(bs, -nb * 10 + bs)"), PREDICTED),
)
