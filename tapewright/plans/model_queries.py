"""Registered queries over models, calibration, drift and sketches; SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.functions.stored import cut_table
from tapewright.operators import evaluation as evl
from tapewright.operators import features as fea
from tapewright.operators import models
from tapewright.operators import sequences as seq
from tapewright.plans.bar_queries import with_bars
from tapewright.plans.evaluation_queries import PREDICTED, WITH_LABEL, scored, with_label
from tapewright.plans.indicator_queries import bars, rounded
from tapewright.plans.pattern_queries import cols, patterns

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FEATURES = ["box_width", "to_sma_200", "to_high_252", "money_log", "volume_log_diff", "range_log_diff", "ret_20", "bbw", "position", "vol_decay"]


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(query(spark, sf_dir))
    if sql:
        SQL[name] = sql


def _training(s: SparkSession, d: str) -> DataFrame:
    """Patterns with the context vector, whether their class is 3 or more, and a split by their end."""
    df = fea.context_vector(patterns(s, d), bars(s, d)).join(with_label(s, d).select("pattern_id", "end_date", "label"), "pattern_id")
    return models.weighted(models.split_by_time(df, "end_date", "pattern_id"), F.col("label").isin(3, 4))


def _metrics(s: SparkSession, d: str, fit: Callable) -> DataFrame:
    df = _training(s, d)
    return models.classifier_metrics(models.score(fit(df, FEATURES), df))


add("ml1_boosted_trees", lambda s, d: _metrics(s, d, lambda df, f: models.fit_boosted(df, f, iterations=20)))
add("ml1_logistic", lambda s, d: _metrics(s, d, models.fit_logistic))


def _linear(s: SparkSession, d: str) -> DataFrame:
    df = models.split_by_time(with_label(s, d), "end_date", "pattern_id").withColumns({"width": F.ln(1 + F.col("box_width")), "size": F.ln(1 + F.col("money")), "gain": F.ln(2 + F.col("fwd_gain"))})
    return models.linear_regression(df, ["width", "size"], "gain")


add(
    "ml1_linear", _linear,
    with_bars(f"""SELECT name, {cols('coefficient=c')} FROM (SELECT unnest(['intercept', 'width', 'size']) AS name, unnest([my - bx * mx - bz * mz, bx, bz]) AS c FROM (SELECT *, (cxy * vz - czy * cxz) / (vx * vz - cxz * cxz) AS bx, (czy * vx - cxy * cxz) / (vx * vz - cxz * cxz) AS bz FROM
      (SELECT avg(y) AS my, avg(x) AS mx, avg(z) AS mz, var_pop(x) AS vx, var_pop(z) AS vz, covar_pop(x, y) AS cxy, covar_pop(z, y) AS czy, covar_pop(x, z) AS cxz FROM
        (SELECT ln(1 + box_width) AS x, ln(1 + money) AS z, ln(2 + fwd_gain) AS y, row_number() OVER (ORDER BY end_date, md5(pattern_id)) AS place, count(*) OVER () AS total FROM wl) WHERE place <= floor(total * 0.8))))""", WITH_LABEL),
)
add("ml2_profiles", lambda s, d: models.cluster_profiles(fea.context_vector(patterns(s, d), bars(s, d)), FEATURES[:4], most=5)[1])


def _calibrated(s: SparkSession, d: str) -> DataFrame:
    df = cut_table(scored(s, d).select("pattern_id", "p0", "p1", "p2", "cls"))  # fitted, then calibrated
    return models.calibrate(df, models.fit_isotonic(df, ["p0", "p1", "p2"], "cls")).drop("cls")


def _pooled(k: int) -> str:
    """The isotonic value of each distinct probability: the largest, over starts, of the least mean over ends."""
    return f"""q{k} AS (SELECT p, row_number() OVER (ORDER BY p) AS i, sum(w) OVER (ORDER BY p) AS sw, sum(y) OVER (ORDER BY p) AS sy FROM (SELECT floor(p{k} * 10000 + 0.5) / 10000 AS p, CAST(count(*) AS DOUBLE) AS w, CAST(count(*) FILTER (cls = {k}) AS DOUBLE) AS y FROM pr GROUP BY 1)),
r{k} AS (SELECT a.i AS j, b.i AS k, (b.sy - coalesce(z.sy, 0)) / (b.sw - coalesce(z.sw, 0)) AS m FROM q{k} a JOIN q{k} b ON b.i >= a.i LEFT JOIN q{k} z ON z.i = a.i - 1),
g{k} AS (SELECT p, max(m) AS g FROM (SELECT j, k, min(m) OVER (PARTITION BY j ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS m FROM r{k}) JOIN q{k} ON i = k GROUP BY 1)"""


_fitted = ", ".join(f"greatest(g{k}.g, 1e-8) AS c{k}" for k in range(3))
add(
    "ml3_calibrated", _calibrated,
    with_bars(f"SELECT pattern_id, {cols(';'.join(f'p{k}=c{k} / (c0 + c1 + c2)' for k in range(3)))} FROM (SELECT pattern_id, {_fitted} FROM pr {' '.join(f'JOIN g{k} ON g{k}.p = floor(pr.p{k} * 10000 + 0.5) / 10000' for k in range(3))})", ", ".join([PREDICTED, *map(_pooled, range(3))])),
)
_reference = {"ret": (0.0, 1.0), "close": (1500.0, 500.0)}
_z = "abs(z) / sqrt(2.0)"
_t = f"(1 / (1 + 0.3275911 * {_z}))"
_phi = f"(0.5 + sign(z) * 0.5 * (1 - {_t} * (0.254829592 + {_t} * (-0.284496736 + {_t} * (1.421413741 + {_t} * (-1.453152027 + {_t} * 1.061405429)))) * exp(-z * z / 2)))"
add(
    "evl14_normality", lambda s, d: evl.normality(bars(s, d), _reference),
    with_bars(f"""SELECT feature, n, {cols('distance=dist;p_value=p')}, CAST(p < 0.05 AS INTEGER) AS drifts FROM (SELECT *, CASE WHEN n * dist * dist < 0.04 THEN 1 ELSE least(1, greatest(0, list_sum([CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * k * k * n * dist * dist) FOR k IN range(1, 101)]))) END AS p FROM
      (SELECT feature, count(*) AS n, max(greatest(abs(hi / CAST(total AS DOUBLE) - {_phi}), abs(lo / CAST(total AS DOUBLE) - {_phi}))) AS dist FROM
        (SELECT feature, z, count(*) OVER (PARTITION BY feature) AS total, rank() OVER (PARTITION BY feature ORDER BY z) - 1 AS lo, count(*) OVER (PARTITION BY feature ORDER BY z RANGE UNBOUNDED PRECEDING) AS hi FROM
          ({' UNION ALL '.join(f"SELECT '{k}' AS feature, ({k} - {mu}) / {sd} AS z FROM b WHERE {k} IS NOT NULL" for k, (mu, sd) in _reference.items())})) GROUP BY feature))"""),
)
add("agg25_robust_exact", lambda s, d: seq.robust_parameters(bars(s, d), ["close", "volume", "ret"]), with_bars("SELECT c AS \"column\", " + cols("median=quantile_cont(v, 0.5);q1=quantile_cont(v, 0.25);q3=quantile_cont(v, 0.75);iqr=quantile_cont(v, 0.75) - quantile_cont(v, 0.25)") + " FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS c, {c} AS v FROM b" for c in ("close", "volume", "ret")) + ") GROUP BY c"))
add("agg25_robust_sketched", lambda s, d: seq.sketched_parameters(seq.sketched(bars(s, d).withColumn("year", F.year("date")), ["close", "volume", "ret"], ["year"])))
