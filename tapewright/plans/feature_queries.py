"""Registered queries over feature sets, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.operators import features as fea
from tapewright.operators import resampling
from tapewright.plans import indicator_queries
from tapewright.plans import sqltext as S
from tapewright.plans.bar_queries import with_bars
from tapewright.plans.indicator_queries import bars, rounded
from tapewright.plans.pattern_queries import PATTERNS, after_sql, cols, patterns
from tapewright.plans.sqltext import div, frame, over

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(query(spark, sf_dir))
    SQL[name] = sql


def register(name: str, function: Callable[[DataFrame], DataFrame], columns: dict[str, str], ctes: str = "", source: str = "b", raw: tuple[str, ...] = ()) -> None:
    add(name, lambda s, d: function(bars(s, d)).select("ticker", "date", *columns), S.select(S.PREPARED + (f",\n{ctes}" if ctes else ""), source, columns, raw=raw))


def flag(condition: str) -> str:
    return f"coalesce({condition}, false)"


def run_sql(condition: str) -> str:
    return f"CASE WHEN {condition} THEN least(rn - max(CASE WHEN {condition} THEN 0 ELSE rn END) OVER ({S.BY_DATE} ROWS UNBOUNDED PRECEDING), 5) ELSE 0 END"


_body, _span = "(close - open)", "(high - low)"
_prev = f"lag({_body}) OVER ({S.BY_DATE})"
register(
    "fea1_candles", fea.candles,
    {"body": _body, "body_share": "bs", "upper_shadow": "us", "lower_shadow": "ls", "close_place": "cp", "open_place": div("open - low", _span), "range_expansion": div(_span, over("avg", _span, 20)), "shadow_balance": "us - ls",
     "doji": flag("bs < 0.1"), "hammer": flag("bs < 0.3 AND ls > 0.6 AND cp > 0.7"), "shooting_star": flag("bs < 0.3 AND us > 0.6 AND cp < 0.3"),
     "bullish_engulfing": flag(f"{_body} > 0 AND {_prev} < 0 AND abs({_body}) > 1.2 * abs({_prev})"), "bearish_engulfing": flag(f"{_body} < 0 AND {_prev} > 0 AND abs({_body}) > 1.2 * abs({_prev})"),
     "rising_run": run_sql("close > open"), "falling_run": run_sql("close < open")},
    f"x AS (SELECT *, {div(f'abs({_body})', _span)} AS bs, {div('high - greatest(open, close)', _span)} AS us, {div('least(open, close) - low', _span)} AS ls, {div('close - low', _span)} AS cp FROM b)", "x",
    raw=("doji", "hammer", "shooting_star", "bullish_engulfing", "bearish_engulfing", "rising_run", "falling_run"),
)
register(
    "fea2_intrabar", fea.intrabar,
    {"opening_gap": "g", "reversal": div("(least(open, close) - low) + (high - greatest(open, close))", _span), "acceleration": div("m", "ret"), "gap_up": flag("g > 0.005"), "gap_down": flag("g < -0.005"), "persists": flag("sign(ret) = sign(m)"),
     "above_high": flag("close > ph"), "below_low": flag("close < pl"), "inside_bar": flag("high <= ph AND low >= pl"), "outside_bar": flag("high > ph AND low < pl")},
    f"x AS (SELECT *, {div('open - pc', 'pc')} AS g, {div(_body, 'open')} AS m, {S.lag('high')} AS ph, {S.lag('low')} AS pl FROM b)", "x",
    raw=("gap_up", "gap_down", "persists", "above_high", "below_low", "inside_bar", "outside_bar"),
)
register(
    "fea3_pressure", fea.pressure,
    {"buying": "u", "selling": "d", "range_per_volume": div(_span, f"(volume / ({over('avg', 'volume', 20)}))"), "net_pressure": div(f"({over('sum', 'u', 20)}) - ({over('sum', 'd', 20)})", over("sum", "volume", 20)),
     "volume_at_high": div(over("sum", "vh", 20), over("sum", "volume", 20)), "volume_at_low": div(over("sum", "vl", 20), over("sum", "volume", 20))},
    f"y AS (SELECT *, {div('close - low', _span)} AS cp FROM b), x AS (SELECT *, coalesce(volume * cp, 0) AS u, coalesce(volume * {div('high - close', _span)}, 0) AS d, CASE WHEN cp > 0.8 THEN volume ELSE 0 END AS vh, CASE WHEN cp < 0.2 THEN volume ELSE 0 END AS vl FROM y)", "x",
)
register(
    "fea4_efficiency", fea.efficiency,
    {"path_efficiency": div(f"abs(close - {S.lag('close', 20)})", over("sum", "abs(step)", 20)), "turning_points": over("sum", "turn", 20), "alternation": over("avg", "turn", 20), "smoothness": f"1 / (1 + {div(over('stddev_samp', 'step', 20), over('avg', 'abs(step)', 20))})"},
    f"y AS (SELECT *, close - pc AS step FROM b), x AS (SELECT *, CASE WHEN sign(step) * sign({S.lag('step')}) < 0 THEN 1.0 WHEN sign(step) * sign({S.lag('step')}) >= 0 THEN 0.0 END AS turn FROM y)", "x",
)
register(
    "fea5_band_profile", fea.quartile_profile,
    {"bbw_std": over("stddev_samp", "w", 20), "bbw_smooth": f"1 / (1 + {div(over('avg', 'd', 20), over('avg', 'w', 20))})", "bbw_slope": S.slope("w", 20), "bbw_range": f"({over('max', 'w', 20)}) - ({over('min', 'w', 20)})", "bbw_position": div(f"w - ({over('min', 'w', 20)})", f"(({over('max', 'w', 20)}) - ({over('min', 'w', 20)}))")},
    f"y AS (SELECT *, {div('4 * (' + over('stddev_samp', 'close', 20) + ')', over('avg', 'close', 20))} AS w FROM b), x AS (SELECT *, abs(w - {S.lag('w')}) AS d FROM y)", "x",
)
register(
    "fea6_regime_shifts", fea.regime_shifts,
    {"z": "z", "shift": "sh", "regime": "CASE WHEN z > 2 THEN 1 WHEN z < -2 THEN -1 ELSE 0 END", "rows_since_shift": f"rn - last_value(CASE WHEN sh THEN rn END IGNORE NULLS) OVER ({S.BY_DATE} ROWS UNBOUNDED PRECEDING)"},
    f"y AS (SELECT *, {div('4 * (' + over('stddev_samp', 'close', 20) + ')', over('avg', 'close', 20))} AS w FROM b), v AS (SELECT *, {div('w - (' + over('avg', 'w', 20, back=1) + ')', over('stddev_samp', 'w', 20, back=1))} AS z FROM y), x AS (SELECT *, coalesce(abs(z) > 2, false) AS sh FROM v)", "x",
    raw=("shift", "regime", "rows_since_shift"),
)
register(
    "fea7_volume_build_up", fea.volume_build_up,
    {"volume_3": over("avg", "volume", 3), "volume_5": over("avg", "volume", 5), "rows_above_5": over("sum", "a", 5), "volume_momentum": f"{div(over('avg', 'volume', 3), over('avg', 'volume', 10))} - 1", "strength_7": div(over("avg", "volume", 7), "m"), "strength_10": div(over("avg", "volume", 10), "m"), "volume_trend": f"sign(round({S.slope('volume', 10)}, 6))"},
    f"y AS (SELECT *, {over('avg', 'volume', 20)} AS m FROM b), x AS (SELECT *, CASE WHEN volume > m THEN 1.0 WHEN volume <= m THEN 0.0 END AS a FROM y)", "x",
)
_cmp = {c: div(over("avg", e, 20), over("avg", e, 30, back=20)) for c, e in (("bbw", "w"), ("volume", "volume"), ("span_share", "ss"))}
register(
    "fea12_against_baseline", fea.against_baseline, {"bbw_compression": "c1", "volume_compression": "c2", "span_share_compression": "c3", "compression_score": "list_avg([greatest(0, 1 - v) for v in [c1, c2, c3] if v IS NOT NULL])"},
    f"y AS (SELECT *, {div('4 * (' + over('stddev_samp', 'close', 20) + ')', over('avg', 'close', 20))} AS w, {div(_span, 'close')} AS ss FROM b), x AS (SELECT *, {_cmp['bbw']} AS c1, {_cmp['volume']} AS c2, {_cmp['span_share']} AS c3 FROM y)", "x",
)
register("ind32_boundary_slopes", fea.boundary_slopes, {f"{k}_slope": S.clip(div(S.slope(c, 5), f"((({over('max', 'high', 20)}) - ({over('min', 'low', 20)})) / 5)"), -3, 3) for k, c in (("upper", "high"), ("lower", "low"))})
register("ind34_log_differences", fea.log_differences, {k: f"CASE WHEN v60 IS NOT NULL THEN ln(1 + greatest({a}, 0)) - ln(1 + greatest({b}, 0)) END" for k, a, b in (("volume_log_diff", "v5", "v60"), ("range_log_diff", "r5", "r60"))},
         f"x AS (SELECT *, {over('avg', 'volume', 5)} AS v5, {over('avg', 'volume', 60)} AS v60, {over('avg', _span, 5)} AS r5, {over('avg', _span, 60)} AS r60 FROM b)", "x")
_dm = indicator_queries._dm
ADX_SIMPLE = f"""{_dm},
dn AS (SELECT *, {over('avg', 'plus_dm', 14)} AS p, {over('avg', 'minus_dm', 14)} AS q, {over('avg', 'tr', 14)} AS a FROM m),
dx0 AS (SELECT *, 100 * {div('p', 'a')} AS pd, 100 * {div('q', 'a')} AS md FROM dn),
dx1 AS (SELECT *, 100 * {div('abs(pd - md)', 'pd + md')} AS dx FROM dx0),
ax AS (SELECT *, coalesce({over('avg', 'dx', 14)}, 50) AS adx_filled, {div('volume', over('avg', 'volume', 30))} AS rvol FROM dx1)"""
register("ind41_relative_volume", fea.relative_volume, {"rvol": "rvol", "money": "close * volume", "adx_filled": "adx_filled"}, ADX_SIMPLE, "ax")
register(
    "ind29_hurst", fea.hurst, {"hurst": "CASE WHEN rn >= 50 AND len(p) >= 2 THEN 2 * (len(p) * sxy - sx * sy) / nullif(len(p) * sxx - sx * sx, 0) END"},
    f"""w AS (SELECT ticker, date, rn, list(close) OVER {frame(-49, 0)} AS w FROM b),
k AS (SELECT w.*, r.k, list_var_pop([w[i + r.k] - w[i] for i in range(1, 51 - r.k)]) AS vp FROM w, range(2, 20) AS r(k) WHERE rn >= 50),
h AS (SELECT ticker, date, rn, list(k) FILTER (vp > 0) AS p, sum(ln(k)) FILTER (vp > 0) AS sx, sum(ln(sqrt(sqrt(vp)))) FILTER (vp > 0) AS sy, sum(ln(k) * ln(k)) FILTER (vp > 0) AS sxx, sum(ln(k) * ln(sqrt(sqrt(vp)))) FILTER (vp > 0) AS sxy FROM k GROUP BY ticker, date, rn
      UNION ALL SELECT ticker, date, rn, [], 0, 0, 0, 0 FROM w WHERE rn < 50)""", "h",
)
_bbw = div("4 * (" + over("stddev_samp", "close", 20) + ")", over("avg", "close", 20))
_in = lambda x: f"least(greatest({x}, 0), 1)"
IGNITION = f"""{ADX_SIMPLE}, ig0 AS (SELECT *, {_bbw} AS w, {div('close - (' + over('min', 'low', 20) + ')', f"(({over('max', 'high', 20)}) - ({over('min', 'low', 20)}))")} AS po FROM ax),
ig AS (SELECT *, CASE WHEN po IS NULL OR rvol IS NULL OR ({S.slope('w', 5)}) IS NULL THEN NULL ELSE 0.4 * {_in('po')} + 0.3 * {_in('(rvol - 1) / 2')} + 0.15 * CAST(({S.slope('w', 5)}) > 0 AS INTEGER) + 0.1 * CAST(close > open AS INTEGER) + 0.05 * {_in('adx_filled / 50')} END AS ignition FROM ig0)"""
register("fea27_ignition", fea.ignition, {"ignition": "ignition", "ignites": "ignition >= 0.5"}, IGNITION, "ig", raw=("ignites",))
register(
    "fea24_relative_strength", fea.relative_strength, {"ret_n": "r", "relative": "r - cohort"},
    f"y AS (SELECT *, {div('close', S.lag('close', 20))} - 1 AS r FROM b), m AS (SELECT date, quantile_cont(r, 0.5) AS m, count(r) AS k FROM y GROUP BY date), c AS (SELECT date, last_value(CASE WHEN k >= 3 THEN m END IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS cohort FROM m)", "y JOIN c USING (date)",
)
add(
    "ind39_weekly_set", lambda s, d: fea.weekly_set(resampling.weekly(bars(s, d)).withColumnRenamed("week", "date")).select("ticker", "date", "bbw", "sma_20", "sma_50", "to_20", "to_50"),
    with_bars(f"SELECT ticker, CAST(date AS VARCHAR) AS date, {cols(f'bbw={_bbw} * 100;sma_20={over("avg", "close", 20)};sma_50={over("avg", "close", 50)};to_20={div("close", over("avg", "close", 20))};to_50={div("close", over("avg", "close", 50))}')} FROM wk",
              "wk AS (SELECT ticker, CAST(date + CAST((12 - isodow(date)) % 7 AS INTEGER) AS DATE) AS date, arg_max(close, date) AS close FROM b GROUP BY 1, 2)"),
)

# windows of patterns
INSIDE = """i0 AS (SELECT p.*, y.date AS b_date, y.open AS b_open, y.high AS b_high, y.low AS b_low, y.close AS b_close, y.volume AS b_volume FROM p JOIN b AS y ON y.ticker = p.ticker AND y.date BETWEEN p.start_date AND p.end_date),
i1 AS (SELECT *, row_number() OVER w AS pl, count(*) OVER (PARTITION BY pattern_id) AS n, lag(b_close) OVER w AS b_prev FROM i0 WINDOW w AS (PARTITION BY pattern_id ORDER BY b_date)),
i AS (SELECT *, b_close / nullif(b_prev, 0) - 1 AS b_ret FROM i1)"""


def window(name: str, function: Callable, body: str, more: str = "") -> None:
    add(name, lambda s, d: function(patterns(s, d), bars(s, d)), with_bars(body, f"{PATTERNS},\n{INSIDE}" + (f",\n{more}" if more else "")))


_pos = "(b_close - lower) / nullif(upper - lower, 0)"
_hi, _lo = "b_close >= upper - 0.25 * (upper - lower)", "b_close <= lower + 0.25 * (upper - lower)"
_ut, _lt = "b_high >= upper * 0.995", "b_low <= lower * 1.005"
window(
    "fea15_place_in_range", fea.place_in_range,
    f"SELECT pattern_id, {cols(f'mean_position=avg({_pos});time_high=avg(CAST({_hi} AS INTEGER));time_low=avg(CAST({_lo} AS INTEGER));time_middle=avg(CAST(NOT ({_hi}) AND NOT ({_lo}) AS INTEGER));final_position=arg_max({_pos}, pl);touch_ratio=(count(*) FILTER ({_ut}) + count(*) FILTER ({_lt})) / CAST(count(*) AS DOUBLE);touch_balance=coalesce(count(*) FILTER ({_ut}) / nullif(CAST(count(*) FILTER ({_ut}) + count(*) FILTER ({_lt}) AS DOUBLE), 0), 0.5)')}, count(*) FILTER ({_ut}) AS upper_touches, count(*) FILTER ({_lt}) AS lower_touches, count(*) - coalesce(max(pl) FILTER ({_ut}), 0) AS rows_since_upper, count(*) - coalesce(max(pl) FILTER ({_lt}), 0) AS rows_since_lower, count(*) AS n FROM i GROUP BY pattern_id",
)
_skew = "avg((b_ret - mr) * (b_ret - mr) * (b_ret - mr)) / nullif(pow(avg((b_ret - mr) * (b_ret - mr)), 1.5), 0)"
window(
    "fea16_volume_and_volatility", fea.volume_and_volatility,
    f"SELECT pattern_id, {cols(f'volume_slope=regr_slope(b_volume, pl);volume_cv=stddev_pop(b_volume) / nullif(avg(b_volume), 0);volume_contraction=CASE WHEN count(*) >= 20 THEN avg(b_volume) FILTER (pl > n - 10) / nullif(avg(b_volume) FILTER (pl <= 10), 0) END;ret_mean=avg(b_ret);ret_std=stddev_pop(b_ret);ret_skew={_skew};mean_range=avg((b_high - b_low) / nullif(b_low, 0) * 100);range_std=stddev_pop((b_high - b_low) / nullif(b_low, 0) * 100);mean_true_range=avg(tr1);atr_percent=avg(tr1) / nullif(avg(b_close), 0) * 100')}, count(*) FILTER (b_volume > mv + 2 * sv) AS volume_spikes FROM k GROUP BY pattern_id",
    "k AS (SELECT *, avg(b_volume) OVER e AS mv, stddev_pop(b_volume) OVER e AS sv, avg(b_ret) OVER e AS mr, CASE WHEN pl > 1 THEN greatest(b_high - b_low, abs(b_high - b_prev), abs(b_low - b_prev)) END AS tr1 FROM i WINDOW e AS (PARTITION BY pattern_id))",
)
window(
    "fea17_quality", fea.quality,
    f"SELECT pattern_id, {cols('tightness=t;consistency=c;compression=k;balance=q;overall=(least(t * 10, 1) + c + q + (1 - least(k, 1))) / 4')} FROM o",
    "o AS (SELECT pattern_id, 1 / (max((upper - lower) / nullif(lower, 0)) * 100) AS t, 1 - avg(CAST(b_high > upper * 1.01 OR b_low < lower * 0.99 AS INTEGER)) AS c, coalesce(stddev_pop(b_ret) FILTER (pl > n // 2 + 1) / nullif(stddev_pop(b_ret) FILTER (pl <= n // 2 AND pl > 1), 0), 1) AS k, 1 - abs(avg(CAST(b_close > (upper + lower) / 2 AS INTEGER)) - avg(CAST(b_close <= (upper + lower) / 2 AS INTEGER))) AS q FROM i GROUP BY pattern_id)",
)
window(
    "fea18_gaps", fea.gaps,
    f"SELECT pattern_id, count(*) FILTER (g > 0.01) AS gaps_up, count(*) FILTER (g < -0.01) AS gaps_down, {cols('mean_gap=avg(abs(g)) FILTER (abs(g) > 0.01);fill_rate=avg(CAST((g > 0.01 AND b_low <= b_prev) OR (g < -0.01 AND b_high >= b_prev) AS INTEGER)) FILTER (abs(g) > 0.01)')} FROM k GROUP BY pattern_id",
    "k AS (SELECT *, b_open / nullif(b_prev, 0) - 1 AS g FROM i)",
)
COIL = f"""c0 AS (SELECT *, {_bbw} AS w, {div(over('max', 'volume', 3), over('avg', 'volume', 20, back=3))} AS shock, {div(over('avg', 'volume', 5), over('avg', 'volume', 20))} - 1 AS trend FROM b),
c1 AS (SELECT *, {S.slope('w', 5)} AS ws FROM c0),
cl AS (SELECT p.*, y.w, y.shock, y.trend, y.ws, (p.close - lower) / nullif(upper - lower, 0) AS po FROM p JOIN c1 AS y ON y.ticker = p.ticker AND y.rn = p.end_rn)"""
COIL_INTENSITY = "(least(greatest(1 - po, 0), 1) + CASE WHEN ws < 0 THEN 1 ELSE 0 END + CASE WHEN trend < 0 THEN 1 ELSE 0 END) / 3.0"
add("fea21_coil_at_end", lambda s, d: fea.coil_at_end(patterns(s, d), bars(s, d)), with_bars(f"SELECT pattern_id, {cols(f'price_position=po;volume_shock=shock;bbw=w;bbw_slope=ws;volume_trend=trend;coil_intensity={COIL_INTENSITY}')}, CAST(po <= 0.3 AS INTEGER) AS in_danger FROM cl", f"{PATTERNS},\n{COIL}"))
PEAKS = """k0 AS (SELECT *, arg_min(day, struct_pack(c := -b_close, d := day)) OVER (PARTITION BY pattern_id) AS pk, b_close / lag(b_close) OVER (PARTITION BY pattern_id ORDER BY day) - 1 AS rt FROM j),
k1 AS (SELECT pattern_id, close, pk, count(*) AS n, max(b_close) AS peak, min(b_close) AS least, arg_min(day, struct_pack(c := b_close, d := day)) AS td, arg_max(b_close, day) AS last, min(b_close) FILTER (day >= pk) AS la,
  count(*) FILTER (day BETWEEN 1 AND pk AND rt > 0) AS rising, stddev_pop(rt) FILTER (day BETWEEN 1 AND pk) AS sd FROM k0 GROUP BY 1, 2, 3),
k2 AS (SELECT *, peak / close - 1 AS g, last / close - 1 AS e, CASE WHEN pk < 99 THEN la / peak - 1 ELSE 0 END AS fall, CASE WHEN pk > 0 THEN (peak / close - 1) / pk ELSE 0 END AS vel, CASE WHEN peak > close THEN (last / close - 1) / (peak / close - 1) ELSE 0 END AS st FROM k1),
k AS (SELECT pattern_id, n, """ + ", ".join(f"CASE WHEN n >= 100 THEN {x} ELSE 0 END AS {c}" for c, x in {
    "peak_day": "pk", "trough_day": "td", "fwd_gain": "g", "fwd_loss": "least / close - 1", "fwd_end": "e", "fwd_velocity": "vel", "fwd_sustainability": "st", "fwd_retention": S.clip("st", 0, 1), "fwd_fall": "fall",
    "fwd_recovery": "CASE WHEN fall < -0.05 AND last > peak * 0.95 THEN 1.0 WHEN fall < -0.05 AND last > peak * 0.9 THEN 0.5 ELSE 0 END", "fwd_consistency": "CASE WHEN pk > 1 THEN rising / pk ELSE 0 END", "fwd_spread": "CASE WHEN pk > 1 THEN sd ELSE 0 END",
    "explosive": "CAST(vel > 0.03 AND pk <= 30 AND g >= 0.4 AS INTEGER)", "grind": "CAST(pk > 60 AND g >= 0.4 AS INTEGER)", "peak_at": "pk / 99.0",
}.items()) + " FROM k2)"
_peaks = f"{PATTERNS},\n{after_sql(99, 0)},\n{PEAKS}"
_timing = "CASE WHEN n < 100 THEN 'unknown' WHEN peak_at < 0.33 THEN 'early' WHEN peak_at < 0.66 THEN 'mid' ELSE 'late' END AS timing"
_rounded = ";".join(f"{c}={c}" for c in ("fwd_gain", "fwd_loss", "fwd_end", "fwd_velocity", "fwd_sustainability", "fwd_retention", "fwd_fall", "fwd_recovery", "fwd_consistency", "fwd_spread", "peak_at"))
add("fea25_time_to_peak", lambda s, d: fea.time_to_peak(patterns(s, d), bars(s, d)), with_bars(f"SELECT pattern_id, CAST(peak_day AS INTEGER) AS peak_day, CAST(trough_day AS INTEGER) AS trough_day, {cols(_rounded)}, CAST(explosive AS INTEGER) AS explosive, CAST(grind AS INTEGER) AS grind, {_timing} FROM k", _peaks))
_fast = "fwd_velocity > 0.025 AND fwd_gain >= 0.4"
_moves = f"CASE WHEN {_fast} AND fwd_sustainability > 0.7 THEN 'explosive_high_quality' WHEN {_fast} AND fwd_sustainability < 0.5 THEN 'explosive_reversal' WHEN peak_day > 60 AND fwd_gain >= 0.4 THEN 'slow_grind' WHEN fwd_velocity > 0.015 AND fwd_gain >= 0.25 AND fwd_sustainability > 0.6 THEN 'moderate_quality' WHEN fwd_gain < 0.15 THEN 'failed' ELSE 'mixed' END"
_worth = "CASE move WHEN 'explosive_high_quality' THEN 1.0 WHEN 'explosive_reversal' THEN 0.5 WHEN 'slow_grind' THEN 0.3 WHEN 'moderate_quality' THEN 0.6 WHEN 'failed' THEN 0.0 ELSE 0.4 END"
add("fea26_move_class", lambda s, d: fea.move_class(fea.time_to_peak(patterns(s, d), bars(s, d))).select("pattern_id", "move", "move_score"), with_bars(f"SELECT pattern_id, move, {cols(f'move_score={_worth}')} FROM (SELECT *, {_moves} AS move FROM k)", _peaks))
_ctx = {"box_width": "box_width", "to_sma_200": "close / nullif(c_sma, 0)", "to_high_252": "close / nullif(c_high, 0)", "money_log": "ln(1 + money)", "volume_log_diff": "c_vol", "range_log_diff": "c_range", "ret_20": "c_ret", "bbw": "c_bbw", "position": "(close - lower) / nullif(upper - lower, 0)", "vol_decay": "c_decay"}
_scaled = ";".join(f"{k}=coalesce((({S.clip(x, *fea.CONTEXT_RANGES[k])}) - {fea.CONTEXT_RANGES[k][0]}) / {fea.CONTEXT_RANGES[k][1] - fea.CONTEXT_RANGES[k][0]}, 0.5)" for k, x in _ctx.items())
CONTEXT = f"""q0 AS (SELECT ticker, rn, {over('avg', 'close', 200)} AS c_sma, max(high) OVER {frame(-251, 0)} AS c_high, {div('close', S.lag('close', 20))} - 1 AS c_ret, {_bbw} AS c_bbw, {S.slope('ln(1 + volume)', 20)} AS c_decay,
  CASE WHEN ({over('avg', 'volume', 60)}) IS NOT NULL THEN ln(1 + ({over('avg', 'volume', 5)})) - ln(1 + ({over('avg', 'volume', 60)})) END AS c_vol, CASE WHEN ({over('avg', 'volume', 60)}) IS NOT NULL THEN ln(1 + ({over('avg', _span, 5)})) - ln(1 + ({over('avg', _span, 60)})) END AS c_range FROM b),
q AS (SELECT p.*, q0.* EXCLUDE (ticker, rn) FROM p JOIN q0 ON q0.ticker = p.ticker AND q0.rn = p.end_rn)"""
add("fea22_context_vector", lambda s, d: fea.context_vector(patterns(s, d), bars(s, d)), with_bars(f"SELECT pattern_id, {cols(_scaled)} FROM q", f"{PATTERNS},\n{CONTEXT}"))
_fs = ["box_width", "mean_volume", "money", "close"]
_pairs = [(a, b) for i, a in enumerate(_fs) for b in _fs[i:]]
add(
    "fea10_interaction_importance", lambda s, d: fea.interaction_importance(patterns(s, d).withColumn("target", F.col("end_rn").cast("double")), _fs, "target"),
    with_bars("SELECT feature, " + cols("importance=importance") + " FROM (" + " UNION ALL ".join(f"SELECT '{a}*{b}' AS feature, abs(corr({a} * {b}, CAST(end_rn AS DOUBLE))) AS importance FROM p" for a, b in _pairs) + ") ORDER BY importance DESC, feature LIMIT 10", PATTERNS),
)
