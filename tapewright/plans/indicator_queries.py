"""Registered indicator queries, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.functions.rolling import prepared
from tapewright.operators import indicators as ind
from tapewright.plans import sqltext as S
from tapewright.plans.sqltext import div, over
from tapewright.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to four places, so that engines that add in another order agree; dates as text, conditions as 0 and 1."""
    shown = {"double": lambda c: F.round(F.col(c) + S.SHIFT, 4) + 0.0, "date": lambda c: F.col(c).cast("string"), "timestamp": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss"), "boolean": lambda c: F.col(c).cast("int")}
    return df.select(*[shown.get(kind, F.col)(c).alias(c) for c, kind in df.dtypes])


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(tables.bars(spark, sf_dir))


def register(name: str, function: Callable[[DataFrame], DataFrame], columns: dict[str, str], ctes: str = "", source: str = "b", raw: tuple[str, ...] = (), before: str = "") -> None:
    """A query of the function over prepared bars, and the SQL of its columns over ``source`` after ``ctes``."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(function(bars(spark, sf_dir)).select("ticker", "date", *columns))

    QUERIES[name] = query
    SQL[name] = S.select(S.PREPARED + (f",\n{ctes}" if ctes else ""), source, columns, raw=raw)


register("ind1_moving_averages", ind.moving_averages, {f"sma_{n}": over("avg", "close", n) for n in (5, 20, 50)})

_std = "stddev_samp"
register(
    "ind2_bollinger", ind.bollinger, {"bbw": f"{div('4 * s', 'm')} * 100", "bbw_safe": div("4 * ps", "pm"), "bb_position": div("close - (m - 2 * s)", "4 * s")},
    f"x AS (SELECT *, {over('avg', 'close', 20)} AS m, {over(_std, 'close', 20)} AS s, {over('avg', 'close', 20, back=1)} AS pm, {over(_std, 'close', 20, back=1)} AS ps FROM b)", "x",
)
register("ind5_true_range", lambda b: b, {"tr": "tr", "ret": "ret"})
register(
    "ind6_atr", ind.atr, {"atr_simple": over("avg", "t", 14, 1), "atr_wilder": "atr_wilder"},
    "x AS (SELECT *, greatest(high - low, abs(high - coalesce(pc, close)), abs(low - coalesce(pc, close))) AS t FROM b),\n" + S.ewm("e", "b", {"atr_wilder": ("tr", 1 / 14)}), "x JOIN e USING (ticker, rn)",
)
register("ind8_ema", ind.moving_exponentials, {"ema_12": "ema_12", "ema_26": "ema_26"}, S.ewm("e", "b", {"ema_12": ("close", 2 / 13), "ema_26": ("close", 2 / 27)}), "b JOIN e USING (ticker, rn)")
_dm = f"""m0 AS (SELECT *, coalesce(high - {S.lag('high')}, 0) AS up, coalesce({S.lag('low')} - low, 0) AS down FROM b),
m AS (SELECT *, CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS plus_dm, CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS minus_dm FROM m0)"""
_di = "100 * p / (a + 1e-10) AS plus_di, 100 * q / (a + 1e-10) AS minus_di"
register(
    "ind9_adx", ind.adx, {"plus_di": "plus_di", "minus_di": "minus_di", "adx": "adx"},
    f"""{_dm},
{S.ewm('e', 'm', {'p': ('plus_dm', 1 / 14), 'q': ('minus_dm', 1 / 14), 'a': ('tr', 1 / 14)})},
d0 AS (SELECT ticker, rn, {_di} FROM e),
d AS (SELECT *, 100 * abs(plus_di - minus_di) / (plus_di + minus_di + 1e-10) AS dx FROM d0),
{S.ewm('f', 'd', {'adx': ('dx', 1 / 14)})}""", "b JOIN d USING (ticker, rn) JOIN f USING (ticker, rn)",
)
register(
    "ind10_adx_simple", ind.adx_simple, {"adx_simple": over("avg", "dx", 14)},
    f"""{_dm},
n AS (SELECT *, {over('avg', 'plus_dm', 14)} AS p, {over('avg', 'minus_dm', 14)} AS q, {over('avg', 'tr', 14)} AS a FROM m),
o AS (SELECT *, 100 * {div('p', 'a')} AS pd, 100 * {div('q', 'a')} AS md FROM n),
x AS (SELECT *, 100 * {div('abs(pd - md)', 'pd + md')} AS dx FROM o)""", "x",
)
register(
    "ind11_rsi", ind.rsi, {"rsi": "100 - 100 / (1 + eg / (el + 1e-10))", "rsi_simple": f"100 - 100 / (1 + {over('avg', 'g', 14)} / ({over('avg', 'l', 14)} + 1e-10))"},
    f"x AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(close - pc, 0) END AS g, CASE WHEN pc IS NOT NULL THEN greatest(pc - close, 0) END AS l FROM b),\n{S.ewm('e', 'x', {'eg': ('g', 1 / 14), 'el': ('l', 1 / 14)})}", "x JOIN e USING (ticker, rn)",
)
register(
    "ind12_macd", ind.macd, {"macd": "macd", "macd_signal": "macd_signal", "macd_hist": "macd - macd_signal"},
    f"""{S.ewm('e', 'b', {'f': ('close', 2 / 13), 's': ('close', 2 / 27)})},
m AS (SELECT ticker, rn, f - s AS macd FROM e),
{S.ewm('g', 'm', {'macd_signal': ('macd', 2 / 10)})}""", "b JOIN m USING (ticker, rn) JOIN g USING (ticker, rn)",
)
register(
    "ind13_stochastic", ind.stochastic, {"stoch_k": "k", "stoch_d": over("avg", "k", 3), "williams_r": "k - 100"},
    f"""y AS (SELECT *, {over('min', 'low', 14)} AS lo, {over('max', 'high', 14)} AS hi FROM b),
x AS (SELECT *, 100 * {div('close - lo', 'hi - lo')} AS k FROM y)""", "x",
)
register(
    "ind14_cci", ind.cci, {"cci": "(tp - m) / (0.015 * list_avg([abs(v - m) for v in w]) + 1e-10)"},
    f"""y AS (SELECT *, (high + low + close) / 3 AS tp FROM b),
x AS (SELECT *, {over('avg', 'tp', 20)} AS m, list(tp) OVER {S.frame(-19, 0)} AS w FROM y)""", "x",
)
_flow = "CASE WHEN high > low THEN ((close - low) - (high - close)) / (high - low) ELSE 0 END * volume"
register("ind15_volume_lines", ind.volume_lines, {"obv": S.sofar("sum(coalesce(sign(close - pc), 0) * volume)"), "ad_line": S.sofar(f"sum({_flow})"), "vpt": S.sofar("sum(coalesce(ret, 0) * volume)")})
register(
    "ind17_money_flow", ind.money_flow, {"chaikin": "c - d", "mfi": f"100 - 100 / (1 + {over('sum', 'up', 14)} / ({over('sum', 'dn', 14)} + 1e-10))"},
    f"""y AS (SELECT *, (high + low + close) / 3 AS tp, {S.sofar(f'sum({_flow})')} AS ad FROM b),
z AS (SELECT *, tp - {S.lag('tp')} AS ch FROM y),
x AS (SELECT *, CASE WHEN ch > 0 THEN tp * volume ELSE 0 END AS up, CASE WHEN ch < 0 THEN tp * volume ELSE 0 END AS dn FROM z),
{S.ewm('e', 'y', {'c': ('ad', 2 / 4), 'd': ('ad', 2 / 11)})}""", "x JOIN e USING (ticker, rn)",
)
register("ind18_returns", ind.returns, {f"roc_{n}": f"{div('close', S.lag('close', n))} - 1" for n in (1, 5, 20)} | {"log_return": f"ln({div('close', 'pc')})"})
register(
    "ind19_volatility", ind.volatility, {"vol_5": "v5", "vol_20": "v20", "vol_ratio_5": div("v5", over("avg", "v5", 50)), "vol_ratio_20": div("v20", over("avg", "v20", 50))},
    f"x AS (SELECT *, {over(_std, 'ret', 5)} * sqrt(252) AS v5, {over(_std, 'ret', 20)} * sqrt(252) AS v20 FROM b)", "x",
)
register(
    "ind20_channels", ind.channels, {"keltner": div("close - (m - 2 * a)", "4 * a"), "supertrend": f"{over('avg', 'close', 10)} + 2 * {over('avg', 'tr', 14)}"},
    f"x AS (SELECT *, {over('avg', 'close', 20)} AS m, {over('avg', 'tr', 10)} AS a FROM b)", "x",
)
_up, _dn = f"arg_max(rn, (high, rn)) OVER {S.frame(-14, 0)}", f"arg_max(rn, (-low, rn)) OVER {S.frame(-14, 0)}"
register(
    "ind21_aroon", ind.aroon, {"aroon_up": "u", "aroon_down": "d", "aroon_osc": "u - d"},
    f"""x AS (SELECT *, CASE WHEN rn > 14 THEN (14 - (rn - [v.r for v in list({{'k': high, 'r': rn}}) OVER {S.frame(-14, 0)} if v.k = max(high) OVER {S.frame(-14, 0)}][-1])) * 100 / 14.0 END AS u,
                    CASE WHEN rn > 14 THEN (14 - (rn - [v.r for v in list({{'k': low, 'r': rn}}) OVER {S.frame(-14, 0)} if v.k = min(low) OVER {S.frame(-14, 0)}][-1])) * 100 / 14.0 END AS d FROM b)""", "x",
)
_tp = "(high + low + close) / 3"
register("ind22_vwap", ind.vwap, {
    "vwap_20": div(over("sum", "close * volume", 20), over("sum", "volume", 20)), "vwap_tp_5": div(over("sum", f"{_tp} * volume", 5), over("sum", "volume", 5)),
    "vwap_all": f"{S.sofar(f'sum({_tp} * volume)')} / {S.sofar('sum(volume)')}"})
register("ind23_volume_ratios", ind.volume_ratios, {
    "volume_ratio": div("volume", over("avg", "volume", 20)), "volume_ratio_safe": div("volume", over("avg", "volume", 20, back=1)),
    "dry_up": div(over("avg", "volume", 3, back=1), over("avg", "volume", 20, back=1))})
register("ind24_daily_range", ind.daily_range, {"range": "high - low", "range_share": div("high - low", "close"), "range_ratio": div("high - low", over("avg", "high - low", 20))})
_w = f"list(close) OVER {S.frame(-99, 0)}"
register(
    "ind25_percentile_rank", lambda b: ind.percentile_rank(b, "close"), {"pct_rank": "CASE WHEN rn = 1 THEN 0.5 ELSE len([v for v in w if v < close]) / CAST(len(w) AS DOUBLE) END"}, f"x AS (SELECT *, {_w} AS w FROM b)", "x",
)
register(
    "ind26_average_rank", lambda b: ind.average_rank(b, "close"), {"avg_rank": "CASE WHEN len(w) >= 50 THEN (len([v for v in w if v < close]) + (len([v for v in w if v = close]) + 1) / 2.0) / len(w) END"}, f"x AS (SELECT *, {_w} AS w FROM b)", "x",
)
_m20 = over("avg", "close", 20)
register(
    "ind27_distribution", ind.distribution, {"q25": "q25", "q75": "q75", "iqr": "q75 - q25", "zscore": div("close - m", "s"), "skew": "CASE WHEN n >= 20 THEN list_skewness(w) END"},
    f"""x AS (SELECT *, {over('quantile_cont({}, 0.25)', 'close', 20)} AS q25, {over('quantile_cont({}, 0.75)', 'close', 20)} AS q75, {_m20} AS m, {over(_std, 'close', 20)} AS s,
                    list(close) OVER {S.frame(-19, 0)} AS w, count(close) OVER {S.frame(-19, 0)} AS n FROM b)""", "x",
)
register(
    "ind28_autocorrelation", ind.autocorrelation,
    {f"autocorr_{k}": f"CASE WHEN count(CASE WHEN l{k} IS NOT NULL THEN ret END) OVER {S.frame(k - 19, 0)} = {20 - k} THEN corr(ret, l{k}) OVER {S.frame(k - 19, 0)} END" for k in (1, 5)},
    f"x AS (SELECT *, {S.lag('ret', 1)} AS l1, {S.lag('ret', 5)} AS l5 FROM b)", "x",
)
register("ind30_slopes", ind.slopes, {"slope_5": S.slope("close", 5), "slope_20": S.slope("close", 20), "vol_decay": S.clip(S.slope("ln(1 + volume)", 20), -0.5, 0.5)})
register(
    "ind31_slope_agreement", ind.rank_in_window, {"slope_agreement": "1 / (1 + " + div("sqrt((pow(s5 - m, 2) + pow(s10 - m, 2) + pow(s20 - m, 2)) / 3)", "abs(m)") + ")", "slope_divergence": "s5 - s20", "reversal": "sign(s5) <> sign(s20)"},
    f"""y AS (SELECT *, {S.slope('close', 5)} AS s5, {S.slope('close', 10)} AS s10, {S.slope('close', 20)} AS s20 FROM b),
x AS (SELECT *, (s5 + s10 + s20) / 3 AS m FROM y)""", "x", raw=("reversal",),
)
register(
    "ind33_levels", ind.levels,
    {"pivot_level": "pv", "r1": f"2 * pv - {S.lag('low')}", "s1": f"2 * pv - {S.lag('high')}", "break_up": f"close > {over('max', 'high', 20, back=1)}", "break_down": f"close < {over('min', 'low', 20, back=1)}",
     "higher_high": f"high > {S.lag('high')}", "lower_low": f"low < {S.lag('low')}", "doji": "abs(close - open) <= 0.1 * (high - low)", "engulfing": f"close > open AND pc < {S.lag('open')} AND close > {S.lag('open')} AND open < pc"},
    f"x AS (SELECT *, ({S.lag('high')} + {S.lag('low')} + pc) / 3 AS pv FROM b)", "x", raw=("break_up", "break_down", "higher_high", "lower_low", "doji", "engulfing"),
)
register(
    "ind37_composites", ind.composites, {"var_score": f"tanh(vz * (1 + r20))", "nes_score": f"tanh({div('e - ' + '(' + over('avg', 'e', 10) + ')', over(_std, 'e', 10))})", "lpf_score": div(over("sum", "sv", 14), over("sum", "v1", 14))},
    f"""x AS (SELECT *, {div('close', S.lag('close', 20))} - 1 AS r20, {div('volume - (' + over('avg', 'volume', 20) + ')', over(_std, 'volume', 20))} AS vz, ret * ret * volume AS e,
                    sign(ret) * volume AS sv, CASE WHEN ret IS NOT NULL THEN volume END AS v1 FROM b)""", "x",
)
register(
    "ind38_bundle", ind.bundle,
    {"volume_sum_5": over("sum", "volume", 5), "volume_sum_60": over("sum", "volume", 60), "volume_median_126": "CASE WHEN md = 0 THEN 1 ELSE md END", "sma_200": over("avg", "close", 200), "high_252": over("max", "high", 252), "money_20": over("avg", "close * volume", 20), "money_60": over("avg", "close * volume", 60)},
    f"x AS (SELECT *, {over('quantile_cont({}, 0.5)', 'volume', 126)} AS md FROM b)", "x",
)
register(
    "ind42_trend_quality", ind.trend_quality,
    {"part_mean": f"avg(close) OVER {S.frame(-19, 0)}", "part_std": f"stddev_pop(close) OVER {S.frame(-19, 0)}", "part_median": f"quantile_cont(close, 0.5) OVER {S.frame(-19, 0)}", "trend_r2": f"CASE WHEN rn >= 20 THEN regr_r2(close, rn) OVER {S.frame(-19, 0)} END", "compression": f"({over('avg', 'tr', 10)}) / greatest({over('avg', 'tr', 50)}, 1e-4)"},
)
register(
    "fea23_obv_divergence", ind.obv_divergence, {"obv_divergence": S.clip("CASE WHEN a IS NOT NULL AND c IS NOT NULL THEN ln(1 + greatest(a, 0)) - ln(1 + greatest(c, 0)) END", -5, 5)},
    f"""y AS (SELECT *, {S.sofar('sum(coalesce(sign(close - pc), 0) * volume)')} AS obv FROM b),
x AS (SELECT *, {div(S.slope('obv', 21), over('stddev_pop', 'obv', 21))} AS a, {div(S.slope('close', 21), over('stddev_pop', 'close', 21))} AS c FROM y)""", "x",
)
