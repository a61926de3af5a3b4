"""Pieces of the DuckDB SQL that the registered queries are compared with."""

from __future__ import annotations

TRADES = "lineitem JOIN part ON l_partkey = p_partkey"
PRICE = "l_extendedprice / l_quantity"
PLACE = "l_orderkey * 10 + l_linenumber"
BARS = f"""bars AS (
  SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, arg_min({PRICE}, {PLACE}) AS open, max({PRICE}) AS high,
         min({PRICE}) AS low, arg_max({PRICE}, {PLACE}) AS close, sum(l_quantity) AS volume
  FROM {TRADES} GROUP BY 1, 2)"""
PREPARED = f"""{BARS},
b0 AS (SELECT *, row_number() OVER w AS rn, lag(close) OVER w AS pc FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)),
b AS (SELECT *, close / nullif(pc, 0) - 1 AS ret,
             CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM b0)"""
BY_DATE = "PARTITION BY ticker ORDER BY date"
TICKS = "ticks AS (SELECT ts, event_type AS symbol, value AS bid, value * 1.001 AS ask, user_id FROM events)"


#: Added before rounding: prices are often exact halves of the last place, which engines round in either way.
SHIFT = 0.0000031


def rnd(expression: str) -> str:
    return f"round(CAST({expression} AS DOUBLE) + {SHIFT}, 4) + 0.0"


def frame(first: int, last: int) -> str:
    side = lambda k: "CURRENT ROW" if k == 0 else f"{abs(k)} {'PRECEDING' if k < 0 else 'FOLLOWING'}"
    return f"({BY_DATE} ROWS BETWEEN {side(first)} AND {side(last)})"


def over(fn: str, value: str, n: int, least: int | None = None, back: int = 0) -> str:
    """fn({}) over the last n rows, null with fewer than ``least`` values."""
    at = frame(1 - n - back, -back)
    call = fn.format(value) if "{}" in fn else f"{fn}({value})"
    return f"CASE WHEN count({value}) OVER {at} >= {n if least is None else least} THEN {call} OVER {at} END"


def lag(value: str, k: int = 1) -> str:
    return f"lag({value}, {k}) OVER ({BY_DATE})"


def sofar(call: str) -> str:
    return f"{call} OVER ({BY_DATE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def slope(value: str, n: int) -> str:
    at = frame(1 - n, 0)
    return f"CASE WHEN count({value}) OVER {at} >= {n} THEN regr_slope({value}, rn) OVER {at} END"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def clip(x: str, least: float, most: float) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, {least}), {most}) END"


def ewm(name: str, source: str, values: dict[str, tuple[str, float]]) -> str:
    """A recursive table of exponentially weighted means of columns of a table that has ticker and rn."""
    first = ", ".join(f"{c} AS {k}" for k, (c, _) in values.items())
    then = ", ".join(f"CASE WHEN e.{k} IS NULL THEN s.{c} ELSE {1 - a!r} * e.{k} + {a!r} * s.{c} END" for k, (c, a) in values.items())
    return f"""{name} AS (
  SELECT ticker, rn, {first} FROM {source} WHERE rn = 1
  UNION ALL
  SELECT s.ticker, s.rn, {then} FROM {name} AS e JOIN {source} AS s ON s.ticker = e.ticker AND s.rn = e.rn + 1)"""


def select(tables: str, source: str, columns: dict[str, str], keys: str = "ticker, CAST(date AS VARCHAR) AS date", raw: tuple[str, ...] = ()) -> str:
    """SELECT of keys and rounded columns, those in ``raw`` as whole numbers."""
    listed = ", ".join(f"{f'CAST({x} AS INTEGER)' if c in raw else rnd(x)} AS {c}" for c, x in columns.items())
    return f"WITH RECURSIVE {tables}\nSELECT {keys}, {listed} FROM {source}"
