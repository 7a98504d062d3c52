"""Queries on bars and technicals."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from finevidence.operators import technicals as T
from finevidence.sources import adapters as A
from finevidence.sources import payloads

R6 = lambda c: F.round(c, 6).alias(c)


def a00_line_bars(spark, sf_dir):
    return A.line_bars(spark, sf_dir).select("symbol", "day", R6("o"), R6("h"), R6("l"), R6("c"), "v")


def w01_w07_series(spark, sf_dir):
    s = T.series(A.line_bars(spark, sf_dir))
    return s.select("symbol", "day", A.clean("i").alias("i"), R6("sma20"), R6("sma50"), R6("change"), R6("log_return"), R6("running_max"), R6("drawdown"))


def w02_sma_orders(spark, sf_dir):
    return T.series(A.order_bars(spark, sf_dir)).select("symbol", "day", F.round("sma20", 4).alias("sma20"), F.round("sma50", 4).alias("sma50"))


def w04_ema_series(spark, sf_dir):
    return T.ema_series(A.line_bars(spark, sf_dir), 20, A.kept).select("symbol", "day", R6("ema"))


def w08_pivots(spark, sf_dir):
    return T.pivots(A.line_bars(spark, sf_dir)).select("symbol", "day", "kind", R6("level"))


def w09_levels(spark, sf_dir):
    return T.levels(T.pivots(A.line_bars(spark, sf_dir))).select("symbol", A.clean("cluster").alias("cluster"), R6("level"))


def w10_supports_resistances(spark, sf_dir):
    bars = A.line_bars(spark, sf_dir)
    last = bars.groupBy("symbol").agg(F.max_by("c", "day").alias("last_close"))
    return T.supports_resistances(T.levels(T.pivots(bars)), last).select("symbol", "side", A.clean("nth").alias("nth"), R6("level"))


def w13_chart_series(spark, sf_dir):
    return T.chart_series(A.line_bars(spark, sf_dir)).select("symbol", "day", "up", R6("body"), R6("sma20"), R6("sma50"), R6("axis_low"), R6("axis_high"), R6("volume_top"))


_SCALARS = ["last_close", "period_return", "range_low", "range_high", "sma20", "sma50", "ema20", "rsi14", "volatility_annual", "max_drawdown", "trend_slope"]


def _flat(t):
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.format_string("%.6f", x)), ",").alias(c)
    return t.select("symbol", "n_bars", "start", "end", *map(R6, _SCALARS), "range_low_date", "range_high_date", "trend", "above_sma50", "periods_per_year", *map(joined, ("supports", "resistances", "pivots")))


def w14_technical_summary(spark, sf_dir):
    return _flat(T.summary(A.line_bars(spark, sf_dir)))


def w14_technical_summary_short(spark, sf_dir):
    return _flat(T.summary(A.event_bars(spark, sf_dir), F.when(F.col("symbol") == "view", 365).otherwise(252)))


def a01_a06_scalars(spark, sf_dir):
    return T.scalars(A.order_bars(spark, sf_dir)).select("symbol", "n_bars", *map(R6, ["period_return", "rsi14", "volatility_annual", "max_drawdown", "trend_slope"]), F.round("ema20", 4).alias("ema20"))


def t01_t06_relations(spark, sf_dir):
    bars = A.line_bars(spark, sf_dir)
    t = T.scalars(bars).withColumn("trend", T.trend_class())
    return T.relations(t).join(t.select("symbol", "trend"), "symbol").select("symbol", "trend", "side_sma20", R6("distance_sma20"), "side_sma50", R6("distance_sma50"), "sma_cross", "rsi_zone", R6("above_low"), R6("below_high"), R6("range_position"))


def t09_fact_sheet(spark, sf_dir):
    return T.fact_sheet(T.summary(A.line_bars(spark, sf_dir)))


def s09_csv_bars(spark, sf_dir):
    """All symbols' bars written as CSV and read again, by the header's names."""
    path = f"{A.shared_folder(spark)}/{uuid.uuid4().hex}"
    payloads.write_bars_csv(A.order_bars(spark, sf_dir), path)
    return payloads.read_bars_csv(spark, path)


def p01_look_back(spark, sf_dir):
    return T.look_back(A.line_bars(spark, sf_dir), "6mo").select("symbol", "day", R6("c"))


def p02_history_gate(spark, sf_dir):
    _, short = T.enough_history(A.line_bars(spark, sf_dir), 550)
    return short


def u02_known_levels(spark, sf_dir):
    return T.known_levels(T.summary(A.line_bars(spark, sf_dir))).select("symbol", F.round("level", 6).alias("level")).distinct()


QUERIES = {f.__name__: f for f in (a00_line_bars, w01_w07_series, w02_sma_orders, w04_ema_series, w08_pivots, w09_levels, w10_supports_resistances, w13_chart_series, w14_technical_summary, w14_technical_summary_short, a01_a06_scalars, t01_t06_relations, t09_fact_sheet, s09_csv_bars, p01_look_back, p02_history_gate, u02_known_levels)}

# -- SQL --------------------------------------------------------------------------------------------

_LINE = """bars AS (
  SELECT symbol, day, arg_min(price, nth) AS o, max(price) AS h, min(price) AS l, arg_max(price, nth) AS c, sum(volume) AS v
  FROM (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS day, floor(l_extendedprice * 100 / l_quantity) / 100 AS price, l_quantity AS volume,
               row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS nth FROM lineitem)
  GROUP BY symbol, day)"""
_ORDER = """bars AS (
  SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS day, arg_min(o_totalprice, o_orderkey) AS o, max(o_totalprice) AS h,
         min(o_totalprice) AS l, arg_max(o_totalprice, o_orderkey) AS c, CAST(count(*) AS DOUBLE) AS v
  FROM orders GROUP BY 1, 2)"""
_EVENT = """bars AS (
  SELECT symbol, day, arg_min(price, nth) AS o, max(price) AS h, min(price) AS l, arg_max(price, nth) AS c, CAST(count(*) AS DOUBLE) AS v
  FROM (SELECT event_type AS symbol, CAST(ts AS DATE) AS day, value + 1 AS price, row_number() OVER (ORDER BY ts, event_id) AS nth FROM events)
  GROUP BY symbol, day)"""
_SERIES = """series AS (
  SELECT *, CASE WHEN i >= 19 THEN avg(c) OVER (PARTITION BY symbol ORDER BY day ROWS 19 PRECEDING) END AS sma20,
         CASE WHEN i >= 49 THEN avg(c) OVER (PARTITION BY symbol ORDER BY day ROWS 49 PRECEDING) END AS sma50,
         c - lag(c) OVER w AS change, ln(c) - ln(lag(c) OVER w) AS log_return,
         max(c) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING) AS running_max
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars)
  WINDOW w AS (PARTITION BY symbol ORDER BY day))"""
_SCALAR_SQL = """scalars AS (
  SELECT symbol, count(*) AS n_bars, min(day) AS "start", max(day) AS "end", arg_max(c, i) AS last_close, arg_max(c, i) / arg_min(c, i) - 1 AS period_return,
         min(l) AS range_low, max(h) AS range_high, arg_max(sma20, i) AS sma20_, max(CASE WHEN i = n - 1 THEN sma20 END) AS sma20, max(CASE WHEN i = n - 1 THEN sma50 END) AS sma50,
         CASE WHEN count(*) >= 20 THEN sum(c * CASE WHEN i < 20 THEN power(19.0 / 21, n - 20) / 20 ELSE 2.0 / 21 * power(19.0 / 21, n - 1 - i) END) END AS ema20,
         sum(greatest(change, 0) * CASE WHEN i <= 14 THEN power(13.0 / 14, n - 15) ELSE power(13.0 / 14, n - 1 - i) END) / 14 AS gain,
         sum(greatest(-change, 0) * CASE WHEN i <= 14 THEN power(13.0 / 14, n - 15) ELSE power(13.0 / 14, n - 1 - i) END) / 14 AS loss,
         stddev_samp(log_return) AS sd, min(c / running_max - 1) AS max_drawdown, regr_slope(c, i) / avg(c) * (count(*) - 1) AS trend_slope
  FROM series GROUP BY symbol),
dates AS (
  SELECT s.symbol, min(CASE WHEN s.l = k.range_low THEN s.day END) AS range_low_date, min(CASE WHEN s.h = k.range_high THEN s.day END) AS range_high_date
  FROM series s JOIN scalars k USING (symbol) GROUP BY 1),
tech AS (
  SELECT k.*, d.range_low_date, d.range_high_date,
         CASE WHEN n_bars < 15 THEN NULL WHEN gain = 0 AND loss = 0 THEN 50.0 WHEN loss = 0 THEN 100.0 ELSE 100 - 100 / (1 + gain / loss) END AS rsi14,
         CASE WHEN trend_slope >= 0.05 AND last_close >= coalesce(sma50, sma20, last_close) THEN 'up'
              WHEN trend_slope <= -0.05 AND last_close <= coalesce(sma50, sma20, last_close) THEN 'down' ELSE 'sideways' END AS trend
  FROM scalars k JOIN dates d USING (symbol))"""
_PIVOTS = """around AS (
  SELECT *, max(h) OVER w AS top, min(l) OVER w AS low FROM series
  WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
pivots AS (
  SELECT symbol, day, 'high' AS kind, h AS level FROM around WHERE h >= top AND i >= 5 AND i < n - 5
  UNION ALL SELECT symbol, day, 'low', l FROM around WHERE l <= low AND i >= 5 AND i < n - 5)"""
_LEVELS = """levels AS (
  SELECT symbol, cluster, avg(level) AS level FROM (
    SELECT *, sum(opens) OVER (PARTITION BY symbol ORDER BY level ROWS UNBOUNDED PRECEDING) AS cluster FROM (
      SELECT *, CASE WHEN lag(level) OVER w IS NULL OR level > lag(level) OVER w * 1.015 THEN 1 ELSE 0 END AS opens
      FROM pivots WINDOW w AS (PARTITION BY symbol ORDER BY level)))
  GROUP BY symbol, cluster)"""
_SIDES = """sides AS (
  SELECT * FROM (
    SELECT symbol, side, level, row_number() OVER (PARTITION BY symbol, side ORDER BY abs(level - last_close), level) AS nth
    FROM (SELECT v.symbol, v.level, k.last_close, CASE WHEN v.level < k.last_close THEN 'support' ELSE 'resistance' END AS side
          FROM levels v JOIN (SELECT symbol, arg_max(c, day) AS last_close FROM bars GROUP BY 1) k USING (symbol)))
  WHERE nth <= 3)"""
r6 = lambda *cs: ", ".join(f"round({c}, 6) AS {c}" for c in cs)


_p = lambda c: f"format('{{:,.2f}}', round({c}, 6))"
_share = lambda c: f"format('{{:,.2f}}', round(({c}) * 100, 6)) || ' %'"
_SHEET_PARTS = f"""{_LINE}, {_SERIES}, {_SCALAR_SQL}, {_PIVOTS}, {_LEVELS}, {_SIDES},
sheet AS (
  SELECT k.*, CASE WHEN n_bars >= 3 THEN sd * sqrt(252) END AS volatility_annual, (SELECT string_agg({_p('level')}, ', ' ORDER BY nth) FROM sides s WHERE s.symbol = k.symbol AND side = 'support') AS supports,
         (SELECT string_agg({_p('level')}, ', ' ORDER BY nth) FROM sides s WHERE s.symbol = k.symbol AND side = 'resistance') AS resistances FROM tech k)"""
_beside = lambda n: f"'SMA{n}: ' || {_p(f'sma{n}')} || ', close ' || CASE WHEN last_close >= sma{n} THEN 'above' ELSE 'below' END || ' by ' || {_share(f'abs(last_close / sma{n} - 1)')}"
_SHEET_LINES = f"""'Last close: ' || {_p('last_close')}, 'Return: ' || {_share('period_return')}, 'Range: ' || {_p('range_low')} || ' - ' || {_p('range_high')}, {_beside(20)}, {_beside(50)},
  'Cross: ' || CASE WHEN sma20 > sma50 THEN 'bullish' WHEN sma20 < sma50 THEN 'bearish' WHEN sma20 = sma50 THEN 'equal' END, 'EMA20: ' || {_p('ema20')},
  'RSI14: ' || format('{{:,.1f}}', round(rsi14, 6)) || ' ' || CASE WHEN rsi14 > 70 THEN 'overbought' WHEN rsi14 < 30 THEN 'oversold' ELSE 'neutral' END,
  'Volatility: ' || {_share('volatility_annual')}, 'Drawdown: ' || {_share('max_drawdown')}, 'Trend: ' || trend, 'Supports: ' || supports, 'Resistances: ' || resistances"""


def _summary_sql(bars: str, ppy: str) -> str:
    listed = lambda side, order: f"coalesce((SELECT string_agg(printf('%.6f', level), ',' ORDER BY {order}) FROM {side} x WHERE x.symbol = t.symbol), '')"
    return f"""WITH {bars}, {_SERIES}, {_SCALAR_SQL}, {_PIVOTS}, {_LEVELS}, {_SIDES},
      s AS (SELECT * FROM sides WHERE side = 'support'), r AS (SELECT * FROM sides WHERE side = 'resistance')
      SELECT symbol, n_bars, "start", "end", {r6('last_close', 'period_return', 'range_low', 'range_high', 'sma20', 'sma50', 'ema20', 'rsi14', 'max_drawdown', 'trend_slope')},
             round(CASE WHEN n_bars >= 3 THEN sd * sqrt({ppy}) END, 6) AS volatility_annual, range_low_date, range_high_date, trend, last_close >= sma50 AS above_sma50,
             CAST({ppy} AS BIGINT) AS periods_per_year, {listed('s', 'nth')} AS supports, {listed('r', 'nth')} AS resistances, {listed('levels', 'level')} AS pivots
      FROM tech t WHERE n_bars >= 10"""


ORACLE_SQL = {
    "a00_line_bars": f"WITH {_LINE} SELECT symbol, day, {r6('o', 'h', 'l', 'c')}, v FROM bars",
    "w01_w07_series": f"WITH {_LINE}, {_SERIES} SELECT symbol, day, i, {r6('sma20', 'sma50', 'change', 'log_return', 'running_max')}, round(c / running_max - 1, 6) AS drawdown FROM series",
    "w02_sma_orders": f"WITH {_ORDER}, {_SERIES} SELECT symbol, day, round(sma20, 4) AS sma20, round(sma50, 4) AS sma50 FROM series",
    "w04_ema_series": f"""WITH RECURSIVE {_LINE}, {_SERIES},
      step AS (SELECT symbol, i, day, sma20 AS ema FROM series WHERE i = 19
               UNION ALL SELECT s.symbol, s.i, s.day, 2.0 / 21 * s.c + 19.0 / 21 * p.ema FROM step p JOIN series s ON s.symbol = p.symbol AND s.i = p.i + 1)
      SELECT s.symbol, s.day, round(p.ema, 6) AS ema FROM series s LEFT JOIN step p USING (symbol, i)""",
    "w08_pivots": f"WITH {_LINE}, {_SERIES}, {_PIVOTS} SELECT symbol, day, kind, round(level, 6) AS level FROM pivots",
    "w09_levels": f"WITH {_LINE}, {_SERIES}, {_PIVOTS}, {_LEVELS} SELECT symbol, CAST(cluster AS BIGINT) AS cluster, round(level, 6) AS level FROM levels",
    "w10_supports_resistances": f"WITH {_LINE}, {_SERIES}, {_PIVOTS}, {_LEVELS}, {_SIDES} SELECT symbol, side, nth, round(level, 6) AS level FROM sides",
    "w13_chart_series": f"""WITH {_LINE}, {_SERIES},
      k AS (SELECT *, min(l) OVER s AS low, max(h) OVER s AS high, max(v) OVER s AS vol FROM series WHERE n >= 2 WINDOW s AS (PARTITION BY symbol)),
      w AS (SELECT *, CASE WHEN high > low THEN high - low ELSE greatest(abs(high) * 0.02, 1e-9) END AS width FROM k)
      SELECT symbol, day, c >= o AS up, round(greatest(abs(c - o), width * 0.0012), 6) AS body, {r6('sma20', 'sma50')},
             round(low - width * 0.05, 6) AS axis_low, round(high + width * 0.05, 6) AS axis_high, round(vol * 1.15, 6) AS volume_top FROM w""",
    "w14_technical_summary": _summary_sql(_LINE, "252"),
    "w14_technical_summary_short": _summary_sql(_EVENT, "CASE WHEN symbol = 'view' THEN 365 ELSE 252 END"),
    "a01_a06_scalars": f"""WITH {_ORDER}, {_SERIES}, {_SCALAR_SQL} SELECT symbol, n_bars, {r6('period_return', 'rsi14', 'max_drawdown', 'trend_slope')},
      round(sd * sqrt(252), 6) AS volatility_annual, round(ema20, 4) AS ema20 FROM tech""",
    "t01_t06_relations": f"""WITH {_LINE}, {_SERIES}, {_SCALAR_SQL}
      SELECT symbol, trend, CASE WHEN last_close >= sma20 THEN 'above' WHEN last_close < sma20 THEN 'below' END AS side_sma20, round(abs(last_close / sma20 - 1), 6) AS distance_sma20,
             CASE WHEN last_close >= sma50 THEN 'above' WHEN last_close < sma50 THEN 'below' END AS side_sma50, round(abs(last_close / sma50 - 1), 6) AS distance_sma50,
             CASE WHEN sma20 > sma50 THEN 'bullish' WHEN sma20 < sma50 THEN 'bearish' WHEN sma20 = sma50 THEN 'equal' END AS sma_cross,
             CASE WHEN rsi14 > 70 THEN 'overbought' WHEN rsi14 < 30 THEN 'oversold' WHEN rsi14 IS NOT NULL THEN 'neutral' END AS rsi_zone,
             round(last_close / range_low - 1, 6) AS above_low, round(1 - last_close / range_high, 6) AS below_high, round((last_close - range_low) / (range_high - range_low), 6) AS range_position
      FROM tech""",
    "s09_csv_bars": f"WITH {_ORDER} SELECT day AS fecha, o AS open, h AS high, l AS low, c AS close, v AS volume FROM bars",
    "p01_look_back": f"WITH {_LINE} SELECT symbol, day, round(c, 6) AS c FROM (SELECT *, max(day) OVER (PARTITION BY symbol) AS newest FROM bars) WHERE day >= newest - 183",
    "p02_history_gate": f"WITH {_LINE} SELECT symbol, count(*) AS n_bars FROM bars GROUP BY 1 HAVING count(*) < 550",
    "u02_known_levels": f"""WITH {_LINE}, {_SERIES}, {_SCALAR_SQL}, {_PIVOTS}, {_LEVELS}
      SELECT DISTINCT symbol, round(level, 6) AS level FROM (SELECT symbol, level FROM levels UNION ALL SELECT symbol, unnest([range_low, range_high]) FROM tech)
      WHERE symbol IN (SELECT symbol FROM tech WHERE n_bars >= 10)""",
    "t09_fact_sheet": f"WITH {_SHEET_PARTS} SELECT symbol, concat_ws(chr(10), {_SHEET_LINES}) AS sheet FROM sheet",
}
