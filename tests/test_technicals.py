import datetime as dt
import math

import pytest
from pyspark.sql import functions as F
from finevidence.operators import technicals as T

CLASSIC = [44.34, 44.09, 44.15, 43.61, 44.33, 44.83, 45.10, 45.42, 45.84, 46.08, 45.89, 46.03, 45.61, 46.28, 46.28]


def bars(spark, closes, symbol="A", wick=0.0):
    day = dt.date(2026, 1, 1)
    rows = [(symbol, day + dt.timedelta(i), closes[max(0, i - 1)], max(c, closes[max(0, i - 1)]) + wick, min(c, closes[max(0, i - 1)]) - wick, float(c), 1000.0) for i, c in enumerate(map(float, closes))]
    return spark.createDataFrame([(s, d, float(o), float(h), float(low), c, v) for s, d, o, h, low, c, v in rows], "symbol string, day date, o double, h double, l double, c double, v double")


def one(df):
    return df.collect()[0]


def test_sma_needs_history(spark):
    from pyspark.sql import functions as F

    s = T.indexed(bars(spark, [1, 2, 3, 4, 5])).select("i", T.sma(3).alias("x"), T.sma(0).alias("none")).orderBy("i").collect()
    assert [r.x for r in s] == [None, None, 2.0, 3.0, 4.0] and {r.none for r in s} == {None}
    assert T.indexed(bars(spark, [1, 2])).select(T.sma(3).alias("x")).where(F.col("x").isNotNull()).count() == 0


def test_ema_series_and_closed_form(spark):
    s = T.ema_series(bars(spark, [1, 2, 3, 4]), 3).orderBy("day").collect()
    assert [r.ema for r in s] == [None, None, 2.0, 3.0]
    closes = [100 + 10 * math.sin(i) + i for i in range(90)]
    want = sum(closes[:20]) / 20
    for c in closes[20:]:
        want = want + 2 / 21 * (c - want)
    assert one(T.scalars(bars(spark, closes))).ema20 == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("closes, want, within", [(CLASSIC, 70.5, 0.2), (range(1, 30), 100, 0), (range(30, 1, -1), 0, 1e-9), ([5] * 20, 50, 0)])
def test_rsi(spark, closes, want, within):
    assert one(T.scalars(bars(spark, list(closes)))).rsi14 == pytest.approx(want, abs=within or 1e-9)


def test_rsi_recurrence(spark):
    closes = [100 + 7 * math.sin(i * 1.3) + i / 5 for i in range(60)]
    d = [b - a for a, b in zip(closes, closes[1:])]
    g, p = sum(max(x, 0) for x in d[:14]) / 14, sum(max(-x, 0) for x in d[:14]) / 14
    for x in d[14:]:
        g, p = (g * 13 + max(x, 0)) / 14, (p * 13 + max(-x, 0)) / 14
    assert one(T.scalars(bars(spark, closes))).rsi14 == pytest.approx(100 - 100 / (1 + g / p), abs=1e-9)


def test_drawdown_slope_and_short_history(spark):
    assert one(T.scalars(bars(spark, [100, 120, 60, 90]))).max_drawdown == pytest.approx(-0.5)
    assert one(T.scalars(bars(spark, [100, 150, 200]))).trend_slope == pytest.approx(100 / 150)
    short = one(T.scalars(bars(spark, [1, 2])))
    assert short.volatility_annual is None and short.rsi14 is None and short.ema20 is None


def test_summary_of_a_rise(spark):
    s = one(T.summary(bars(spark, range(100, 160))))
    assert (s.n_bars, s.trend, s.rsi14, s.max_drawdown, s.above_sma50) == (60, "up", 100.0, 0.0, True)
    assert s.period_return == pytest.approx(0.59) and s.supports == [] and s.pivots == []


def test_history_gate_and_ranges(spark):
    both = bars(spark, range(1, 13)).unionByName(bars(spark, [1, 2, 3], "B"))
    kept, short = T.enough_history(both)
    assert kept.select("symbol").distinct().count() == 1 and [tuple(r) for r in short.collect()] == [("B", 3)]
    assert T.look_back(bars(spark, range(1, 100)), "1mo").count() == 32
    with pytest.raises(ValueError):
        T.look_back(both, "5y")


def test_pivots_and_levels(spark):
    closes = [10, 11, 12, 13, 14, 20, 14, 13, 12, 11, 10, 9, 8, 7, 6, 5]
    found = T.pivots(bars(spark, closes)).collect()
    assert 20.0 in {r.level for r in found if r.kind == "high"}
    points = spark.createDataFrame([("A", x) for x in (100.0, 101.0, 102.0, 110.0)], "symbol string, level double")
    assert sorted(r.level for r in T.levels(points).collect()) == [101.0, 110.0]


def test_earliest_extreme_wins_and_nulls_are_no_bars(spark):
    b = bars(spark, [5, 9, 5, 9, 5, 9, 7, 7, 7, 7, 7])
    s = one(T.scalars(b))
    assert s.range_high_date == dt.date(2026, 1, 2) and s.range_low_date == dt.date(2026, 1, 1)
    holed = b.selectExpr("symbol", "day", "IF(c = 9, NULL, o) o", "h", "l", "c", "v")
    assert T.indexed(holed).count() == 8


def test_partitioning_does_not_matter(spark):
    from pyspark.sql import functions as F

    b = bars(spark, [50 + (i * 37 % 17) for i in range(80)])
    rows = lambda df: df.select("symbol", "trend", *(F.round(c, 9).alias(c) for c in ("ema20", "rsi14", "trend_slope"))).collect()
    assert rows(T.summary(b)) == rows(T.summary(b.repartition(7)))


def test_ema_of_a_long_symbol(spark):
    """A million bars of one symbol, and a short one, against the recurrence."""
    n, size = 20, 1_000_000
    rows = spark.range(size).selectExpr("1 AS symbol", "date_add(date'0001-01-01', cast(id AS int)) AS day", "cast(100 + (id * 7919) % 1009 / 10.0 AS double) AS c")
    rows = rows.unionByName(spark.range(30).selectExpr("2 AS symbol", "date_add(date'2020-01-01', cast(id * 9 AS int)) AS day", "cast(id AS double) AS c"))
    bars = rows.selectExpr("symbol", "day", "c AS o", "c AS h", "c AS l", "c", "1.0D AS v")
    got = T.ema_series(bars, n).groupBy("symbol").agg(F.count("*").alias("bars"), F.count("ema").alias("some"), F.sum("ema").alias("total"), F.max_by("ema", "day").alias("last")).orderBy("symbol").collect()
    for r, closes in zip(got, ([100 + (i * 7919) % 1009 / 10 for i in range(size)], [float(i) for i in range(30)])):
        ema = sum(closes[:n]) / n
        total = ema
        for c in closes[n:]:
            ema = ema * (1 - 2 / (n + 1)) + c * 2 / (n + 1)
            total += ema
        assert (r.bars, r.some) == (len(closes), len(closes) - n + 1)
        assert r.total == pytest.approx(total, rel=1e-9) and r.last == pytest.approx(ema, rel=1e-9)
    assert T.ema_series(bars.limit(0), n).count() == 0
