"""Market indicators over a table of bars (``symbol, day, o, h, l, c, v``).

Windows partition by symbol and order by day; all of a job's windows share one sort. Bars are daily, so a
symbol's partition grows with its calendar, not with its ticks: the ticks are combined before. Too little
history gives null, never NaN. Rows with a null in o, h, l or c are no bars.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_BARS, MIN_CHART_BARS = 10, 2
#: Days of a block of a symbol's bars, which one row holds.
BLOCK_DAYS = 128
# Thresholds and look-back ranges in days.
TREND, PIVOT_SPAN, CLUSTER, MAX_LEVELS = 0.05, 5, 0.015, 3
PERIODS = {"equity": 252, "crypto": 365}
RANGES = {"1mo": 31, "3mo": 92, "6mo": 183, "1y": 366, "2y": 731}


def _in_order():
    return Window.partitionBy("symbol").orderBy("day")


def _so_far():
    return _in_order().rowsBetween(Window.unboundedPreceding, 0)


def _all():
    return _in_order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # in order too: one sort for all


def indexed(bars: DataFrame) -> DataFrame:
    """``i``: a bar's place from 0; ``n``, ``last_close``: the symbol's number of bars and its last close."""
    ok = bars.dropna(subset=["o", "h", "l", "c"]).withColumn("v", F.coalesce("v", F.lit(0.0)))
    return ok.withColumn("i", F.row_number().over(_in_order()) - 1).withColumn("n", F.count("*").over(_all())).withColumn("last_close", F.last("c").over(_all()))


def sma(n: int, value: str = "c") -> Column:
    """Mean of the last n values; null before there are n, and for n < 1."""
    if n < 1:
        return F.lit(None).cast("double")
    return F.when(F.col("i") >= n - 1, F.avg(value).over(_in_order().rowsBetween(1 - n, 0)))


def series(bars: DataFrame) -> DataFrame:
    """Per bar: index, averages, differences, running maximum and drawdown."""
    return indexed(bars).select(
        "symbol", "day", "o", "h", "l", "c", "v", "i", "n",
        sma(20).alias("sma20"), sma(50).alias("sma50"),
        (F.col("c") - F.lag("c").over(_in_order())).alias("change"),
        (F.ln("c") - F.ln(F.lag("c").over(_in_order()))).alias("log_return"),
        F.max("c").over(_so_far()).alias("running_max"),
        (F.col("c") / F.max("c").over(_so_far()) - 1).alias("drawdown"),
    )


def sma_last(n: int) -> Column:
    """The last bar's ``sma``, in a groupBy over (i, n, c): no window is moved over all the bars for it."""
    return F.when(F.max("n") >= n, F.avg(F.when(F.col("i") >= F.col("n") - n, F.col("c"))))


def ema_last(n: int) -> Column:
    """Exponential average at the last bar, in a groupBy over (i, n, c): the recurrence's weights in closed form."""
    keep = 1 - 2 / (n + 1)
    last = F.col("n") - 1
    weight = F.when(F.col("i") < n, F.pow(F.lit(keep), last - n + 1) / n).otherwise((1 - keep) * F.pow(F.lit(keep), last - F.col("i")))
    return F.when(F.max("n") >= n, F.sum(weight * F.col("c")))


def rsi_last(n: int = 14) -> Column:
    """Wilder's index at the last bar, in a groupBy over (i, n, change)."""
    keep = (n - 1) / n
    weight = F.when(F.col("i") <= n, F.pow(F.lit(keep), F.col("n") - 1 - n)).otherwise(F.pow(F.lit(keep), F.col("n") - 1 - F.col("i"))) / n
    gain = F.sum(weight * F.greatest("change", F.lit(0.0)))
    loss = F.sum(weight * F.greatest(-F.col("change"), F.lit(0.0)))
    value = F.when((loss == 0) & (gain == 0), 50.0).when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / loss))
    return F.when(F.max("n") >= n + 1, value)


def ema_series(bars: DataFrame, n: int, kept: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Per bar the exponential average: the mean of the first n closes, then ``keep * before + (1 - keep) * close``.

    An associative scan: bars of a symbol are cut into blocks of BLOCK_DAYS days, each block is folded into one affine map,
    the few maps of a symbol are chained in order, and each block's rows start from what the chain gives it. So a long
    symbol spreads over tasks, and only its maps (one a block) meet in one. ``kept`` writes what is read several times."""
    keep = 1 - 2 / (n + 1)
    ok = bars.dropna(subset=["o", "h", "l", "c"])
    own = ok.groupBy("symbol", F.floor(F.unix_date(F.to_date("day")) / BLOCK_DAYS).alias("block")).agg(F.array_sort(F.collect_list(F.struct("day", "c"))).alias("x"))
    own = kept(own.withColumn("size", F.size("x")))
    before = F.sum("size").over(Window.partitionBy("symbol").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    first = own.select("symbol", "block", before.alias("first"))
    placed = own.join(first, ["symbol", "block"])
    head = F.greatest(F.lit(0), F.least(F.size("x"), n - F.col("first"))).cast("int")  # bars of the first n
    closes = lambda rows: F.transform(rows, lambda b: b["c"])
    maps = placed.select(
        "symbol", "block", "first", "size", F.aggregate(closes(F.slice("x", F.lit(1), head)), F.lit(0.0), lambda t, c: t + c).alias("head"),
        F.aggregate(closes(F.slice("x", head + 1, F.size("x"))), F.lit(0.0), lambda e, c: keep * e + (1 - keep) * c).alias("add"),
    )

    def chain(acc: Column, b: Column) -> Column:
        total = acc["total"] + b["head"]
        ema = F.when((b["first"] < n) & (b["first"] + b["size"] >= n), total / n).otherwise(acc["ema"])
        passed = F.greatest(F.lit(0), F.least(b["size"], b["first"] + b["size"] - n))
        carry = F.struct(b["block"].alias("block"), F.when(b["first"] < n, acc["total"]).otherwise(acc["ema"]).alias("carry"))
        return F.struct(F.concat(acc["out"], F.array(carry)).alias("out"), total.alias("total"), (F.pow(F.lit(keep), passed) * ema + b["add"]).alias("ema"))

    empty = F.struct(F.array().cast("array<struct<block:bigint,carry:double>>").alias("out"), F.lit(0.0).alias("total"), F.lit(0.0).alias("ema"))
    in_order = F.array_sort(F.collect_list(F.struct("block", "first", "size", "head", "add")))
    chained = maps.groupBy("symbol").agg(F.aggregate(in_order, empty, chain, lambda acc: acc["out"]).alias("out"))
    carried = chained.select("symbol", F.inline("out"))
    start = F.struct(F.array().cast("array<double>").alias("out"), F.col("carry").alias("value"), F.col("first").alias("i"))

    def step(acc: Column, c: Column) -> Column:
        i = acc["i"] + 1
        value = F.when(i < n, acc["value"] + c).when(i == n, (acc["value"] + c) / n).otherwise(keep * acc["value"] + (1 - keep) * c)
        return F.struct(F.concat(acc["out"], F.array(F.when(i >= n, value))).alias("out"), value.alias("value"), i.alias("i"))

    folded = placed.join(carried, ["symbol", "block"]).select("symbol", "x", F.aggregate(closes(F.col("x")), start, step, lambda acc: acc["out"]).alias("out"))
    return folded.select("symbol", F.explode(F.arrays_zip(F.transform("x", lambda b: b["day"]).alias("day"), F.col("out").alias("ema"))).alias("r")).select("symbol", F.col("r.day").alias("day"), F.col("r.ema").alias("ema"))


def pivots(bars: DataFrame, span: int = PIVOT_SPAN, *also: str) -> DataFrame:
    """``symbol, day, kind, level, *also``: bars that are the extreme of the bars around them."""
    around = _in_order().rowsBetween(-span, span)
    marked = indexed(bars).withColumn("top", F.max("h").over(around)).withColumn("low", F.min("l").over(around)).where((F.col("i") >= span) & (F.col("i") < F.col("n") - span))
    both = F.array(F.when(F.col("h") >= F.col("top"), F.struct(F.lit("high").alias("kind"), F.col("h").alias("level"))), F.when(F.col("l") <= F.col("low"), F.struct(F.lit("low").alias("kind"), F.col("l").alias("level"))))
    return marked.select("symbol", "day", *also, F.explode(F.filter(both, lambda x: x.isNotNull())).alias("p")).select("symbol", "day", "p.kind", "p.level", *also)


def levels(points: DataFrame, within: float = CLUSTER, *also: str) -> DataFrame:
    """``symbol, cluster, level, *also``: levels that follow each other within a tolerance, merged into their mean; with what is one
    value a symbol."""
    up = Window.partitionBy("symbol").orderBy("level")
    before = F.lag("level").over(up)
    opens = F.when(before.isNull() | (F.col("level") > before * (1 + within)), 1).otherwise(0)
    marked = points.withColumn("opens", opens).withColumn("cluster", F.sum("opens").over(up.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("symbol", "cluster").agg(F.avg("level").alias("level"), *(F.first(c).alias(c) for c in also))


def _by_side(levels_: DataFrame) -> DataFrame:
    """``*, side, nth``: below the last close or not, nearest first."""
    side = F.when(F.col("level") < F.col("last_close"), "support").otherwise("resistance")
    near = Window.partitionBy("symbol", "side").orderBy(F.abs(F.col("level") - F.col("last_close")), "level")
    return levels_.withColumn("side", side).withColumn("nth", F.row_number().over(near))


def supports_resistances(levels_: DataFrame, last: DataFrame, most: int = MAX_LEVELS) -> DataFrame:
    """``symbol, side, nth, level``: the nearest levels below the last close, and at or above it."""
    return _by_side(levels_.join(last, "symbol")).where(F.col("nth") <= most).select("symbol", "side", "nth", "level")


def scalars(bars: DataFrame, periods: int | Column = PERIODS["equity"]) -> DataFrame:
    """One row a symbol, from one groupBy over the shared windows."""
    ppy = periods if isinstance(periods, Column) else F.lit(periods)
    last = lambda c: F.max_by(c, "i")
    change = F.col("c") - F.lag("c").over(_in_order())
    log_return = F.ln("c") - F.ln(F.lag("c").over(_in_order()))
    rows = indexed(bars).withColumns({"change": change, "log_return": log_return, "drawdown": F.col("c") / F.max("c").over(_so_far()) - 1})
    return rows.groupBy("symbol").agg(
        F.count("*").alias("n_bars"), F.min("day").alias("start"), F.max("day").alias("end"), last("c").alias("last_close"),
        (last("c") / F.min_by("c", "i") - 1).alias("period_return"),
        F.min(F.struct("l", "day"))["l"].alias("range_low"), F.min(F.struct("l", "day"))["day"].alias("range_low_date"),
        F.max(F.struct("h", -F.col("i")))["h"].alias("range_high"), F.max_by("day", F.struct("h", -F.col("i"))).alias("range_high_date"),
        sma_last(20).alias("sma20"), sma_last(50).alias("sma50"), ema_last(20).alias("ema20"), rsi_last(14).alias("rsi14"),
        F.when(F.count("*") >= 3, F.stddev_samp("log_return") * F.sqrt(F.max(ppy))).alias("volatility_annual"),
        F.min("drawdown").alias("max_drawdown"),
        F.when(F.count("*") > 1, F.regr_slope(F.col("c"), F.col("i").cast("double")) / F.avg("c") * (F.count("*") - 1)).alias("trend_slope"),
        F.max(ppy).cast("bigint").alias("periods_per_year"),
    )


def trend_class() -> Column:
    reference = F.coalesce("sma50", "sma20")
    return (
        F.when((F.col("trend_slope") >= TREND) & (reference.isNull() | (F.col("last_close") >= reference)), "up")
        .when((F.col("trend_slope") <= -TREND) & (reference.isNull() | (F.col("last_close") <= reference)), "down")
        .otherwise("sideways")
    )


def enough_history(bars: DataFrame, least: int = MIN_BARS) -> tuple[DataFrame, DataFrame]:
    """Bars of symbols with at least ``least`` bars; the other symbols with their number of bars."""
    counted = bars.withColumn("n_bars", F.count("*").over(_all()))
    return counted.where(F.col("n_bars") >= least).drop("n_bars"), counted.where(F.col("n_bars") < least).select("symbol", "n_bars").distinct()


def look_back(bars: DataFrame, range_: str) -> DataFrame:
    """Bars of the last so many days of each symbol; an unknown range is an error."""
    if range_ not in RANGES:
        raise ValueError(f"unknown range {range_!r}; known: {', '.join(RANGES)}")
    return bars.withColumn("newest", F.max("day").over(_all())).where(F.col("day") >= F.date_sub("newest", RANGES[range_])).drop("newest")


def summary(bars: DataFrame, periods: int | Column = PERIODS["equity"]) -> DataFrame:
    """All scalars of a symbol with enough history, trend, and its levels as arrays. Both read the bars in one partitioning by
    symbol, and levels bring their symbol's last close along, so nothing is computed or shuffled again for them. Bars of no symbol go."""
    kept, _ = enough_history(bars.where("symbol IS NOT NULL"))  # here, as the join asks for it on one side alone
    one = scalars(kept, periods).withColumn("trend", trend_class()).withColumn("above_sma50", F.col("last_close") >= F.col("sma50"))
    found = _by_side(levels(pivots(kept, PIVOT_SPAN, "last_close"), CLUSTER, "last_close"))
    in_order = lambda side: F.transform(F.array_sort(F.collect_list(F.when((F.col("side") == side) & (F.col("nth") <= MAX_LEVELS), F.struct("nth", "level")))), lambda x: x["level"])
    near = found.groupBy("symbol").agg(in_order("support").alias("supports"), in_order("resistance").alias("resistances"), F.sort_array(F.collect_list("level")).alias("pivots"))
    none = F.array().cast("array<double>")
    out = one.join(near, "symbol", "left")
    return out.withColumns({c: F.coalesce(c, none) for c in ("supports", "resistances", "pivots")})


def known_levels(technicals: DataFrame) -> DataFrame:
    """``symbol, level``: distinct pivots, supports, resistances and the range's ends."""
    every = F.array_distinct(F.concat("pivots", "supports", "resistances", F.array("range_low", "range_high")))
    return technicals.select("symbol", F.explode(every).alias("level"))


def _relations() -> list[Column]:
    def beside(average: str) -> list[Column]:
        usable = F.col(average).isNotNull() & (F.col(average) != 0)
        return [F.when(usable, F.when(F.col("last_close") >= F.col(average), "above").otherwise("below")).alias(f"side_{average}"), F.when(usable, F.abs(F.col("last_close") / F.col(average) - 1)).alias(f"distance_{average}")]

    width = F.col("range_high") - F.col("range_low")
    return [
        *beside("sma20"), *beside("sma50"),
        F.when(F.col("sma20") > F.col("sma50"), "bullish").when(F.col("sma20") < F.col("sma50"), "bearish").when(F.col("sma20") == F.col("sma50"), "equal").alias("sma_cross"),
        F.when(F.col("rsi14") > 70, "overbought").when(F.col("rsi14") < 30, "oversold").when(F.col("rsi14").isNotNull(), "neutral").alias("rsi_zone"),
        F.when(width > 0, F.col("last_close") / F.col("range_low") - 1).alias("above_low"),
        F.when(width > 0, 1 - F.col("last_close") / F.col("range_high")).alias("below_high"),
        F.when(width > 0, (F.col("last_close") - F.col("range_low")) / width).alias("range_position"),
    ]


def relations(technicals: DataFrame) -> DataFrame:
    """Where the last close stands: averages, their cross, the index's zone, the range."""
    return technicals.select("symbol", *_relations())


def chart_series(bars: DataFrame, margin: float = 0.05, least_body: float = 0.0012, headroom: float = 1.15) -> DataFrame:
    """What a candle chart draws: direction, body height with a floor, averages, axis limits. A flat
    series gets limits around its price."""
    kept, _ = enough_history(bars, MIN_CHART_BARS)
    low, high = F.min("l").over(_all()), F.max("h").over(_all())
    width = F.when(high > low, high - low).otherwise(F.greatest(F.abs(high) * 0.02, F.lit(1e-9)))
    return series(kept).select(
        "symbol", "day", (F.col("c") >= F.col("o")).alias("up"), F.greatest(F.abs(F.col("c") - F.col("o")), width * least_body).alias("body"), "sma20", "sma50",
        (low - width * margin).alias("axis_low"), (high + width * margin).alias("axis_high"), (F.max("v").over(_all()) * headroom).alias("volume_top"),
    )


def fact_sheet(technicals: DataFrame, derivatives: DataFrame | None = None) -> DataFrame:
    """``symbol, sheet``: ordered lines of text; lines without a value are left out. Derivatives (as from
    ``payloads.perp_contexts``) add lines of their funding, open interest, prices and volume. Numbers are rounded to six
    decimals first, so float noise doesn't turn a digit."""
    r = lambda c: F.round(F.col(c) if isinstance(c, str) else c, 6)
    price = lambda c: F.format_number(r(c), 2)
    share = lambda c: F.concat(F.format_number(r(F.col(c) * 100), 2), F.lit(" %"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    t = technicals.where("symbol IS NOT NULL").select("*", *_relations())
    lines = [
        line("Last close", price("last_close")), line("Return", share("period_return")), line("Range", F.concat(price("range_low"), F.lit(" - "), price("range_high"))),
        line("SMA20", F.concat(price("sma20"), F.lit(", close "), "side_sma20", F.lit(" by "), share("distance_sma20"))),
        line("SMA50", F.concat(price("sma50"), F.lit(", close "), "side_sma50", F.lit(" by "), share("distance_sma50"))),
        line("Cross", F.col("sma_cross")), line("EMA20", price("ema20")), line("RSI14", F.concat(F.format_number(r("rsi14"), 1), F.lit(" "), "rsi_zone")),
        line("Volatility", share("volatility_annual")), line("Drawdown", share("max_drawdown")), line("Trend", F.col("trend")),
        F.when(F.size("supports") > 0, line("Supports", F.array_join(F.transform("supports", price), ", "))),
        F.when(F.size("resistances") > 0, line("Resistances", F.array_join(F.transform("resistances", price), ", "))),
    ]
    if derivatives is not None:
        d = derivatives.withColumns({c: r(c) for c in ("funding_annual", "open_interest", "mark", "oracle", "notional")})
        t = t.join(d.select("symbol", "funding_annual", "open_interest", "mark", "oracle", "notional"), "symbol", "left")
        pays = F.when(F.col("funding_annual") > 0, "positive, longs pay shorts").when(F.col("funding_annual") < 0, "negative, shorts pay longs").otherwise("zero")
        lines += [
            line("Funding", F.concat(pays, F.lit(", "), share("funding_annual"), F.lit(" a year"))),
            line("Open interest", F.concat(F.format_number("open_interest", 0), F.lit(" units, "), F.format_number(r(F.col("open_interest") * F.col("mark")), 0), F.lit(" USD at the mark"))),
            line("Perpetual", F.concat(F.lit("mark "), price("mark"), F.lit(", oracle "), price("oracle"), F.lit(", volume 24 h "), F.format_number("notional", 0), F.lit(" USD"))),
        ]
    return t.select("symbol", F.concat_ws("\n", *lines).alias("sheet"))
