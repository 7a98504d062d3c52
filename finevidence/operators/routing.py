"""Tickers: normal form, market, filer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Symbols that mean the coin even where a fund has the ticker.
MAJOR = ["BTC", "ETH", "XRP", "SOL", "DOGE"]
_CRYPTO, _EQUITY, _SUFFIX = r"(?i)^cripto:\s*", r"(?i)^accion:\s*", r"^(.+?)(-PERP|-USDT|-USD)$"


def symbol_of(raw: Column) -> Column:
    """Upper-case symbol without crypto marks."""
    bare = F.regexp_replace(F.upper(F.trim(raw)), _CRYPTO, "")
    return F.trim(F.regexp_replace(bare, _SUFFIX, "$1"))


def explicit_crypto(raw: Column) -> Column:
    t = F.upper(F.trim(raw))
    return t.rlike(_CRYPTO) | F.regexp_replace(t, _CRYPTO, "").rlike(_SUFFIX)


def visible_symbol(raw: Column) -> Column:
    equity = F.trim(raw).rlike(_EQUITY)
    return F.when(equity, F.upper(F.trim(F.regexp_replace(F.trim(raw), _EQUITY, "")))).otherwise(symbol_of(raw))


def route(tickers: DataFrame, filers: DataFrame | None = None, perps: DataFrame | None = None) -> DataFrame:
    """``*, symbol, market``: equity or crypto by ordered rules, null for an empty ticker. A table of filers or perps that is
    missing leaves its rule out. Filers and perps join on the symbol; Spark broadcasts them where they are small."""
    t = tickers.withColumn("symbol", visible_symbol(F.col("raw")))
    for name, known in (("filer", filers), ("perp", perps)):
        t = t.join(known.select("symbol", F.lit(True).alias(name)).distinct(), "symbol", "left") if known is not None else t.withColumn(name, F.lit(None).cast("boolean"))
    market = (
        F.when(F.coalesce("symbol", F.lit("")) == "", None).when(F.trim("raw").rlike(_EQUITY), "equity").when(explicit_crypto(F.col("raw")), "crypto")
        .when(F.col("symbol").rlike(r"[.^]"), "equity").when(F.col("symbol").isin(MAJOR), "crypto").when(F.col("filer"), "equity").when(F.col("perp"), "crypto").otherwise("equity")
    )
    return t.withColumn("market", market).drop("filer", "perp")


def filer_lookup(tickers: DataFrame, filers: DataFrame) -> DataFrame:
    """``*, cik``: by symbol, else with dots as dashes; null without a match."""
    f = filers.groupBy("symbol").agg(F.min("cik").alias("cik"))
    exact = tickers.join(f, "symbol", "left")
    alias = f.select(F.col("symbol").alias("alias"), F.col("cik").alias("alias_cik"))
    return exact.join(alias, F.translate("symbol", ".", "-") == F.col("alias"), "left").withColumn("cik", F.coalesce("cik", "alias_cik")).drop("alias", "alias_cik")


def expand_ranges(c: Column) -> Column:
    """``"1,3,14-24"`` as an array of numbers; parts that aren't numbers give none."""
    parts = F.transform(F.split(c, ","), lambda p: F.struct(F.regexp_extract(p, r"^\s*(\d+)", 1).try_cast("int").alias("a"), F.regexp_extract(p, r"(\d+)\s*$", 1).try_cast("int").alias("b")))
    return F.flatten(F.transform(F.filter(parts, lambda x: x["a"].isNotNull() & (x["b"] >= x["a"])), lambda x: F.sequence(x["a"], x["b"])))


def select_sources(asked: DataFrame, equity_bars: DataFrame, perp_bars: DataFrame) -> DataFrame:
    """``*bars, market``: symbols of the crypto market read the perpetuals' bars, equities theirs. asked: ``symbol,
    market``; symbols are joined to their own source only, so the filter on the market reaches both."""
    symbols = asked.select("symbol", "market").where("market IS NOT NULL").distinct()
    own = [bars.join(symbols.where(F.col("market") == market), "symbol") for bars, market in ((equity_bars, "equity"), (perp_bars, "crypto"))]
    return own[0].unionByName(own[1])


def guarded_by_market(asked: DataFrame, derivatives: DataFrame, facts: DataFrame) -> DataFrame:
    """``*``, with the columns of ``derivatives`` for crypto alone and those of ``facts`` for equities alone (one row a symbol each)."""
    out = asked.join(derivatives.withColumn("market", F.lit("crypto")), ["symbol", "market"], "left")
    return out.join(facts.withColumn("market", F.lit("equity")), ["symbol", "market"], "left")


def market_context(asked: DataFrame, technicals: DataFrame, levels: DataFrame, derivatives: DataFrame, facts: DataFrame, contrast: DataFrame) -> DataFrame:
    """``symbol`` and the columns of all parts, one row a requested symbol, null where a part has none. Each part has at most one
    row a symbol, but for ``levels`` (symbol, side, nth, level), which become two lists, nearest first. Contrast is that of
    readings of charts drawn from the same bars alone: one that was sent may show other days."""
    listed = lambda side: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("nth", "level")))), lambda x: x["level"]).alias(f"{side}s")
    sides = levels.groupBy("symbol").agg(listed("support"), listed("resistance"))
    out = asked.select("symbol").distinct()
    for part in (technicals, sides, derivatives, facts, contrast):
        out = out.join(part, "symbol", "left")
    return out
