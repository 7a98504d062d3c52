"""Readers of landed payload files: text rows to typed tables, with a reason where a row gives none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finevidence.sources import files

_CHART = """struct<chart:struct<result:array<struct<meta:map<string,string>,timestamp:array<bigint>,
  indicators:struct<quote:array<struct<open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<double>>>>>>,
  error:struct<code:string,description:string>>>"""
# Metadata that is kept.
META_KEYS = ["symbol", "currency", "exchangeName", "fullExchangeName", "instrumentType", "longName", "shortName", "timezone", "regularMarketPrice", "fiftyTwoWeekHigh", "fiftyTwoWeekLow"]


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, body``: one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def equity_bars(payloads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bars (``symbol, currency, t, o, h, l, c, v``), kept metadata (``symbol, meta``), and rejected payloads
    with a reason. payloads: ``id, body``. A bar without open, high, low or close goes; volume defaults to 0."""
    p = payloads.select("id", F.from_json("body", _CHART).alias("p")).select("id", F.col("p.chart.error").alias("error"), F.get("p.chart.result", F.lit(0)).alias("r"))
    q = F.get("r.indicators.quote", F.lit(0))
    zipped = F.arrays_zip(F.col("r.timestamp").alias("t"), q["open"].alias("o"), q["high"].alias("h"), q["low"].alias("l"), q["close"].alias("c"), q["volume"].alias("v"))
    valid = F.filter(zipped, lambda b: b["t"].isNotNull() & b["o"].isNotNull() & b["h"].isNotNull() & b["l"].isNotNull() & b["c"].isNotNull())
    p = p.withColumn("bars", valid).withColumn("reason", F.when(F.col("error").isNotNull(), "unknown symbol").when(F.col("r").isNull() | F.col("bars").isNull(), "no data").when(F.size("bars") == 0, "no valid bars"))
    ok = p.where("reason IS NULL")
    meta = ok.select(F.col("r.meta")["symbol"].alias("symbol"), F.map_filter("r.meta", lambda k, v: k.isin(META_KEYS)).alias("meta"))
    bars = ok.select(F.col("r.meta")["symbol"].alias("symbol"), F.col("r.meta")["currency"].alias("currency"), F.explode("bars").alias("b"))
    bars = bars.select("symbol", "currency", F.timestamp_seconds("b.t").alias("t"), "b.o", "b.h", "b.l", "b.c", F.coalesce("b.v", F.lit(0.0)).alias("v"))
    return bars, meta, p.where("reason IS NOT NULL").select("id", "reason")


def perp_bars(payloads: DataFrame) -> DataFrame:
    """``symbol, currency, t, o, h, l, c, v`` from lists of bars with numbers as text. payloads: ``symbol, body``."""
    bars = payloads.select("symbol", F.explode(F.from_json("body", "array<struct<t:bigint,o:string,h:string,l:string,c:string,v:string>>")).alias("b"))
    n = lambda c: F.col(f"b.{c}").try_cast("double").alias(c)
    return bars.select("symbol", F.lit("USD").alias("currency"), F.timestamp_millis("b.t").alias("t"), *map(n, "ohlcv")).dropna(subset=["t", "o", "h", "l", "c"])


def perp_contexts(payloads: DataFrame) -> DataFrame:
    """``symbol, funding_hourly, funding_annual, open_interest, mark, oracle, notional, previous``: names and
    contexts of a two-element array, aligned by position; rows with a missing number go. payloads: ``body``."""
    v = F.parse_json("body")
    names = F.variant_get(v, "$[0].universe", "array<struct<name string>>")
    contexts = F.variant_get(v, "$[1]", "array<struct<funding string, openInterest string, markPx string, oraclePx string, dayNtlVlm string, prevDayPx string>>")
    rows = payloads.select(F.explode(F.arrays_zip(names.alias("n"), contexts.alias("c"))).alias("x"))
    d = lambda c: F.col(f"x.c.{c}").try_cast("double")
    out = rows.select(F.upper("x.n.name").alias("symbol"), d("funding").alias("funding_hourly"), (d("funding") * 8760).alias("funding_annual"), d("openInterest").alias("open_interest"), d("markPx").alias("mark"), d("oraclePx").alias("oracle"), d("dayNtlVlm").alias("notional"), d("prevDayPx").alias("previous"))
    return out.dropna()


def derivative_facts(contexts: DataFrame) -> DataFrame:
    """Sign of the funding rate and open interest in money."""
    sign = F.when(F.col("funding_hourly") > 0, "positive").when(F.col("funding_hourly") < 0, "negative").otherwise("zero")
    return contexts.select("symbol", sign.alias("funding_sign"), "funding_annual", (F.col("open_interest") * F.col("mark")).alias("oi_notional"))


def filer_map(payloads: DataFrame) -> DataFrame:
    """``symbol, cik, title`` from an object with arbitrary keys. payloads: ``body``."""
    rows = payloads.select(F.explode(F.map_values(F.from_json("body", "map<string,struct<cik_str:bigint,ticker:string,title:string>>"))).alias("f"))
    return rows.select(F.upper("f.ticker").alias("symbol"), F.col("f.cik_str").alias("cik"), F.col("f.title").alias("title"))


def company_facts(payloads: DataFrame, unit: str = "USD") -> DataFrame:
    """``cik, company, tag, pos, start, end, val, form, fp, filed``: a filer's nested facts as a long table."""
    entry = "struct<start:string,end:string,val:double,accn:string,fy:int,fp:string,form:string,filed:string>"
    p = payloads.select(F.from_json("body", f"struct<cik:bigint,entityName:string,facts:map<string,map<string,struct<units:map<string,array<{entry}>>>>>>").alias("p"))
    tags = p.select(F.col("p.cik").alias("cik"), F.col("p.entityName").alias("company"), F.explode(F.col("p.facts")["us-gaap"]).alias("tag", "fact"))
    rows = tags.select("cik", "company", "tag", F.posexplode(F.col("fact.units")[unit]).alias("pos", "e"))
    return rows.select("cik", "company", "tag", "pos", "e.start", "e.end", "e.val", "e.form", "e.fp", "e.filed")


def read_bars_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="fecha DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE")


def write_bars_csv(bars: DataFrame, path: str) -> None:
    cols = [F.col(a).alias(b) for a, b in zip(("day", "o", "h", "l", "c", "v"), ("fecha", "open", "high", "low", "close", "volume"))]
    bars.select(*cols).sortWithinPartitions("fecha").write.mode("overwrite").csv(path, header=True)


def historical_extract(bars: DataFrame) -> DataFrame:
    """Prices rounded to four decimals, days as text."""
    return bars.select("symbol", F.date_format("t", "yyyy-MM-dd").alias("day"), *(F.round(c, 4).alias(c) for c in "ohlc"), "v")


# Bytes that audio and images may have.
AUDIO_LIMIT, IMAGE_LIMIT = 25 * 1024 * 1024, 10 * 1024 * 1024


def case_folders(spark: SparkSession, path: str, audio_limit: int = AUDIO_LIMIT, image_limit: int = IMAGE_LIMIT, bundled: bool = False) -> DataFrame:
    """One row a folder with a report: its media by name and extension; a voice question goes before audio. Files lie in their
    folder, or (as Spark writes them) in ``folder=.../name=.../part-...``, or in bundles."""
    f = files.read_files(spark, path, bundled).select("path", "length", "content")
    place = r"(?:folder=)?([^/]+)/(?:name=)?([^/]+?)(?:/part-[^/]+)?$"
    f = f.select(F.regexp_extract("path", place, 1).alias("folder"), F.regexp_extract("path", place, 2).alias("name"), "length", F.hex(F.substring("content", 1, 12)).alias("head"))
    voice, audio = F.col("name").rlike(r"^pregunta_voz\.(mp3|wav|m4a)$"), F.col("name").rlike(r"^audio\.(mp3|wav|m4a)$")
    image = F.col("name").rlike(r"(?i)\.(png|jpe?g|gif|webp)$")
    kind = F.when(F.col("head").like("89504E470D0A1A0A%"), "image/png").when(F.col("head").like("FFD8FF%"), "image/jpeg").when(F.col("head").like("47494638%"), "image/gif").when(F.col("head").like("52494646________57454250%"), "image/webp")
    too_big = F.when(F.col("length") == 0, "empty").when((voice | audio) & (F.col("length") > audio_limit), "audio too large").when(image & (F.col("length") > image_limit), "image too large")
    f = f.withColumn("reason", too_big)
    return f.groupBy("folder").agg(
        F.bool_or(F.col("name") == "informe.pdf").alias("report"), F.coalesce(F.min(F.when(voice, F.col("name"))), F.min(F.when(audio, F.col("name")))).alias("audio"),
        F.when(F.bool_or(voice), "question").when(F.bool_or(audio), "call").alias("role"), F.min(F.when(image, F.col("name"))).alias("image"), F.min(F.when(image, kind)).alias("image_type"), F.min("reason").alias("reason"),
    ).where("report").drop("report")


def text_assets(asked: DataFrame, folder: str) -> DataFrame:
    """``*, text``: the trimmed text of each named file of a folder, empty where it is absent. asked: ``name``."""
    files = asked.sparkSession.read.text(folder, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("text"))
    return asked.join(files, "name", "left").withColumn("text", F.coalesce("text", F.lit("")))
