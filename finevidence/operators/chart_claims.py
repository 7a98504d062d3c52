"""Claims of a chart reading against the levels and the range that the bars give.

One Arrow UDF finds the numbers of each sentence, as positions are needed; what a number is (price, level, zone,
or a percentage, period, date, year or volume and no claim) follows from columns, ranges, levels and verdicts from
joins on the symbol.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finevidence.functions.numbers import readings

# Margins of range and level, least whole number, words that make a number something else than a price.
RANGE_MARGIN, LEVEL_BAND, LEAST = 0.03, 0.03, 10
_MONTH = r"(?:ene(?:ro)?|feb(?:rero)?|mar(?:zo)?|abr(?:il)?|may(?:o)?|jun(?:io)?|jul(?:io)?|ago(?:sto)?|sep(?:t(?:iembre)?)?|oct(?:ubre)?|nov(?:iembre)?|dic(?:iembre)?)"
_NUMBER = re.compile(r"(?<![\w.,])(\d{1,3}(?:[.,]\d{3})+(?:[.,]\d+)?|\d+(?:[.,]\d+)?)(\s?[kK]\b)?(\s?%)?")
_INDICATOR = r"\b(?:SMA|EMA|RSI|MA|MM|MACD|medias?|sesion(?:es)?|velas?|d[ií]as?)\b"
_PERIOD_END = r"per[ií]odo\s*$"
_CLAUSE_CUT = r"[,;:()]|\d"
_PRICE_WORD = r"\b(?:soporte|resistencia|precio|cierre|cierra|m[aá]ximo|m[ií]nimo|nivel|support|resistance)\b"
_OSCILLATOR = r"\b(?:RSI|MACD)\s*\(?(?:\d+\)?\s*(?:en|a|de|=|:|est[aá]\s+en|se\s+sit[uú]a\s+en|marca)?)?\s*$"
_PERIOD_AFTER = rf"\s*(?:de\s+)?(?:d[ií]as?|velas?|sesiones?|semanas?|meses|mes|horas?|a[ñn]os?|veces|x\b|{_MONTH}\b)"
_YEAR_BEFORE = rf"(?:\b{_MONTH}\.?|\bde|\bdel|\ba[ñn]o|\bdesde|\bhasta)\s*$"
_ZONE = r"\s*(?:-|–|—|a|y|hasta|and|to)\s*"
_SENTENCES = re.compile(r"(?<=[.;!?])\s+|\n+")
_VOLUME = r"\bvol[uú]men(?:es)?\b|\bvolume\b"
_LEVEL = r"soporte|resistencia|support|resistance"
_MONTH_DOT = re.compile(rf"\b({_MONTH})\.", re.I)
WINDOW = 6

NUMBERS = T.ArrayType(T.StructType([
    T.StructField("sentence_nth", T.IntegerType()), T.StructField("sentence", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
    T.StructField("number", T.StringType()), T.StructField("thousands", T.BooleanType()), T.StructField("percent", T.BooleanType()), T.StructField("values", T.ArrayType(T.DoubleType())),
]))


@F.pandas_udf(NUMBERS)
def sentence_numbers(texts: pd.Series) -> pd.Series:
    """Numbers of each sentence with their places; ``values``: what the notation allows, in full units."""

    def of(text: str) -> list[tuple]:
        found = []
        for nth, sentence in enumerate(_SENTENCES.split(_MONTH_DOT.sub(r"\1", text))):
            for m in _NUMBER.finditer(sentence):
                unit = 1000 if m.group(2) else 1
                found.append((nth, sentence, m.start(), m.end(), m.group(1), bool(m.group(2)), bool(m.group(3)), [unit * d / 10**k for d, k in readings(m.group(1))]))
        return found

    return texts.map(lambda t: of(t or ""))


def _says(c: Column, pattern: str, where: str = "{}") -> Column:
    return c.rlike("(?iuU)" + where.format(f"(?:{pattern})"))


def price_claims(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``*keys, nth, kind, token, values, zone, year``: price and level claims of each text, zones as one; what is said
    of volume makes none. keys: of one text."""
    topic = _says(F.col(text), _VOLUME, r"^\s*{}")
    n = texts.where(~topic).select(*keys, _says(F.col(text), _VOLUME).alias("volume"), F.explode(sentence_numbers(text)).alias("x")).select(*keys, "volume", "x.*")
    before, after = F.left("sentence", F.col("start")), F.substr("sentence", F.col("end") + 1, F.length("sentence"))
    whole = F.when(F.col("number").rlike(r"(?U)^\d+$") & ~F.col("thousands"), F.col("number").try_cast("bigint"))
    # the words since the last mark, number or price word, as far as they can name an indicator
    clause = F.regexp_replace(before, f"(?iusU)^.*(?:{_CLAUSE_CUT}|{_PRICE_WORD})", "")
    near = F.concat(F.array_join(F.slice(F.filter(F.split(clause, r"(?U)\s+"), lambda w: w != ""), -WINDOW, WINDOW), " "), F.when(clause.endswith(" "), " ").otherwise(""))
    near = F.when(F.size(F.filter(F.split(clause, r"(?U)\s+"), lambda w: w != "")) > WINDOW, near).otherwise(F.ltrim(clause))
    rules = [
        F.col("percent"), F.col("thousands") & F.col("volume"), _says(near, _INDICATOR) | _says(near, _PERIOD_END), _says(before, _OSCILLATOR), _says(after, _PERIOD_AFTER, "^{}"),
        before.rlike(r"(?U)\d[-/]$") | after.rlike(r"(?U)^[-/]\d"), F.coalesce(whole < LEAST, F.lit(False)), F.coalesce(whole.between(1900, 2100), F.lit(False)) & _says(before, _YEAR_BEFORE),
    ]
    is_claim = ~reduce(lambda a, b: a | b, rules)
    c = n.where(is_claim).select(*keys, "sentence_nth", "sentence", "start", "end", "values", F.trim(F.substr("sentence", F.col("start") + 1, F.col("end") - F.col("start"))).alias("token"),
                                 F.when(_says(F.col("sentence"), _LEVEL), "level").otherwise("price").alias("kind"), F.coalesce(whole.between(1900, 2100), F.lit(False)).alias("year"))
    # neighbouring levels that only a zone word parts are taken two by two, as the ends of a zone
    along = Window.partitionBy(*keys, "sentence_nth").orderBy("start")
    between = F.substr("sentence", F.lag("end").over(along) + 1, F.col("start") - F.lag("end").over(along))
    linked = F.coalesce((F.col("kind") == "level") & _says(between, _ZONE, "^{}$"), F.lit(False))
    c = c.withColumn("linked", linked).withColumn("chain", F.sum((~F.col("linked")).cast("int")).over(along))
    in_chain = Window.partitionBy(*keys, "sentence_nth", "chain").orderBy("start")
    c = c.withColumn("second", F.row_number().over(in_chain) % 2 == 0)
    far = lambda x: F.when(F.lead("second").over(along), F.lead(x).over(along))
    zone = F.coalesce(F.lead("second").over(along), F.lit(False))
    c = c.select(*keys, "sentence_nth", "start", "kind", "second", "year", zone.alias("zone"), F.concat_ws(" - ", "token", far("token")).alias("token"), F.when(zone, F.array(F.array_min("values"), F.array_max(far("values")))).otherwise(F.col("values")).alias("values")).where("NOT second")
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("sentence_nth", "start")) - 1
    return c.select(*keys, nth.alias("nth"), "kind", "token", "values", "zone", "year")


def level_verdicts(claims_: DataFrame, levels: DataFrame, band: float = LEVEL_BAND) -> DataFrame:
    """``*keys, nearest, distance, verdict``: each claimed level against the symbol's levels above 0.

    The level of least relative distance is a neighbour of the value in order, so values and levels of a symbol are sorted together and
    each value sees the last level up to it and the first after it; no pairs are made. A level is confirmed if its nearest is within
    the band; a zone, if the first level from its lower end (less the band) on lies within its upper end (plus the band)."""
    keys = ["reading_id", "part", "nth"]
    known = levels.where("level > 0").select("symbol", F.col("level").alias("x"), F.lit(True).alias("known")).distinct()
    ends = F.array(F.struct(F.array_min("values").alias("low"), F.array_max("values").alias("high")))
    each = F.transform("values", lambda v: F.struct(v.alias("x"), F.lit(False).alias("opens"), F.lit(None).cast("double").alias("to")))
    zone = F.transform(F.when(F.col("zone"), ends).otherwise(F.slice(ends, 1, 0)), lambda z: F.struct((z["low"] * (1 - band)).alias("x"), F.lit(True).alias("opens"), (z["high"] * (1 + band)).alias("to")))
    asked = claims_.select("symbol", *keys, "zone", F.explode(F.concat(each, zone)).alias("q")).select("symbol", *keys, "zone", "q.*")
    both = asked.withColumn("known", F.lit(False)).unionByName(known, allowMissingColumns=True)
    level = F.when(F.col("known"), F.col("x"))
    up = Window.partitionBy("symbol").orderBy("x", F.desc("known")).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("symbol").orderBy(F.desc("x"), F.desc("known")).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("below", F.last(level, ignorenulls=True).over(up)).withColumn("above", F.last(level, ignorenulls=True).over(down)).where("NOT known")
    near = F.filter(F.transform(F.array("below", "above"), lambda n: F.struct((F.abs(F.col("x") - n) / n).alias("distance"), n.alias("level"))), lambda s: s["level"].isNotNull())
    best = F.min(F.when(~F.col("opens"), F.array_min(near)))
    inside = F.bool_or(F.col("opens") & F.coalesce(F.col("above") <= F.col("to"), F.lit(False)))
    out = met.groupBy(*keys).agg(best.alias("best"), inside.alias("inside"), F.first("zone").alias("zone")).where("best IS NOT NULL")
    confirmed = F.when(F.col("zone"), F.col("inside")).otherwise(F.col("best.distance") <= band)
    return out.select(*keys, F.col("best.level").alias("nearest"), F.col("best.distance").alias("distance"), F.when(confirmed, "confirmed").otherwise("disagrees").alias("verdict"))


def check_readings(readings_: DataFrame, technicals: DataFrame, levels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verdicts (``reading_id, part, nth, kind, verdict``) and the score of each reading (confirmed of the
    verifiable ones; 0.5 if none is). readings: ``reading_id, symbol, trend, description, observations``."""
    texts = readings_.select("reading_id", "symbol", F.posexplode(F.concat(F.array("description"), "observations")).alias("part", "text"))
    c = price_claims(texts, ["reading_id", "symbol", "part"])
    span = technicals.select("symbol", (F.col("range_low") * (1 - RANGE_MARGIN)).alias("low"), (F.col("range_high") * (1 + RANGE_MARGIN)).alias("high"), F.col("trend").alias("real_trend"))
    c = c.join(span, "symbol").where(~(F.col("year") & ~F.col("values")[0].between(F.col("low"), F.col("high"))))
    inside = F.exists("values", lambda v: v.between(F.col("low"), F.col("high")))
    prices = c.where("kind = 'price'").select("reading_id", "part", "nth", "kind", F.when(inside, "confirmed").otherwise("disagrees").alias("verdict"))
    of_levels = level_verdicts(c.where("kind = 'level'"), levels).select("reading_id", "part", "nth", F.lit("level").alias("kind"), "verdict")
    says: Column = F.when(F.col("trend") == "undetermined", "not_verifiable").when(F.col("trend") == F.col("real_trend"), "confirmed").otherwise("disagrees")
    trend = readings_.join(span, "symbol").select("reading_id", F.lit(-1).alias("part"), F.lit(0).alias("nth"), F.lit("trend").alias("kind"), says.alias("verdict"))
    every = trend.unionByName(prices).unionByName(of_levels)
    yes, no = F.count(F.when(F.col("verdict") == "confirmed", 1)), F.count(F.when(F.col("verdict") == "disagrees", 1))
    score = every.groupBy("reading_id").agg(yes.alias("confirmed"), no.alias("disagrees"), F.coalesce(F.try_divide(yes.cast("double"), (yes + no).cast("double")), F.lit(0.5)).alias("score"))
    return every, score
