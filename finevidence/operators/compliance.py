"""Sentences that recommend an investment: detection, removal, and what it does to outputs.

Each sentence is normalised (case, accents, invisible characters) and met by a fixed list of patterns, all
in Spark's own functions; sentences are regrouped by text, so a task holds one text at a time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finevidence.functions import text as X

NOTICE = "[Removed: not allowed as investment advice]"
REPORT_NOTICE = "Content was removed that broke the rule against investment advice."
SPOKEN = "Notice: made with artificial intelligence, for information only; it is no investment advice."
DISCLAIMER = "Generated with AI for information only. It is no investment advice and no recommendation to buy or sell."
# Vocabulary and patterns of recommendations in Spanish and English, on folded text.
_ACTION = r"(?:comprar|vender|acumular|infraponderar|sobreponderar|liquidar|(?:mantener|adquirir)\s+(?:mas\s+)?(?:las\s+|los\s+|la\s+|su\s+|tu\s+)?(?:acciones|titulos|valores|posicion))"
_ADVICE = r"(?:recom\w+|aconsej\w+|sug\w+|conviene|hay que|es (?:el |la )?(?:momento|hora) de|buen momento para|oportunidad de|aprovech\w+ para|deberi\w+|debes|toca|mi consejo es|nuestro consejo es)"
TARGET_PRICE = r"\b(?:precio[- ]objetivo|objetivo de precio|valor objetivo|cotizacion objetivo|price target|target price)\b"
MACRO = r"\b(?:regulador\w*|banco central|bce|fed|reserva federal|inflacion|regulator|central bank|ecb)\b"
SECURITY = r"\b(?:accion\w*|acciones|valor|titulo\w*|cotizacion|analista\w*|stock|shares?|equity|target price for)\b"
ANYWHERE = [
    rf"\b{_ADVICE}\b(?:\W+\w+){{0,4}}?\W+\b{_ACTION}\b",
    r"\b(?:compra|vende)\s+(?:ya|ahora|hoy)\b",
    r"\b(?:compre|compren|comprad|venda|vendan|vended)\s+(?:\w+\s+){0,2}(?:acciones|accion|titulos|valores|posicion)\b",
    r"\b(?:yo|nosotros)\s+(?:\w+\s+)?(?:comprari\w+|venderi\w+|acumulari\w+)\b",
    r"\boportunidad de compra\b|\bmerece\s+(?:una\s+)?(?:compra|venta)\b",
    r"\b(?:sobreponderar|infraponderar|sobreponderad\w+|infraponderad\w+)\b",
    r"\b(?:buy|sell)\s+(?:\w+\s+){0,2}(?:stock|shares|now)\b",
    TARGET_PRICE,
    r"\b(?:recomendacion|rating|calificacion|consejo)\s*:?\s*(?:de\s+)?(?:compra|venta|comprar|vender|mantener|neutral|sobreponderar|infraponderar)\b",
    r"\b(?:strong buy|strong sell|buy rating|sell rating|hold rating|overweight|underweight|outperform|underperform)\b",
    r"\b(?:comprari\w+|venderi\w+|acumulari\w+)\s+(?:\w+\s+){0,2}(?:acciones|accion|titulos|valores|posicion|el valor)\b",
    r"\bmerece\s+la\s+pena\s+(?:comprar|vender|acumular)\b",
    r"\b(?:should|must|ought to|recommend(?:s|ed)?(?: that you| to)?|advise[sd]?(?: to)?)\s+(?:buy|sell|accumulate|buying|selling|accumulating)\b",
    r"\b(?:recommend|advise|suggest)\w*\s+(?:a\s+)?(?:buy|sell)\b",
    r"\b(?:upgrade[sd]?|downgrade[sd]?|rated?|initiate[sd]?|reiterate[sd]?)\s+(?:to|at|as|with)?\s*(?:a\s+)?(?:buy|sell|hold|overweight|underweight|outperform|underperform|accumulate)\b",
    r"\b(?:rating|recommendation|call)\s*:?\s*(?:a\s+)?(?:buy|sell|hold|accumulate|reduce)\b",
]
AT_START = [
    r"^(?:compra|vende|acumula|compre|compren|venda|vendan)\s+(?!de\b|del\b|en\b|y\b|e\b|a\b|que\b|como\b)\w+",
    r"^(?:buy|sell|accumulate)\s+(?!back\b|side\b|and\b|of\b|in\b)\w+",
    r"^accumulate\b",
    r"^mantener\s+(?:la|su|tu)\s+posicion\b",
]


#: What a sentence must hold to match anything: one of these, and one of the patterns (also where a start pattern isn't at its start).
STEMS = ["compr", "vend", "venta", "acumul", "pondera", "liquidar", "mantener", "adquirir", "buy", "sell", "objetivo", "target", "neutral", "hold", "weight", "perform", "accumulat", "reduce"]
ANY = "|".join([*ANYWHERE, *(p.replace("^", r"\b", 1) for p in AT_START)])


def matches(folded: Column) -> Column:
    """``array<string>``: what a sentence says that it shouldn't, on its normalised form."""
    macro = folded.rlike(MACRO) & ~folded.rlike(SECURITY)
    every = [F.regexp_extract_all(folded, F.lit(p), F.lit(0)) for p in [*ANYWHERE, *AT_START]]
    found = F.filter(F.concat(*every), lambda m: ~(m.rlike(TARGET_PRICE) & macro))
    may = reduce(lambda a, b: a | b, (F.contains(folded, F.lit(s)) for s in STEMS))  # most sentences meet no pattern for it
    return F.when(may & folded.rlike(ANY), found).otherwise(F.array().cast("array<string>"))


def judged(text: str) -> Column:
    """``array<struct<s, matches>>`` of a text's sentences; each is normalised once, and a text is not normalised besides."""
    folded = F.transform(X.sentences(text), lambda s: F.struct(s.alias("s"), F.trim(X.visible(s)).alias("folded")))
    return F.transform(folded, lambda x: F.struct(x["s"].alias("s"), matches(x["folded"]).alias("matches")))


def violations(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``*keys, nth, match``: one row a match."""
    s = texts.select(*keys, F.posexplode(judged(text)).alias("nth", "x"))
    return s.select(*keys, "nth", F.explode("x.matches").alias("match"))


def clean(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``*keys, clean, removed``: a text without its offending sentences, the notice where none is left;
    texts without an offence stay exactly as they are, so do blank ones. Works within each row."""
    t = texts.select(*keys, F.col(text).alias("original"), judged(text).alias("judged"))
    kept = F.transform(F.filter("judged", lambda x: F.size(x["matches"]) == 0), lambda x: F.trim(x["s"]))
    removed = F.coalesce(F.aggregate("judged", F.lit(0), lambda a, x: a + F.size(x["matches"])), F.lit(0))
    shown = F.when(removed == 0, F.col("original")).when(F.size(kept) == 0, NOTICE).otherwise(F.array_join(kept, " "))
    return t.select(*keys, shown.alias("clean"), removed.cast("bigint").alias("removed"))


def sanitise_report(fields: DataFrame) -> DataFrame:
    """``report_id, fields, dropped, blocked``: fields (``report_id, kind, ord, text``) cleaned one by one;
    figures and limitations that offend are dropped, other fields lose sentences, empty ones go too. A report
    that lost anything says so in a last line."""
    c = clean(fields, ["report_id", "kind", "ord"])
    gone = (F.col("removed") > 0) & (F.col("kind").isin("figure", "limitation") | (F.col("clean") == NOTICE))
    kept = F.filter(F.array_sort(F.collect_list(F.when(~gone, F.struct("kind", "ord", "clean")))), lambda x: x.isNotNull())
    notice = F.when(F.bool_or(F.col("removed") > 0), F.array(F.lit(REPORT_NOTICE))).otherwise(F.array().cast("array<string>"))
    return c.groupBy("report_id").agg(F.array_join(F.concat(F.transform(kept, lambda x: x["clean"]), notice), "\n").alias("fields"), F.count(F.when(gone, 1)).alias("dropped"), F.bool_or(F.col("removed") > 0).alias("blocked"))


def gate(outputs: DataFrame) -> DataFrame:
    """``*, allowed, shown``: speech that was removed as a whole isn't spoken, an offending image prompt isn't
    drawn, an answer is cleaned. Speech ends with the spoken notice, an answer with the written one. outputs: ``id, kind, text``."""
    c = clean(outputs, ["id", "kind"])
    allowed = F.when(F.col("kind") == "speech", F.col("clean") != NOTICE).when(F.col("kind") == "image", F.col("removed") == 0).otherwise(True)
    ending = F.when(F.col("kind") == "speech", " " + SPOKEN).when(F.col("kind") == "image", "").otherwise("\n\n" + DISCLAIMER)
    return c.select("id", "kind", allowed.alias("allowed"), F.when(allowed, F.concat("clean", ending)).alias("shown"))
