"""Verification of cited figures against pages, filings and market values.

figures: ``report_id, ord, name, value, citations array<struct<origin, location>>``. Cited pages are found
first and only those are scanned; the numbers of a figure meet those of its pages by an equi-join on document, page and what
equivalent numbers share, their mantissa or their value rounded at a scale, and only those that meet are compared. A figure is
verified on the first cited page that has all its numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finevidence.functions import numbers as N
from finevidence.functions import text as X

# Rounding tolerance in units of the last cited digit, digits that an unscaled number needs, market band, range of pages.
TOLERANCE, MIN_DIGITS, MARKET_BAND, MAX_RANGE = 0.75, 3, 0.01, 50
SHIFTS = [0, 3, -3, 6, -6, 9, -9]
# What a market figure's name or value says, in order of precedence, and the keys it may match.
ALIASES = [
    (r"\brsi(?:\s*\(?\s*\d+\s*\)?)?(?![a-z])", ["rsi"]), (r"\bsma\s*\(?\s*50\b|media.{0,20}\b50\b", ["sma50"]), (r"\bsma\s*\(?\s*20\b|media.{0,20}\b20\b", ["sma20"]),
    (r"\bsma\b|media movil|moving average", ["sma20", "sma50"]), (r"\bema(?:\s*\(?\s*\d+\s*\)?)?(?![a-z])", ["ema"]),
    (r"cierre|close|ultimo precio|precio actual|cotizacion", ["close"]), (r"rentabilidad|retorno|return|variacion", ["return"]), (r"volatilidad|volatility", ["volatility"]),
    (r"drawdown|caida maxima", ["drawdown"]), (r"maximo|maximum|\bhigh\b|\bmax\b", ["high"]), (r"minimo|minimum|\blow\b|\bmin\b", ["low"]),
    (r"soporte|support", ["support"]), (r"resistencia|resistance", ["resistance"]), (r"funding", ["funding"]), (r"open interest|interes abierto|\boi\b", ["oi", "oi_notional"]),
    (r"volumen|volume", ["volume"]), (r"\bmark\b|oraculo|oracle", ["price"]),
]
_PAGE = r"(?i)\b(?:pp?|pags?|p[aá]g(?:inas?)?|pages?)\.?\s*(\d+)(?:\s*[-–]\s*(\d+))?"
_KEY = ["report_id", "ord"]


def _large(rows: DataFrame) -> DataFrame:
    """The side of a join that grows with the data: its size is guessed from its files, before its arrays are built and exploded, so it would
    be broadcast where it is far larger than the guess."""
    return rows.hint("merge")


def value_of(r: Column) -> Column:
    return r["m"] * F.pow(F.lit(10.0), r["e"])


def equivalent(a: Column, b: Column) -> Column:
    """Whether source reading ``b`` is the cited reading ``a``: exact, or by scale and rounding."""
    shifts = F.when(a["scaled"] & b["scaled"], F.array(F.lit(0))).otherwise(F.array(*map(F.lit, SHIFTS)))
    long_enough = (a["scaled"] | (a["digits"] >= MIN_DIGITS)) & (b["scaled"] | (b["digits"] >= MIN_DIGITS))
    close = lambda k: (b["unit_e"] + k <= a["unit_e"]) & (F.abs(value_of(a) - value_of(b) * F.pow(F.lit(10.0), k)) < TOLERANCE * F.pow(F.lit(10.0), a["unit_e"]))
    shifted = F.exists(shifts, lambda k: ((a["m"] == b["m"]) & (a["e"] == b["e"] + k)) | close(k))
    loose = (a["unit"] == "") & (b["unit"] == "") & (a["scaled"] | b["scaled"]) & long_enough & shifted
    return ((a["unit"] == "") | (a["unit"] == b["unit"])) & (((a["m"] == b["m"]) & (a["e"] == b["e"])) | loose)


def may_round(r: Column) -> Column:
    """Whether a reading can be equivalent to another by rounding."""
    return (r["unit"] == "") & (r["scaled"] | (r["digits"] >= MIN_DIGITS))


def _key(kind: Column | int, value: Column) -> Column:
    return F.struct((kind if isinstance(kind, Column) else F.lit(kind)).cast("int").alias("scale"), value.cast("bigint").alias("value"))


#: The scales that stand for a mantissa and for any number; scales of numbers are small.
_MANTISSA, _ANY = 1000, 1001


def source_keys(b: Column) -> Column:
    """Keys of a source reading: its mantissa, and its value in units of 10^s, rounded, for each s from its last digit to
    one beyond its first. They are as many as it has digits. One key is shared by all readings."""
    top = F.when(b["m"] > 0, F.floor(F.log10(b["m"].cast("double"))).cast("int") + b["e"] + 2).otherwise(b["unit_e"])
    scales = F.when(may_round(b), F.sequence(b["unit_e"], F.greatest(b["unit_e"], top))).otherwise(F.array().cast("array<int>"))
    rounded = F.transform(scales, lambda s: _key(s, F.round(b["m"] * F.pow(F.lit(10.0), b["e"] - s))))
    return F.concat(F.array(_key(_MANTISSA, b["m"]), _key(_ANY, F.lit(0))), rounded)


def cited_keys(a: Column) -> Column:
    """Keys under which the sources of a cited reading stand: its mantissa, and for each shift its digits and those next
    to them, as the tolerance is under one and a half units from a rounded value."""
    digits = F.round(value_of(a) / F.pow(F.lit(10.0), a["unit_e"]))
    near = F.flatten(F.transform(F.array(*map(F.lit, SHIFTS)), lambda k: F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: _key(a["unit_e"] - k, digits + d))))
    none = F.array().cast("array<struct<scale:int,value:bigint>>")
    any_ = F.when(a["m"] == 0, F.array(_key(_ANY, F.lit(0)))).otherwise(none)  # what rounds to zero has no first digit
    return F.concat(F.array(_key(_MANTISSA, a["m"])), any_, F.when(may_round(a), near).otherwise(none))


def cited_pages() -> tuple[Column, Column]:
    """Of a figure's ``citations``: distinct pages of document citations in order, and whether one of them has a location without a
    valid page."""
    docs = F.filter("citations", lambda c: c["origin"] == "document")
    spans = lambda loc: F.zip_with(F.regexp_extract_all(loc, F.lit(_PAGE), F.lit(1)), F.regexp_extract_all(loc, F.lit(_PAGE), F.lit(2)), lambda a, b: F.struct(F.expr("1").alias("x"), a.try_cast("int").alias("a"), F.coalesce(F.nullif(b, F.lit("")).try_cast("int"), a.try_cast("int")).alias("b")))
    valid = lambda loc: F.filter(spans(loc), lambda s: (s["a"] <= s["b"]) & (s["b"] <= s["a"] + MAX_RANGE))
    pages = F.flatten(F.transform(docs, lambda c: F.flatten(F.transform(valid(c["location"]), lambda s: F.sequence(s["a"], s["b"])))))
    return F.array_distinct(pages), F.exists(docs, lambda c: (F.trim(c["location"]) != "") & (F.size(valid(c["location"])) == 0))


def figure_numbers() -> Column:
    """Readings of a figure's ``value``; an indicator's period is no number of it."""
    return N.cited_numbers(F.regexp_replace("value", r"(?i)\b(rsi|sma|ema|ma|mm)\s*\(?\s*\d+\s*\)?", "$1"))


def checkable(figures: DataFrame) -> DataFrame:
    """Adds pages, malformed, nums, and ``checkable``: a checkable source, and a number that is more than a
    year or an integer under 10."""
    trivial = F.forall(F.filter("nums", lambda r: F.col("nums")[0].isNotNull()), lambda r: r["plain"] & ((value_of(r) < 10) | value_of(r).between(1900, 2100)))
    pages, broken = cited_pages()
    f = figures.withColumns({"pages": pages, "malformed": broken, "nums": figure_numbers()})
    source = (F.size("pages") > 0) | F.col("malformed") | F.exists("citations", lambda c: c["origin"].isin("sec", "market"))
    return f.withColumn("checkable", source & (F.size("nums") > 0) & ~trivial)


def match_documents(figures: DataFrame, pages: DataFrame) -> DataFrame:
    """``report_id, ord, page, matched`` of figures verified on a cited page. figures: as from ``checkable``,
    with doc_id; pages: ``doc_id, page, text``."""
    cited = figures.where("checkable").select("doc_id", *_KEY, "nums", F.posexplode("pages").alias("page_nth", "page"))
    scanned = pages.join(_large(cited.select("doc_id", "page").distinct()), ["doc_id", "page"], "left_semi")
    found = scanned.select("doc_id", "page", F.explode(N.page_numbers("text")).alias("b"))
    want = cited.select("doc_id", *_KEY, "page_nth", "page", F.array_max(F.transform("nums", lambda r: r["nth"])).alias("last"), F.explode("nums").alias("a"))
    hits = want.withColumn("key", F.explode(cited_keys(F.col("a")))).join(_large(found.withColumn("key", F.explode(source_keys(F.col("b"))))), ["doc_id", "page", "key"]).where(equivalent(F.col("a"), F.col("b")))
    each = hits.groupBy(*_KEY, "page_nth", "page", "last", F.col("a.nth").alias("nth")).agg(F.min_by("b.fragment", "b.nth").alias("fragment"))
    whole = each.groupBy(*_KEY, "page_nth", "page", "last").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("nth", "fragment"))).alias("fragments")).where(F.col("n") == F.col("last") + 1)
    first = whole.groupBy(*_KEY).agg(F.min_by(F.struct("page", "fragments"), "page_nth").alias("x"))
    return first.select(*_KEY, F.col("x.page").alias("page"), F.array_join(F.array_distinct(F.transform("x.fragments", lambda f: f["fragment"])), " · ").alias("matched"))


def match_filings(figures: DataFrame, facts: DataFrame) -> DataFrame:
    """``report_id, ord, matched``: figures that cite filings, against ``cik, nth, label, fy, value, unit``."""
    b = F.struct(F.abs("value").cast("decimal(30,2)").alias("d"))
    whole = F.regexp_replace(b["d"].cast("string"), r"\.?0+$", "")
    scaled = facts.select("cik", F.col("nth").alias("fact"), F.format_string("%s FY%d: %s M %s", "label", "fy", F.format_number(F.col("value") / 1e6, 0), "unit").alias("fragment"),
                          F.regexp_replace(whole, r"\.", "").try_cast("bigint").alias("m0"), F.length(F.regexp_extract(whole, r"\.(\d+)", 1)).alias("dec"), F.abs("value").alias("v"))
    want = figures.where(F.col("checkable") & F.exists("citations", lambda c: c["origin"] == "sec")).select("cik", *_KEY, F.array_max(F.transform("nums", lambda r: r["nth"])).alias("last"), F.explode("nums").alias("a"))
    a = F.col("a")
    near = F.exists(F.array(*map(F.lit, SHIFTS)), lambda k: (k <= a["unit_e"]) & (F.abs(value_of(a) - F.col("v") * F.pow(F.lit(10.0), k)) < TOLERANCE * F.pow(F.lit(10.0), a["unit_e"])))
    same = F.abs(value_of(a) - F.col("v")) < 1e-9 * (1 + F.col("v"))
    hits = want.join(_large(scaled), "cik").where((a["unit"] == "") & (same | (a["scaled"] & near)))
    each = hits.groupBy(*_KEY, "last", a["nth"].alias("nth")).agg(F.min_by("fragment", "fact").alias("fragment"))
    whole = each.groupBy(*_KEY, "last").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("nth", "fragment"))).alias("f")).where(F.col("n") == F.col("last") + 1)
    return whole.select(*_KEY, F.array_join(F.array_distinct(F.transform("f", lambda x: x["fragment"])), " · ").alias("matched"))


def market_targets(technicals: DataFrame) -> DataFrame:
    """``symbol, nth, key, label, target, fraction``: a symbol's values as rows, nulls left out, levels numbered."""
    single = [("close", "Last close", "last_close", False), ("sma20", "SMA20", "sma20", False), ("sma50", "SMA50", "sma50", False), ("ema", "EMA20", "ema20", False), ("rsi", "RSI14", "rsi14", False), ("low", "Period low", "range_low", False), ("high", "Period high", "range_high", False), ("return", "Period return", "period_return", True), ("volatility", "Annual volatility", "volatility_annual", True), ("drawdown", "Max drawdown", "max_drawdown", True)]
    rows = [F.struct(F.lit(i).alias("nth"), F.lit(k).alias("key"), F.lit(label).alias("label"), F.col(c).cast("double").alias("target"), F.lit(f).alias("fraction")) for i, (k, label, c, f) in enumerate(single)]
    level = lambda key, name, c, base: F.transform(c, lambda v, i: F.struct((i + base).alias("nth"), F.lit(key).alias("key"), F.concat(F.lit(name + " "), (i + 1).cast("string")).alias("label"), v.cast("double").alias("target"), F.lit(False).alias("fraction")))
    every = F.concat(F.array(*rows), level("support", "Support", "supports", 10), level("resistance", "Resistance", "resistances", 20))
    return technicals.select("symbol", F.explode(F.filter(every, lambda x: x["target"].isNotNull())).alias("x")).select("symbol", "x.*")


def derivative_targets(derivatives: DataFrame) -> DataFrame:
    """``symbol, nth, key, label, target, fraction`` of derivative contexts (as from ``payloads.perp_contexts``), to go
    with those of ``market_targets``; nulls left out."""
    d = F.col
    rows = [
        ("funding", F.lit("Annual funding"), d("funding_annual"), True), ("funding", F.lit("Hourly funding"), d("funding_hourly"), True),
        ("oi", F.concat(F.lit("Open interest ("), d("symbol"), F.lit(")")), d("open_interest"), False), ("oi_notional", F.lit("Open interest, notional"), d("open_interest") * d("mark"), False),
        ("price", F.lit("Mark price"), d("mark"), False), ("price", F.lit("Oracle price"), d("oracle"), False), ("volume", F.lit("Notional volume 24 h"), d("notional"), False), ("price", F.lit("Previous close"), d("previous"), False),
    ]
    every = F.array(*(F.struct(F.lit(30 + i).alias("nth"), F.lit(k).alias("key"), label.alias("label"), v.cast("double").alias("target"), F.lit(f).alias("fraction")) for i, (k, label, v, f) in enumerate(rows)))
    return derivatives.select("symbol", F.explode(F.filter(every, lambda x: x["target"].isNotNull())).alias("x")).select("symbol", "x.*")


def alias_keys(name: Column, value: Column) -> Column:
    """Keys that a figure may match; null where its text names none, so all may."""
    t = X.fold(F.concat_ws(" ", name, value))
    out = F.when(t.rlike(ALIASES[0][0]), F.array(*map(F.lit, ALIASES[0][1])))
    for pattern, keys in ALIASES[1:]:
        out = out.when(t.rlike(pattern), F.array(*map(F.lit, keys)))
    return out


def match_market(figures: DataFrame, targets: DataFrame) -> DataFrame:
    """``report_id, ord, matched``: figures that cite the market, within 1 % of the symbol's values."""
    want = figures.where(F.col("checkable") & F.exists("citations", lambda c: c["origin"] == "market")).select("symbol", *_KEY, alias_keys(F.col("name"), F.col("value")).alias("keys"), F.array_max(F.transform("nums", lambda r: r["nth"])).alias("last"), F.posexplode("nums").alias("reading", "a"))
    a = F.abs(value_of(F.col("a")))
    near = lambda t: F.abs(a - F.abs(t)) <= MARKET_BAND * F.abs(t)
    fits = ((F.col("a.unit") != "%") | F.col("fraction")) & (near(F.col("target")) | (F.col("fraction") & near(F.col("target") * 100)))
    hits = want.join(_large(targets), "symbol").where((F.col("keys").isNull() | F.array_contains("keys", F.col("key"))) & fits)
    each = hits.groupBy(*_KEY, "last", F.col("a.nth").alias("num")).agg(F.min_by("label", F.struct("reading", "nth")).alias("fragment"))
    whole = each.groupBy(*_KEY, "last").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("num", "fragment"))).alias("f")).where(F.col("n") == F.col("last") + 1)
    return whole.select(*_KEY, F.array_join(F.array_distinct(F.transform("f", lambda x: x["fragment"])), " · ").alias("matched"))


def check_figures(figures: DataFrame, pages: DataFrame, facts: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """``report_id, ord, name, value, status, page, matched, source``; documents go before filings and those
    before the market. Figures hold doc_id, and cik and symbol where those sources are given."""
    f = checkable(figures)
    out = f.join(_large(match_documents(f, pages).withColumnsRenamed({"matched": "in_document", "page": "found_page"})), _KEY, "left")
    none = F.lit(None).cast("string")
    out = out.join(_large(match_filings(f, facts).withColumnRenamed("matched", "in_filing")), _KEY, "left") if facts is not None else out.withColumn("in_filing", none)
    out = out.join(_large(match_market(f, targets).withColumnRenamed("matched", "in_market")), _KEY, "left") if targets is not None else out.withColumn("in_market", none)
    matched = F.coalesce("in_document", "in_filing", "in_market")
    status = F.when(~F.col("checkable"), "no_source").when(matched.isNotNull(), "verified").otherwise("not_found")
    source = F.when(F.col("in_document").isNotNull(), "document").when(F.col("in_filing").isNotNull(), "sec").when(F.col("in_market").isNotNull(), "market")
    page = F.when(F.col("in_document").isNotNull(), F.col("found_page")).when(F.col("checkable") & matched.isNull() & (F.size("pages") > 0), F.get("pages", F.lit(0)))
    return out.select(*_KEY, "name", "value", status.alias("status"), page.cast("bigint").alias("page"), matched.alias("matched"), source.alias("source"))


def summary(checks: DataFrame) -> DataFrame:
    """Per report: figures, verified ones, distinct pages cited by verified ones in order."""
    ok = F.col("status") == "verified"
    return checks.groupBy("report_id").agg(F.count("*").alias("figures"), F.count(F.when(ok, 1)).alias("verified"), F.array_join(F.sort_array(F.collect_set(F.when(ok, F.col("page")))), ",").alias("pages"))


def verified_by_origin(figures: DataFrame, checks: DataFrame) -> DataFrame:
    """``report_id, origin, figures, verified``: by the origin of each figure's first citation, ``none`` where it has none."""
    first = figures.select(*_KEY, F.coalesce(F.get("citations", F.lit(0))["origin"], F.lit("none")).alias("origin"))
    return first.join(_large(checks.select(*_KEY, "status")), _KEY).groupBy("report_id", "origin").agg(F.count("*").alias("figures"), F.count(F.when(F.col("status") == "verified", 1)).alias("verified"))


def source_flags(figures: DataFrame, origins: list[str]) -> DataFrame:
    """Each figure's flag of every origin that it cites, and how many kinds these are."""
    cited = F.array_distinct(F.transform("citations", lambda c: c["origin"]))
    flags = [F.coalesce(F.array_contains(cited, o), F.lit(False)).alias(o) for o in origins]
    return figures.select(*_KEY, *flags, F.size(F.array_intersect(cited, F.array(*map(F.lit, origins)))).cast("bigint").alias("kinds"))


def source_matrix(figures: DataFrame) -> DataFrame:
    """Per report: citations and distinct origins."""
    return figures.groupBy("report_id").agg(F.sum(F.size("citations")).alias("citations"), F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.transform("citations", lambda c: c["origin"]))))), ",").alias("origins"))


def top_cards(checks: DataFrame, most: int = 6) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("report_id").orderBy("ord"))
    return checks.where("status = 'verified'").withColumn("nth", nth).where(F.col("nth") <= most)


def market_contradictions(texts: DataFrame, technicals: DataFrame) -> DataFrame:
    """``report_id, average, says, real``: sentences about the price that put it on the wrong side of an
    average. texts: ``report_id, symbol, text``."""
    relation = r"\b(por encima|por debajo|encima|debajo|sobre|bajo|above|below)\s+(?:de\s+)?(?:la\s+|el\s+|su\s+|the\s+)?(?:sma|media\s+movil|moving\s+average|ma)\s*(?:de\s+)?\(?\s*(20|50)\b"
    s = texts.select("report_id", "symbol", F.explode(X.sentences(X.fold("text"))).alias("s")).where(F.col("s").rlike(r"\b(precio|cierre|cotizacion|price|close|cotiza|cotizando)\b"))
    both = F.arrays_zip(F.regexp_extract_all("s", F.lit(relation), F.lit(1)).alias("side"), F.regexp_extract_all("s", F.lit(relation), F.lit(2)).alias("average"))
    c = s.select("report_id", "symbol", F.explode(both).alias("c")).select("report_id", "symbol", "c.*").join(technicals.select("symbol", "last_close", "sma20", "sma50"), "symbol")
    mean = F.when(F.col("average") == "20", F.col("sma20")).otherwise(F.col("sma50"))
    up = F.col("side").isin("por encima", "encima", "sobre", "above")
    return c.where(mean.isNotNull() & (up != (F.col("last_close") > mean))).select("report_id", F.concat(F.lit("sma"), "average").alias("average"), F.when(up, "above").otherwise("below").alias("says"), F.when(F.col("last_close") > mean, "above").otherwise("below").alias("real")).distinct()


def paired_checks(figures: DataFrame, checks: DataFrame) -> DataFrame:
    """``report_id, ord, name, value, status, matched, paired`` for every figure: the check of equal name and value (of several the
    last), else the last of equal name, else none, and the figure is unverified. checks: as from ``check_figures``."""
    last = lambda keys, name: checks.groupBy("report_id", *keys).agg(F.max_by(F.struct("status", "matched"), "ord").alias(name))
    own = figures.select(*_KEY, "name", "value").join(last(["name", "value"], "by_value"), ["report_id", "name", "value"], "left").join(last(["name"], "by_name"), ["report_id", "name"], "left")
    found = F.coalesce("by_value", "by_name")
    paired = F.when(F.col("by_value").isNotNull(), "value").when(F.col("by_name").isNotNull(), "name")
    return own.select(*_KEY, "name", "value", F.coalesce(found["status"], F.lit("unverified")).alias("status"), found["matched"].alias("matched"), paired.alias("paired"))
