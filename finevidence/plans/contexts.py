"""Queries on payload readers, questions, transcripts, labels and joined contexts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from finevidence.functions import text as X
from finevidence.operators import chart_claims, figures, filings, reports, routing
from finevidence.operators import runs as R
from finevidence.operators import technicals as T
from finevidence.plans import evidence as E
from finevidence.plans import market as M
from finevidence.sources import adapters as A
from finevidence.sources import payloads


def _perps(spark, sf_dir):
    """Parts as perpetuals: one payload a hundred of them, names and contexts by position."""
    p = A.table(spark, sf_dir, "part")
    text = lambda c: c.cast("string")
    k = F.col("p_partkey")
    context = F.struct(text((k % 7 - 3) / 10000).alias("funding"), text(k * 2).alias("openInterest"), F.when(k % 11 == 0, F.lit(None)).otherwise(text(k % 97 + 1)).alias("markPx"), text(k % 97 + 2).alias("oraclePx"), text(k * 5).alias("dayNtlVlm"), text(k % 97 + 3).alias("prevDayPx"))
    rows = p.groupBy(F.floor(k / 100).alias("g")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", context.alias("c")))).alias("x"))
    names = F.to_json(F.struct(F.transform("x", lambda r: F.struct(F.concat(F.lit("p"), r["p_partkey"].cast("string")).alias("name"))).alias("universe")))
    return rows.select(F.concat(F.lit("["), names, F.lit(","), F.to_json(F.transform("x", lambda r: r["c"])), F.lit("]")).alias("body"))


def s05_s06_perp_contexts(spark, sf_dir):
    c = payloads.perp_contexts(_perps(spark, sf_dir))
    return c.select("symbol", F.round("funding_hourly", 8).alias("funding_hourly"), F.round("funding_annual", 6).alias("funding_annual"), "open_interest", "mark", "oracle", "notional", "previous")


def g11_derivative_targets(spark, sf_dir):
    t = figures.derivative_targets(payloads.perp_contexts(_perps(spark, sf_dir)))
    return t.select("symbol", A.clean("nth").alias("nth"), "key", F.round("target", 6).alias("target"), "fraction")


def t07_t08_derivative_facts(spark, sf_dir):
    d = payloads.derivative_facts(payloads.perp_contexts(_perps(spark, sf_dir)))
    return d.select("symbol", "funding_sign", "oi_notional")


def s07_filer_map(spark, sf_dir):
    s = A.table(spark, sf_dir, "supplier")
    entry = F.struct(F.col("s_suppkey").cast("string").alias("key"), F.struct(F.col("s_suppkey").alias("cik_str"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("ticker"), F.lit("x").alias("title")).alias("value"))
    bodies = s.groupBy(F.floor(F.col("s_suppkey") / 50).alias("g")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("body"))
    return payloads.filer_map(bodies).select("symbol", "cik")


def s08_company_facts(spark, sf_dir):
    """Orders as filers' nested facts, read as a long table and resolved."""
    e = E._entries(spark, sf_dir)
    text = lambda c: F.col(c).cast("string").alias(c)
    by_tag = e.groupBy("cik", "tag").agg(F.array_sort(F.collect_list(F.struct("pos", text("start"), text("end"), "val", "fp", "form", text("filed")))).alias("x"))
    fact = F.struct(F.create_map(F.lit("USD"), F.transform("x", lambda r: r.dropFields("pos"))).alias("units"))
    bodies = by_tag.groupBy("cik").agg(F.map_from_entries(F.collect_list(F.struct("tag", fact.alias("f")))).alias("tags"))
    bodies = bodies.select(F.to_json(F.struct("cik", F.lit("c").alias("entityName"), F.create_map(F.lit("us-gaap"), F.col("tags")).alias("facts"))).alias("body"))
    facts = filings.annual_facts(payloads.company_facts(bodies), filings.concept_table(spark, E._CONCEPTS))
    return facts.select("cik", "concept", "tag", "end", "fy", F.round("val", 2).alias("val"))


def p07_questions(spark, sf_dir):
    k = F.col("o_orderkey")
    typed, spoken = F.when(k % 3 == 0, F.concat(F.lit(" q"), k.cast("string"))), F.when(k % 4 == 0, F.concat(F.lit("v"), k.cast("string"), F.lit(" ")))
    return A.table(spark, sf_dir, "orders").select("o_orderkey", reports.question(typed, spoken, k % 5 == 0, "How does it trade?", "What does the report say?").alias("question"))


def x11_x12_transcripts(spark, sf_dir):
    """Two attempts a customer order: the better transcript is kept, costs add up."""
    k = F.col("o_orderkey")
    o = A.table(spark, sf_dir, "orders")
    attempt = lambda n, size, reported: o.select(k.alias("audio_id"), F.lit(n).alias("attempt"), F.repeat(F.lit("x"), size.cast("int")).alias("text"), reported.cast("double").alias("reported"), F.lit(100.0).alias("real"), (k % 10 / 100).alias("cost"))
    both = attempt(1, 300 + k % 2 * 200, F.lit(100)).unionByName(attempt(2, 350 + k % 3 * 100, 60 + k % 5 * 10))
    return reports.best_transcript(both).select("audio_id", F.length("text").cast("bigint").alias("chars"), F.round("cost", 6).alias("cost"), "warned")


def x02_visible_text(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(X.visible(F.concat(F.lit("­​"), F.col("text")))).alias("visible_md5"))


def x06_x07_labels(spark, sf_dir):
    """Epochs as UTC times, and citation labels of trimmed parts."""
    k = F.col("event_id")
    label = F.trim(F.concat_ws(" ", "event_type", F.when(k % 3 > 0, F.concat(F.lit("p."), (k % 50).cast("string")))))
    return A.table(spark, sf_dir, "events").select("event_id", F.timestamp_seconds(k * 3600).alias("from_seconds"), F.timestamp_millis(k * 1000 + 500).alias("from_millis"), label.alias("label"))


def p11_number_formats(spark, sf_dir):
    v = F.col("o_totalprice")
    scaled = F.when(v >= 1e9, F.format_string("%.2fG", F.floor(v / 1e7) / 100)).when(v >= 1e6, F.format_string("%.2fM", F.floor(v / 1e4) / 100)).when(v >= 1e3, F.format_string("%.2fK", F.floor(v / 10) / 100)).otherwise(F.format_string("%.0f", v))
    return A.table(spark, sf_dir, "orders").select("o_orderkey", F.format_number(v, 2).alias("grouped"), F.coalesce(scaled, F.lit("n/a")).alias("volume"))


def j05_figure_pairs(spark, sf_dir):
    """Figures and checks with equal name and value pair in order; one without a partner pairs by position."""
    o = A.table(spark, sf_dir, "orders")
    same = lambda c: Window.partitionBy("o_custkey", c).orderBy("o_orderkey")
    pos = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    left = o.select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("name")).withColumn("nth", F.row_number().over(same("name"))).withColumn("pos", F.row_number().over(pos))
    renamed = F.when(F.col("o_orderkey") % 6 == 0, F.lit("other")).otherwise(F.col("o_orderpriority"))
    right = o.select("o_custkey", "o_orderkey", renamed.alias("name")).withColumn("nth", F.row_number().over(same("name"))).withColumn("pos", F.row_number().over(pos))
    by_name = left.join(right.select("o_custkey", "name", "nth", F.col("o_orderkey").alias("by_name")), ["o_custkey", "name", "nth"], "left")
    both = by_name.join(right.select("o_custkey", "pos", F.col("o_orderkey").alias("by_pos")), ["o_custkey", "pos"], "left")
    return both.select("o_orderkey", F.coalesce("by_name", "by_pos").alias("pair"))


def j06_market_context(spark, sf_dir):
    """One row a requested symbol: market, technicals, derivatives and facts where they exist."""
    t = T.scalars(A.line_bars(spark, sf_dir)).select("symbol", "last_close", "sma20")
    d = payloads.perp_contexts(_perps(spark, sf_dir)).select(F.regexp_extract("symbol", r"(\d+)", 1).cast("bigint").alias("symbol"), "mark")
    f = E._facts(spark, sf_dir).groupBy(F.col("cik").alias("symbol")).agg(F.count("*").alias("facts"))
    asked = A.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("symbol"))
    out = asked.join(t, "symbol", "left").join(d, "symbol", "left").join(f, "symbol", "left")
    return out.select("symbol", F.round("last_close", 6).alias("last_close"), F.round("sma20", 6).alias("sma20"), "mark", F.coalesce("facts", F.lit(0)).cast("bigint").alias("facts"))


def p11_price_formats(spark, sf_dir):
    """Prices by size, percentages, and numbers without decimals; nothing where there is no value."""
    v = F.col("o_totalprice")
    price = F.when(F.col("o_orderkey") % 5 == 0, v / 1e6).when(F.col("o_orderkey") % 5 == 1, -v / 1000).when(F.col("o_orderkey") % 5 == 2, F.lit(None)).otherwise(v)
    price = X.half_away(price, 6)
    return A.table(spark, sf_dir, "orders").select("o_orderkey", X.price_text(price).alias("price"), X.percent_text(X.half_away(price / 1e4, 6)).alias("share"), X.number_text(price, 0).alias("units"))


def j05_paired_checks(spark, sf_dir):
    """Figures against checks of which some have another value or are missing."""
    o = A.table(spark, sf_dir, "orders")
    figs = o.select(F.col("o_custkey").alias("report_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("value"))
    status = F.when(F.col("o_orderkey") % 2 == 0, "verified").otherwise("not_found")
    checks = o.where("o_orderpriority <> '5-LOW'").select(F.col("o_custkey").alias("report_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("name"), F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise(F.col("o_orderstatus")).alias("value"), status.alias("status"), F.col("o_orderkey").cast("string").alias("matched"))
    return figures.paired_checks(figs, checks)


def m02_speech_costs(spark, sf_dir):
    """Each run's spoken characters at the price of its own backend."""
    k = F.col("o_custkey")
    backend = F.element_at(F.array(*map(F.lit, (" Auto", "openrouter", "openai", ""))), (k % 4 + 1).cast("int"))
    settings = A.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(F.length("o_orderpriority") * 1000).alias("chars"))
    price = R.speech_price(backend, k % 7 == 0, k % 5 != 0)
    return settings.select(k.alias("run_id"), "chars", F.round(F.col("chars") / 1e6 * price, 9).alias("cost"))


def t09_derivative_sheet(spark, sf_dir):
    """Fact sheets of suppliers, of which those with a perpetual of their number have lines of it."""
    d = payloads.perp_contexts(_perps(spark, sf_dir)).withColumn("symbol", F.regexp_extract("symbol", r"(\d+)", 1).cast("bigint"))
    return T.fact_sheet(T.summary(A.line_bars(spark, sf_dir)), d)


def j06_full_context(spark, sf_dir):
    """With the nearest levels, and how a reading of the drawn chart stands against the bars."""
    readings, t = E._readings(spark, sf_dir)
    side = lambda name: t.select("symbol", F.lit(name).alias("side"), F.posexplode(f"{name}s").alias("nth", "level"))
    d = payloads.perp_contexts(_perps(spark, sf_dir)).select(F.regexp_extract("symbol", r"(\d+)", 1).cast("bigint").alias("symbol"), "mark")
    f = E._facts(spark, sf_dir).groupBy(F.col("cik").alias("symbol")).agg(F.count("*").alias("facts"))
    _, score = chart_claims.check_readings(readings, t, T.known_levels(t))
    contrast = score.select(F.col("reading_id").alias("symbol"), "confirmed", "disagrees")
    c = routing.market_context(A.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("symbol")), t.select("symbol", "last_close"), side("support").unionByName(side("resistance")), d, f, contrast)
    text = lambda n: F.array_join(F.transform(n, lambda x: F.format_string("%.6f", x)), ",").alias(n)
    return c.select("symbol", F.round("last_close", 6).alias("last_close"), text("supports"), text("resistances"), "mark", "facts", "confirmed", "disagrees")


def j03_source_selection(spark, sf_dir):
    """Every routed symbol with the bars of its own market, derivatives for crypto, facts for equities."""
    routed = A.kept(routing.route(E._tickers(spark, sf_dir)).select("symbol", "market").distinct())
    asked = routed.where("market IS NOT NULL")  # of what is written: put into the rules, it would repeat them all
    counted = A.kept(A.line_bars(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("bars")))  # both markets' bars
    named = lambda letter: counted.withColumn("symbol", F.concat(F.lit(letter), F.col("symbol").cast("string")))
    bars = routing.select_sources(asked, named("S"), named("P"))
    perps = payloads.perp_contexts(_perps(spark, sf_dir)).select("symbol", "mark")
    facts = E._facts(spark, sf_dir).groupBy(F.concat(F.lit("S"), F.col("cik").cast("string")).alias("symbol")).agg(F.count("*").alias("facts"))
    return routing.guarded_by_market(asked.join(bars, ["symbol", "market"], "left"), perps, facts).select("symbol", "market", "bars", "mark", "facts")


def j01_market_mix(spark, sf_dir):
    """Requests a market, with how many of its symbols have a mark of their own."""
    t = routing.route(E._tickers(spark, sf_dir))
    return t.groupBy("market").agg(F.count("*").alias("requests"), F.countDistinct("symbol").alias("symbols"))


QUERIES = {f.__name__: f for f in (s05_s06_perp_contexts, g11_derivative_targets, t07_t08_derivative_facts, s07_filer_map, s08_company_facts, p07_questions, x11_x12_transcripts, x02_visible_text, x06_x07_labels, p11_number_formats, j05_figure_pairs, j06_market_context, p11_price_formats, j05_paired_checks, m02_speech_costs, t09_derivative_sheet, j06_full_context, j03_source_selection, j01_market_mix)}

_PERP = "p AS (SELECT p_partkey AS k, 'P' || p_partkey AS symbol, (p_partkey % 7 - 3) / 10000 AS funding, CAST(p_partkey % 97 + 1 AS DOUBLE) AS mark FROM part WHERE p_partkey % 11 <> 0)"
_EPOCH = "TIMESTAMP '1970-01-01'"
ORACLE_SQL = {
    "s05_s06_perp_contexts": f"WITH {_PERP} SELECT symbol, round(funding, 8) AS funding_hourly, round(funding * 8760, 6) AS funding_annual, CAST(k * 2 AS DOUBLE) AS open_interest, mark, mark + 1 AS oracle, CAST(k * 5 AS DOUBLE) AS notional, mark + 2 AS previous FROM p",
    "g11_derivative_targets": f"""WITH {_PERP}, t AS (SELECT *, CAST(k * 2 AS DOUBLE) AS oi FROM p)
      SELECT symbol, nth, key, round(target, 6) AS target, fraction FROM (
        SELECT symbol, 30 AS nth, 'funding' AS key, funding * 8760 AS target, true AS fraction FROM t UNION ALL SELECT symbol, 31, 'funding', funding, true FROM t
        UNION ALL SELECT symbol, 32, 'oi', oi, false FROM t UNION ALL SELECT symbol, 33, 'oi_notional', oi * mark, false FROM t
        UNION ALL SELECT symbol, 34, 'price', mark, false FROM t UNION ALL SELECT symbol, 35, 'price', mark + 1, false FROM t
        UNION ALL SELECT symbol, 36, 'volume', k * 5, false FROM t UNION ALL SELECT symbol, 37, 'price', mark + 2, false FROM t)""",
    "t07_t08_derivative_facts": f"WITH {_PERP} SELECT symbol, CASE WHEN funding > 0 THEN 'positive' WHEN funding < 0 THEN 'negative' ELSE 'zero' END AS funding_sign, k * 2 * mark AS oi_notional FROM p",
    "s07_filer_map": "SELECT 'S' || s_suppkey AS symbol, s_suppkey AS cik FROM supplier",
    "s08_company_facts": E.ORACLE_SQL["f01_f04_annual_facts"],
    "p07_questions": """SELECT o_orderkey, CASE WHEN o_orderkey % 12 = 0 THEN concat('q', o_orderkey, chr(10), chr(10), 'v', o_orderkey) WHEN o_orderkey % 3 = 0 THEN concat('q', o_orderkey) WHEN o_orderkey % 4 = 0 THEN concat('v', o_orderkey)
      WHEN o_orderkey % 5 = 0 THEN 'What does the report say?' ELSE 'How does it trade?' END AS question FROM orders""",
    "x11_x12_transcripts": """WITH t AS (SELECT o_orderkey AS k, 300 + o_orderkey % 2 * 200 AS c1, 350 + o_orderkey % 3 * 100 AS c2, o_orderkey % 2 = 0 AS bad1, o_orderkey % 5 < 2 OR o_orderkey % 3 = 0 AS bad2 FROM orders)
      SELECT k AS audio_id, CASE WHEN NOT bad1 THEN c1 WHEN NOT bad2 THEN c2 ELSE greatest(c1, c2) END AS chars, round(k % 10 / 50, 6) AS cost, bad1 AND bad2 AS warned FROM t""",
    "x02_visible_text": r"SELECT doc_id, md5(regexp_replace(strip_accents(lower(text)), '[\s\x0b]+', ' ', 'g')) AS visible_md5 FROM documents",
    "x06_x07_labels": f"SELECT event_id, {_EPOCH} + to_seconds(event_id * 3600) AS from_seconds, {_EPOCH} + to_milliseconds(event_id * 1000 + 500) AS from_millis, CASE WHEN event_id % 3 > 0 THEN concat(event_type, ' p.', event_id % 50) ELSE event_type END AS label FROM events",
    "p11_number_formats": "SELECT o_orderkey, format('{:,.2f}', o_totalprice) AS grouped, CASE WHEN o_totalprice >= 1e6 THEN printf('%.2fM', floor(o_totalprice / 1e4) / 100) WHEN o_totalprice >= 1e3 THEN printf('%.2fK', floor(o_totalprice / 10) / 100) ELSE printf('%.0f', o_totalprice) END AS volume FROM orders",
    "j05_figure_pairs": """WITH l AS (SELECT o_custkey, o_orderkey, o_orderpriority AS name, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS nth FROM orders),
      r AS (SELECT o_custkey, o_orderkey, name, row_number() OVER (PARTITION BY o_custkey, name ORDER BY o_orderkey) AS nth FROM (SELECT *, CASE WHEN o_orderkey % 6 = 0 THEN 'other' ELSE o_orderpriority END AS name FROM orders))
      SELECT l.o_orderkey, coalesce(r.o_orderkey, l.o_orderkey) AS pair FROM l LEFT JOIN r ON r.o_custkey = l.o_custkey AND r.name = l.name AND r.nth = l.nth""",
    "j06_market_context": f"""WITH {M._LINE}, {M._SERIES}, {M._SCALAR_SQL}, {_PERP}, {E._FACTS.replace('facts AS', 'resolved AS').replace(' t AS', ' tg AS').replace('JOIN t ON t.', 'JOIN tg t ON t.')}
      SELECT s_suppkey AS symbol, round(last_close, 6) AS last_close, round(sma20, 6) AS sma20, mark, (SELECT count(*) FROM resolved WHERE cik = s_suppkey) AS facts
      FROM supplier LEFT JOIN tech ON tech.symbol = s_suppkey LEFT JOIN p ON p.k = s_suppkey""",
    "p11_price_formats": """WITH p AS (SELECT o_orderkey, round(CASE o_orderkey % 5 WHEN 0 THEN o_totalprice / 1e6 WHEN 1 THEN -o_totalprice / 1000 WHEN 2 THEN NULL ELSE o_totalprice END, 6) AS v FROM orders)
      SELECT o_orderkey, coalesce(CASE WHEN abs(v) >= 1000 THEN format('{:,.0f}', v) WHEN abs(v) >= 1 THEN format('{:,.2f}', v) ELSE format('{:,.4f}', v) END, 'n/a') AS price,
        coalesce(format('{:,.2f}', round(v / 1e4, 6) * 100) || '%', 'n/a') AS share, coalesce(format('{:,.0f}', v), 'n/a') AS units FROM p""",
    "j05_paired_checks": """WITH c AS (SELECT o_custkey, o_orderkey, o_orderpriority AS name, CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE o_orderstatus END AS value, CASE WHEN o_orderkey % 2 = 0 THEN 'verified' ELSE 'not_found' END AS status FROM orders WHERE o_orderpriority <> '5-LOW'),
      v AS (SELECT o_custkey, name, value, max(o_orderkey) AS k FROM c GROUP BY ALL), n AS (SELECT o_custkey, name, max(o_orderkey) AS k FROM c GROUP BY ALL)
      SELECT o.o_custkey AS report_id, o.o_orderkey AS ord, o_orderpriority AS name, o_orderstatus AS value, CASE WHEN coalesce(v.k, n.k) % 2 = 0 THEN 'verified' WHEN coalesce(v.k, n.k) IS NULL THEN 'unverified' ELSE 'not_found' END AS status,
        CAST(coalesce(v.k, n.k) AS VARCHAR) AS matched, CASE WHEN v.k IS NOT NULL THEN 'value' WHEN n.k IS NOT NULL THEN 'name' END AS paired
      FROM orders o LEFT JOIN v ON v.o_custkey = o.o_custkey AND v.name = o_orderpriority AND v.value = o_orderstatus LEFT JOIN n ON n.o_custkey = o.o_custkey AND n.name = o_orderpriority""",
    "m02_speech_costs": "SELECT o_custkey AS run_id, CAST(sum(length(o_orderpriority) * 1000) AS BIGINT) AS chars, round(sum(length(o_orderpriority) * 1000) / 1e6 * CASE WHEN o_custkey % 7 <> 0 AND o_custkey % 4 < 2 AND o_custkey % 5 <> 0 THEN 0.65::DOUBLE ELSE 15.0::DOUBLE END, 9) AS cost FROM orders GROUP BY o_custkey",
    "t09_derivative_sheet": f"""WITH {M._SHEET_PARTS}, {_PERP} SELECT k.symbol, concat_ws(chr(10), {M._SHEET_LINES},
        'Funding: ' || CASE WHEN funding > 0 THEN 'positive, longs pay shorts' WHEN funding < 0 THEN 'negative, shorts pay longs' ELSE 'zero' END || ', ' || format('{{:,.2f}}', round(round(funding * 8760, 6) * 100, 6)) || ' % a year',
        'Open interest: ' || format('{{:,.0f}}', CAST(p.k * 2 AS DOUBLE)) || ' units, ' || format('{{:,.0f}}', CAST(p.k * 2 AS DOUBLE) * mark) || ' USD at the mark',
        'Perpetual: mark ' || format('{{:,.2f}}', mark) || ', oracle ' || format('{{:,.2f}}', mark + 1) || ', volume 24 h ' || format('{{:,.0f}}', CAST(p.k * 5 AS DOUBLE)) || ' USD') AS sheet
      FROM sheet k LEFT JOIN p ON p.k = k.symbol""",
    "j06_full_context": f"""WITH {M._LINE}, {M._SERIES}, {M._SCALAR_SQL}, {M._PIVOTS}, {M._LEVELS}, {M._SIDES}, {_PERP}, {E._FACTS.replace('facts AS', 'resolved AS').replace(' t AS', ' tg AS').replace('JOIN t ON t.', 'JOIN tg t ON t.')},
      listed AS (SELECT symbol, coalesce(string_agg(printf('%.6f', level), ',' ORDER BY nth) FILTER (side = 'support'), '') AS supports, coalesce(string_agg(printf('%.6f', level), ',' ORDER BY nth) FILTER (side = 'resistance'), '') AS resistances FROM sides GROUP BY 1)
      SELECT s_suppkey AS symbol, round(last_close, 6) AS last_close, supports, resistances, mark, (SELECT nullif(count(*), 0) FROM resolved WHERE cik = s_suppkey) AS facts,
        CAST(2 + (s_suppkey % 3 <> 0 AND trend = 'up')::INT AS BIGINT) AS confirmed, CAST(1 + (s_suppkey % 3 <> 0 AND trend <> 'up')::INT AS BIGINT) AS disagrees
      FROM supplier LEFT JOIN tech ON tech.symbol = s_suppkey LEFT JOIN listed ON listed.symbol = s_suppkey LEFT JOIN p ON p.k = s_suppkey""",
    "j03_source_selection": f"""WITH {M._LINE}, {_PERP}, {E._FACTS.replace(' t AS', ' tg AS').replace('JOIN t ON t.', 'JOIN tg t ON t.')},
      asked AS (SELECT DISTINCT (['S' || o_orderkey, 'C' || o_orderkey, 'P' || o_orderkey, 'BTC' || o_orderkey, 'X' || o_orderkey || '.MC', 'BTC', 'P' || o_orderkey])[o_orderkey % 8 + 1] AS symbol,
        CASE WHEN o_orderkey % 8 IN (1, 2, 5) THEN 'crypto' ELSE 'equity' END AS market FROM orders WHERE o_orderkey % 8 < 7),
      src AS (SELECT CASE WHEN m = 'equity' THEN 'S' ELSE 'P' END || symbol AS symbol, m AS market, count(*) AS bars FROM bars CROSS JOIN (SELECT unnest(['equity', 'crypto']) AS m) GROUP BY 1, 2),
      nf AS (SELECT 'S' || cik AS symbol, count(*) AS facts FROM facts GROUP BY 1)
      SELECT a.symbol, a.market, bars, CASE WHEN a.market = 'crypto' THEN mark END AS mark, CASE WHEN a.market = 'equity' THEN facts END AS facts
      FROM asked a LEFT JOIN src s ON s.symbol = a.symbol AND s.market = a.market LEFT JOIN p ON p.symbol = a.symbol LEFT JOIN nf ON nf.symbol = a.symbol""",
    "j01_market_mix": """WITH t AS (SELECT (['S' || o_orderkey, 'C' || o_orderkey, 'P' || o_orderkey, 'BTC' || o_orderkey, 'X' || o_orderkey || '.MC', 'BTC', 'P' || o_orderkey, ''])[o_orderkey % 8 + 1] AS symbol, o_orderkey % 8 AS k FROM orders)
      SELECT CASE WHEN k = 7 THEN NULL WHEN k IN (1, 2, 5) THEN 'crypto' ELSE 'equity' END AS market, count(*) AS requests, count(DISTINCT symbol) AS symbols FROM t GROUP BY 1""",
}
