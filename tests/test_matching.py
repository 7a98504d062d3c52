"""Joins of numbers and levels by key and by order, against all pairs."""

import random
import time

from pyspark.sql import functions as F

from finevidence.functions import numbers as N
from finevidence.operators import chart_claims, figures


def _number(r):
    n = r.choice([r.randint(0, 12), r.randint(90, 1100), r.randint(9_990, 10_010), r.randint(10**5, 10**7), r.randint(10**9, 10**11), r.randint(95, 105) * 10 ** r.randint(0, 9)])
    d = r.choice([0, 0, 1, 2, 3])
    return r.choice(["{:,.%df}", "{:.%df}"]).replace("%d", str(d)).format(n / 10**d) + r.choice(["", "", " million", " bn", " mil", " thousand", " %", " bps", " M"])


def test_keyed_numbers_equal_all_pairs(spark):
    r = random.Random(5)
    figs = [(d, d, i, "f", r.choice(["{}", "{} or {}"]).format(_number(r), _number(r)), [("document", f"p.{d % 3 + 1}")]) for d in range(4) for i in range(60)]
    figs += [(0, 0, 900, "f", "0.0 million", [("document", "p.1")]), (0, 0, 901, "f", "10.0 bn", [("document", "p.1")])]
    pages = [(d, p, r.choice(["", "in millions: ", "in thousands "]) + ", ".join(_number(r) for _ in range(150))) for d in range(4) for p in (1, 2, 3)] + [(0, 9, None)]
    pages[0] = (0, 1, "values 0.4 million; 4; 400 thousand; 9,960 million; 9.99 bn; 1,2 " + pages[0][2])
    f = figures.checkable(spark.createDataFrame(figs, "doc_id long, report_id long, ord int, name string, value string, citations array<struct<origin string, location string>>"))
    p = spark.createDataFrame(pages, "doc_id long, page int, text string")
    got = {(x.report_id, x.ord): (x.page, x.matched) for x in figures.match_documents(f, p).collect()}
    want = f.where("checkable").select("doc_id", "report_id", "ord", F.explode("pages").alias("page"), F.explode("nums").alias("a"))
    found = p.select("doc_id", "page", F.explode(N.page_numbers("text")).alias("b"))
    pairs = want.join(found, ["doc_id", "page"]).where(figures.equivalent(F.col("a"), F.col("b"))).select("report_id", "ord", "page", F.col("a.nth").alias("num"), F.struct("b.nth", "b.fragment").alias("hit"))
    hits = {}
    for x in pairs.collect():
        at = hits.setdefault((x.report_id, x.ord, x.page), {})
        at[x.num] = min(at.get(x.num, x.hit), x.hit)
    last = {(x.report_id, x.ord): x.n for x in f.where("checkable").select("report_id", "ord", F.array_max("nums.nth").alias("n")).collect()}
    full = {k[:2]: (k[2], " · ".join(dict.fromkeys(v[i].fragment for i in sorted(v)))) for k, v in hits.items() if len(v) == last[k[:2]] + 1}
    assert got == full and len(full) > 20


def test_pages_of_many_numbers(spark):
    """Ten times the numbers take about ten times as long; nothing is compared with all numbers of the page."""

    def seconds(n):
        figs = spark.range(n // 10).selectExpr("1L AS doc_id", "1L AS report_id", "cast(id AS int) AS ord", "'f' AS name", "concat(format_number(1000 + id * 10 + 0.5, 1), ' million') AS value", "array(struct('document' AS origin, 'p.1' AS location)) AS citations")
        page = spark.range(n).groupBy().agg(F.array_join(F.array_sort(F.collect_list(F.format_string("%d.25", 10_000_000 + F.col("id")))), " ; ").alias("text")).selectExpr("1L AS doc_id", "1 AS page", "concat('1,000.5 million ; ', text) AS text")
        at = time.time()
        assert figures.match_documents(figures.checkable(figs), page).count() >= 1
        return time.time() - at

    seconds(1_000)
    few, many = seconds(10_000), seconds(100_000)
    assert many < 25 * max(few, 1.0)


def brute_verdict(values, zone, levels, band=0.03):
    near = min(((min(abs(v - n) / n for v in values), n) for n in levels), default=None)
    if near is None:
        return None
    ok = any(min(values) * (1 - band) <= n <= max(values) * (1 + band) for n in levels) if zone else near[0] <= band
    return near[1], near[0], "confirmed" if ok else "disagrees"


def test_levels_by_order_equal_all_pairs(spark):
    r = random.Random(3)
    levels = {s: [round(r.uniform(50, 150), r.choice([0, 2])) for _ in range(n)] for s, n in (("a", 10_000), ("b", 3), ("c", 0), ("d", 40))}
    claims = [(f"{s}{i}", 0, i, s, sorted(r.choices([v, v * 1.5, 0.0, 99.0], k=2)) if zone else [v] + [v * 1000] * (i % 3), zone) for s in levels for i in range(200) for zone in [i % 4 == 0] for v in [round(r.uniform(20, 200), 1)]]
    c = spark.createDataFrame(claims, "reading_id string, part int, nth int, symbol string, values array<double>, zone boolean")
    k = spark.createDataFrame([(s, float(x)) for s, own in levels.items() for x in own] + [("b", 0.0), ("b", None)], "symbol string, level double")
    got = {x.reading_id: (x.nearest, x.distance, x.verdict) for x in chart_claims.level_verdicts(c, k).collect()}
    want = {rid: v for rid, _, _, s, values, zone in claims if (v := brute_verdict(values, zone, levels[s])) is not None}
    assert got == want and {v[2] for v in got.values()} == {"confirmed", "disagrees"}
