"""Lexical search, vector codes and page text against brute force, their SQL, and held-out pages."""

import hashlib
import html
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from finevidence.llm import html_text, lexical, queries, vector_codes
from finevidence.llm.labelled_pages import labelled_pages


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_vector_codes"])
def test_equals_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = queries.QUERIES[name](spark, sf_dir)
    want = db.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(want.fetchall())


# --- lexical search


def brute_rank(items, docs, k):
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    terms = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in word.findall(t or "")]
    held = [(i, c) for i, t in docs if (c := Counter(terms(t)))]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    weight = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for w, d in df.items()}
    out = []
    for item, text in set(items):
        found = []
        for i, c in held:
            m = 25 + 75 * sum(c.values()) * n_docs // n_terms
            score = sum(weight[w] * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in terms(text) if w in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, nth + 1, None if null else i, -s) for nth, (s, null, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def ranked(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_rank_odd_tables(spark, odd, empty):
    items = [(1, "Same TEXT here, word"), (1, "Same TEXT here, word"), (2, None), (3, ""), (None, "a row a row id"), (4, "nowhere-to-be-found"), (5, "é É mail MAIL mail")]
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS rank", "'x' AS terms")
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert ranked(lexical.rank(asked, odd, 3)) == brute_rank(items, docs, 3)
    assert ranked(lexical.rank(asked, empty)) == [] == ranked(lexical.rank(asked.limit(0), odd))


def test_rank_many_tiles_and_groups(spark, monkeypatch):
    r = np.random.default_rng(3)
    text = lambda n: " ".join(f"w{x}" for x in r.zipf(1.3, n) if x < 10**6)
    docs = [(i, text(int(r.integers(0, 60)))) for i in range(300)] + [(1000 + i, "w1 w2 tie") for i in range(40)]
    items = [(i, text(12)) for i in range(40)] + [(99, "tie tie w2")]
    for name, value in (("TILE_ITEMS", 7), ("TILE_TERMS", 5), ("TILE_DOCS", 32), ("GROUP_ENTRIES", 150)):
        monkeypatch.setattr(lexical, name, value)
    got = ranked(lexical.rank(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string").repartition(5), 10))
    assert got == brute_rank(items, docs, 10)
    assert [x[2] for x in sorted(got, key=lambda x: x[:2] if x[0] == 99 else (0, 0)) if x[0] == 99] == list(range(1000, 1010))


def test_product_stays_exact():
    q = np.array([[3.0, 2.0**30, 1.0], [1.0, 5.0, 2.0**40]])
    d = np.array([[1.0, 2.0], [3e10, 1.0], [3.0, 7e9]])
    want = [[sum(int(a) * int(b) for a, b in zip(row, col)) for col in d.T] for row in q]
    with np.errstate(over="ignore"):
        assert np.array_equal(lexical.product(q[:, :1], d[:1]), [[3, 6], [1, 2]])
    small = q.copy()
    small[0, 1], small[1, 2] = 2.0**20, 2.0**19 - 1
    want = [[sum(int(a) * int(b) for a, b in zip(row, col)) for col in d.T] for row in small]
    assert lexical.product(small, d).tolist() == want


# --- vector codes


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for dim in {len(v) for _, v, _ in kept}:
        own = sorted((r for r in kept if len(r[1]) == dim), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        cut = [p * dim // parts for p in range(parts + 1)]
        books = [[v[cut[p] : cut[p + 1]] for _, v, _ in own[:entries]] for p in range(parts)]
        near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), n) for n, e in enumerate(book))
        for _ in range(rounds):
            for p in range(parts):
                groups = defaultdict(list)
                for _, v, _ in own:
                    groups[near(x := v[cut[p] : cut[p + 1]], books[p])[1]].append(x)
                books[p] = [[sum(c) // len(groups[n]) for c in zip(*groups[n])] if n in groups else e for n, e in enumerate(books[p])]
        sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
        for i, v, label in own:
            found = [near(v[cut[p] : cut[p + 1]], books[p]) for p in range(parts)]
            out.append([i, "".join(f"{n:02x}" for _, n in found), sum(d for d, _ in found), label, sha])
    total = Counter()
    for x in out:
        total[x[3]] += x[2]
    return sorted(((i, c, e, total[label], sha) for i, c, e, label, sha in out), key=str)


def coded(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def test_codes_odd_tables(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(size=16).round(2)], int(i % 3) if i % 4 else None) for i in range(90)]
    rows += [(200, None, 1), (201, [float("nan")] * 16, 1), (202, [1.0, None] * 8, 1), (203, [float("inf")] * 16, 2), (5, rows[5][1], 2), (5, rows[5][1], 2), (None, rows[7][1], None), (204, [], 1)]
    rows += [(300 + i, [float(i), -float(i)] * 5, 7) for i in range(20)] + [(400, [1e6] * 24, 8), (401, [-2e6] * 24, 8), (402, [1e6 + 3] * 24, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' AS dim", "1 AS code", "2 AS n_rows", "3 AS label_key").repartition(3)
    want = brute_codes([(i, v, label) for i, v, label in rows])
    assert coded(vector_codes.digests(df)) == want
    assert coded(vector_codes.digests(df.limit(0))) == []


@pytest.mark.parametrize("n, d, k", [(1, 3, 1), (5, 0, 4), (2000, 8, 16), (300, 2, 7), (33, 4, 3)])
def test_two_trees_equal_all_pairs(n, d, k):
    r = np.random.default_rng(n)
    x = vector_codes.whole(3 * r.normal(size=(6, d))[r.integers(0, 6, n)] + 0.1 * r.normal(size=(n, d)))
    for rows in (x, x.astype(object) * 10**12):
        tree, entries = vector_codes.Tree(rows, 32), rows[:k]
        away = vector_codes.squares(rows, entries)
        code, error = vector_codes.codes(tree, entries)
        assert (code == away.argmin(1)).all() and (error == away.min(1)).all()
        for e, count, sums in vector_codes.partial_sums(tree, entries):
            assert count == (code == e).sum() and sums == rows[code == e].sum(0).tolist()
    spread = vector_codes.whole(r.normal(size=(1, d)) + 100 * np.arange(6)[:, None])[r.integers(0, 6, n)]
    assert n < 1000 or len(vector_codes.assign(vector_codes.Tree(spread, 32), np.unique(spread, axis=0))[1]) < n / 4  # whole nodes are assigned


# --- page text


@pytest.fixture(scope="module")
def tagger():
    return html_text.train()


def test_held_out_layouts(tagger):
    reader, wrong, total = html_text.Reader(), 0, 0
    for page in labelled_pages(200, seed=4242):
        want = [(b[0], int(b[1].main)) for b in reader.read(page)[1]]
        got = tagger.blocks(page.replace(" data-main", ""))
        assert [t for t, _ in got] == [t for t, _ in want]
        wrong, total = wrong + sum(a != b for a, b in zip(got, want)), total + len(want)
    assert wrong < 0.02 * total


def test_shared_pages(spark, sf_dir, tagger):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in html_text.extract(pages, tagger).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        article = re.search(r"<article>(.*?)(?=</article>|<footer>)", r.html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split("</?(?:p|h1)>", article))
        want = "\n\n".join(p for p in parts if p)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def test_reader():
    read = lambda page: [b[0] for b in html_text.Reader().read(page)[1]]
    assert read("<p>a &amp; b&nbsp;c<br>d<p>e<ul><li>f<li>g</ul>h") == ["a & b c d", "e", "f", "g", "h"]
    assert read("a < b <!-- <p>x --> c<script>if (a<b) '</p>'</script> d <!-- open <p>z") == ["a < b c d"]
    assert read("<table><tr><td>1<td>2<tr><td>3</table><div title='a>b'>4</DIV></i></p>5<style>x") == ["1", "2", "3", "4", "5"]
    assert read("") == read("<p>") == [] and read("<") == ["<"] and read("x<a href=") == ["x<a href="]
    assert read("<div>" * 20_000 + "deep" + "</div>" * 10_000) == ["deep"]


def test_extract_odd_tables(spark, tagger):
    long = "<article><h1>T</h1>" + "<p>Some words of a sentence, and more.</p>" * 30_000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "v", "<nav><a href=x>a</a></nav>"), (3, "w", long), (3, "w", long), (4, "x", "   \n ")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' AS text", "0 AS n_chars", "1 AS _html")
    got = html_text.extract(df, tagger)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == 6
    assert sorted(((r.page_id, r.n_chars) for r in got.collect()), key=str) == sorted([(1, 0), (2, 0), (None, 0), (3, 1 + 30_000 * 37), (3, 1 + 30_000 * 37), (4, 0)], key=str)
    assert html_text.extract(df.limit(0), tagger).count() == 0


def test_own_labelled_pages():
    """Only the class tells the two apart: they come in either order."""
    parts = lambda i: [f"<div class=zork data-main>Body text number {i}.</div>", f"<div class=plim>Other text number {i}.</div>"]
    own = ["".join(parts(i)[:: 1 if i % 2 else -1]) for i in range(40)]
    assert html_text.train(own).text("<div class=plim>Third thing.</div><div class=zork>Fourth thing.</div>") == "Fourth thing."
    assert html_text.train([]).text("<p>x</p>") == ""
