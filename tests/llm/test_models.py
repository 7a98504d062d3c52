import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from finevidence.llm import ann, licenses, pii, quality, toxicity
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


@pytest.fixture(scope="module")
def more(spark, sf_dir):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def auc(score, y):
    order = np.argsort(np.argsort(score))
    n = y.sum()
    return (order[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


def held_out_scores(rows, labels, column, folds, fold):
    y = {r.doc_id: r[column] for r in labels.collect()}
    rows = [r for r in rows if r.doc_id in y]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold) for r in rows)
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    test = [r for r in rows if r.held_out]
    return np.array([r.score for r in test]), np.array([y[r.doc_id] for r in test])


def test_quality(more, labels, odd, empty, spark):
    net = quality.train(more, labels)
    s, y = held_out_scores(quality.score(more, net).collect(), labels, "quality", 4, 2)
    assert auc(s, y) > 0.9
    got = quality.score(odd, net)
    assert got.count() == odd.count() and quality.score(empty, net).count() == 0
    assert quality.accepted(odd, net).columns == odd.columns
    whole = quality.ByteConvNet()
    one = whole.score([b"abc " * 400, b"", b"x"], whole.pair_table())
    assert one == pytest.approx([whole.score([t], whole.pair_table())[0] for t in (b"abc " * 400, b"", b"x")], abs=1e-6)
    assert len(quality.train(odd, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).p)


def test_quality_gradient():
    net, r = quality.ByteConvNet(3), np.random.default_rng(0)
    pairs = np.concatenate([quality.chunks(bytes(r.integers(97, 105, 300, np.uint8))) for _ in range(4)])
    starts, y = np.array([0, 2, 4, 6]), np.array([0, 1, 1, 0], np.float32)

    def loss():
        z = net.logits(net.chunk_features(net.pooled(pairs, net.pair_table()))[1], starts)[0].astype(float)
        return float(np.mean(np.log1p(np.exp(-np.where(y == 1, z, -z)))))

    g = net.gradient(pairs, starts, y)
    for name in ("embed", "filters", "hidden", "out", "bias"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        old, eps = net.p[name][at], 3e-3
        net.p[name][at] = old + eps
        up = loss()
        net.p[name][at] = old - eps
        down = loss()
        net.p[name][at] = old
        assert (up - down) / (2 * eps) == pytest.approx(g[name][at], rel=0.15, abs=2e-3), name


def test_chain_marginals():
    r = np.random.default_rng(0)
    t, start, sizes = r.standard_normal((2, 2)), 0.3, [3, 1, 700, 5]
    first = np.zeros(sum(sizes), bool)
    first[np.cumsum([0, *sizes[:-1]])] = True
    e = np.exp(r.standard_normal(len(first)))
    want, k = [], 0
    for n in sizes:
        own = e[k : k + n]
        k += n
        a = [np.array([1, math.exp(start) * own[0]])]
        for x in own[1:]:
            v = a[-1] @ np.exp(t) * np.array([1, x])
            a.append(v / v.sum())
        b = [np.ones(2)]
        for x in own[:0:-1]:
            v = np.exp(t) @ (np.array([1, x]) * b[0])
            b.insert(0, v / v.sum())
        want += [p[1] * q[1] / (p @ q) for p, q in zip(a, b)]
    assert toxicity.Chain(start, t).marginals(e, first) == pytest.approx(want, abs=1e-12)


def test_toxicity(more, labels, odd, empty):
    tagger = toxicity.train(more, labels)
    rows = toxicity.score(more, tagger).collect()
    s, y = held_out_scores(rows, labels, "toxic", 3, 1)
    assert auc(s, y) > 0.8
    texts = {r.doc_id: r.text for r in more.collect()}
    some = [(texts[r.doc_id][x.start : x.end], x.p) for r in rows for x in r.spans]
    assert some and all(p >= 0.5 and w.strip() for w, p in some)
    assert toxicity.score(odd, tagger).count() == odd.count() and toxicity.score(empty, tagger).count() == 0


def brute_base(x):
    out = []
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    for k, p in enumerate(patterns):
        for m in re.finditer(p, x):
            digits = re.sub("[^0-9]", "", m.group())
            if k == 0 or k == 1 and all(int(v) <= 255 for v in m.group().split(".")) or k == 2 and 12 <= len(digits) <= 19 and pii.luhn(digits) or k == 3 and 9 <= len(digits) <= 15:
                out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_patterns():
    import random

    r = random.Random(2)
    for _ in range(20000):
        x = "".join(r.choice("a.@-+1 2(7") for _ in range(r.randint(1, 40)))
        assert brute_base(x) == pii.base_spans(x), x
    for x in ("1" * 100_000, "a@" * 30_000, "1." * 50_000, "a" * 100_000 + "@", "+1" + "(" * 100_000):
        pii.base_spans(x)


def test_disclosing_terms(spark, odd, empty):
    texts = [f"filler{i} speaking of Zanzibarish things contact jo@x.example.com please reply{i}" for i in range(6)] + [f"please contact someone{i} about things" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    n, near, have = len(texts), Counter(), Counter()
    for t in texts:
        for w in set(re.findall(r"\w+", t.lower())):
            have[w] += 1
    base = {i: brute_base(t) for i, t in enumerate(texts)}
    for i, spans in base.items():
        for a, b, _ in spans:
            near.update(set(re.findall(r"\w+", (texts[i][:a] + " " + texts[i][b:]).lower())))
    strong = {w for w, k in near.items() if k >= 3 and math.log(n * k / (have[w] * 6)) / math.log(n / 6) >= 0.9}
    assert strong == {"zanzibarish", "speaking", "of"} and "please" not in strong  # short words and numbers are terms as well
    for r in pii.detect(df).collect():
        got = {texts[r.doc_id][int(s.split(":")[1]) : int(s.split(":")[2])].lower() for s in r.spans.split(",") if s.startswith("term")}
        assert got == strong & set(re.findall(r"\w+", texts[r.doc_id].lower()))
        assert r.n_email == len(base[r.doc_id])
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "[EMAIL]" in clean[0] and "zanzibarish" not in clean[0].lower() and clean[10] == texts[10]
    out = pii.sanitise(odd)
    assert out.columns == odd.columns and Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in odd.collect())
    assert pii.detect(odd).count() == odd.count() and pii.detect(empty).count() == 0 and pii.sanitise(empty).count() == 0


def test_licenses(spark, odd, empty, docs):
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "cc"), (-4, "CC BY cc by, General PUBLIC license all rights reserved"), (-4, "x"), (-5, "Permission is hereby granted, free of charge, to any person who obtains a copy of this software")], "doc_id long, text string")
    df = docs.select("doc_id", "text").union(extra).union(odd.select("doc_id", "text"))
    low, want = str.maketrans(licenses.CAPITALS, licenses.SMALL), Counter()
    for r in df.collect():
        w = re.findall(licenses.WORDS, (r.text or "").translate(low))
        places = [(i, label) for phrase, label in licenses.BASE for p in [phrase.split()] for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        want[(r.doc_id, len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places})))] += 1
    rows = licenses.scan(df).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows) == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in rows)
    assert [r.labels for r in rows if r.doc_id == -5] == ["mit"] and licenses.scan(empty).count() == 0


def brute_spans(words, templates=licenses.TEMPLATES, coverage=0.8):
    """Best chain of equal runs of three words and more for each template, over all chains."""
    best = {}
    for t, (text, _) in enumerate(templates):
        w = re.findall(licenses.WORDS, text.translate(str.maketrans(licenses.CAPITALS, licenses.SMALL)))
        runs = []
        for i in range(len(words)):
            for j in range(len(w)):
                if words[i : i + 1] == w[j : j + 1] and not (i and j and words[i - 1] == w[j - 1]):
                    n = 0
                    while i + n < len(words) and j + n < len(w) and words[i + n] == w[j + n]:
                        n += 1
                    if n >= 3:
                        runs.append((i, j, n))
        runs.sort()
        chains = []
        for i, j, n in runs:
            chains.append((i, i + n, j + n, n))
            chains += [(s, i + n, j + n, m + n) for s, e, p, m in chains[:-1] if e <= i and p <= j]
        best[t] = max((m / (len(w) + e - s - m) for s, e, _, m in chains), default=0.0)
    return {t: x for t, x in best.items() if x >= coverage}


def test_license_spans(spark):
    import random

    r = random.Random(8)
    texts = ["this work zz work is zz is licensed zz licensed under zz under a zz a creative zz creative commons zz commons attribution", "this work is licensed under a creative commons attribution"]
    for _ in range(60):
        w = re.findall(licenses.WORDS, r.choice(licenses.TEMPLATES)[0].lower())
        for _ in range(r.choice([0, 1, 2, 4, 8])):
            k = r.randrange(len(w))
            w[k : k + r.choice([0, 1, 2])] = [f"x{r.randint(0, 9)}"] * r.choice([0, 1, 1, 2])
            w = w or ["x"]
        texts.append(" ".join([f"p{i}" for i in range(r.randint(0, 5))] + w + w[: r.choice([0, 0, 4, len(w)])]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    n = 0
    for row in licenses.scan(df).collect():
        words = re.findall(licenses.WORDS, texts[row.doc_id])
        found = brute_spans(words)
        own = {licenses.TEMPLATES[t][1] for t in found}
        assert set(filter(None, row.labels.split(","))) == own | set(filter(None, row.base_labels.split(","))), texts[row.doc_id]
        if found and not row.base_labels:
            assert row.score == pytest.approx(max(found.values()))
            n += 1
    assert n > 20


def brute_neighbours(rows, k=20):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for q in ids[ids % 20 == 0]:
        s = x @ x[list(ids).index(q)]
        out[q] = [int(ids[i]) for i in np.lexsort((ids, -np.round(s, 12))) if ids[i] != q][:k]
    return out


def test_neighbours(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = defaultdict(dict)
    for r in ann.search(df, F.col("id") % 20 == 0).collect():
        got[r.query_id][r.rank] = r.vec_id
    want = brute_neighbours([(r.vec_id, r.embedding) for r in df.collect()])
    assert set(got) == set(want) and all(sorted(got[q]) == list(range(1, 21)) for q in got)
    assert sum(len(set(want[q]) & set(got[q].values())) for q in want) >= 0.9 * 20 * len(want)


def test_neighbours_of_odd_vectors(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.standard_normal(4).tolist()) for i in range(100)] + [(i, [9.0, 0.0, 0.0, 0.0]) for i in range(100, 200)]
    bad = [(300, None), (301, [0.0] * 4), (302, [1.0, None, 0.0, 0.0]), (303, [float("nan")] * 4), (304, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (305, []), (306, [1.0])]
    df = spark.createDataFrame(rows + bad + rows[:5], "vec_id long, embedding array<float>").selectExpr("*", "1 AS leaf", "'x' AS node")
    got = defaultdict(list)
    for x in sorted(ann.search(df, F.col("id") % 20 == 0, k=20).collect(), key=lambda x: (x.query_id, x.rank)):
        got[x.query_id].append(x.vec_id)
    exact = brute_neighbours([(i, np.float32(v).astype(float)) for i, v in rows])
    assert set(got) == set(exact)
    assert got[120] == exact[120] == [100 + i for i in range(21) if i != 20][:20]
    short = [(i, [float(i % 7 + 1), 1.0, float(i % 3)]) for i in range(1000, 1060)]  # vectors of another length have their own neighbours
    both = defaultdict(list)
    for x in sorted(ann.search(df.unionByName(spark.createDataFrame(short, "vec_id long, embedding array<float>"), allowMissingColumns=True), F.col("id") % 20 == 0).collect(), key=lambda x: (x.query_id, x.rank)):
        both[x.query_id].append(x.vec_id)
    assert both == {**got, **brute_neighbours(short)}
    few = ann.search(df.where("vec_id IN (0, 20, 3)"), F.col("id") % 20 == 0).collect()
    assert Counter(x.query_id for x in few) == {0: 2, 20: 2}
    assert ann.search(df.limit(0)).count() == 0


def test_neighbours_in_blocks(spark, monkeypatch):
    """More than one row and query block a leaf, and leaves that the ball bound rules out."""
    monkeypatch.setattr(ann, "ROWS", 40)
    monkeypatch.setattr(ann, "QUERIES", 7)
    monkeypatch.setattr(ann, "AT_ONCE", 3)
    r = np.random.default_rng(1)
    rows = [(i, (r.standard_normal(6) * 0.1 + 5 * np.eye(6)[i % 6]).tolist()) for i in range(900)] + [(i, [1.0] * 6) for i in range(900, 960)]
    got = defaultdict(list)
    for x in sorted(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0, recall=1.0, leaf_rows=64).collect(), key=lambda x: (x.query_id, x.rank)):
        got[x.query_id].append(x.vec_id)
    want = brute_neighbours(rows)
    assert set(got) == set(want) and sum(len(set(want[q]) & set(got[q])) for q in want) >= 0.99 * 20 * len(want)


def test_models_against_plain_versions(spark):
    """Rows of op4 and op7 recomputed plainly: which rows are learned from, and every score."""
    r = np.random.default_rng(4)
    texts = [" ".join(r.choice(["plain", "words", "about", "things", "zorgle" if i % 3 == 0 else "fine", f"n{i}"], 12 if i % 40 else 3000)) for i in range(400)] + [None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(5, texts[5])], "doc_id long, text string")
    y = {i: int(i % 3 == 0) for i in range(402)}
    rows = [(i, v, v) for i, v in y.items()] + [(7, 1, 1), (8, None, None), (None, 1, 1), (9999, 1, 1), (9, 0, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    conflicts = {**y, 7: 1, 9: 1}
    fold = lambda i, n: zlib.crc32(str(i).encode()) % n
    got_texts, got_y, share = quality.labelled_sample(docs, labels, "quality", 4, 2, (1500, 1500))
    want = [(texts[i] or "", v) for i, v in sorted(conflicts.items()) if fold(i, 4) != 2]
    assert list(zip(got_texts, got_y)) == want and share == pytest.approx(np.mean([v for _, v in want]))  # long texts are learned from as well
    few = quality.labelled_sample(docs, labels, "quality", 4, 2, (10, 5))
    assert sorted(few[1]) == [0] * 10 + [1] * 5 and few[2] == share

    net = quality.train(docs, labels)
    p = net.p

    def plain_quality(text):
        data, logits = text.encode(), []
        n = max(1, -(-(len(data) - (quality.CHUNK - quality.STEP)) // quality.STEP))
        data += b"\xff" * (quality.STEP * (n - 1) + quality.CHUNK - len(data))
        for c in range(n):
            e = p["embed"][np.frombuffer(data[c * quality.STEP : c * quality.STEP + quality.CHUNK], np.uint8)].reshape(quality.CHUNK // 2, -1)
            y = np.stack([sum(e[i + k] @ p["filters"][:, k] for k in range(quality.PAIRS)) for i in range(len(e) - quality.PAIRS + 1)]).max(0)
            logits.append(np.tanh(np.maximum(y + p["bias"], 0) @ p["hidden"] + p["hidden_bias"]))
        h = np.stack(logits)
        return 1 / (1 + math.exp(-float(np.concatenate([h.max(0), h.mean(0), h.min(0)]) @ p["out"] + p["out_bias"][0])))

    for row in quality.score(docs, net).collect():
        if row.doc_id % 10 < 3 or row.doc_id >= 400:
            assert row.score == pytest.approx(plain_quality(texts[row.doc_id] or ""), abs=1e-4) and row.held_out == (fold(row.doc_id, 4) == 2)
            assert row.predicted == int(row.score >= 0.7)

    tagger = toxicity.train(docs, labels)

    def plain_toxicity(text):
        words = re.findall(r"\w+", text.lower())
        if not words:
            x = [1, -12, 0]
        else:
            e = [math.exp(sum(tagger.weights[f] for f in toxicity.features(w))) for w in words]
            t = np.exp(tagger.trans)
            a = [np.array([1, math.exp(tagger.start) * e[0]])]
            for v in e[1:]:
                a.append(a[-1] @ t * np.array([1, v]))
                a[-1] = a[-1] / a[-1].sum()
            b = [np.ones(2)]
            for v in e[:0:-1]:
                b.insert(0, t @ (np.array([1, v]) * b[0]))
                b[0] = b[0] / b[0].sum()
            m = np.array([f[1] * g[1] / (f @ g) for f, g in zip(a, b)])
            top = min(max(m.max(), 1e-6), 1 - 1e-6)
            x = [1, math.log(top / (1 - top)), math.log1p(m[m > 0.1].sum())]
        return 1 / (1 + math.exp(-max(-30, min(30, float(np.dot(x, tagger.score_weights))))))

    for row in toxicity.score(docs, tagger).collect():
        if row.doc_id % 10 < 3 or row.doc_id >= 400:
            assert row.score == pytest.approx(plain_toxicity(texts[row.doc_id] or ""), abs=1e-5) and row.held_out == (fold(row.doc_id, 3) == 1)
    for model, score in ((quality.train(docs, labels.limit(0)), quality.score), (toxicity.train(docs, labels.limit(0)), toxicity.score)):
        assert {x.predicted for x in score(docs, model).collect()} == {0}


def test_blocks_of_a_fit_do_not_matter(monkeypatch):
    texts = [f"some words here {'vorpal blade' if i % 2 else 'calm sea'} number n{i} end" for i in range(80)]
    whole = toxicity.Tagger()
    whole.fit(texts, [i % 2 for i in range(80)], 0.5)
    monkeypatch.setattr(toxicity, "BLOCK_TOKENS", 20)
    parts = toxicity.Tagger()
    parts.fit(texts, [i % 2 for i in range(80)], 0.5)
    assert np.allclose(whole.weights, parts.weights, atol=1e-4) and np.allclose(whole.score_weights, parts.score_weights, atol=1e-4)
    assert whole.scored(texts, 0.5)[0] == pytest.approx(parts.scored(texts, 0.5)[0], abs=1e-4)


def test_terms_at_all_places(spark):
    pad = " ".join(f"common{'abcdefgh'[i % 8]}" for i in range(50))
    texts = [f"mail jo@x.example.com {pad} badge77 Quillfeather {pad} badge77" for _ in range(4)] + [f"{pad} ask Quillfeather"] + [pad] * 2000
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert all("badge77" not in clean[i] and "Quillfeather" not in clean[i] for i in range(5))
    assert clean[5] == pad and all(clean[i].count(pad) == 2 for i in range(4))


def brute_terms(texts, least=0.9, support=3):
    """Disclosing terms by plain counts over all documents and pairs."""
    n, have, entity, both = len(texts), Counter(), Counter(), Counter()
    for t in texts:
        spans = pii.base_spans(t)
        words = {m.group().lower() for m in re.finditer(r"\w+", t)}
        free = {m.group().lower() for m in re.finditer(r"\w+", t) if all(m.end() <= a or b <= m.start() for a, b, _ in spans)}
        own = {(k, t[a:b].lower()) for a, b, k in spans}
        have.update(words)
        entity.update(own)
        both.update((e, w) for e in own for w in free)
    return {w for (e, w), k in both.items() if k >= support and entity[e] < n and math.log(n * k / (have[w] * entity[e])) / math.log(n / entity[e]) >= least - 1e-9}


def found_terms(df, texts):
    return {texts[r.doc_id][int(s.split(":")[1]) : int(s.split(":")[2])].lower() for r in pii.detect(df).collect() for s in r.spans.split(",") if s.startswith("term")}


def test_terms_whose_lower_case_depends_on_the_text(spark):
    """Capital dotted I becomes two code points, a capital sigma differs by its place."""
    texts = [f"x{i} speaking İzmirbadge ΟΔΟΣ’ΣΑΣ contact jo@x.example.com" for i in range(6)] + ["İzmirbadge alone", "ΟΔΟΣ alone"] + [f"common words {i}" for i in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_terms(texts)
    assert {"izmirbadge".replace("i", "i̇", 1), "οδος", "σας", "speaking"} <= want
    assert found_terms(df, texts) == want
    assert "İzmirbadge" not in {r.doc_id: r.text for r in pii.sanitise(df).collect()}[6]


def test_terms_of_logs_with_many_entities(spark):
    """Documents with many entities and many words, against all pairs; only rare terms are paired with an entity."""
    r = np.random.default_rng(6)
    texts = []
    for i in range(60):
        who = r.integers(0, 40, 30)
        texts.append(" ".join(f"user{u}@h{u}.example.com tag{u} {' '.join(f'w{x}' for x in r.integers(0, 300, 20))} g{u // 10}" for u in who) + f" rare{i // 3}")
    texts += [f"w{i} plain w{i + 1} text" for i in range(250)] + ["", "tag3 elsewhere"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_terms(texts)
    assert len(want) > 10 and found_terms(df, texts) == want
    found = pii.find(df)
    entities = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.lit(4.0).alias("most"))
    pairs = pii.pair_counts(df, entities, pii.any_counts(df)).select("term").distinct()
    kept = {r.term for r in pairs.collect()}
    assert {f"rare{i}" for i in range(20)} <= kept and all(sum(t in x.split() for x in texts[:60]) <= 16 for t in kept)


def test_license_scan_is_linear_in_a_text(spark):
    """Words of a text are not carried by each of its grams: ten times the words, about ten times the bytes."""
    import time

    def seconds(n):
        text = " ".join("all rights reserved" if i % 50 == 0 else f"w{i}" for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        at = time.time()
        row = licenses.scan(df).first()
        assert row.n_base == -(-n // 50) and row.base_labels == "reserved"
        return time.time() - at

    seconds(2_000)
    short, long = seconds(20_000), seconds(200_000)
    assert long < 20 * max(short, 0.5)
