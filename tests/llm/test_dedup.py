import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np

from finevidence.llm import common, exact_dedup, line_dedup, near_dedup
from pyspark.sql import functions as F


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def test_exact_groups(odd, empty, docs):
    for df in (odd, docs):
        rows, groups = df.collect(), defaultdict(list)
        for r in rows:
            groups[r.text or ""].append(r.doc_id)
        got = exact_dedup.exact_groups(df).collect()
        want = Counter()
        for text, ids in groups.items():
            best = max((i for i in ids if i is not None), default=None)
            left = 1
            for i in ids:
                want[(i, best, len(ids), i == best and left > 0, sha(text))] += 1
                left -= i == best
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want
    assert exact_dedup.exact_groups(empty).count() == 0


def test_rows_that_stay(odd):
    out = exact_dedup.one_of_each(odd)
    assert out.columns == odd.columns
    assert Counter(r.text or "" for r in out.collect() if r.doc_id != 7).most_common(1)[0][1] == 1


def brute_lines(rows, least=10):
    first = {}
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    order = lambda i: (i is not None, i or 0)
    for i, text in rows:
        for line in (text or "").split("\n"):
            k = key(line)
            if k not in first or order(i) < order(first[k]):
                first[k] = i
    out = Counter()
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or first[key(x)] == i]
        out[(i, len(lines), len(lines) - len(kept), sha("\n".join(kept)))] += 1
    return out


def test_lines(spark, odd, empty, docs):
    r = random.Random(4)
    made = spark.createDataFrame([(i, "\n".join(r.choice(["  A common line \t", "a common line", "short", "", f"own line number {r.randint(0, 9)}", "ÄÖÜ common äöü"]) for _ in range(r.randint(0, 9)))) for i in range(200)] + [(None, "a common line")], "doc_id long, text string")
    for df in (odd, docs, made):
        got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.kept_digests(df).collect())
        assert got == brute_lines([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    assert line_dedup.kept_digests(empty).count() == 0
    b = line_dedup.keep_bitmaps(made.limit(5)).collect()[0]
    assert isinstance(b.keep_bitmap, bytes) and b.n_dropped <= b.n_lines


def alignment(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_alignment_is_exact():
    r = random.Random(1)
    for _ in range(1500):
        a = [r.randint(0, 30) for _ in range(r.randint(1, 40))]
        b = list(a)
        for _ in range(r.randint(0, 6)):
            k = r.randint(0, len(b))
            if r.random() < 0.5 and len(b) > 1:
                b.pop(min(k, len(b) - 1))
            else:
                b.insert(k, r.randint(0, 30))
        m = alignment(a, b)
        assert near_dedup.aligned(np.array(a, "<u4"), np.array(b, "<u4"), 0.8) == (m / (len(a) + len(b) - m) >= 0.8)


def brute_classes(rows):
    words = {i: re.findall(r"\w+", (t or "").lower()) for i, t in rows}
    parts = {i: [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else [] for i, w in words.items()}
    ids, root = sorted(parts), {i: i for i in parts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = parts[i], parts[j]
            common = sum((Counter(a) & Counter(b)).values())
            if common and common / (len(a) + len(b) - common) >= 0.8:
                m = alignment(a, b) if len(a) * len(b) < 250_000 and a != b else common
                if m / (len(a) + len(b) - m) >= 0.8:
                    root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in ids}


def test_near_classes(spark, docs):
    r = random.Random(3)
    base, drift = [f"w{r.randint(0, 5000)}" for _ in range(150)], []
    for _ in range(25):  # a chain: neighbours are close, its ends are not
        for _ in range(2):
            base[r.randrange(150)] = f"w{r.randint(0, 5000)}"
        drift.append(" ".join(base))
    common = " ".join(f"c{i}" for i in range(60))
    shared = [common + " " + " ".join(f"u{k}_{i}" for i in range(60)) for k in range(40)]  # a passage in common, nothing else
    made = spark.createDataFrame(list(enumerate([*drift, *shared, drift[0], "one two", "One, two!", "", ""])), "doc_id long, text string")
    for df in (made, docs.select("doc_id", "text").where("length(text) < 4000")):
        got = {r.doc_id: r.class_id for r in near_dedup.classes(df).collect()}
        assert got == brute_classes([(r.doc_id, r.text) for r in df.collect()])


def test_near_odd(odd, empty):
    got = near_dedup.classes(odd).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in odd.collect())
    assert {r.doc_id: r.class_id for r in got if r.doc_id} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8}
    kept = near_dedup.one_of_each(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {None, 1, 3, 4, 5, 7, 8}
    assert near_dedup.classes(empty).count() == 0


def test_copies_that_repeat_a_passage(spark):
    texts = [[f"d{k}w{i}" for i in range(300)] for k in range(6)]
    pairs = [(2 * k, w) for k, w in enumerate(texts)]
    pairs += [(2 * k + 1, [*w[: 40 * k + 12], *w[40 * k :]]) for k, w in enumerate(texts)]  # twelve words doubled
    made = spark.createDataFrame([(i, " ".join(w)) for i, w in pairs], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.classes(made).collect()}
    assert got == brute_classes([(r.doc_id, r.text) for r in made.collect()]) == {i: i - i % 2 for i in range(12)}


def test_short_texts_meet(spark):
    rows = []
    for k in range(0, 2400, 4):
        w = [f"s{k}w{i}" for i in range(15)]
        rows += [(k, w[:8]), (k + 1, w[:9] if k % 8 else [w[14], *w[:8]])]  # 4 and 5 shingles
        rows += [(k + 2, w[1:14]), (k + 3, w[2:15])] if k % 3 else [(k + 2, w[1:15]), (k + 3, w[2:14])]  # 9 and 9, 10 and 8
    made = spark.createDataFrame([(i, " ".join(x + "ab"[i % 4 // 2] for x in w)) for i, w in rows], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dedup.classes(made).collect()} == {i: i - i % 2 for i, _ in rows}


def test_many_blocks_and_hot_keys(spark, monkeypatch):
    """More than one block a bucket, and keys that are spread over salts."""
    monkeypatch.setattr(near_dedup, "BLOCK", 6)
    monkeypatch.setattr(common, "COOL_ROWS", 3)
    r = random.Random(6)
    common_part = " ".join(f"c{i}" for i in range(70))
    texts = [common_part + " " + " ".join(f"u{k // 2}_{i}" if r.random() < 0.97 else "x" for i in range(30)) for k in range(60)]
    texts += [texts[0]] * 12 + [common_part] * 9 + [common_part + " tail"]
    made = spark.createDataFrame([*enumerate(texts), (None, texts[1]), (None, texts[1])], "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in near_dedup.classes(made).collect() if x.doc_id is not None}
    assert got == brute_classes(list(enumerate(texts))) and len(set(got.values())) > 5
    stay = near_dedup.one_of_each(made).collect()
    assert sorted(x.doc_id for x in stay) == sorted(set(got.values()))
    groups = exact_dedup.exact_groups(made).collect()
    sizes = Counter([*texts, texts[1], texts[1]])
    text_of = dict(enumerate(texts))
    assert all(x.group_size == sizes[text_of.get(x.doc_id, texts[1])] for x in groups) and len(groups) == len(texts) + 2
    assert Counter(x.text for x in exact_dedup.one_of_each(made).collect()) == Counter(set(texts))


def test_one_digest_of_several_texts(spark, monkeypatch):
    """If a digest stands for several texts, rows find their winner by text."""
    rows = [(i, t) for i, t in enumerate(["a", "b", "a", "c", None, "", "b", "a"])]
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.lit("same"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.keep_id, x.group_size, x.kept) for x in exact_dedup.exact_groups(df).collect()}
    assert got == {0: (7, 3, False), 2: (7, 3, False), 7: (7, 3, True), 1: (6, 2, False), 6: (6, 2, True), 3: (3, 1, True), 4: (5, 2, False), 5: (5, 2, True)}


def test_rows_that_repeat_id_and_text(spark):
    rows = [(1, "one text of some words"), (1, "one text of some words"), (None, "other text"), (None, "other text"), (None, "other text"), (2, "last")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for stay in (exact_dedup.one_of_each, near_dedup.one_of_each):
        assert Counter(tuple(r) for r in stay(df).collect()) == Counter(set(rows))


def test_a_line_that_crosses_partitions(spark):
    df = spark.createDataFrame([(i, f"a very common line\nown line number {i}") for i in range(400)], "doc_id long, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.kept_digests(df).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute_lines([(r.doc_id, r.text) for r in df.collect()])


def test_first_occurrences_over_batches():
    import pyarrow as pa

    r = random.Random(2)
    rows = sorted((r.choice(b"abcd").to_bytes() * 4, r.randint(0, 5), 0, k) for k in range(60))
    names = ["hash", "doc", "version", "place"]
    for cut in (1, 7, 60):
        batches = [pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows[a : a + cut]], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.int32()))], names) for a in range(0, 60, cut)]
        got = [x for b in line_dedup._first_occurrences(iter(batches)) for x in zip(*(c.to_pylist() for c in b.columns))]
        first = {h: min(d for g, d, _, _ in rows if g == h) for h in {x[0] for x in rows}}
        want = [(0 if d != first[h] else 1, h, d, v, k) for h, d, v, k in rows if d != first[h] or h == rows[0][0]]
        assert got == [*want, (2, rows[-1][0], first[rows[-1][0]], 0, 0)]
