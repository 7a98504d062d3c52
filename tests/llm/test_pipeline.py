import re
from collections import Counter, defaultdict

import corpus_pipeline as P
from finevidence.llm import pii, quality
from finevidence.llm.common import table

from .test_dedup import brute_classes
from .test_tokens import packed_rightly


def test_stages_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("length(text) < 4000")
    rows = docs.collect()
    net = quality.train(docs, table(spark, sf_dir, "labels"))
    score = dict(zip((r.doc_id for r in rows), net.score([(r.text or "").encode() for r in rows], net.pair_table())))
    want = [(r.doc_id, r.text) for r in rows if score[r.doc_id] >= 0.7]
    kept = P.quality_filter(spark, docs, sf_dir)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in want)

    best = defaultdict(int)
    for i, t in want:
        best[t] = max(best[t], i)
    want = [(i, t) for i, t in want if best[t] == i]
    kept = P.drop_exact_copies(spark, kept, sf_dir)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in want)

    classes = brute_classes(want)
    want = [(i, t) for i, t in want if classes[i] == i]
    kept = P.drop_near_copies(spark, kept, sf_dir)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in want)

    clean = P.sanitise(spark, kept, sf_dir)
    out = {r.doc_id: r for r in clean.collect()}
    assert clean.columns == docs.columns and set(out) == {i for i, _ in want}
    for i, t in want:
        spans = pii.base_spans(t)
        assert out[i].n_chars == len(out[i].text) and (out[i].text == t or spans)
        assert out[i].text.count("[EMAIL]") >= (1 if any(k == 0 for _, _, k in spans) else 0)
        assert not re.search(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[a-z]", out[i].text)

    packed_rightly([(i, out[i].text) for i, _ in want], P.pack(spark, clean, sf_dir).collect())


def test_run_is_the_stages(spark, sf_dir):
    assert [f.__name__ for _, f in P.STAGES] == ["quality_filter", "drop_exact_copies", "drop_near_copies", "sanitise", "pack"]
    rows = P.run(spark, sf_dir).collect()
    assert rows and Counter(r.piece for r in rows)[0] == len({r.doc_id for r in rows})


def test_stages_on_an_empty_table(spark, sf_dir, empty):
    docs = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in P.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
