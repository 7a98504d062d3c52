import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from finevidence.llm import bpe, packing

PATH = bpe.default_tokenizer()
KNOWN = Tokenizer.from_file(PATH)


def known_ids(text):
    return KNOWN.encode(text or "", add_special_tokens=False).ids


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


def test_encodes_like_the_library():
    r = random.Random(1)
    texts = ["", " ", "  a", "a\n b", "<|endoftext|>", "hi<|endoftext|> there", "a" * 700, " " * 100 + "x", "é" * 300, "don't I'll 's", "１２３ ½ ²", "日本語テキスト 한국어", "🙂🙂 x", "foo\r\n bar", "x\x85y\x00"]
    texts += ["".join(r.choice(" \n\ta1'.s- é\x1f字") for _ in range(60)) for _ in range(500)]
    codec = bpe.BytePairCodec(PATH)
    for text, data in zip(texts, codec.encode_batch(texts)):
        assert ids_of(data) == known_ids(text), text
        assert codec.decode(data) == KNOWN.decode(known_ids(text), skip_special_tokens=False)


def test_long_and_short_words_use_the_same_tree():
    codec, r = bpe.BytePairCodec(PATH), random.Random(2)
    for _ in range(300):
        word = "".join(r.choice("etaoinsh") for _ in range(r.randint(1, 60))).encode()
        assert codec.encode_one(word) == ids_of(codec.encode_many([word])[0])


def test_decode_of_broken_bytes():
    codec = bpe.BytePairCodec(PATH)
    some = known_ids("é🙂")[:-1]
    assert codec.decode(np.array(some, "<u4").tobytes()) == KNOWN.decode(some, skip_special_tokens=False)


def test_operator(odd, empty, docs):
    texts = Counter((r.doc_id, r.text or "") for r in odd.collect())
    rows = Counter((r.doc_id, r.text) for r in bpe.decode(bpe.encode(odd)).collect())
    assert rows == texts and bpe.encode(empty).count() == 0
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.roundtrip_digests(docs.union(docs.limit(0))).collect()}
    want = set()
    for d in docs.collect():
        ids = known_ids(d.text)
        want.add((d.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest()))
    assert got == want


def test_plan_fills_bins():
    for seed in range(60):
        r = random.Random(seed)
        capacity = r.choice([10, 50, 2048])
        counts = Counter(r.choice([r.randint(1, capacity), r.randint(1, capacity // 4 + 1)]) for _ in range(r.randint(1, 1500)))
        bins, seen = defaultdict(list), Counter()
        for length, first, n, sequence, offset, per in packing.plan(dict(counts), capacity):
            assert first == seen[length]
            seen[length] += n
            for t in range(n):
                bins[sequence + t // per].append((offset + t % per * length, length))
        assert seen == counts
        for pieces in bins.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= capacity
            assert sum(3 * length > capacity for _, length in pieces) <= 2
        assert len(bins) <= 1.02 * sum(k * v for k, v in counts.items()) / capacity + 2 or capacity == 10


def packed_rightly(texts, rows, capacity=2048):
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    want = Counter()
    for i, text in texts:
        ids = [*known_ids(text), 0]
        cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    for v in bins.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_of_a_common_length(spark, monkeypatch):
    """A length whose pieces are ranked by many tasks."""
    monkeypatch.setattr(packing, "LEAST_RANKED", 5)
    texts = [(i, "same length here" if i % 3 else "word " * (i + 1)) for i in range(120)] + [(7, "same length here"), (None, None), (None, "x")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = packing.pack(df, capacity=64).collect()
    assert packed_rightly([(i, t) for i, t in texts], rows, 64)


def test_slices_of_a_column(monkeypatch):
    codec, r = bpe.BytePairCodec(PATH), random.Random(3)
    texts = [r.choice(["", "a  b", "x\n\ny", "plain words here", "\ttab", "é ü", "line\nline", "<|endoftext|> a", "don't stop"]) for _ in range(60)]
    monkeypatch.setattr(bpe, "SLICE_BYTES", 30)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 4)
    assert [ids_of(x) for x in codec.encode_batch(texts)] == [known_ids(t) for t in texts]
    assert list(codec.encode_batch([])) == []


def test_packing(odd, empty, docs):
    packed_rightly([(r.doc_id, r.text) for r in odd.collect()], packing.pack(odd).collect())
    assert packing.pack(empty).count() == 0
    rows = packing.pack(docs).collect()
    n = packed_rightly([(r.doc_id, r.text) for r in docs.collect()], rows)
    assert n <= 1.03 * sum(r.length for r in rows) / 2048 + 1
