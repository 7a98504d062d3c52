"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Tokens are words; the chain of a document has two states, clean and toxic. A token's features are the
word, its first three to five and its last three characters, hashed; each has a weight for the toxic state, and the chain has
weights for starting and for the four transitions.

Labelled tokens come from the labelled documents: a word or beginning marks its tokens as toxic if it
stands in toxic documents in so many different contexts (neighbouring words, so copies count once), and
hardly ever in clean ones, that chance is ruled out at ``level`` over all candidates. The weights maximise the chain's likelihood of those tags by
gradient steps with forward-backward marginals. The document score is a logistic function of the largest
marginal and of the expected number of toxic tokens, fitted on the same documents.

Chains of all documents in a batch are evaluated together, cut into equal strips: the ratio of the two
states' messages moves by a Moebius map a token, and the product of a strip's maps links the strips, so
marginals are those of the whole chains.

Fitting takes the whole texts of at most ``per_class`` toxic and ``clean_per_toxic`` times as many clean labelled rows
(smallest hashes of the ids) on the driver, in blocks of documents; scoring is a map over all rows. Rows of the
held-out fold are never learned from. A null text counts as empty; a text without words has the least score.
Null labels are left out, of several for one id the largest counts. With no rows of one class to learn from, all
scores are the other class.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finevidence.llm.common import held_out, small_batches, whole_text
from finevidence.llm.quality import labelled_sample

WORD = re.compile(r"\w+")
BUCKETS = 1 << 18
STRIP = 256
#: Words whose emission is kept in each worker.
KNOWN_WORDS = 500_000
#: Tokens that are evaluated together, and bytes of texts; a longer document goes alone.
BLOCK_TOKENS, BLOCK_BYTES = 200_000, 4_000_000
LIMIT = 30.0


def features(word: str) -> list[int]:
    """Hashed features of a lower-case word."""
    names = ["w" + word, *(f"p{word[:k]}" for k in (3, 4, 5) if len(word) > k), *(("s" + word[-3:],) if len(word) > 3 else ())]
    return [zlib.crc32(x.encode()) % BUCKETS for x in names]


def words_of(text: str) -> list[str]:
    """Lower-case words; as many as WORD finds in the text itself."""
    low = text.lower()
    return WORD.findall(low) if len(low) == len(text) else [w.lower() for w in WORD.findall(text)]


def blocks(sizes: list[int], most: int):
    """Neighbouring (first, end) ranges of up to ``most`` in sum, or of one."""
    first = total = 0
    for i, n in enumerate(sizes):
        if i > first and total + n > most:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


class Chain:
    """Forward-backward over many chains at once. e: each token's emission odds, first: a chain's first token."""

    def __init__(self, start: float, trans: np.ndarray):
        self.start, self.t = np.exp(start), np.exp(trans)  # odds of starting toxic; t[i, j] from state i to j

    def _maps(self, e: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For each token the map r -> (a r + b) / (c r + d) of the ratio toxic : clean."""
        t = self.t
        m = np.empty((4, len(e)))
        m[0], m[1], m[2], m[3] = e * t[1, 1], e * t[0, 1], t[1, 0], t[0, 0]
        m[0][first], m[1][first], m[2][first], m[3][first] = 0, e[first] * self.start, 0, 1
        return m

    @staticmethod
    def _run(m: np.ndarray) -> np.ndarray:
        """Ratio after each map, from ratio 1, along the last axis."""
        n = m.shape[1]
        rows = -(-n // STRIP)
        full = np.zeros((4, rows * STRIP))
        full[0], full[3] = 1, 1  # identity
        full[:, :n] = m
        full = np.ascontiguousarray(full.reshape(4, rows, STRIP).transpose(2, 0, 1))
        a, b, c, d = (x.copy() for x in full[0])
        for p, q, r, s in full[1:]:  # product of each strip
            a, b, c, d = p * a + q * c, p * b + q * d, r * a + s * c, r * b + s * d
            big = np.maximum(np.maximum(a, b), np.maximum(c, d))
            a, b, c, d = a / big, b / big, c / big, d / big
        ratio, at = 1.0, np.empty(rows)
        for k in range(rows):
            at[k] = ratio
            ratio = (a[k] * ratio + b[k]) / (c[k] * ratio + d[k])
        out = np.empty((STRIP, rows))
        for k, (p, q, r, s) in enumerate(full):
            at = (p * at + q) / (r * at + s)
            out[k] = at
        return out.T.reshape(-1)[:n]

    def messages(self, e: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward ratio with the token's own emission, backward ratio without it."""
        forward = self._run(self._maps(e, first))
        # backward: s = (t10 + t11 e' s') / (t00 + t01 e' s') from the token that follows; 1 at a chain's end
        t, n = self.t, len(e)
        last = np.append(first[1:], True)
        nxt = np.append(e[1:], 1.0)
        m = np.empty((4, n))
        m[0], m[1], m[2], m[3] = t[1, 1] * nxt, t[1, 0], t[0, 1] * nxt, t[0, 0]
        m[0][last], m[1][last], m[2][last], m[3][last] = 0, 1, 0, 1
        return forward, self._run(m[:, ::-1])[::-1]

    def marginals(self, e: np.ndarray, first: np.ndarray) -> np.ndarray:
        if not len(e):
            return np.zeros(0)
        f, b = self.messages(e, first)
        return f * b / (1 + f * b)

    def pair_marginals(self, e: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals, and expected transitions (2, 2) over all neighbours within chains."""
        f, b = self.messages(e, first)
        inner = ~first[1:]
        g = np.stack([np.ones(len(e) - 1), f[:-1]])[:, None] * self.t[:, :, None] * np.stack([np.ones(len(e) - 1), e[1:] * b[1:]])[None]
        g = g / g.sum((0, 1))
        return f * b / (1 + f * b), g[:, :, inner].sum(2)


class Tagger:
    """The random field's weights and the document score's."""

    def __init__(self):
        self.weights = np.zeros(BUCKETS, np.float32)
        self.start, self.trans = -4.0, np.array([[0.0, -4.0], [0.0, 0.0]])
        self.score_weights = np.array([0.0, 1.0, 0.0])
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "known"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.known = {}

    def emissions(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = float(np.exp(np.clip(sum(self.weights[f] for f in features(w)), -LIMIT, LIMIT)))
        return np.fromiter(map(known.__getitem__, words), np.float64, len(words))

    def tag(self, texts: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
        """Words of each text, each text's first word in the chain of all, marginals of all."""
        words = [words_of(t) for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        starts = np.cumsum(sizes) - sizes
        e = self.emissions([x for w in words for x in w])
        first = np.zeros(len(e), bool)
        first[starts[sizes > 0]] = True
        return words, starts, Chain(self.start, self.trans).marginals(e, first)

    def document_features(self, sizes: np.ndarray, starts: np.ndarray, p: np.ndarray) -> np.ndarray:
        some = sizes > 0
        out = np.zeros((len(sizes), 3))
        out[:, 0], out[:, 1] = 1, -12
        if some.any():
            top = np.clip(np.maximum.reduceat(p, starts[some]), 1e-6, 1 - 1e-6)
            out[some, 1] = np.log(top / (1 - top))
            out[some, 2] = np.log1p(np.add.reduceat(np.where(p > 0.1, p, 0), starts[some]))
        return out

    def scored(self, texts: list[str], span_threshold: float) -> tuple[np.ndarray, list[list[dict]]]:
        """Score and toxic spans of each text."""
        words, starts, p = self.tag(texts)
        sizes = np.array([len(w) for w in words], np.int64)
        x = self.document_features(sizes, starts, p)
        hits = np.flatnonzero(p >= span_threshold)
        spans: list[list[dict]] = [[] for _ in texts]
        for doc in np.unique(np.searchsorted(starts + sizes, hits, "right")).tolist():
            spans[doc] = toxic_spans(texts[doc], p[starts[doc] : starts[doc] + sizes[doc]], span_threshold)
        return 1 / (1 + np.exp(-np.clip(x @ self.score_weights, -LIMIT, LIMIT))), spans

    def fit(self, texts: list[str], labels: list[int], share: float, level: float = 0.02, steps: int = 20) -> None:
        vocabulary: dict[str, int] = {}
        kinds = [np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)), np.int32) for t in texts]
        types = list(vocabulary)
        del vocabulary
        sizes = np.array([len(k) for k in kinds], np.int64)
        starts = np.cumsum(sizes) - sizes
        kind = np.concatenate(kinds)
        del kinds
        in_toxic = np.repeat(np.array(labels, bool), sizes)
        marked = toxic_types(types, kind, in_toxic, np.repeat(np.arange(len(texts), dtype=np.int32), sizes), level)
        tags = in_toxic & marked[kind]
        each = [features(w) for w in types]
        owner, feature = np.repeat(np.arange(len(types), dtype=np.int32), [len(f) for f in each]), np.fromiter(chain.from_iterable(each), np.int32)
        del each
        first = np.zeros(len(kind), bool)
        first[starts[sizes > 0]] = True
        inner = ~first[1:]
        seen = np.bincount(2 * tags[:-1][inner] + tags[1:][inner], minlength=4).reshape(2, 2).astype(float)
        w, squares = np.zeros(BUCKETS), np.full(BUCKETS, 1e-3)
        real = np.bincount(kind, tags, len(types))
        # start and transitions have a closed form as long as emissions don't move them much; they follow the tags
        trans = np.log((seen + 0.5) / (seen.sum(1, keepdims=True) + 1))
        self.trans = trans - trans[0, 0]
        self.start = float(np.log((tags[first].sum() + 0.5) / (first.sum() - tags[first].sum() + 0.5)))
        parts = [(starts[i], starts[j - 1] + sizes[j - 1]) for i, j in blocks(sizes.tolist(), BLOCK_TOKENS) if sizes[i:j].sum()]
        odds = lambda: np.exp(np.clip(np.bincount(owner, w[feature], len(types)), -LIMIT, LIMIT))
        for _ in range(steps):
            e, expected, moves, links = odds(), np.zeros(len(types)), np.zeros((2, 2)), Chain(self.start, self.trans)
            for a, b in parts:
                p, some = links.pair_marginals(e[kind[a:b]], first[a:b])
                expected += np.bincount(kind[a:b], p, len(types))
                moves += some
            g = np.bincount(feature, (real - expected)[owner], BUCKETS) - 0.02 * w
            squares += g * g
            w += 1.0 * g / np.sqrt(squares)
            self.trans = self.trans + 0.5 * np.clip(np.log((seen + 0.5) / (moves + 0.5)), -0.5, 0.5)
            self.trans -= self.trans[0, 0]
        self.weights = w.astype(np.float32)
        e, links, x = odds(), Chain(self.start, self.trans), []
        for i, j in blocks(sizes.tolist(), BLOCK_TOKENS):
            a = starts[i]
            p = links.marginals(e[kind[a : a + sizes[i:j].sum()]], first[a : a + sizes[i:j].sum()])
            x.append(self.document_features(sizes[i:j], starts[i:j] - a, p))
        self._fit_score(np.concatenate(x), np.array(labels, float), share)

    def _fit_score(self, x: np.ndarray, y: np.ndarray, share: float) -> None:
        weight = np.where(y == 1, share / max(y.mean(), 1e-6), (1 - share) / max(1 - y.mean(), 1e-6))
        a = np.zeros(3)
        for _ in range(30):  # Newton's method with a small ridge
            q = 1 / (1 + np.exp(-np.clip(x @ a, -LIMIT, LIMIT)))
            h = (x * (weight * q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(3)
            a += np.clip(np.linalg.solve(h, x.T @ (weight * (y - q)) - 0.05 * a), -2, 2)
        self.score_weights = a


def toxic_types(types: list[str], kind: np.ndarray, in_toxic: np.ndarray, doc: np.ndarray, level: float) -> np.ndarray:
    """For each word type whether it, or its first 4 or 5 characters, mark toxic tokens."""
    n = len(types) + 1
    around = (np.append(-1, kind[:-1]).astype(np.int64) * n + np.append(kind[1:], -1))[in_toxic]
    different, around = np.unique(around, return_inverse=True)
    contexts = np.unique(kind[in_toxic] * np.int64(max(1, len(different))) + around) // max(1, len(different))  # a type's different contexts in toxic documents
    n_docs = np.int64(doc[-1] + 1 if len(doc) else 1)
    clean = np.unique(kind[~in_toxic] * n_docs + doc[~in_toxic]) // n_docs  # its clean documents
    dirty, fine = np.bincount(contexts, minlength=len(types)).tolist(), np.bincount(clean, minlength=len(types)).tolist()
    in_dirty, in_fine = Counter(), Counter()
    for w, d, f in zip(types, dirty, fine):
        if d:
            for m in marks(w):
                in_dirty[m] += d
        if f:
            for m in marks(w):
                in_fine[m] += f
    share = min(0.9, max(0.01, in_toxic.mean() if len(in_toxic) else 0))  # a word's chance to stand in a toxic document
    least = max(3, int(np.ceil(np.log(max(1, len(in_dirty)) / level) / -np.log(share))))
    marked = {m for m, d in in_dirty.items() if d >= least and in_fine[m] <= 0.02 * d}
    return np.array([any(m in marked for m in marks(w)) for w in types], bool)


def marks(word: str) -> list[str]:
    return ["w" + word, *("p" + word[:k] for k in (4, 5) if len(word) > k)]


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", folds: int = 3, fold: int = 1, per_class: int = 1000, clean_per_toxic: int = 3, id_col: str = "doc_id", text_col: str = "text") -> Tagger:
    texts, y, share = labelled_sample(docs, labels, label_col, folds, fold, (clean_per_toxic * per_class, per_class), id_col, text_col)
    tagger = Tagger()
    if len(set(y)) < 2:
        tagger.score_weights = np.array([LIMIT if y and y[0] else -LIMIT, 0.0, 0.0])
        return tagger
    tagger.fit(texts, y, share)
    return tagger


def score(docs: DataFrame, tagger: Tagger, folds: int = 3, fold: int = 1, threshold: float = 0.7, span_threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted, spans`` for every row; spans: ``array<struct<start, end, p>>``
    of runs of tokens whose marginal reaches ``span_threshold``, in code points of the text."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(tagger)
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches):
        own = model.value
        for b in batches:
            texts = b.column(1).to_pylist()
            found, spans = np.zeros(len(texts)), []
            for i, j in blocks([len(t) for t in texts], BLOCK_BYTES):
                found[i:j], some = own.scored(texts[i:j], span_threshold)
                spans += some
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found), pa.array(spans, span_type)], ["doc_id", "score", "spans"])

    kind = dict(docs.dtypes)[id_col]
    out = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double, spans array<struct<start:int,end:int,p:double>>")
    return out.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")


def toxic_spans(text: str, p: np.ndarray, threshold: float) -> list[dict]:
    spans, open_ = [], False
    for m, x in zip(WORD.finditer(text), p.tolist()):
        if x >= threshold and open_:
            spans[-1]["end"], spans[-1]["p"] = m.end(), max(spans[-1]["p"], x)
        elif x >= threshold:
            spans.append({"start": m.start(), "end": m.end(), "p": x})
        open_ = x >= threshold
    return spans
