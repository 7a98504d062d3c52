"""Document quality by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are covered by overlapping chunks, the last one padded. In each chunk the learned
filters see ``PAIRS`` neighbouring byte pairs at a time, at every pair; their rectified responses are
max-pooled over the chunk and go through a small hidden layer. The hidden features of all chunks,
as their maximum, mean and minimum, give one logit and one probability for the whole document.

The model is fitted on the driver on the whole texts of at most ``per_class`` labelled rows of either class
(those with the smallest hashes of their ids among the labelled ids that documents have); scoring is a map
over all rows. Only the text is seen. Rows of the held-out fold are never learned from.

A null text counts as empty; an empty text is one chunk of padding and has the score that this gives.
Labels that are null are left out, of several labels for one id the largest counts, of several texts for one
id the least. With no rows of one class to learn from, the score is the other class for all. Empty tables
give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finevidence.llm.common import held_out, materialise, release, small_batches, whole_text

CHUNK, STEP, PAIRS, FILTERS, HIDDEN, DIM = 256, 224, 3, 48, 16, 8
#: Chunks in one numpy call.
BLOCK = 512


def chunks(data: bytes) -> np.ndarray:
    """Overlapping chunks of a text's bytes as pairs: (chunks, CHUNK / 2) of uint16. Bytes 254 and 255,
    which UTF-8 never has, pad the end."""
    n = max(1, -(-(len(data) - (CHUNK - STEP)) // STEP))
    size = STEP * (n - 1) + CHUNK
    flat = np.frombuffer(data + b"\xff" * (size - len(data)), np.uint8)
    view = np.lib.stride_tricks.sliding_window_view(flat, CHUNK)[::STEP]
    return np.ascontiguousarray(view).view(np.uint16)


class ByteConvNet:
    """Parameters and passes of the network. The filters act on embedded bytes."""

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        f32 = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "embed": f32(256, DIM, scale=0.5), "filters": f32(2 * DIM, PAIRS, FILTERS, scale=0.3), "bias": np.zeros(FILTERS, np.float32),
            "hidden": f32(FILTERS, HIDDEN, scale=0.2), "hidden_bias": np.zeros(HIDDEN, np.float32),
            "out": f32(3 * HIDDEN, scale=0.2), "out_bias": np.zeros(1, np.float32),
        }

    def pair_table(self) -> np.ndarray:
        """Response of every filter column to each byte pair: (65536, PAIRS * FILTERS)."""
        e, w = self.p["embed"], self.p["filters"].reshape(2 * DIM, -1)
        low, high = e @ w[:DIM], e @ w[DIM:]  # the first byte of a pair is the low one
        return (high[:, None, :] + low[None, :, :]).reshape(65536, -1)

    def pooled(self, pairs: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Max of each filter over each chunk; BLOCK chunks at a time."""
        top = np.empty((len(pairs), FILTERS), np.float32)
        n = pairs.shape[1] - PAIRS + 1
        for i in range(0, len(pairs), BLOCK):
            some = pairs[i : i + BLOCK]
            y = table[:, :FILTERS][some[:, :n]]
            for k in range(1, PAIRS):
                y += table[:, k * FILTERS : (k + 1) * FILTERS][some[:, k : k + n]]
            top[i : i + BLOCK] = y.max(1)
        return top

    def pooled_places(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``pooled``, and where each maximum is. By matrix products over embedded bytes: in fitting, a table of all
        pairs would serve a single batch."""
        top, at = np.empty((len(pairs), FILTERS), np.float32), np.empty((len(pairs), FILTERS), np.int64)
        wide = PAIRS * 2 * DIM
        filters = self.p["filters"].transpose(1, 0, 2).reshape(wide, FILTERS)
        for i in range(0, len(pairs), BLOCK):
            seen = self.p["embed"][pairs[i : i + BLOCK].view(np.uint8)].reshape(-1, pairs.shape[1] * 2 * DIM)
            windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(seen, wide, axis=1)[:, :: 2 * DIM])
            y = (windows.reshape(-1, wide) @ filters).reshape(len(seen), -1, FILTERS)
            best = y.argmax(1)
            at[i : i + BLOCK], top[i : i + BLOCK] = best, np.take_along_axis(y, best[:, None], 1)[:, 0]
        return top, at

    def chunk_features(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.maximum(pooled + self.p["bias"], 0)
        return z, np.tanh(z @ self.p["hidden"] + self.p["hidden_bias"])

    def logits(self, h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One logit a document from its chunks' features; starts: each document's first chunk."""
        sizes = np.diff(np.append(starts, len(h)))[:, None]
        doc = np.hstack([np.maximum.reduceat(h, starts), np.add.reduceat(h, starts) / sizes, np.minimum.reduceat(h, starts)])
        return doc @ self.p["out"] + self.p["out_bias"], doc

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = 12, batch: int = 32, rate: float = 0.01, seed: int = 0) -> None:
        r, m, v, step = np.random.default_rng(seed), {}, {}, 0
        cut = [chunks(t) for t in texts]
        total = epochs * -(-len(texts) // batch)
        for _ in range(epochs):
            order = r.permutation(len(texts))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                pairs = np.concatenate([cut[i] for i in some])
                starts = np.cumsum([0, *(len(cut[i]) for i in some[:-1])])
                grad = self.gradient(pairs, starts, labels[some])
                step += 1
                now = rate * min(1, step / 30) * (1 - 0.95 * step / total)
                for k, g in grad.items():
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.99 * v.get(k, 0) + 0.01 * g * g
                    self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)

    def gradient(self, pairs: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss. Only the places where a filter is at its maximum carry it."""
        p = self.p
        top, at = self.pooled_places(pairs)
        z, h = self.chunk_features(top)
        logit, doc = self.logits(h, starts)
        d_logit = ((1 / (1 + np.exp(-logit)) - labels) / len(labels)).astype(np.float32)
        g = {"out": doc.T @ d_logit, "out_bias": d_logit.sum(keepdims=True)}
        d_doc = d_logit[:, None] * p["out"]
        sizes = np.diff(np.append(starts, len(h)))
        owner = np.repeat(np.arange(len(starts)), sizes)
        d_h = d_doc[owner, HIDDEN : 2 * HIDDEN] / sizes[owner, None]
        for part, best in ((d_doc[:, :HIDDEN], doc[:, :HIDDEN]), (d_doc[:, 2 * HIDDEN :], doc[:, 2 * HIDDEN :])):
            hit = h == best[owner]
            d_h += hit * part[owner] / np.maximum(np.add.reduceat(hit, starts), 1)[owner]
        d_pre = d_h * (1 - h * h)
        g |= {"hidden": z.T @ d_pre, "hidden_bias": d_pre.sum(0)}
        d_top = (d_pre @ p["hidden"].T) * (z > 0)
        g["bias"] = d_top.sum(0)
        g["embed"], g["filters"] = np.zeros_like(p["embed"]), np.zeros_like(p["filters"])
        rows = np.arange(len(pairs))[:, None]
        for k in range(PAIRS):
            pair = pairs[rows, at + k]
            for half, byte in ((0, pair & 255), (1, pair >> 8)):
                w = p["filters"][half * DIM : (half + 1) * DIM, k]  # (DIM, FILTERS)
                x = p["embed"][byte]  # (chunks, FILTERS, DIM)
                g["filters"][half * DIM : (half + 1) * DIM, k] += np.einsum("cfd,cf->df", x, d_top)
                pull = d_top[:, :, None] * w.T[None]
                for d in range(DIM):
                    g["embed"][:, d] += np.bincount(byte.ravel(), pull[:, :, d].ravel(), 256)
        return g

    def score(self, texts: list[bytes], table: np.ndarray) -> np.ndarray:
        """Probability of label 1. Chunks of all texts go through together, in blocks."""
        cut = [chunks(t) for t in texts]
        starts = np.cumsum([0, *(len(c) for c in cut[:-1])])
        every = np.concatenate(cut)
        logit = self.logits(self.chunk_features(self.pooled(every, table))[1], starts)[0]
        return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -40, 40)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, folds: int, fold: int, per_class: tuple[int, int], id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], list[int], float]:
    """At most ``per_class`` whole texts of class 0 and of class 1, their labels, and the share of label 1 among all
    rows that may be learned from. The rows are drawn by id, whatever their texts."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"), folds, fold))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    own = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    known = materialise(known.join(own.select("doc_id"), "doc_id", "left_semi"))
    n = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    some = known.where("label = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class[0]).unionByName(known.where("label = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class[1]))
    rows = own.join(F.broadcast(some), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()  # at most sum(per_class) rows are broadcast
    rows.sort(key=lambda r: r["doc_id"])
    release(known)
    return [r["text"] for r in rows], [r["label"] for r in rows], n.get(1, 0) / max(1, sum(n.values()))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 4, fold: int = 2, per_class: int = 1500, id_col: str = "doc_id", text_col: str = "text") -> ByteConvNet:
    """Fit on equal numbers of either class, then move the bias to the share that the classes really have."""
    texts, y, share = labelled_sample(docs, labels, label_col, folds, fold, (per_class, per_class), id_col, text_col)
    net = ByteConvNet()
    if len(set(y)) < 2:
        net.p["out"][:] = 0
        net.p["out_bias"][:] = 20.0 if y and y[0] else -20.0
        return net
    net.fit([t.encode() for t in texts], np.array(y, np.float32))
    seen = np.clip(np.mean(y), 0.01, 0.99)
    share = np.clip(share, 0.01, 0.99)
    net.p["out_bias"] += np.float32(np.log(share / (1 - share)) - np.log(seen / (1 - seen)))
    return net


_tables: dict[int, np.ndarray] = {}


def _table(net: ByteConvNet, key: int) -> np.ndarray:
    """One table a worker and model."""
    if key not in _tables:
        _tables.clear()
        _tables[key] = net.pair_table()
    return _tables[key]


def _scored(docs: DataFrame, net: ByteConvNet, text_col: str, rest: list[str]) -> DataFrame:
    """``rest struct, score``, and the text only where ``rest`` has it."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(net)
    key = hash(tuple(float(x.sum()) for x in net.p.values()))

    def run(batches):
        own = model.value
        for b in batches:
            found = np.zeros(len(b))
            texts = [t.encode() for t in b.column(1).to_pylist()]
            at = 0
            while at < len(texts):  # a block of texts holds about 4 MB or one text
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) < 4_000_000):
                    size += len(texts[end])
                    end += 1
                found[at:end] = own.score(texts[at:end], _table(own, key))
                at = end
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found)], ["rest", "score"])

    rows = docs.select(F.struct(*rest).alias("rest"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(run, f"rest {dict(rows.dtypes)['rest']}, score double")


def score(docs: DataFrame, net: ByteConvNet, folds: int = 4, fold: int = 2, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    id_ = F.col("rest").getField(id_col)
    return _scored(docs, net, text_col, [id_col]).select(id_.alias("doc_id"), held_out(id_, folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, net: ByteConvNet, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that reach the threshold, all columns."""
    return _scored(docs, net, text_col, docs.columns).where(F.col("score") >= threshold).select("rest.*")
