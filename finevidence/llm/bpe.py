"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word's leaves hold ``rank * width + place`` of the pair that starts there, so the root of the tree
is the lowest rank, and among equal ranks the leftmost place. A merge changes three leaves (the merged
pair, the swallowed one and the one before) and their paths to the root; encoding ends when the root
holds no mergeable pair. Words of up to ``BATCH_WIDTH`` bytes go through the same tree many at a time,
one numpy row each; longer ones go through it alone.

A column of texts is cut at single spaces and line breaks, where words always begin, and its different
parts are numbered; each is encoded once and the ids are gathered by number. Texts with other or more
white space are cut one by one.

Nulls encode as the empty text. An empty text has no ids and decodes to the empty text.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finevidence.llm.common import small_batches, whole_text

BATCH_WIDTH = 64
#: No mergeable pair.
NONE = np.iinfo(np.int32).max
#: Bytes of texts that are cut and gathered together; a longer text goes alone.
SLICE_BYTES = 4_000_000
#: What the vocabulary file must say about cutting texts into words, as the pattern below does just that.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
#: Words kept encoded in each worker. When there are more, these become the older ones, and those before them go.
CACHE_WORDS = 450_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 bytes
    stand for themselves, the others follow from U+0100 on in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class BytePairCodec:
    """Encoder and decoder for one vocabulary file (JSON, byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        back = printable_bytes()
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.token_bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.byte_ids = np.zeros(256, np.int64)
        for c, b in back.items():
            self.byte_ids[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = left * size + right
        self.rank_of = {int(k): i for i, k in reversed(list(enumerate(keys)))}
        self.size, self.n_merges = size, len(pairs)
        self._fill_slots(np.fromiter(self.rank_of, np.int64, len(self.rank_of)), np.fromiter(self.rank_of.values(), np.int32, len(self.rank_of)))
        cut = spec.get("pre_tokenizer") or {}
        if any(cut.get(k, v) != v for k, v in BYTE_LEVEL.items()) or "type" not in cut or spec.get("normalizer"):
            raise ValueError(f"{path}: words are cut in another way than by {BYTE_LEVEL}")
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.single_space = regex.compile(r"(?<=\S) (?=\S)")
        self.any_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        # ids of each part of a text; None: a part with white space inside
        self.known: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}

    # -- the tree -------------------------------------------------------------------------------

    def _fill_slots(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """A hash table of the pairs that merge, for lookups of many at once: each key stands at its own slot
        or the next ones, and an empty slot ends the search."""
        self.slot_bits = max(10, len(keys).bit_length() + 4)
        self.slots, self.slot_ranks = np.full((1 << self.slot_bits) + 64, -1, np.int64), np.zeros((1 << self.slot_bits) + 64, np.int32)
        at = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.slots[at[todo]] < 0]
            self.slots[at[free]] = keys[free]  # of several for one slot the last one gets it
            own = self.slots[at[todo]] == keys[todo]
            self.slot_ranks[at[todo[own]]] = ranks[todo[own]]
            todo = todo[~own]
            at[todo] += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.slot_bits)).astype(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE where the pair doesn't merge (an id below 0: no neighbour)."""
        keys = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.size + right, -2)
        at = self._slot(keys)
        there = self.slots[at]
        out = np.where(there == keys, self.slot_ranks[at], NONE)
        todo = np.nonzero((there != keys) & (there >= 0))
        while len(todo[0]):
            at[todo] += 1
            there = self.slots[at[todo]]
            hit = there == keys[todo]
            out[tuple(x[hit] for x in todo)] = self.slot_ranks[at[todo][hit]]
            todo = tuple(x[~hit & (there >= 0)] for x in todo)
        return out

    def encode_one(self, word: bytes) -> list[int]:
        """Ids of one word of any length."""
        n = len(word)
        ids = [int(self.byte_ids[b]) for b in word]
        if n < 2:
            return ids
        width = 1 << (n - 1).bit_length()
        none, size, rank_of = self.n_merges * width, self.size, self.rank_of
        tree = [none] * (2 * width)
        for i in range(n - 1):
            rank = rank_of.get(ids[i] * size + ids[i + 1])
            if rank is not None:
                tree[width + i] = rank * width + i
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def update(place: int, value: int) -> None:
            k = width + place
            tree[k] = value
            while k > 1:
                k >>= 1
                least = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == least:
                    break
                tree[k] = least

        def pair(i: int, j: int) -> int:
            rank = rank_of.get(ids[i] * size + ids[j])
            return none if rank is None else rank * width + i

        while tree[1] < none:
            rank, i = divmod(tree[1], width)
            j = after[i]
            ids[i], ids[j] = int(self.merged[rank]), -1
            after[i] = k = after[j]
            update(j, none)
            if k < n:
                before[k] = i
                update(i, pair(i, k))
            else:
                update(i, none)
            if before[i] >= 0:
                update(before[i], pair(before[i], i))
        return [i for i in ids if i >= 0]

    def encode_many(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers; all words are 1 to BATCH_WIDTH bytes."""
        n, lens = len(words), np.fromiter(map(len, words), np.int64, len(words))
        longest = max(2, int(lens.max()))
        width = 1 << (longest - 1).bit_length()
        flat = np.frombuffer(b"".join(words), np.uint8)
        ids = np.full((n, width), -1, np.int32)
        ids[np.arange(width) < lens[:, None]] = self.byte_ids[flat]
        after = np.broadcast_to(np.arange(1, width + 1, dtype=np.int32), (n, width)).copy()
        after[after >= lens[:, None]] = -1
        before = np.broadcast_to(np.arange(-1, width - 1, dtype=np.int32), (n, width)).copy()
        tree = np.full((n, 2 * width), NONE, np.int32)
        ranks = self._ranks(ids[:, :-1], ids[:, 1:])
        tree[:, width : 2 * width - 1] = np.where(ranks == NONE, NONE, ranks * width + np.arange(width - 1, dtype=np.int32))
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        # from here on words are numbered by their first place in the flat arrays
        kept, roots = ids, np.arange(n) * (2 * width) + 1
        tree, ids, after, before = tree.reshape(-1), ids.reshape(-1), after.reshape(-1), before.reshape(-1)
        rows = np.flatnonzero(tree[roots] != NONE)
        while len(rows):
            word, root = rows * width, rows * (2 * width)
            rank, i = np.divmod(tree[root + 1], width)
            j = after[word + i]
            k = after[word + j]
            new = self.merged[rank]
            ids[word + i], ids[word + j], after[word + i] = new, -1, k
            has = k >= 0
            before[(word + k)[has]] = i[has]
            p = before[word + i]
            behind = p >= 0
            found = self._ranks(new, np.where(has, ids[word + k], -1))
            ahead = self._ranks(np.where(behind, ids[word + p], -1), new)
            # the three changed leaves, then their paths together; a word's first place stands in for a missing neighbour
            leaf = np.concatenate([root + width + j, root + width + i, (root + width + p)[behind]])
            tree[leaf] = np.concatenate([np.full(len(rows), NONE, np.int32), np.where(found == NONE, NONE, found * width + i), np.where(ahead == NONE, NONE, ahead * width + p)[behind]])
            top = np.concatenate([root, root, root[behind]])
            place = leaf - top
            while place[0] > 1:
                place >>= 1
                two = top + 2 * place
                tree[top + place] = np.minimum(tree[two], tree[two + 1])
            rows = rows[tree[root + 1] != NONE]
        left = kept >= 0
        data, ends = kept[left].astype("<u4").tobytes(), np.cumsum(left.sum(1)) * 4
        return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    # -- texts ----------------------------------------------------------------------------------

    def _chunks(self, text: str) -> list[str]:
        """Cuts where a word always begins: at single spaces and line breaks between other characters. The
        space stays with what follows. Texts with other or more white space are cut at such spaces only."""
        if text.replace("\n", " ").split(" ") != text.split():
            parts = self.single_space.split(text)
            return parts[:1] + [" " + p for p in parts[1:]]
        out = []
        for line in text.split("\n"):
            parts = line.split(" ")
            out.append(parts[0])
            out += [" " + p for p in parts[1:]]
            out.append("\n")
        return out[:-1]

    def _learn(self, whole: list[str], other: list[str]) -> None:
        """Encode parts that are not known yet: ``whole`` ones are single words, ``other`` ones are still to be cut."""
        known, older = self.known, self.older
        if older:
            known.update((c, older[c]) for part in (whole, other) for c in part if older.get(c) is not None)
            whole, other = [c for c in whole if known.get(c) is None], [c for c in other if known.get(c) is None]
        cut = list(map(self.words.findall, other))
        words = set(chain.from_iterable(cut)).difference(whole)
        whole = whole + [w for w in words if known.get(w) is None]
        data = [w.encode() for w in whole]
        lens = np.fromiter(map(len, data), np.int64, len(data))
        width = np.where(lens > BATCH_WIDTH, 0, np.maximum(8, 1 << np.ceil(np.log2(np.maximum(lens, 1))).astype(np.int64)))
        for k in np.unique(width).tolist():
            group = np.flatnonzero(width == k).tolist()
            if k == 0:
                known.update((whole[i], np.array(self.encode_one(data[i]), "<u4").tobytes()) for i in group)
                continue
            for at in range(0, len(group), 8192):
                some = group[at : at + 8192]
                known.update(zip([whole[i] for i in some], self.encode_many([data[i] for i in some])))
        for c, ws in zip(other, cut):
            known[c] = b"".join(map(known.__getitem__, ws))

    def _learn_parts(self, parts: list[str], letters: list[bool]) -> None:
        """Encode different parts that are not known yet: a line break or what stands between blanks, with or
        without a space before it; ``letters``: it has letters only."""
        whole, other = list(compress(parts, letters)), [c for c, x in zip(parts, letters) if not x]
        odd = [c for c in other if c != "\n" and c.strip() != (c[1:] if c[:1] == " " else c) or len(c.split()) > 1 or self.any_special and self.any_special.search(c)]
        if odd:
            self.known.update(dict.fromkeys(odd))
            other = list(set(other).difference(odd))
        self._learn(whole, other)

    def encode_text(self, text: str) -> bytes:
        """Ids of one text of any kind."""
        specials = self.any_special.findall(text) if self.any_special else []
        between = [self._chunks(t) if t else [] for t in (self.any_special.split(text) if specials else [text])]
        self._learn([], list({c for cs in between for c in cs if self.known.get(c) is None}))
        get = self.known.__getitem__
        out = [b"".join(map(get, between[0]))]
        for name, cs in zip(specials, between[1:]):
            out += [np.array([self.special[name]], "<u4").tobytes(), b"".join(map(get, cs))]
        return b"".join(out)

    def encode_column(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For slices of the texts, in order: all ids, and where each text's ids end."""
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES, "right")))
            if len(self.known) > CACHE_WORDS:
                self.older, self.known = self.known, {}
            yield self._encode_slice(texts.slice(at, end - at))
            at = end

    def _encode_slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " \n "), " ")
        ends = parts.offsets.to_numpy()[1:] - parts.offsets[0].as_py()
        numbered = parts.flatten().dictionary_encode()
        code, words = numbered.indices.to_numpy(zero_copy_only=False), numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        letters = pc.utf8_is_alpha(numbered.dictionary).to_numpy(zero_copy_only=False)
        starts = np.append(0, ends[:-1])
        bare = np.zeros(len(code) + 1, bool)  # parts without a space before them: line breaks, and what follows these or begins a text
        if "\n" in words:
            breaks = code == words.index("\n")
            bare[:-1] = breaks
            bare[1:] |= breaks
        bare[starts] = True
        code = 2 * code + ~bare[:-1]
        used = np.flatnonzero(np.bincount(code, minlength=2 * len(words)))
        keys = [" " + words[u >> 1] if u & 1 else words[u >> 1] for u in used.tolist()]
        found = list(map(self.known.get, keys))
        if missing := [i for i, f in enumerate(found) if f is None and keys[i] not in self.known]:
            self._learn_parts([keys[i] for i in missing], letters[used[missing] >> 1].tolist())
            for i in missing:
                found[i] = self.known[keys[i]]
        # an empty part: more than one blank at a place; None: other white space, or a special token
        odd = np.zeros(len(keys), bool)
        for i in [i for i, f in enumerate(found) if not f]:
            found[i], odd[i] = b"", True
        if "" in words:
            for i in np.flatnonzero(used >> 1 == words.index("")).tolist():
                found[i], odd[i] = b"", True
        n = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        ids = np.frombuffer(b"".join(found), "<u4")
        at = np.full(2 * len(words), -1)
        at[used] = np.arange(len(used))
        code = at[code]
        counts = n[code]
        total = np.cumsum(counts)
        before = total - counts
        out = ids[np.repeat((np.cumsum(n) - n)[code] - before, counts) + np.arange(total[-1] if len(total) else 0)]
        done = total[ends - 1] if len(ends) else np.zeros(0, np.int64)
        if not odd.any():
            return out, done
        strange = np.unique(np.searchsorted(ends, np.flatnonzero(odd[code]), "right"))
        rows = np.split(out, done[:-1])
        for r in strange.tolist():
            rows[r] = np.frombuffer(self.encode_text(texts[r].as_py()), "<u4")
        return np.concatenate(rows), np.cumsum([len(r) for r in rows])

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        for ids, ends in self.encode_column(pa.array(texts, pa.string())):
            data = ids.tobytes()
            for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
                yield data[4 * a : 4 * b]

    def decode(self, ids: bytes) -> str:
        """Text of ids given as little-endian unsigned 32-bit integers; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_codecs: dict[str, BytePairCodec] = {}


def codec(path: str) -> BytePairCodec:
    """One codec a worker and vocabulary."""
    if path not in _codecs:
        _codecs[path] = BytePairCodec(path)
    return _codecs[path]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``doc_id, ids array<int>`` for every row (one output row per input row, repeated rows too)."""
    path = tokenizer or default_tokenizer()
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            at = 0
            for ids, ends in codec(path).encode_column(b.column(1)):
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(ends)), lists], ["doc_id", "ids"])
                at += len(ends)

    return docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, ids array<int>")


def decode(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """``doc_id, text`` from ids; null ids give the empty text."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        for b in batches:
            texts = [codec(path).decode(np.array(x or [], "<u4").tobytes()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {dict(rows.dtypes)[id_col]}, text string")


def roundtrip_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Encode, decode the ids again, and return per row ``doc_id, n_tokens, ids_sha256, decoded_sha256``
    without moving ids or texts between stages."""
    path = tokenizer or default_tokenizer()
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            own, n, ids_sha, text_sha = codec(path), [], [], []
            for ids in (data[4 * i : 4 * j] for all_ids, ends in own.encode_column(b.column(1)) for data in [memoryview(all_ids.tobytes())] for i, j in zip([0, *ends[:-1].tolist()], ends.tolist())):
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"doc_id {dict(docs.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, schema)
