"""Personal data: base patterns, and information-theoretic sanitisation of the terms around them.

The base patterns find emails, IP addresses, card and phone numbers. Each distinct value is a protected
entity. The other words of a document with the entity, short ones and numbers too, are terms that might
reveal it. Over the corpus

    disclosure(t; e) = log(N n(t, e) / (n(t) n(e))) / log(N / n(e))

is the share of the entity's information that the term gives away: 1 if the term stands only where the
entity does. n(t, e) counts the documents with both, at any distance, n(t) and n(e) all documents
with the term or the entity, N all documents. At all their places in all documents, terms that reach
``generalise`` for some entity are replaced by their kind, those that reach ``remove`` are removed, if the two
stand together in at least ``support`` documents (a pair seen once tells nothing about either).

n(t) needs all words of the corpus, but only for terms that might disclose: n(t) is at least n_any(t), the number of
documents with the term and any base match. As n(t, e) is at most n(e) and n_any(t), an entity can be disclosed only by terms with
n_any(t) up to max(n(e), N^(1 - generalise) n(e)^generalise), so a document pairs its entities with such terms alone. Tables of
fixed size of the hashes of terms and entities keep the rest of the corpus out of the shuffle; they err on the safe side, and exact
counts decide. A word's lower case is that of the word alone, wherever words are compared.

A null text counts as empty. Rows with equal id and text get the same spans. Null ids are allowed, and
empty tables give empty results. Base spans never change or go; terms never overlap them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finevidence.llm.common import join_groups, materialise, release, small_batches, whole_text

KINDS = ["email", "ip", "card", "phone"]
#: Bits of the terms' bitmap; it fills up as terms grow, and then only lets more words through.
BITS = 1 << 23

# Each pattern matches what the contract's does, in linear time: a run is entered at its start only.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"\w+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: the local part is all of the run before the at sign that no match has taken."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        if m := _DOMAIN.match(text, at):
            start = at
            while start > free and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < at:
                out.append((start, m.end()))
                free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of all base matches, by start, then kind."""
    out = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                    out.append((m.start(), m.end(), 3))
    return sorted(set(out), key=lambda s: (s[0], s[2]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def terms_outside(text: str, spans: list[tuple[int, int, int]]):
    """(term, start, end) for the words of the whole text that overlap no span; ``spans`` by start."""
    i, covered = 0, -1
    for m in _WORD.finditer(text):
        s, e = m.span()
        while i < len(spans) and spans[i][0] < e:
            covered = max(covered, spans[i][1])
            i += 1
        if covered <= s:
            yield m.group().lower(), s, e


def entities_of(text: str, spans: list[tuple[int, int, int]]) -> set[str]:
    return {f"{KINDS[k]}:{text[a:b].lower()}" for a, b, k in spans}


def _rows(docs: DataFrame, id_col: str, text_col: str):
    """Id, the key that stands for the row in joins (id as text, null as the empty text, and a hash of the text), text."""
    text = whole_text(text_col)
    return [F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id_key"), F.xxhash64(text).alias("version"), text.alias("text")]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, id_key, version, base array<struct<start, end, kind>>, entities array<string>`` for every row;
    entities are distinct."""
    small_batches(docs.sparkSession)
    base_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches):
        for b in batches:
            base, entities = [], []
            for text in b.column(3).to_pylist():
                spans = base_spans(text)
                base.append([{"start": s, "end": e, "kind": KINDS[k]} for s, e, k in spans])
                entities.append(sorted(entities_of(text, spans)))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(base, base_type), pa.array(entities, pa.list_(pa.string()))], ["doc_id", "id_key", "version", "base", "entities"])

    schema = f"doc_id {dict(docs.dtypes)[id_col]}, id_key string, version long, base array<struct<start:int,end:int,kind:string>>, entities array<string>"
    return docs.select(*_rows(docs, id_col, text_col)).mapInArrow(run, schema)


def bitmap(terms: DataFrame) -> np.ndarray:
    """Bits of crc32(term) modulo BITS for all rows of ``terms``: BITS / 8 bytes at most reach the driver."""
    bit = F.pmod(F.crc32(F.encode("term", "utf-8")), F.lit(BITS)).cast("long")
    parts = terms.select(bit.alias("bit")).groupBy(F.shiftright("bit", 15).alias("part")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position((bit % 32768) + 1))").alias("bits")).collect()
    out = np.zeros(BITS // 32768 * 4096, np.uint8)
    for r in parts:
        out[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _bits(terms: DataFrame):
    return terms.sparkSession.sparkContext.broadcast(np.unpackbits(bitmap(terms), bitorder="little").astype(bool))


def level(n):
    """ceil(log4(n)) of a column of counts, 15 at most; ranges of counts with a bitmap each."""
    return F.least(F.lit(15), F.greatest(F.lit(0), F.ceil(F.log(F.greatest(n, F.lit(1.0))) / F.log(F.lit(4.0)) - 1e-9))).cast("int")


def _levels(rows: DataFrame, highest: bool) -> np.ndarray:
    """The highest or lowest ``level`` of ``rows`` (term, level) with each value of crc32(term) modulo BITS; -1 or 16
    where there is none. 16 bitmaps at most reach the driver."""
    bit = F.pmod(F.crc32(F.encode("term", "utf-8")), F.lit(BITS)).cast("long")
    parts = rows.select(bit.alias("bit"), "level").groupBy("level", F.shiftright("bit", 15).alias("part")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position((bit % 32768) + 1))").alias("bits")).collect()
    out = np.full(BITS, -1 if highest else 16, np.int8)
    for r in sorted(parts, key=lambda r: r["level"] if highest else -r["level"]):
        at = np.flatnonzero(np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")) + r["part"] * 32768
        out[at] = r["level"]
    return out


def any_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``term, n_any``: documents with the term and any base match, over whole texts."""
    small_batches(docs.sparkSession)

    def run(batches):
        counts = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])
        for b in batches:
            for text in b.column(0).to_pylist():
                if spans := base_spans(text):
                    counts.update({t for t, _, _ in terms_outside(text, spans)})
                    if len(counts) > 300_000:
                        yield flush()
                        counts.clear()
        yield flush()

    partial = docs.select(whole_text(text_col).alias("text")).mapInArrow(run, "term string, n long")
    return partial.groupBy("term").agg(F.sum("n").alias("n_any"))


def pair_counts(docs: DataFrame, entities: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """``entity, term, n_both`` over whole texts for ``entities`` (entity, most) and ``terms`` (term, n_any) with n_any up to
    the level of the entity's ``most``."""
    small_batches(docs.sparkSession)
    reach = _levels(entities.select(F.col("entity").alias("term"), level(F.col("most")).alias("level")), highest=True)
    rare = _levels(terms.select("term", level(F.col("n_any")).alias("level")), highest=False)
    sent = docs.sparkSession.sparkContext.broadcast((reach, rare))

    def run(batches):
        (reach, rare), counts = sent.value, Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array([e for e, _ in counts], pa.string()), pa.array([t for _, t in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["entity", "term", "n"])
        for b in batches:
            for text in b.column(0).to_pylist():
                spans = base_spans(text)
                own = [(e, at) for e in entities_of(text, spans) if (at := int(reach[zlib.crc32(e.encode()) % BITS])) >= 0] if spans else []
                if not own:
                    continue
                by_level = [[] for _ in range(17)]
                for t in {t for t, _, _ in terms_outside(text, spans)}:
                    by_level[rare[zlib.crc32(t.encode()) % BITS]].append(t)
                for e, at in own:
                    for some in by_level[: at + 1]:
                        counts.update((e, t) for t in some)
                    if len(counts) > 200_000:
                        yield flush()
                        counts.clear()
        yield flush()

    partial = docs.select(whole_text(text_col).alias("text")).mapInArrow(run, "entity string, term string, n long")
    return partial.groupBy("entity", "term").agg(F.sum("n").alias("n_both")).join(entities.select("entity"), "entity", "left_semi")


def _disclosure(n: int, n_both: str, n_term: str, n_entity: str):
    gain = F.log(F.lit(float(max(1, n))) * F.col(n_both) / (F.col(n_term) * F.col(n_entity)))
    known = F.log(F.lit(float(max(1, n))) / F.col(n_entity))
    return F.when(known > 0, gain / known).otherwise(0.0)


def candidate_pairs(docs: DataFrame, found: DataFrame, least: float, support: int = 3, text_col: str = "text") -> tuple[DataFrame, int]:
    """``entity, term, n_both, n_entity`` for pairs that stand together in at least ``support`` documents and whose
    disclosure might be ``least``; and the number of documents."""
    counted = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    n = found.count()
    most = F.greatest(F.col("n_entity").cast("double"), F.pow(F.lit(float(max(1, n))), F.lit(1 - least)) * F.pow(F.col("n_entity"), F.lit(least)))
    entities = materialise(counted.where(F.col("n_entity") >= support).withColumn("most", most * (1 + 1e-9)))  # others can't reach it with any term
    terms = materialise(any_counts(docs, text_col).where(F.col("n_any") >= support))
    pairs = materialise(pair_counts(docs, entities, terms, text_col).where(F.col("n_both") >= support))
    total = pairs.count()
    per_term = pairs.groupBy("term").agg(F.count("*").alias("size")).join(terms, "term")
    both = join_groups(pairs, per_term, ["term"], "size", total, ["entity"]).drop("size")
    per_entity = pairs.groupBy("entity").agg(F.count("*").alias("size")).join(entities, "entity")
    both = join_groups(both, per_entity, ["entity"], "size", total, ["term"])
    out = materialise(both.where(_disclosure(n, "n_both", "n_any", "n_entity") >= least - 1e-9).select("entity", "term", "n_both", "n_entity"))
    release(entities, terms, pairs)
    return out, n


def document_frequencies(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """``term, n_docs`` over all rows of ``docs`` for the terms in ``terms``."""
    small_batches(docs.sparkSession)
    bits = _bits(terms)

    def run(batches):
        set_, known, counts = bits.value, {}, Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])
        for b in batches:
            for text in b.column(0).to_pylist():
                counts.update(marked_words(text, known, set_))
            if len(counts) > 300_000:
                yield flush()
                counts.clear()
        yield flush()

    partial = docs.select(whole_text(text_col).alias("text")).mapInArrow(run, "term string, n long")
    return partial.groupBy("term").agg(F.sum("n").alias("n_docs")).join(terms, "term", "left_semi")


def marked_words(text: str, known: dict[str, bool], bits: np.ndarray) -> list[str]:
    """The different words of a text whose bits are set; ``known`` keeps what was looked up."""
    words = {w.lower() for w in set(_WORD.findall(text))}
    if len(known) > 300_000:
        known.clear()
    known.update((w, bool(bits[zlib.crc32(w.encode()) % BITS])) for w in words.difference(known))
    return list(filter(known.__getitem__, words))


def term_places(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_key, version, term, start, end`` for the places of ``terms`` outside base spans, and of the few others
    that their bitmap doesn't tell from them."""
    bits = _bits(terms)

    def run(batches):
        set_, known = bits.value, {}
        for b in batches:
            rows: list[tuple] = []
            for key, version, text in zip(*(c.to_pylist() for c in b.columns)):
                if marked_words(text, known, set_):
                    rows += [(key, version, *x) for x in terms_outside(text, base_spans(text)) if set_[zlib.crc32(x[0].encode()) % BITS]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32()))], ["id_key", "version", "term", "start", "end"])

    return docs.select(*_rows(docs, id_col, text_col)[1:]).mapInArrow(run, "id_key string, version long, term string, start int, end int")


def term_spans(docs: DataFrame, found: DataFrame, generalise: float = 0.9, support: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_key, version, terms array<struct<start, end, disclosure>>`` for each distinct (id, text) with any."""
    pairs, n = candidate_pairs(docs, found, generalise, support, text_col)
    frequencies = materialise(document_frequencies(docs, pairs.select("term").distinct(), text_col))
    per_term = pairs.groupBy("term").agg(F.count("*").alias("size")).join(frequencies, "term")
    judged = join_groups(pairs, per_term, ["term"], "size", pairs.count(), ["entity"]).withColumn("disclosure", _disclosure(n, "n_both", "n_docs", "n_entity"))
    strong = materialise(judged.where(F.col("disclosure") >= generalise).groupBy("term").agg(F.max("disclosure").alias("disclosure")))
    places = materialise(term_places(docs, strong, id_col, text_col))
    per_term = strong.join(places.groupBy("term").agg(F.count("*").alias("places")), "term")
    hits = join_groups(places, per_term, ["term"], "places", places.count(), ["id_key", "version"])
    return hits.groupBy("id_key", "version").agg(F.sort_array(F.collect_set(F.struct("start", "end", "disclosure"))).alias("terms"))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise: float = 0.9, support: int = 3) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for every row."""
    found = materialise(find(docs, id_col, text_col))
    terms = term_spans(docs, found, generalise, support, id_col, text_col)
    both = found.drop("entities").join(terms, ["id_key", "version"], "left")
    as_text = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    in_order = lambda a: F.transform(F.array_sort(F.transform(a, lambda x: F.struct(x["start"], F.array_position(F.array(*map(F.lit, [*KINDS, "term"])), x["kind"]).alias("o"), x["end"], x["kind"]))), as_text)
    every = F.concat("base", F.coalesce(F.transform("terms", lambda x: F.struct(x["start"], x["end"], F.lit("term").alias("kind"))), F.array().cast("array<struct<start:int,end:int,kind:string>>")))
    count_of = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return both.select(
        "doc_id",
        *(count_of(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(F.array_join(in_order(F.col("base")), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(in_order(every), ",").alias("spans"),
    )


def redact(text: str, terms: list[dict], remove: float) -> str:
    """Base spans become their kind in brackets; terms are generalised to [TERM] or removed. Of spans
    that overlap, the whole stretch takes the first one's mark."""
    spans = [(a, b, f"[{KINDS[k].upper()}]") for a, b, k in base_spans(text)]
    spans += [(t["start"], t["end"], "" if t["disclosure"] >= remove else "[TERM]") for t in terms]
    out, at = [], 0
    for a, b, mark in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise: float = 0.9, remove: float = 0.97, support: int = 3) -> DataFrame:
    """``docs`` with personal data and disclosing terms taken out of ``text_col``; other columns stay as they are."""
    small_batches(docs.sparkSession)
    terms = term_spans(docs, materialise(find(docs, id_col, text_col)), generalise, support, id_col, text_col)
    rest = [c for c in docs.columns if c != text_col]
    own = docs.select(F.struct(*rest).alias("rest"), *_rows(docs, id_col, text_col)[1:])
    both = own.join(terms.hint("shuffle_hash"), ["id_key", "version"], "left").select("rest", "text", "terms")

    def run(batches):
        for b in batches:
            texts = [redact(t, x or [], remove) for t, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["rest", "text"])

    out = both.mapInArrow(run, f"rest {dict(own.dtypes)['rest']}, text string")
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in docs.columns))
