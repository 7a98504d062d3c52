"""Text column functions and the word-packing UDF."""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spanish stop words, without accents.
STOP_WORDS = (
    "a al algo ante como con cual cuando de del desde donde el ella ellas ello ellos en entre era es esa esas ese eso esos esta "
    "estas este esto estos fue ha han hay la las le les lo los mas me mi muy ni no nos o para pero por que se si sin sobre son "
    "su sus te tu un una uno unos y ya"
).split()
CHUNK_CHARS, OVERLAP_CHARS, PAGE_BUDGET = 1000, 150, 300_000


@functools.cache
def plain_forms() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility decomposition (NFKD) without marks is one other character, those characters in
    the same order, and the decompositions of several characters. Hangul syllables stay whole."""
    one, several = {}, {}
    for c in map(chr, range(0x80, 0x110000)):
        if unicodedata.decomposition(c) and not "가" <= c <= "힣":
            d = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
            if d != c:
                (one if len(d) == 1 else several)[c] = d
    return "".join(one), "".join(one.values()), {c: d for c, d in several.items() if d}


def is_ascii(c: Column | str) -> Column:
    """Whether a text has as many bytes as characters."""
    return F.octet_length(c) == F.char_length(c)


def fold(c: Column | str) -> Column:
    """Lower case, every character in its plain compatibility form (ligatures and digits too), no combining marks."""
    return F.when(is_ascii(c), F.lower(c)).otherwise(_fold_any(c))


def _fold_any(c: Column | str) -> Column:
    one, plain, several = plain_forms()
    low = F.lower(c)
    # one string that Spark folds to one literal: a literal a character makes plans slow to optimise
    forms = F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in several.items())), F.lit("\x02"), F.lit("\x01"))
    met = F.array_intersect(F.split(low, ""), F.map_keys(forms))
    # most texts hold no character of the ranges in which all of these are
    whole = F.when(low.rlike(r"[\x{A8}-\x{BE}\x{132}-\x{10FFFF}]"), F.aggregate(met, low, lambda t, x: F.replace(t, x, forms[x]))).otherwise(low)
    return F.regexp_replace(F.translate(whole, one, plain), r"\p{M}", "")


def one_line(c: Column | str) -> Column:
    """All runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def visible(c: Column | str) -> Column:
    """Folded, format characters dropped, every kind of space plain, runs of spaces as one. ASCII has one space and no marks."""
    whole = F.regexp_replace(_fold_any(F.regexp_replace(F.regexp_replace(c, r"\p{Cf}", ""), r"\p{Zs}", " ")), r"(?U)\s+", " ")
    return F.when(is_ascii(c), F.regexp_replace(F.lower(c), r"[\t-\r][\t-\r ]*| [\t-\r ]+", " ")).otherwise(whole)


def sentences(c: Column | str) -> Column:
    """Sentences, blank ones dropped; a line break also ends one."""
    return F.filter(F.split(c, r"(?<=[.!?;])\s+|\n+"), lambda s: F.trim(s) != "")


def words(c: Column | str) -> Column:
    """Folded words of two characters or more, without stop words."""
    return F.filter(F.regexp_extract_all(fold(c), F.lit(r"(?U)\b\w\w+\b"), F.lit(0)), lambda w: ~w.isin(STOP_WORDS))


def terms(w: Column) -> Column:
    """Words, then pairs of neighbouring words; of a column of ``words``."""
    pairs = F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(w, pairs)


def token_estimate(c: Column | str) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("bigint")


def content_key(*parts: Column | str) -> Column:
    """SHA-256 of all parts, each after its length, so parts can't run into each other; null counts as empty."""
    sized = []
    for p in parts:
        b = F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")).cast("binary")
        sized += [F.unhex(F.lpad(F.hex(F.octet_length(b).cast("bigint")), 16, "0")), b]
    return F.sha2(F.concat(*sized), 256)


def shorten(c: Column, width: int) -> Column:
    return F.when(F.length(c) > width, F.concat(F.rtrim(F.left(c, F.lit(width - 1))), F.lit("…"))).otherwise(c)


def pack_words(text: str, most: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[str]:
    """Chunks of whole words up to ``most`` characters; each begins with the last words of the one before
    that fit ``overlap``. A longer word stands alone."""
    out: list[str] = []
    held: list[str] = []
    size = fresh = 0  # characters with a space each; words not yet in a chunk
    for w in text.split():
        if held and fresh and size + len(w) > most:
            out.append(" ".join(held))
            tail, room = [], overlap
            for x in reversed(held):
                room -= len(x) + 1
                if room < 0:
                    break
                tail.append(x)
            held = tail[::-1]
            size, fresh = sum(len(x) + 1 for x in held), 0
            if size + len(w) > most:
                held, size = [], 0
        held.append(w)
        size += len(w) + 1
        fresh += 1
    return [*out, " ".join(held)] if fresh else out


@F.pandas_udf(T.ArrayType(T.StringType()))
def chunk_texts(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: pack_words(t or ""))


def half_away(v: Column, places: int) -> Column:
    """A double rounded in double arithmetic, as SQL engines do: halves of ``v * 10^places`` go away from zero, and what rounds to
    zero keeps its sign. (Spark's ``round`` takes the decimals that a double prints as, so it moves other halves, and knows no -0.)"""
    scale = F.lit(10.0**places)
    size = F.abs(v * scale)
    whole = F.floor(size)
    up = F.when(size - whole >= 0.5, 1).otherwise(0)
    return F.when(size < 2.0**52, F.signum(v) * (whole + up) / scale).otherwise(v)  # larger ones have no fraction


def number_text(v: Column, decimals: int = 2) -> Column:
    """With separators of thousands; ``n/a`` for null."""
    return F.coalesce(F.format_number(v, decimals), F.lit("n/a"))


def percent_text(v: Column) -> Column:
    """A share as a percentage of two decimals; ``n/a`` for null."""
    return F.coalesce(F.concat(F.format_number(v * 100, 2), F.lit("%")), F.lit("n/a"))


def price_text(v: Column) -> Column:
    """Decimals by size: none from 1000 on, two from 1 on, else four; ``n/a`` for null."""
    size = F.abs(v)
    last = F.when((size >= 0.00005) & (size < 0.0001), F.signum(v) * 0.0001).otherwise(v)  # the formatter takes the double 0.00005 for a half
    return F.coalesce(F.when(size >= 1000, F.format_number(v, 0)).when(size >= 1, F.format_number(v, 2)).otherwise(F.format_number(last, 4)), F.lit("n/a"))
