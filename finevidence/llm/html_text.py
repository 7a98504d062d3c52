"""Main text of HTML pages: a linear-chain conditional random field over the leaf blocks of a page's tree.

A page is read as browsers do where it matters here: raw elements, implied end tags, comments, unclosed and stray tags.
A leaf block is the text between two starts or ends of block elements; character references are decoded and white space
(Unicode's) in a block becomes one space, as do line breaks. Each block has two states, main text or not. Features are the
tags and the words of class, id and role of its ancestors, its nearest sectioning elements and its own element, and its text's
length, share of links, ends, digits and likeness to the title. Weights are learned on labelled pages (``labelled_pages``; a
bounded set of one's own can be given) by gradients from forward-backward marginals; pages are decoded by Viterbi.
Blocks tagged as main text are joined in page order by an empty line.

Null and empty pages have the empty text; repeated rows and null ids or addresses each keep their row. Nothing is cut: the
reader takes time in proportion to a page's length, however deep its elements are nested.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from finevidence.llm.common import small_batches, whole_text
from finevidence.llm.labelled_pages import labelled_pages
from finevidence.llm.toxicity import Chain

_TOKEN = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>|[!?/][^>]*+>)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_TOLD = re.compile("class|id|role|hidden|data-main", re.I)
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp template svg math".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li "
    "main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
_SECTION = frozenset("article aside body dialog fieldset figure footer form header main nav section td".split())
#: Elements whose start ends an open p, and where the search for an open p stops.
_ENDS_P = _BLOCK - frozenset("body button caption dd dt head html label legend optgroup option select tbody td tfoot th thead tr".split()) | {"dd", "dt"}
_P_SCOPE = ("table", "td", "th", "caption", "button")
#: Start of an element: elements that it ends, unless one of the others was opened since.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)), "optgroup": (("option", "optgroup"), ("select",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)), "tbody": (("thead", "tbody", "tfoot"), ("table",)), "tfoot": (("thead", "tbody"), ("table",)),
}
_LENGTHS = (1, 2, 3, 5, 8, 13, 21, 40, 80)
#: Entries of the tables of known element contexts and attributes of a worker; they are emptied beyond it.
KNOWN = 20_000


class Context:
    """What an element's blocks inherit: features of the ancestors, the two nearest sectioning elements, the label."""

    __slots__ = ("features", "main", "near", "score", "under")

    def __init__(self, features: frozenset, near: tuple[str, str], main: bool):
        self.features, self.near, self.main = features, near, main
        self.under: dict = {}
        self.score: float | None = None


class Reader:
    """Pages to leaf blocks. ``known``: the features that matter (all, if None)."""

    def __init__(self, known: dict[str, float] | None = None):
        self.known = known
        self.attributes: dict[str, tuple[tuple[str, ...], bool]] = {}
        self.contexts = 0
        self.root = Context(frozenset(), ("", ""), False)

    def _attributes(self, text: str) -> tuple[tuple[str, ...], bool]:
        """Words of class, id and role; whether the label is there."""
        if (found := self.attributes.get(text)) is None:
            words, main = {}, False
            for m in _ATTRIBUTE.finditer(text):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                main |= name == "data-main"
                if name in ("hidden", "aria-hidden") and value.lower() != "false":
                    words["hidden"] = 1
                elif name in ("class", "id", "role"):
                    words |= {w.lower().rstrip("s"): 1 for w in _NAME_WORD.findall(value)}
            if len(self.attributes) > KNOWN:
                self.attributes.clear()
            found = self.attributes[text] = tuple(sorted(words)), main
        return found

    def _child(self, parent: Context, tag: str, text: str) -> Context:
        names, main = self._attributes(text) if _TOLD.search(text) else ((), False)
        key = tag, names, main
        if (found := parent.under.get(key)) is None:
            own = [f"name:{w}" for w in names] + ([f"in:{tag}"] if tag in _BLOCK else [])
            if self.known is not None:
                own = [f for f in own if f in self.known]
            near = (tag, parent.near[0]) if tag in _SECTION else parent.near
            self.contexts += 1
            found = parent.under[key] = Context(parent.features.union(own), near, main or parent.main)
        return found

    def read(self, page: str) -> tuple[str, list[tuple[str, Context, str, float]]]:
        """The title; (text, context, own block element, share of links) of each leaf block."""
        if self.contexts > KNOWN:
            self.contexts, self.root = 0, Context(frozenset(), ("", ""), False)
        stack: list[tuple[str, Context]] = [("", self.root)]
        at: dict[str, list[int]] = {}  # places of the open elements by tag
        block_at = [0]  # and of the open block elements
        blocks: list[tuple[str, Context, str, float]] = []
        pieces: list[str] = []
        linked = 0
        title, context, pos, last = "", None, 0, page.rfind(">") + 1

        def flush() -> None:
            nonlocal linked, context
            if pieces:
                text = " ".join("".join(pieces).split())
                if text:
                    blocks.append((text, context, stack[block_at[-1]][0], min(1.0, linked / len(text))))
                pieces.clear()
                linked, context = 0, None

        def add(raw: str) -> None:
            nonlocal linked, context
            text = entities.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if context is None or at.get("a"):
                if size := len(text.strip()):
                    if context is None:
                        context = stack[-1][1]
                    if at.get("a"):
                        linked += size

        def pop_to(place: int) -> None:
            while len(stack) > place:
                at[stack.pop()[0]].pop()
            while block_at[-1] >= place:
                block_at.pop()

        def latest(tags) -> int:
            return max((p[-1] for t in tags if (p := at.get(t))), default=0)

        while pos < last and (m := _TOKEN.search(page, pos, last)):
            if m.start() > pos:
                add(page[pos : m.start()])
            pos, tag = m.end(), m[2]
            if tag is None:
                if page.startswith("<!--", m.start()) and not page.endswith("-->", m.start(), pos):
                    pos = len(page)
                continue
            tag = tag.lower()
            block = tag in _BLOCK
            if block:
                flush()
            if m[1]:
                if (own := at.get(tag)) and (block or own[-1] > block_at[-1]):
                    pop_to(own[-1])
                continue
            if tag == "br":
                pieces.append(" ")
            if tag in _RAW and not m[3].endswith("/"):
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, pos)
                if tag == "title" and not title:
                    title = " ".join(entities.unescape(page[pos : end.start() if end else len(page)]).split())
                pos = end.end() if end else len(page)
            if tag in _VOID or tag in _RAW:
                continue
            if tag in _ENDS_P and (p := at.get("p")) and p[-1] > latest(_P_SCOPE):
                pop_to(p[-1])
            if tag in _ENDS:
                ended, scope = _ENDS[tag]
                if (place := latest(ended)) > latest(scope):
                    pop_to(place)
            if tag == "a" and (own := at.get("a")) and own[-1] > block_at[-1]:
                pop_to(own[-1])
            if block:
                block_at.append(len(stack))
            at.setdefault(tag, []).append(len(stack))
            stack.append((tag, self._child(stack[-1][1], tag, m[3])))
        if pos < len(page):
            add(page[pos:])
        flush()
        return title, blocks


def text_features(text: str, own: str, links: float, title: str, before: str, turn: int, left: int) -> list[str]:
    """Features of a block's own text and place; few distinct ones."""
    n = text.count(" ") + 1
    end = text[-1]
    out = [
        f"own:{own}", f"words:{sum(n > x for x in _LENGTHS)}", f"links:{0 if not links else 1 + int(links * 3)}", f"end:{'.' if end in '.?!' else ':' if end == ':' else 'a' if end.isalnum() else 'x'}",
        f"comma:{',' in text}", f"sign:{'©' in text or '·' in text or '|' in text}", f"digit:{any(c.isdigit() for c in text[:200])}", f"before:{before}>{own}", f"turn:{min(turn, 3)}", f"left:{min(left, 3)}",
    ]
    if title and (text == title or len(text) > 5 and (title.startswith(text) or text.startswith(title))):
        out.append("as title")
    return out


class BlockTagger:
    """Weights of the random field; state 1 is main text."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.start, self.trans = 0.0, np.zeros((2, 2))
        self.reader: Reader | None = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "reader"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.reader = None

    @staticmethod
    def block_features(title: str, blocks: list, i: int) -> list[str]:
        text, context, own, links = blocks[i]
        return text_features(text, own, links, title, blocks[i - 1][2] if i else "", i, len(blocks) - 1 - i)

    @staticmethod
    def near_features(context: Context) -> list[str]:
        return [f"near:{context.near[0]}", f"near:{context.near[0]}<{context.near[1]}"]

    def fit(self, pages: list[str], steps: int = 120, decay: float = 0.05) -> BlockTagger:
        """Learn from labelled pages; they are a bounded set, whole."""
        reader, number, owner, feature, tags, first = Reader(), {}, [], [], [], []
        for page in pages:
            title, blocks = reader.read(page)
            for i, b in enumerate(blocks):
                own = [*b[1].features, *self.near_features(b[1]), *self.block_features(title, blocks, i)]
                owner += [len(tags)] * len(own)
                feature += [number.setdefault(f, len(number)) for f in own]
                tags.append(b[1].main)
                first.append(i == 0)
        if not tags:
            return self
        owner, feature, tags, first = np.array(owner), np.array(feature), np.array(tags, float), np.array(first)
        real, n = np.bincount(feature, tags[owner], len(number)), len(tags)
        inner, t = ~first[1:], tags.astype(int)
        seen = np.bincount(2 * t[:-1][inner] + t[1:][inner], minlength=4).reshape(2, 2).astype(float)
        w, squares = np.zeros(len(number)), np.full(len(number), 1e-3)
        for _ in range(steps):
            odds = np.exp(np.clip(np.bincount(owner, w[feature], n), -30, 30))
            p, moves = Chain(self.start, self.trans).pair_marginals(odds, first) if n > 1 else (odds / (1 + odds), np.zeros((2, 2)))
            g = real - np.bincount(feature, p[owner], len(number)) - decay * w
            squares += g * g
            w += g / np.sqrt(squares)
            self.trans = self.trans + 0.3 * np.clip(np.log((seen + 0.5) / (moves + 0.5)), -0.5, 0.5)
            self.trans -= self.trans[0, 0]
            self.start += 0.3 * float(np.clip(np.log((tags[first].sum() + 0.5) / (p[first].sum() + 0.5)), -0.5, 0.5))
        self.weights = dict(zip(number, w.tolist()))
        return self

    def emissions(self, title: str, blocks: list) -> list[float]:
        """Log odds of main text of each block by itself."""
        w, out = self.weights.get, []
        for i, (_, context, _, _) in enumerate(blocks):
            if context.score is None:
                context.score = sum(w(f, 0.0) for f in context.features) + sum(w(f, 0.0) for f in self.near_features(context))
            out.append(context.score + sum([w(f, 0.0) for f in self.block_features(title, blocks, i)]))
        return out

    def viterbi(self, e: list[float]) -> list[int]:
        """The likeliest states of one page's blocks."""
        (_, t01), (t10, t11) = self.trans.tolist()
        back, a, b = [], 0.0, 0.0  # best score of a path that ends in state 0 or 1
        for i, x in enumerate(e):
            if not i:
                b = x + self.start
                continue
            from0, from1 = b + t10 > a, b + t11 > a + t01
            a, b = (b + t10 if from0 else a), (b + t11 if from1 else a + t01) + x
            back.append((from0, from1))
        state = int(b > a)
        out = [state] if e else []
        for pair in reversed(back):
            state = int(pair[state])
            out.append(state)
        return out[::-1]

    def blocks(self, page: str) -> list[tuple[str, int]]:
        """Leaf blocks and their states."""
        if self.reader is None:
            self.reader = Reader(self.weights)
        title, found = self.reader.read(page)
        return [(b[0], s) for b, s in zip(found, self.viterbi(self.emissions(title, found)))]

    def text(self, page: str) -> str:
        return "\n\n".join(t for t, s in self.blocks(page) if s)


def train(pages: list[str] | None = None) -> BlockTagger:
    """A tagger fitted on labelled pages; by default on the bounded set that ``labelled_pages`` writes."""
    return BlockTagger().fit(labelled_pages() if pages is None else pages)


def extract(pages: DataFrame, tagger: BlockTagger | None = None, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep``, ``text`` and ``n_chars`` of every row."""
    small_batches(pages.sparkSession, 500)
    sent = pages.sparkSession.sparkContext.broadcast(tagger or train())

    def run(batches):
        tagger = sent.value
        for b in batches:
            texts = [tagger.text(x.as_py()) for x in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    rows = pages.select(*keep, whole_text(html_col).alias("_html"))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{kinds}, text string, n_chars long")
