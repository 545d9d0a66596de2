"""Operator 9, main text of HTML pages by a tree-structured graphical model.

A page is read into a tree of its block elements, with a leaf for every run of
text between block boundaries. Each node is mixed, content or boilerplate.
Node potentials come from the words of class, id and role, and for leaves from
length, link share and punctuation; edge potentials link the states of parent
and child, by the child's tag. Both are fitted on labelled
pages (``html_pages``). Sum-product messages go from the leaves to the root and
back, and a leaf is kept if its marginal says content. Levels of many pages are
passed together in numpy.

Defined results: null or empty html gives an empty text; broken markup is read
as browsers do in the common cases (missing end tags, unquoted attributes,
pages cut short); scripts, styles and comments never give text; character
references are decoded; pages of any length are read whole, in time that grows
with their length; elements that are not known as blocks are inline, and their
text is kept (math, svg, object and iframe too); a tag that the page's end cuts
off is dropped; repeated rows give equal results; an empty table gives an empty
result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map
from .html_pages import labelled_pages

MIXED, CONTENT, OTHER = 0, 1, 2
STATES = {"m": MIXED, "c": CONTENT, "b": OTHER}
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
TURN = re.compile(r"""["'>]""")
COMMENT_END = re.compile(r"--!?>")
ATTRIBUTE = re.compile(r"""(?<![^\s=/"'>])([^\s=/"'>]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]++))""")
WORD = re.compile(r"[a-z]+")
#: Fixed values of HTML: elements without content, with raw text, and blocks (what isn't one of these is inline).
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style template".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html input ins label legend li link listing main menu meta nav noscript ol optgroup option p plaintext pre search section select summary table tbody td textarea tfoot th thead title tr ul xmp".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "optgroup": {"select"}}
SENTENCE_END = (".", "!", "?", "…", '"', "”", ":", ";")


class Page:
    """Nodes of a page: parent (-1 for the root), kind, features, state (where labelled); leaves also have text."""

    __slots__ = ("features", "kind", "parent", "state", "text")

    def __init__(self):
        self.parent, self.kind, self.features, self.text, self.state = [-1], ["#root"], [()], [None], [MIXED]

    def add(self, parent: int, kind: str, features: tuple, text: str | None = None, state: int | None = None) -> int:
        for column, value in zip((self.parent, self.kind, self.features, self.text, self.state), (parent, kind, features, text, self.state[parent] if state is None else state), strict=True):
            column.append(value)
        return len(self.parent) - 1


def tag_end(source: str, at: int, dead: set[int]) -> int:
    """Where the ``>`` is that ends a tag whose attributes begin at ``at``, outside quotes; where quotes leave none, the next ``>``; -1 if there is none.
    ``dead``: places outside quotes from which no end was found, so that a page's quotes are followed once."""
    begin, seen = at, []
    while at not in dead and (m := TURN.search(source, at)):
        if m[0] == ">":
            return m.start()
        seen.append(at)
        close = source.find(m[0], m.end())
        if close < 0:
            break
        at = close + 1
    dead.update(seen)
    return source.find(">", begin)


def markup(source: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, lower-case name, whether it closes, attributes) of every tag; comments and the like have no name. What lies between is text."""
    dead: set[int] = set()
    at = 0
    while (start := source.find("<", at)) >= 0:
        closing = source.startswith("/", start + 1)
        name = NAME.match(source, start + 1 + closing)
        if name:
            end = tag_end(source, name.end(), dead)
            end = len(source) if end < 0 else end + 1
            cut_off = end == len(source) and source[-1] != ">"
            yield start, end, "" if cut_off else name[0].lower(), closing, source[name.end() : end - 1]
        elif source.startswith("<!--", start):
            m = COMMENT_END.search(source, start + 4)
            end = m.end() if m else len(source)
            yield start, end, "", False, ""
        elif source.startswith(("!", "?", "/"), start + 1):
            end = source.find(">", start)
            end = len(source) if end < 0 else end + 1
            yield start, end, "", False, ""
        else:
            at = start + 1
            continue
        at = end
        if name and not closing and name[0].lower() in RAW:
            m = re.compile(rf"</{name[0]}(?=[\s/>])", re.I).search(source, end)
            if not m:
                yield end, len(source), "", False, ""
                return
            yield end, m.start(), "", False, ""
            at = m.start()


def read(source: str) -> Page:
    page = Page()
    stack: list[tuple[str, int]] = [("#root", 0)]
    places: dict[str, list[int]] = defaultdict(list)  # where in the stack each tag is open
    run: list[str] = []
    linked, in_link = 0, 0

    def flush():
        nonlocal linked
        text = " ".join(entities.unescape("".join(run)).split()) if run else ""
        if text:
            words = text.count(" ") + 1
            share = linked / max(1, sum(map(len, run)))
            link = (share > 0.2) + (share > 0.7)
            page.add(stack[-1][1], "#text", (f"#len{min(3, (words > 2) + (words > 7) + (words > 19))}", f"#link{link}", f"#end{text.endswith(SENTENCE_END)}", f"#in-{stack[-1][0]}-link{link}"), text)
        run.clear()
        linked = 0

    def leave(depth: int):
        while len(stack) > depth:
            places[stack.pop()[0]].pop()

    def last(tags: Iterable[str]) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=0)

    at = 0
    for start, end, tag, closing, attributes in markup(source):
        if start > at:
            run.append(piece := source[at:start])
            linked += len(piece) if in_link else 0
        at = end
        if tag == "a":
            in_link = 0 if closing else 1
        if tag == "br":
            run.append(" ")
        if tag not in BLOCK:
            continue
        flush()
        in_link = 0
        if closing:
            if places[tag]:
                leave(places[tag][-1])
            continue
        if stack[-1][0] == "p":
            leave(len(stack) - 1)
        if tag in CLOSES and (own := last(CLOSES[tag])) > last(SCOPES[tag]):
            leave(own)
        found, state = [], None
        for name, a, b, c in ATTRIBUTE.findall(attributes) if attributes.strip() else ():
            if (name := name.lower()) in ("class", "id", "role"):
                found += {f".{w}" for w in WORD.findall((a or b or c).lower())}
            elif name == "y" and c in STATES:
                state = STATES[c]
        node = page.add(stack[-1][1], tag, tuple(found), None, state)
        if tag not in VOID:
            places[tag].append(len(stack))
            stack.append((tag, node))
    if at < len(source):
        run.append(source[at:])
        linked += len(source) - at if in_link else 0
    flush()
    return page


class Model:
    """Log potentials: of a feature per state, and of (parent's state, own state) per kind of child."""

    def __init__(self, pages: list[Page], smooth: float = 0.3):
        counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(3))
        edges: dict[str, np.ndarray] = defaultdict(lambda: np.zeros((3, 3)))
        totals: Counter = Counter()
        for page in pages:
            for parent, kind, features, state in zip(page.parent, page.kind, page.features, page.state, strict=True):
                if parent < 0:
                    continue
                leaf = kind == "#text"
                if leaf and state == MIXED:
                    state = OTHER
                edges[kind][page.state[parent], state] += 1
                if not leaf:
                    edges["<>"][page.state[parent], state] += 1
                totals[leaf, state] += 1
                for f in features:
                    counts[f][state] += 1
        self.feature = {}
        for f, n in counts.items():
            total = np.array([totals[f.startswith("#"), s] for s in range(3)], float)
            rate = (n + smooth) / (total + 2 * smooth)
            self.feature[f] = np.log(rate) - np.log((n.sum() + smooth) / (total.sum() + 2 * smooth))
        allowed = np.array([[1, 1, 1], [0.02, 1, 1], [1e-4, 1e-4, 1]])  # content seldom turns mixed, boilerplate stays so
        every = edges["<>"] + smooth * allowed
        every /= every.sum(1, keepdims=True)
        self.edge = {"<>": np.log(every)}
        for kind, n in edges.items():
            if kind == "#text":
                p = n + smooth * allowed
                p[:, MIXED] = 1e-9
            else:  # a tag's own counts, with the general rates as one more observation
                p = n + every
            self.edge[kind] = np.log(p / p.sum(1, keepdims=True))

    def potentials(self, page: Page) -> list[np.ndarray]:
        zero, out = np.zeros(3), []
        for features in page.features:
            total = zero
            for f in features:
                if (v := self.feature.get(f)) is not None:
                    total = total + v
            out.append(total)
        return out


def marginals(model: Model, pages: list[Page]) -> np.ndarray:
    """State probabilities of all nodes of the pages, in order, by one upward and one downward pass."""
    sizes = [len(p.parent) for p in pages]
    first = np.repeat(np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
    parent = np.array([x for p in pages for x in p.parent])
    root = parent < 0
    parent = np.where(root, 0, parent + first)
    own = np.array([v for p in pages for v in model.potentials(p)])
    own[root] = np.array([0, -1e9, -1e9])
    depth = np.zeros(len(parent), int)
    for i in range(len(parent)):  # parents come before children
        if not root[i]:
            depth[i] = depth[parent[i]] + 1
    general = model.edge["<>"]
    edge = np.array([model.edge.get(k, general) for p in pages for k in p.kind])
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)

    def log_sum(x, axis):
        top = x.max(axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))

    up, message = own.copy(), np.zeros_like(own)
    for level in levels[:0:-1]:
        message[level] = log_sum(edge[level] + up[level][:, None, :], 2)
        np.add.at(up, parent[level], message[level])
    belief = up.copy()
    for level in levels[1:]:
        belief[level] += log_sum(edge[level] + (belief[parent[level]] - message[level])[:, :, None], 1)
    belief -= log_sum(belief, 1)[:, None]
    return np.exp(belief)


_MODEL: list[Model] = []


def trained() -> Model:
    if not _MODEL:
        _MODEL.append(Model([read(p) for p in labelled_pages()]))
    return _MODEL[0]


def extract(sources: list[str | None], model: Model) -> list[str]:
    pages = [read(s or "") for s in sources]
    p = marginals(model, pages)[:, CONTENT]
    out, at = [], 0
    for page in pages:
        own = p[at : at + len(page.parent)]
        at += len(page.parent)
        out.append("\n".join(t for t, q in zip(page.text, own.tolist(), strict=True) if t is not None and q >= 0.5))
    return out


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars of each page."""
    model = trained()
    named = [F.col(f"`{c}`") for c in (html_col, id_col, url_col)]
    schema = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType), T.StructField(url_col, pages.schema[url_col].dataType), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def kernel():
        def work(columns):
            sources, ids, urls = columns
            texts = [t for s in range(0, len(sources), 128) for t in extract(sources[s : s + 128], model)]
            return [ids, urls, texts, pa.array([len(t) for t in texts], pa.int64())], None

        return work

    return arrow_map(pages, named, schema, kernel)
