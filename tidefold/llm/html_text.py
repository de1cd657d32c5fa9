"""Main text of web pages by a tree-structured graphical model over the DOM.

Nodes are the block elements of a page and its blocks of text.  Each takes one of three states:
boilerplate, content, or (elements only) mixed, that is some of both below it.  A node's own
potential comes from its tag, the words in its class, id and role, its length of text and its
share of link text; a potential on every edge says how a child's state follows its parent's.
Both are estimated from labelled pages.  Sum-product messages go up and down the tree once,
which is exact on a tree, and give every block's marginal; blocks that are content with 0.5 or
more make up the text.

Defined results: null or empty html has empty text; broken markup is read as far as it goes (tags
left open end with their parent, a comment left open ends with the page); scripts, styles, frames
and templates are markup; all else that holds text is judged by the model; nothing is cut by
length; repeated rows get equal texts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from html import unescape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import map_arrow, row_slices

# Fixed values of HTML: elements without end tag; with raw text; what isn't shown; inside a line; what start tags close.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style iframe noembed noframes textarea title".split())
HIDDEN = frozenset("script style iframe noembed noframes template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr audio canvas object picture video".split())
FOREIGN = frozenset("svg math".split())
FOREIGN_HIDDEN = frozenset("title desc metadata annotation annotation-xml script style".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt td th tr".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
HOLDS = frozenset("ul ol dl table td th article section div body blockquote figure form main aside nav header footer".split())

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# A quote begins a quoted value only as its first character; one that nothing closes is part of an unquoted value.
VALUE = r"(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+)"
MARKUP = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]*+[^\s/>][^\s/>=]*+(?:\s*+=\s*+{VALUE})?+)*+)([\s/]*+)>|</[^a-zA-Z][^>]*>|</?[a-zA-Z][^>]*\Z", re.S
)
ATTRIBUTE = re.compile(rf"[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+({VALUE}))?+", re.S)
NAME = re.compile(r"[a-z]+")
BOILER, CONTENT, MIXED = 0, 1, 2


class Page:
    """Nodes in page order, parents before children: parallel lists, -1 as the parent of the root."""

    def __init__(self, html: str):
        self.parent: list[int] = [-1]
        self.tag: list[str] = ["html"]
        self.names: list[str] = [""]
        self.text: list[str] = [""]  # of blocks; empty for elements
        self.linked: list[int] = [0]
        self._stack = [0]
        self._parts: list[str] = []
        self._in_link, self._linked = False, 0
        self._read(html)

    def _flush(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            self._parts = []
            if text:
                self._add("#text", "", text, self._linked)
        self._linked, self._in_link = 0, False

    def _add(self, tag: str, names: str, text: str = "", linked: int = 0) -> int:
        self.parent.append(self._stack[-1])
        self.tag.append(tag)
        self.names.append(names)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.tag) - 1

    def _say(self, raw: str) -> None:
        text = unescape(raw)
        self._parts.append(text)
        if self._in_link:
            self._linked += len(text.strip())

    def _close(self, tags: tuple[str, ...], stop: frozenset[str]) -> None:
        for i in range(len(self._stack) - 1, 0, -1):
            tag = self.tag[self._stack[i]]
            if tag in tags:
                del self._stack[i:]
                return
            if tag in stop:
                return

    def _until(self, html: str, tag: str, at: int) -> tuple[int, int] | None:
        """Where the end tag of `tag` begins and ends."""
        end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
        return end.span() if end else None

    def _read(self, html: str) -> None:
        at, n, foreign = 0, len(html), ""
        while at < n:
            m = MARKUP.search(html, at)
            if m is None:
                self._say(html[at:])
                break
            if m.start() > at:
                self._say(html[at:m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag, closed = m[2].lower(), "/" in m[4]
            if foreign:  # drawings and formulas are part of a line, with what they show
                if m[1]:
                    foreign = "" if tag == foreign else foreign
                    continue
                if tag in FOREIGN_HIDDEN:
                    end = None if closed else self._until(html, tag, at)
                    at = end[1] if end else at
                    continue
                if tag not in ENDS_P:
                    continue
                foreign = ""  # an element of the page's own: the drawing was left open
            if m[1]:
                if tag in INLINE:
                    self._in_link = self._in_link and tag != "a"
                    continue
                heading = tag in HEADINGS
                at_open = next((i for i in range(len(self._stack) - 1, 0, -1) if (other := self.tag[self._stack[i]]) == tag or heading and other in HEADINGS), 0)
                if at_open or tag == "p":  # other end tags without a start tag mean nothing
                    self._flush()
                if at_open:
                    del self._stack[at_open:]
                continue
            if tag in HIDDEN:  # raw text without an end tag ends with the page, as in browsers
                end = self._until(html, tag, at)
                at = end[1] if end else n if tag in RAW_TEXT else at
                continue
            if tag in FOREIGN:
                foreign = "" if closed else tag
                continue
            if tag in INLINE:
                if tag == "a":
                    self._in_link = True
                elif tag == "br":
                    self._parts.append(" ")
                continue
            self._flush()
            if tag in ("html", "body", "head") or tag == "hr":
                continue
            if tag in ENDS_P:
                self._close(("p",), HOLDS)
            if tag in ENDS:
                self._close(ENDS[tag], HOLDS - {"td", "th"} if tag in ("tr", "td", "th", "tbody", "tfoot") else HOLDS)
            names = mark = ""
            if m[3]:
                found: dict[str, str] = {}
                for name, value in ATTRIBUTE.findall(m[3]):
                    found.setdefault(name.lower(), value[1:-1] if value[:1] in ("'", '"') and value[-1] == value[0] and len(value) > 1 else value)
                names = " ".join(found[x] for x in ("class", "id", "role") if x in found)
                mark = f" data-y={found['data-y']}" if "data-y" in found else ""
            node = self._add(tag, names + mark)
            if tag in RAW_TEXT:  # title, textarea: text without markup
                stop, end = self._until(html, tag, at) or (n, n)
                self._stack.append(node)
                self._say(html[at:stop])
                self._flush()
                self._stack.pop()
                at = end
            elif tag not in VOID and not closed:
                self._stack.append(node)
        self._flush()

    def features(self) -> list[list[str]]:
        n = len(self.tag)
        size, linked, parts = [len(t) for t in self.text], list(self.linked), [1 if t else 0 for t in self.text]
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            size[p] += size[i]
            linked[p] += linked[i]
            parts[p] += parts[i]
        out, whole = [], max(size[0], 1)
        before, after, last = ["^"] * n, ["$"] * n, [0] * n  # tags of the neighbours under the same parent
        for i in range(1, n):
            if k := last[self.parent[i]]:
                before[i], after[k] = self.tag[k], self.tag[i]
            last[self.parent[i]] = i
        for i in range(n):
            share = 4 * linked[i] // max(size[i], 1)
            if self.text[i]:
                end = self.text[i][-1]
                out.append([f"t{min(size[i].bit_length(), 10)}", f"l{share}", f"e{end in '.!?:;'}", f"p{self.tag[self.parent[i]]}", f"c{min(size[i].bit_length(), 10)}{share}{end in '.!?:;'}"])
            else:
                names = set(NAME.findall(self.names[i].split(" data-y=")[0].lower()))
                out.append([f"<{self.tag[i]}", f"L{share}", f"T{min(size[i].bit_length(), 14) // 2}", f"S{8 * size[i] // whole}", f"N{min(parts[i].bit_length(), 5)}", f"P{self.tag[self.parent[i]]}" if i else "P", f"B{before[i]}", f"A{after[i]}", *[f".{x}" for x in names]])
        return out

    def states(self) -> list[int]:
        """Of a labelled page: content or boilerplate by the nearest mark above, mixed where both are below."""
        n = len(self.tag)
        own = [BOILER] * n
        for i in range(1, n):
            mark = self.names[i].rpartition(" data-y=")[2] if " data-y=" in self.names[i] else ""
            own[i] = int(mark) if mark else own[self.parent[i]]
        below = [set() for _ in range(n)]
        for i in range(n - 1, 0, -1):
            if self.text[i]:
                below[i].add(own[i])
            below[self.parent[i]] |= below[i]
        return [MIXED if len(b) == 2 else b.pop() if b else o for b, o in zip(below, own, strict=True)]


class Batch:
    """All nodes of many labelled pages as arrays, level by level, for training."""

    def __init__(self, pages: list[str], least: int):
        parent, state, leaf, level, features = [], [], [], [], []
        for html in pages:
            page = Page(html)
            base, depth = len(parent), [0] * len(page.tag)
            for i in range(1, len(page.tag)):
                depth[i] = depth[page.parent[i]] + 1
            parent += [base + p if p >= 0 else -1 for p in page.parent]
            state += page.states()
            leaf += [int(bool(t)) for t in page.text]
            level += depth
            features += page.features()
        seen = Counter(f for found in features for f in found)
        self.names = sorted(f for f, n in seen.items() if n >= least)
        place = {f: k for k, f in enumerate(self.names)}
        ids = [[place[f] for f in found if f in place] for found in features]
        self.parent, self.state, self.leaf, level = (np.array(x) for x in (parent, state, leaf, level))
        self.row = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        self.feature = np.array([k for x in ids for k in x], dtype=np.int64)
        self.levels = [np.flatnonzero(level == d) for d in range(level.max() + 1)]
        self.pages = len(pages)


class Model:
    """log-potentials of features by state, and potentials of a child's state under its parent's by kind of child.

    They maximise the likelihood of the labelled pages' states given their features; the gradient comes
    from the same messages up and down the trees that `marginals` sends.  In each round a tenth of the
    features is left out at random, names three times as often, so no single one decides.
    """

    def __init__(self, pages: list[str], least: int = 4, rounds: int = 60, rate: float = 0.15, ridge: float = 2e-5, seed: int = 1):
        b, rng = Batch(pages, least), np.random.default_rng(seed)
        n, k = len(b.parent), len(b.names)
        left_out = np.where([f[0] == "." for f in b.names], 0.3, 0.1)[b.feature]
        ban = np.where((b.leaf[:, None] == 1) & (np.arange(3) == MIXED), -np.inf, 0.0)
        true = np.eye(3)[b.state]
        theta = np.zeros(3 * k + 18 + 3)
        one, two = np.zeros_like(theta), np.zeros_like(theta)
        for t in range(1, rounds + 1):
            used = rng.random(len(left_out)) >= left_out
            row, feature = b.row[used], b.feature[used]
            w, edge, root = theta[:3 * k].reshape(k, 3), theta[3 * k:-3].reshape(2, 3, 3), theta[-3:]
            local = np.stack([np.bincount(row, w[feature, s], n) for s in range(3)], axis=1) + ban
            local[b.levels[0]] += root
            belief, pairs = self._messages(b, local, np.exp(edge))
            off = true - belief
            g_w = np.stack([np.bincount(feature, off[row, s], k) for s in range(3)], axis=1)
            g = np.concatenate((g_w.ravel(), pairs.ravel(), off[b.levels[0]].sum(axis=0))) / b.pages - ridge * 100 * theta / 2
            one, two = 0.9 * one + 0.1 * g, 0.99 * two + 0.01 * g * g
            theta = theta + rate * one / (1 - 0.9**t) / (np.sqrt(two / (1 - 0.99**t)) + 1e-8)
        w, edge, root = theta[:3 * k].reshape(k, 3), np.exp(theta[3 * k:-3].reshape(2, 3, 3)), np.exp(theta[-3:])
        keep = np.where([f[0] == "." for f in b.names], 0.7, 0.9)  # what is left out in training counts less at work
        self.evidence: dict[str, tuple[float, float, float]] = {f: tuple((c * x).tolist()) for f, x, c in zip(b.names, w, keep, strict=True)}
        self.edge, self.root = edge.tolist(), (root / root.sum()).tolist()

    @staticmethod
    def _messages(b: Batch, local: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Beliefs of all nodes, and per kind of child how often its labelled pairs of states exceed those expected."""
        local, up = local.copy(), np.ones_like(local)
        for at in b.levels[:0:-1]:
            own = np.exp(local[at] - local[at].max(axis=1, keepdims=True))
            m = np.einsum("nps,ns->np", edge[b.leaf[at]], own)
            up[at] = m / m.sum(axis=1, keepdims=True)
            np.add.at(local, b.parent[at], np.log(np.maximum(up[at], 1e-300)))
        own = np.exp(local - local.max(axis=1, keepdims=True))
        belief, pairs = own / own.sum(axis=1, keepdims=True), np.zeros((2, 3, 3))
        for at in b.levels[1:]:
            above = belief[b.parent[at]] / np.maximum(up[at], 1e-300)
            joint = above[:, :, None] * edge[b.leaf[at]] * own[at][:, None, :]
            joint /= np.maximum(joint.sum(axis=(1, 2), keepdims=True), 1e-300)
            belief[at] = joint.sum(axis=1)
            for kind in (0, 1):
                here = b.leaf[at] == kind
                pairs[kind] -= joint[here].sum(axis=0)
                np.add.at(pairs[kind], (b.state[b.parent[at][here]], b.state[at][here]), 1)
        return belief, pairs

    def marginals(self, page: Page) -> list[float]:
        """P(content) of every node, by one pass of messages up and one down."""
        n, parent, text = len(page.tag), page.parent, page.text
        get, exp = self.evidence.get, math.exp
        local = []
        for i, found in enumerate(page.features()):
            a = b = c = 0.0
            for f in found:
                e = get(f)
                if e is not None:
                    a, b, c = a + e[0], b + e[1], c + e[2]
            top = max(a, b) if text[i] else max(a, b, c)
            local.append([exp(a - top), exp(b - top), 0.0 if text[i] else exp(c - top)])
        up = [None] * n
        for i in range(n - 1, 0, -1):  # children come after their parents
            x, y, z = local[i]
            e = self.edge[1 if text[i] else 0]
            m = [r[0] * x + r[1] * y + r[2] * z for r in e]
            s = m[0] + m[1] + m[2]
            m = [m[0] / s, m[1] / s, m[2] / s]
            up[i] = m
            into = local[parent[i]]
            x, y, z = into[0] * m[0], into[1] * m[1], into[2] * m[2]
            s = x + y + z or 1e-300
            into[0], into[1], into[2] = x / s, y / s, z / s
        belief = [None] * n
        belief[0] = [a * b for a, b in zip(local[0], self.root, strict=True)]
        out = [0.0] * n
        for i in range(n):
            if i:
                b, m = belief[parent[i]], up[i]
                x, y, z = b[0] / (m[0] or 1e-300), b[1] / (m[1] or 1e-300), b[2] / (m[2] or 1e-300)
                e, own = self.edge[1 if text[i] else 0], local[i]
                belief[i] = [own[k] * (x * e[0][k] + y * e[1][k] + z * e[2][k]) for k in range(3)]
            b = belief[i]
            s = b[0] + b[1] + b[2] or 1e-300
            belief[i] = [b[0] / s, b[1] / s, b[2] / s]
            out[i] = b[1] / s
        return out

    def blocks(self, html: str) -> list[str]:
        page = Page(html)
        return [t for t, p in zip(page.text, self.marginals(page), strict=True) if t and p >= 0.5]


@functools.lru_cache(maxsize=1)
def default_model() -> Model:
    from tidefold.llm.html_pages import labelled_pages

    return Model(labelled_pages())


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page; one narrow pass."""
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in row_slices(whole, column="html"):
                texts = ["\n\n".join(shared.value.blocks(html)) for html in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    return map_arrow(rows, run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
