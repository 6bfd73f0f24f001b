"""Main text of web pages by a tree-structured graphical model.

A page's block elements are the nodes of a tree; each is content or not. A node's
evidence is its tag, what the words of its class, id and role say, and the length and
link share of the text it holds itself; an edge's potential says how likely a child is
content given its parent and its own kind. Messages go from the leaves to the root
and back (sum-product; on a tree that is exact), which gives each node's marginal.
Potentials are counted on labelled pages.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.html_pages import labelled_pages
from palimpsest.llm.workers import lean

TRAINING_PAGES = 600
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|aria-label|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[A-Za-z][a-z]*")
_RAW = frozenset("script style textarea title".split())  # to the end of the page if they aren't closed
_DROPPED = frozenset("noscript iframe xmp noembed noframes svg template annotation annotation-xml".split())
_MATH = "maction math menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label map mark meter nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split() + _MATH.split())
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag closes these if they are open, up to the element that bounds them.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
_KINDS = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager skip",
    "head": "header masthead topbar banner logo branding",
    "foot": "footer bottom copyright legal colophon",
    "side": "sidebar side aside widget rail related recommended trending popular more",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion",
    "notice": "cookie cookies notice consent gdpr popup modal overlay alert disclaimer privacy",
    "comment": "comment comments respond reply replies discussion disqus reader",
    "form": "form subscribe newsletter signup login search share social contact poll",
    "body": "article content post entry story body main text prose page",
}
_KIND_OF = {w: k for k, words in _KINDS.items() for w in words.split()}


class Node:
    __slots__ = ("tag", "kind", "parent", "texts", "chars", "link_chars", "label")

    def __init__(self, tag: str, kind: str, parent: int):
        self.tag, self.kind, self.parent = tag, kind, parent
        self.texts: list[int] = []  # numbers of its blocks of text
        self.chars = self.link_chars = 0
        self.label = False


def _kind(attrs: str) -> str:
    if not attrs or "=" not in attrs:
        return ""
    found = Counter()
    for m in _ATTR.finditer(attrs):
        for word in _WORD.findall(m[2] or m[3] or m[4] or ""):
            if k := _KIND_OF.get(word.lower()):
                found[k] += 1
    if len(found) > 1:
        del found["body"]  # "article-sidebar" is a sidebar
    return found.most_common(1)[0][0] if found else ""


class _Open:
    """The open elements of a page, with the places of each tag, so that a tag costs the same however deep it lies."""

    def __init__(self) -> None:
        self.tags, self.nodes = ["#root"], [0]  # inline elements share their block's node
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, tag: str, node: int) -> None:
        self.places.setdefault(tag, []).append(len(self.tags))
        if tag not in _INLINE:
            self.blocks.append(len(self.tags))
        self.tags.append(tag)
        self.nodes.append(node)

    def last(self, tags: Iterable[str]) -> int:
        """The place of the innermost open element with one of the tags; 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def last_block(self) -> int:
        return self.blocks[-1] if self.blocks else 0

    def cut(self, depth: int) -> None:
        while len(self.tags) > depth:
            tag = self.tags.pop()
            self.nodes.pop()
            self.places[tag].pop()
            if tag not in _INLINE:
                self.blocks.pop()


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """The tree of block elements (parents first) and the blocks of text in page order, each with its node."""
    nodes = [Node("#root", "", -1)]
    blocks: list[tuple[int, str]] = []
    stack = _Open()
    buffer: list[tuple[str, bool]] = []

    def linked() -> bool:
        return bool(stack.places.get("a"))

    def flush() -> None:
        nonlocal buffer
        if buffer:
            node = stack.nodes[-1]
            text = " ".join(html.unescape("".join(t for t, _ in buffer)).split())
            if text:
                nodes[node].texts.append(len(blocks))
                nodes[node].chars += len(text)
                nodes[node].link_chars += min(len(text), sum(len(t) for t, in_link in buffer if in_link))
                blocks.append((node, text))
            buffer = []

    def pop_to(depth: int) -> None:
        if stack.last_block() >= depth:
            flush()
        stack.cut(depth)

    def close_implied(closed: Iterable[str], bounds: Iterable[str]) -> None:
        while (i := stack.last(closed)) > stack.last(bounds):
            pop_to(i)

    at, end, lower = 0, len(page), None
    unclosed: set[str] = set()  # dropped tags that have no end tag from here on
    while at < end:
        m = _TOKEN.search(page, at)
        text_end = m.start() if m else end
        if text_end > at:
            buffer.append((page[at:text_end], linked()))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:  # a closing tag
            if tag == "p" and not stack.last(("p",)):
                flush()
            elif tag in _HEADINGS and (i := stack.last(_HEADINGS)):
                tag = stack.tags[i]
            i = stack.last((tag,))
            if i and not (tag in _INLINE and stack.last_block() > i):  # an inline end tag doesn't close blocks
                pop_to(i)
            continue
        if tag in _DROPPED and (tag in unclosed or tag == "svg" and m[3].endswith("/")):
            continue
        if tag in _RAW or tag in _DROPPED:
            lower = lower if lower is not None else page.lower()
            stop = lower.find(f"</{tag}", at) if lower.isascii() or len(lower) == end else -2
            if stop == -2:
                found = re.compile(f"</{tag}", re.I).search(page, at)
                stop = found.start() if found else -1
            close = page.find(">", stop) if stop >= 0 else -1
            if close >= 0:
                at = close + 1
            elif tag in _RAW:
                at = end
            else:
                unclosed.add(tag)
            continue
        if tag == "br":
            buffer.append((" ", linked()))
            continue
        if tag in _INLINE:
            if tag not in _VOID and not m[3].endswith("/"):
                stack.push(tag, stack.nodes[-1])
            continue
        if tag in _ENDS_P:
            close_implied(("p",), ("td", "th", "table", "button", "caption"))
        if tag in _CLOSES:
            close_implied(*_CLOSES[tag])
        flush()
        if tag in _VOID:
            continue
        nodes.append(Node(tag, _kind(m[3]), stack.nodes[-1]))
        stack.push(tag, len(nodes) - 1)
    flush()
    return nodes, blocks


def _length_bin(n: int) -> int:
    return 0 if n == 0 else 1 if n < 25 else 2 if n < 80 else 3 if n < 300 else 4


def _evidence(node: Node) -> tuple[str, str, str]:
    share = node.link_chars / node.chars if node.chars else 0.0
    return f"t:{node.tag}", f"k:{node.kind}", f"l:{_length_bin(node.chars)}:{0 if share < 0.3 else 1 if share < 0.8 else 2}"


class Model(NamedTuple):
    root: float  # log odds
    evidence: dict[str, float]  # log likelihood ratios
    edges: dict[str, tuple[float, float]]  # P(child is content) where the parent isn't, and where it is
    unseen: tuple[float, float]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Each node's probability of being content given the whole page."""
        n = len(nodes)
        own = [sum(self.evidence.get(e, 0.0) for e in _evidence(x)) for x in nodes]
        up = [0.0] * n  # messages to parents
        edge = [self.edges.get(f"{x.tag}|{x.kind}") or self.edges.get(f"{x.tag}|") or self.unseen for x in nodes]
        for i in range(n - 1, 0, -1):  # children come after parents
            q0, q1 = edge[i]
            e = math.exp(max(-60.0, min(60.0, own[i])))
            up[i] = math.log((q1 * e + 1 - q1) / (q0 * e + 1 - q0))
            own[nodes[i].parent] += up[i]
        total = own
        total[0] += self.root
        for i in range(1, n):
            q0, q1 = edge[i]
            e = math.exp(max(-60.0, min(60.0, total[nodes[i].parent] - up[i])))
            total[i] += math.log((q1 * e + q0) / ((1 - q1) * e + 1 - q0))
        return [1 / (1 + math.exp(-max(-60.0, min(60.0, t)))) for t in total]


def train(pages: list[tuple[str, set[str]]]) -> Model:
    """Potentials from pages and, for each, the texts of its content blocks.

    A node with text of its own is content if its texts are; one without, if any child is.
    """
    seen: dict[bool, Counter] = {True: Counter(), False: Counter()}
    edges: dict[tuple[str, bool], list[int]] = {}
    counts, roots = Counter(), Counter()
    for page, content in pages:
        nodes, blocks = parse(page)
        for i in range(len(nodes) - 1, -1, -1):
            x = nodes[i]
            if x.texts:
                x.label = all(blocks[b][1] in content for b in x.texts)
            if x.label and x.parent >= 0 and not nodes[x.parent].texts:
                nodes[x.parent].label = True
        # what holds content among other things is a frame, not content
        for x in nodes:
            if x.tag in ("#root", "html", "body"):
                x.label = False
        roots[nodes[0].label] += 1
        for x in nodes:
            counts[x.label] += 1
            for e in _evidence(x):
                seen[x.label][e] += 1
            if x.parent >= 0:
                for key in (f"{x.tag}|{x.kind}", f"{x.tag}|", "*"):
                    edges.setdefault((key, nodes[x.parent].label), [0, 0])[x.label] += 1
    kinds = {e for c in seen.values() for e in c}
    evidence = {e: math.log((seen[True][e] + 0.5) / (counts[True] + 1)) - math.log((seen[False][e] + 0.5) / (counts[False] + 1)) for e in kinds}

    def chance(key: str, parent: bool) -> float:
        no, yes = edges.get((key, parent), [0, 0])
        return (yes + 0.5) / (no + yes + 1)

    keys = {k for k, _ in edges if k != "*"}
    return Model(math.log((roots[True] + 0.5) / (roots[False] + 0.5)), evidence, {k: (chance(k, False), chance(k, True)) for k in keys}, (chance("*", False), chance("*", True)))


def extract(page: str, model: Model) -> str:
    """The texts of blocks whose node is more likely content than not, a line each."""
    nodes, blocks = parse(page)
    p = model.marginals(nodes)
    return "\n".join(text for node, text in blocks if p[node] > 0.5)


def main_text(pages: DataFrame, training_pages: int = TRAINING_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of each row; null or empty html, or a page without content, gives an empty text.

    The model is trained here on ``training_pages`` labelled pages and sent to the
    workers: some hundred numbers. Rows that repeat give a row each, a null id or url stays
    null, and other columns are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(train(labelled_pages(training_pages)))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [extract(p, model) if p else "" for p in (x.as_py() for x in batch.column(2))]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
