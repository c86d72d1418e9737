"""HTML extraction by tree scoring.

A page becomes a tree of block elements; inline tags are transparent. Every text block is a paragraph that passes points
for its length and commas to its container, half to the next ancestor and less to those above; a container's points are
discounted by its link density. The container with the most points and the siblings that score alike or read like prose
are kept, without what is page furniture by tag or role, and without containers that are furniture by name. Names that an
article's own parts may have count against short or link-laden containers only, and no heading, paragraph, item or cell goes
by its own name. Reading a page takes time in proportion to its length, whatever its tags are.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_texts

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(script|style|title|textarea|iframe|noscript|template|svg|select|annotation)\b(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-z][^\s/>]*)([^>]*)>"
    r"|<[!?/][^>]*>",
    re.I | re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
#: Elements by what they are on a page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr del audio video source picture object canvas math semantics mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mspace mpadded mphantom".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav header footer aside form head button dialog menu fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored banner popup modal overlay cookie cookies consent gdpr comments disqus respond replies sidebar widget widgets nav navbar navigation breadcrumb breadcrumbs footer masthead newsletter pagination pager".split())
WEAK_NAMES = frozenset("promo promotion notice notices alert comment aside related recommended share sharing social menu header subscribe subscription signup login search toolbar skip".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre li dt dd td th caption figcaption h1 h2 h3 h4 h5 h6 summary".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: A start tag ends an open element of these, up to the element that holds the list or table.
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr", "td", "th"), ("table",)), "option": (("option",), ("select",))}
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SPACE = re.compile(r"\s+")


#: A start tag of a group ends the open element of the group that no element of the second set stands above.
GROUPS = (
    (frozenset(["p"]), frozenset("button td th table article section div li blockquote main body".split())),
    *dict.fromkeys((frozenset(tags), frozenset(stop)) for tags, stop in ENDS.values()),
)
GROUP_OF = {tag: GROUPS.index((frozenset(tags), frozenset(stop))) for tag, (tags, stop) in ENDS.items()}


class Node:
    """named: 0, or 1 for a weak and 2 for a strong name of furniture. open: for each group, the open element that the next
    start tag of the group would end."""

    __slots__ = ("tag", "parent", "parts", "cut", "named", "points", "chars", "linked", "links", "open")

    def __init__(self, tag: str, parent: Node | None, cut: bool, named: int):
        self.tag, self.parent, self.cut, self.named = tag, parent, cut, named
        self.parts: list = []  # child nodes and text blocks, in page order
        self.points, self.chars, self.linked, self.links = 0.0, 0, 0, 0
        above = parent.open if parent is not None else [None] * len(GROUPS)
        self.open = [self if tag in tags else None if tag in stop else up for (tags, stop), up in zip(GROUPS, above)]

    @property
    def density(self) -> float:
        return self.linked / self.chars if self.chars else 0.0


def _flags(tag: str, raw: str) -> tuple[bool, int]:
    """Whether the element is furniture by tag, role or hiding; and how much by its names."""
    if not raw or raw.isspace():
        return tag in FURNITURE, 0
    at = {m[0].lower(): m[1] or m[2] or m[3] for m in ATTRIBUTE.findall(raw)}
    hidden = "hidden" in at or at.get("aria-hidden", "").lower() == "true" or bool(HIDDEN.search(at.get("style", "")))
    words = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", f"{at.get('class', '')} {at.get('id', '')}").lower())
    container = tag not in PARAGRAPHS and tag not in ("html", "body", "article", "main", "blockquote", "figure", "details")
    named = 0 if not container else 2 if not NAMES.isdisjoint(words) else 0 if WEAK_NAMES.isdisjoint(words) else 1
    return tag in FURNITURE or hidden or at.get("role", "").lower() in ROLES, named


def parse(page: str) -> Node:
    root = node = Node("html", None, False, 0)
    text: list[tuple[str, bool]] = []
    opened: Counter[str] = Counter()
    anchors = at = 0

    def flush() -> None:
        if text:
            whole = SPACE.sub(" ", html.unescape("".join(t for t, _ in text))).strip()
            if whole:
                node.parts.append((whole, min(len(whole), sum(len(t.strip()) for t, a in text if a)), anchors))
            text.clear()

    def leave(n: Node) -> None:
        """End n and all open elements in it."""
        nonlocal node
        while True:
            done, node = node, node.parent
            opened[done.tag] -= 1
            if done is n:
                return

    def enter(n: Node) -> None:
        nonlocal node
        n.parent.parts.append(n)
        opened[n.tag] += 1
        node = n

    def end(group: int) -> None:
        if node.open[group] is not None:
            leave(node.open[group])

    last = page.rfind(">") + 1  # no tag goes on beyond it
    for m in TOKEN.finditer(page, 0, last):
        if m.start() > at:
            text.append((page[at : m.start()], anchors > 0))
        at = m.end()
        tag = m[3] or m[6]
        if not tag:
            continue
        tag, ends, raw = tag.lower(), m[2] or m[5], m[4] or m[7] or ""
        if tag == "a":
            anchors = 0 if ends else 1
        elif tag == "br":
            flush()
        elif tag in INLINE or tag in VOID:
            if tag == "hr":
                flush()
        elif ends:
            flush()
            if opened[tag] > 0:
                n = node
                while n.tag != tag:
                    n = n.parent
                leave(n)
        elif tag == "html":
            flush()
            anchors = 0
        elif tag == "body":  # ends an open head
            flush()
            anchors = 0
            while node is not root:
                leave(node)
            enter(Node("body", root, False, 0))
        else:
            flush()
            anchors = 0
            if tag in CLOSES_P:
                end(0)
            if tag in GROUP_OF:
                end(GROUP_OF[tag])
            enter(Node(tag, node, *_flags(tag, raw)))
    if at < len(page):
        text.append((page[at:], anchors > 0))
    flush()
    return root


def _furniture(n: Node) -> bool:
    """Whether a container goes by its name; its text is counted already."""
    if n.named < 2:
        section = n.tag == "section" and any(isinstance(x, Node) and x.tag in HEADINGS for x in n.parts)
        return n.named == 1 and not section and (n.chars < 200 or n.density > 1 / 3)
    return True


def weigh(order: list[Node]) -> None:
    """Characters, linked ones and links of each node, children included; order: parents before children."""
    for n in order:
        n.chars = n.linked = n.links = 0
    for n in reversed(order):
        for x in n.parts:
            if isinstance(x, Node):
                if not x.cut:
                    n.chars, n.linked, n.links = n.chars + x.chars, n.linked + x.linked, n.links + x.links
            else:
                n.chars, n.linked, n.links = n.chars + len(x[0]), n.linked + x[1], n.links + (x[1] > 0)


def extract(page: str) -> str:
    """Main text of one page: blocks joined by a line feed; empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    order: list[Node] = []
    stack = [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack.extend(x for x in n.parts if isinstance(x, Node))
    main = {id(n) for n in order if n.tag in ("article", "main")}
    holds = set()
    for n in order:
        if id(n) in main:
            p = n.parent
            while p is not None and id(p) not in holds:
                holds.add(id(p))
                p = p.parent
    for n in order:  # parents come first
        n.cut = n.cut or (n.parent is not None and n.parent.cut)
    weigh(order)
    for n in order:
        n.cut = n.cut or (n.named > 0 and id(n) not in holds and _furniture(n)) or (n.parent is not None and n.parent.cut)
    order = [n for n in order if not n.cut]
    weigh(order)
    for n in order:
        for x in n.parts:
            if isinstance(x, Node):
                continue
            points = (1 + x[0].count(",") + min(len(x[0]) / 100, 3)) * (1 - x[1] / max(1, len(x[0])))
            up = n.parent if n.tag in PARAGRAPHS and n.parent is not None else n
            for share in (1, 0.5, 1 / 6, 1 / 9):
                if up is None:
                    break
                up.points += points * share
                up = up.parent
    scored = [n for n in order if n.points > 0]
    if not scored:
        return ""
    score = {id(n): n.points * (1 - n.density) * (1.25 if id(n) in main else 1) for n in scored}
    best = max(scored, key=lambda n: score[id(n)])  # the first in page order among equals
    p = best
    while p is not None:  # a best part of an article stands for the article
        if id(p) in main:
            best = p
        p = p.parent
    kept = [best]
    if best.parent is not None and best.tag not in ("body", "html"):
        least = max(2.0, 0.2 * score.get(id(best), 0))
        kept = []
        for x in best.parent.parts:
            if x is best:
                kept.append(x)
            elif isinstance(x, Node):
                if not x.cut and (score.get(id(x), 0) >= least or (x.tag == "p" and x.chars > 80 and x.density < 0.25)):
                    kept.append(x)
            elif len(x[0]) > 80 and x[1] < 0.25 * len(x[0]):
                kept.append(x)
    blocks: list[str] = []
    todo = kept[::-1]
    while todo:
        x = todo.pop()
        if not isinstance(x, Node):
            blocks.append(x[0])
        elif not x.cut and not (x is not best and x.tag not in PARAGRAPHS and x.links > 1 and x.density > 0.5):
            todo.extend(reversed(x.parts))
    return "\n".join(blocks)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars (code points).

    A null or empty html, and a page without main text, give an empty text. Null ids and urls pass through; repeated
    rows come back repeated; pages of any size are read whole; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h or "") for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = whole_texts(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
