"""Main text of pages by tag-path ratios.

A page's text lies in nodes, and every node has a root-to-leaf tag path. What tells content from the rest is a property of
paths rather than of nodes: the text and punctuation of all nodes on a path, over their number. Both ratios are smoothed
along the page, fused, weighed by what the page says of the path, and compared with a threshold from their own spread; the
paths above it are content, whatever the length of a single node on them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([A-Za-z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_PUNCTUATION = re.compile(r"[.,;:!?。，；：！？、]")

#: Elements whose content is not markup, or is never shown; it ends at their end tag.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Elements that are left out with all that they hold, where they are closed. A self-closed or unclosed one holds nothing.
SKIPPED = frozenset("template svg canvas object audio video select annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that do not end a block of text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mi mn mo ms mtext mrow mfrac msup msub msqrt semantics q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that an element of the same group closes.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Where the search for a sibling ends.
SCOPE = frozenset("ul ol dl table tbody thead tfoot div section article main body html".split())
#: Elements that are not part of an article.
OUTSIDE = frozenset("nav header footer aside form menu dialog button head address".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words in class and id that mark what is not part of an article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb "
    "breadcrumbs footer header masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "comment comments reply replies respond discussion disqus share sharing social related recommended recommendations widget pagination pager toolbar "
    "login search copyright legal disclaimer skip feedback".split()
)
#: Words that say that the element is a frame around parts, an article's among them.
FRAMES = frozenset("with has layout page content main".split())
#: Words of elements that hold one part or many: a mark beside them counts unless the page's main part is found inside.
HOLDERS = frozenset("wrapper wrap container row grid column col".split())
#: Marks that count whatever lies inside.
READERS = frozenset("comment comments reply replies respond discussion disqus".split())
#: Words of adverts and of what readers say: an element with a name of these goes with all its text, however long.
FIRM = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored comment comments reply replies respond disqus".split())
#: Words that may stand beside them in such a name and say nothing else.
BESIDE = frozenset("slot box unit block item list section area wrapper wrap container content page main layout top bottom left right inner outer body thread form reader readers user inline middle".split())
#: Elements that hold an article.
REGION = frozenset(("article", "main"))
#: Elements whose id names what they hold, as a link's target, and says nothing of their place.
NAMED = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of text: in an article only a class or id that says nothing else marks them.
TEXTUAL = frozenset("p li blockquote pre figure figcaption table dl ul ol".split())
#: The ratio from which text in a marked element of the article counts as the article's: long, punctuated, unlinked.
LONG = 400
#: What a path's ratio is multiplied by in an element that holds an article, in one that is not part of one, and in a marked one.
REGION_FACTOR, OUTSIDE_FACTOR, MARK_FACTOR = 9, 1 / 9, 1 / 9
#: What a character of a link counts for in an element that holds an article, and elsewhere.
LINK_INSIDE, LINK_ELSEWHERE = 0.25, 0.0
#: The score that a path of something else must reach, whatever the threshold: that of long text with a mark.
LEAST = float(np.log1p(LONG * MARK_FACTOR))


@dataclass
class Block:
    """A run of text between block boundaries."""

    path: int  # pages number their tag paths
    parent: int
    leaf: str
    inside: bool  # in an element that holds an article
    outside: bool  # in an element that is not part of one
    marked: bool  # in an element whose class or id says so
    hidden: bool  # never shown
    doubts: tuple[list[bool], ...]  # marks that count only while they hold True
    firm: tuple[list[bool], ...]  # the same for marks of adverts and reader comments
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    noted: int = 0  # characters in inline elements that are marked or outside
    text: str = ""

    @property
    def key(self) -> tuple[int, bool, bool]:
        """What has a ratio of its own: a path, apart from its blocks that inline elements mark."""
        return self.path, self.outside, self.marked


@dataclass
class _Open:
    tag: str
    path: int
    parent: int
    leaf: str
    inside: bool
    outside: bool
    marked: bool
    hidden: bool = False
    doubts: tuple[list[bool], ...] = ()
    firm: tuple[list[bool], ...] = ()


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(text)} if text and not text.isspace() else {}


def _open(tag: str, attributes: dict[str, str], parent: _Open, paths: dict[tuple[int, str], int]) -> _Open:
    named = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    tokens = {t.lower() for t in _TOKEN.findall(named)}
    telling = tokens
    if tag in NAMED or (tag == "section" and parent.inside):
        telling = {t.lower() for t in _TOKEN.findall(attributes.get("class", ""))}
    role = attributes.get("role", "").lower()
    if tag in TEXTUAL and parent.inside:
        telling = {t for name in named.split() if (words := {t.lower() for t in _TOKEN.findall(name)}) <= MARKS for t in words}
    marked = bool(telling & MARKS) and not telling & FRAMES and tag not in ("html", "body")
    doubted = marked and bool(telling & HOLDERS) and not telling & READERS and tag not in INLINE
    marked = marked and not doubted
    hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
    core = tag == "main" or role == "main" or attributes.get("itemprop") == "articleBody"
    region = (core or tag in REGION) and not marked and not parent.marked and not parent.outside
    if core or tag == "h1":
        for doubt in (*parent.doubts, *parent.firm):
            doubt[0] = False
    firm = tag not in ("html", "body", "main") and any(w & FIRM and w <= MARKS | BESIDE for w in ({t.lower() for t in _TOKEN.findall(name)} for name in named.split()))
    step = tag + "".join(f".{t}" for t in sorted(tokens)[:3])
    # inline elements are on the path of the block that they are in
    place = (parent.path, parent.parent, parent.leaf) if tag in INLINE else (paths.setdefault((parent.path, step), len(paths) + 1), parent.path, step)
    return _Open(tag, *place, parent.inside or region, parent.outside or tag in OUTSIDE or role in ROLES, parent.marked or marked, parent.hidden or hidden, (*parent.doubts, [True]) if doubted else parent.doubts, (*parent.firm, [True]) if firm else parent.firm)


def _ends(html: str, tag: str) -> dict[int, int]:
    """Where each closed element of this tag begins, and where it ends."""
    pattern = re.compile(rf"""<(/?){tag}(?=[\s/>])((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>""", re.IGNORECASE)
    begun: list[int] = []
    found: dict[int, int] = {}
    for m in pattern.finditer(html):
        if m[1]:
            if begun:
                found[begun.pop()] = m.end()
        elif not m[2].endswith("/"):
            begun.append(m.start())
    return found


def blocks(html: str) -> list[Block]:
    """The text blocks of a page in order. Unclosed, crossing and unknown tags are taken as browsers do.

    Adverts and reader comments are no blocks, however long, unless the page's main part or first heading lies in them.
    """
    root = _Open("", 0, -1, "", False, False, False)
    stack, out, links, paths, opened = [root], [], 0, {}, Counter()
    now: Block | None = None
    ends: dict[str, dict[int, int]] = {}
    at, size = 0, len(html)

    def add(text: str) -> None:
        nonlocal now
        top = stack[-1]
        if top.tag in ("html", "head") and text.isspace():
            return
        if now is None:
            block = next((e for e in reversed(stack) if e.tag not in INLINE), root)
            now = Block(top.path, top.parent, top.leaf, top.inside, block.outside, block.marked, top.hidden, block.doubts, block.firm)
            out.append(now)
        if top.hidden and not now.hidden:
            return
        if now.hidden and not top.hidden:
            now.hidden = False
            now.pieces.clear()
            now.linked = now.noted = 0
        text = unescape(text)
        now.pieces.append(text)
        now.linked += len(text) if links else 0
        now.noted += len(text) if top.tag in INLINE and (top.outside or top.marked) else 0

    def close(k: int) -> None:
        nonlocal now, links
        for e in stack[k:]:
            links -= e.tag == "a"
            opened[e.tag] -= 1
            if e.tag not in INLINE:
                now = None
        del stack[k:]

    def last(*tags: str) -> int:
        if not any(opened[t] > 0 for t in tags):
            return 0
        return next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag in tags), 0)

    while at < size:
        m = _TAG.search(html, at)
        if m is None:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if k := last(tag):
                close(k)
            elif tag not in INLINE:
                now = None
            continue
        if tag == "br":
            if now is not None:
                now.pieces.append(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(html, at)
            at = end.end() if end else size
            continue
        if tag in SKIPPED:
            if tag not in ends:
                ends[tag] = _ends(html, tag)
            at = ends[tag].get(m.start(), at)
            continue
        if tag in VOID:
            if tag not in INLINE and tag != "img":
                now = None
            continue
        if tag not in INLINE:
            if k := last("p"):
                if not any(e.tag in ("td", "th", "button", "caption") for e in stack[k:]):
                    close(k)
            if tag in SIBLINGS:
                k = last(*SIBLINGS[tag])
                if k and not any(e.tag in SCOPE for e in stack[k + 1 :]):
                    close(k)
            now = None
        stack.append(_open(tag, _attributes(m[3]), stack[-1], paths))
        opened[tag] += 1
        links += tag == "a"
    for b in out:
        whole = "".join(b.pieces)
        b.text = " ".join(whole.split())
        b.marked = b.marked or 2 * b.noted > len(whole) or any(d[0] for d in b.doubts)
    return [b for b in out if b.text and not b.hidden and not any(f[0] for f in b.firm)]


def path_scores(found: list[Block]) -> dict[tuple[int, bool, bool], float]:
    """Smoothed and fused ratio of each path: unlinked text over nodes, raised by punctuation over nodes.

    What the page says of a path is one more factor: REGION_FACTOR where it lies in an element that holds an article,
    OUTSIDE_FACTOR and MARK_FACTOR where it lies in something else; long, punctuated, unlinked text of the article
    overrides a mark. In an article links count a little, so that lists of references have a ratio too. Logarithms keep
    the spread from being that of the longest path alone.
    """
    order: dict[tuple[int, bool, bool], int] = {}
    for b in found:
        order.setdefault(b.key, len(order))
    text, marks, nodes, factor, long = (np.zeros(len(order)) for _ in range(5))
    for b in found:
        k = order[b.key]
        linked = min(b.linked, len(b.text))
        text[k] += len(b.text) - linked + linked * (LINK_INSIDE if b.inside and not b.outside else LINK_ELSEWHERE)
        marks[k] += len(_PUNCTUATION.findall(b.text))
        nodes[k] += 1
        factor[k] = OUTSIDE_FACTOR if b.outside else MARK_FACTOR if b.marked else REGION_FACTOR if b.inside else 1
        long[k] = b.inside and b.marked and not b.outside
    factor[(long > 0) & ((text / nodes) * (1 + marks / nodes) >= LONG)] = REGION_FACTOR
    fused = np.log1p(np.expm1(_smoothed(np.log1p(text / nodes))) * np.exp(_smoothed(np.log1p(marks / nodes))) * factor)
    return dict(zip(order, fused.tolist(), strict=True))


def _smoothed(ratios: np.ndarray) -> np.ndarray:
    """A path's own ratio leads; its neighbours on the page lift the short paths between long ones."""
    weights = np.exp(-0.5 * np.arange(-2, 3) ** 2.0)
    near = np.convolve(np.pad(ratios, 2), weights / weights.sum(), "valid") if len(ratios) else ratios
    return 0.75 * ratios + 0.25 * near


def _parting(values: np.ndarray) -> float:
    """The least value of the upper of two classes whose means are farthest apart, weighed by their sizes; 0 for one value."""
    line = np.sort(values)
    n = np.arange(1, len(line))
    if not len(n):
        return 0.0
    below = np.cumsum(line)[:-1]
    apart = n * n[::-1] * (below / n - (line.sum() - below) / n[::-1]) ** 2
    return float(line[1 + int(apart.argmax())])


def _linky(found: list[Block]) -> set[tuple[int, bool, bool]]:
    """Paths that hold lists of links, but for those of an article."""
    total: dict[tuple[int, bool, bool], list[int]] = {}
    for b in found:
        t = total.setdefault(b.key, [0, 0, 0])
        t[0] += len(b.text)
        t[1] += b.linked
        t[2] += not b.inside or b.outside or b.marked
    return {key for key, (n, linked, nodes) in total.items() if nodes > 1 and linked > 0.8 * n}


def select(found: list[Block]) -> list[Block]:
    """The blocks of the article: those on paths with a ratio above the threshold, and headings beside them.

    The threshold parts the page's ratios into two classes as far from each other as may be; in an element that holds an
    article their spread is enough, so that its short paths stay. Paths outside the article that hold lists of links never
    count, and one that is marked as something else needs long text whatever the threshold.
    """
    links = _linky(found)
    rest = [b for b in found if b.key not in links]
    scores = path_scores(rest)
    values = np.array(list(scores.values()))
    spread = min(values.std(), values.max()) if scores else 0
    parted = max(spread, _parting(values))
    inside = {b.key for b in rest if b.inside}
    least = lambda key: max(parted, LEAST) if key[1] or key[2] else spread if key in inside else parted
    content = {key for key, s in scores.items() if s >= least(key)}
    parents = {b.parent for b in rest if b.key in content}
    heading = re.compile(r"h[1-6](\.|$)")
    return [b for b in rest if b.key in content or (heading.match(b.leaf) and b.parent in parents and not b.outside and not b.marked)]


def extract(html: str | None) -> str:
    """The article's text, a line per block; empty for a null or empty page and for one without an article."""
    return "\n".join(b.text for b in select(blocks(html))) if html else ""


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page, from its whole html.

    Null or empty html, and a page without an article, give an empty text; null ids and urls stay; repeated rows each
    come back; an empty table gives an empty table; pages of any length are read whole; other columns are not read.
    """
    pages = pages.select("page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
