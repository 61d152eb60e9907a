"""Main text of web pages: blocks labelled content or boilerplate by a minimum cut."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = re.compile(r"""<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*)>|<[!?][^>]*(?:>|$)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

#: Elements whose content is no text of the page.
SKIPPED = frozenset("script style noscript template svg math iframe object canvas audio video map datalist select textarea button title".split())
#: Elements whose content the parser takes as raw text up to the end tag.
RAW = frozenset("script style textarea title iframe noscript".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that run within a line; all others begin and end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meter nobr output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that an opening block element ends implicitly when they are the innermost open ones.
ENDED_BY_BLOCK = frozenset("p".split())
#: Like ends like: an item ends the item before it in the same list.
SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: Cost, in bits of evidence, that an enclosing element takes from (negative) or gives to (positive) the content label.
ELEMENT = {"nav": -9.0, "aside": -8.0, "footer": -9.0, "header": -7.0, "form": -7.0, "fieldset": -6.0, "dialog": -8.0, "menu": -8.0, "address": -2.0, "article": 9.0, "main": 5.0, "p": 1.0, "blockquote": 1.0, "pre": 1.0, "figure": 0.0, "figcaption": 0.0, "li": -0.5, "td": 0.0, "h1": 1.5, "h2": 0.5, "h3": 0.5}
#: Roles of accessibility markup.
ROLE = {"navigation": -9.0, "banner": -8.0, "contentinfo": -9.0, "complementary": -8.0, "search": -8.0, "dialog": -8.0, "alertdialog": -8.0, "alert": -8.0, "menu": -8.0, "menubar": -8.0, "form": -7.0, "main": 5.0, "article": 9.0}
#: Words of classes and ids that name boilerplate, and those that name content.
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner sidebar aside widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager footer foot masthead topbar toolbar header comment comments commentlist respond reply replies disqus cookie cookies consent gdpr notice notices notification notifications popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations copyright disclaimer legal tags tagcloud search skip paywall teaser outbrain taboola".split()
)
GOOD_NAMES = frozenset("article content post entry story body main text maintext articlebody prose blog".split())
NAME_COST, GOOD_COST = -8.0, 3.0


@dataclass
class Block:
    """A run of text between two block boundaries, with what the classifier knows of it."""

    path: tuple[int, ...]  # numbers of the open elements, outermost first
    evidence: float  # from enclosing elements
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def blocks(html: str) -> list[Block]:
    """The non-empty blocks of a page in order; unclosed, misnested and truncated markup is taken as it comes."""
    found: list[Block] = []
    stack: list[tuple[str, int, float]] = []  # element, number, evidence up to here
    skip = links = number = 0
    skip_at: list[int] = []
    cur: Block | None = None

    def text(s: str) -> None:
        nonlocal cur
        if skip_at or not s:
            return
        if cur is None:
            if s.isspace():
                return
            cur = Block(tuple(x[1] for x in stack if x[0] not in INLINE), stack[-1][2] if stack else 0.0)
            found.append(cur)
        plain = unescape(s) if "&" in s else s
        cur.parts.append(plain)
        if links:
            cur.linked += len(plain)

    at, n = 0, len(html)
    while at < n:
        m = TAG.search(html, at)
        if m is None:
            # an unfinished tag at the end is markup, a stray "<" is text
            rest = html[at:]
            cut = re.search(r"<[a-zA-Z/!?][^<>]*$", rest)
            text(rest[: cut.start()] if cut else rest)
            break
        text(html[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name not in INLINE:
                cur = None
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    links -= sum(x[0] == "a" for x in stack[i:])
                    del stack[i:]
                    while skip_at and skip_at[-1] >= len(stack):
                        skip_at.pop()
                    break
            continue
        if name == "br" or name in ("wbr",):
            if name == "br" and cur is not None:
                cur.parts.append(" ")
            continue
        if name not in INLINE:
            cur = None
            while stack and (stack[-1][0] in ENDED_BY_BLOCK or stack[-1][0] in INLINE and any(x[0] in ENDED_BY_BLOCK for x in stack)):
                links -= stack[-1][0] == "a"
                stack.pop()
            ends = SAME_ENDS.get(name)
            if ends and stack and stack[-1][0] in ends:
                stack.pop()
            while skip_at and skip_at[-1] >= len(stack):
                skip_at.pop()
        if name in VOID or m[3].rstrip().endswith("/") and name not in RAW and name in INLINE:
            continue
        number += 1
        inherited = stack[-1][2] if stack else 0.0
        own, hidden = _evidence(name, m[3], inherited)
        stack.append((name, number, own))
        links += name == "a"
        if name in SKIPPED or hidden or name == "head":
            skip_at.append(len(stack) - 1)
            skip += 1
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            at = end.start() if end else n
    for b in found:
        b.text = " ".join("".join(b.parts).split())
    return [b for b in found if b.text]


def _evidence(name: str, attributes: str, inherited: float) -> tuple[float, bool]:
    """Evidence of everything open once this element is, and whether it is hidden. Boilerplate inside an article counts; an article inside boilerplate counts less."""
    own, hidden = ELEMENT.get(name, 0.0), False
    if name == "header" and inherited >= 8:
        own = 0.0  # an article's own heading
    if attributes.strip(" /"):
        for m in ATTRIBUTE.finditer(attributes):
            key = m[1].lower()
            value = (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id"):
                names = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", m[2] or m[3] or m[4] or "").lower()))
                bad = names & BAD_NAMES
                if bad == {"header"} and names & GOOD_NAMES:
                    bad = set()
                if bad and name not in ("body", "html"):
                    own = min(own, 0.0) + NAME_COST
                elif names & GOOD_NAMES:
                    own += GOOD_COST
            elif key == "role":
                own += ROLE.get(value.strip(), 0.0)
            elif key == "hidden" and value in ("", "hidden", "true") or key == "aria-hidden" and value == "true":
                hidden = True
            elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                hidden = True
    if own <= -5:
        # what stands inside an article as menu, notice, advert or comment isn't the article
        return min(inherited, 0.0) + own, hidden
    if inherited <= -5:
        return inherited + min(own, 2.0), hidden
    return min(inherited + own, 14.0), hidden


def local_cost(b: Block) -> float:
    """The classifier's evidence for content minus that for boilerplate from the block's own text: length, sentences and links."""
    linked = min(1.0, b.linked / len(b.text))
    if b.evidence >= 8:  # inside an article short blocks are no worse than long ones
        return -3.0 * linked
    n = len(b.text)
    return min(n, 400) / 100 - 0.8 + (0.8 if b.text[-1] in ".!?…。:;\"”»" and n > 40 else -0.2) - 6.0 * linked


def min_cut(n: int, gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which of n nodes stay on the source side of a minimum cut: node i is tied to the source by gain > 0 or to the sink by -gain, edges tie both ways.

    Maximum flow by shortest augmenting paths in level graphs. Ties go to the source side, to content.
    """
    source, sink = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, c: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(c)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, g in enumerate(gain):
        if g > 0:
            join(source, i, g, 0.0)
        elif g < 0:
            join(i, sink, -g, 0.0)
    for a, b, w in edges:
        join(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for k in out[a]:
                if cap[k] > tiny and level[to[k]] < 0:
                    level[to[k]] = level[a] + 1
                    queue.append(to[k])
        if level[sink] < 0:
            break
        at = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                least = min(cap[k] for k in path)
                for k in path:
                    cap[k] -= least
                    cap[k ^ 1] += least
                # back to the tail of the first edge that is full
                for i, k in enumerate(path):
                    if cap[k] <= tiny:
                        a = to[k ^ 1]
                        del path[i:]
                        break
                continue
            while at[a] < len(out[a]):
                k = out[a][at[a]]
                if cap[k] > tiny and level[to[k]] == level[a] + 1:
                    break
                at[a] += 1
            if at[a] < len(out[a]):
                path.append(k)
                a = to[k]
            elif path:
                k = path.pop()
                a = to[k ^ 1]
                at[a] += 1
            else:
                break
    # the largest source side: what can't reach the sink any more
    reach = [False] * (n + 2)
    reach[sink] = True
    queue = deque([sink])
    while queue:
        b = queue.popleft()
        for k in out[b]:
            if cap[k ^ 1] > tiny and not reach[to[k]]:
                reach[to[k]] = True
                queue.append(to[k])
    return [not reach[i] for i in range(n)]


def graph(found: list[Block]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Terminal capacities and smoothness edges: the blocks first, then the elements that hold them.

    Blocks have the classifier's costs of their own text. An element that names its kind, or stands in one that does, is tied to its terminal more strongly than all of its blocks could pull it away, and
    each of its blocks to it by the evidence: whoever stands in an advert goes with it unless the text outweighs that. Neighbours are tied, the more so the nearer the element that holds both is to them.
    """
    gain, edges = [local_cost(b) for b in found], []
    holders: dict[tuple[int, float], list[int]] = {}
    last: dict[int, int] = {}  # container -> last block directly in it
    for i, b in enumerate(found):
        if b.evidence:
            holders.setdefault((b.path[-1] if b.path else 0, b.evidence), []).append(i)
        if i:
            a = found[i - 1]
            shared = 0
            for x, y in zip(a.path, b.path, strict=False):
                if x != y:
                    break
                shared += 1
            apart = len(a.path) + len(b.path) - 2 * shared
            edges.append((i - 1, i, 1.2 / (1 + apart)))
        holder = b.path[-2] if len(b.path) > 1 else 0
        if holder in last and last[holder] != i - 1:
            edges.append((last[holder], i, 0.6))
        last[holder] = i
    for (_, evidence), inside in holders.items():
        edges += [(i, len(gain), abs(evidence)) for i in inside]
        gain.append(evidence * (1 + len(inside)))
    return gain, edges


def labels(found: list[Block]) -> list[bool]:
    """Content or not for each block, by the minimum cut of ``graph``; where nothing at all speaks for content, what nothing marks as boilerplate."""
    if found and all(local_cost(b) + b.evidence < 0 for b in found):
        return [b.evidence >= 0 and 2 * b.linked <= len(b.text) for b in found]
    gain, edges = graph(found)
    return min_cut(len(gain), gain, edges)[: len(found)]


def main_text(html: str) -> str:
    """The content blocks of a page, one per line."""
    found = blocks(html)
    if not found:
        return ""
    return "\n".join(b.text for b, keep in zip(found, labels(found), strict=True) if keep)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The rows of ``pages`` without their markup, with ``text`` and ``n_chars``.

    The whole html is cut into blocks at block elements; character references are decoded, white space inside a block becomes one space (a line break counts as white space),
    and blocks of the main text are joined by line feeds. A classifier's costs of each block's own text (length, sentences, links) tie it to source or sink, elements whose kind or name speaks for
    or against content are nodes tied to a terminal and to their blocks, neighbours in the page and blocks of one container are tied to one another, and the minimum cut separates content from the
    rest. Boilerplate inside an article is cut out of it. Null and empty pages give an empty text; pages without markup are one block; pages of any length are taken whole. Repeated rows and other
    columns are kept, but for those named text and n_chars, which are replaced; an empty table gives no rows.
    """
    others = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h or "") for h in b.column(0).to_pylist()]
            kept = [b.column(i + 1) for i in range(len(others))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*others, "text", "n_chars"])

    source = pages.select(F.col(html_col).cast("string").alias("__html"), *[F.col(f"`{c}`") for c in others])
    schema = source.drop("__html").schema.add("text", "string").add("n_chars", "long")
    return source.mapInArrow(each, schema)
