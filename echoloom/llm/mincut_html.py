"""Main-text extraction by minimum-cut labelling.

A page becomes a list of text blocks with their DOM paths. A linear classifier turns each block's features into the
cost of either label, which become the capacities to the two terminals; blocks that are adjacent in the page or share a
near ancestor get smoothness edges. The minimum cut, found with max-flow, labels each block content or boilerplate at
least total cost. All text blocks are nodes and all neighbours are joined, whatever they are marked as, so a block that
the classifier doubts follows those around it; marks (article, menus, footers, forms, ...) are features of great weight.
Names are marks only of elements that hold others and only if all their words name parts of pages: a name on running text
or with other words in it is a hint, and headings' names, which are made of their text, are nothing.

Each page is one row of work in a Python worker; memory is bounded by one Arrow batch and its largest page.

Defined results: null, empty or unreadable html gives the empty text; markup that never closes ends with the page;
repeated pages give the same text each; a page whose every block looks like boilerplate gives the empty text, an empty
table no row; a very long page is one graph of its blocks, with two or three edges each; a block that costs the same
either way is boilerplate. Only page_id, url and html are read, so further columns cannot clash.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame

#: The elements of HTML that end a run of text, hold no text of their own, or never close.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section select summary table "
    "tbody td tfoot th thead tr ul xmp".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style template noscript iframe object svg canvas audio video head title textarea select button datalist noframes applet map".split())
NEVER = set("nav footer aside form menu dialog search".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Elements that an opening element of the key's set closes when left open.
CLOSED_BY = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words in class, id and role that mark parts of a page.
BAD_NAMES = set(
    "ad ads adv advert adverts advertisement advertisements adsense adslot billboard breadcrumb breadcrumbs byline-share comment comments commentlist respond reply replies disqus "
    "consent cookie cookies gdpr copyright disclaimer footer foot masthead topbar login signin signup register menu menus navbar nav navigation navlist "
    "newsletter subscribe subscription notice notices notification notifications alert popup modal overlay pagination pager paywall popular promo promos promotion "
    "promoted related recommended recommendations rss search searchbox share sharing sharebar shares sidebar sidebars side sidenav skip skiplink social sponsor sponsored sponsors "
    "tagcloud tags teaser toc toolbar trending widget widgets navigation complementary contentinfo tablist outbrain taboola hidden".split()
)
#: Words that say what a page has rather than what an element is: `has-sidebar` marks no sidebar.
HAVING = set("has with without no not is show js".split())
HEADER_NAMES = set("header head banner masthead titlebar".split())
GOOD_NAMES = set("article articlebody articlecontent body content contents entry entrycontent hentry main maincontent post postbody postcontent story storybody text".split())
#: Words that, beside those above, names of page parts are made of. A name with any other word is a subject, not a part:
#: `comments-and-replies` and `copyright-law` are what a section is about.
LAYOUT_NAMES = set(
    "area author avatar bar block body bottom box btn button buttons card cards center col column container content desktop display div entry field fixed float form global group holder "
    "icon icons id image img inline inner item items label left link links list logo main message meta mobile module my native outer page panel policy post posts primary recent right row "
    "secondary section site slot small space sticky text thread tile title top unit view wrap wrapper zone button google gpt dfp js has is the".split()
)
#: Elements that hold running text: their own names say little, and those of headings nothing, as they are made of their text.
TEXT_TAGS = set("p li dd dt blockquote pre td th figcaption caption summary".split())
#: Classifier: costs are its logits. Positive speaks for content.
WEIGHTS = {"bias": -0.3, "words": 0.9, "link_share": -5.0, "sentence": 0.8, "good": 5.0, "bad": -8.0, "never": -12.0, "heading": 0.6, "list": -0.6, "header": -9.0, "copyright": -4.0, "outside": -3.5, "subject": -1.0, "labelled": -2.2, "paragraph": 1.0, "bare": -0.8, "early": -1.5}
#: Words inside marked content from which blocks outside it count as outside the article.
ENOUGH_WORDS = 25
SMOOTH_NEXT = 1.2
SMOOTH_PARENT = 0.6
#: A tag's attributes: a quotation mark opens a value only after an equals sign, as in HTML.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s"'>][^\s>]*)?|[^>=])*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s>/=]*)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?""", re.S)
#: The slash that closes an element with its opening tag is a mark of its own, not the end of an unquoted value.
_CLOSED = re.compile(r"""(?:^|[\s"'])/\s*$""")
#: Elements of lists and tables, and those among them beyond which nothing is closed.
_SCOPES, LISTS = set("li dd dt tr td th option ul ol dl table".split()), set("ul ol dl table".split())
_SPLIT_NAME = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"[\s]+")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noframes", "xmp", "iframe", "noscript", "template")}


@dataclass(slots=True)
class Element:
    """An open element: where it is (its parent and depth; no path is kept) and what holds for its text."""

    tag: str
    parent: Element | None
    depth: int
    never: bool = False
    good: int = 0
    bad: int = 0
    hint: int = 0
    heading: bool = False
    listed: bool = False
    header: bool = False
    hidden: bool = False
    link: bool = False
    block: str = ""


@dataclass(slots=True)
class Block:
    text: str
    linked: int
    at: Element


def _names(attributes: str) -> tuple[list[set[str]], set[str], bool]:
    """The names of class, id and role as sets of words, all their words (and joined names), and whether the element is hidden."""
    names, found, hidden = [], set(), False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), unescape(m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = True
        if key == "role":
            found.add("role=" + value.strip())
            names.append({value.strip()})
        if key in ("class", "id", "role"):
            for name in value.split():
                parts = [p for p in _SPLIT_NAME.split(name) if p]
                if not HAVING.isdisjoint(parts):
                    continue
                found.update(parts)
                found.add("".join(parts))
                names.append(set(parts) if "".join(parts) not in BAD_NAMES else {"".join(parts)})
    return names, found, hidden


def _marks(tag: str, names: list[set[str]], words: set[str]) -> tuple[bool, int]:
    """Whether names say that an element is a part of the page beside its main text, and else the hint: 1 for a name of other
    words too (a subject), 2 for such a part's name on running text (a label)."""
    if tag in HEADINGS or words.isdisjoint(BAD_NAMES):
        return False, 0
    part = any(not n.isdisjoint(BAD_NAMES) and all(w in BAD_NAMES or w in LAYOUT_NAMES or w in HEADER_NAMES or w.isdigit() for w in n) for n in names)
    return part and tag not in TEXT_TAGS, 1 + (part and tag in TEXT_TAGS)


def blocks(html: str) -> list[Block]:
    """Text blocks in page order. A stack of open elements gives each block its place and its marks."""
    out: list[Block] = []
    stack, buffer, linked = [Element("", None, 0)], [], 0
    opened: Counter = Counter()  # open elements by tag
    scopes: list[int] = []  # where in the stack elements of lists and tables are

    def flush(state: Element) -> None:
        nonlocal buffer, linked
        if buffer:
            text = _SPACE.sub(" ", "".join(buffer)).strip()
            if text:
                out.append(Block(text, min(linked, len(text)), state))
            buffer, linked = [], 0

    def cut(k: int) -> None:
        for e in stack[k:]:
            opened[e.tag] -= 1
        del stack[k:]
        while scopes and scopes[-1] >= k:
            scopes.pop()

    at, n = 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        end = m.start() if m else n
        if end > at and not stack[-1].hidden:
            text = unescape(html[at:end])
            buffer.append(text)
            if stack[-1].link:
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCKS:
                flush(stack[-1])
            if opened[tag]:
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                if any(e.tag in BLOCKS for e in stack[k:]):
                    flush(stack[-1])
                cut(k)
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if tag in BLOCKS:
            flush(stack[-1])
            # an open paragraph ends where another block begins; its open inline elements end with it
            if opened["p"]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "p":
                        cut(k)
                        break
                    if stack[k].tag in BLOCKS:
                        break
            closes = CLOSED_BY.get(tag)
            if closes:
                for k in reversed(scopes):
                    if stack[k].tag in closes:
                        cut(k)
                        break
                    if stack[k].tag in LISTS:
                        break
        if tag in _RAW_END:
            e = _RAW_END[tag].search(html, at)
            at = e.end() if e else n
            continue
        if tag in VOID or tag not in BLOCKS and _CLOSED.search(m[3]):
            continue
        up = stack[-1]
        names, words, hidden = _names(m[3]) if m[3] else ((), (), False)
        # the innermost mark counts: a bad part stays bad whatever it holds, but for the page's main element
        good, bad, hint = up.good, up.bad, up.hint
        if tag == "main" or "role=main" in words:
            good, bad, hint = 1, 0, 0
        elif tag not in ("body", "html", "article") and words:
            part, doubt = _marks(tag, names, words)
            if part:
                good, bad = 0, 1
            else:
                hint = max(hint, doubt)
        if not bad and tag not in ("body", "html") and (tag == "article" or words and not words.isdisjoint(GOOD_NAMES)):
            good = 1
        if tag in _SCOPES:
            scopes.append(len(stack))
        opened[tag] += 1
        stack.append(Element(
            tag, up, up.depth + 1, up.never or tag in NEVER, good, bad, hint, up.heading or tag in HEADINGS, up.listed or tag in ("li", "dt", "dd"),
            up.header or tag == "header" or bool(words) and tag not in ("body", "html", *HEADINGS) and not words.isdisjoint(HEADER_NAMES), up.hidden or hidden or tag in HIDDEN, up.link or tag == "a", tag if tag in BLOCKS else up.block,
        ))
    flush(stack[-1])
    return out


def cost(b: Block) -> float:
    """The classifier's logit: what labelling the block boilerplate costs more than labelling it content."""
    w, n, at = WEIGHTS, b.text.count(" ") + 1, b.at
    share = b.linked / max(1, len(b.text))
    z = w["bias"] + w["words"] * min(4.0, (n / 8.0) ** 0.5) + w["link_share"] * share
    z += w["sentence"] * (b.text[-1] in ".!?…:;\"'»”)")
    # a hint takes the mark's credit away, but leaves the text and its neighbours to decide
    z += w["good"] * (at.good and not at.hint) + w["bad"] * at.bad + w["never"] * at.never + (0.0, w["subject"], w["labelled"])[0 if at.bad else at.hint]
    z += w["heading"] * at.heading + w["list"] * at.listed + w["header"] * (at.header and not (at.heading and at.good))
    if at.block in ("p", "blockquote", "pre"):
        z += w["paragraph"] * (at.hint < 2)
    elif not (at.good or at.heading or at.listed):
        z += w["bare"]
    if n < 40 and re.search(r"©|\(c\) \d{4}|all rights reserved", b.text, re.I):
        z += w["copyright"] * (not at.good)
    return z


def minimum_cut(terminal: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the source's side. terminal: capacity from the source (positive) or to the sink (negative).

    Shortest augmenting paths over level graphs; pages have tens to thousands of nodes and sparse edges.
    """
    n = len(terminal)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, forward: float, backward: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(forward)
        out[b].append(len(to))
        to.append(a)
        cap.append(backward)

    for i, c in enumerate(terminal):
        if c > 0:
            join(s, i, c, 0.0)
        elif c < 0:
            join(i, t, -c, 0.0)
    for a, b, c in edges:
        join(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        while True:
            # one augmenting path by depth-first search along the levels, without recursion
            path: list[int] = []
            a = s
            while a != t:
                while at[a] < len(out[a]):
                    e = out[a][at[a]]
                    if cap[e] > 1e-9 and level[to[e]] == level[a] + 1:
                        break
                    at[a] += 1
                if at[a] == len(out[a]):
                    if not path:
                        break
                    level[a] = -1
                    a = to[path.pop() ^ 1]
                    at[a] += 1
                else:
                    path.append(out[a][at[a]])
                    a = to[path[-1]]
            if not path:
                break
            flow = min(cap[e] for e in path)
            for e in path:
                cap[e] -= flow
                cap[e ^ 1] += flow


def _shared(a: Element, b: Element) -> int:
    """Depth of the innermost element around both, the page itself counting one. All such walks of a page take as many steps
    as it opens and closes elements."""
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
    return a.depth + 1


def label(found: list[Block]) -> list[bool]:
    """Content or not, for each block, by the minimum cut of costs and smoothness."""
    terminal = costs(found)
    edges = []
    last: dict[int, int] = {}
    for k, b in enumerate(found):
        if k:
            a = found[k - 1]
            edges.append((k - 1, k, SMOOTH_NEXT * _shared_of(a, b)))
        # DOM proximity: the block before under the same parent or grandparent
        one = b.at.parent
        for up in (one.parent if one else None, one):
            if up is None:
                continue
            if id(up) in last and last[id(up)] != k - 1:
                edges.append((last[id(up)], k, SMOOTH_PARENT / 2))
            last[id(up)] = k
    return minimum_cut(terminal, edges)


def _shared_of(a: Block, b: Block) -> float:
    return _shared(a.at, b.at) / (max(a.at.depth, b.at.depth) + 1)


def costs(found: list[Block]) -> list[float]:
    """Terminal capacities: the classifier's logits, less for blocks outside a marked article of some length, and for bare
    text before a page's first heading."""
    marked = sum(b.text.count(" ") + 1 for b in found if b.at.good and not b.at.bad and not b.at.never) >= ENOUGH_WORDS
    first = next((k for k, b in enumerate(found) if b.at.heading), 0)
    early = [k < first and b.at.block not in TEXT_TAGS and not b.at.good for k, b in enumerate(found)]
    return [cost(b) + WEIGHTS["outside"] * (marked and not b.at.good) + WEIGHTS["early"] * e for b, e in zip(found, early, strict=True)]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    found = blocks(html)
    return "\n".join(b.text for b, keep in zip(found, label(found), strict=True) if keep)


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        text = [main_text(h) for h in f["html"]]
        yield pd.DataFrame({"page_id": f["page_id"], "url": f["url"], "text": text, "n_chars": [len(t) for t in text]})


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per page, a narrow pass."""
    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInPandas(_batches, f"page_id {kinds['page_id']}, url string, text string, n_chars long")
