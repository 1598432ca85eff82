"""Main text of HTML pages by tree scoring.

A page becomes a tree of its block elements, without scripts, menus and other furniture (by element, and by class, id and role: a
name made of furniture words alone marks furniture, one that only holds such a word does where most of the text is links; wrappers of
the only article, or of most of the text beside no article, stay). Each paragraph passes points for its length and commas to the
container around it, half to the next and a third to the one above; a container's points are discounted by its share of link text. The best
container is found so; the article or main around it is the text, whole, but for inner lists of links and for nested articles of less than
half the text. Where there is none, the container is kept with those siblings that score like it or are prose, and all between the first and the last of them.

Defined cases: a null or empty page gives the empty text, as does one without text outside furniture; unclosed and stray
tags are allowed; character references are decoded after the markup is read; white space inside a block is one
space; blocks stand in page order, one a line; of containers of one score the first in page order is taken; repeated
rows are worked each; very long and very deep pages take time in proportion to their length; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm._spark import in_arrow

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.DOTALL)
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE)

#: Elements whose content is text up to their end tag; elements without content; elements that start a block; furniture.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption head button select option svg object canvas audio video math map".split())
FURNITURE = set("nav footer aside menu button select option fieldset dialog search head svg object canvas audio video map".split())
PARAGRAPH = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dd", "dt", "blockquote", "pre", "figcaption", "td", "th", "summary", "caption", "address"}
#: Words of class, id or role that mark furniture, and words that only say where or of what build it is.
SIGNS = re.compile(r"ads?|advert\w*|adslot|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumbs?|sidebar|footer|masthead|topbar|header|cookies?|consent|gdpr|notices?|popup|modal|overlay|alert|comments?|commentlist|replies|respond|disqus|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|search|widget|pagination|pager|toolbar|skip|complementary|contentinfo|dialog")
BUILD = set("area article articles author bar block body bottom box btn button buttons col column container content count desktop entry first form global group icon icons inner item items last left link links list main meta mobile outer page pages panel post posts primary reply right row secondary section side site slot story sub text thread title top unit wrap wrapper".split())
#: Words with which a header is the article's own.
OWN_HEADER = {"article", "entry", "post", "section", "story"}
#: Share of link text from which a list of at least so many blocks is a menu.
MENU, MENU_BLOCKS = 0.8, 3
#: An open paragraph ends where one of these starts; others end with their like.
ENDS_P = BLOCK - {"html", "body", "option", "button", "select"}
LIKE = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIER = {"ul", "ol", "dl", "table", "menu", "div", "section", "article", "body"}


CELLS = {"td", "th"}
#: What the names of an element say: nothing, that it may be furniture, that it is.
NO, MAYBE, SURE = 0, 1, 2

#: Elements that end an open one like them, by the name under which an element is remembered as open.
OPEN = {"p"} | set().union(*LIKE.values())
PROSE = {"p", "pre", "ul", "ol", "dl", "table", "blockquote", "figure", "section"}
HEADS = {"h1", "h2", "h3", "h4", "h5", "h6"}


class Node:
    """An element. Numbers are in page order; what hangs on the elements around one is settled when it opens."""

    __slots__ = ("count", "depth", "drop", "head", "holder", "inside", "kept", "kids", "link", "names", "near", "number", "outer", "own", "parent", "points", "sign", "size", "tag")

    def __init__(self, tag: str, names: str, parent: Node | None, drop: bool, number: int):
        self.tag, self.names, self.parent, self.drop, self.number = tag, names, parent, drop, number
        self.kept, self.sign = False, NO
        self.points, self.size, self.link, self.own, self.head, self.count = 0.0, 0, 0, 0, 0, 0
        self.kids: list[Node] = []
        body = tag in ("article", "main")
        #: what gets the points of a text in it: itself, or around paragraphs of any kind the next that is none
        self.holder: Node = self if parent is None or tag not in PARAGRAPH or tag in CELLS else parent.holder
        if parent is None:
            self.depth, self.near, self.inside, self.outer = 0, {}, body, self if body else None
            return
        parent.kids.append(self)
        self.depth, self.inside, self.outer = parent.depth + 1, parent.inside or body, parent.outer or (self if body else None)
        # open elements up to the next barrier, by tag
        self.near: dict[str, Node] = {} if tag in BARRIER else {**parent.near, tag: self} if tag in OPEN else parent.near


def _sign(names: str, inside: bool) -> int:
    """SURE if a name has a furniture word and no other words than such and BUILD, else MAYBE if one holds such a word. Headers of articles are none."""
    found = NO
    for name in names.lower().split():
        words = [x for x in re.split(r"[^a-z]+", name) if x]
        signs = [x for x in words if SIGNS.fullmatch(x) and not (x == "header" and (inside or OWN_HEADER & set(words)))]
        if signs:
            found = max(found, SURE if all(x in BUILD or SIGNS.fullmatch(x) for x in words) else MAYBE)
    return found


def _furniture(tag: str, names: str, attrs: str, parent: Node) -> tuple[bool, int]:
    """Whether an element goes with all it holds, and what its names say, which its contents may overrule."""
    if parent.drop or tag in FURNITURE:
        return True, NO
    if tag == "header":
        return not parent.inside, NO
    if tag in ("html", "body", "article", "main"):
        return False, SURE if tag == "article" and _sign(names, False) == SURE and not OWN_HEADER & set(re.split(r"[^a-z]+", names.lower())) else NO
    if attrs and HIDDEN.search(attrs):
        return True, NO
    return False, SURE if tag == "form" else _sign(names, parent.inside) if names else NO


def _rivals(nodes: list[Node]) -> list[bool]:
    """Whether an article or main with text stands outside each element (for one that is partly around: has text outside the element)."""
    is_body = [n.tag in ("article", "main") and n.own > 0 and n.sign != SURE for n in nodes]
    within, above = [int(x) for x in is_body], [0] * len(nodes)
    for n in reversed(nodes[1:]):
        within[n.parent.number] += within[n.number]
    for n in nodes[1:]:
        above[n.number] = above[n.parent.number] + is_body[n.parent.number]
    around = [n.outer if n.outer is not n else None for n in nodes]
    return [within[0] > within[n.number] + above[n.number] or (o is not None and o.own > n.own) for n, o in zip(nodes, around, strict=True)]


def _judge(nodes: list[Node], marked: list[Node], total: int) -> None:
    """Which of the nodes that names mark go. total: characters outside links.

    One that may be furniture goes if most of its text is links. One that surely is goes too, unless it holds an article or main, or most of the
    page's text (a form: in containers), and no other article or main has any.
    """
    holders = [False] * len(nodes)
    for n in reversed(nodes[1:]):
        holders[n.parent.number] |= holders[n.number] or (n.tag in ("article", "main") and n.size > 0)
    rival = _rivals(nodes)
    for n in marked:
        laid_out = n.tag != "form" or any(k.tag in ("div", "table", "section") and k.size for k in n.kids)
        wraps = holders[n.number] or (laid_out and 2 * n.own > total)
        n.drop = rival[n.number] or not wraps if n.sign == SURE else not wraps and 2 * n.own < n.size


def blocks(page: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """(elements in page order, (container, text) of each block outside furniture in page order); points are passed on the way."""
    root = Node("", "", None, False, 0)
    nodes, at, found, marked = [root], root, [], []
    opened: Counter[str] = Counter()  # elements around the place, by tag
    text: list[str] = []
    linked = depth = 0

    def close() -> None:
        nonlocal linked
        if text:
            words = " ".join(html.unescape("".join(text)).split())
            if words and not at.drop:
                found.append((at, words, min(linked, len(words))))
            text.clear()
        linked = 0

    def leave() -> None:
        nonlocal at
        opened[at.tag] -= 1
        at = at.parent

    pos = 0
    while True:
        m = MARKUP.search(page, pos)
        piece = page[pos : m.start()] if m else page[pos:]
        if piece:
            text.append(piece)
            if depth:
                linked += len(piece)
        if m is None:
            break
        pos = m.end()
        if not m[2]:
            continue
        tag, ending, attrs = m[2].lower(), m[1], m[3] or ""
        if tag == "a":
            depth = 0 if ending else 1
        elif tag == "br":
            text.append(" ")
        elif tag in RAW and not ending:
            if not attrs.endswith("/"):
                end = re.compile(rf"</{tag}[\s>/]", re.IGNORECASE).search(page, pos)
                pos = page.find(">", end.start()) + 1 or len(page) if end else len(page)
        elif tag == "hr":
            close()
        elif tag in BLOCK:
            if ending:
                if opened[tag]:
                    close()
                    while at.tag != tag:
                        leave()
                    leave()
                elif tag == "p":
                    close()
                continue
            close()
            for up in (at.near.get("p") if tag in ENDS_P else None, max((at.near[x] for x in LIKE.get(tag, ()) if x in at.near), key=lambda x: x.depth, default=None)):
                while up is not None and at.depth >= up.depth:
                    leave()
            names = " ".join(x or y or z for x, y, z in NAMES.findall(attrs)) if attrs else ""
            drop, sign = _furniture(tag, names, attrs, at)
            at = Node(tag, names, at, drop, len(nodes))
            at.sign = sign
            nodes.append(at)
            opened[tag] += 1
            if sign:
                marked.append(at)
            if attrs.endswith("/") and tag in ("svg", "canvas", "object"):
                leave()
    close()
    for n, words, links in found:
        n.own += len(words) - links
        n.size += len(words)
    total = _summed(nodes, "own", "size")
    if marked:
        _judge(nodes, marked, total)
    gone = [False] * len(nodes)
    for n in nodes:
        gone[n.number] = n.drop or (n.parent is not None and gone[n.parent.number])
        n.size = 0
    left = []
    for n, words, links in found:
        if gone[n.number]:
            continue
        left.append((n, words))
        n.size += len(words)
        n.link += links
        n.count += 1
        n.head += len(words) if n.tag in HEADS else 0
        up = n.holder
        points = 1.0 + words.count(",") + words.count("，") + words.count("、") + min(len(words) // 100, 3)
        for share in (1.0, 0.5, 1 / 3):
            up.points += points * share
            if up.parent is None:
                break
            up = up.parent.holder
    _summed(nodes, "size", "link", "head", "count")
    return nodes, left


def _summed(nodes: list[Node], *names: str) -> int:
    """Each element's numbers with those of all it holds; the page's total of the first."""
    for n in reversed(nodes):
        if n.parent is not None:
            for x in names:
                setattr(n.parent, x, getattr(n.parent, x) + getattr(n, x))
    return getattr(nodes[0], names[0])


def _score(n: Node) -> float:
    return n.points * (1 - n.link / n.size) if n.size else 0.0


def _around(best: Node) -> Node | None:
    """The nearest article around a container or itself, else the nearest main."""
    main, n = None, best
    while n is not None and n.tag != "article":
        main = main or (n if n.tag == "main" else None)
        n = n.parent
    return n or main


def _keep_whole(nodes: list[Node], text: Node, best: Node) -> None:
    """All of an article, less inner lists of links, and less nested articles that have under half of its text."""
    line, n = set(), best
    while n is not None:
        line.add(n.number)
        n = n.parent
    within, nested, inner = [False] * len(nodes), [False] * len(nodes), 0
    within[text.number] = text.kept = True
    for n in nodes[text.number + 1 :]:
        up = n.parent.number
        within[n.number], nested[n.number] = within[up], nested[up]
        if within[up] and not nested[up] and n.tag == "article" and n.number not in line:
            nested[n.number] = True
            inner += n.size
    for n in nodes[text.number + 1 :]:
        if within[n.number] and n.parent.kept:
            menu = n.number not in line and n.count >= MENU_BLOCKS and n.link > MENU * n.size
            n.kept = not menu and not (nested[n.number] and 2 * inner < text.size)


def _keep_siblings(best: Node) -> None:
    """A container with its siblings that score like it or are prose or headings before it, and all that stands between the first and the last kept one."""
    while best.parent is not None and best.parent.tag not in ("", "html", "body") and best.parent.size == best.size:
        best = best.parent
    best.kept = True
    if best.parent is None or best.tag in ("body", "html"):
        return
    top, inner = _score(best), best.parent.tag not in ("", "html", "body")
    kids = [n for n in best.parent.kids if not n.drop and n.size]
    for n in kids:
        like = _score(n) + (0.2 * top if n.names and n.names == best.names else 0) >= max(10.0, 0.2 * top)
        few_links = n.link < 0.25 * n.size
        prose = few_links and (n.tag == "p" and n.size > 80 or inner and n.tag in PROSE)
        n.kept = n.kept or like or prose or (n.head == n.size and n.number < best.number)
    at = [k for k, n in enumerate(kids) if n.kept]
    for n in kids[at[0] : at[-1]]:
        n.kept = n.kept or n.link <= MENU * n.size


def main_text(page: str | None) -> str:
    if not page:
        return ""
    nodes, found = blocks(page)
    if not found:
        return ""
    best = max((n for n in nodes if n.points > 0 and n.size and n.holder is n), key=_score)  # the first of equals, which is the outer one or stands before
    text = _around(best)
    if text is not None:
        _keep_whole(nodes, text, best)
    else:
        _keep_siblings(best)
        for n in nodes[1:]:
            n.kept = n.kept or n.parent.kept
    return "\n".join(words for n, words in found if n.kept)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [main_text(x.as_py()) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html)."""
    return in_arrow(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), _texts, "page_id bigint, url string, text string, n_chars bigint")
