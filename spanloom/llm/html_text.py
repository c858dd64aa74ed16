"""Operator 9: main text of web pages by composite text density.

A tolerant tokenizer builds a DOM (implied end tags, unclosed tags, raw script
and style).  Subtrees that are no article by their tag, role or names (menus,
headers, footers, asides, forms, adverts, notices, comments) are cut.  A name
is a whole part of class or id that says what the element is (``main-nav``, not
``has-sidebar`` or ``related-work``); headings are never cut by name, and
forms and named elements stay if they wrap the article (``_cut_named``).  For
every node left, the density is its characters per tag, adjusted by the share
of them that are links:

    c / t * log_b (c / l * t / k),   b = ln(c / (c - l) * l + L / C * c + e)

with c characters, t tags, l link characters and k link tags of the subtree
(at least one each in the fractions, as for c - l), and L / C the links' share of the body.
The subtree whose children's densities have the greatest sum is selected.  The
least density on its path from the body is the threshold: an article or main
element around it, and siblings along the path that reach the threshold, belong
to the text as well, as do headings before it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Names of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math".split())
_NO_TEXT = frozenset("head nav header footer aside button select option input label fieldset legend dialog menu object canvas video audio".split()) | _RAW
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# an open element of the second kind ends where one of the first kind begins
_ENDS = {
    **{t: frozenset(["p"]) for t in _BLOCK if t not in ("html", "body", "td", "th", "tr", "tbody", "thead", "tfoot")},
    "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "option": frozenset(["option"]),
    "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]),
    "tbody": frozenset(["tbody", "thead", "tr", "td", "th", "p"]), "tfoot": frozenset(["tbody", "thead", "tr", "td", "th", "p"]),
}
# such an end does not reach beyond these
_SCOPE = frozenset("html body table td th ul ol dl div article section main button blockquote".split())
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices overlay pagination popup promo promoted promotion related replies reply share sharing sidebar sidebars social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
# what others say of a page or of an article's discussion, however long
_TALK = frozenset("comment comments commentlist disqus replies reply".split())
# a part of such a name tells the kind of its element only alone
_ALONE = frozenset("widget widgets".split())
# names that end so are what stands before: comment-list, nav-links
_HOLDERS = frozenset("area bar box button buttons icon icons item items link links list post posts".split())
# names that begin so tell the state of a page: has-sidebar, no-comments
_STATES = frozenset("has is no not with without".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
# whole attributes, so that no value or part of a name passes for one
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_TELLING = re.compile("class|id|role|hidden", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[a-z]+")
_MAYBE, _SAID = 1, 2


class Node:
    __slots__ = ("tag", "parent", "parts", "cut", "c", "t", "l", "k", "density", "sum", "named")

    def __init__(self, tag: str, parent: Node | None, cut: bool = False, named: int = 0):
        self.tag, self.parent, self.cut, self.named = tag, parent, cut, named
        self.parts: list[Node | str] = []


def _kind(value: str) -> int:
    """Whether a class or id names an element that is no article (``_MAYBE``),
    or what others say of one (``_SAID``)."""
    found = 0
    for token in value.split():
        parts = _PART.findall(token)
        if len(parts) > 1 and parts[0] in _STATES:
            continue
        if len(parts) > 1 and parts[-1] in _HOLDERS:
            parts.pop()
        if parts and parts[-1] in _NAMES and (parts[-1] not in _ALONE or len(parts) == 1):
            found = max(found, _SAID if parts[-1] in _TALK else _MAYBE)
    return found


def _is_cut(tag: str, attrs: str) -> tuple[bool, int]:
    """Whether an element goes by tag, role or state, and its kind by name."""
    if tag in _NO_TEXT:
        return True, 0
    if not attrs or tag in ("html", "body", "article", "main") or not _TELLING.search(attrs):
        return False, _MAYBE * (tag == "form")
    named = _MAYBE * (tag == "form")
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True, 0
        if name == "role" and value in _ROLES:
            return True, 0
        if name in ("class", "id") and tag not in _HEADINGS:
            named = max(named, _kind(value))
    return False, named


class _Finder:
    """``str.find`` that asks again only behind the last answer: a mark that is
    not found is not found from any later place either, so all questions
    together read a page once."""

    def __init__(self, text: str):
        self.text, self.held = text, {}

    def __call__(self, mark: str, at: int) -> int:
        last = self.held.get(mark)
        if last is None or -1 < last < at:
            last = self.held[mark] = self.text.find(mark, at)
        return last


def _tag_end(find: _Finder, at: int, end: int) -> int:
    """Where the tag whose attributes begin at ``at`` has its '>'; -1 if it
    never closes.

    A '>' inside a quoted value does not count, if the quote follows an equals
    sign and is closed before the next '<'; else it is a plain character.
    """
    text = find.text
    while True:
        close = find(">", at)
        if close < 0:
            return -1
        quote = min((q for q in (find('"', at), find("'", at)) if q >= 0), default=end)
        if quote > close:
            return close
        pair = find(text[quote], quote + 1) if text[at:quote].rstrip().endswith("=") else -1
        bound = find("<", quote)
        if pair < 0 or 0 <= bound < pair:
            at = quote + 1
        else:
            at = pair + 1


def _tokens(html: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of each tag, comment and
    declaration (these without a name) of a page, in one pass.  A '<' that
    opens none of these, or whose tag never closes, is text."""
    at, end, find = 0, len(html), _Finder(html)
    unended: set[str] = set()
    while True:
        at = html.find("<", at)
        if at < 0 or at + 1 >= end:
            return
        nxt = html[at + 1]
        if html.startswith("<!--", at):
            close = find("-->", at + 4)
            stop = end if close < 0 else close + 3
            yield at, stop, "", False, ""
            at = stop
            continue
        if nxt in "!?":
            close = find(">", at)
            if close < 0:
                return
            yield at, close + 1, "", False, ""
            at = close + 1
            continue
        closing = nxt == "/"
        m = _NAME.match(html, at + 1 + closing)
        if m is None:
            at += 1
            continue
        close = _tag_end(find, m.end(), end)
        if close < 0:
            return
        tag = m[0].lower()
        attrs = html[m.end() : close]
        # a tag that another one interrupts is cut short there
        broken = attrs.find("<")
        if broken >= 0 and not _quoted(attrs, broken):
            yield at, m.end() + broken, tag, closing, attrs[:broken]
            at = m.end() + broken
            continue
        stop = close + 1
        yield at, stop, tag, closing, attrs
        if tag in _RAW and not closing and not attrs.endswith("/"):
            found = None if tag in unended else re.compile(rf"</{tag}[\s/>]", re.IGNORECASE).search(html, stop)
            if found:
                # what stands between belongs to the raw element
                yield stop, found.start(), "", False, ""
                stop = found.start()
            else:
                unended.add(tag)
                if tag in ("script", "style"):
                    yield stop, end, "", False, ""
                    return
        at = stop


def _quoted(attrs: str, at: int) -> bool:
    """Whether the character at ``at`` lies in a quoted value of a tag."""
    return any(m.start(2) <= at < m.end(2) for m in _ATTR.finditer(attrs) if m[2] and m[2][0] in "\"'")


def parse(html: str, by_name: bool = True) -> Node:
    """The body-rooted tree of a page; ``by_name`` cuts by attributes too."""
    root = Node("body", None)
    at, here = 0, root
    opened: Counter = Counter()

    def leave(top: Node) -> Node:
        """Close all elements from ``here`` up to and with ``top``."""
        nonlocal here
        while True:
            n = here
            opened[n.tag] -= 1
            here = n.parent
            if n is top:
                return here

    for start, end, tag, closing, attrs in _tokens(html):
        if start > at:
            here.parts.append(html[at:start])
        at = end
        if not tag:
            continue
        if closing:
            if tag == "br":
                here.parts.append(Node("br", here))
                continue
            if opened[tag] <= 0:
                continue
            up = here
            while up is not root and up.tag != tag:
                # an inline end tag does not close a block
                if tag not in _BLOCK and up.tag in _BLOCK:
                    up = root
                    break
                up = up.parent
            if up is not root:
                leave(up)
            continue
        if tag == "body" and here is not root:
            while here is not root:
                leave(here)
        if tag in ("html", "body"):
            continue
        if tag in _BLOCK and here.tag == "head":
            leave(here)
        closes = _ENDS.get(tag)
        if closes and any(opened[t] > 0 for t in closes):
            up, last = here, None
            while up is not root:
                if up.tag in closes:
                    last = up
                elif up.tag in _SCOPE:
                    break
                up = up.parent
            if last is not None:
                leave(last)
        node = Node(tag, here, *_is_cut(tag, attrs if by_name else ""))
        here.parts.append(node)
        if tag in _VOID or tag in _RAW or attrs.endswith("/"):
            continue
        here = node
        opened[tag] += 1
    if at < len(html):
        here.parts.append(html[at:])
    return root


def _order(root: Node) -> list[Node]:
    """Uncut nodes, parents first."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo.extend(x for x in reversed(n.parts) if isinstance(x, Node) and not x.cut)
    return out


def measure(root: Node) -> list[Node]:
    """Give every uncut node its density and density sum."""
    nodes = _order(root)
    for n in reversed(nodes):
        n.c, n.t, n.l, n.k = 0, 0, 0, 0
        for x in n.parts:
            if isinstance(x, str):
                n.c += len(_SPACE.sub("", x))
            elif not x.cut:
                n.c += x.c
                n.t += x.t + 1
                n.l += x.l
                n.k += x.k + (x.tag == "a")
        if n.tag == "a":
            n.l = n.c
    share = root.l / max(1, root.c)
    for n in nodes:
        if not n.c:
            n.density = 0.0
            continue
        c, t, l, k = n.c, max(1, n.t), max(1, n.l), max(1, n.k)
        base = log(c / max(1, c - n.l) * n.l + share * c + e)
        n.density = c / t * max(0.0, log(max(1.0, c / l * t / k))) / log(max(base, 1.0 + 1e-9)) if base > 1 else c / t * max(0.0, log(max(1.0, c / l * t / k)))
    for n in nodes:
        n.sum = sum(x.density for x in n.parts if isinstance(x, Node) and not x.cut)
    return nodes


def _best(nodes: list[Node]) -> Node:
    return max(nodes, key=lambda n: (n.sum, n.density))


def _above(nodes: list[Node]) -> set[Node]:
    """The nodes and all that contain them."""
    out: set[Node] = set()
    for n in nodes:
        up: Node | None = n
        while up is not None and up not in out:
            out.add(up)
            up = up.parent
    return out


def _cut_named(root: Node) -> None:
    """Cut forms and named elements, but none that wraps the article: one with
    a main element, or with the node of greatest density sum and either the
    page's first article or h1 or more than half of its characters.  Comments
    may be longer than their article and be articles themselves, so they stay
    only with the first h1, or with the first article of a page without h1."""
    nodes = _order(root)
    named = [n for n in nodes if n.named]
    if not named:
        return
    first = lambda tag, nodes: [n for n in nodes if n.tag == tag][:1]
    mains = _above([n for n in nodes if n.tag == "main"])
    told = _above(first("h1", nodes) or first("article", nodes))
    for n in named:
        n.cut = n.named == _SAID and n not in mains and n not in told
    nodes = measure(root)
    firsts, around = _above(first("h1", nodes) + first("article", nodes)), _above([_best(nodes)])
    for n in named:
        if n.named == _MAYBE and n not in mains and not (n in around and (n in firsts or 2 * n.c > root.c)):
            n.cut = True


def _emit(node: Node, blocks: list[list[str]]) -> None:
    todo: list[Node | str | None] = [node]
    while todo:
        x = todo.pop()
        if x is None:
            blocks.append([])
        elif isinstance(x, str):
            blocks[-1].append(x)
        elif x.cut:
            continue
        elif x.tag == "br":
            blocks[-1].append(" ")
        else:
            block = x.tag in _BLOCK
            if block:
                blocks.append([])
                todo.append(None)
            todo.extend(reversed(x.parts))


def main_text(html: str | None) -> str:
    """The article of a page; empty for null, empty and textless pages."""
    if not html:
        return ""
    root = parse(html)
    _cut_named(root)
    nodes = measure(root)
    if not root.c:
        # a wrapper of all content may bear such a name
        root = parse(html, by_name=False)
        nodes = measure(root)
    if not root.c:
        return ""
    best = _best(nodes)
    if not best.sum:
        best = root
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    outer = next((n for n in reversed(path) if n.tag in ("article", "main")), None)
    if outer is not None:
        path = path[path.index(outer) :]
    blocks: list[list[str]] = [[]]
    _along(path, threshold, blocks, outer is not None)
    out = []
    for b in blocks:
        s = _SPACE.sub(" ", unescape("".join(b))).strip()
        if s:
            out.append(s)
    return " ".join(out)


def _along(path: list[Node], threshold: float, blocks: list[list[str]], whole: bool) -> None:
    """Emit path[0] and, on the way up, the siblings that belong to it."""
    todo = [(path[-1], len(path) - 1)]
    while todo:
        node, depth = todo.pop()
        if isinstance(node, str):
            blocks[-1].append(node)
            continue
        if depth <= 0:
            _emit(node, blocks)
            continue
        on = path[depth - 1]
        later, seen = [], False
        for x in node.parts:
            if x is on:
                later.append((x, depth - 1))
                seen = True
            elif isinstance(x, Node) and not x.cut and (x.density >= threshold > 0 and (not whole or x.tag == "article") and x.l * 2 < x.c or not seen and not whole and x.tag in _HEADINGS):
                later.append((x, 0))
        todo.extend(reversed(later))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
        )


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row, in one narrow pass.

    Null and empty pages give an empty text.  White space inside a block is
    one space, blocks are joined by one space in page order, character
    references are decoded.  Repeated rows agree; extra columns are ignored;
    an empty table gives an empty result.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
