"""Main-text extraction by scoring a page's tree.

Boilerplate elements (by tag, role, class or id) are removed. Paragraphs then pass points for length and commas to their
container and, less at every level, to its ancestors; a container's score is discounted by its link density. Article
elements count their points undiminished and main elements nearly so, as nothing in them is foreign: that is all that
their names decide. The container with the best score is kept, with those of its siblings that score well too, and with
headings beside it. Every step is linear in the page.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import small_batches

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_PLAIN = re.compile(r"[^>\"']*")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe noframes xmp noembed".split())
_DROP = frozenset("script style noscript iframe head title nav footer aside form button select textarea input template dialog menu noframes noembed label fieldset".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_HEADING = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: An open element of the first kind ends where one of the second starts.
_ENDS = {
    "p": _BLOCK - {"body", "html"},
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "td": frozenset({"td", "th", "tr", "tbody", "thead", "tfoot"}),
    "th": frozenset({"td", "th", "tr", "tbody", "thead", "tfoot"}),
    "tr": frozenset({"tr", "tbody", "thead", "tfoot"}),
    "option": frozenset({"option"}),
}
#: For each tag, those of the open elements that end where it starts.
_CLOSES = {tag: tuple(k for k, v in _ENDS.items() if tag in v) for tag in frozenset().union(*_ENDS.values())}
_SCOPE = frozenset("table ul ol dl div section article main body html td th blockquote".split())
#: Words in a class or id that mark what is not the article.
_BAD = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|sidebar|side-bar|aside|nav|navbar|navigation|menu|breadcrumbs?|footer|foot|header|masthead|cookies?|notice|alert|consent|gdpr|popup|modal|overlay|newsletter|subscribe|signup|share|sharing|social|comments?|disqus|respond|replies|related|recommended|widget|pagination|pager|login|toolbar|skip|hidden|copyright)(?:$|[\s_-])",
    re.I,
)
#: Words that tell reader comments and adverts among article elements.
_BAD_ARTICLE = re.compile(r"(?:^|[\s_-])(?:comments?|disqus|replies|reply|advert\w*|ads?|promo\w*|sponsor\w*|related|teaser)(?:$|[\s_-])", re.I)
_BAD_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_SPACE = re.compile(r"\s+")


DECAY = 0.75  # of points at every level upwards
SHARE = 0.2  # of the best score, from which a sibling is kept
NAMED = {"article": 1.0, "main": 0.97}  # of all points inside


class _Node:
    __slots__ = ("tag", "kids", "up", "bad", "named", "own", "score", "points", "chars", "linked", "anchors")

    def __init__(self, tag: str, up: _Node | None, bad: bool = False, named: bool = False) -> None:
        self.tag, self.up, self.bad, self.named = tag, up, bad, named
        self.kids: list[_Node | str] = []
        self.own, self.score, self.points = 0.0, 0.0, 0.0
        self.chars, self.linked, self.anchors = 0, 0, 0


def _is_bad(tag: str, attrs: str) -> tuple[bool, bool]:
    """Whether an element is boilerplate, and whether only its class or id says so."""
    if tag in _DROP and tag != "form":
        return True, False
    named = tag == "form"  # some pages are one form
    if not attrs or tag in ("html", "body"):
        return named, named
    rule = _BAD_ARTICLE if tag in NAMED else _BAD
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            named = named or rule.search(value) is not None
        elif name == "role":
            if value.lower() in _BAD_ROLE:
                return True, False
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, False
    return named, named


def _tag(page: str, at: int, unclosed: set[str]) -> tuple[str, str, bool, int, int] | None:
    """(name, attributes, whether it ends, start, end) of the next tag from at on; comments and declarations have no name.

    A quote that is never closed is taken as it stands, and noted in unclosed; a tag that is never closed ends the page.
    """
    while (at := page.find("<", at)) >= 0:
        ends = page.startswith("/", at + 1)
        if page.startswith("<!--", at):
            close = page.find("-->", at + 4)
            return "", "", False, at, close + 3 if close >= 0 else len(page)
        if page[at + 1 : at + 2] in ("!", "?"):
            close = page.find(">", at)
            return "", "", False, at, close + 1 if close >= 0 else len(page)
        if name := _NAME.match(page, at + 1 + ends):
            pos = name.end()
            while True:
                pos = _PLAIN.match(page, pos).end()
                mark = page[pos : pos + 1]
                if mark == ">":
                    return name[0].lower(), page[name.end() : pos], ends, at, pos + 1
                if not mark:
                    return "", "", False, at, len(page)
                close = page.find(mark, pos + 1) if mark not in unclosed else -1
                if close < 0:
                    unclosed.add(mark)  # nor will one be closed further on
                pos = max(close, pos) + 1
        at += 1
    return None


def _tree(page: str) -> _Node:
    """Elements and texts; unknown end tags are ignored, open elements end with the one around them."""
    root = node = _Node("html", None)
    path = [root]
    open_at: dict[str, list[int]] = {}  # depths of the open elements of each tag
    deepest = lambda tags: max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

    def leave(depth: int) -> _Node:
        """End the open elements from depth on."""
        while len(path) > depth:
            open_at[path.pop().tag].pop()
        return path[-1]

    at, unclosed = 0, set()
    while found := _tag(page, at, unclosed):
        tag, attrs, ends, start, end = found
        if start > at:
            node.kids.append(page[at:start])
        at = end
        if not tag:
            continue
        if ends:
            depth = deepest((tag,))
            if depth and (tag in _BLOCK or deepest(_SCOPE) <= depth):  # an inline end tag doesn't end blocks around it
                node = leave(depth)
            continue
        if tag in ("html", "body"):
            continue
        if tag in _VOID:
            if tag in ("br", "hr"):
                node.kids.append(_Node(tag, node))
            continue
        closed = deepest(_CLOSES.get(tag, ()))
        if closed and closed >= deepest(_SCOPE - {"td", "th"} if tag in ("td", "th", "tr") else _SCOPE):
            node = leave(closed)
        child = _Node(tag, node, *_is_bad(tag, attrs))
        node.kids.append(child)
        if tag in _RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if tag not in _DROP:
                child.kids.append(page[at : close.start() if close else len(page)])
            at = close.end() if close else len(page)
        elif not attrs.rstrip().endswith("/") or tag in _BLOCK:
            node = child
            open_at.setdefault(tag, []).append(len(path))
            path.append(child)
    if at < len(page):
        node.kids.append(page[at:])
    return root


def _ordered(root: _Node) -> list[_Node]:
    """Elements that are not bad, each before those inside it. No recursion: pages nest deep."""
    return list(_walk(root))


def _score(root: _Node) -> None:
    """Characters, those in links, anchors, points and scores of every element, without what is bad."""
    order, in_link = _ordered(root), set()
    for x in order:
        if x.tag == "a" or x.up is not None and id(x.up) in in_link:
            in_link.add(id(x))
        x.chars = sum(len(k.strip()) for k in x.kids if isinstance(k, str))
        x.linked = x.chars if id(x) in in_link else 0
        x.anchors = int(x.tag == "a")
    for x in reversed(order):
        if x is not root:
            x.up.chars += x.chars
            x.up.linked += x.linked
            x.up.anchors += x.anchors
    block = {id(root): root}  # the nearest block at or around each element
    for x in order[1:]:
        block[id(x)] = x if x.tag in _BLOCK else block[id(x.up)]
    for x in order:
        if x.tag in _HEADING or x.tag not in _BLOCK and x is not root:
            continue
        text = _own_text(x).strip()
        if text:
            points = (len(text) >= 25) + text.count(",") + min(len(text) / 100, 3)
            holder = block[id(x.up)] if x.up is not None and x.tag in ("p", "pre", "blockquote", "li", "td", "dd") else x
            holder.own += points * (1 - x.linked / max(x.chars, 1))
    for x in order:
        x.score = x.points = x.own
    for x in reversed(order):
        if x is not root:
            x.up.score += x.score * (DECAY if x.up.tag in _BLOCK or x.up is root else 1)
            x.up.points += x.points
    for x in order:
        if x.tag in NAMED:
            x.score = max(x.score, NAMED[x.tag] * x.points)
        x.score *= 1 - x.linked / max(x.chars, 1)


def _pardon(root: _Node) -> None:
    """An element with most of a page's text, in two paragraphs or more, is no boilerplate, whatever its class says.

    Where a page has article or main elements, only those around one are pardoned.
    """
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack.extend(k for k in x.kids if not isinstance(k, str) and (k.named or not k.bad))
    if not any(x.named for x in order):
        return
    size, paras, holds = {}, {}, {}
    for x in reversed(order):
        inner = [k for k in x.kids if not isinstance(k, str) and id(k) in size]
        size[id(x)] = sum(len(k.strip()) for k in x.kids if isinstance(k, str)) + sum(size[id(k)] for k in inner)
        paras[id(x)] = (x.tag == "p") + sum(paras[id(k)] for k in inner)
        holds[id(x)] = x.tag in ("article", "main") or any(holds[id(k)] for k in inner)
    for x in order:
        if x.named and 2 * size[id(x)] > size[id(root)] and paras[id(x)] > 1 and (holds[id(x)] or not holds[id(root)]):
            x.bad = False


def _own_text(node: _Node) -> str:
    """Text of a block without the blocks inside it."""
    out, stack = [], list(reversed(node.kids))
    while stack:
        k = stack.pop()
        if isinstance(k, str):
            out.append(k)
        elif k.tag == "br":
            out.append(" ")
        elif not k.bad and k.tag not in _BLOCK:
            stack.extend(reversed(k.kids))
    return "".join(out)


def _walk(root: _Node) -> Iterator[_Node]:
    stack = [root]
    while stack:
        x = stack.pop()
        yield x
        stack.extend(k for k in reversed(x.kids) if not isinstance(k, str) and not k.bad)


def _beside(kids: list[_Node | str]) -> list[_Node]:
    return [k for k in kids if not isinstance(k, str) and not k.bad and (k.tag in _HEADING or k.tag == "header")]


def _container(root: _Node) -> list[_Node]:
    """The container with the best score, with siblings worth keeping, in page order.

    Headings beside it stay, and those beside its ancestors up to the outermost article or main element around it. Of
    equal scores the innermost, and then the first, is best.
    """
    _score(root)
    order = [x for x in _ordered(root) if x is root or x.tag in _BLOCK and x.tag not in _HEADING and x.tag not in ("p", "li", "tr", "td", "th", "dt", "dd", "tbody", "thead", "tfoot", "ul", "ol", "dl")]
    depth = {id(root): 0}
    for x in _walk(root):
        if x is not root:
            depth[id(x)] = depth[id(x.up)] + 1
    best = max(order, key=lambda x: (round(x.score, 9), depth[id(x)]))
    if best.up is None:
        return [best]
    line = [best]  # best and its ancestors
    while line[-1].up is not None:
        line.append(line[-1].up)
    whole = max((i for i, x in enumerate(line) if x.tag in NAMED), default=-1)
    least, kept = SHARE * best.score, []
    titled = any(x.tag in _HEADING for x in _walk(best))
    for k in best.up.kids:
        if isinstance(k, str) or k.bad:
            if isinstance(k, str) and best.tag not in NAMED and len(k.strip()) >= 25 and best.up.tag in _BLOCK:
                kept.append(_text(k, best.up))
            continue
        if k is best:
            kept.append(k)
        elif k.tag in _HEADING or k.tag == "header":
            if whole > 0 or not titled or best.tag not in NAMED:
                kept.append(k)
        elif best.tag in NAMED:
            if k.tag == best.tag and k.score >= least:
                kept.append(k)
        else:
            dense = k.linked / max(k.chars, 1)
            if k.tag == "p":
                good = k.chars and dense < (0.25 if k.chars > 80 else 0.01)
            else:
                good = k.tag in _BLOCK and k.score > 0 and k.score >= least
            if good:
                kept.append(k)
    for child, x in zip(line[1:], line[2 : whole + 1], strict=False):
        at = next(i for i, k in enumerate(x.kids) if k is child)
        kept = _beside(x.kids[:at]) + kept + _beside(x.kids[at + 1 :])
    return kept


def _text(text: str, up: _Node) -> _Node:
    """A bare text beside the best container, as a block of its own."""
    made = _Node("p", up)
    made.kids.append(text)
    return made


def _menu(node: _Node) -> bool:
    """A list or box of links."""
    return node.tag in ("ul", "ol", "dl", "div", "table", "section") and node.anchors >= 3 and node.chars > 0 and node.linked >= 0.66 * node.chars


def _headings(node: _Node) -> list[_Node]:
    """The headings at any depth, none inside another."""
    found, stack = [], list(reversed(node.kids))
    while stack:
        k = stack.pop()
        if isinstance(k, str) or k.bad:
            continue
        if k.tag in _HEADING:
            k.up = node
            found.append(k)
        else:
            stack.extend(reversed(k.kids))
    return found


def main_text(page: str | None) -> str:
    """The article's text: blocks in page order, a line each; empty if there is none."""
    if not page:
        return ""
    root = _tree(page)
    _pardon(root)
    named = {id(root): False}  # whether an article or main element is at or around each element
    for x in _walk(root):
        named[id(x)] = x.tag in NAMED or x.up is not None and named[id(x.up)]
        if x.tag == "header":  # of an article, only its headings stay
            x.bad = not named[id(x)]
            x.kids = [] if x.bad else _headings(x)
    lines: list[str] = []
    part: list[str] = []

    def end() -> None:
        line = _SPACE.sub(" ", "".join(part)).strip()
        part.clear()
        if line:
            lines.append(line)

    for top in _container(root):
        stack: list[_Node | str | None] = [top]
        while stack:
            k = stack.pop()
            if k is None:
                end()
            elif isinstance(k, str):
                part.append(_html.unescape(k))
            elif k.tag == "br":
                part.append(" ")
            elif not k.bad and not (k is not top and not named.get(id(k), False) and _menu(k)):
                if k.tag in _BLOCK:
                    end()
                    stack.append(None)
                stack.extend(reversed(k.kids))
        end()
    return "\n".join(lines)


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        text = [main_text(x) for x in batch["html"]]
        yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": text, "n_chars": [len(t) for t in text]})


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page, from its whole html.

    Null or empty html gives an empty text, an empty table an empty result. Repeated rows each have their row, null ids
    and urls stay null, other columns are ignored. A page of any length is read whole, in linear time.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInPandas(_run, "page_id long, url string, text string, n_chars long")
