"""Main text of web pages by tree scoring.

The markup is read into a tree that closes what HTML lets authors leave open. Boilerplate elements are cut off by tag,
role and by words of their class and id, unless they hold most of the page's prose; what is named for comments goes
however large it is, and inside an article a word of two meanings is not enough against a part that reads like prose.
Each paragraph-like block then
passes points for its length and its commas to its parent, half to the grandparent and less further up; a container's
points are discounted by the share of its text inside links. The best container is kept, widened to the ``article`` or
``main`` around it, with those siblings that score well, are prose themselves, or have its own tag and attributes.

One page is handled at a time; memory is bounded by the largest page. As in browsers, elements are nested at most
``DEEPEST`` deep and deeper ones become siblings, so the time grows with the page and not with its square.

Edge cases: null and empty pages give an empty text; markup without text gives an empty text; text without markup is
one block; unclosed and stray tags are tolerated; repeated rows give repeated results; an empty table gives an empty
result; other columns of the input are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
PROSE = frozenset("p pre blockquote td li dd h1 h2 h3 h4 h5 h6 div section article figcaption".split())
#: A start tag of the key ends an open element of these names, up to the nearest of the stops.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table", "tbody", "thead", "tfoot")),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "option": (("option",), ("select",)),
    "body": (("head",), ("html",)),
}
CUT_TAGS = frozenset(
    "nav footer aside form button select option dialog menu svg canvas object audio video map input fieldset label head".split()
)
CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
CUT_WORDS = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar footer masthead ad ads advert adverts advertisement adsense sponsor"
    " sponsored promo promotion banner cookie cookies consent gdpr notice notices newsletter subscribe subscription signup popup modal"
    " overlay share sharing social related recommended recommendations comment comments disqus respond responses reply replies widget toolbar"
    " pagination pager login signin search rss skip copyright disclaimer alert paywall header topbar teaser outbrain taboola".split()
)
#: Of these, words that name what readers write: such parts go however much of the page they are.
COMMENT_WORDS = frozenset("comment comments disqus respond responses reply replies".split())
#: Words that may as well name what an article is about; inside one, a part that reads like prose stays.
DOUBTFUL_WORDS = frozenset("search share sharing social alert notice notices related banner recommended recommendations teaser widget copyright disclaimer response".split())
INLINE_CONTROLS = frozenset("button label".split())
PROSE_SIZE, PROSE_LINKS = 80, 0.2
DEEPEST = 512
#: Words of an article's own heading as well as of a page's.
HEADING_WORDS = frozenset("header banner masthead topbar".split())
NEVER_CUT = frozenset("html body article main".split())
SPLIT_NAME = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
TAG_END = re.compile(r"[^\"'>]*+(?:\"[^\"]*+\"[^\"'>]*+|'[^']*+'[^\"'>]*+)*+>")
TAG_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "parent", "children", "attrs", "cut", "size", "linked", "score")

    def __init__(self, tag: str, parent: Node | None, attrs: str = ""):
        self.tag, self.parent, self.attrs = tag, parent, attrs
        self.children: list[Node | str] = []
        self.cut = False
        self.size = self.linked = 0
        self.score = 0.0


def parse(page: str) -> Node:
    root = Node("#root", None)
    stack = [root]
    at, n = 0, len(page)
    last_close = page.rfind(">")
    while at < n:
        lt = page.find("<", at)
        if lt < 0 or lt > last_close:
            _text(stack[-1], page[at:])
            break
        if lt > at:
            _text(stack[-1], page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            at = page.find(">", lt) + 1
            continue
        named = TAG_NAME.match(page, lt + 1)
        if not named:
            _text(stack[-1], "<")
            at = lt + 1
            continue
        closed = TAG_END.match(page, named.end())
        end = closed.end() if closed else page.find(">", named.end()) + 1
        tag = named[1].lower()
        at = end
        if page[lt + 1] == "/":
            _close(stack, tag)
            continue
        inner = page[named.end() : end - 1]
        _open(stack, tag, inner)
        if tag in RAW:
            shut = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            at = n if not shut else page.find(">", shut.start()) + 1 or n
            stack.pop()
        elif tag in VOID or inner.endswith("/") and tag not in BLOCK:
            stack.pop()
    return root


def _text(node: Node, text: str) -> None:
    if text:
        node.children.append(text)


def _open(stack: list[Node], tag: str, attrs: str) -> None:
    if tag in ENDS:
        names, stops = ENDS[tag]
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in stops:
                break
            if stack[k].tag in names:
                del stack[k:]
                if tag not in ("tr", "tbody", "tfoot"):
                    break
    if tag in BLOCK:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == "p":
                del stack[k:]
                break
            if stack[k].tag in BLOCK:
                break
    if len(stack) > DEEPEST:
        stack.pop()
    node = Node(tag, stack[-1], attrs)
    stack[-1].children.append(node)
    stack.append(node)


def _close(stack: list[Node], tag: str) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == tag:
            del stack[k:]
            return
        # an inline end tag does not end the blocks opened since
        if stack[k].tag in BLOCK and tag not in BLOCK:
            return


def _names(attrs: str) -> tuple[set[str], str, bool]:
    """Words of class and id, the role, and whether the element is hidden."""
    words: set[str] = set()
    role, hidden = "", False
    for m in ATTRIBUTE.finditer(attrs):
        key, value = (m[1] or m[5]).lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            words.update(w.lower() for w in SPLIT_NAME.split(value) if w)
        elif key == "role":
            role = value.lower()
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and HIDDEN_STYLE.search(value):
            hidden = True
    return words, role, hidden


def _walk(root: Node) -> list[Node]:
    """All nodes, parents before children."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return order


def _measure(order: list[Node]) -> None:
    """Characters of text below each node, and those inside links; cut branches count nothing for their ancestors."""
    for node in reversed(order):
        own = sum(len(c) for c in node.children if isinstance(c, str) and not c.isspace())
        node.size = own + sum(c.size for c in node.children if isinstance(c, Node) and not c.cut)
        node.linked = node.size if node.tag == "a" else sum(c.linked for c in node.children if isinstance(c, Node) and not c.cut)


def _cut(order: list[Node]) -> None:
    total = order[0].size
    holds: set[int] = set()
    for node in reversed(order):
        if node.tag in ("article", "main") or id(node) in holds:
            if node.parent:
                holds.add(id(node.parent))
    within: set[int] = set()  # nodes inside an article or main
    paragraphs = {id(node): 0 for node in order}
    for node in reversed(order):
        paragraphs[id(node)] += node.tag == "p" and node.size > 0
        if node.parent is not None:
            paragraphs[id(node.parent)] += paragraphs[id(node)]
    for node in order:
        if node.parent is not None and (node.parent.tag in ("article", "main") or id(node.parent) in within):
            within.add(id(node))
        if node.tag in NEVER_CUT or node.tag == "#root":
            continue
        if node.tag in RAW:
            node.cut = True
            continue
        large = 2 * node.size > total or id(node) in holds
        words, role, hidden = _names(node.attrs) if node.attrs else ((), "", False)
        if hidden:
            node.cut = True
        elif node.tag in INLINE_CONTROLS and node.parent is not None and node.parent.tag == "p" and node.parent.size > 2 * node.size:
            pass  # a word of a sentence that happens to be a control
        elif not COMMENT_WORDS.isdisjoint(words) and node.tag in BLOCK and not node.tag.startswith("h"):
            # a wrapper around the whole page may be named for its comments, too
            whole = id(node) in holds or 10 * node.size >= 9 * total and paragraphs[id(node)] == paragraphs[id(order[0])]
            node.cut = id(node) in within or not whole
        elif node.tag in CUT_TAGS or role in CUT_ROLES:
            # a form may be wrapped around a whole page; menus never are prose
            node.cut = not (large and node.tag not in ("nav", "footer", "aside", "head"))
        elif node.tag == "header":
            node.cut = id(node) not in within and not large
        elif words and node.tag in BLOCK | {"span", "ins"} and not CUT_WORDS.isdisjoint(words):
            own_heading = id(node) in within and CUT_WORDS.intersection(words) <= HEADING_WORDS
            node.cut = not large and not own_heading and not node.tag.startswith("h") and not (id(node) in within and _doubtful(node, words))


def _doubtful(node: Node, words: set[str]) -> bool:
    """Whether only words that have another meaning speak against a part that reads like prose."""
    if not CUT_WORDS.intersection(words) <= DOUBTFUL_WORDS or node.size < PROSE_SIZE or _density(node) > PROSE_LINKS:
        return False
    return any(isinstance(x, Node) and x.tag == "p" and x.size >= PROSE_SIZE for x in node.children) or node.tag in ("p", "blockquote")


def _density(node: Node) -> float:
    return node.linked / node.size if node.size else 0.0


def _flat(node: Node) -> str:
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.cut:
            todo.extend(reversed(x.children))
    return "".join(out)


def _score(order: list[Node]) -> Node | None:
    for node in order:
        if node.cut or node.tag not in PROSE or not node.size:
            continue
        if any(isinstance(c, Node) and c.tag in BLOCK and not c.cut for c in node.children):
            continue
        text = _flat(node)
        points = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - _density(node))
        above, level = node.parent, 0
        while above is not None and level < 5:
            above.score += points / (1, 2, 6, 9, 12)[level]
            above, level = above.parent, level + 1
    best, most = None, 0.0
    for node in order:
        if node.cut or node.tag == "#root":
            continue
        value = (node.score + 25 * (node.tag in ("article", "main") and node.size > 0)) * (1 - _density(node))
        if value > most:
            best, most = node, value
    return best


def _dropped(order: list[Node]) -> None:
    """Marks all that lies inside a cut node."""
    for node in order:
        if node.parent is not None and node.parent.cut:
            node.cut = True


def _kept(best: Node) -> list[Node]:
    top = best
    above: Node | None = best
    while above is not None:
        if above.tag in ("article", "main"):
            top = above
            if above.tag == "article":
                break
        above = above.parent
    if top.parent is None or top.tag in ("main", "body", "html"):
        return [top]
    least = max(10.0, 0.2 * best.score)
    out = []
    for c in top.parent.children:
        if c is top:
            out.append(c)
        elif isinstance(c, Node) and not c.cut:
            prose = c.tag == "p" and c.size > 80 and _density(c) < 0.25
            same = c.tag == "article" and top.tag == "article" or top.tag != "article" and c.score * (1 - _density(c)) >= least
            title = top.tag != "article" and c.tag in ("h1", "h2")
            path = top.tag != "article" and (c.tag, c.attrs) == (top.tag, top.attrs) and _density(c) < 0.25
            path = path and any(isinstance(x, Node) and x.tag == "p" and x.size and not x.cut for x in c.children)
            if prose or same or title or path:
                out.append(c)
    return out


def _blocks(nodes: list[Node]) -> list[str]:
    """The text of the blocks, in page order, with single spaces inside."""
    blocks: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                blocks.append(text)
            held.clear()

    todo: list[Node | str | None] = list(reversed(nodes))
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            held.append(x)
        elif x.cut:
            if x.tag in BLOCK:
                flush()
        elif x.tag == "br":
            held.append(" ")
        elif x.tag in BLOCK:
            flush()
            todo.append(None)
            todo.extend(reversed(x.children))
        else:
            todo.extend(reversed(x.children))
    flush()
    return blocks


def main_text(page: str | None) -> str:
    """The article of a page: its blocks joined by line feeds."""
    if not page:
        return ""
    order = _walk(parse(page))
    _measure(order)
    _cut(order)
    _dropped(order)
    _measure(order)
    best = _score(order)
    if best is None:
        rest = [x for x in order if x.tag == "body"] or order[:1]
        return "\n".join(_blocks(rest[:1]))
    return "\n".join(_blocks(_kept(best)))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of each page."""

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages_ in batches:
            yield pages_.map(main_text, na_action=None)

    return pages.select("page_id", "url", text_of(F.coalesce("html", F.lit(""))).alias("text"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
