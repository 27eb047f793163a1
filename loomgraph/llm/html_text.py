"""Operator 2: the main text of HTML pages by composite text density.

A page is read to a tree with the usual implied end tags. For every element, with C characters and T tags below it, LC
characters and LT tags of links, N = C - LC, and CB, LB for the body's C and LC, the density is

    C / T * ln(C / LC * T / LT) / ln(ln(C / N * LC + LB / CB * C + e))

with 1 for zero counts. An element's sum is that of its children's densities. The element of the largest sum, the first
of equals, is the core of the article.

What an element is called is evidence for or against it. Menus, asides, footers, headers of the page, hidden elements,
dialogs and buttons are no article by name or role and never count. A form, and an element whose class or id has a whole
token of listed words, is doubtful. Of these, those stay that are around the page's main or its articles that fewest
such elements enclose, reader comments aside. On a page with neither, those stay that are around the element of the
largest sum in them, if half of it (of reader comments a tenth) is more than any sum outside them. All others go, and
the core is searched in what is left. There, what is around an article or main is no core, and sums in them count 16
times, unless an element beside them has a larger sum.

The text is that of the outermost article or main around the core, or else of the core. Density chooses within it, too:
paragraphs left out by a class or id come back if their own density is at least half the mean density of the core's
children and less than half of them are links, and elements that are links alone, three at least, go below that. Other
outermost articles of the page count as well if their sum is at least half the core's article's. Without an article or
main, elements beside the path from the core to the body count if their density reaches the threshold: the least
density on that path, but no less than half and no more than three quarters of the mean density of the core's children
(large elements are denser than single paragraphs). So do headings before the core. Lists of links alone, three at
least, below that threshold count nowhere. A page without any text outside the left-out elements gives an empty text.

Character references are decoded, white space inside a block becomes one space (a `br` is white space), blocks are
trimmed and joined in page order by one line feed. Null html gives an empty text, other columns may be null; repeated
rows are each extracted; empty tables give no rows; other columns of any name are not read. A page of any length is
read whole, by one task, with some hundred bytes for each tag.
"""

from __future__ import annotations

import re
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of HTML elements, and words by which pages name what is no article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template iframe canvas audio video select".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body caption dd dt html legend li optgroup option tbody td tfoot th thead tr".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"), "thead": ("tbody",), "tfoot": ("tbody", "thead", "tr", "td", "th")}
WALLS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "thead": ("table",), "tfoot": ("table",), "option": ("select",)}
OUT = frozenset("nav aside footer form head button label input dialog menu".split())
OUT_ROLES = frozenset("navigation complementary banner contentinfo search form dialog alert alertdialog menu menubar".split())
OUT_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar widget nav navbar navigation menu breadcrumb breadcrumbs footer cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations pagination pager toolbar masthead comment comments discussion respond replies disqus".split())
PLACES = frozenset("area bar block body bottom box center col column container content global header inner item items js left links list main outer page panel primary right secondary section site top wrap wrapper".split())
COMMENTS = frozenset("comment comments discussion respond replies disqus".split())

VALUE = r"(?>\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)"  # quotes count at a value's start only
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]+|=\s*+{VALUE}?+)*+)>|<[a-zA-Z/][^>]*(?:>|\Z)", re.S)
HEADER = frozenset(["header"])
TELLING = re.compile(r"class|id|role", re.I)
ATTRIBUTE = re.compile(rf"([^\s=/>\"'][^\s=/>]*)(?:\s*=\s*({VALUE}))?")
WORDS = re.compile(r"[a-z]{2,}")
SOFT, REMARKS, HARD = 1, 2, 3  # how an element is left out: unless it holds the article; as reader comments; always
WEIGHT = {0: 0.0, SOFT: 0.5, REMARKS: 0.1}  # of sums inside them, against those outside


class Node:
    __slots__ = ("name", "parent", "kids", "out", "chars", "tags", "link_chars", "link_tags", "density", "sum")

    def __init__(self, name, parent, out):
        self.name, self.parent, self.out, self.kids = name, parent, out, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


def says(value: str, listed: frozenset) -> bool:
    """Whether a class or id has a token of listed words and, at most, places."""
    return any(listed.intersection(w) and all(x in listed or x in PLACES for x in w) for w in map(WORDS.findall, value.split()))


def left_out(name: str, attributes: str, inside: bool) -> int:
    """How an element is left out of an article, or 0; inside: below an article or main."""
    how = 0
    if name in OUT or name == "header" and not inside:
        if name != "form":
            return HARD
        how = SOFT
    if not attributes or name in ("html", "body") or not TELLING.search(attributes):
        return how
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value.strip() in OUT_ROLES - {"form"}:
            return HARD
        if key == "role" and value.strip() == "form":
            how = how or SOFT
        if key in ("class", "id"):
            if says(value, COMMENTS):
                how = HARD if name in ("article", "main") else REMARKS
            elif name not in ("article", "main") and (says(value, OUT_WORDS) or not inside and name in ("div", "section") and says(value, HEADER)):
                how = how or SOFT
    return how


def around(node: Node):
    """The element and what is around it, from the inside."""
    while node is not None:
        yield node
        node = node.parent


def spare(root: Node) -> None:
    """Takes back what is left out softly but holds the article."""
    order = size_up(root, HARD)
    if not any(n.out for n in order):
        return
    found = []  # the articles, with how many doubtful elements are around them
    for n in order:
        if n.name in ("article", "main") and n.chars > n.link_chars:
            up = [u.out for u in around(n) if u.out]
            if REMARKS not in up:
                found.append((n, len(up)))
    least = min((k for _, k in found), default=0)
    keep = [n for n, k in found if n.name == "main" or k == least]
    if not keep:
        densities(order, body_of(order))
        doubtful = {id(n): WEIGHT[max(u.out for u in around(n))] * n.sum for n in order}
        inside = max(order, key=lambda n: doubtful[id(n)])
        best = doubtful[id(inside)]
        reset(order)
        order = size_up(root)
        densities(order, body_of(order))
        if best > max(n.sum for n in order):
            keep = [inside]
    for n in keep:
        for up in around(n):
            up.out = 0
    reset(order)


def body_of(order: list[Node]) -> Node:
    return next((n for n in order if n.name == "body"), order[0])


def reset(order: list[Node]) -> None:
    for n in order:
        n.chars = n.tags = n.link_chars = n.link_tags = 0
        n.density = n.sum = 0.0


def parse(html: str) -> Node:
    root = Node("#root", None, 0)
    here, at, end = root, 0, len(html)
    open_tags: dict[str, int] = {}

    def close(name):
        nonlocal here
        while here is not root:
            was, here = here.name, here.parent
            open_tags[was] -= 1
            if was == name:
                return

    while at < end:
        m = TOKEN.search(html, at)
        if m is None:
            here.kids.append(html[at:])
            break
        if m.start() > at:
            here.kids.append(html[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name == "br":
                here.kids.append(" ")
            elif open_tags.get(name):
                close(name)
            continue
        if name == "br" or name == "wbr":
            if name == "br":
                here.kids.append(" ")
            continue
        if name in RAW:
            stop = re.compile(rf"</{name}\s*>", re.I).search(html, at) if not m[3].endswith("/") else None
            at = stop.end() if stop else end if name in ("script", "style", "textarea", "title") else at
            continue
        if name in CLOSES_P and open_tags.get("p"):
            close("p")
        if name in CLOSES:
            up = here  # the nearest one that a like start tag ends, within its list or table
            last = None
            while up is not root and up.name not in WALLS[name]:
                if up.name in CLOSES[name]:
                    last = up
                up = up.parent
            if last is not None:
                while here is not last:
                    close(here.name)
                close(last.name)
        if name in ("html", "body") and open_tags.get(name):
            continue
        out = left_out(name, m[3], bool(open_tags.get("article") or open_tags.get("main")))
        node = Node(name, here, out)
        here.kids.append(node)
        if name not in VOID and not m[3].endswith("/") or name in ("p", "div", "span", "a", "b", "i"):
            if name not in VOID:
                open_tags[name] = open_tags.get(name, 0) + 1
                here = node
    return root


def size_up(root: Node, out: int = SOFT) -> list[Node]:
    """The elements that count, in page order, with their counts; those left out so much or more don't."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [k for k in reversed(node.kids) if type(k) is Node and k.out < out]
    for node in reversed(order):
        own = 0
        for k in node.kids:
            if type(k) is str:
                own += len("".join((unescape(k) if "&" in k else k).split()))
        node.chars += own
        if node.name == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
        up = node.parent
        if up is not None:
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
    return order


def density(n: Node, share: float) -> float:
    if not n.chars:
        return 0.0
    t, lc, lt = max(n.tags, 1), max(n.link_chars, 1), max(n.link_tags, 1)
    base = log(log(n.chars / max(n.chars - n.link_chars, 1) * lc + share * n.chars + e))
    return max(n.chars / t * log(max(n.chars / lc * t / lt, 1.0)) / max(base, 1e-9), 0.0)


def densities(order: list[Node], body: Node) -> None:
    share = body.link_chars / max(body.chars, 1)
    for n in order:
        n.density = density(n, share)
        if n.parent is not None:
            n.parent.sum += n.density


def inside(node: Node) -> list[Node]:
    """The element and all below it that is not left out, in page order."""
    out, stack = [], [node]
    while stack:
        n = stack.pop()
        out.append(n)
        stack += [k for k in reversed(n.kids) if type(k) is Node and not k.out]
    return out


def sums_below(node: Node) -> float:
    """The largest sum in an element."""
    return max(n.sum for n in inside(node))


def links_alone(n: Node) -> bool:
    return n.link_tags > 2 and n.chars == n.link_chars and n.name in BLOCK


def take_back(node: Node, least: float, body: Node) -> None:
    """Paragraphs of an article that a class or id has left out and whose density speaks for them."""
    share = body.link_chars / max(body.chars, 1)
    for up in inside(node):
        for n in up.kids:
            if type(n) is Node and n.out == SOFT and n.name == "p":
                alone = Node(n.name, None, 0)
                alone.kids = n.kids
                held = [(k, k.parent) for k in n.kids if type(k) is Node]
                for k, _ in held:
                    k.parent = alone
                size_up(alone)
                for k, parent in held:
                    k.parent = parent
                if alone.chars > 2 * alone.link_chars and density(alone, share) >= least:
                    n.out, n.density = 0, density(alone, share)


def blocks(node: Node, keep, out: list[str]) -> None:
    """Appends the text blocks below node; keep(element) says which elements count."""
    text: list[str] = []

    def end():
        if text:
            raw = "".join(text)
            line = " ".join((unescape(raw) if "&" in raw else raw).split())
            if line:
                out.append(line)
            text.clear()

    stack, names = [iter(node.kids)], [True]
    while stack:
        for k in stack[-1]:
            if type(k) is str:
                text.append(k)
            elif not k.out and keep(k):
                is_block = k.name in BLOCK
                if is_block:
                    end()
                stack.append(iter(k.kids))
                names.append(is_block)
                break
            elif k.name in BLOCK:
                end()
        else:
            stack.pop()
            if names.pop():
                end()
    end()


def main_text(html: str) -> str:
    if not html:
        return ""
    root = parse(html)
    spare(root)
    order = size_up(root)
    if not root.chars:
        return ""
    body = body_of(order)
    densities(order, body)
    core = max(order, key=lambda n: n.sum)  # the first of equals
    holders = {id(u) for n in order if n.name in ("article", "main") and n.chars > n.link_chars for u in around(n.parent)}
    if holders:
        best = max((n for n in order if id(n) not in holders), key=lambda n: n.sum * (16 if any(u.name in ("article", "main") for u in around(n)) else 1))
        core = best if any(u.name in ("article", "main") for u in around(best)) else core
    if not core.sum:
        core = body
    path = list(around(core))
    marked = [n for n in path if n.name in ("article", "main")]
    out: list[str] = []
    kids = [k.density for k in core.kids if type(k) is Node and k.density]
    if marked:  # the page says where its article is
        half, best = sum(kids) / len(kids) / 2 if kids else 0.0, sums_below(marked[-1])
        for n in order:
            if n.name in ("article", "main") and not any(u.name in ("article", "main") for u in around(n.parent)) and (n is marked[-1] or n.chars > 2 * n.link_chars and sums_below(n) >= best / 2):
                take_back(n, half, body)
                blocks(n, lambda k: not links_alone(k) or k.density >= half, out)
        return "\n".join(out)
    on_path = {id(n) for n in path}
    mean, least = sum(kids) / len(kids) if kids else 0.0, min((n.density for n in path if n.name not in ("html", "#root")), default=0.0)
    least = min(max(least, mean / 2), mean * 3 / 4)
    after = False  # whether the core has begun: nothing behind it is its heading

    def keep(n):
        nonlocal after
        if id(n) in on_path:
            after = after or n is core
            return True
        if n.density < least and links_alone(n):
            return False
        return id(n.parent) not in on_path or n.parent is core or n.density >= least or not after and n.name in HEADINGS

    blocks(root, keep, out)
    return "\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""

    def run(batches):
        for b in batches:
            text = [main_text(h.as_py()) for h in b.column("html")]
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
