"""Main text of web pages by tree scoring.

A tolerant parser builds a tree of block elements (inline markup only counts for whether text is in a link). Scripts,
styles, forms, menus, headers, footers, sidebars, notices, adverts, hidden parts and reader comments
are left out, by element, role, and class or id, where a whole token says so ("share", "share-buttons", not "share-price").
Each paragraph then has points: one, one for each comma, and one for each 100 characters (three at most); its parent
gets them all, its grandparent half, further ancestors ever smaller shares, up to LEVELS of them. A container's points are multiplied by the share of its text outside links;
the best one is kept, widened to the article or main element that holds it, with those siblings that score
a fifth of it or are prose themselves. Inside, every block stays, but lists of links.

Defined cases: a null or empty page, and one without text outside links, gives an empty text; character references are
decoded, also unended ones that HTML allows; white space inside a block becomes one space, line breaks of `br`
too; unclosed and misnested elements are closed as HTML implies; a tag that never ends is text with what follows; references to numbers
beyond all characters become U+FFFD; every row gives a row, repeated ones too. Time grows in proportion to the page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from livgrid.llm.storage import bound_batches
from livgrid.llm.wordhash import chunks

#: HTML's elements by role.
SKIP = frozenset("script style noscript template svg math canvas iframe object embed applet audio video form button select textarea input option optgroup datalist label fieldset nav footer aside menu dialog head title map frameset noframes".split())
RAW = frozenset("script style template textarea title iframe noscript xmp noembed noframes svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr frame keygen basefont bgsound".split())
BLOCK = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 hgroup header address blockquote pre ul ol li dl dt dd table thead tbody tfoot tr td th caption colgroup figure figcaption details summary center dir listing hr search".split()
)
CLOSES_P = BLOCK - {"caption", "colgroup", "thead", "tbody", "tfoot", "tr", "td", "th", "html", "body"} | {"form", "fieldset", "nav", "footer", "aside", "menu", "dialog"}
#: An element that ends the open one of these kinds, up to the nearest of those bounds.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"})}
#: Words of a class or id that mark what isn't the article, and words that may stand beside them in a compound.
BOILERPLATE = frozenset(
    "nav navbar navigation topnav subnav menu submenu breadcrumb breadcrumbs sidebar side rail footer foot header masthead topbar banner ad ads advert adverts advertisement advertising adsense adbox sponsor sponsored promo promotion promoted "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist disqus respond replies reply "
    "widget toolbar pagination pager paywall skip search outbrain taboola hidden".split()
)
QUALIFIERS = frozenset(
    "a an and the to of for by on in up all my new more main site page global primary secondary top bottom left right upper lower inner outer mobile desktop sticky fixed floating wrapper wrap container holder box block panel pane area section region zone col column row bar strip slot unit "
    "list lists item items entry entries group grid card cards post posts article articles story stories news blog link links icon icons button buttons btn btns form forms field input text content body title heading media module component tags tag count counter "
    "author user reader readers thread feed stream tools tool print email mail facebook twitter follow rss sr only visually js is has".split()
)
_WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*|[0-9]+")


def marks_boilerplate(value: str) -> bool:
    """Whether a token of a class or id says that the element isn't the article: all its words are of the two lists, or numbers, and one marks."""
    for token in value.split():
        words = [w.lower() for w in _WORDS.findall(token)]
        if any(w in BOILERPLATE for w in words) and all(w in BOILERPLATE or w in QUALIFIERS or w.isdigit() for w in words):
            return True
        if token.lower() in ("sr-only", "visually-hidden"):
            return True
    return False


ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
KEPT_WHOLE = frozenset("html body article main".split())
PARAGRAPHS = frozenset("p pre blockquote td li dd div section article main body figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(
    r"<!--(?P<c>.*?)(?:-->|--!>|\Z)|<!\[CDATA\[(?P<d>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<e>/?)(?P<t>[a-zA-Z][^\s/>]*)(?P<a>(?:[^>\"'=]|=\s*+(?:\"[^\"]*+\"|'[^']*+')?|[\"'])*+)>", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
#: Numeric references of more digits than any character has, and noughts before others.
_HUGE = re.compile(r"&#(?:0*[1-9][0-9]{7,}|[xX]0*[1-9a-fA-F][0-9a-fA-F]{6,});?")
_NOUGHTS = re.compile(r"&#([xX]?)0{8,}(?=[0-9a-fA-F])")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
#: An open p is out of reach behind these.
_P_BOUNDS = frozenset("html body td th table li article div section".split())
#: How far up a paragraph's points go.
LEVELS = 8


class Node:
    """An element. p: the open paragraph that a block would end; ends: by kind of IMPLIED, the outermost open element that one of the kind would end."""

    __slots__ = ("children", "ends", "length", "linked", "p", "parent", "points", "tag")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.children: list[Node | tuple[str, bool]] = []
        self.points, self.length, self.linked = 0.0, 0, 0
        self.p = self if tag == "p" else None if parent is None or tag in _P_BOUNDS else parent.p
        self.ends: dict[str, Node] = {} if parent is None else parent.ends
        if tag in _IMPLIED_TAGS:
            self.ends = {k: v for k, v in self.ends.items() if tag not in IMPLIED[k][1]}
            for k, (ended, bounds) in IMPLIED.items():
                if tag in ended and tag not in bounds:
                    self.ends.setdefault(k, self)


_IMPLIED_TAGS = frozenset().union(*(a | b for a, b in IMPLIED.values()))


def _left_out(tag: str, attributes: str, inside_article: bool) -> bool:
    if tag in SKIP:
        return True
    if tag == "header" and not inside_article:
        return True
    if not attributes or attributes.isspace():
        return False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", "").lower()):
        return tag not in ("html", "body")
    if tag in KEPT_WHOLE:
        return False
    if found.get("role", "").lower() in ROLES:
        return True
    return any(k in found and marks_boilerplate(found[k]) for k in ("class", "id"))


def parse(page: str) -> Node:
    """The tree of what isn't left out, in one pass: no step looks back over more than it closes."""
    root = here = Node("html", None)
    at, links, n = 0, 0, len(page)
    skipped: list[str] = []  # open elements from the one that is left out
    inside: Counter[str] = Counter()  # how many of each are in it
    opened: Counter[str] = Counter()  # how many of each are open above and with `here`

    def close(node: Node) -> Node:
        """Closes the elements up to the node, itself included."""
        nonlocal here
        while here is not node:
            opened[here.tag] -= 1
            here = here.parent
        opened[here.tag] -= 1
        here = here.parent
        return here

    look = 0
    while (look := page.find("<", look)) >= 0:
        m = _TOKEN.match(page, look)
        if m is None:
            if re.match(r"</?[a-zA-Z]", page[look : look + 3]):
                break  # a tag that never ends: the rest is text
            look += 1
            continue
        if look > at and not skipped:
            here.children.append((page[at:look], links > 0))
        at = look = m.end()
        tag = m["t"]
        if tag is None:
            if m["d"] is not None and not skipped:
                here.children.append((html.escape(m["d"], quote=False), links > 0))
            continue
        tag = tag.lower()
        if m["e"]:
            if skipped:
                if inside[tag]:
                    while (last := skipped.pop()) != tag:
                        inside[last] -= 1
                    inside[tag] -= 1
                    continue
                if tag not in ("body", "html", "article", "main"):
                    continue
                skipped.clear()  # an unclosed element ends with what holds it
                inside.clear()
            if tag == "a":
                links = 0
            elif tag in BLOCK and tag not in ("html", "body") and opened[tag] > 0:
                node = here
                while node.tag != tag:
                    node = node.parent
                close(node)
                links = 0
            continue
        if tag in RAW:
            if not m["a"].endswith("/") or tag not in ("svg", "math"):
                end = _RAW_END[tag].search(page, at)
                stop = page.find(">", end.end()) if end else -1
                at = look = stop + 1 if stop >= 0 else n
            if not skipped:
                here.children.append((" ", False))
            continue
        if tag in VOID or skipped and m["a"].endswith("/"):
            if not skipped and tag in ("br", "hr", "img"):
                here.children.append((" ", links > 0) if tag != "hr" else Node("hr", here))
            continue
        if skipped:
            if tag in BLOCK or tag in SKIP:
                skipped.append(tag)
                inside[tag] += 1
            continue
        if tag in CLOSES_P and here.p is not None:
            close(here.p)
        if tag in here.ends:
            close(here.ends[tag])
        if _left_out(tag, m["a"], opened["article"] + opened["main"] > 0):
            skipped.append(tag)
            inside[tag] += 1
            here.children.append(Node("hr", here))  # text on both sides stays apart
        elif tag == "a":
            links = 1
        elif tag in BLOCK and tag not in ("html", "body"):
            if here.tag in HEADINGS and tag in HEADINGS:
                close(here)
            node = Node(tag, here)
            here.children.append(node)
            here, links = node, 0
            opened[tag] += 1
    if at < n and not skipped:
        here.children.append((page[at:], links > 0))
    return root


def _order(root: Node) -> list[Node]:
    """All elements, parents before children."""
    out = [root]
    for node in out:
        out.extend(c for c in node.children if isinstance(c, Node))
    return out


def _squeezed(text: str) -> str:
    return " ".join(html.unescape(_NOUGHTS.sub(r"&#\1", _HUGE.sub("\ufffd", text))).split())


def score(root: Node) -> list[Node]:
    """Gives each element its points, text length and linked length; returns the containers that got points."""
    nodes = _order(root)
    for node in reversed(nodes):
        own = [c for c in node.children if not isinstance(c, Node)]
        text = _squeezed("".join(c[0] for c in own))
        node.length += len(text)
        node.linked += len(_squeezed(" ".join(c[0] for c in own if c[1]))) if any(c[1] for c in own) else 0
        if len(text) >= 25 and node.tag in PARAGRAPHS:
            points = 1 + text.count(",") + text.count("，") + text.count("、") + min(len(text) / 100, 3)
            points *= 1 - min(1.0, sum(len(_squeezed(c[0])) for c in own if c[1]) / len(text))
            above, level = (node if node.tag not in ("p", "pre", "li", "dd", "figcaption", "blockquote", "td") else node.parent), 0
            while above is not None and level < LEVELS:
                above.points += points / (1, 2)[level] if level < 2 else points / (3 * level)
                above, level = above.parent, level + 1
        if node.parent is not None:
            node.parent.length += node.length
            node.parent.linked += node.linked
    return [x for x in nodes if x.points > 0]


def _headings(header: Node) -> list[Node]:
    """The topmost headings of a header, in page order."""
    out: list[Node] = []
    todo = [header]
    while todo:
        x = todo.pop()
        if x.tag in HEADINGS:
            out.append(x)
        else:
            todo.extend(c for c in reversed(x.children) if isinstance(c, Node))
    return out


def density(node: Node) -> float:
    return min(1.0, node.linked / node.length) if node.length else 0.0


def blocks(node: Node) -> list[str]:
    """The texts of the blocks of an element, in page order; lists of links are left out."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if text := _squeezed("".join(line)):
            out.append(text)
        line.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, tuple):
            line.append(x[0])
        else:
            flush()
            if x is not node and x.tag in ("ul", "ol", "dl", "table", "div", "section") and density(x) > 0.6 and x.points < 1:
                continue
            todo.append(None)
            # of a header inside the article its headings are the article's; bylines and buttons aren't
            todo.extend(reversed(_headings(x) if x.tag == "header" else x.children))
    flush()
    return out


def extract(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    root = parse(page)
    containers = score(root)
    if not containers:  # no paragraph of a length: the articles there are, else what prose there is
        own = [x for x in _order(root) if x.tag in ("article", "main") and x.length]
        best = [max(own, key=lambda x: x.length)] if own else [root]
        return "\n".join(blocks(best[0])) if density(best[0]) < 0.5 else ""
    top = max(containers, key=lambda x: x.points * (1 - density(x)))  # the first of equal ones
    whole = top
    above = top
    while above is not None:
        if above.tag in ("article", "main"):
            whole = above
            if above.tag == "article":
                break
        above = above.parent
    if whole is root or whole.parent is None:
        return "\n".join(blocks(whole))
    least = max(3.0, 0.2 * top.points * (1 - density(top)))
    kept: list[str] = []
    for x in whole.parent.children:
        if x is whole:
            kept += blocks(x)
        elif isinstance(x, Node) and x.tag not in HEADINGS and x.length:
            prose = x.tag == "p" and (x.length > 80 and density(x) < 0.25)
            if density(x) < 0.5 and (x.points * (1 - density(x)) >= least or prose) and (whole.tag == "article") <= (x.tag == "article"):
                kept += blocks(x)
    return "\n".join(kept)


def main_text(df: DataFrame, page: str = "html", out: str = "text", length: str = "n_chars") -> DataFrame:
    """df without the pages, with each one's main text and its code points; columns of those names are replaced."""
    bound_batches(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name not in (page, out, length)]
    schema = T.StructType([*kept, T.StructField(out, T.StringType()), T.StructField(length, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, page):
            at = batch.schema.get_field_index
            texts = [extract(x) for x in batch.column(at(page)).to_pylist()]
            arrays = [batch.column(at(f.name)) for f in kept] + [pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in schema])

    return df.mapInArrow(run, schema)
