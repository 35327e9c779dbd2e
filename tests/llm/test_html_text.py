import random
import re
import time
from html.parser import HTMLParser

import pytest

from livgrid.llm import html_text, queries

PROSE = "This is a long paragraph of the story, with commas, and it goes on for quite a while so that it counts as prose."


def page(inside, around=("", "")):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var x='</p><p>no';</script></head><body>{around[0]}{inside}{around[1]}</body></html>"


ARTICLE = f"<article><h1>Head &amp; line</h1><p>{PROSE}</p><p>Short.</p></article>"
WANT = f"Head & line\n{PROSE}\nShort."


@pytest.mark.parametrize(
    "noise",
    [
        f"<nav><ul><li><a href=/>Home</a></li></ul><p>{PROSE}</p></nav>", f"<header><p>{PROSE}</p></header>", f"<footer><p>{PROSE}</p></footer>", f"<aside>{PROSE}</aside>", f'<div class="sidebar"><p>{PROSE}</p><p>{PROSE}</p></div>',
        f'<div class="ad">{PROSE}</div>', f'<div id="cookie-notice"><p>{PROSE}</p></div>', f"<form><p>{PROSE}</p><input></form>", f'<section class="comments"><article><p>{PROSE}</p></article><p>{PROSE}</p></section>', f'<div id="comments"><div class="comment"><p>{PROSE}</p></div></div>',
        f"<!-- {PROSE} -->", f"<noscript>{PROSE}</noscript>", f'<div style="display:none"><p>{PROSE}</p></div>', f'<div role="complementary"><p>{PROSE}</p></div>', f"<p hidden>{PROSE}</p>", "<ul><li><a href=1>one two three</a></li><li><a href=2>four five six</a></li></ul>",
    ],
)
def test_noise_is_left_out(noise):
    assert html_text.extract(page(ARTICLE, (noise, ""))) == WANT
    assert html_text.extract(page(ARTICLE, ("", noise))) == WANT
    assert html_text.extract(page(ARTICLE.replace("<p>Short", noise + "<p>Short"))) == WANT


def test_without_semantic_elements():
    inside = f'<div id="top"><a href=1>a</a> <a href=2>b</a></div><div class="content"><h2>Title here</h2><p>{PROSE}</p><p>{PROSE} Again, twice, yes.</p></div><div><a href=3>more links</a></div>'
    assert html_text.extract(page(inside)) == f"Title here\n{PROSE}\n{PROSE} Again, twice, yes."


def test_sections_inside_an_article_stay():
    inside = f"<main><article><section><p>{PROSE}</p></section><section><p>{PROSE} Two.</p><p>End</p></section></article></main>"
    assert html_text.extract(page(inside)) == f"{PROSE}\n{PROSE} Two.\nEnd"


def test_tag_soup_references_and_white_space():
    inside = f"<article><h1>A &am B &lt;c&gt; &#233;&#x41; &nbsp; d</h1><p><b>{PROSE}<br>x\n\t y<p>un<i>closed</i><ul><li>one<li>two</ul>tail</article>"
    assert html_text.extract(page(inside)).split("\n") == ["A &am B <c> éA d", PROSE + " x y", "unclosed", "one", "two", "tail"]


@pytest.mark.parametrize("text", [None, "", "   ", "<", "<p", "<div><div>", "</p></div>", "<!--", "<script>", "plain words only here", "<a href=x>link</a>", "<html></html>", "<" * 5000, "<div>" * 20000 + PROSE, '<p a="' * 300])
def test_odd_pages_do_not_crash(text):
    out = html_text.extract(text)
    assert isinstance(out, str)
    if text == "plain words only here":
        assert out == text
    if text == "<a href=x>link</a>":
        assert out == ""


def test_frames_and_query(spark, sf):
    df = spark.createDataFrame([(1, "u", page(ARTICLE), "x"), (1, "u", page(ARTICLE), "x"), (2, None, None, None), (None, "v", "", "y")], "page_id long, url string, html string, text string")
    rows = html_text.main_text(df).collect()
    assert sorted(r["n_chars"] for r in rows) == [0, 0, len(WANT), len(WANT)] and len(rows[0]) == 4
    assert html_text.main_text(df.limit(0)).count() == 0
    out = queries.op4_html_text(spark, sf)
    assert out.columns == ["page_id", "url", "text", "n_chars"] and out.count() == spark.read.parquet(f"{sf}/pages.parquet").count()


@pytest.mark.parametrize("name", ["side-effects", "share-price", "social-security", "search-results", "related-work", "header-files", "NoticePeriod", "alerting", "comment-on-the-text-of-Kant"])
def test_words_of_the_subject_are_not_boilerplate(name):
    for kind in ("class", "id"):
        inside = ARTICLE.replace("<p>Short.", f'<section {kind}="{name}"><p>{PROSE} More.</p></section><p>Short.')
        assert html_text.extract(page(inside)) == f"Head & line\n{PROSE}\n{PROSE} More.\nShort."


@pytest.mark.parametrize("name", ["share-buttons", "post-comments", "siteFooter", "related_posts", "cookie-notice top", "x ad-slot-3", "SIDEBAR", "newsletter-signup-form", "sr-only", "comments-area"])
def test_compounds_of_boilerplate_are_left_out(name):
    assert html_text.extract(page(ARTICLE.replace("<p>Short", f'<div class="{name}"><p>{PROSE} More.</p></div><p>Short'))) == WANT


class Plain(HTMLParser):
    """Every element of a page without omitted end tags, as lists (tag, attributes, children)."""

    def __init__(self, text):
        super().__init__()
        self.root = self.here = ("html", {}, [], None)
        self.feed(text)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = (tag, dict(attrs), [], self.here)
        self.here[2].append(node)
        if tag not in html_text.VOID:
            self.here = node

    def handle_endtag(self, tag):
        if self.here[0] == tag:
            self.here = self.here[3]

    def handle_data(self, data):
        self.here[2].append(data)


def plain_extract(text):
    """Main text with every number counted anew where it is asked for."""
    inner = lambda x: [c for c in x[2] if not isinstance(c, str)]
    in_article = lambda x: x is not None and (x[0] in ("article", "main") or in_article(x[3]))

    def gone(x):
        words = lambda v: [[w.lower() for w in re.findall("[A-Z]?[a-z]+|[A-Z]+|[0-9]+", t)] for t in (v or "").split()]
        marked = any(set(t) & html_text.BOILERPLATE and all(w in html_text.BOILERPLATE | html_text.QUALIFIERS or w.isdigit() for w in t) for k in ("class", "id") for t in words(x[1].get(k)))
        return x[0] in html_text.SKIP | html_text.RAW or x[0] == "header" and not in_article(x[3]) or x[0] not in html_text.KEPT_WHOLE and (marked or "hidden" in x[1] or x[1].get("role") in html_text.ROLES)

    def runs(x):
        """Texts (text, in a link) and block elements of an element, in order."""
        for c in x[2]:
            if isinstance(c, str):
                yield c, False
            elif c[0] in ("br", "img"):
                yield " ", False
            elif gone(c):
                yield (" ", False) if c[0] in html_text.RAW else ("hr", {}, [], x)
            elif c[0] in html_text.BLOCK and c[0] not in ("html", "body"):
                yield c
            else:
                for r in runs(c):
                    yield (r[0], r[1] or c[0] == "a") if len(r) == 2 else r

    squeezed = lambda t: " ".join(t.split())
    own = lambda x: squeezed("".join(r[0] for r in runs(x) if len(r) == 2))
    linked_own = lambda x: [r[0] for r in runs(x) if len(r) == 2 and r[1]]
    blocks_of = lambda x: [r for r in runs(x) if len(r) == 4]

    def every(x):
        return [x] + [y for b in blocks_of(x) for y in every(b)]

    def up(x):
        x = x[3]
        while x is not None and x[3] is not None and (x[0] not in html_text.BLOCK or x[0] in ("html", "body")):
            x = x[3]
        return x

    root = Plain(text).root
    nodes = every(root)
    length = lambda x: sum(len(own(y)) for y in every(x))
    density = lambda x: min(1.0, sum(len(squeezed(" ".join(linked_own(y)))) for y in every(x)) / length(x)) if length(x) else 0.0
    points = {id(x): 0.0 for x in nodes}
    for x in reversed(nodes):
        t = own(x)
        if len(t) >= 25 and x[0] in html_text.PARAGRAPHS:
            gain = (1 + t.count(",") + min(len(t) / 100, 3)) * (1 - min(1.0, sum(len(squeezed(v)) for v in linked_own(x)) / len(t)))
            to = up(x) if x[0] in ("p", "pre", "li", "dd", "figcaption", "blockquote", "td") else x
            for share in (1, 1 / 2, 1 / 6, 1 / 9, 1 / 12, 1 / 15, 1 / 18, 1 / 21):
                if to is not None:
                    points[id(to)] += gain * share
                    to = up(to)
    worth = lambda x: points[id(x)] * (1 - density(x))

    def texts(x, top=True):
        if not top and x[0] in ("ul", "ol", "dl", "table", "div", "section") and density(x) > 0.6 and points[id(x)] < 1:
            return []
        out, line = [], ""
        for r in runs(x):
            if len(r) == 2:
                line += r[0]
            else:
                out += [squeezed(line)] + texts(r, False)
                line = ""
        return [t for t in [*out, squeezed(line)] if t]

    some = [x for x in nodes if points[id(x)] > 0]
    if not some:
        articles = [x for x in nodes if x[0] in ("article", "main") and length(x)]
        best = max(articles, key=length) if articles else root
        return "\n".join(texts(best)) if density(best) < 0.5 else ""
    whole = top = max(some, key=lambda x: round(worth(x), 9))
    above = top
    while above is not None:
        if above[0] in ("article", "main"):
            whole = above
            if above[0] == "article":
                break
        above = up(above)
    if up(whole) is None:
        return "\n".join(texts(whole))
    kept = []
    for x in blocks_of(up(whole)):
        good = x[0] not in html_text.HEADINGS and length(x) and density(x) < 0.5 and (worth(x) >= max(3.0, 0.2 * worth(top)) or x[0] == "p" and length(x) > 80 and density(x) < 0.25) and (whole[0] == "article") <= (x[0] == "article")
        if x is whole or good:
            kept += texts(x)
    return "\n".join(kept)


def random_page(rng, depth=0):
    """A page of nested elements whose end tags are all there."""
    words = lambda: " ".join(rng.choice(("alpha", "beta,", "gamma", "delta.", "&amp;", "é")) for _ in range(rng.choice((1, 3, 8, 30))))
    inline = lambda: rng.choice((words(), f"<b>{words()}</b>", f'<a href="x">{words()}</a>', f"{words()}<br>{words()}", f"<span>{words()} <i>{words()}</i></span>"))
    out = ""
    for _ in range(rng.choice((1, 2, 4))):
        kind = rng.choice(("p", "p", "p", "div", "div", "section", "ul", "h2", "blockquote", "nav", "aside", "article", "text", "header"))
        mark = rng.choice(("", "", "", "", ' class="share-price"', ' class="sidebar left"', ' id="comments"'))
        if kind == "text" or depth > 5:
            out += inline()
        elif kind in ("p", "h2"):
            out += f"<{kind}>{inline()} {inline()}</{kind}>"
        elif kind == "ul":
            out += "<ul>" + "".join(f"<li>{inline()}</li>" for _ in range(rng.randrange(4))) + "</ul>"
        elif kind == "header":
            out += f"<section>{inline()}</section>"
        else:
            out += f"<{kind}{mark}>{random_page(rng, depth + 1)}</{kind}>"
    return out


def test_random_pages_equal_the_plain_version():
    rng = random.Random(6)
    for _ in range(400):
        text = page(random_page(rng))
        assert html_text.extract(text) == plain_extract(text), text


def test_the_whole_table_equals_the_plain_version(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.op4_html_text(spark, sf).collect()
    assert {r["page_id"]: r["text"] for r in rows} == {i: plain_extract(t or "") for i, t in pages.items()} and all(r["n_chars"] == len(r["text"]) for r in rows)


@pytest.mark.parametrize(
    "piece",
    ["<a ", f"<div><p>{PROSE}</p>", "<blockquote>", "<div><li>x", "</p>", "<svg/>", "<nav><div></p>", "<article><header><h1>", f"<article><p>{PROSE}</p>", "<ul><li>", "<h1><div>", "&#9", "<a b=\"", "<table><tr><td>"],
)
def test_time_grows_in_proportion_to_the_page(piece):
    def seconds(n):
        began = time.perf_counter()
        html_text.extract("<div>" * (n // 10) + piece * n)
        return time.perf_counter() - began

    seconds(500)
    assert seconds(32_000) < 8 * seconds(8_000) + 1


def test_references_to_numbers_without_end():
    assert html_text.extract(f"<p>{PROSE} &#{'9' * 6000}; &#x{'F' * 6000}; &#{'0' * 6000}65;</p>") == f"{PROSE} \ufffd \ufffd A"
