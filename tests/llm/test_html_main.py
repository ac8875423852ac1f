"""Main text on hand-made pages whose article is known, on planted pages, and against an independent slow parser."""

import random
import re
from html.parser import HTMLParser

import pytest

from tessera.llm.html_main import extract, main_text

LONG = "It was, by any account, a long and winding afternoon, and nobody in the village thought otherwise."


def test_article_only():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
    <header><h2>Site</h2></header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- ad --><div class="ad">Buy, buy, buy now, really.</div>
    <article><h1>Head &amp; line</h1><p><b>{LONG}<br>More&nbsp;text  here.<p>{LONG}</p><ul><li>one thing</li><li>another</li></ul>
    <form><input><p>Sign up, now</p></form><aside><p>{LONG}</p></aside></article>
    <div id="comments"><p>{LONG} I disagree.</p></div><div class="cookie-notice">{LONG}</div><div class="sidebar">{LONG}</div>
    <footer>&copy; me</footer></body></html>"""
    assert main_text(page) == "\n".join(["Head & line", f"{LONG} More text here.", LONG, "one thing", "another"])


def test_containers_without_names():
    side = "".join(f'<li><a href="/{i}">Some other story, with a longish name {i}</a></li>' for i in range(20))
    page = f"<body><table><tr><td><ul>{side}</ul></td><td><p>{LONG}</p><p>{LONG} Twice.</p><p>Short.</p></td></tr></table><div>small print</div>"
    assert main_text(page) == f"{LONG}\n{LONG} Twice.\nShort."


@pytest.mark.parametrize(
    "opening",
    ['<div id="main" class="content with-sidebar">', '<div class="post no-comments share">', '<div class="sidebar-layout">', '<section class="post comments-open">', '<article class="has-sidebar">', '<div class="nav-wrapper">'],
)
def test_misleading_names_lose_no_article(opening):
    body = "".join(f"<p>{LONG} {i}.</p>" for i in range(6))
    page = f"<body><div class='teaser'>Buy now.</div>{opening}{body}</{opening[1:].split()[0]}><div class='comment-list'><p>{LONG} I disagree, strongly.</p></div><div class='promo'>{LONG}</div></body>"
    assert main_text(page) == "\n".join(f"{LONG} {i}." for i in range(6))


def test_names_inside_a_sentence():
    page = f'<article><p>{LONG} Open the <span class="menu">File menu</span> and <em class="alert">wait</em>.</p><p>{LONG}</p><p><span class="share">Share this page</span></p></article>'
    assert main_text(page) == f"{LONG} Open the File menu and wait.\n{LONG}"


def test_blocks_stay_apart_where_something_was_cut():
    page = f'<article><p>{LONG}</p><div>First words here <div class="advert">Buy</div> second words here</div></article>'
    assert main_text(page) == f"{LONG}\nFirst words here\nsecond words here"


def test_broken_and_empty():
    assert main_text(None) == main_text("") == main_text("<p></p>") == main_text("<script>x<p>y</p>") == ""
    assert main_text("just text") == "just text"
    assert main_text("<article><p>Tiny.</article>") == "Tiny."
    assert main_text("<article><p>a < b and c</p>") == "a < b and c"
    assert main_text("<div><nav><p>x</nav><article><p>" + LONG + "</p></article>") == LONG
    assert len(main_text("<div>" * 3000 + f"<p>{LONG}</p>")) == len(LONG)
    assert main_text("<p title='x" + "<b" * 5000) == "<p title='x" + "<b" * 5000


def test_rows(spark):
    rows = [(1, "u", f"<p>{LONG}</p>", "x"), (1, "u", f"<p>{LONG}</p>", "x"), (2, None, None, None), (None, "v", "", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, extract(pages).collect()), key=repr)
    assert got == sorted([(1, "u", LONG, len(LONG))] * 2 + [(2, None, "", 0), (None, "v", "", 0)], key=repr)
    assert extract(pages.where("false")).count() == 0


class Slow(HTMLParser):
    """All text of the article element outside scripts, block by block: a page's truth where the article is marked."""

    BLOCKS = {"article", "p", "h1", "h2", "li", "ul", "blockquote", "div"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.skip, self.out, self.run = 0, 0, [], []

    def end(self):
        text = " ".join("".join(self.run).split())
        self.run = []
        self.out += [text] if text and self.inside else []

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCKS:
            self.end()
        self.inside += tag == "article"
        self.skip += tag in ("script", "style", "aside", "form")
        if tag == "br":
            self.run.append(" ")

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.end()
        self.inside -= tag == "article"
        self.skip -= tag in ("script", "style", "aside", "form")

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.run.append(data)


def planted(rng):
    words = "stone, river and the old mill; people came, slowly, from far away places to see what was left of it &amp; more".split()
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    paragraph = lambda: f"<p>{sentence(rng.randrange(3, 60))}{' <b>bold</b> <i>and</i> words' * rng.randrange(2)}</p>"
    inner = [f"<h1>{sentence(5)}</h1>", *[paragraph() for _ in range(rng.randrange(2, 9))]]
    inner.insert(rng.randrange(1, len(inner)), rng.choice(["<ul><li>one, two</li><li>three</li></ul>", f"<blockquote>{sentence(12)}</blockquote>", f"<script>var x='{sentence(4)}'</script>", f"<aside>{paragraph()}</aside>", "<form><p>Join, now</p></form>", ""]))
    junk = [f'<nav><ul>{"".join(f"<li><a href=/{i}>{sentence(3)}</a></li>" for i in range(6))}</ul></nav>', f'<div class="ad">{sentence(9)}</div>', f"<header><p>{sentence(6)}</p></header>"]
    after = [f"<footer>{sentence(20)}</footer>", f'<div class="comments">{paragraph() * 3}</div>', f'<div id="sidebar">{paragraph()}</div>', f'<div class="cookie-notice">{paragraph()}</div>']
    tag = rng.choice(["article", "article class='post'", "article id='main' class='entry with-sidebar'"])
    return f"<html><body>{''.join(rng.sample(junk, 2))}<{tag}>{''.join(inner)}</article>{''.join(rng.sample(after, 3))}</body></html>"


def test_planted_pages_against_a_slow_parser():
    rng = random.Random(6)
    tokens = lambda t: re.findall(r"\S+", t)
    found = wanted = right = exact = 0
    for _ in range(200):
        page = planted(rng)
        slow = Slow()
        slow.feed(page)
        slow.end()
        want, got = "\n".join(slow.out), main_text(page)
        exact += want == got
        a, b = tokens(want), tokens(got)
        found, wanted = found + len(b), wanted + len(a)
        right += sum(min(a.count(x), b.count(x)) for x in set(a))
    assert right / wanted > 0.99 and right / found > 0.99 and exact >= 190
