"""Main text of pages by tag-path ratios: what belongs to an article stays, and ratios rather than names decide."""

import html as htmllib
import re

import pytest

from granary.llm import html_text, queries
from granary.llm.common import table

SF = "/root/testdata/sf0.01"
LONG = ("This is a sentence, with signs in it. " * 26).strip()
ITEMS = {
    "list": ("<ul><li>One item</li><li>Two</li></ul>", "One item\nTwo"),
    "table": "<table><tr><td>a</td><td>b</td></tr></table>|a\nb".split("|"),
    "quote": ("<blockquote>Said so</blockquote>", "Said so"),
    "pre": ("<pre>code  here</pre>", "code here"),
    "caption": ("<figure><img src=x><figcaption>A caption</figcaption></figure>", "A caption"),
    "div": ("<div>Short</div>", "Short"),
}


def page(body):
    return f'<html><body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>News</a></li></ul></nav><div class="ad">Buy this now, it is good.</div>{body}<footer>&copy; all rights, reserved here.</footer></body></html>'


def text(body):
    return html_text.main_text(page(body))


@pytest.mark.parametrize("name", ITEMS)
@pytest.mark.parametrize("tag", ["article", "div", "section"])
def test_what_stands_beside_the_text_belongs_to_it(name, tag):
    item, said = ITEMS[name]
    assert text(f"<{tag}><p>{LONG}</p> {item}</{tag}>") == f"{LONG}\n{said}"
    assert text(f"<{tag}>{item}<p>{LONG}</p></{tag}>") == f"{said}\n{LONG}"


def test_dates_and_lists_of_links():
    assert text(f"<article><div>3 May 2020</div><p>{LONG}</p></article>") == f"3 May 2020\n{LONG}"
    links = "<ul><li><a href=x>See this</a></li><li><a href=y>And that</a></li></ul>"
    assert text(f"<article><p>{LONG}</p>{links}<p>{LONG}</p></article>") == f"{LONG}\nSee this\nAnd that\n{LONG}"
    assert text(f"<div><p>{LONG}</p><p>{LONG}</p>{links}</div>") == f"{LONG}\n{LONG}"


@pytest.mark.parametrize("name", ["post comment-policy", "layout-sidebar", "sidebar", "comments", "ad", "widget-text"])
def test_names_do_not_veto_the_article(name):
    assert text(f'<div class="{name}"><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div>') == f"Title\n{LONG}\n{LONG}"
    assert text(f"<form><p>{LONG}</p><p>{LONG}</p></form>") == f"{LONG}\n{LONG}"


def test_parts_that_are_no_article():
    both = f"{LONG}\n{LONG}"
    for part in (
        f'<div class="comments"><p>{LONG}</p><p>{LONG[:500]}</p></div>',
        f'<section id="comment-list"><div><p>{LONG[:400]}</p></div><div><p>{LONG[:300]}</p></div></section>',
        "<form><p>Enter your mail, please.</p><input></form>",
        "<aside><p>About us, shortly. We are here.</p></aside>",
        '<div class="cookie-notice"><p>We use cookies, as all do.</p></div>',
        '<ul class="related"><li><a href=1>Related one</a></li><li><a href=2>Related two</a></li></ul>',
        "<footer><p>Some rights, reserved.</p></footer>",
    ):
        assert text(f"<div><p>{LONG}</p><p>{LONG}</p>{part}</div>") == both
        assert text(f"<div><div><p>{LONG}</p><p>{LONG}</p></div>{part}</div>") == both
        assert text(f"<article><p>{LONG}</p><p>{LONG}</p></article>{part}") == both
    assert text(f"<article><p>{LONG}</p></article><ul>" + f"<li><p>{LONG[:300]}</p></li>" * 3 + "</ul>") == LONG


def test_broken_markup():
    for button in ("button", "select", "video"):
        assert text(f"<{button}>Menu <article><p>{LONG}</p></article><div><{button}>x</{button}></div>") == LONG
        assert text(f"<{button}>Menu <div><p>{LONG}</p><p>{LONG}</p></div><div><{button}>x</{button}></div>") == f"{LONG}\n{LONG}"
    assert text(f'<script src=/js/>var a="leak, this one. "</script><article><p>{LONG}</p></article>') == LONG
    assert text(f'<script src="a"/><article><p>{LONG}</p></article>') == LONG
    assert text(f"<article><!--><p>{LONG}</p><!-- x --></article>") == text(f"<article><!---><p>{LONG}</p><!-- x --!></article>") == LONG
    assert text(f"<svg><svg/><text>no</text></svg><article><p>{LONG}</p></article>") == LONG


def article(page):
    """What the made pages hold in their article element, without the operator."""
    inside = re.sub(r"<br>", " ", re.search(r"<article>(.*)</article>", page, re.S)[1])
    parts = (re.sub(r"[ \t\r\n]+", " ", htmllib.unescape(re.sub(r"<[^>]+>", "", b))).strip() for b in re.split(r"</?(?:p|h1)[^>]*>", inside))
    return "\n".join(p for p in parts if p)


def test_op7_is_the_article_of_made_pages(spark):
    pages = {r.page_id: r for r in table(spark, SF, "pages").collect()}
    got = queries.op7_html_main_text(spark, SF).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        assert (r.text, r.url, r.n_chars) == (article(pages[r.page_id].html), pages[r.page_id].url, len(r.text))


def test_ratios_decide(spark, monkeypatch):
    pages = [r.html for r in table(spark, SF, "pages").limit(100).collect()]
    found = [html_text.main_text(p) for p in pages]
    monkeypatch.setattr(html_text, "path_scores", lambda parts, sigma=1.0: {p.path: p.weight for p in parts})
    assert sum(html_text.main_text(p) != f for p, f in zip(pages, found, strict=True)) >= 50  # by names alone
    monkeypatch.undo()
    monkeypatch.setattr(html_text, "ASIDE", frozenset())
    monkeypatch.setattr(html_text, "CHROME", frozenset())
    nameless = [html_text.main_text(p) for p in pages]
    assert all(set(f.split("\n")) <= set(n.split("\n")) for f, n in zip(found, nameless, strict=True))
    assert sum(map(len, nameless)) <= 1.01 * sum(map(len, found))
