"""Main text against an independent reader on all pages of the table, and the rules on class names, languages and links."""

from html.parser import HTMLParser

import duckdb
import pytest

from segmentary.llm import html_text as H

GOOD = "This is the first good paragraph of the page and it has many of the words that you would know from all that is there, for it was in the book. " * 2
RUSSIAN = "Это первый абзац страницы. Он написан на русском языке и довольно длинный, чтобы правила сочли его текстом. " * 3


class Reader(HTMLParser):
    """Blocks of the article, without what is never main text; for well-formed pages."""

    SKIP = frozenset(["nav", "footer", "aside", "form", "script", "style", "select", "button", "noscript", "template"])
    EMPTY = frozenset(["br", "img", "hr", "meta", "link", "input"])

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.blocks, self.now, self.open = [], "", []
        self.feed(page)
        self.close()
        self.end()

    def end(self):
        if " ".join(self.now.split()):
            self.blocks.append(" ".join(self.now.split()))
        self.now = ""

    def handle_starttag(self, tag, attrs):
        bad = tag in self.SKIP or any(k in ("class", "id") and v and {"ad", "comment", "comments"} & set(v.replace("-", " ").split()) for k, v in attrs)
        if tag in H.BLOCK or bad:
            self.end()
        if tag == "br":
            self.now += " "
        elif tag not in self.EMPTY:
            self.open.append((tag, bad))

    def handle_endtag(self, tag):
        while tag in [t for t, _ in self.open]:
            if tag in H.BLOCK or self.open[-1][1]:
                self.end()
            if self.open.pop()[0] == tag:
                break

    def handle_data(self, data):
        if any(t == "article" for t, _ in self.open) and not any(bad for _, bad in self.open):
            self.now += data


def test_all_pages_as_an_independent_reader():
    pages = duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' WHERE html IS NOT NULL").fetchall()
    same = sum(H.main_text(page) == "\n\n".join(Reader(page).blocks) for (page,) in pages)
    assert len(pages) > 100 and same >= 0.98 * len(pages), (same, len(pages))


@pytest.mark.parametrize("name", ["page with-sidebar", "layout no-sidebar", "has-ad content", "sidebar"])
def test_wrappers_named_after_the_layout(name):
    page = f'<nav><a href=x>home</a></nav><div class="{name}"><p>{GOOD}</p><p>{GOOD}</p></div><div class="footer-links"><a href=x>imprint</a></div>'
    assert H.main_text(page) == f"{GOOD.strip()}\n\n{GOOD.strip()}"


@pytest.mark.parametrize("name", ["sidebar", "cookie-notice", "main-nav", "ad_slot", "social-links", "x comments"])
def test_names_of_boilerplate(name):
    assert H.main_text(f'<p>{GOOD}</p><div class="{name}"><p>{GOOD}</p></div><p>{GOOD}</p>') == f"{GOOD.strip()}\n\n{GOOD.strip()}"


def test_language_without_stop_words():
    assert H.main_text(f"<nav>меню сайта</nav><div><p>{RUSSIAN}</p><p>Да.</p><p>{RUSSIAN}</p></div>") == f"{RUSSIAN.strip()}\n\nДа.\n\n{RUSSIAN.strip()}"


def test_links_in_an_article():
    page = f"<article><p>{GOOD}</p><p><a href=x>{GOOD}</a></p><p>{GOOD}</p><ul><li><a href=y>{GOOD}</a></li></ul></article>"
    assert H.main_text(page) == "\n\n".join([GOOD.strip()] * 3)


def test_very_long_page():
    page = "<article>" + f"<p>{GOOD}</p>" * 20_000 + "<div>" * 5000 + "end"
    assert len(H.main_text(page)) == 20_000 * (len(GOOD.strip()) + 2) + 3
