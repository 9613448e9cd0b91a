"""Operator 3 against a small extractor of its own, on all given pages, on wrappers and on broken markup."""
import re
import time
from html.parser import HTMLParser

import pytest

from fbrank.llm import html_extract, queries

SF = "/root/testdata/sf0.01"
BLOCK = set("article p div h1 h2 h3 ul ol li br section table tr td th blockquote main".split())
DROP = set("script style nav header footer aside form".split())


class Article(HTMLParser):
    """Text of the article elements, without elements that are out by tag or by a class that is just such a word."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.out, self.open, self.blocks = 0, 0, [], [""]

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "img", "meta", "link", "hr", "input"):
            self.blocks.append("")
            return
        bad = tag in DROP or dict(attrs).get("class") in ("ad", "comments", "share", "sidebar")
        self.open.append((tag, bad))
        self.out += bad
        self.inside += tag == "article"
        if tag in BLOCK:
            self.blocks.append("")

    def handle_endtag(self, tag):
        while self.open and any(t == tag for t, _ in self.open):
            t, bad = self.open.pop()
            self.out -= bad
            self.inside -= t == "article"
            if t in BLOCK:
                self.blocks.append("")
            if t == tag:
                return

    def handle_data(self, data):
        if self.inside and not self.out:
            self.blocks[-1] += data

    def text(self):
        return " ".join(t for b in self.blocks if (t := " ".join(b.split())))


def test_given_pages_equal_an_independent_extractor(spark):
    """Every given page has an article, whose text is the result; blocks that most pages of a host share are the only ones that may go."""
    pages = {r.page_id: r.html for r in queries.table(spark, SF, "pages").collect()}
    got = {r.page_id: r for r in queries.op3_html_extraction(spark, SF).collect()}
    assert set(got) == set(pages)
    for i, page in pages.items():
        p = Article()
        p.feed(page or "")
        assert got[i].text == p.text() and got[i].n_chars == len(got[i].text), i


KEPT = {
    '<body><div class="layout has-sidebar"><article><p>Main text here.</p></article></div></body>': "Main text here.",
    '<div id="page" class="no-sidebar"><main>Main text</main></div>': "Main text",
    '<div class="sidebar-layout content-with-menu"><article>Main text</article></div>': "Main text",
    '<form id="aspnetForm"><nav>menu</nav><article>Main text</article><div class="footer">end</div></form>': "Main text",
    '<div class="modal"><article>Main text</article></div>': "Main text",
    '<article><p class="share-price">A</p><div class="social-policy">B</div><section id="advert-history">C</section></article>': "A B C",
    '<article class="post no-comments has-related">Main text</article>': "Main text",
    '<article>Main text<div class="share">x</div><div class="socialShare">y</div><ul class="share-buttons"><li>z</ul></article>': "Main text",
    '<article>Main text</article><div class="related-posts"><article>teaser</article></div>': "Main text",
    '<article>Main text</article><article class="comment-body">first!</article><div id="comments"><article>second</article></div>': "Main text",
    '<div class="site-footer">x</div><div class="left-sidebar">y</div><div id="cookieBanner">z</div><div class="header-ad">w</div><p>Main text</p>': "Main text",
    "Main &#" + "9" * 6000 + "; text &#00000000000065;": "Main � text A",
    "1 < 2, a <b>b</b> <c": "1 < 2, a b <c",
    'Main <a "text <b>on</b>': 'Main <a "text on',
}


@pytest.mark.parametrize("page", KEPT, ids=range(len(KEPT)))
def test_wrappers_and_words_that_only_look_like_boilerplate(page):
    assert " ".join(t for t, _ in html_extract.blocks_of(page)) == KEPT[page]


LONG = ["<p>text</p>" + "<a " * 333_000, "<div>" * 110_000 + "</b>" * 110_000, '<a "' * 250_000, '<a "' * 250_000 + ">", "<a \"'" * 200_000, "<![CDATA[" * 110_000,
        "]]>" * 50_000 + "<![CDATA[" * 90_000, "<!" * 500_000, "<!--" * 250_000, "<script " * 125_000, "<script>" + "</script " * 110_000, "&#" * 500_000, "<" * 1_000_000,
        "<p>" * 330_000, "<div><b>" * 60_000 + "</div>" * 60_000 + "</b>" * 60_000, '<div class="' + "ad-" * 300_000 + '">x', "<a " + "= " * 500_000 + ">", "word " * 200_000]


@pytest.mark.parametrize("page", LONG, ids=range(len(LONG)))
def test_a_megabyte_of_anything_is_read_in_linear_time(page):
    html_extract.blocks_of(page[:1000])
    start = time.process_time()
    html_extract.blocks_of(page[:1_000_000])
    assert time.process_time() - start < 6  # a third of a million tags takes 2 s; in quadratic time it would be hours


def test_long_pages_pass_through_the_operator(spark):
    rows = [(i, "http://h.example/", p) for i, p in enumerate([*LONG[:2], "<article>" + "word " * 200_000 + "</article>", None, ""])]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 5 and got[2] == ("word " * 200_000).strip() and re.match("text", got[0]) and got[3] == got[4] == ""
