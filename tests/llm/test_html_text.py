"""Main text of pages."""

import html
import re

import pytest

from cardwatch.llm import base, html_text

PAGES = "page_id long, url string, html string"


def page(k, body, menu="<nav><ul><li><a>Home</a><li>News</ul></nav>"):
    return f"<!doctype html><html><head><title>t{k}</title><style>p{{}}</style></head><body>{menu}<div class='ad'>buy</div>{body}<footer>&copy; x</footer></body></html>"


def test_whole_table_equals_the_articles(lm, sf):
    pages = base.table(lm, sf, "pages")
    found = {r.page_id: r for r in html_text.extract(pages).collect()}
    for p in pages.collect():
        article = re.search("<article>(.*?)</article>", p.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", b)).split()) for b in re.split("</?(?:p|h1|br)>", article)]
        expected = "\n\n".join(b for b in blocks if b)
        assert (found[p.page_id].text, found[p.page_id].n_chars) == (expected, len(expected))


@pytest.mark.parametrize("source, text", [
    (None, ""), ("", ""), ("plain < text &lt;b&gt; &amp", "plain < text <b> &"),
    ("<article><h1>A</h1><p>one\n <b>two<p>three<aside>no</aside><div class='x comments'>no</div><ul><li>l1<li>l2</ul>end</article>no", "A\n\none two\n\nthree\n\nl1\n\nl2\n\nend"),
    ("<article><p>x<script>var a='</p>';</script>y<!-- <p> -->z</p><form>f</form>", "x yz"),
    ("<div id=cookie-notice>c</div><div><p title='a > b'>hello</p>tail</div>", "hello\n\ntail"),
    ("<main><p>cut here <b", "cut here <b"),
])
def test_single_pages(source, text):
    assert html_text.main_text(source, {}, frozenset()) == text


@pytest.mark.parametrize("source", [
    '<article title="The hidden cost of X"><p>kept</p></article>', '<article data-note="a hidden gem"><p>kept</p></article>',
    '<body class="has-sidebar"><article><p>kept</p></article></body>', '<main class="main no-sidebar"><p>kept</p></main>',
    '<article data-id="widget-7"><p>kept</p></article>', '<form id="aspnetForm"><article><p>kept</p></article></form>',
    '<article><h1 id="search">kept</h1></article>', '<article class="promo"><p>kept</p></article>',
    '<div class="sidebar"><article><p>kept</p></article></div>', '<div class="menu"><p>no</p></div><div><main><p>kept</p></main></div>',
    '<article><p>kept</p><section class="comments"><article class="comment"><p>no</p></article></section></article>',
    '<article><p>kept</p></article><div id="comments"><article><p>no</p></article></div>',
    '<article><p>kept</p><div hidden>no</div><div hidden="">no</div><p HIDDEN>no</p></article>',
    '<article><p>kept</p><div class="Cookie-Notice x">no</div><div id=widget-7>no</div><div role="navigation">no</div></article>',
    '<article><p>kept</p><article class="comment"><p>no</p></article></article>', '<aside><article><p>no</p></article></aside><article>kept</article>',
])
def test_attributes_are_read_as_attributes(source):
    assert html_text.main_text(source, {}, frozenset()) == "kept"


def test_paragraphs_that_pages_share_stay(frame):
    """Three of six pages share two paragraphs; five of five share one in the middle of their text."""
    shared = "<p>A paragraph that some pages share.</p><p>And a second one.</p>"
    rows = [(k, "http://six.org/x", f"<article><p>Own {k}</p>{shared if k < 3 else ''}<p>End {k}</p></article>") for k in range(6)]
    rows += [(10 + k, "http://five.org/x", f"<article><p>Own {k}</p><p>In all of them.</p><p>End {k}</p></article>") for k in range(5)]
    found = {r.page_id: r.text for r in html_text.extract(frame(rows, PAGES)).collect()}
    assert found[1] == "Own 1\n\nA paragraph that some pages share.\n\nAnd a second one.\n\nEnd 1"
    assert found[4] == "Own 4\n\nEnd 4"
    assert found[12] == "Own 2\n\nIn all of them.\n\nEnd 2"


def test_template_of_a_host_without_articles(frame):
    rows = [(k, "http://h.org/x", page(k, f"<div><p>Same line.</p><p>Own {k}</p>" + "<p>more</p>" * k + "</div>")) for k in range(8)]
    rows += [(100, "http://alone.org/", page(100, "<div><p>Same line.</p></div>")), (101, None, None), rows[0]]
    found = {r.page_id: r.text for r in html_text.extract(frame(rows, PAGES)).collect()}
    assert found[3] == "Own 3\n\nmore\n\nmore\n\nmore"
    assert found[100] == "Same line."
    assert found[101] == ""
    template = html_text.templates(frame([("h.org", r[0], r[2]) for r in rows[:8]], "host string, page long, html string")).first()
    assert len({t.of_class for t in template.tokens}) >= 1
    assert any(t.constant for t in template.tokens)


def test_tokens_out_of_turn_make_a_class_invalid():
    items = html_text.read_page("<div><p>a</p></div>")
    tokens = [html_text.token_of(i) for i in items]
    in_order = {t: (1, k) for k, t in enumerate(tokens)}
    assert html_text.valid_tokens(items, in_order) == set(tokens)
    turned = {t: (1, len(tokens) - 1 - k) for k, t in enumerate(tokens)}
    assert html_text.valid_tokens(items, turned) == set()


def test_hostile_pages_take_linear_time():
    assert html_text.main_text("<div>" * 20_000 + "x", {}, frozenset()) == "x"
    html_text.main_text('<a href="' * 20_000, {}, frozenset())
    html_text.main_text("<" * 50_000 + "</p>" * 20_000, {}, frozenset())


def test_empty_table_and_further_columns(frame):
    assert html_text.extract(frame([], PAGES + ", host string, text string, tokens string")).collect() == []
    one = html_text.extract(frame([(1, "http://a/", "<p>x</p>", "h", "t")], PAGES + ", host string, text string")).first()
    assert (one.text, one.n_chars, one.url) == ("x", 1, "http://a/")


def test_long_pages_keep_the_text_behind_a_thousand_entries(frame):
    def long_page(k):
        entries = "".join(f"<li>Entry {k} {j}</li>" for j in range(1100))
        return f"<html><body><nav><ul>{entries}</ul></nav><article><p>Own text {k}</p></article><div><p>Behind {k}</p></div></body></html>"

    found = {r.page_id: r.text for r in html_text.extract(frame([(k, "http://long.org/x", long_page(k)) for k in range(4)], PAGES)).collect()}
    assert found == {k: f"Own text {k}" for k in range(4)}


def test_an_open_tag_without_its_close_in_the_template_ends_with_its_element():
    items = html_text.read_page("<nav><p>menu</p></nav><article><p>text</p></article>")
    only_open = {html_text.token_of(items[0])}
    assert [i[2] for _, texts in html_text.slots(items, only_open) for i in texts] == ["text"]


def test_blocks_of_the_template_leave_articles(frame):
    def article(k, own):
        return f"<body><article><p>Read us every day.</p><p>{own}</p><div>All rights kept.</div></article><p>x{k}</p></body>"

    rows = [(k, "http://bar.org/x", article(k, f"Own text of the page {k} that says much more than the lines around it")) for k in range(5)]
    rows += [(10 + k, "http://short.org/x", article(k, f"Own {k}")) for k in range(5)]
    # Copies of one article: what is on every page is all there is.
    rows += [(20 + k, "http://copy.org/x", article(0, "Copied")) for k in range(4)]
    # Half of the pages near copies of each other: their own text stays.
    rows += [(30 + k, "http://near.org/x", f"<body><article><p>{'The same long paragraph. ' * 4}</p><p>Part {k}</p></article></body>") for k in range(3)]
    rows += [(33 + k, "http://near.org/x", f"<body><article><p>Another {k}</p></article></body>") for k in range(3)]
    found = {r.page_id: r.text for r in html_text.extract(frame(rows, PAGES)).collect()}
    assert found[2] == "Own text of the page 2 that says much more than the lines around it"
    assert found[12] == "Own 2"
    assert found[22] == "Read us every day.\n\nCopied\n\nAll rights kept."
    assert found[31] == " ".join(["The same long paragraph."] * 4) + "\n\nPart 1"
