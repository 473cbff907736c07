import re
import time
from html.parser import HTMLParser

import pytest

from tidewatch.llm import html


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


TEXT = "The house on the hill was old and it had been there for as long as anyone in the village could remember, they said, with the door to the east."


def test_article_with_everything_around_it():
    body = f"""<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies.</div><!-- <p>no</p> -->
    <article><h1>Title &amp; more</h1><p><b>{TEXT}<br>Next</b><p>Short.</p><form><p>Sign up</p></form><aside>Related</aside><script>var t="</p><p>x";</script>
    <div class="comments"><p>{TEXT}</p></div><p>a < b &lt;i&gt; &eacute;\n\n c</p></article><footer>&copy; x</footer>"""
    want = f"Title & more\n{TEXT} Next\nShort.\na < b <i> é c"
    assert html.main_text(page(body)) == want == html.main_text(page(body.replace("article", "div")))


def test_density_decides_and_short_blocks_inherit():
    body = f"<div><a href=x>Home</a> <a href=y>About</a></div><h2>Heading</h2><p>{TEXT}</p><p>Short.</p><p>{TEXT}</p><div><a href=x>More</a> <a>links</a></div><p>Tiny</p>"
    want = f"Heading\n{TEXT}\nShort.\n{TEXT}"
    assert html.main_text(page(body)) == want
    # No tag makes a list of links main text.
    assert html.main_text(page(f"<article>{body}</article>")) == want


@pytest.mark.parametrize(
    ("found", "want"),
    [
        ([(TEXT, 0.0, False, False)], [1]),
        ([(TEXT, 0.5, False, False)], [-1]),  # links
        ([("xyzzy " * 40, 0.0, False, False), ("a", 0.9, False, False)], [-1, -1]),  # long, no stop words: as its neighbour
        ([("xyzzy " * 40, 0.0, False, False), (TEXT, 0.0, False, False)], [1, 1]),
        ([(TEXT[:80], 0.0, False, False)], [1]),  # middling, many stop words
        ([("a", 0.0, False, False), ("b", 0.0, False, True)], [1, 1]),  # nothing decided
        ([(TEXT, 0.0, False, False), ("x", 0.0, False, False), ("y", 0.9, False, False)], [1, -1, -1]),  # as near to both
        ([(TEXT, 0.0, False, False), ("x", 0.0, False, False), ("x", 0.0, False, False), ("x", 0.0, False, False), ("y", 0.9, False, False)], [1, 1, -1, -1, -1]),
        ([("y", 0.9, False, False), ("x", 0.0, False, True), ("x", 0.0, False, False), (TEXT, 0.0, False, False)], [-1, 1, 1, 1]),  # a heading goes with what follows
        ([(TEXT, 0.0, True, False), ("x", 0.0, False, False)], [1]),  # what is marked has no say
    ],
)
def test_rules(found, want):
    assert html.classify(found) == want


def test_broken_pages():
    assert html.main_text("") == "" == html.main_text("<!-- never closed <article>x</article>")
    assert html.main_text("<") == "<" and html.main_text("a <3 b") == "a <3 b"
    assert html.main_text("<article>a<p>b") == "a\nb"
    assert html.main_text("<article>a<script>x") == "a"
    assert html.main_text("<article><p title='>'>a</p></article>") == "a"
    assert html.main_text("<p title=it's>a</p><p data-id=ad title='class=ad'>b</p>") == "a\nb"
    assert html.main_text("<article></div></p>a</article></article>") == "a"
    assert html.main_text("<article>" + "<div>" * 3000 + "x" + "</div>" * 3000 + "</article>") == "x"
    assert html.main_text("<p>&#00065;&#x0041;&#" + "9" * 10_000 + ";") == "AA�"


@pytest.mark.parametrize(
    "page",
    ['<a "' * 250_000, "<head>" * 150_000, "<div>" * 100_000 + "</p>" * 100_000, "<" * 10**6, "<a b=" * 200_000, "&" * 10**6, "<!" * 500_000, "<button>" * 120_000, "<li><b class=x>" * 60_000, "=' " * 300_000, "<p " + "= " * 400_000, "<!--" * 250_000],
    ids=lambda p: p[:12],
)
def test_malformed_pages_take_time_in_proportion(page):
    before = time.process_time()
    html.main_text(page)
    assert time.process_time() - before < 5


class Plain(HTMLParser):
    """The blocks of the table's pages by the library's parser: what stands in no menu, advert or footer."""

    def __init__(self):
        super().__init__()
        self.out, self.text, self.skip = [], [], []

    def end(self):
        words = " ".join("".join(self.text).split())
        self.out += [words] if words else []
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text.append(" ")
        elif tag != "b":
            self.end()
            if tag in ("nav", "footer", "head", "script", "style") or ("class", "ad") in attrs:
                self.skip.append(tag)

    def handle_endtag(self, tag):
        if tag != "b":
            self.end()
            if self.skip and self.skip[-1] == tag:
                self.skip.pop()

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)


def plain(page):
    parser = Plain()
    parser.feed(page)
    parser.close()
    parser.end()
    return "\n".join(parser.out)


def test_pages_of_the_table(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in html.op8_html(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(rows) == len(got) > 200
    for r in rows:
        want = plain(r.html)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)
        assert html.main_text(re.sub("</?article>", "", r.html)) == want


def test_nulls_columns_and_long_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (2, "u", "<p>x"), (3, "v", "<article>" + f"<p>{TEXT}</p>" * 3000)]
    df = spark.createDataFrame(rows, "page_id long, text string, html string")
    got = html.extract(df.withColumnRenamed("text", "_html")).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 1, 3000 * len(TEXT) + 2999]
    assert html.extract(df.limit(0)).count() == 0
