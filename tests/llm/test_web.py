"""HTML extraction and URL filters."""

import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from strataweave.llm import html, queries, urls

STORY = "<article><header><h1>A &amp; B</h1></header><p>To <b>be</b>,<br>or\n not.<p>In short.</article>"
PAGES = [
    (f'<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href="/">Home</a></nav><!-- x -->{STORY}<footer>&copy; us</footer></body></html>', "A & B To be, or not. In short."),
    (f'<body><div class="ad">Buy now</div>{STORY}<aside>More</aside><form>Your mail <input></form><section id="comments"><p>Great read, thanks!</p></section>', "A & B To be, or not. In short."),
    ('<script>var t="</p><p>no</p>";</script><article><h1>Title</h1><aside>Tweet</aside><p>Body text here.</p></article>', "Title Body text here."),
    ("", ""),
    (None, ""),
    ("<article><p>cut off &amp", "cut off &"),
    ("<article><p>open tag <a href='x", "open tag"),
    ("<article><p>1 < 2 &lt; 3 &#x41;&#65;&nbsp;x</p></article>", "1 < 2 < 3 AA x"),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_main_text(page, want):
    assert html.main_text(page or "", html.trained_tree()) == want


def test_tree_on_held_out_pages():
    x, y = html.training_blocks(120, seed=99)
    assert (html.trained_tree().predict(x) == y).mean() > 0.97


def words(n, start=0):
    return " ".join(f"w{start + i}" for i in range(n))


LAYOUTS = [
    # no element says where the article is; the menu is plain words, the copyright a short last block
    (f"<body><div>Home News Sport</div><div><h1>A title here</h1><p>{words(40)}</p><p>{words(30, 50)}</p></div><div>Copyright 2024 Example Ltd. All rights reserved.</div></body>", f"A title here {words(40)} {words(30, 50)}"),
    (f'<ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul><table><tr><td><h1>On things</h1><p>{words(60)}</p><p>{words(8, 60)}</p><p>{words(45, 70)}</p></td></tr></table><p>(c) us</p>', f"On things {words(60)} {words(8, 60)} {words(45, 70)}"),
    # classes that name other things
    (f'<body><div class="legal-analysis"><h1>Law</h1><p>{words(40)}</p><p>{words(30, 50)}</p></div></body>', f"Law {words(40)} {words(30, 50)}"),
    (f'<body><div class="social-policy page"><p>{words(40)}</p><p>{words(30, 50)}</p></div><div>(c) 2024</div></body>', f"{words(40)} {words(30, 50)}"),
    (f'<article><section class="related-work"><p>{words(20)}</p><p>short one</p></section></article><div>Buy this now</div>', f"{words(20)} short one"),
    # landmarks, comments as articles in the article, hidden parts
    (f'<div role="navigation">Home</div><div role="main"><p>{words(20)}</p></div><div role="contentinfo">us</div>', words(20)),
    (f'<article><h1>T</h1><p>{words(25)}</p><section><article><div><a href="/u">Ann</a></div><p>Great read, thanks a lot!</p></article></section></article>', f"T {words(25)}"),
    (f'<main><p>{words(25)}</p><p hidden>{words(9, 30)}</p></main>', words(25)),
]


@pytest.mark.parametrize(("page", "want"), LAYOUTS)
def test_layouts(page, want):
    assert html.main_text(page, html.trained_tree()) == want


class Plain(HTMLParser):
    """The text of article elements, block by block, by the library's parser."""

    def __init__(self):
        super().__init__()
        self.inside, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.parts += ["\0"] * (tag not in ("b", "i", "a", "em", "span"))

    def handle_endtag(self, tag):
        self.parts += ["\0"] * (tag not in ("b", "i", "a", "em", "span"))
        self.inside -= tag == "article"

    def handle_data(self, data):
        self.parts += [data] * (self.inside > 0)


def test_query_against_plain_parser(spark):
    """The pages of the table say where their article is."""
    folder, want = "/root/testdata/sf0.01", {}
    for r in spark.read.parquet(f"{folder}/pages.parquet").collect():
        plain = Plain()
        plain.feed(r["html"] or "")
        blocks = [re.sub(r"\s+", " ", x).strip() for x in "".join(plain.parts).split("\0")]
        text = " ".join(x for x in blocks if x)
        want[r["page_id"]] = (r["url"], text, len(text))
    assert {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in queries.op7_html(spark, folder).collect()} == want


def test_long_and_deep_pages():
    deep = "<div>" * 5000 + f"<p>{words(30)}</p>" + "</div>" * 5000
    assert html.main_text(f"<article>{deep}</article>", html.trained_tree()) == words(30)
    long_ = "".join(f"<p>{words(20, i)}</p>" for i in range(3000))
    assert html.main_text(f"<article>{long_}</article>", html.trained_tree()).count("w") == 60_000


def test_extract(spark):
    pages = spark.createDataFrame([(i, f"u{i}", p) for i, (p, _) in enumerate(PAGES)] * 2, "page_id bigint, url string, html string")
    got = html.extract(pages, F.struct("page_id", "url")).collect()
    assert sorted((r["row"]["page_id"], r["text"]) for r in got) == sorted((i, w) for i, (_, w) in enumerate(PAGES) for _ in range(2))
    assert html.extract(pages.limit(0), F.struct("page_id")).count() == 0


URLS = [
    ("http://a.Example.ORG/es/1?q#z", "a.example.org", "/es/1", "example.org/es/", "block"),
    ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
    ("http://example.org/EN/12", "example.org", "/EN/12", "org/", "allow"),
    ("http://notexample.org/en/12", "notexample.org", "/en/12", "org/", "allow"),
    ("https://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"),
    ("https://x.com/de/casino", "x.com", "/de/casino", "com/de/", "block"),
    ("https://x.com/de", "x.com", "/de", None, "allow"),
    ("https://www.casino-win.net/", "www.casino-win.net", "/", None, "block"),
    ("https://casinowin.net", "casinowin.net", "", None, "allow"),
    ("http://org", "org", "", None, "allow"),
    ("https://casino.org/", "casino.org", "/", "org/", "allow"),
    ("mailto:me@x.org", "", "", None, "allow"),
    ("//x.org/", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("http://", "", "", None, "allow"),
    ("x?u=http://b.org/y", "b.org", "/y", "org/", "allow"),
]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u[0], "h") for i, u in enumerate(URLS)], "page_id bigint, url string, host string")
    got = {r["page_id"]: tuple(r["url_verdict"]) for r in urls.filter_urls(pages).collect()}
    assert got == {i: u[1:] for i, u in enumerate(URLS)}
    assert urls.filter_urls(pages.limit(0)).count() == 0
    assert {r["url_verdict"]["verdict"] for r in urls.filter_urls(pages, [], "block").collect()} == {"block"}
    long_ = spark.createDataFrame([(1, "https://a.org/" + "x/" * 50_000, "p", "q")], "page_id bigint, url string, page string, fits string")
    got = urls.filter_urls(long_).first()
    assert (got["page"], got["fits"], got["url_verdict"]["rule"], len(got["url_verdict"]["path"])) == ("p", "q", "org/", 100_001)


def test_rarest_token_index():
    rules = [urls.site_rule("block", "example.org", "/es/"), urls.Rule("all", "block", "zzz")]
    assert urls.index(rules, {"example": 9, "org": 5, "es": 7}) == {"org": [0], "": [1]}
