import html
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from dossier.functions.html import anchors, body_text, decode_entities
from dossier.functions.urls import resolve_url
from dossier.operators import pages
from dossier.sinks.stage import new_folder
from dossier.sources import page_store
from dossier.sources.page_store import store_page_texts

HEADINGS = {"h1", "h2", "h3", "h4", "h5"}
# Elements that end an open paragraph.
BLOCKS = set(
    "p h1 h2 h3 h4 h5 h6 address article aside blockquote body center details dialog dir div dl dd dt fieldset figcaption "
    "figure footer form header hgroup hr html li main menu nav ol pre search section summary table ul".split()
)


class Reader(HTMLParser):
    """Reads page text and links one event at a time: a block ends a paragraph, and only its own
    end, another heading or a paragraph ends a heading."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.elements, self.links = [], []
        self.open = None
        self.link = False
        self.hidden = None
        self.in_body = False

    def block(self, tag):
        if self.open == "p" or (self.open and tag[:1] == "h" and tag[1:].isdigit()):
            self.open = None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden = tag
        if tag == "body":
            self.in_body = True
        if tag in BLOCKS:
            self.block(tag)
        if (tag == "p" or tag in HEADINGS) and self.in_body:
            self.open = tag
            self.elements.append("")
        if tag == "a":
            self.link = dict(attrs).get("href") is not None
            if self.link:
                self.links.append([dict(attrs)["href"], ""])

    def handle_endtag(self, tag):
        if tag == self.hidden:
            self.hidden = None
        if tag in BLOCKS:
            self.block(tag)
        if tag == "a":
            self.link = False

    def handle_data(self, data):
        if self.hidden:
            return
        if self.open:
            self.elements[-1] += data
        if self.link:
            self.links[-1][1] += data


def read(markup):
    reader = Reader()
    reader.feed(markup)
    reader.close()
    text = "".join(e + "\n\n" for e in reader.elements)
    pieces = (p.strip() for line in text.splitlines() for p in line.strip().split("  "))
    return "\n".join(p for p in pieces if p), [tuple(x) for x in reader.links]


SAMPLES = [
    "<html><head><title>no</title><script>var a='<body><p>x</p>';</script></head><body><h1>T &amp; U</h1><p>a<br>b</p></body></html>",
    "<body class='x'><p title=\"a>b\">one<p>two <b>bold</b><div>not<p data-x='>'>three</p></div><li>no</li><h6>no</h6><h5>yes</h5>",
    "<body><!-- <p>hidden</p> --><p>seen<!-- <b> --> still</p><style>p{}</style><script>'</p>'</script><p>end",
    "<BODY><P>Upper</P><H2 id=q>Case</H2></BODY>",
    "<body><a href='/single?a=1&amp;b=2'>S <i>x</i></a><a href=/bare>B</a><a name=n>no</a><A class=\"k\" HREF=\"u\">U</A><a data-href='z'>no</a>",
    "<body><a href=\"\">empty</a><a title='x > y' href='/q'>quoted &copy; &#65;</a>",
    "<body><h2><div>Title</div></h2><h3><section>Part <b>two</b></section> end</h3><h2>Lead<ul><li>x</li></ul>tail</h2>after",
    "<body><h1>One<h2>Two<p>para<h6>no</h6>still no<h5><header>H</header></h5><p>a<h4>b</h3>c",
    "<p>no body tag</p>",
    "<body></body>",
]


@pytest.mark.parametrize("markup", [s for s in SAMPLES if "<body" in s.lower()])
def test_body_text_of_samples(one, markup):
    assert one([markup], body_text(F.col("t"))) == [read(markup)[0]]


@pytest.mark.parametrize("markup", SAMPLES)
def test_anchors_of_samples(one, markup):
    got = [(a["href"], a["text"]) for a in one([markup], anchors(F.col("t")))[0]]
    assert got == read(markup)[1]


def test_given_pages(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = table.select(
        "html", body_text(F.col("html")).alias("text"), anchors(F.col("html")).alias("links")
    ).collect()
    assert got
    for row in got:
        text, links = read(row["html"])
        assert row["text"] == text
        assert [(a["href"], a["text"]) for a in row["links"]] == links


def test_long_tags_do_not_overflow(one):
    markup = "<body><p " + "a b=c 'd " * 50_000 + ">text</p>"
    assert one([markup], body_text(F.col("t"))) == ["text"]


def test_entities(one):
    texts = ["a &amp;lt; b", "&copy 2020", "&#65;&#x1F600;&#38;lt;", "&hellip;&bogus;&", "no", "&ampx &notit;", "&#0;"]
    assert one(texts, decode_entities(F.col("t"))) == [
        html.unescape(t) if t != "&ampx &notit;" else "&x &notit;" for t in texts
    ]


def test_numeric_references(one):
    numbers = [*range(0, 300), 0x80, 0x9F, 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFDEF, 0xFFFE, 0xFFFF, 0x10000, 0x1FFFE, 0x10FFFF, 0x110000, 10**12]
    texts = [f"a&#{n};b&#x{n:x};c&#X{n:X} d&#{n:020};e&#x{n:030x};" for n in numbers]
    assert one(texts, decode_entities(F.col("t"))) == [html.unescape(t) for t in texts]
    long_name = "&" + "a" * 100 + ";"
    assert one([long_name], decode_entities(F.col("t"))) == [long_name]


def test_query_parameters_are_not_entities(one):
    got = one(["<a href='/x?a=1&copy=2&amp;b=3'>t</a>"], anchors(F.col("t")))
    assert got[0][0]["href"] == "/x?a=1&copy=2&b=3"


HREFS = (
    "|/z|z|../z|#g|?k=v|//host/p|mailto:x@y|.|..|g;x=1/../y|../../../g|http:g|http://o.example|a//b|/a//b|../|./|;x"
    "|a/./b/../c|HTTP://Q.example/x|  /z|x#s/../x|javascript:void(0)|/a/../b/.|tel:1"
).split("|")
BASES = "http://a/b/c/d?q#f|http://a|http://a/|https://h.example/en/25#top|http://a/b/c/d;p?q".split("|")


def test_resolve_url(rows):
    pairs = [(b, h) for b in BASES for h in HREFS]
    got = rows(pairs, "b string, h string").select("b", "h", resolve_url(F.col("b"), F.col("h")).alias("u"))
    assert [(r.b, r.h, r.u) for r in got.collect()] == [(b, h, urljoin(b, h)) for b, h in pairs]


def test_latest_page_of_a_url_is_used(rows):
    crawled = rows(
        [(1, "u", "<body><p>old"), (3, "u", "<body><p>new"), (2, "v", "<body><p>other"), (4, None, "x")],
        "page_id long, url string, html string",
    )
    urls = rows([("u",), ("gone",), (None,)], "url string")
    assert [r.page_id for r in pages.latest_pages(crawled, urls).collect()] == [3]


def test_lookup_statuses(rows):
    visits = rows(
        [(1, 0, 1, "u"), (1, 0, 2, "gone"), (1, 0, 3, "blank"), (1, 1, 1, "")],
        "run_id long, query_idx int, rank int, url string",
    )
    texts = rows([("u", 1, "words"), ("blank", 2, "")], "url string, page_id long, text string")
    got = {r.url: r.status for r in pages.page_lookup(visits, texts).collect()}
    assert got == {"u": "ok", "gone": "no_page", "blank": "empty_text", "": "no_url"}


def test_a_lookup_leaves_stored_texts_where_they_are(spark, rows):
    path = new_folder(spark, "page-store")
    texts = rows(
        [(i, f"http://h/{i % 30}", f"text {i}") for i in range(70)] + [(99, None, "x"), (98, "http://h/e", "")], "page_id long, url string, text string"
    )
    store_page_texts(texts, path, 4)
    spark.sql("DROP TABLE " + page_store._table(path))  # as in a session that did not write it
    store = page_store.read_page_texts(spark, path)
    visits = rows([("r", f"http://h/{i}") for i in (3, 3, 29, 40)] + [("s", None), ("s", "http://h/e"), ("s", "")], "run_id string, url string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        looked = pages.page_lookup(visits, store)
        got = sorted((r.run_id, str(r.url), r.page_id, r.status, r.text) for r in looked.collect())
        plan = looked._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    newest = {f"http://h/{i % 30}": i for i in range(70)}
    want = [("r", u, newest.get(u), "ok" if u in newest else "no_page", f"text {newest[u]}" if u in newest else None) for u in ("http://h/3", "http://h/3", "http://h/29", "http://h/40")]
    want += [("s", "None", None, "no_url", None), ("s", "http://h/e", 98, "empty_text", ""), ("s", "", None, "no_url", None)]
    assert got == sorted(want)
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in final
