import base64
import collections
import hashlib
import random
import time

import pytest

from dossier.llm import main_text, url_templates, warc
from dossier.llm.queries import RULES
from dossier.sinks.stage import new_folder

LONG = "This is a long text of the page, and it has many of the words that are in a text, so the rules will find that it is one of the article itself."
SHELL = (
    '<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>'
    '<nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">%s</div>%s'
    '<aside><p>%s</p></aside><section id="comments"><article class="comment"><p>%s</p></article></section>'
    "<form><p>%s</p></form><footer>&copy; me %s</footer><script>var t='</p>';</script></body></html>"
)


def shell(article):
    return SHELL % (LONG, article, LONG, LONG, LONG, LONG)


@pytest.mark.parametrize(
    "html,text",
    [
        (shell(f"<article><h1>A &amp;\n B</h1><p>{LONG}<p>Short&nbsp; one&#146;s.<br>more</article>"), f"A & B\n\n{LONG}\n\nShort one’s. more"),
        (shell("<article><h2>Tiny</h2><p>Few words</p></article>"), "Tiny\n\nFew words"),
        (shell(f"<main><div class='ad'>{LONG}</div><p>{LONG}</p><div class='related'><a href=x>{LONG}</a></div></main>"), LONG),
        (shell(f"<div><h2>Head</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div>"), f"Head\n\n{LONG}\n\nShort.\n\n{LONG}"),
        (shell(f"<article><header><h1>Title</h1><a href=b>by</a></header><ul><li>one<li>two</ul><footer>{LONG}</footer></article>"), "Title\n\none\n\ntwo"),
        (f"<article><p>1 < 2 <b>bold</b>ly<!-- {LONG} --></p><p hidden>{LONG}</p><p style='display: none'>{LONG}</p>", "1 < 2 boldly"),
        (f"<article>a<article>b</article>c<script>{LONG}", "a\n\nb\n\nc"),
        ("<p>menu</p>", ""),
        ("<", ""),
        ("", ""),
        ("<article>" + "<div>" * 3000 + "x", "x"),
        ("<article><p " + "a='b\" " * 2000 + ">x", None),
    ],
)
def test_main_text(html, text):
    found = main_text.main_text(html)
    assert text is None or found == text


@pytest.mark.parametrize(
    "html,text",
    [
        (f"<main><div><p>{LONG}</p><p>1 {LONG}</p></div><div class=related><article><p>2 {LONG}</p></article></div></main>", f"{LONG}\n\n1 {LONG}"),
        (f"<main><p>1 {LONG}</p><article><p>{LONG}</p><p>2 {LONG}</p></article><p>Share</p></main>", f"1 {LONG}\n\n{LONG}\n\n2 {LONG}"),
        (f"<div><p>1 {LONG}</p><p>2 {LONG}</p></div><article>Teaser</article>", f"1 {LONG}\n\n2 {LONG}"),
        (f"<body><form id=f><nav>menu</nav><div><p>{LONG}</p></div></form>", LONG),
        (f"<body><form><article><p>{LONG}</p></article></form>", LONG),
        (f"<div class=widget><article><p>{LONG}</p></article></div>", LONG),
    ],
)
def test_areas_are_evidence(html, text):
    assert main_text.main_text(html) == text


def test_undecided_blocks_follow_their_neighbours():
    make = lambda label: main_text.Block("x", 0, "", False, 0)
    blocks = []
    for label in "bad short good short short short bad near good".split():
        blocks.append(make(label))
        blocks[-1].label = label
    got = main_text.final_labels(blocks)
    assert got == [False, False, True, True, False, False, False, True, True]


def test_main_text_of_odd_rows(spark):
    rows = [(1, "u", None), (None, None, "<article>x</article>"), (1, "u", ""), (2, "v", "<article><p>" + "y " * 300_000)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text")
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in main_text.extract(frame).collect())
    assert [(g[0], g[2]) for g in got] == [("1", 0), ("1", 0), ("2", 599_999), ("None", 1)]
    assert main_text.extract(frame.limit(0)).collect() == []


URLS = [
    None, "", "no scheme", "http://", "http://Example.ORG", "http://example.org/", "HTTP://a.Example.org/es/x?y#z", "http://example.org/en/12",
    "http://notexample.org/es/", "http://x.com/fr/1", "http://x.com/fr", "http://x.com/de/1?a=/fr/", "http://com/de/", "x://y://z/w", "http://É.NET/A#b",
    "http://a.net/p/" + "long/" * 5000,
]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def test_urls_and_rules(spark):
    frame = spark.createDataFrame([*enumerate(URLS), (None, URLS[6]), (6, URLS[6])], "page_id long, url string").selectExpr("*", "0 AS host")
    labels = spark.createDataFrame([], "url_key long, good int")
    rows = url_templates.filter_urls(frame, RULES, labels).collect()
    assert len(rows) == len(URLS) + 2
    for row in rows:
        host, path = split(URLS[6 if row.page_id is None else row.page_id])
        assert (row.host, row.path) == (host, path)
        fitting = []
        for verdict, rule in RULES:
            name, _, rest = rule.partition("/")
            if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
                fitting.append((len(rule), rule, verdict))
        assert row.rule == (max(fitting)[1] if fitting else None)
        assert row.verdict == (max(fitting)[2] if fitting else "allow")
    assert url_templates.filter_urls(frame.limit(0), RULES, labels).collect() == []


def brute_purity(pages):
    """The tree by plain loops: pages are (host, segments, good or None)."""
    deepest = max(len(segs) for _, segs, _ in pages)
    live = [(host, [*segs, *[""] * (deepest - len(segs))], "", good) for host, segs, good in pages]
    for level in range(max(len(segs) for _, segs, _ in pages)):
        parent, branch = collections.defaultdict(list), collections.defaultdict(list)
        for host, segs, prefix, good in live:
            if good is not None:
                parent[host, prefix].append(good)
                branch[host, prefix, segs[level]].append(good)
        grown = []
        for host, segs, prefix, good in live:
            siblings, own, seg = parent[host, prefix], branch[host, prefix, segs[level]], segs[level]
            share = (sum(siblings) + 0.5) / (len(siblings) + 1)
            away = abs(sum(own) - len(own) * share) > 1.96 * (len(own) * share * (1 - share)) ** 0.5
            step = seg if seg == "" or seg[0] == "*" or away else "*"
            grown.append((host, segs, prefix + "/" + step if step else prefix, good))
        live = grown
    known = [g for *_, g in live if g is not None]
    prior = (sum(known) + 1) / (len(known) + 2)
    out = {}
    for host, segs, prefix, _ in live:
        of_host = [g for h, *_, g in live if h == host and g is not None]
        own = [g for h, _, p, g in live if (h, p) == (host, prefix) and g is not None]
        level = (sum(of_host) + 10 * prior) / (len(of_host) + 10)
        out[host, tuple(s for s in segs if s)] = (prefix, (sum(own) + 10 * level) / (len(own) + 10))
    return out


def test_templates_against_loops(spark):
    draw = random.Random(7)
    pages, labels = [], []
    for key in range(900):
        host = draw.choice(["h.net", "h.net", "k.net"])
        kind = draw.choice(["spam", "blog", "news", "shop"])
        url = f"http://{host}/{kind}/{key}{draw.choice(['', '.html'])}" + draw.choice(["", "", "/x/y/z/w", "/x/y/z/w/" + kind, "/x/y/9/q/" + draw.choice("ab") + "/r/s/t"])
        pages.append((key, url))
        if draw.random() < 0.7:
            labels.append((key, int(draw.random() < (0.05 if kind == "spam" and host == "h.net" else 0.9))))
    frame = spark.createDataFrame(pages, "page_id long, url string")
    rows = url_templates.filter_urls(frame, [], spark.createDataFrame([*labels, (None, 0)], "url_key long, good int")).collect()
    good = dict(labels)
    shape = lambda path: ["*" + (".html" if s.endswith(".html") else "") if s[:1].isdigit() else s for s in path.split("/") if s]
    data = []
    for key, url in pages:
        data.append((split(url)[0], shape(split(url)[1]), good.get(key)))
    want = brute_purity(data)
    for row in rows:
        template, purity = want[data[row.page_id][0], tuple(data[row.page_id][1])]
        assert row.template == template and abs(row.purity - purity) < 1e-9
        assert row.verdict == ("block" if purity < 0.5 else "allow")
    assert {r.verdict for r in rows} == {"allow", "block"}


@pytest.mark.parametrize("depth", [1, 5, 8, 40])
def test_sections_are_told_apart_at_any_depth(spark, depth):
    pages = [(i, f"http://h.net/{i}/" + "a/" * (depth - 1) + ("casino" if i < 100 else "news") + f"/x{i % 7}.html") for i in range(200)]
    labels = spark.createDataFrame([(i, int(i >= 100)) for i in range(200)], "url_key long, good int")
    rows = url_templates.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), [], labels).collect()
    assert {r.page_id for r in rows if r.verdict == "block"} == set(range(100))


def payload_rows():
    big = "<p>é</p>" * 40_000
    return [
        (1, "http://a/", "x"), (2, "http://b/", "x"), (3, None, ""), (4, "http://c/\n", None), (5, "u", big), (6, "u", big), (7, "v", "\r\n\r\nWARC/1.1\r\n\r\n"),
        (8, "w", big + "!"), (None, "n", "x"), (None, "n", "alone"), (9, "r", "same"), (9, "r", "same"),
    ]


@pytest.mark.parametrize("least", [0, 3])
def test_archive(spark, least):
    data = payload_rows()
    frame = spark.createDataFrame(data, "page_id long, url string, html string").selectExpr("*", "1 AS payload", "'' AS owner").repartition(3)
    out = new_folder(spark, "archive")
    warc.write_archive(frame, out, least)
    records = warc.read_archive(spark, out)
    got = sorted(map(tuple, warc.captures(records).collect()), key=str)
    groups = collections.defaultdict(list)
    for page, _, html in data:
        groups[html or ""].append(page)
    want = []
    for page, _, html in data:
        raw = (html or "").encode()
        ids = [i for i in groups[html or ""] if i is not None]
        owner = max(ids, default=None)
        revisit = len(raw) >= least and len(groups[html or ""]) > 1 and owner is not None and page != owner
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want.append((page, len(raw), digest, "revisit" if revisit else "response", owner if revisit else None))
    assert got == sorted(want, key=str)
    bodies = {bytes(r.payload) for r in warc.payloads(records).collect() if r.payload is not None}
    assert bodies == {(h or "").encode() for _, _, h in data}


def test_segments_and_chunks():
    block = bytes(range(256)) * 1000
    records = list(warc.records_of("urn:x", {"WARC-Type": "response"}, block, segment=60_000))
    parsed = list(warc.parsed(b"".join(records)))
    assert len(records) == 5 and b"".join(b for _, b in parsed) == block
    assert [f.get("warc-segment-number") for f, _ in parsed] == list("12345")
    assert [f.get("warc-segment-total-length") for f, _ in parsed] == [None] * 4 + ["256000"]
    assert {f["warc-segment-origin-id"] for f, _ in parsed[1:]} == {"<urn:x>"}
    for payload in (b"", b"x", b"\r\n0\r\n\r\n", block):
        assert warc.dechunked(warc.chunked(payload)) == payload
    assert warc.dechunked(b"3;ext=1\r\nabc\r\n0\r\ntrailer: x\r\n\r\n") == b"abc"


@pytest.mark.parametrize("lost", [0, 1, 2])
def test_a_lost_segment_is_an_error(spark, lost):
    records = list(warc.records_of("urn:x", {"WARC-Type": "response", "X-Page-ID": "1"}, b"x" * 25, segment=10))
    del records[lost]
    out = new_folder(spark, "broken")
    parts = spark.createDataFrame([(bytearray(r[:-1]),) for r in records], "value binary")
    parts.selectExpr("CAST(value AS STRING) AS value").write.text(out)
    with pytest.raises(Exception, match="do not fit"):
        warc.read_archive(spark, out).collect()


def test_empty_archive(spark):
    frame = spark.createDataFrame([], "page_id long, url string, html string")
    out = new_folder(spark, "archive")
    warc.write_archive(frame, out)
    assert warc.captures(warc.read_archive(spark, out)).collect() == []


PROSE = "This is the text of the page and it was written by the people who have been in the city for all of the year. " * 4


@pytest.mark.parametrize("style", ["layout sidebar-right", "content legal-news", "post popular", "page header"])
def test_a_layout_word_around_the_whole_text_does_not_count(style):
    page = '<html><body><div class="nav"><a href="/">Home</a></div>{}<div class="footer">All is said</div></body></html>'
    inner = f"<p>{PROSE}</p><div class=sidebar><p>{PROSE.upper()}</p></div><p>{PROSE}</p>"
    text = main_text.main_text(page.format(f'<div class="{style}">{inner}</div>'))
    assert text == PROSE.strip() + "\n\n" + PROSE.strip()
    # Beside text of its own the page keeps such a box out, and words of adverts and notices never give way.
    assert main_text.main_text(page.format(f'<p>{PROSE}</p><div class="{style}"><p>{PROSE.lower()}</p></div>')) == PROSE.strip()
    assert main_text.main_text(page.format(f'<div class="cookie-notice"><p>{PROSE}</p></div>')) == ""
    assert main_text.main_text(page.format(f'<div class="comments"><p>{PROSE}</p></div>')) == ""


def test_formulas_are_text():
    text = main_text.main_text(f"<article><p>{PROSE}</p><p>As it is so that <math><mi>x</mi><mo>=</mo><mn>1</mn></math> for all of them in the end.</p></article>")
    assert "x=1" in text


@pytest.mark.parametrize(
    "html", ["<p>ab</p>" * 20_000, "<b>" * 20_000 + "</i>" * 20_000, "<i><div>" + "<b>" * 20_000 + "</i>" * 20_000, "<div class=sidebar>" * 5_000 + f"<p>{PROSE}</p>"]
)
def test_time_is_linear_in_the_page(html):
    started = time.perf_counter()
    main_text.main_text(html)
    assert time.perf_counter() - started < 5


def brute_final(blocks):
    """Pass two as it reads: walk from each undecided block to its neighbours."""
    out = []
    for at, block in enumerate(blocks):
        if block.label in (main_text.GOOD, main_text.BAD):
            out.append(block.label == main_text.GOOD)
            continue
        seen = []
        for step in (-1, 1):
            place, distance = at + step, 1
            while 0 <= place < len(blocks) and blocks[place].group == block.group and blocks[place].label not in (main_text.GOOD, main_text.BAD):
                place, distance = place + step, distance + 1
            inside = 0 <= place < len(blocks) and blocks[place].group == block.group
            counts = inside and (not block.core or blocks[place].area == block.area)
            seen.append((blocks[place].label == main_text.GOOD if counts else block.core, distance))
        (left, before), (right, after) = seen
        if left == right:
            out.append(left)
        elif block.label == main_text.NEAR or block.core:
            out.append(True)
        elif block.heading:
            out.append(right)
        else:
            out.append(left if before < after else right if after < before else False)
    return out


def test_pass_two_against_loops():
    draw = random.Random(3)
    for _ in range(400):
        blocks, group = [], 0
        for _ in range(draw.randrange(0, 25)):
            group += draw.random() < 0.15
            block = main_text.Block("t", 0, draw.choice(["main", "outer", ""]), draw.random() < 0.2, group)
            block.label = draw.choice([main_text.GOOD, main_text.BAD, main_text.NEAR, main_text.SHORT, main_text.SHORT])
            block.core = draw.random() < 0.4
            blocks.append(block)
        assert main_text.final_labels(blocks) == brute_final(blocks)
