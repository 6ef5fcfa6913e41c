"""Main text of web pages by two passes of block rules.

The markup is cut into blocks.  Pass one decides what length, link density and stop-word density
(and the element a block stands in) make clear; pass two gives each undecided block the label of its
nearest decided neighbours.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent words of six languages.
STOP_WORDS = frozenset(
    """the of and to in is that it was for on are as with his they at be this have from or had by not but what all were when we there can an your which their if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than been its who now
der die das und ist in den von zu mit sich des auf für im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch
le la les de des du et un une est en que qui dans pour pas sur au aux avec ce il elle par plus ne se son sa ses mais ou où on nous vous ils être cette ces leur sont été comme tout
el los las del y en un una es que por con no para se su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante
il lo gli di da un uno una e che non per con su si come più ma anche alla della dei nel sono
o os as do da dos das em um uma que não para com por se mais como mas foi ao ele ela""".split()
)
# Elements whose contents are never text of the page.
UNSEEN = "script style noscript template iframe svg object textarea select button title canvas audio video map"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{'|'.join(UNSEEN.split())})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
BLOCKS = frozenset(
    "p h1 h2 h3 h4 h5 h6 address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form head header hgroup hr html legend li main menu nav ol optgroup option pre section summary table tbody tfoot thead tr ul caption".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SECTIONS = frozenset("article aside body div footer form header html main nav section table td th ul ol dl".split())
BAD_ELEMENTS = frozenset("nav footer aside form menu dialog head fieldset".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies reply respond responses discussion".split())
BAD_WORDS = COMMENT_WORDS | frozenset(
    """nav navbar navigation menu menubar submenu header masthead topbar footer bottombar sidebar aside widget widgets
    ad ads adbox advert adverts advertisement advertising banner promo promotion promoted sponsor sponsored sponsors
    cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay
    newsletter subscribe subscription signup signin login register form search share sharing social follow
    breadcrumb breadcrumbs pagination pager related recommended recommendations trending popular
    copyright legal disclaimer toolbar skip teaser outbrain taboola paywall""".split()
)
# Of these the words that style sheets also use for the layout of a whole page, or that a topic may be named by.  An
# element is not bad by them alone if it holds all text of the page that its own measures call good.
LAYOUT_WORDS = frozenset(
    """header masthead topbar bottombar sidebar aside widget widgets banner promo promotion promoted notice notices alert alerts
    overlay register form search share sharing social follow related recommended recommendations trending popular legal teaser
    nav navbar navigation menu toolbar skip""".split()
)
# Words before which a style name says what a page has, not what the element is.
ABOUT = frozenset("has with no without is".split())
GOOD, BAD, NEAR, SHORT = "good", "bad", "near", "short"


class Block:
    __slots__ = ("text", "links", "area", "heading", "label", "group", "form", "core", "boxes")

    def __init__(self, text: str, links: int, area: str, heading: bool, group: int, form: int = 0, boxes: tuple = ()) -> None:
        self.boxes = boxes  # the elements around it that are bad by a layout word alone: (outer boxes, number)
        self.text, self.links, self.area, self.heading, self.group = text, links, area, heading, group
        self.label, self.form = "", form
        self.core = area in ("main", "outer", "title")


def _area(name: str, attributes: str, inside: str, plain: bool = False) -> tuple[str, bool]:
    """The kind of area that an element opens: bad, comments, main, boxed (an article in a
    bad box), title (the head of an article), or what surrounds it; and whether it is bad by layout words alone, which do
    not count if it is ``plain``."""
    marked, layout = "", False
    if attributes.strip():
        for key, *values in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), "".join(values).lower()
            if key in ("class", "id") and name not in ("html", "body", "main"):
                words = re.split(r"[\s_-]+", value)
                hits = {w for before, w in zip(["", *words], words) if w in BAD_WORDS and before not in ABOUT}
                if hits & COMMENT_WORDS:
                    return "comments", False
                layout = bool(hits) and hits <= LAYOUT_WORDS and marked != "bad"
                if layout and plain:
                    layout = False
                    continue
                if hits and not (name == "article" or (hits == {"header"} and inside == "main")):
                    marked = "title" if hits == {"header"} and inside == "main" else "bad"
            elif key == "role" and value in BAD_ROLES:
                marked, layout = "bad", False
            elif (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
                return "hidden", False
        if re.search(r"(?:^|\s)hidden(?:\s|/|$)", ATTRIBUTE.sub(" ", attributes)):
            return "hidden", False
    if name in BAD_ELEMENTS:
        return "gone", False
    if name == "header":
        return ("title" if inside == "main" else "bad"), False
    if marked:
        return marked, layout and marked == "bad"
    if name == "article" and inside == "bad":
        return "boxed", False
    if name in ("article", "main") and inside in ("", "bad", "main", "outer"):
        return ("main" if name == "article" else "outer"), False
    return inside, False


def blocks_of(html: str, plain_form: int = 0, plain_boxes: frozenset = frozenset()) -> list[Block]:
    """Blocks of a page in order, with white space tidied and references decoded.

    The form of number ``plain_form`` is an element like any other: one that holds most of
    the page's text.  So are the boxes of ``plain_boxes``, which hold all its good text."""
    out: list[Block] = []
    stack: list[tuple[str, str, tuple]] = []
    # Open elements by name: of sections all, of others those since each open section.
    sections: dict[str, int] = {}
    since: list[dict[str, int]] = [{}]
    numbered = 0
    buffer: list[str] = []
    links = group = depth_a = depth_form = forms = form = 0
    heading = False

    def flush() -> None:
        nonlocal buffer, links
        if buffer:
            text = " ".join(unescape("".join(buffer)).split())
            if text:
                out.append(Block(text, links, stack[-1][1] if stack else "", heading, group, form, stack[-1][2] if stack else ()))
        buffer, links = [], 0

    def close(name: str) -> bool:
        """Close the innermost open ``name``, not through a section that holds it."""
        nonlocal depth_a, group, depth_form, form
        if not (sections if name in SECTIONS else since[-1]).get(name):
            return False
        while True:
            gone = stack.pop()[0]
            depth_a -= gone == "a"
            group += gone == "article"
            depth_form -= gone == "form"
            if gone in SECTIONS:
                sections[gone] -= 1
                since.pop()
            else:
                since[-1][gone] -= 1
            if gone == name:
                form = form if depth_form else 0
                return True

    end = 0
    breaks = 0
    for token in TOKEN.finditer(html):
        text = html[end : token.start()]
        end = token.end()
        if text:
            buffer.append(text)
            if not text.isspace():
                breaks = 0
                if depth_a > 0:
                    links += len(" ".join(unescape(text).split()))
        name = (token["name"] or token["name2"] or "").lower()
        if not name:
            continue
        if name == "br":
            breaks += 1
            buffer.append(" ")
            if breaks == 2:
                flush()
            continue
        is_end = bool(token["end"] or token["end2"])
        if name in BLOCKS or name in ("td", "th"):
            if name in BLOCKS:
                flush()
            else:
                buffer.append(" ")
        if is_end:
            close(name)
            if name in HEADINGS:
                heading = False
            continue
        if name in BLOCKS:
            close("p")  # a block element ends an open paragraph
            if name in ("li", "dd", "dt", "option"):
                close(name)
        if name in HEADINGS:
            heading = True
        elif name in BLOCKS:
            heading = False
        if name == "a":
            close("a")
        if name in VOID:
            continue
        group += name == "article"
        attributes = token["attributes"] or ""
        inside = stack[-1][1] if stack else ""
        if name == "form":
            forms += 1
            form = form or forms
            depth_form += 1
        boxes = stack[-1][2] if stack else ()
        numbered += 1
        if name == "form" and forms == plain_form:
            area = inside
        else:
            area, layout = _area(name, attributes, inside, numbered in plain_boxes)
            boxes = (boxes, numbered) if layout else boxes
        stack.append((name, area, boxes))
        if name in SECTIONS:
            sections[name] = sections.get(name, 0) + 1
            since.append({})
        else:
            since[-1][name] = since[-1].get(name, 0) + 1
        depth_a += name == "a"
    if end < len(html):
        tail = html[end:]
        buffer.append(tail)
        if depth_a > 0:
            links += len(tail)
    flush()
    sizes: dict[int, int] = {}
    for block in out:
        if block.area != "hidden":
            sizes[block.form] = sizes.get(block.form, 0) + len(block.text)
    largest = max(sizes, key=sizes.__getitem__, default=0)
    if largest and not plain_form and 2 * sizes[largest] > sum(sizes.values()):
        return blocks_of(html, largest)
    if not plain_boxes and any(block.boxes for block in out):
        plain = _plain_boxes(out)
        if plain:
            return blocks_of(html, plain_form, plain)
    return out


def _chain(boxes: tuple) -> list[int]:
    """Numbers of the boxes around a block, the outermost first."""
    out = []
    while boxes:
        boxes, number = boxes
        out.append(number)
    return out[::-1]


def _plain_boxes(blocks: list[Block]) -> frozenset:
    """Boxes around all good text of a page that has no text as good or nearly so outside its boxes."""
    chains, sizes = [], {}
    for block in blocks:
        if block.area in ("comments", "hidden", "gone") or not block.text:
            continue
        size, density, stops = _measures(block)
        if block.boxes and size > 140 and density <= 0.33 and stops >= 0.3:
            chains.append((_chain(block.boxes), size))
            sizes[chains[-1][0][0]] = sizes.get(chains[-1][0][0], 0) + size
        elif not block.boxes and block.area not in ("bad", "title") and size >= 70 and density <= 0.33 and stops >= 0.15:
            return frozenset()
    if not chains:
        return frozenset()
    first = max(sizes, key=sizes.__getitem__)
    inner = [chain for chain, _ in chains if chain[0] == first]
    common = 0
    for level in zip(*inner):
        if len(set(level)) > 1:
            break
        common += 1
    return frozenset(inner[0][:common])


def _measures(block: Block) -> tuple[int, float, float]:
    """Length, link density and stop-word density."""
    size = len(block.text)
    words = [w.strip("\"'.,;:!?()[]{}#*$%&|<>-–—«»“”„…").lower() for w in block.text.split()]
    return size, min(block.links / size, 1.0), sum(w in STOP_WORDS for w in words) / len(words)


def _container(blocks: list[Block], measures: list[tuple[int, float, float]]) -> str:
    """The innermost of article, main and page that holds most of the good text."""
    good = dict.fromkeys(("main", "outer", "", "boxed"), 0)
    for block, (size, density, stops) in zip(blocks, measures):
        if block.area in good and size > 140 and density <= 0.33 and stops >= 0.3:
            good[block.area] += size
    article, main, page = good["main"], good["outer"], good[""]
    if good["boxed"] and not (article or main or page):
        for block in blocks:
            if block.area == "boxed":
                block.area = "main"
        return "main"
    areas = {b.area for b in blocks}
    if "main" in areas and 2 * article >= article + main + page:
        return "main"
    return "outer" if "outer" in areas and article + main >= page else ""


def first_labels(blocks: list[Block]) -> None:
    """Pass one: what a block's own measures decide."""
    measures = [_measures(block) for block in blocks]
    chosen = _container(blocks, measures)
    # Text of <main> beside its articles, and articles beside more text, count by their own measures.
    beside = {"main": ("outer",), "outer": ("main",), "": ("main", "outer")}[chosen]
    for block, (size, density, stops) in zip(blocks, measures):
        inner = chosen if block.area == chosen else ""
        block.core = bool(inner) or (block.area == "title" and chosen == "main")
        if block.area == "title":
            block.label = SHORT if block.heading else BAD
        elif block.area != chosen and block.area not in beside:
            block.label = BAD
        elif density > 0.5 or (density > 0.33 and not inner) or ("©" in block.text and size < 200 and not inner):
            block.label = BAD
        elif size < 70:
            block.label = BAD if density and not inner else SHORT
        elif stops >= 0.3:
            block.label = GOOD if size > 140 else NEAR
        elif stops >= 0.15:
            block.label = NEAR
        else:
            # Long without stop words: a list of terms, or an article in odd wording.
            block.label = NEAR if inner else BAD
    if not any(block.label == GOOD for block in blocks):
        for block in blocks:
            if block.label == NEAR:
                block.label = GOOD


def final_labels(blocks: list[Block]) -> list[bool]:
    """Pass two: undecided blocks take the label of the nearest decided ones.  An article's own
    edges count as good, those of a page as bad."""
    n = len(blocks)
    decided = [b.label in (GOOD, BAD) for b in blocks]
    # The nearest block before and after each that is decided or of another article, in one sweep each.
    stops = lambda at, of: not 0 <= at < n or decided[at] or blocks[at].group != blocks[of].group
    earlier, later = [0] * n, [0] * n
    for at in range(n):
        earlier[at] = at - 1 if stops(at - 1, at) else earlier[at - 1]
    for at in range(n - 1, -1, -1):
        later[at] = at + 1 if stops(at + 1, at) else later[at + 1]
    out = []
    for at, block in enumerate(blocks):
        if decided[at]:
            out.append(block.label == GOOD)
            continue
        main = edge = block.core
        before, after = earlier[at], later[at]

        def good(place: int) -> bool:
            if 0 <= place < n and blocks[place].group == block.group and (not main or blocks[place].area == block.area):
                return blocks[place].label == GOOD
            return edge

        left, right = good(before), good(after)
        if left == right:
            out.append(left)
        elif block.label == NEAR or main:
            out.append(True)
        elif block.heading:
            out.append(right)
        else:
            out.append(left if at - before < after - at else right if after - at < at - before else False)
    return out


def main_text(html: str) -> str:
    blocks = blocks_of(html)
    first_labels(blocks)
    return "\n\n".join(block.text for block, kept in zip(blocks, final_labels(blocks)) if kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row.

    Null or empty html gives an empty text, an empty table no rows; time is linear in the page.  Blocks are joined in page order by two line feeds;
    nothing else is dropped or cut.  Rows are independent: null and repeated ids stay, other
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html) if html else "" for html in batch.column(2).to_pylist()]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    narrow = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")
    )
    return narrow.mapInArrow(run, "page_id long, url string, text string, n_chars long")
