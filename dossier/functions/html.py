"""Page markup to text and links, as expressions over an ``html`` column.

A tag runs to the first
``>`` outside a quoted attribute value; the possessive loops keep the regular
expression engine from recursing on long tags.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.text import let, tidy_lines

TAG_REST = r"""(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+"""
UNSEEN = (
    r"(?is)<(?:!--.*?(?:-->|\z)|script(?:[\s/]%s)?>.*?(?:</script\s*>|\z)|style(?:[\s/]%s)?>.*?(?:</style\s*>|\z))"
    % (TAG_REST, TAG_REST)
)
BODY_START = r"(?is)^.*?<body(?:[\s/]%s)?>" % TAG_REST
PARAGRAPH_START = r"(?i)<p(?:[\s/]%s)?>" % TAG_REST
HEADING_START = r"(?i)<h[1-5](?:[\s/]%s)?>" % TAG_REST
HEADING_END = r"(?i)(?:</h[1-6](?:[\s/]%s)?>|<h6(?:[\s/]%s)?>)" % (TAG_REST, TAG_REST)
# Element names whose tags end an open paragraph; a heading holds them.
BLOCKS = [
    "p", "address", "article", "aside", "blockquote", "body", "center", "details", "dialog", "dir", "div", "dl", "dd",
    "dt", "fieldset", "figcaption", "figure", "footer", "form", "header", "hgroup", "hr", "html", "li", "main", "menu",
    "nav", "ol", "pre", "search", "section", "summary", "table", "ul",
]
BLOCK_TAG = r"(?i)</?(?:%s)(?:[\s/]%s)?>" % ("|".join(BLOCKS), TAG_REST)
ANY_TAG = r"(?i)<[a-z/!?]%s>" % TAG_REST
ANCHOR_START = r"(?i)<a((?:[\s/]%s)?)>" % TAG_REST
ANCHOR_END = r"(?i)</a(?:[\s/]%s)?>" % TAG_REST
HREF = r"""(?is)(?:^|[\s/"'])href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
# A few old entity names also count without their semicolon; within an attribute they
# do so only where no letter, digit or equals sign follows.
OLD_NAMES = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True))
ENTITY = rf"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;|{OLD_NAMES})"
ATTRIBUTE_ENTITY = rf"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;|(?:{OLD_NAMES})(?![=A-Za-z0-9]))"

OPEN, CLOSE, SPLIT = "\x01", "\x02", "\x03"
HEADING, HEADING_CLOSE = "\x04", "\x05"
# What HTML reads the numbers of the C1 controls as; five have no other meaning.
C1 = [bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(0x80, 0xA0)]


# The entities nearly all pages use, tried before the full table.
COMMON_ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&nbsp;": "\xa0", "&copy;": "©"}


def _entity_value(entity: Column) -> Column:
    """Characters of one ``&...;``; the entity itself where it has no meaning."""
    name = F.substring(entity, F.lit(2), F.length(entity))
    digits = F.regexp_replace(name, "^#[xX]?0*|;$", "")
    number = F.when(name.rlike("^#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint")
    # More digits than any character has are a number beyond all of them.
    code = F.when(digits == "", 0).when(F.length(digits) <= 10, number).otherwise(0x110000)
    plane_end = code.bitwiseAND(0xFFFE) == 0xFFFE
    dropped = (
        code.between(1, 8) | (code == 0x0B) | code.between(0x0E, 0x1F) | (code == 0x7F) | code.between(0xFDD0, 0xFDEF) | plane_end
    )
    usable = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    char = (
        F.when(~usable, "\ufffd")
        .when(code.between(0x80, 0x9F), F.element_at(F.array(*map(F.lit, C1)), (code - 0x7F).cast("int")))
        .when(dropped, "")
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    )
    # The full table is one string literal, folded to a map when the query is planned.
    pairs = "\x02".join(f"{name}\x01{value}" for name, value in html5.items())
    table = F.str_to_map(F.lit(pairs), F.lit("\x02"), F.lit("\x01"))
    rare = F.when(name.startswith("#"), char).otherwise(F.try_element_at(table, name))
    value = F.coalesce(rare, entity)
    for found, wanted in COMMON_ENTITIES.items():
        value = F.when(entity == found, F.lit(wanted)).otherwise(value)
    return value


def decode_entities(text: Column, pattern: str = ENTITY) -> Column:
    """Decode each entity once, left to right; text without ``&`` is untouched."""

    def decoded(t: Column) -> Column:
        joined = F.array_join(
            F.zip_with(
                F.split(t, pattern),
                F.regexp_extract_all(t, F.lit(pattern), F.lit(0)),
                lambda piece, entity: F.concat(piece, F.coalesce(_entity_value(entity), F.lit(""))),
            ),
            "",
        )
        return F.when(F.contains(t, F.lit("&")), joined).otherwise(t)

    return let(text, decoded)


def visible(html: Column) -> Column:
    """Markup less comments, scripts, styles and our own marker characters."""
    return F.regexp_replace(F.regexp_replace(html, f"[{OPEN}{CLOSE}{SPLIT}{HEADING}{HEADING_CLOSE}]", ""), UNSEEN, "")


def body_text(html: Column) -> Column:
    """Text of h1-h5 and p elements of the body, in document order, tidied.

    A paragraph ends at any block tag or heading, a heading only at its own end or the next
    paragraph or heading."""
    marked = F.regexp_replace(visible(html), BODY_START, "")
    for pattern, mark in (
        (PARAGRAPH_START, OPEN),
        (HEADING_START, OPEN + HEADING),
        (HEADING_END, HEADING_CLOSE),
        (BLOCK_TAG, CLOSE),
    ):
        marked = F.regexp_replace(marked, pattern, mark)
    plain = F.regexp_replace(marked, ANY_TAG, "")
    pieces = F.slice(F.split(plain, OPEN), 2, 2_000_000_000)
    heading = lambda p: F.replace(F.substring(F.substring_index(p, HEADING_CLOSE, 1), F.lit(2), F.length(p)), F.lit(CLOSE), F.lit(""))
    paragraph = lambda p: F.substring_index(F.substring_index(p, CLOSE, 1), HEADING_CLOSE, 1)
    elements = F.transform(pieces, lambda p: F.when(p.startswith(HEADING), heading(p)).otherwise(paragraph(p)))
    return tidy_lines(decode_entities(F.array_join(elements, "\n\n")))


def anchors(html: Column) -> Column:
    """``array<struct<href,text>>`` of every anchor that has an href."""
    marked = F.regexp_replace(visible(html), ANCHOR_START, OPEN + "$1" + CLOSE)
    marked = F.regexp_replace(marked, ANCHOR_END, SPLIT)
    pieces = F.slice(F.split(marked, OPEN), 2, 2_000_000_000)

    def link(piece: Column) -> Column:
        inner = F.substring_index(F.substring_index(piece, CLOSE, -1), SPLIT, 1)
        return F.struct(
            let(F.substring_index(piece, CLOSE, 1), href).alias("href"),
            decode_entities(F.regexp_replace(inner, ANY_TAG, "")).alias("text"),
        )

    def href(attributes: Column) -> Column:
        groups = [F.regexp_extract(attributes, HREF, g) for g in (1, 2, 3)]
        return F.when(attributes.rlike(HREF), decode_entities(F.concat(*groups), ATTRIBUTE_ENTITY))

    return F.filter(F.transform(pieces, link), lambda a: a["href"].isNotNull())
