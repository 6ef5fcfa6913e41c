"""Text expressions: whitespace, words, chunks, templates, extractive summary."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The characters ``str.splitlines`` breaks at, and the Unicode
# whitespace ``str.strip`` removes.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
WORD = r"[\p{L}\p{N}]+"
SENTENCE_BREAK = r"[.\n]+"


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it in ``body``; otherwise an expression named
    inside a lambda is evaluated again for each element."""
    return F.transform(F.array(value), body)[0]


def fill(template: str, **slots: Column) -> Column:
    """Put columns into the ``{name}`` slots of a fixed template.

    The template is cut at its slots and concatenated, so a value that itself
    contains a slot name is not expanded a second time.
    """
    pieces = re.split(r"\{(\w+)\}", template)
    parts = [
        slots[piece].cast("string") if i % 2 else F.lit(piece)
        for i, piece in enumerate(pieces)
        if i % 2 or piece
    ]
    return F.concat(*parts)


def literal_table(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A small fixed table of strings as literals of the plan."""
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, EDGE_SPACE, "")


def tidy_lines(text: Column) -> Column:
    """Split on line breaks and on double spaces, strip, drop empties, rejoin."""
    pieces = F.split(text, LINE_BREAK + "|  ")
    return F.array_join(F.filter(F.transform(pieces, strip), lambda p: p != ""), "\n")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    """Pieces of a split on one space: doubled spaces count and '' counts 1."""
    gaps = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    return (gaps + 1).cast("bigint")


def chunks(text: Column, limit: int) -> Column:
    """Greedy packing of paragraphs, each costing its length + 1, up to ``limit``.

    One chunk is the longest run of whole paragraphs whose joined length is
    below the limit, or else a single paragraph; that is a greedy regular
    expression, so the text is scanned once whatever its paragraph count.  A
    first paragraph over the limit leaves an empty chunk before it.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    pattern = r"(?s)(.{0,%d}|[^\n]*)\n" % (limit - 1)
    packed = F.regexp_extract_all(F.concat(text, F.lit("\n")), F.lit(pattern), F.lit(1))
    first = F.length(F.substring_index(text, "\n", 1))
    return F.when(first + 1 > limit, F.array_insert(packed, 1, F.lit(""))).otherwise(packed)


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE_BREAK), lambda s: F.trim(s)), lambda s: s != "")


def extractive_summary(
    text: Column, question: Column, keep: int = 3, separator: str = ". "
) -> Column:
    """Offline stand-in for a model: the ``keep`` sentences sharing most distinct
    question words (one more point for a digit), in text order."""

    def pick(wanted: Column) -> Column:
        scored = F.transform(
            sentences(text),
            lambda s, i: F.struct(
                (
                    -F.size(F.array_intersect(wanted, tokens(s)))
                    - F.when(s.rlike("[0-9]"), 1).otherwise(0)
                ).alias("neg_score"),
                i.alias("pos"),
                s.alias("sentence"),
            ),
        )
        best = F.slice(F.array_sort(scored), 1, keep)
        in_order = F.array_sort(
            F.transform(best, lambda b: F.struct(b["pos"].alias("pos"), b["sentence"].alias("s")))
        )
        return F.array_join(F.transform(in_order, lambda b: b["s"]), separator)

    return let(tokens(question), pick)


def quoted_path(path: Column) -> Column:
    """Percent-encoding that keeps ``/`` and the unreserved characters."""
    encoded = F.url_encode(path)
    for found, wanted in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(found), F.lit(wanted))
    return encoded


def interval_micros(interval: Column) -> Column:
    """Whole microseconds of a day-time interval."""
    return (
        F.extract(F.lit("DAY"), interval).cast("bigint") * 86_400_000_000
        + F.extract(F.lit("HOUR"), interval).cast("bigint") * 3_600_000_000
        + F.extract(F.lit("MINUTE"), interval).cast("bigint") * 60_000_000
        + (F.extract(F.lit("SECOND"), interval) * 1_000_000).cast("bigint")
    )


def duration_text(micros: Column) -> Column:
    """``[D day(s), ]H:MM:SS[.ffffff]``."""
    days = F.floor(micros / 86_400_000_000).cast("bigint")
    rest = micros - days * 86_400_000_000
    clock = F.format_string(
        "%d:%02d:%02d",
        F.floor(rest / 3_600_000_000).cast("bigint"),
        (F.floor(rest / 60_000_000) % 60).cast("bigint"),
        (F.floor(rest / 1_000_000) % 60).cast("bigint"),
    )
    fraction = rest % 1_000_000
    return F.concat(
        F.when(days == 0, "")
        .when(days == 1, "1 day, ")
        .otherwise(F.concat(days.cast("string"), F.lit(" days, "))),
        clock,
        F.when(fraction == 0, "").otherwise(F.format_string(".%06d", fraction)),
    )
