import datetime
import random
import re
import urllib.parse

import pytest
from pyspark.sql import functions as F

from dossier.functions import text as X


def greedy_chunks(text, limit):
    """Plain packing loop: a paragraph costs its length and one more."""
    packs, room = [[]], limit
    for paragraph in text.split("\n"):
        cost = len(paragraph) + 1
        if cost > room:
            packs.append([])
            room = limit
        packs[-1].append(paragraph)
        room -= cost
    return ["\n".join(p) for p in packs]


@pytest.mark.parametrize("limit", [1, 5, 17, 60, 8192])
def test_chunks_match_a_plain_loop(one, limit):
    rng = random.Random(limit)
    texts = ["", "\n", "a" * 10 + "\nb", "\nabc", "abcd", "abc\n", "\n\n\n", "é😀" * 9 + "\n😀"]
    for _ in range(60):
        texts.append("".join(rng.choice("ab é😀\n\n") for _ in range(rng.randrange(200))))
    got = one(texts, X.chunks(F.col("t"), limit))
    assert got == [greedy_chunks(t, limit) for t in texts]
    for text, parts in zip(texts, got):
        joined = "\n".join(parts[1:] if parts[0] == "" and len(text.split("\n")[0]) + 1 > limit else parts)
        assert joined == text
        assert all(len(p) < limit for p in parts if "\n" in p)


def test_oversized_first_paragraph_leaves_an_empty_chunk(one):
    assert one(["a" * 10 + "\nb"], X.chunks(F.col("t"), 5)) == [["", "a" * 10, "b"]]


def test_chunks_of_a_long_text(one):
    text = "\n".join("x" * (i % 300) for i in range(20000))
    assert one([text], X.chunks(F.col("t"), 8192)) == [greedy_chunks(text, 8192)]


def test_chunk_limit_is_checked():
    with pytest.raises(ValueError):
        X.chunks(F.lit("a"), 0)


def test_tidy_lines(one):
    texts = [
        "  a  b \r\n c \n\n d   e\tf \x1c g h\x85i",
        "", "   ", "a\x0bb\x0cc", "x    y", " x \x1f y ",
    ]

    def plain(t):
        pieces = (p.strip() for line in t.splitlines() for p in line.strip().split("  "))
        return "\n".join(p for p in pieces if p)

    assert one(texts, X.tidy_lines(F.col("t"))) == [plain(t) for t in texts]


def test_word_count_counts_pieces(one):
    texts = ["", " ", "a", "a  b ", "a\nb c", "   "]
    assert one(texts, X.word_count(F.col("t"))) == [len(t.split(" ")) for t in texts]


def test_fill_does_not_expand_twice(one):
    filled = X.fill("<{first}|{second}>", first=F.col("t"), second=F.lit("2"))
    assert one(["{second}", "x"], filled) == ["<{second}|2>", "<x|2>"]


def test_quoted_path(one):
    texts = ["./outputs/a b/é'()!*~._-+%?#&=\n.pdf", "plain"]
    assert one(texts, X.quoted_path(F.col("t"))) == [urllib.parse.quote(t) for t in texts]


@pytest.mark.parametrize(
    "micros", [0, 1, 999_999, 59_000_000, 3_661_000_001, 86_400_000_000, 200_000_000_123, 10**13 + 7]
)
def test_duration_text(spark, micros):
    wanted = str(datetime.timedelta(microseconds=micros))
    assert spark.range(1).select(X.duration_text(F.lit(micros).cast("bigint"))).first()[0] == wanted


def test_interval_micros(spark):
    frame = spark.sql(
        "select timestamp_ntz'2024-03-12 01:02:03.000004' - timestamp_ntz'2024-03-09 23:00:00' as d"
    )
    wanted = datetime.datetime(2024, 3, 12, 1, 2, 3, 4) - datetime.datetime(2024, 3, 9, 23)
    got = frame.select(X.interval_micros(F.col("d"))).first()[0]
    assert got == wanted // datetime.timedelta(microseconds=1)


def test_extractive_summary(one):
    texts = ["One cat. Two dogs. A cat and dog 7. Nothing.\nLast cat.", "", "no overlap. at all. here. four"]

    def plain(t, asked, keep):
        sentences = [s.strip(" ") for s in re.split(r"[.\n]+", t)]
        sentences = [s for s in sentences if s]
        score = lambda s: len(asked & set(re.findall(r"\w+", s.lower()))) + bool(re.search("[0-9]", s))
        best = sorted(range(len(sentences)), key=lambda i: (-score(sentences[i]), i))[:keep]
        return ". ".join(sentences[i] for i in sorted(best))

    got = one(texts, X.extractive_summary(F.col("t"), F.lit("Cat or DOG"), 2))
    assert got == [plain(t, {"cat", "or", "dog"}, 2) for t in texts]
