"""Spelling variants by asymmetric chunks: words one edit apart, and the form each leads to.

Of two words at most one edit apart, the shorter one contributes two disjoint chunks, its first half and
the rest.  One edit lies in one of them, so the other chunk stands unchanged in the longer word, moved by at most one place.
The longer word contributes its positional grams.  A gram meets a chunk only if it is as long and its place
differs by what the lengths differ, so of all grams a word of m characters lays out those that a word of m or m - 1
characters can meet; the others could never join.  Pairs that share a chunk are compared within the join.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.stages import staged
from dossier.llm.words import KEEP

# Letters of a word, and the letters that are lower-cased.
LETTERS = "A-Za-zÀ-ÿ"
LOWERED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
# Characters of a text that are split at once; a text is cut between words only.
PIECE = 4_000_000
# Chunks of one key that are compared in one group.
BLOCK = 2048


def _pieces(text: str) -> Iterator[str]:
    between, start = re.compile(f"[^{LETTERS}]"), 0
    while start < len(text):
        found = between.search(text, start + PIECE)
        end = found.start() if found else len(text)
        yield text[start:end]
        start = end


def counted_words(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_length: int = 6,
    least_count: int = 5,
    slips: int | None = None,
) -> DataFrame:
    """(word, n): words of at least ``least_length`` characters and ``least_count`` occurrences.

    A word is a maximal run of Latin letters, A to Z lower-cased.  With ``slips``, misspellings are
    planted: where the crc32 of ``<id>:<word>`` is a multiple of it, the character at crc32 modulo the length is left out.
    A null text has no words, a null id counts as an empty one.  Words are counted per task first, in a table of bounded size
    that is passed on when full; a repeated row counts as often as it occurs."""
    longer = re.compile(f"[{LETTERS}]{{{least_length},}}")

    def words(number, text: str) -> Counter:
        lowered = text.encode("utf-8").translate(LOWERED).decode("utf-8")
        found: Counter = Counter()
        for piece in _pieces(lowered):
            found.update(longer.findall(piece))
        if not slips:
            return found
        seed = zlib.crc32(f"{'' if number is None else number}:".encode())
        slipped = []
        for word in found:
            h = zlib.crc32(word.encode("utf-8"), seed)
            if h % slips == 0:
                slipped.append((word, h % len(word)))
        for word, n, at in [(word, found.pop(word), at) for word, at in slipped]:
            found[word[:at] + word[at + 1 :]] += n
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: defaultdict = defaultdict(int)

        def counts() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"]
            )

        for batch in batches:
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for word, n in words(number, text.as_py() or "").items():
                    held[word] += n
                if len(held) >= KEEP:
                    yield counts()
                    held.clear()
        if held:
            yield counts()

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(run, "word string, n long").where(F.length("word") >= least_length)
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _chunks(word: Column, length: Column) -> list[Column]:
    """The two chunks that a word of ``length`` characters contributes."""
    half = F.floor(length / 2).cast("int")
    return [F.substring(word, F.lit(1), half), F.substring(word, half + 1, length - half)]


def _grams(word: Column, length: Column, other: Column) -> list[Column]:
    """Of a word of ``length`` characters, the grams that the chunks of a word of ``other`` characters can meet."""
    half = F.floor(other / 2).cast("int")
    return [F.substring(word, F.lit(1), half), F.substring(word, half + 1 + length - other, other - half)]


def _keyed(words: DataFrame, lengths: list[Column], parts) -> DataFrame:
    """Rows (size, side, chunk, word, n), one per part of a word."""
    rows = []
    for size in lengths:
        for side, chunk in enumerate(parts(F.col("word"), F.length("word"), size)):
            rows.append(F.struct(size.alias("size"), F.lit(side).alias("side"), chunk.alias("chunk")))
    return words.select("word", "n", F.explode(F.array(*rows)).alias("k")).select("k.*", "word", "n")


def near_pairs(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, a_n, b, b_n): all pairs of words exactly one insertion, deletion or replacement apart, each once.

    ``words`` has word (unique) and n.  Words of fewer than two characters have an empty chunk, by which they meet all words
    as short.  A chunk that more than ``block`` words contribute is cut into blocks by word, each compared with
    all words that hold it, so a common chunk is spread over tasks."""
    length = F.length("word")
    chunks = _keyed(words, [length], lambda w, n, size: _chunks(w, size))
    grams = _keyed(words, [length, length - 1], _grams)
    key = ["size", "side", "chunk"]
    common = staged(
        chunks.groupBy(*key).count().where(F.col("count") > block).select(*key, F.ceil(F.col("count") / block).cast("int").alias("blocks")),
        "common-chunks",
    )
    blocks = F.coalesce("blocks", F.lit(1))
    one = chunks.join(common, key, "left").select(
        *key, F.pmod(F.xxhash64("word"), blocks).cast("int").alias("block"), F.col("word").alias("a"), F.col("n").alias("a_n")
    )
    two = grams.join(common, key, "left").select(
        *key, F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.col("word").alias("b"), F.col("n").alias("b_n")
    )
    # Words of one length meet in both roles and are taken in order; a pair that shares both chunks is taken by the first.
    half = F.floor(F.col("size") / 2).cast("int")
    once = (F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))
    first = (F.col("side") == 0) | (F.substring("a", F.lit(1), half) != F.substring("b", F.lit(1), half))
    joined = one.join(two.hint("merge"), [*key, "block"])
    return joined.where(once & first & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n")


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word.

    The form of a word is the most frequent word one edit away (of several the least in code point order), if it
    occurs at least ``ratio`` times as often; the root is the last word when forms are followed.  Frequencies grow along the way, so
    it ends.  ``words`` has word (unique, not null) and n (positive); an empty table gives an empty one, and extra columns are left out."""
    if ratio < 2:
        raise ValueError("ratio must be at least 2")
    words = staged(words.select("word", "n"), "words")
    sides = F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n"), F.col("a_n").alias("n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n"), F.col("b_n").alias("n")),
    )
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("word")))
    near = staged(
        near_pairs(words).select(F.explode(sides).alias("p")).select("p.*").groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best")),
        "near-words",
    )
    led = -F.col("best.less") >= ratio * F.col("n")
    formed = near.select(
        "word", "n_near", F.when(led, F.col("best.word")).alias("form"), F.when(led, -F.col("best.less")).alias("form_n")
    )
    roots = _roots(formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    return (
        words.join(formed, "word", "left")
        .join(roots, "word", "left")
        .select(
            "word",
            "form",
            F.coalesce("root", "word").alias("root"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            "form_n",
        )
    )


def _roots(steps: DataFrame) -> DataFrame:
    """The end of the way from each word: every round doubles the steps taken, over stored tables."""
    steps = staged(steps, "forms")
    while True:
        beyond = steps.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = staged(
            steps.join(beyond, "root", "left").select(
                "word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")
            ),
            "forms",
        )
        steps = moved.select("word", "root")
        if not moved.where("moved").head(1):
            return steps
