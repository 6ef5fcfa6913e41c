"""Dense word numbers and ragged tables, the base of the operators that read whole texts.

A text repeats most of its words, so what a word costs (tokens, hashes) is worked
out once per distinct word of a task and then gathered by number.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The characters with the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
# Distinct words a task keeps before it starts afresh; bounds memory, not results.
KEEP = 600_000


class Interner(dict):
    """Word to number, in the order of first sight; ``new`` lists words not yet worked out."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list = []

    def __missing__(self, word):
        number = len(self)
        self[word] = number
        self.new.append(word)
        return number

    def numbers(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def take_new(self) -> list:
        new, self.new = self.new, []
        return new


class Ragged:
    """Rows of different length by dense row number."""

    def __init__(self, dtype) -> None:
        self.flat = np.empty(0, dtype)
        self.starts = np.zeros(1, np.int64)

    def append(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.flat = np.concatenate([self.flat, flat.astype(self.flat.dtype, copy=False)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths, dtype=np.int64)])

    def gather(self, rows: np.ndarray) -> np.ndarray:
        """Values of the given rows, one row after the other."""
        starts = self.starts[rows]
        lengths = self.starts[rows + 1] - starts
        ends = np.cumsum(lengths)
        index = np.arange(ends[-1] if len(ends) else 0)
        index += np.repeat(starts - (ends - lengths), lengths)
        return self.flat[index]

    def lengths(self, rows: np.ndarray) -> np.ndarray:
        return self.starts[rows + 1] - self.starts[rows]


def first_rows(interner: Interner, table: Ragged, keep: int) -> tuple[Interner, Ragged]:
    """The first ``keep`` words and their rows, without the memory of the others; all words must be worked out."""
    if len(interner) <= keep:
        return interner, table
    words, rows = Interner(), Ragged(table.flat.dtype)
    words.update(islice(interner.items(), keep))
    rows.flat, rows.starts = table.flat[: table.starts[keep]].copy(), table.starts[: keep + 1].copy()
    return words, rows


def slices(texts: list[str], chars: int = 8_000_000) -> Iterator[list[str]]:
    """Texts in order, in lists of about ``chars`` characters or one longer text."""
    part: list[str] = []
    held = 0
    for text in texts:
        if part and held + len(text) > chars:
            yield part
            part, held = [], 0
        part.append(text)
        held += len(text)
    if part:
        yield part


def numbered_words(texts: list[str], interner: Interner) -> tuple[np.ndarray, np.ndarray]:
    """Words between ASCII white space (0x20, 0x09 to 0x0D), as numbers of ``interner``: all
    words of all texts in turn, and where each text starts, with the end at last."""
    column = pc.ascii_trim_whitespace(pa.array(texts, pa.large_string()))
    return _numbered(pc.ascii_split_whitespace(column), interner, empty=False)


def numbered_parts(texts: list[str], interner: Interner) -> tuple[np.ndarray, np.ndarray]:
    """The same for the parts between single spaces, empty ones included."""
    return _numbered(pc.split_pattern(pa.array(texts, pa.large_string()), " "), interner, empty=True)


def _numbered(lists, interner: Interner, empty: bool) -> tuple[np.ndarray, np.ndarray]:
    starts = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    numbers = interner.numbers(names)[coded.indices.to_numpy()] if names else np.zeros(0, np.int64)
    starts = starts - starts[0]
    if not empty and "" in names:
        kept = numbers != interner[""]
        before = np.concatenate([[0], np.cumsum(kept)])
        numbers, starts = numbers[kept], before[starts]
    return numbers, starts
