"""Token ids of whole texts by a byte-level vocabulary of the tokenizers library.

Texts are cut into stretches at which the vocabulary's own splitter always cuts too, the
stretches into the splitter's pieces, and the library's model encodes each distinct piece once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

from dossier.llm.bpe import byte_alphabet
from dossier.llm.words import KEEP, WHITE_SPACE, Interner, Ragged, first_rows, numbered_parts, slices

# Letters, digits and punctuation whose class is beyond doubt, and the two common spaces.
PLAIN = re.compile(r"[ -~\nÀ-ÖØ-öø-ÿ]*")
# How the vocabulary cuts text, for PLAIN characters.
PIECES = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^ \nA-Za-z0-9À-ÖØ-öø-ÿ]+|[ \n]+(?![^ \n])|[ \n]+"
).findall
# The common shape of a stretch after a space: a word with or without punctuation behind it.
WORD_AND_MARKS = re.compile(r"([A-Za-z]+)([!-/:-@\[-`{-~]*)").fullmatch
OTHER_SPACE = [c for c in WHITE_SPACE if c not in " \n"]
# A stretch is a run without white space and the one white space character before it,
# or white space that no such run takes along.
STRETCHES = re.compile(f"[{WHITE_SPACE}]?[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])").findall


class ByteCodec:
    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.normalizer is not None:
            raise NotImplementedError("a vocabulary that normalises its input")
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = {b: c for b, c in enumerate(byte_alphabet())}
        self.forget()

    def forget(self) -> None:
        """Free what the distinct words of a task took; workers live on between tasks."""
        # Stretches after a space (which the key leaves out), and stretches as they stand.
        self.spaced, self.bare, self.pieces = Interner(), Interner(), Interner()
        self.spaced_ids, self.bare_ids, self.piece_ids = (Ragged(np.int32) for _ in range(3))

    def trim(self, keep: int = 100_000) -> None:
        """Free what a task took but for the ``keep`` stretches that it met first, most of the frequent ones among them."""
        self.spaced, self.spaced_ids = first_rows(self.spaced, self.spaced_ids, keep)
        self.bare, self.bare_ids = first_rows(self.bare, self.bare_ids, keep)
        self.pieces, self.piece_ids = first_rows(self.pieces, self.piece_ids, keep)

    def _cut_spaced(self, stretch: str) -> list[str]:
        """Pieces of a stretch that a space precedes."""
        if common := WORD_AND_MARKS(stretch):
            word, marks = common.groups()
            return ["Ġ" + word, marks] if marks else ["Ġ" + word]
        return self._cut(" " + stretch)

    def _cut(self, stretch: str) -> list[str]:
        if PLAIN.fullmatch(stretch):
            pieces = PIECES(stretch)
            if stretch.isascii():
                return [p.replace(" ", "Ġ").replace("\n", "Ċ") for p in pieces]
            return [p.encode().decode("latin-1").translate(self.letters) for p in pieces]
        return [piece for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(stretch)]

    def _work_out(self) -> None:
        tokenize = self.tokenizer.model.tokenize
        for interner, table, cutter in (
            (self.spaced, self.spaced_ids, self._cut_spaced),
            (self.bare, self.bare_ids, self._cut),
        ):
            new = interner.take_new()
            if not new:
                continue
            cut = list(map(cutter, new))
            counts = np.fromiter(map(len, cut), np.int64, len(cut))
            numbers = self.pieces.numbers([piece for pieces in cut for piece in pieces])
            ids = [[token.id for token in tokenize(piece)] for piece in self.pieces.take_new()]
            self.piece_ids.append(
                np.array([i for row in ids for i in row], np.int32), np.fromiter(map(len, ids), np.int64, len(ids))
            )
            owner = np.repeat(np.arange(len(new)), counts)
            lengths = np.bincount(owner, self.piece_ids.lengths(numbers), len(new)).astype(np.int64)
            table.append(self.piece_ids.gather(numbers), lengths)

    def _simple(self, text: str) -> bool:
        """Whether every space stands between two runs without white space, or at an end."""
        return not ("  " in text or " \n" in text or "\n " in text or any(c in text for c in OTHER_SPACE))

    def _rows(self, part: list[str]) -> Iterator[tuple]:
        """(text, table, stretch numbers, first stretch) of each text; a text that spells a
        special token has no numbers and is left to the library as a whole."""
        if len(self.spaced) + len(self.bare) > KEEP:
            self.forget()
        odd = [any(mark in text for mark in self.special) for text in part]
        simple = [not o and self._simple(text) for o, text in zip(odd, part)]
        numbers, starts = numbered_parts([t for s, t in zip(simple, part) if s], self.spaced)
        bounds = zip(starts.tolist(), starts[1:].tolist())
        rows: list[tuple] = []
        for o, s, text in zip(odd, simple, part):
            if o:
                rows.append((text, None, None, None))
            elif s:
                start, end = next(bounds)
                first = np.array([self.bare[text.split(" ", 1)[0]]])
                rows.append((text, self.spaced_ids, numbers[start + 1 : end], first))
            else:
                rows.append((text, self.bare_ids, self.bare.numbers(STRETCHES(text)), None))
        self._work_out()
        yield from rows

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text in order, as the library encodes it without special tokens."""
        for part in slices(texts):
            for text, table, numbers, first in self._rows(part):
                if table is None:
                    yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
                elif first is None:
                    yield table.gather(numbers)
                else:
                    yield np.concatenate([self.bare_ids.gather(first), table.gather(numbers)])

    def counts(self, texts: list[str]) -> Iterator[int]:
        """Number of ids of each text.  Its slices are small, as there are no ids to gather at length."""
        for part in slices(texts, 4_000_000):
            for text, table, numbers, first in self._rows(part):
                if table is None:
                    yield len(self.tokenizer.encode(text, add_special_tokens=False).ids)
                else:
                    more = 0 if first is None else int(self.bare_ids.lengths(first).sum())
                    yield int(table.lengths(numbers).sum()) + more


@lru_cache(maxsize=2)
def byte_codec(path: str) -> ByteCodec:
    return ByteCodec(path)
