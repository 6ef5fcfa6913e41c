"""Byte-pair encoding by a pair occurrence index, and decoding.

The distinct words of a slice of texts form one chain of symbols.  An index maps every
mergeable pair to all its positions; ranks that have positions are applied in ascending
order, each at all its positions at once, and the lists of the pairs that appear at the
seams are extended.  Words are independent, so this gives each word the merges it would
get by itself.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dossier.llm.words import KEEP, Interner, Ragged, numbered_words, slices

SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it
    is printable in Latin-1, else the next free one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    table = {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(others)}
    return [table[b] for b in range(256)]


class PairIndex:
    """Merges of one vocabulary, applied to many words together."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str) -> None:
        pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        # A merge joins texts; the end mark is part of the right half only.
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.left, self.right = left, right
        self.size = max(vocab.values()) + 2
        keys = left * self.size + right
        self.order = np.argsort(keys, kind="stable")
        self.keys = np.append(keys[self.order], np.iinfo(np.int64).max)
        self.order = np.append(self.order, -1)
        alphabet = byte_alphabet()
        self.inner = np.array([vocab.get(c, -2) for c in alphabet], np.int64)
        self.last = np.array([vocab.get(c + suffix, -2) for c in alphabet], np.int64)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in turn, and how many belong to each."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(lengths)
        full = lengths > 0
        symbols[ends[full] - 1] = self.last[raw[ends[full] - 1]]
        owner = np.repeat(np.arange(len(words)), lengths)
        known = symbols >= 0  # a symbol outside the vocabulary is left out
        symbols, owner = symbols[known], owner[known]
        # One boundary symbol before, between and after the words.
        place = np.arange(len(symbols)) + owner + 1
        chain = np.full(len(symbols) + len(words) + 1, -1, np.int64)
        chain[place] = symbols
        self._merge(chain)
        alive = chain[place] >= 0
        return chain[place[alive]], np.bincount(owner[alive], minlength=len(words))

    def _merge(self, chain: np.ndarray) -> None:
        following = np.arange(1, len(chain) + 1)
        before = np.arange(-1, len(chain) - 1)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(positions: np.ndarray) -> None:
            a, b = chain[positions], chain[following[positions]]
            # A boundary (-1) never makes a key that is in the table.
            keys = a * self.size + b
            slot = np.searchsorted(self.keys, keys)
            found = np.flatnonzero(self.keys[slot] == keys)
            if not len(found):
                return
            ranks = self.order[slot[found]]
            by_rank = np.argsort(ranks, kind="stable")
            ranks, positions = ranks[by_rank], positions[found[by_rank]]
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            for rank, start, end in zip(ranks[cuts[:-1]].tolist(), cuts, cuts[1:]):
                if rank in index:
                    index[rank].append(positions[start:end])
                else:
                    index[rank] = [positions[start:end]]
                    heapq.heappush(active, rank)

        enter(np.arange(len(chain) - 1))
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            positions = lists[0] if len(lists) == 1 else np.concatenate(lists)
            a, b = self.left[rank], self.right[rank]
            positions = positions[(chain[positions] == a) & (chain[following[positions]] == b)]
            if len(positions) > 1:
                positions.sort()
                positions = positions[np.concatenate([[True], positions[1:] != positions[:-1]])]
            if a == b and len(positions) > 1:
                # In a run of overlapping pairs every second one counts, from the left.
                first = np.r_[True, following[positions[:-1]] != positions[1:]]
                at = np.arange(len(positions))
                positions = positions[(at - np.maximum.accumulate(np.where(first, at, 0))) % 2 == 0]
            if not len(positions):
                continue
            gone = following[positions]
            chain[positions] = self.merged[rank]
            chain[gone] = -2
            after = following[gone]
            following[positions] = after
            before[after] = positions
            enter(np.concatenate([before[positions], positions]))


# The characters whose lower case, composition and class are beyond doubt: a word of
# these is cut here, any other by the vocabulary's own normaliser and splitter.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")


class WordCodec:
    """Encoder and decoder of a tokenizer file with word ends and dropped white space."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["single_word"] for t in spec["added_tokens"]) or spec["decoder"]:
            raise NotImplementedError("added tokens found after normalising, or a decoder")
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.index = PairIndex(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.names = [b""] * size
        for text, number in [*model["vocab"].items(), *self.special.items()]:
            self.names[number] = text.encode()
        self.to_byte = {c: b for b, c in enumerate(byte_alphabet())}
        # How the vocabulary cuts lower-cased text, for PLAIN characters.
        self.cut = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+").findall
        self.forget()

    def forget(self) -> None:
        """Free what the distinct words of a task took; workers live on between tasks."""
        self.chunks, self.pieces = Interner(), Interner()
        self.chunk_ids, self.piece_ids = Ragged(np.int32), Ragged(np.int32)

    def _cut(self, chunk: str) -> list:
        """Words of a stretch without ASCII white space, as bytes; special tokens as their ids."""
        if PLAIN.fullmatch(chunk) and "<|" not in chunk:
            return [piece.encode() for piece in self.cut(chunk.lower())]
        out: list = []
        for part in self.special_pattern.split(chunk):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                normal = self.tokenizer.normalizer.normalize_str(part)
                for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal):
                    out.append(bytes(map(self.to_byte.__getitem__, piece)))
        return out

    def _work_out(self) -> None:
        new = self.chunks.take_new()
        if not new:
            return
        cut = [self._cut(chunk) for chunk in new]
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        numbers = self.pieces.numbers([piece for pieces in cut for piece in pieces])
        words = self.pieces.take_new()
        plain = [b"" if isinstance(word, int) else word for word in words]
        ids, lengths = self.index.encode(plain)
        if any(isinstance(word, int) for word in words):
            spot = np.array([i for i, word in enumerate(words) if isinstance(word, int)])
            ids = np.insert(ids, np.cumsum(lengths)[spot], [words[i] for i in spot])
            lengths[spot] = 1
        self.piece_ids.append(ids, lengths)
        owner = np.repeat(np.arange(len(new)), counts)
        per_chunk = np.bincount(owner, self.piece_ids.lengths(numbers), len(new)).astype(np.int64)
        self.chunk_ids.append(self.piece_ids.gather(numbers), per_chunk)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text in order."""
        for part in slices(texts):
            if len(self.chunks) > KEEP:
                self.forget()
            numbers, starts = numbered_words(part, self.chunks)
            self._work_out()
            for start, end in zip(starts.tolist(), starts[1:].tolist()):
                yield self.chunk_ids.gather(numbers[start:end])

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 text of ids: without a decoder, token texts joined by spaces."""
        return b" ".join(map(self.names.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def word_codec(path: str) -> WordCodec:
    return WordCodec(path)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_tokens, ids_sha256, decoded_sha256``, over whole texts.

    A null text counts as empty: no token, digests of nothing.  Rows are independent, so
    repeated rows and null ids stay as they are; other columns are not read.  ``path`` is
    a tokenizer file that every executor can open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = word_codec(path)
        for batch in batches:
            texts = [text or "" for text in batch.column(1).to_pylist()]
            rows = []
            for ids in codec.encode(texts):
                raw = ids.astype("<u4").tobytes()
                rows.append((len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()))
            columns = zip(*rows) if rows else ([], [], [])
            kinds = (pa.int64(), pa.string(), pa.string())
            yield pa.record_batch(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        codec.forget()

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"doc_id long, {SCHEMA}")


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the ids themselves, for further steps."""

    def run(batches):
        codec = word_codec(path)
        for batch in batches:
            ids = list(codec.encode([text or "" for text in batch.column(1).to_pylist()]))
            yield pa.record_batch(
                [batch.column(0), pa.array([i.tolist() for i in ids], pa.list_(pa.int32()))], names=["doc_id", "ids"]
            )
        codec.forget()

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, ids array<int>")
