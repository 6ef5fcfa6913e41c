"""Length-limited canonical Huffman codes for token ids, in numpy."""

from __future__ import annotations

import numpy as np

STRIDE = 128  # ids between two bit-offset checkpoints


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by the package-merge method; 0
    for ids that never occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) == 0:
        return lengths
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)
    # Each level holds leaves and pairs of the level below, in ascending weight; only
    # which entries are leaves is kept, as the entries taken are always a prefix.
    levels = []
    weights, is_leaf = leaf, np.ones(len(leaf), bool)
    for _ in range(limit - 1):
        levels.append(is_leaf)
        even = len(weights) // 2 * 2
        packed = weights[:even:2] + weights[1:even:2]
        both = np.concatenate([leaf, packed])
        at = np.argsort(both, kind="stable")
        weights, is_leaf = both[at], at < len(leaf)
    levels.append(is_leaf)
    take = 2 * len(leaf) - 2
    depth = np.zeros(len(leaf), np.int64)
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        depth[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    if len(order):
        bits = lengths[order]
        widest = int(bits.max())
        steps = np.left_shift(1, widest - bits)
        codes[order] = np.concatenate([[0], np.cumsum(steps)[:-1]]) >> (widest - bits)
    return codes


class Coder:
    """Encoder and table-driven decoder of one set of code lengths."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.lengths = lengths.astype(np.int64)
        self.codes = canonical_codes(self.lengths)
        self.width = max(1, int(self.lengths.max(initial=1)))
        self.symbol = np.zeros(1 << self.width, np.int32)
        self.bits = np.ones(1 << self.width, np.int64)
        used = np.flatnonzero(self.lengths)
        order = used[np.argsort(self.lengths[used], kind="stable")]
        spread = np.left_shift(1, self.width - self.lengths[order])
        filled = int(spread.sum())
        self.symbol[:filled] = np.repeat(order, spread)
        self.bits[:filled] = np.repeat(self.lengths[order], spread)

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Bit offset of every STRIDE-th id, and the packed bits."""
        if not len(ids):
            return np.zeros(0, np.int64), b""
        bits = self.lengths[ids]
        ends = np.cumsum(bits)
        starts = ends - bits
        word, offset = starts >> 6, starts & 63
        codes = self.codes[ids].astype(np.uint64)
        over = offset + bits - 64  # bits that reach into the next word
        inside = np.where(over > 0, codes >> np.maximum(over, 0).astype(np.uint64), codes << np.maximum(-over, 0).astype(np.uint64))
        packed = np.zeros(int(ends[-1] + 63 >> 6) + 1, np.uint64)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        packed[word[first]] = np.bitwise_or.reduceat(inside, first)
        crossing = np.flatnonzero(over > 0)
        packed[word[crossing] + 1] |= codes[crossing] << (64 - over[crossing]).astype(np.uint64)
        return starts[::STRIDE], packed.astype(">u8").tobytes()[: int(ends[-1] + 7 >> 3)]

    def decode(self, starts: np.ndarray, counts: np.ndarray, payload: bytes) -> np.ndarray:
        """Ids of many stretches side by side, one id of each per step.

        ``starts`` are bit offsets in ``payload``, ``counts`` the ids of each stretch, at most
        STRIDE."""
        order = np.argsort(-counts, kind="stable")
        ranked = counts[order]
        out = np.zeros((len(counts), STRIDE), np.int32)
        padded = np.frombuffer(payload + b"\0" * (8 + -len(payload) % 4), ">u4").astype(np.int64)
        at = starts[order].astype(np.int64)
        live = len(counts)
        for step in range(int(ranked[0]) if live else 0):
            live = int(np.searchsorted(-ranked, -step, "left"))
            here = at[:live]
            word, shift = here >> 5, here & 31
            # 64 bits from two words; the top `width` after the offset are the window.
            window = ((padded[word] << shift) & 0xFFFFFFFF) | (padded[word + 1] >> (32 - shift))
            window >>= 32 - self.width
            out[:live, step] = self.symbol[window]
            here += self.bits[window]
        back = np.empty(len(counts), np.int64)
        back[order] = np.arange(len(counts))
        return out[back][np.arange(STRIDE) < counts[:, None]]
