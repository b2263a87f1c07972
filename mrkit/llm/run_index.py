"""A run-length compressed Burrows-Wheeler index of a few texts, and matching statistics streamed from it."""

from __future__ import annotations

import numpy as np


class RunIndex:
    """The transform of the texts as runs of equal characters, with both ends of every run sampled.

    A sample is the text position of the suffix and how many characters it shares with the neighbour on the other side of the
    run's border. Inside a run, the preceding characters of two neighbours are equal; then the suffix one place
    further to the right shares one character less with its neighbour, so samples say all (irreducible values).
    """

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(text) for text in texts])
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        self.n = n = int(sizes.sum()) + len(texts)
        symbols = np.frombuffer(b"\0".join([*texts, b""]), dtype=np.uint8).astype(np.int64) + len(texts)
        # Every text ends in a separator of its own, so that matches stay inside texts and suffixes differ.
        symbols[self.starts + sizes] = np.arange(len(texts))
        order, levels = _suffix_order(symbols)
        before = symbols[order - 1]
        border = np.flatnonzero(before[1:] != before[:-1])
        shared = _shared(levels, order[border], order[border + 1])
        self.run_characters = before[np.append(0, border + 1)]
        self.run_lengths = np.diff(np.concatenate([[0], border + 1, [n]]))
        self.run_starts, self.run_ends, self.border_lengths = order[border + 1], order[border], shared
        self.first, self.last = order[0], order[-1]

    def matching_statistics(self) -> np.ndarray:
        """For every text position the length of the longest match that starts at another position."""
        above = self._stream(np.append(self.run_starts, self.first), np.append(self.border_lengths, 0))
        below = self._stream(np.append(self.run_ends, self.last), np.append(self.border_lengths, 0))
        return np.maximum(above, below)

    def _stream(self, positions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Lengths at the sampled positions, and one less for each step to the right of a sample."""
        last = np.zeros(self.n, dtype=np.int64)
        last[positions] = positions
        sampled = np.zeros(self.n, dtype=np.int64)
        sampled[positions] = lengths
        last = np.maximum.accumulate(last)
        return np.maximum(sampled[last] - (np.arange(self.n) - last), 0)


# Symbols of a suffix that are sorted together at first.
PACKED = 4


def _suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffixes in order, by prefix doubling, and the ranks of the prefixes of each length.

    A rank is the place of the first suffix with that prefix, so suffixes that differ from all others keep theirs and are
    not sorted again. Those still equal have no separator among the symbols compared, so none of them ends there. The
    ranks of one length may be given several times, as ``_shared`` uses each once.
    """
    n, base = len(symbols), int(symbols.max()) + 2
    packed = PACKED if base**PACKED < 1 << 63 else 1
    # A symbol of 0 stands behind the end.
    following = np.append(symbols + 1, np.zeros(packed - 1, dtype=np.int64))
    key = following[:n].copy()
    for i in range(1, packed):
        key *= base
        key += following[i : i + n]
    order = np.argsort(key)
    new = _changes(key[order])
    rank = np.empty(n, dtype=np.int32)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    levels = [(1, symbols.astype(np.int32))] * (packed - 1)
    places, length = np.flatnonzero(~(new & np.append(new[1:], True))), packed
    del following, key, new
    while True:
        levels.append((length, rank.copy()))
        if not len(places):
            return order, levels
        suffixes = order[places]
        key = rank[suffixes].astype(np.int64) * n + rank[suffixes + length]
        by_key = np.argsort(key)
        suffixes, new = suffixes[by_key], _changes(key[by_key])
        order[places] = suffixes
        rank[suffixes] = places[np.flatnonzero(new)][np.cumsum(new) - 1]
        places, length = places[~(new & np.append(new[1:], True))], length * 2


def _changes(ordered: np.ndarray) -> np.ndarray:
    return np.append(True, ordered[1:] != ordered[:-1])


def _shared(levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at ``a`` and ``b``."""
    a, b, total = a.copy(), b.copy(), np.zeros(len(a), dtype=np.int64)
    for length, rank in reversed(levels):
        inside = np.maximum(a, b) < len(rank)
        equal = inside & (rank[np.minimum(a, len(rank) - 1)] == rank[np.minimum(b, len(rank) - 1)])
        step = np.where(equal, length, 0)
        a, b, total = a + step, b + step, total + step
    return total
