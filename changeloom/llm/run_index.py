"""A run-length index of a collection of byte strings, and what it tells of repeats.

The index is the Burrows-Wheeler transform as runs of equal bytes, with the
suffix numbers at both ends of each run. For the first suffix of a run, and for the
last, the length of the match with its neighbour in sorted order is measured. All
other matches follow from these while the text is streamed from left to right:
inside a run the neighbour of the next suffix is the next suffix of the neighbour,
so a match gets shorter by one with each byte. The longer of both neighbours'
matches is the longest match of a suffix with any other one.

Repetitive collections have few runs, so few matches are measured.
"""

from __future__ import annotations

import numpy as np

SEPARATOR = 0xFF  # in no UTF-8 text


def _words(text: np.ndarray, to_end: np.ndarray) -> np.ndarray:
    """Eight bytes from each position, those behind a separator as zeros."""
    words = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    for step in (1, 2, 4):
        words[:-step] = words[:-step] << np.uint64(8 * step) | words[step:]
    words = words[: len(text)] if len(text) else words[:0]
    short = np.flatnonzero(to_end < 7)
    words[short] &= ~np.uint64(0) << (np.uint64(8) * (7 - to_end[short]).astype(np.uint64))
    return words


def suffix_order(words: np.ndarray, to_end: np.ndarray) -> np.ndarray:
    """Suffixes in order; a separator is larger than any byte and than those before it."""
    order = np.argsort(words, kind="stable")
    ordered = words[order]
    rank = np.empty(len(words), np.int64)
    slots, reach = np.arange(len(words)), 8
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    while True:
        members = order[slots]
        new |= to_end[members] < reach  # equal up to a separator: position decides, and the sort is stable
        starts = slots[np.flatnonzero(new)]
        rank[members] = starts[np.cumsum(new) - 1]
        alone = new & np.concatenate([new[1:], [True]])
        slots = slots[~alone]
        if not len(slots):
            return order
        members = order[slots]
        key = rank[members].astype(np.uint64) << np.uint64(32) | rank[members + reach].astype(np.uint64)
        by = np.argsort(key, kind="stable")
        order[slots], key = members[by], key[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        reach *= 2


class RunIndex:
    """Runs of the transform of the strings, each with a separator behind it."""

    def __init__(self, strings: list[bytes]):
        self.text = np.frombuffer(b"".join(s + bytes([SEPARATOR]) for s in strings), np.uint8)
        ends = np.cumsum([len(s) + 1 for s in strings]) - 1
        self.begins = np.concatenate([[0], ends[:-1] + 1]) if len(strings) else np.zeros(0, np.int64)
        self.to_end = np.repeat(ends, [len(s) + 1 for s in strings]) - np.arange(len(self.text)) if len(strings) else np.zeros(0, np.int64)
        self.words = _words(self.text, self.to_end)
        order = suffix_order(self.words, self.to_end) if len(self.text) else np.zeros(0, np.int64)
        bytes_before = self.text[order - 1]
        change = bytes_before[1:] != bytes_before[:-1]
        change |= bytes_before[1:] == SEPARATOR  # separators differ from each other
        heads = np.concatenate([[0], np.flatnonzero(change) + 1]) if len(order) else np.zeros(0, np.int64)
        self.run_bytes, self.run_lengths = bytes_before[heads], np.diff(np.append(heads, len(order)))
        # From here on runs are all that is left of the sorted suffixes.
        ends = np.cumsum(self.run_lengths)
        self.head_samples, self.tail_samples = order[ends - self.run_lengths], order[ends - 1]
        self.head_matches = np.append(0, self._match(self.head_samples[1:], self.tail_samples[:-1])) if len(order) else heads
        self.tail_matches = np.append(self.head_matches[1:], 0) if len(order) else heads

    def _match(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes for which the suffixes at a and b agree, up to a separator."""
        most = np.minimum(self.to_end[a], self.to_end[b])
        size, left = np.zeros(len(a), np.int64), np.arange(len(a))
        while len(left):
            apart = self.words[a[left] + size[left]] ^ self.words[b[left] + size[left]]
            same = np.full(len(left), 8)
            for k in range(8):
                same[(same == 8) & (apart >> np.uint64(56 - 8 * k) != 0)] = k
            size[left] += same
            left = left[(same == 8) & (size[left] < most[left])]
        return np.minimum(size, most)

    def matching_statistics(self) -> np.ndarray:
        """For each position, the length of its longest match with another position."""
        longest = np.zeros(len(self.text), np.int64)
        place = np.arange(len(self.text))
        for samples, matches in ((self.head_samples, self.head_matches), (self.tail_samples, self.tail_matches)):
            measured = np.full(len(self.text), -1)
            measured[samples] = matches
            last = np.maximum.accumulate(np.where(measured >= 0, place, 0))
            np.maximum(longest, measured[last] - (place - last), out=longest)
        return longest

    def repeated(self, span: int) -> list[np.ndarray]:
        """For each string, which of its ``span``-byte substrings occur elsewhere in the collection."""
        found = self.matching_statistics() >= span
        sizes = np.diff(np.append(self.begins, len(self.text))) - span
        return [found[at : at + max(0, size)] for at, size in zip(self.begins.tolist(), sizes.tolist(), strict=True)]
