"""Byte-level BPE encoding as a tree reduction over joined halves, and decoding.

Encodings form a monoid: enc(AB) follows from enc(A) and enc(B). A window around the
seam is encoded anew and grows until it is known to be enough, by this rule:

    Let the window start at a token a of enc(A) and end with a token b of enc(B). If
    its encoding starts with a and ends with b, each a token of its own, then enc(AB)
    is what stands before the window, the window's encoding, and what stands behind.

Why: merges are taken by least (rank, place). As long as none crosses a cut, the parts
beside it change as they would alone, and in what order two neighbours change depends
on those two only. No merge crosses the cuts at both sides of a in A alone (left one)
nor in the window alone (right one), so the two neighbours of such a cut go through the
same states in AB, and a merge that crossed it there would have been the best one there
too. The same holds for b. Nothing is assumed of the ranks. A side whose window reaches
the end of its text needs no such token.
"""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Sequence
from functools import cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

LEAF = 16
KEPT_LENGTH = 48


class ByteTokenizer:
    """Encoder and decoder by a table of ranks; each match of the pattern is encoded alone."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, kept: int = 200_000):
        self.ranks, self.kept = ranks, kept
        self.bytes_of = {i: token for token, i in ranks.items()}
        if len(self.bytes_of) < len(ranks) or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("ranks must be distinct and hold all single bytes")
        # In tiktoken's pattern language white space is Unicode's; regex adds four controls to \s.
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}

    def merged(self, data: bytes) -> list[int]:
        """The encoding by definition: the pair of least rank is joined, the leftmost of equals, until none is left."""
        ranks, n = self.ranks, len(data)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a part is named by its start
        heap = [(rank, at, at + 2) for at in range(n - 1) if (rank := ranks.get(data[at : at + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, at, upto = heapq.heappop(heap)
            middle = end[at]
            if not middle or middle >= n or end[middle] != upto:
                continue  # one of the two has been joined to another since
            end[at], end[middle] = upto, 0
            if upto < n:
                before[upto] = at
                if (rank := ranks.get(data[at : end[upto]])) is not None:
                    heapq.heappush(heap, (rank, at, end[upto]))
            if (left := before[at]) >= 0 and (rank := ranks.get(data[left:upto])) is not None:
                heapq.heappush(heap, (rank, left, upto))
        out, at = [], 0
        while at < n:
            out.append(ranks[data[at : end[at]]])
            at = end[at]
        return out

    def joined(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of two texts in a row, from the encodings of each."""
        if not a or not b:
            return a or b
        left = right = 1
        while True:
            left, right = min(left, len(a)), min(right, len(b))
            window = self.merged(self.decode(a[len(a) - left :]) + self.decode(b[:right]))
            two = len(window) > 1
            left_fits = left == len(a) or two and window[0] == a[-left]
            right_fits = right == len(b) or two and window[-1] == b[right - 1]
            if left_fits and right_fits:
                return a[: len(a) - left] + window + b[right:]
            left, right = left * (1 if left_fits else 2), right * (1 if right_fits else 2)

    def reduced(self, data: bytes) -> list[int]:
        """The encoding by halves, whose encodings are joined."""
        if len(data) <= LEAF:
            return self.merged(data)
        half = len(data) // 2
        return self.joined(self.reduced(data[:half]), self.reduced(data[half:]))

    def encode_match(self, match: str) -> list[int]:
        data = match.encode("utf-8", "replace")
        whole = self.ranks.get(data)  # a match that is a token is that token, however pairs would join
        return self.reduced(data) if whole is None else [whole]

    def decode(self, ids: Sequence[int]) -> bytes:
        """The bytes of ids, put together up a tree."""
        if len(ids) <= LEAF:
            return b"".join([self.bytes_of[i] for i in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])

    def encode(self, text: str | None) -> list[int]:
        return [i for match in self.pattern.findall(text or "") for i in self.encode_match(match)]

    def _made(self, match: str) -> tuple[bytes, bytes]:
        """A match's ids as little-endian unsigned 32-bit integers, and the bytes that those decode to.

        Short matches are remembered, the last ``kept`` to twice as many of them.
        """
        found = self.older.get(match)
        if found is None:
            ids = self.encode_match(match)
            found = struct.pack(f"<{len(ids)}I", *ids), self.decode(ids)
        if len(match) <= KEPT_LENGTH:
            if len(self.known) >= self.kept:
                self.known, self.older = {}, self.known
            self.known[match] = found
        return found

    def packed(self, text: str | None) -> tuple[bytes, bytes]:
        """Ids as little-endian unsigned 32-bit integers, and the bytes that they decode to."""
        known = self.known.get
        found = [known(m) or self._made(m) for m in self.pattern.findall(text or "")]
        return b"".join([f[0] for f in found]), b"".join([f[1] for f in found])


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from lines of base64 bytes and a number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def encode_documents(docs: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids (binary: little-endian unsigned
    32-bit integers), decoded (binary: the bytes that the ids decode to).

    A null text counts as an empty one, which has no ids; null and repeated ids of any
    type keep a row each; an empty table gives one; other columns are ignored, whatever
    their names. A text is encoded in one task, in time n log n or so even if it is one
    long match. ``ranks_file`` must be at the same place on every executor.
    """
    id_type = dict(docs.dtypes)[id_col]

    def encoded(rows: dict) -> dict:
        tokenizer = _tokenizer(ranks_file, pattern)
        found = [tokenizer.packed(x) for x in rows["text"]]
        return {id_col: rows["id"], "n_tokens": [len(f[0]) // 4 for f in found], "ids": [f[0] for f in found], "decoded": [f[1] for f in found]}

    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), encoded, f"`{id_col}` {id_type}, n_tokens long, ids binary, decoded binary")


@cache
def _tokenizer(ranks_file: str, pattern: str) -> ByteTokenizer:
    """One for each worker process."""
    return ByteTokenizer(read_ranks(ranks_file), pattern)
