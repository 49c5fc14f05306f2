"""SentencePiece BPE encoding by merge-type prefix tables, and decoding.

Byte pair encoding has this property: the encoding of a prefix ends in one token
only, and two tokens stand side by side in an encoding exactly if they come out
again when their joined strings are encoded alone. So a table of the last token
of each prefix is filled from left to right: an automaton gives every vocabulary
piece that ends at a position, and the one that is compatible with the last
token before it is stored. Ids are recovered backwards from the table's end.

No piece has the space mark behind another character, so a text is encoded in
segments that start at runs of the mark; segments are remembered, up to a
bounded number.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

MARK = "▁"
SEGMENT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
LINE_SEGMENT = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+")
BYTE = re.compile(r"<0x([0-9A-F]{2})>\Z")
KEPT_LENGTH = 48


class _Segments(dict):
    """Remembered segments; others are made when they are asked for."""

    def __init__(self, make: Callable[[str], tuple[bytes, bytes]]):
        super().__init__()
        self.make = make

    def __missing__(self, segment: str) -> tuple[bytes, bytes]:
        return self.make(segment)


class PieceTokenizer:
    """Encoder and decoder of a BPE model with byte fallback and identity normalisation."""

    def __init__(self, model_file: str, kept: int = 100_000):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_file)
        self.pieces, self.scores, self.ids, self.byte_ids, self.control = [], [], {}, {}, set()
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            self.pieces.append(piece)
            self.scores.append(model.get_score(i))
            if model.is_byte(i):
                self.byte_ids[int(BYTE.match(piece)[1], 16)] = i
            elif model.is_control(i) or model.is_unknown(i):
                self.control.add(i)
            else:
                self.ids[piece] = i
        self.id_bytes = {i: b for b, i in self.byte_ids.items()}
        self.unknown = model.unk_id()
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.splits_lines = not any("\n" in piece for piece in self.ids)
        self.kept, self.segments, self.older, self.pairs = kept, _Segments(self._known), {}, {}
        self.alone = {i: len(self._merged(piece)) == 1 for piece, i in self.ids.items()}  # False: no encoding has it

    def _merged(self, text: str) -> list[str]:
        """``text`` by the definition: the best pair is joined, the leftmost of equals, until none is left."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _compatible(self, left: int, right: int) -> bool:
        a, b = self.pieces[left], self.pieces[right]
        if len(self.pairs) >= 4 * self.kept:
            self.pairs.clear()
        fits = self.pairs[left << 20 | right] = self._merged(a + b) == [a, b]
        return fits

    def prefix_table(self, text: str) -> list[int]:
        """For each prefix of ``text``, from the empty one on, the id of its last
        token; -1 for a character that no piece has (and for the empty prefix)."""
        last, pairs, alone = [-1] * (len(text) + 1), self.pairs, self.alone
        for end, (i, size) in self.automaton.iter(text):
            end += 1
            if last[end] < 0:  # no other token can be the last one
                before = last[end - size]
                fits = alone[i] if before < 0 else pairs.get(before << 20 | i)
                if fits is None:
                    fits = self._compatible(before, i)
                if fits:
                    last[end] = i
        return last

    def _segment(self, text: str) -> list[int]:
        if text.count(MARK) == len(text) and len(text) > 1:
            return self._marks(len(text))
        last, at, out = self.prefix_table(text), len(text), []
        while at:
            i = last[at]
            if i >= 0:
                out.append(i)
                at -= len(self.pieces[i])
            else:  # of a character without a piece, the bytes
                at -= 1
                data = text[at].encode("utf-8", "replace")
                out += [self.byte_ids.get(b, self.unknown) for b in reversed(data)]
        return out[::-1]

    def _marks(self, n: int) -> list[int]:
        """A run of marks alone. Several pairs of their pieces give one piece, so the
        last token of a prefix is not the prefix's own; pairs are joined by the
        definition, best score first and then the leftmost, from a heap: n log n."""
        size, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))

        def offers(places: Iterable[int]) -> Iterator[tuple[float, int, int, int]]:
            for at in places:
                if at >= 0 and after[at] < n and (i := self.ids.get(MARK * (size[at] + size[after[at]]))) is not None:
                    yield -self.scores[i], at, size[at], size[after[at]]

        heap = list(offers(range(n)))
        heapq.heapify(heap)
        while heap:
            _, at, mine, others = heapq.heappop(heap)
            right = after[at]
            if size[at] != mine or right >= n or size[right] != others:
                continue  # one of the two has been joined to another since
            size[at], size[right], after[at] = mine + others, 0, after[right]
            if after[at] < n:
                before[after[at]] = at
            for offer in offers((before[at], at)):
                heapq.heappush(heap, offer)
        return [self.ids[MARK * k] for k in size if k]

    def segments_of(self, text: str) -> list[str]:
        """Parts that no piece crosses: runs of marks with what follows, and line
        ends where no piece has one."""
        if not text:
            return []
        if MARK in text or "  " in text or text[0] == " " or " \n" in text or text[-1] == " " or not self.splits_lines:
            marked = MARK + text.replace(" ", MARK)
            return (LINE_SEGMENT if self.splits_lines else SEGMENT).findall(marked)
        out = (" " + text).replace("\n", " \n ").replace(" ", " " + MARK).replace(" " + MARK + "\n " + MARK, " \n ").split(" ")
        return [s for s in out if s]

    def _known(self, segment: str) -> tuple[bytes, bytes]:
        """A segment's ids in decimal, joined by commas, and the text that those decode to."""
        found = self.older.get(segment)
        if found is None:
            ids = self._segment(segment)
            found = ",".join(map(str, ids)).encode(), self._decoded(ids).encode()
        if len(segment) <= KEPT_LENGTH:
            if len(self.segments) >= self.kept:
                self.segments, self.older = _Segments(self._known), self.segments
            self.segments[segment] = found
        return found

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for s in self.segments_of(text or "") for i in self.segments[s][0].split(b",")]

    def _decoded(self, ids: list[int]) -> str:
        out, run = [], bytearray()
        if not any(i in self.id_bytes or i in self.control for i in ids):
            return "".join([self.pieces[i] for i in ids]).replace(MARK, " ")
        for i in [*ids, None]:
            if i in self.id_bytes:
                run.append(self.id_bytes[i])
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            if i == self.unknown:
                out.append(" ⁇ ")
            elif i is not None and i not in self.control:
                out.append(self.pieces[i].replace(MARK, " "))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text, shown = self._decoded(ids), [i for i in ids if i not in self.control or i == self.unknown]
        return text[1:] if shown and self.pieces[shown[0]][:1] == MARK else text

    def digest(self, text: str | None) -> tuple[int, bytes, bytes]:
        """Number of ids, ids in decimal joined by commas, bytes of the text that the ids decode to.

        No character's bytes stand in two segments, so what a segment's ids
        decode to does not depend on its neighbours.
        """
        found = list(map(self.segments.__getitem__, self.segments_of(text or "")))
        ids, decoded = b",".join([f[0] for f in found]), b"".join([f[1] for f in found])
        return ids.count(b",") + bool(ids), ids, decoded[1:] if decoded[:1] == b" " else decoded


def _utf8(data: bytes) -> str:
    """Bytes as text; each byte that starts no valid character becomes U+FFFD."""
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode("utf-8"))
                at += size
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("�")
            at += 1
    return "".join(out)


def token_digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as an empty one, which has no ids; null and repeated ids
    keep a row each; other columns are ignored, whatever their names.
    ``model_file`` must be at the same place on every executor.
    """
    id_type = dict(docs.dtypes)[id_col]

    def digests(rows: dict) -> dict:
        found = [_tokenizer(model_file).digest(x) for x in rows["text"]]
        return {
            id_col: rows["id"],
            "n_tokens": [f[0] for f in found],
            "ids_sha256": [hashlib.sha256(f[1]).hexdigest() for f in found],
            "decoded_sha256": [hashlib.sha256(f[2]).hexdigest() for f in found],
        }

    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), digests, f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")


@cache
def _tokenizer(model_file: str) -> PieceTokenizer:
    """One for each worker process."""
    return PieceTokenizer(model_file)
