"""Suffix-array dedup of long repeats through run-length indexes.

Every ``span``-byte window of a text has an anchor: of the ``gram``-byte grams in
it, the last of smallest hash. Equal windows have equal anchors, so windows need
only be compared where anchors are. Neighbouring windows of one anchor make a
context, the bytes they cover together; each window of a text is in exactly one
of its contexts.

Anchors that occur once in the corpus are dropped; their windows cannot repeat.
Of the other contexts, equal ones are counted and kept once; contexts with equal
anchors and lengths are equal if two independent 64-bit hashes, of the anchor and
of all bytes, agree. The contexts of an anchor go to one task, which builds a
run-length index of them (see ``run_index``), streams matching statistics and so
finds the windows that occur elsewhere. The index of a task is built piece by
piece, for whole anchors, up to ``INDEX_BYTES``.

An anchor with more than ``HOT`` different contexts, such as a frequent line, is made
longer: windows that reach far enough to its left are grouped by the bytes there,
the others by the bytes on its right. That is repeated for groups that are still
too large; the bytes that a window has besides its anchor are halved each time, so
that in the end the windows of a group are equal and one context is left of it.

Lengths are in UTF-8 bytes; matches never cross texts. A null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, with_row_id
from .run_index import RunIndex

INDEX_BYTES = 1 << 18
#: Different contexts of an anchor beyond which it is made longer.
HOT = 1024
PLACE_BITS = 20
BLOCK = (1 << PLACE_BITS) - 1
_random = np.random.default_rng(7)
BYTE_VALUES = _random.integers(0, 1 << 64, 256, np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15 | 5)  # odd, so that it has an inverse
BACK = np.uint64(pow(int(STEP), -1, 1 << 64))
OCCURRENCE = [("rid", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("anchor", pa.int64()), ("context", pa.int64())]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Anchors:
    """Cuts the windows of byte strings into contexts."""

    def __init__(self, span: int, gram: int):
        if gram & gram - 1 or not 1 <= gram <= span < BLOCK:
            raise ValueError("gram must be a power of two, and span not below it")
        self.span, self.gram = span, gram
        self.forward = np.cumprod(np.full(BLOCK + 1, STEP))
        self.backward = np.cumprod(np.full(BLOCK + 1, BACK))

    def contexts(self, data: bytes) -> tuple[np.ndarray, ...]:
        """start, number of windows, anchor hash, hash of all covered bytes; of each context."""
        text, parts = np.frombuffer(data, np.uint8), []
        for at in range(0, max(0, len(text) - self.span + 1), BLOCK - self.span + 1):
            start, *rest = self._block(text[at : at + BLOCK])
            parts.append((start + at, *rest))
        if not parts:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))

    def _block(self, text: np.ndarray) -> tuple[np.ndarray, ...]:
        values = BYTE_VALUES[text]
        grams, step = values, 1
        while step < self.gram:  # hashes of 1, 2, 4, .. bytes
            grams = grams[:-step] * self.forward[step - 1] + grams[step:]
            step *= 2
        grams = _mixed(grams)
        # The place is in the low bits, so that of equal hashes the last is smallest.
        place = np.uint64(BLOCK) - np.arange(len(grams), dtype=np.uint64)
        least = grams & ~np.uint64(BLOCK) | place
        width, window = 1, self.span - self.gram + 1
        while 2 * width <= window:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        if width < window:
            rest = window - width
            least = np.minimum(least[:-rest], least[rest:])
        anchor = BLOCK - (least & np.uint64(BLOCK)).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        n = np.diff(np.append(start, len(anchor)))
        stop = start + n - 1 + self.span
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * self.forward[: len(values)])])
        covered = _mixed((total[stop] - total[start]) * self.backward[start] + n.astype(np.uint64))
        return start, n, grams[anchor[start]].view(np.int64), covered.view(np.int64)


    def anchor_of(self, data: bytes) -> int:
        """Where in a context its anchor is."""
        grams, step = BYTE_VALUES[np.frombuffer(data, np.uint8)[: self.span]], 1
        while step < self.gram:
            grams = grams[:-step] * self.forward[step - 1] + grams[step:]
            step *= 2
        grams = _mixed(grams) & ~np.uint64(BLOCK)
        return len(grams) - 1 - int(np.argmin(grams[::-1]))


def occurrences(base: DataFrame, span: int, gram: int) -> DataFrame:
    """(rid, start, n, anchor, context) of every context of ``base`` (rid, text)."""
    schema = pa.schema(OCCURRENCE)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(span, gram)
        for batch in batches:
            rows, parts = batch.column(0).to_numpy(zero_copy_only=False), []
            for rid, text in zip(rows, batch.column(1), strict=True):
                found = anchors.contexts((text.as_py() or "").encode("utf-8", "replace"))
                parts.append((np.full(len(found[0]), rid, np.int64), *found))
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else []
            if columns:
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return base.select("rid", "text").mapInArrow(cut, "rid long, start long, n int, anchor long, context long")


def _indexed(contexts: DataFrame, span: int) -> DataFrame:
    """(anchor, context, runs): the windows of each context that occur elsewhere, as
    numbers at which repeated stretches begin and end, in turn."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= INDEX_BYTES and row[0] != held[-1][0]:
                    yield marks(held)
                    held, size = [], 0
                    pa.default_memory_pool().release_unused()
                held.append(row)
                size += len(row[3])
        if held:
            yield marks(held)

    def marks(rows: list[tuple]) -> pa.RecordBatch:
        out = []
        for (anchor, context, copies, data), found in zip(rows, RunIndex([r[3] for r in rows]).repeated(span), strict=True):
            if copies > 1:  # kept once, but all of it occurs elsewhere
                runs = [0, len(data) - span + 1]
            else:
                runs = np.flatnonzero(np.diff(np.concatenate([[0], found.view(np.int8), [0]]))).tolist()
            if runs:
                out.append((anchor, context, runs))
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.int32()))], names=["anchor", "context", "runs"])

    dealt = contexts.select("anchor", "context", "copies", "data").repartition("anchor").sortWithinPartitions("anchor", "context")
    return dealt.mapInArrow(index, "anchor long, context long, runs array<int>")


def _lengthened(pieces: DataFrame) -> DataFrame:
    """Contexts grouped by longer anchors: ``pieces`` are (anchor, context, copies, lo, data,
    key, left, right), windows of a context from number lo on, whose anchor is at
    left .. right in data; each gives two at most, with new keys and their hash, sub."""
    fields = [("anchor", "long"), ("context", "long"), ("copies", "long"), ("lo", "long"), ("data", "binary"), ("key", "long"), ("left", "long"), ("right", "long"), ("span", "long")]
    kinds = {"long": pa.int64(), "binary": pa.binary()}

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for anchor, context, copies, lo, data, key, left, right, span in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                spare, windows = span - (right - left), len(data) - span + 1
                more = -(-spare // 2)
                cut = max(0, min(windows, left - more + 1))  # windows that begin so far before the anchor
                for side, first, last, begin, end in ((0, 0, cut, left - more, right), (1, cut, windows, left, right + spare - more + 1 if spare else right)):
                    if first < last:
                        new = xxhash.xxh3_64_intdigest(data[begin:end], side) ^ key & (1 << 64) - 1
                        part = data[first : last - 1 + span]
                        out.append((anchor, context, copies, lo + first, part, _signed(new), begin - first, end - first, span, _signed(xxhash.xxh3_64_intdigest(part))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*out, strict=True), [*fields, ("sub", "long")], strict=True)], names=[*(n for n, _ in fields), "sub"])

    return pieces.select(*(n for n, _ in fields)).mapInArrow(halves, ", ".join(f"{n} {k}" for n, k in fields) + ", sub long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _marked_hot(contexts: DataFrame, span: int, gram: int) -> DataFrame:
    """(anchor, context, runs) for ``contexts`` (anchor, context, copies, data) of hot anchors."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(span, gram)
        for batch in batches:
            left = [anchors.anchor_of(data) for data in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(left, pa.int64())], names=["anchor", "context", "copies", "data", "left"])

    pieces = contexts.select("anchor", "context", "copies", "data").mapInArrow(placed, "anchor long, context long, copies long, data binary, left long")
    pieces = pieces.select("*", F.col("anchor").alias("key"), F.lit(0).cast("long").alias("lo"), (F.col("left") + gram).alias("right"), F.lit(span).cast("long").alias("span"))
    done = None
    while True:
        pieces = stored(_lengthened(pieces), "pieces")
        large = stored(pieces.select("key", "sub").distinct().groupBy("key").count().where(F.col("count") > HOT).select("key"), "hot")
        ready = pieces.join(large, "key", "left_anti")
        once = ready.groupBy(F.col("key").alias("anchor"), F.col("sub").alias("context")).agg(F.sum("copies").alias("copies"), F.min("data").alias("data"))
        found = _indexed(once, span).select(F.col("anchor").alias("key"), F.col("context").alias("sub"), "runs")
        runs = F.transform("runs", lambda x: (x + F.col("lo")).cast("int"))
        marks = stored(ready.select("anchor", "context", "key", "sub", "lo").join(found, ["key", "sub"]).select("anchor", "context", runs.alias("runs")), "marked")
        done = marks if done is None else done.union(marks)
        if not large.head(1):
            return done
        pieces = pieces.join(large, "key", "left_semi")


def mark_repeats(docs: DataFrame, span: int = 200, gram: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, text, rest (its other columns) and marks,
    structs (start, runs) of windows whose bytes occur elsewhere; null if none do.

    Repeated rows are documents of their own, so they repeat each other.
    """
    small_batches(docs.sparkSession)
    base = with_row_id(docs, id_col, text_col)
    found = occurrences(base, span, gram)
    often = stored(found.groupBy("anchor").count().where("count > 1").select("anchor"), "often")  # stored, so that the join may split a large anchor
    found = stored(found.join(often, "anchor", "left_semi"), "contexts")
    different = stored(found.groupBy("anchor", "context").agg(F.count("*").alias("copies"), F.min(F.struct("rid", "start", "n")).alias("at")), "different")
    hot = stored(different.groupBy("anchor").count().where(F.col("count") > HOT).select("anchor"), "hot")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "replace")
                for k in range(0, len(rows), 10_000):
                    part = rows[k : k + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array([r[c] for r in part], pa.int64()) for c in ("anchor", "context", "copies")), pa.array([data[r["start"] : r["start"] + r["n"] - 1 + span] for r in part], pa.binary())],
                        names=["anchor", "context", "copies", "data"],
                    )

    def with_bytes(contexts: DataFrame) -> DataFrame:
        parts = F.struct("anchor", "context", "copies", F.col("at.start").alias("start"), F.col("at.n").alias("n"))
        wanted = contexts.groupBy(F.col("at.rid").alias("rid")).agg(F.collect_list(parts).alias("wanted"))
        return base.select("rid", "text").join(wanted, "rid").select("text", "wanted").mapInArrow(cut_out, "anchor long, context long, copies long, data binary")

    if hot.head(1):
        cut = stored(with_bytes(different), "bytes")  # whole texts are dealt for it, so once for all
        cool, warm = cut.join(hot, "anchor", "left_anti"), cut.join(hot, "anchor", "left_semi")
        marked = _indexed(cool, span).union(_marked_hot(warm, span, gram))
    else:
        marked = _indexed(with_bytes(different), span)
    marks = found.join(marked, ["anchor", "context"]).groupBy("rid").agg(F.collect_list(F.struct("start", "runs")).alias("marks"))
    return base.join(stored(marks, "marks"), "rid", "left").select("id", "text", "rest", "marks")


def spans_of(marks: list[dict] | None, span: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that marked windows cover."""
    spans = sorted((m["start"] + a, m["start"] + b - 1 + span) for m in marks or [] for a, b in zip(m["runs"][::2], m["runs"][1::2], strict=True))
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def remove_repeats(docs: DataFrame, span: int = 200, id_col: str = "doc_id", text_col: str = "text", gram: int = 64) -> DataFrame:
    """One row per row of ``docs``: id, rest (its other columns), n_bytes, n_removed,
    n_spans and kept, the bytes that no repeated ``span``-byte string covers.

    Strings are judged on the input; all their occurrences go. Null and empty
    texts keep nothing; null ids stay null.
    """
    marked = mark_repeats(docs, span, gram, id_col, text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, marks = batch.column(1).to_pylist(), batch.column(3).to_pylist()
            sizes, removed, counts, kept = [], [], [], []
            for text, mark in zip(texts, marks, strict=True):
                data, spans = (text or "").encode("utf-8", "replace"), spans_of(mark, span)
                sizes.append(len(data))
                removed.append(sum(b - a for a, b in spans))
                counts.append(len(spans))
                kept.append(without(data, spans))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(kept, pa.binary())],
                names=["id", "rest", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    types = dict(marked.dtypes)
    return marked.mapInArrow(cut, f"id {types['id']}, rest {types['rest']}, n_bytes long, n_removed long, n_spans long, kept binary")
