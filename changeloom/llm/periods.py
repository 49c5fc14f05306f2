"""Runs of periodic words: found in tiles by scale, stitched by document and period.

A run of period q is a stretch in which words q apart are identical, of at least 4 q
words. Periods are sorted into octaves [s, 2 s), s = 2**k. In the octave's tiles a
boundary stands at every s-th word, so a run holds several of them. A boundary from
which s words come again q words later gets two Z-functions, of the words ahead and of
those behind, which give how far words q apart agree around it. What tiles find are
fragments: intervals of places whose word is that q words later. Tiles overlap by 5 s
words, so that in one of them each fragment is whole or goes to the tile's end, and
fragments of one document and period that touch are one.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ROWS, map_batches, small_batches, stored, with_row_id

WORD = re.compile(r"[^\x20\x09-\x0D]+")
POWERS, SHORTEST = 4, 6
#: Octaves 0 to BASE share tiles, which start every STEP words.
BASE, STEP, OVERLAP = 8, 4096, 5
#: Texts of more words have their tiles dealt to all tasks.
LONG = 1_000_000
#: Bytes of tiles in an Arrow batch.
BATCH = 8_000_000

FRAGMENTS = [("rid", pa.int64()), ("period", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())]
TILES = [("rid", pa.int64()), ("n", pa.int64()), ("start", pa.int64()), ("octave", pa.int32()), ("words", pa.binary())]
#: A fragment or a tile that is still to be solved.
EITHER = pa.schema([("fragment", pa.struct(FRAGMENTS)), ("tile", pa.struct(TILES))])
EITHER_SQL = "fragment struct<rid: long, period: long, begin: long, end: long>, tile struct<rid: long, n: long, start: long, octave: int, words: binary>"


def cut(n: int) -> Iterator[tuple[int, int, int]]:
    """(octave, start, end) of the tiles of n words; octave BASE stands for all up to it."""
    octave = BASE
    while octave == BASE or POWERS << octave <= n:
        step = STEP if octave == BASE else 16 << octave
        overlap = OVERLAP << octave
        for start in range(0, max(1, n - overlap), step):
            yield octave, start, min(n, start + step + overlap)
        octave += 1


def _solved_or_dealt(batches: Iterator[pa.RecordBatch], long: int) -> Iterator[pa.RecordBatch]:
    """Fragments of texts of at most ``long`` words, and the tiles of longer ones."""
    here, away, size = [], [], 0
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                number: dict[str, int] = {}
                words = np.array([number.setdefault(w, len(number)) for w in WORD.findall(text or "")], np.int32)
                if len(words) < SHORTEST or len(number) == len(words):
                    continue
                for octave, start, end in cut(len(words)):
                    tile = rid, len(words), start, octave, words[start:end]
                    (away if len(words) > long else here).append(tile)
                    size += 4 * (end - start)
                    if size > BATCH:
                        yield from _either(here, away)
                        here, away, size = [], [], 0
    yield from _either(here, away)


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from _either([(*head, np.frombuffer(words, np.int32)) for *head, words in zip(*(c.to_pylist() for c in batch.columns))], [])


def _either(here: list[tuple], away: list[tuple]) -> Iterator[pa.RecordBatch]:
    found = [dict(zip(("rid", "period", "begin", "end"), f)) for f in tile_fragments(here)]
    tiles = [dict(zip(("rid", "n", "start", "octave", "words"), (*t[:4], t[4].tobytes()))) for t in away]
    if found or tiles:
        columns = [*found, *[None] * len(tiles)], [*[None] * len(found), *tiles]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, EITHER)], schema=EITHER)
    pa.default_memory_pool().release_unused()


def z_function(s: list[int]) -> list[int]:
    """For each place of s how much of what starts there is how s itself starts (0 for place 0)."""
    n, z, left, right = len(s), [0] * len(s), 0, 0
    first = s[0] if s else None
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        elif s[i] != first:
            continue
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i], left, right = k, i, i + k
    return z


def _primes(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] * (n > 1)


def around(words: np.ndarray, at: int, s: int, periods: list[int]) -> Iterator[tuple[int, int, int]]:
    """(q, begin, end) for those of ``periods`` in [s, 2 s) whose words agree for s
    places from the boundary ``at`` on; up to s places behind and 2 s ahead count.

    Periods with a shorter one within (powers) are left out: whatever has them has the
    shorter one all along.
    """
    ahead = z_function(words[at : at + 4 * s].tolist())
    behind = None
    for q in periods:
        if q >= len(ahead) or ahead[q] < s or any(ahead[q // r] >= q - q // r for r in _primes(q)):
            continue
        if behind is None:
            upto = min(at + 2 * s, len(words))
            left = words[max(0, at - s) : at][::-1].tolist()
            behind = z_function([*left, None, *words[at:upto][::-1].tolist()])
        yield q, at - behind[len(left) + 1 + upto - at - q], at + min(ahead[q], 2 * s)


def fragments(words: np.ndarray, octaves: range) -> Iterator[tuple[int, int, int]]:
    """(q, begin, end): maximal intervals of at least 2 s places whose word is that q
    places later, for periods of the octaves; of those that no boundary shows none."""
    grams, reach = (words.astype(np.int64) + 1).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.zeros(len(words), np.int64)
    grams ^= grams >> np.uint64(29)
    for k in range(octaves.stop):
        s, n = 1 << k, len(grams)
        if k in octaves and n > s:
            rows = np.zeros(-(-n // s) * s, np.uint64)
            rows[:n] = grams
            rows = rows.reshape(-1, s)
            boundary, shift = np.nonzero(rows[1:] == rows[:-1, :1])  # grams of s words that come again
            found, periods = defaultdict(list), defaultdict(list)
            inside = reach[boundary * s] >= boundary * s + 3 * s  # of a run of at most half the period
            for j, q in zip(boundary[~inside].tolist(), (shift[~inside] + s).tolist()):
                periods[j * s].append(q)
            for at, several in periods.items():
                for q, begin, end in around(words, at, s, several):
                    if found[q] and begin <= found[q][-1][1]:
                        found[q][-1][1] = max(end, found[q][-1][1])
                    else:
                        found[q].append([begin, end])
            before, known = (known if k > octaves.start else []), []
            for q, intervals in found.items():
                for begin, end in intervals:
                    if end - begin >= 2 * s:
                        known.append((begin, end + q))
                        yield q, begin, end
            for begin, end in before:
                np.maximum(reach[begin:end], end, out=reach[begin:end])
        if n <= s:
            return
        grams = grams[: n - s] * np.uint64(0xD6E8FEB86659FD93 + 2 * k) + grams[s:]
        grams ^= grams >> np.uint64(31)


def tile_fragments(tiles: list[tuple[int, int, int, int, np.ndarray]]) -> Iterator[tuple[int, int, int, int]]:
    """(rid, q, begin, end) of tiles (rid, n, start, octave, words): fragments that are
    runs or that go to the edge of a tile within its text. Base tiles are solved side
    by side, with a word of its own between two."""
    groups, size = [[]], 0
    for tile in sorted((t for t in tiles if t[3] == BASE), key=lambda t: len(t[4])):
        groups[-1].append(tile)
        size += len(tile[4])
        if size > 64 * STEP:
            groups.append([])
            size = 0
    groups += [[t] for t in tiles if t[3] > BASE]
    for group in filter(None, groups):
        parts = [x for i, t in enumerate(group) for x in (t[4], np.array([-2 - i], np.int32))]
        starts = np.cumsum([0] + [len(t[4]) + 1 for t in group])
        top = max(len(t[4]) for t in group)
        octave = group[0][3]
        octaves = range(octave, octave + 1) if octave > BASE else range(min(BASE + 1, max(1, (top // POWERS).bit_length())))
        for q, begin, end in fragments(np.concatenate(parts), octaves):
            i = int(np.searchsorted(starts, begin, "right")) - 1
            rid, n, start, _, words = group[i]
            begin, end = begin - int(starts[i]), end - int(starts[i])
            cut_left, cut_right = begin == 0 and start > 0, end + q == len(words) and start + len(words) < n
            if end - begin >= (POWERS - 1) * q or cut_left or cut_right:
                yield rid, q, start + begin, start + end


def find_runs(docs: DataFrame) -> DataFrame:
    """(rid, start, length, period) of every run of ``docs`` (rid, text)."""
    small_batches(docs.sparkSession)
    long = LONG
    first = stored(docs.select("rid", "text").mapInArrow(lambda batches: _solved_or_dealt(batches, long), EITHER_SQL), "tiles")
    dealt = first.where("tile IS NOT NULL").select("tile.*").repartition("rid", "octave", "start")
    found = first.union(dealt.mapInArrow(_solved, EITHER_SQL)).where("fragment IS NOT NULL").select("fragment.*")
    w = Window.partitionBy("rid", "period").orderBy("begin", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    parts = found.withColumn("_new", F.coalesce((F.col("begin") > before).cast("int"), F.lit(1)))
    whole = parts.withColumn("_part", F.sum("_new").over(w)).groupBy("rid", "period", "_part").agg(F.min("begin").alias("start"), F.max("end").alias("end"))
    runs = whole.select("rid", "start", (F.col("end") - F.col("start") + F.col("period")).alias("length"), "period")
    runs = runs.where(f"length >= greatest({SHORTEST}, {POWERS} * period)")
    return runs.groupBy("rid", "start", "length").agg(F.min("period").alias("period"))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, runs, kept.

    Words are stretches without space, tab, line feed and the like (9 to 13), numbered
    from 0. runs holds (start, length, period), sorted by start and period: maximal
    stretches of smallest period q, of max(6, 4 q) words or more. kept is the text
    without the words that a run repeats, all that any run holds behind its first q
    words, joined by one space.

    A null text counts as an empty one, which has no words, and no runs; null and
    repeated ids of any type keep a row each; an empty table gives one; other columns
    are ignored, whatever their names. A tile's task holds some 16 words for each of
    its period's, so at most a few times the words of one text.
    """
    rows = with_row_id(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text").select("rid", "id", "text")
    runs = stored(find_runs(rows), "runs")
    each = runs.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    id_type = dict(rows.dtypes)["id"]

    def kept(batch: dict) -> dict:
        numbers, texts = [], []
        for text, found in zip(batch["text"], batch["runs"]):
            words = WORD.findall(text or "")
            numbers.append(len(words))
            if found:
                keep = np.ones(len(words), bool)
                for r in found:
                    keep[r["start"] + r["period"] : r["start"] + r["length"]] = False
                words = [words[i] for i in np.flatnonzero(keep)]
            texts.append(" ".join(words))
        return {"id": batch["id"], "n_words": numbers, "runs": [[{k: r[k] for k in ("start", "length", "period")} for r in found or []] for found in batch["runs"]], "kept": texts}

    # Never by broadcast: runs grow with the texts, and so does what is sent.
    out = map_batches(rows.join(each.hint("merge"), "rid", "left").select("id", "text", "runs"), kept, f"id {id_type}, n_words long, runs array<struct<start: long, length: long, period: long>>, kept string")
    return out.withColumnRenamed("id", id_col)
