"""Links between fingerprints, found by deletion variants of their segments.

A fingerprint is cut into segments; two fingerprints are compared if one of their
segments differs by at most one bit. Each segment is indexed once for each of its
bits with that bit blanked out, so such fingerprints have a variant in common, and
rows of equal variants meet in a bucket.

Of a bucket's pairs that are near enough each is taken in its first common variant
only. Where a bucket of more than ``DENSE`` rows has many, as among the copies of
one text, only a spanning forest is taken first; that its pairs too are taken in
their first common variant alone disconnects nothing, since there a forest
connects them by such pairs again. A bucket of more than ``MOST`` rows is
dealt out to blocks, each compared with itself and with one of them. What that
leaves is made up for when the components of these links are known: of such
buckets, rows of different components are compared, and rows of the bucket's main
component, which are most, stay in their blocks while the few others visit all. Rows
that are near no other row of such a bucket have no part in that. Where pairs are
verified further, rows that are plausible partners of a row of another component
meet by what links have in common (``narrow``) and are verified where they meet, so
that pairs which are near but no links are compared but never listed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .graph import components

DENSE, MOST = 16, 4096
#: Hashes of a set that count as one row of a block.
HASHES = 256
#: Near pairs for each row of a bucket beyond which a forest is taken, and rows looked at together.
MANY, ROWS = 4, 8192
#: What became of a bucket: a pair of it, a forest with this row of it, nothing yet.
PAIR, FOREST, NOTHING = 0, 1, 2


def _segment(prints: np.ndarray, lo: int, bits: int) -> np.ndarray:
    """Bits lo .. lo + bits of each row of words."""
    word, shift = divmod(lo, 64)
    found = prints[:, word] >> np.uint64(shift)
    if shift + bits > 64:
        found = found | prints[:, word + 1] << np.uint64(64 - shift)
    return found & np.uint64((1 << bits) - 1)


def _variant(prints: np.ndarray, number: int, bits: int, bit: int) -> np.ndarray:
    segment = _segment(prints, number * bits, bits)
    return segment & np.uint64(~(1 << bit) & (1 << bits) - 1) | np.uint64((number << 6 | bit) << 40)


def _first_variant(differ: np.ndarray, segments: int, bits: int) -> np.ndarray:
    """The number of the first variant in which fingerprints with these differing bits agree."""
    first = np.full(len(differ), -1, np.int64)
    for number in reversed(range(segments)):
        segment = _segment(differ, number * bits, bits)
        one = np.bitwise_count(segment)
        bit = np.bitwise_count((segment - np.uint64(1)) & ~segment).astype(np.int64)
        first = np.where(one == 0, number << 6, np.where(one == 1, number << 6 | bit, first))
    return first


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.uint16)


class Search:
    """How fingerprints of ``parts`` words are cut into ``segments`` of ``bits`` and up to
    which ``distance`` they are near. ``forest_is_enough`` says that near pairs are
    links as they are, so that a forest of them has their components."""

    def __init__(self, parts: int, segments: int, bits: int, distance: int, forest_is_enough: bool = False):
        if segments * bits > 64 * parts or bits > 40:
            raise ValueError("segments do not fit")
        self.parts, self.segments, self.bits, self.distance, self.enough = parts, segments, bits, distance, forest_is_enough
        self.plausible: Callable[[list[np.ndarray], list[np.ndarray]], np.ndarray] | None = None
        self.similar: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None  # of sets, pairs (i, j) by i

    def mine(self, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pairs' first common variant is that of their bucket's ``key``."""
        return _first_variant(a ^ b, self.segments, self.bits) == key >> 40

    def meet(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pairs have a common variant."""
        return _first_variant(a ^ b, self.segments, self.bits) >= 0

    def small(self, key: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Near pairs of many small buckets at once; rows are sorted by key."""
        alive, step, found = np.arange(len(key)), 1, [np.zeros((2, 0), np.int64)]
        while True:
            alive = alive[alive < len(key) - step]
            alive = alive[key[alive] == key[alive + step]]
            if not len(alive):
                break
            near = alive[_apart(prints[alive], prints[alive + step]) <= self.distance]
            found.append(np.stack([near, near + step]))
            step += 1
        i, j = np.concatenate(found, axis=1)
        mine = self.mine(key[i], prints[i], prints[j])
        return i[mine], j[mine]

    def near(self, top: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Near pairs of rows ``top`` and all rows."""
        far = np.zeros((len(top), len(prints)), np.uint16)
        for part in range(self.parts):
            far += np.bitwise_count(prints[top, None, part] ^ prints[None, :, part])
        i, j = np.nonzero(far <= self.distance)
        return top[i], j

    def dense(self, key: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Near pairs of one bucket, rows sorted by node, or, where they are many, a
        spanning forest of links to small nodes; and of a forest the rows that are in it."""
        n, found, woods = len(prints), 0, np.zeros(0, np.int64)
        parts, step = [np.zeros((2, 0), np.int64)], max(1, (1 << 20) // n)
        for top in range(0, n, step):
            i, j = self.near(np.arange(top, min(n, top + step)), prints)
            parts.append(np.stack([i, j])[:, j < i])
            found += parts[-1].shape[1]
            if found > MANY * n:
                parts = [self._forest(prints)]
                woods = np.unique(parts[0])
                break
        i, j = np.concatenate(parts, axis=1)
        mine = self.mine(np.full(len(i), key), prints[i], prints[j])
        return i[mine], j[mine], woods

    def _forest(self, prints: np.ndarray) -> np.ndarray:
        label, links = np.arange(len(prints)), []
        step = max(1, (1 << 20) // len(prints))
        for top in range(0, len(prints), step):
            i, j = self.near(np.arange(top, min(len(prints), top + step)), prints)
            edges = np.searchsorted(i, np.arange(top, min(len(prints), top + step) + 1)).tolist()
            for a, lo, hi in zip(range(top, len(prints)), edges, edges[1:], strict=False):
                partners = j[lo : lo + np.searchsorted(j[lo:hi], a)]
                others, first = np.unique(label[partners], return_index=True)
                links += [(a, int(partners[k])) for k in first]
                if len(others) > 1:
                    label[np.isin(label, others)] = others[0]
                if len(others):
                    label[a] = others[0]
        return np.array(links, np.int64).reshape(-1, 2).T


def _long(columns: list[str]) -> str:
    return ", ".join(f"{c} long" for c in columns)


def _arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def keyed(nodes: DataFrame, search: Search) -> DataFrame:
    """``nodes`` (longs, the fingerprint's words last) with key, once for each variant."""
    columns = ["key", *nodes.columns]

    def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.stack(_arrays(batch)[-search.parts :], axis=1).view(np.uint64)
            for number in range(search.segments):
                for bit in range(search.bits):
                    yield pa.RecordBatch.from_arrays([pa.array(_variant(prints, number, search.bits, bit).view(np.int64)), *batch.columns], names=columns)

    return nodes.mapInArrow(variants, _long(columns))


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], bool]]:
    """Columns of rows sorted by key: whole buckets, and pieces of those of more than MOST rows."""
    held, large = None, None
    for columns in batches_of(batches, ROWS):
        if held is not None:
            columns, held = [np.concatenate(pair) for pair in zip(held, columns, strict=True)], None
        if large is not None:
            cut = int(np.searchsorted(columns[0], large, side="right"))
            if cut:
                yield [c[:cut] for c in columns], True
            columns = [c[cut:] for c in columns]
            if not len(columns[0]):
                continue
            large = None
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        if cut:
            yield [c[:cut] for c in columns], False
        rest = [c[cut:] for c in columns]
        if len(rest[0]) > MOST:
            large = rest[0][0]
            yield rest, True
        else:
            held = rest
    if held is not None:
        yield held, False


def batches_of(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[np.ndarray]]:
    """Columns of about so many rows at a time."""
    held, n = [], 0
    for batch in batches:
        held.append(_arrays(batch))
        n += batch.num_rows
        if n >= rows:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held, n = [], 0
    if n:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _first_round(rows: DataFrame, search: Search) -> DataFrame:
    """(kind, key, a, b): PAIR with the pair's nodes, larger first; FOREST with a bucket's key
    and, as a, a node that is near another of it; NOTHING with a bucket's key and, as a,
    how many of its rows."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, node, *words), large in _buckets(batches):
            if large:
                yield batch_of([(NOTHING, int(key[0]), len(key), None)])
                continue
            prints = np.stack(words, axis=1).view(np.uint64)
            edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            counts = np.diff(edges)
            at = np.flatnonzero(np.repeat(counts <= DENSE, counts))
            i, j = search.small(key[at], prints[at])
            pairs, left = [np.stack([node[at[i]], node[at[j]]], axis=1)], []
            for k in np.flatnonzero(counts > DENSE).tolist():
                lo, hi = int(edges[k]), int(edges[k + 1])
                if hi - lo > MOST:
                    left.append((NOTHING, int(key[lo]), hi - lo, None))
                    continue
                a, b, woods = search.dense(int(key[lo]), prints[lo:hi])
                pairs.append(np.stack([node[lo + a], node[lo + b]], axis=1))
                if not search.enough:
                    left += [(FOREST, int(key[lo]), x, None) for x in node[lo + woods].tolist()]
            found = np.concatenate(pairs)
            out = [(PAIR, None, a, b) for a, b in zip(found.max(axis=1).tolist(), found.min(axis=1).tolist(), strict=True)] + left
            if out:
                yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["kind", "key", "a", "b"])

    dealt = rows.repartition("key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(compare, "kind int, key long, a long, b long")


def _meet(rows: DataFrame, search: Search, every: bool, variants: bool = True, ends: bool = False) -> DataFrame:
    """(a, b) of the rows of a block (own) and of those and its visitors: all near pairs of
    different labels, or a forest of the own and one link from each to a visitor. Where keys
    are no ``variants`` rows have their sets behind the label, and of pairs with a common
    variant those are taken whose sets are similar. ``ends`` asks for (node), the rows
    that have such a pair, instead of the pairs."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, own = None, None
        for columns in batches_of(batches, ROWS):
            key, at, visits = columns[:3]
            edges = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (at[1:] != at[:-1]) | (visits[1:] != visits[:-1]), [True]])).tolist()
            for lo, hi in zip(edges, edges[1:], strict=False):
                part = [c[lo:hi] for c in columns[3:]]
                if (key[lo], at[lo]) != block:
                    block, own = (key[lo], at[lo]), None
                yield pairs_of(int(key[lo]), own, part, bool(visits[lo]))
                if not visits[lo]:
                    own = part if own is None else [np.concatenate(c) for c in zip(own, part, strict=True)]

    def pairs_of(key: int, own: list[np.ndarray] | None, part: list[np.ndarray], visit: bool) -> pa.RecordBatch:
        found = [np.zeros((0, 2), np.int64)]
        own = [c[:0] for c in part] if own is None else own
        node, label, *further = (np.concatenate(c) for c in zip(own, part, strict=True))
        sets = None if variants else further.pop(0)
        further, words = further[: -search.parts], further[-search.parts :]
        prints, old = np.stack(words, axis=1).view(np.uint64), len(own[0])
        step = max(1, (1 << 20) // max(1, len(node)))
        alone = every and len(label) and label.min() == label.max()
        for top in range(len(node) if alone else old, len(node), step):
            i, j = search.near(np.arange(top, min(len(node), top + step)), prints)
            ok = j < old if visit else j < i
            i, j = i[ok], j[ok]
            if every:
                ok = label[i] != label[j]
                i, j = i[ok], j[ok]
            if search.plausible:
                ok = search.plausible([c[i] for c in further], [c[j] for c in further])
                i, j = i[ok], j[ok]
            if every:
                ok = search.mine(np.full(len(i), key), prints[i], prints[j]) if variants else search.meet(prints[i], prints[j])
                i, j = i[ok], j[ok]
                if not variants:
                    ok = search.similar(sets, i, j)
                    i, j = i[ok], j[ok]
            else:  # one link of each row to the smallest node
                side, other = (j, i) if visit else (i, j)
                order = np.lexsort((node[other], side))
                side, other = side[order], other[order]
                first = np.concatenate([[True], side[1:] != side[:-1]])[: len(side)]
                i, j = side[first], other[first]
            found.append(np.unique(np.stack([node[i], node[j]])).reshape(-1, 1) if ends else np.stack([node[i], node[j]], axis=1))
        if ends:
            return pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([f.ravel() for f in found])))], names=["node"])
        pairs = np.concatenate(found)
        return pa.RecordBatch.from_arrays([pa.array(pairs.max(axis=1, initial=-(1 << 63))), pa.array(pairs.min(axis=1, initial=(1 << 63) - 1))], names=["a", "b"])

    dealt = rows.repartition("key", "at").sortWithinPartitions("key", "at", "visits", "node")
    return dealt.mapInArrow(compare, "node long" if ends else "a long, b long").distinct()


def _by_node(rows: DataFrame, info: DataFrame) -> DataFrame:
    """``rows`` (key, node, ...) with what ``info`` tells of their nodes. A node, which is in
    many buckets, is joined once with the list of its rows, so that what is told of it is
    not fetched for each of them."""
    of = rows.groupBy("node").agg(F.collect_list(F.struct(*(c for c in rows.columns if c != "node"))).alias("_rows"))
    return of.join(info, "node").withColumn("_row", F.explode("_rows")).select("_row.*", *info.columns)


def _main(rows: DataFrame) -> DataFrame:
    """(key, main): the label of most rows."""
    return rows.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"))


def _mixed(rows: DataFrame, size) -> DataFrame:
    """Rows (key, node, label, ...) of keys with several labels, and n, the ``size`` of their keys."""
    rows = stored(rows, "open")
    mixed = rows.groupBy("key").agg(size.alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    return stored(rows.join(mixed.select("key", "n"), "key"), "open")


def links(nodes: DataFrame, search: Search, verified: Callable[[DataFrame], DataFrame] | None = None, narrow: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None) -> DataFrame:
    """(a, b) of ``nodes`` (node, f0, ...) whose components are those of all near pairs,
    or of all that ``verified`` lets through. ``narrow`` gives (key, node) and (node, hashes)
    for some nodes (node), of which any two that ``verified`` lets through have a key in
    common; ``search.similar`` then says of sets of hashes what ``verified`` would say."""
    accept = verified or (lambda pairs: pairs)
    names = [f"f{k}" for k in range(search.parts)]
    further = list(search.plausible.names) if search.plausible else []
    rows = keyed(nodes.select("node", *names), search)
    first = stored(_first_round(rows, search), "proposed")
    pairs = first.where(f"kind = {PAIR}").select("a", "b")
    woods = first.where(f"kind = {FOREST}").select("key", F.col("a").alias("node"))
    large = stored(first.where(f"kind = {NOTHING}").groupBy("key").agg(F.sum("a").alias("n")), "buckets")
    done = stored(accept(stored(pairs.distinct(), "proposed")), "links")
    some = bool(large.head(1))
    if not some and not woods.head(1):
        return done
    blocks = F.ceil(F.col("n") / (MOST // 2))
    own = F.pmod(F.xxhash64("node"), blocks)

    def dealt(rows: DataFrame, goes_round) -> DataFrame:
        columns = ["node", "label", *(["hashes"] if "hashes" in rows.columns else []), *further, *names]
        placed = rows.select("key", *columns, own.alias("own"), F.explode(F.when(goes_round, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own))).alias("at"))
        return placed.select("key", "at", (F.col("at") != F.col("own")).cast("long").alias("visits"), *columns)

    if some:
        rows = keyed(nodes.select("node", *further, *names), search)
        near = _meet(dealt(rows.join(large, "key").withColumn("label", F.col("node")), own == 0), search, every=False)
        done = stored(done.union(accept(stored(near, "proposed"))), "links")
    roots = components(done)
    labelled = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("label"), *further, *names)
    # A bucket of which a forest was taken has MOST rows at most and meets in one task as it is.
    rows = _by_node(woods, labelled).select("key", F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("visits"), "node", "label", *further, *names)
    if some:
        open_ = keyed(nodes.select("node", *names), search).select("key", "node").join(large.select("key"), "key")
        open_ = _mixed(_by_node(open_, labelled.select("node", "label")), F.count("*"))
        main = _main(open_)
        rows = rows.union(dealt(_by_node(open_.drop("label").join(main, "key"), labelled), F.col("label") != F.col("main")))
    if not narrow:
        return done.union(stored(accept(stored(_meet(rows, search, every=True), "proposed")), "links"))
    keys, sets = narrow(stored(_meet(rows, search, every=True, ends=True), "ends"))
    rows = _by_node(keys, labelled.select("node", "label").join(sets.select("node", F.size("hashes").alias("hashed")), "node"))
    rows = _mixed(rows, F.greatest(F.count("*"), F.ceil(F.sum("hashed") / HASHES))).drop("hashed")  # a block of large sets has few
    main = _main(rows)
    rows = _by_node(rows.drop("label").join(main, "key"), labelled.join(sets, "node"))
    return done.union(stored(_meet(dealt(rows, F.col("label") != F.col("main")), search, every=True, variants=False), "links"))
