"""Groups of rows whose shingle sets are similar, by verified links.

SimHash fingerprints of the sets and their deletion variants (see ``variants``)
only propose pairs; a pair is a link if the exact Jaccard similarity of the two
sets is high enough. Equal sets are one node.

Before whole sets are fetched, pairs are dropped whose sizes alone exclude that
similarity, and pairs whose sketches are too far apart: a sketch has one bit of the
least hash in each of 32 bins, under several hash functions. Rows of buckets that are too
dense to list their pairs meet by their rarest shingles, of which similar sets share one,
and their sets are compared there.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, stored
from .graph import components
from .simhash import BLOCK
from .variants import Search
from .variants import links as linked

#: Segments have this many bits, and one more for each doubling of the rows beyond 2**22, so that buckets do not grow.
BITS, FREE = 12, 10
#: Words of a fingerprint at least: what is not cut into segments tells pairs just below the least similarity from those above.
WORDS = 4
#: Standard deviations by which whole fingerprints may differ more than on average.
Z = 2.2
#: Words of a sketch, its bins in each half of a word, the deviations allowed, and the size from which sets fill enough bins.
SKETCH, BINS, SKETCH_Z, FILLED = 4, 32, 3.0, 64


def search_for(rows: int, least: float, recall: float = 0.98) -> Search:
    """How to search among so many sets, that of pairs of similarity ``least`` this
    share meets in a bucket, and of more similar ones more.

    With q = 1 - p, where p is the chance that one bit of two such sets differs, a
    segment of k bits differs by at most one bit with the chance q^k + k p q^(k-1).
    Whole fingerprints may differ by Z standard deviations more than on average,
    which 98.6 % of such pairs do not exceed.
    """
    p = math.acos(2 * least / (1 + least)) / math.pi
    bits = max(BITS, rows.bit_length() - FREE)
    hit = (1 - p) ** bits + bits * p * (1 - p) ** (bits - 1)
    segments = math.ceil(math.log(1 - recall) / math.log(1 - hit))
    whole = 64 * max(WORDS, math.ceil(segments * bits / 64))
    return Search(whole // 64, segments, bits, math.ceil(whole * p + Z * math.sqrt(whole * p * (1 - p))))


def shingle_set(text: str | None, words: int, seed: int) -> np.ndarray:
    """Sorted XXH64 of the different shingles; a text of fewer words is one shingle."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined, ends = b" ".join(tokens), np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    size, digest = min(words, len(tokens)), xxhash.xxh64_intdigest
    starts, ends = np.concatenate([[0], ends[:-1] + 1])[: len(tokens) - size + 1].tolist(), ends[size - 1 :].tolist()
    return np.unique(np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts)))


def majority(hashes: np.ndarray, parts: int) -> list[int]:
    """The fingerprint of a set: each shingle counts once."""
    count = np.zeros((parts, 64), np.int64)
    for at in range(0, len(hashes), BLOCK):
        h = hashes[at : at + BLOCK]
        for part in range(parts):
            count[part] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(31)
    return np.packbits(2 * count > len(hashes), axis=1, bitorder="little").view(np.int64).ravel().tolist()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def sketch(hashes: np.ndarray) -> list[int]:
    """SKETCH words. Two sets' bits agree with the chance (1 + J) / 2, J their Jaccard
    similarity. An empty bin takes the bit of the next one that is not."""
    if not len(hashes):
        return [0] * SKETCH
    floors, bits = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1), []
    for turn in range(64 * SKETCH // BINS):
        h = np.sort(_mixed(hashes ^ np.uint64(0x9E3779B97F4A7C15 * (turn + 1) & (1 << 64) - 1)))
        bits.append(h[np.searchsorted(h, floors) % len(h)] & np.uint64(1))
    return np.packbits(np.concatenate(bits).astype(np.uint8), bitorder="little").view(np.int64).tolist()


class Plausible:
    """Whether sets may have a similarity of ``least``, by their sizes and sketches.

    Sizes exclude no pair wrongly. Of pairs of that similarity 0.13 % are farther apart than
    SKETCH_Z standard deviations, of more similar ones fewer.
    """

    names = ("size", *(f"s{k}" for k in range(SKETCH)))

    def __init__(self, least: float):
        share, bits = (1 - least) / 2, 64 * SKETCH
        self.least, self.distance = least, math.ceil(bits * share + SKETCH_Z * math.sqrt(bits * share * (1 - share)))

    def __call__(self, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        """Of rows of a and b, which are size and sketch."""
        small, large = np.minimum(a[0], b[0]), np.maximum(a[0], b[0])
        far = sum((np.bitwise_count((x ^ y).view(np.uint64)).astype(np.int64) for x, y in zip(a[1:], b[1:], strict=True)), np.zeros(len(small), np.int64))
        return (small >= self.least * large - 1e-9) & ((far <= self.distance) | (small < FILLED))

    def of(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """The plausible ones of ``pairs``; ``nodes`` have ``names``."""
        one, two = (nodes.select(F.col("node").alias(side), F.struct(*self.names).alias(f"of_{side}")) for side in "ab")
        both = pairs.join(one, "a").join(two, "b")
        sizes = [F.col(f"of_{side}.size") for side in "ab"]
        far = sum((F.bit_count(F.col(f"of_a.{n}").bitwiseXOR(F.col(f"of_b.{n}"))) for n in self.names[1:]), F.lit(0))
        fits = F.least(*sizes) >= F.lit(self.least) * F.greatest(*sizes) - F.lit(1e-9)
        return both.where(fits & ((far <= self.distance) | (F.least(*sizes) < FILLED))).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` whose sets (node, hashes) have a Jaccard similarity of ``least``."""
    one, two = (sets.select(F.col("node").alias(n), F.col("hashes").alias(f"of_{n}")) for n in "ab")
    both = pairs.join(one, "a").join(two, "b").select("a", "b", F.size("of_a").alias("m"), F.size("of_b").alias("n"), F.size(F.array_intersect("of_a", "of_b")).alias("k"))
    return both.where(F.col("k") >= F.lit(least) * (F.col("m") + F.col("n") - F.col("k")) - F.lit(1e-9)).select("a", "b")


def rarest(sets: DataFrame, least: float) -> DataFrame:
    """(key, node): of each of ``sets`` (node, hashes) the rarest shingles, so many that
    any two sets of a Jaccard similarity of ``least`` have one of them in common.

    Such a set x has at least ``least`` |x| shingles in the other one, so the first
    |x| - ceil(least |x|) + 1 in any order that holds for all sets do. In order of frequency
    a passage that many sets hold comes last, and does not bring them together.
    """
    held = sets.select("node", F.size("hashes").alias("size"), F.explode("hashes").alias("key"))
    often = stored(held.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "often")
    nth = F.row_number().over(Window.partitionBy("node").orderBy("n", "key"))
    ranked = held.join(often, "key", "left").select("node", "size", "key", F.coalesce("n", F.lit(1)).alias("n")).withColumn("nth", nth)
    return ranked.where((F.col("nth") <= F.col("size") - F.ceil(F.lit(least) * F.col("size") - F.lit(1e-9)) + 1) & (F.col("n") > 1)).select("key", "node")


def alike(sets: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Of pairs (i, j) of ``sets``, sorted by i, whether their similarity is ``least``."""
    out, edges = np.zeros(len(i), bool), np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1], [True]])[: len(i) + 1])
    for lo, hi in zip(edges.tolist(), edges[1:].tolist(), strict=False) if len(i) else ():
        one, others = np.sort(sets[i[lo]]), sets[j[lo:hi]]
        sizes = np.array([len(x) for x in others])
        every = np.concatenate(others)
        hit = one[np.minimum(np.searchsorted(one, every), len(one) - 1)] == every
        both = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
        out[lo:hi] = both >= least * (len(one) + sizes - both) - 1e-9
    return out


def groups(rows: DataFrame, words: int = 5, least: float = 0.8, seed: int = 42) -> DataFrame:
    """(rid, root) for each row (rid long, unique and the same in each pass; text):
    rows of one root are connected by links of similarity ``least`` or more.
    Texts without words are alike."""
    search = search_for(rows.count(), least)
    search.plausible = plausible = Plausible(least)
    search.similar = lambda sets, i, j: alike(sets, i, j, least)
    names = [f"f{k}" for k in range(search.parts)]

    def prints_of(batch: dict) -> dict:
        sets = [shingle_set(x, words, seed) for x in batch["text"]]
        keys = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets]).reshape(-1, 2)
        found, drawn = [majority(s, search.parts) for s in sets], [(len(s), *sketch(s)) for s in sets]
        out = {"rid": batch["rid"], "d0": keys[:, 0], "d1": keys[:, 1]} | {n: [f[k] for f in found] for k, n in enumerate(names)}
        return out | {n: [d[k] for d in drawn] for k, n in enumerate(plausible.names)}

    def sets_of(batch: dict) -> dict:
        return {"node": batch["rid"], "hashes": [shingle_set(x, words, seed).view(np.int64) for x in batch["text"]]}

    texts, columns = rows.select("rid", "text"), [*names, *plausible.names]
    prints = stored(map_batches(texts, prints_of, "rid long, d0 long, d1 long, " + ", ".join(f"{n} long" for n in columns)), "prints")
    nodes = stored(prints.groupBy("d0", "d1").agg(F.min("rid").alias("node"), *(F.min(n).alias(n) for n in columns)), "nodes")

    def accepted(pairs: DataFrame) -> DataFrame:
        pairs = stored(plausible.of(pairs, nodes), "plausible")
        known = pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).distinct()
        return verified(pairs, fetched(known), least)

    def fetched(known: DataFrame) -> DataFrame:
        return stored(map_batches(texts.join(known, "rid"), sets_of, "node long, hashes array<long>"), "sets")

    def narrow(some: DataFrame) -> tuple[DataFrame, DataFrame]:
        sets = fetched(some.select(F.col("node").alias("rid")))
        return rarest(sets, least), sets

    roots = components(linked(nodes, search, accepted, narrow))
    rooted = nodes.select("d0", "d1", "node").join(roots, "node", "left").select("d0", "d1", F.coalesce("root", "node").alias("root"))
    return prints.select("rid", "d0", "d1").join(rooted, ["d0", "d1"]).select("rid", "root")
