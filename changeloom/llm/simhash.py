"""SimHash near-dedup with deletion-variant signatures.

A fingerprint is cut into so few segments that, at the distance asked for, one of
them differs by at most one bit: n segments serve distances below 2n. Variants of
segments with one bit blanked out bring such fingerprints together (see
``variants``); whole fingerprints are then compared.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored
from .graph import components
from .variants import Search
from .variants import links as linked

#: Shingles whose bits are counted at a time.
BLOCK = 1 << 15


def fingerprint(text: str | None, words: int, parts: int, seed: int) -> list[int]:
    """``parts`` signed 64-bit numbers. Without words all are zero.

    The first has the majority bits of the shingles' XXH64; each further one
    those of the hash mixed once more.
    """
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return [0] * parts
    joined, ends = b" ".join(tokens), np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    size = min(words, len(tokens))
    starts, ends = np.concatenate([[0], ends[:-1] + 1])[: len(tokens) - size + 1].tolist(), ends[size - 1 :].tolist()
    count, digest = np.zeros((parts, 64), np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), BLOCK):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)], np.uint64)
        for part in range(parts):
            count[part] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(31)
    return np.packbits(2 * count > len(starts), axis=1, bitorder="little").view(np.int64).ravel().tolist()


def links(prints: DataFrame, parts: int, segments: int, distance: int) -> DataFrame:
    """(a, b) for distinct fingerprints (node long, f0 long, ...): enough of the links
    of at most ``distance`` bits for the components of all."""
    if distance >= 2 * segments:
        raise ValueError("too few segments for this distance")
    search = Search(parts, segments, 64 * parts // segments, distance, forest_is_enough=True)
    return linked(prints, search)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, parts: int = 1, segments: int = 2, distance: int = 2, seed: int = 42) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (hexadecimal, 16 digits a part), component_id.

    component_id is the smallest id that can be reached over links of
    fingerprints at most ``distance`` bits apart, null only if no such row has an
    id. Null and empty texts have fingerprint zero and are linked like any other;
    repeated rows fall into one component; other columns are ignored, whatever
    their names.
    """
    id_type, names = dict(docs.dtypes)[id_col], [f"f{k}" for k in range(parts)]

    def prints_of(rows: dict) -> dict:
        found = [fingerprint(x, words, parts, seed) for x in rows["text"]]
        return {"rid": rows["rid"], "id": rows["id"]} | {n: [f[k] for f in found] for k, n in enumerate(names)}

    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = stored(map_batches(base, prints_of, f"rid long, id {id_type}, " + ", ".join(f"{n} long" for n in names)), "prints")
    nodes = stored(rows.groupBy(*names).agg(F.min("rid").alias("node"), F.min("id").alias("least")), "nodes")
    roots = components(stored(links(nodes, parts, segments, distance), "near"))
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select(*names, "component_id")
    printed = F.concat(*(F.lower(F.lpad(F.hex(n), 16, "0")) for n in names))
    return rows.join(named, names).select(F.col("id").alias(id_col), printed.alias("fingerprint"), "component_id")
