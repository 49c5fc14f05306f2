"""Minimax contiguous partition of rows into shards, with DataFrame functions only.

Rows of equal text form an atomic group. Groups stand in the order of a 64-bit
hash of the text; shards are contiguous runs of groups, and the largest shard is
as small as this order allows. The smallest feasible capacity is found by binary
search, each candidate being checked greedily over group sizes.

The search sees sums over cells of neighbouring keys, a bounded number of them
whatever the number of groups. It brackets the capacity between what would be
feasible if cells could be cut anywhere and what is feasible when cutting only
between cells. Cells in which a cut can lie are then summed more finely, until
both bounds are equal; the cuts are then exact.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

COARSE_BITS, FINER_BITS = 12, 8


def _steps(ends: list[int], whole: list[bool], capacity: int, shards: int, fine: bool) -> list[int]:
    """Sums up to which a greedy walk gets with 1 .. ``shards`` shards.

    ``ends`` are running sums behind each cell, ``whole`` tells which cells are
    one group. With ``fine`` the other cells may be cut anywhere.
    """
    at, out = 0, []
    for _ in range(shards):
        if ends[-1] - at <= capacity:
            at = ends[-1]
        else:
            k = bisect_right(ends, at + capacity)
            inside = fine and not whole[k]
            at = max(at, at + capacity if inside else ends[k - 1] if k else 0)
        out.append(at)
    return out


def _least(ends: list[int], whole: list[bool], shards: int, fine: bool, low: int, high: int) -> int:
    """Binary search for the smallest capacity in [low, high] that is enough; high must be."""
    while low < high:
        mid = (low + high) // 2
        if _steps(ends, whole, mid, shards, fine)[-1] == ends[-1]:
            high = mid
        else:
            low = mid + 1
    return low


def _cells(groups: DataFrame, bits: int) -> list[dict]:
    prefix = F.shiftright("key", 64 - bits)
    rows = groups.groupBy(prefix.alias("prefix")).agg(
        F.sum("size").alias("size"), F.count("*").alias("n"), F.max("key").alias("last"), F.max("size").alias("most"),
    ).collect()
    return [row.asDict() | {"bits": bits} for row in rows]


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The least capacity, and the last key of every shard but the last.

    ``groups`` has (key long, size long), keys distinct, and should be stored, as
    it is read once for each round of refinement.
    """
    bits = COARSE_BITS
    cells = _cells(groups, bits)
    if not cells:
        return 0, []
    biggest = max(cell["most"] for cell in cells)
    while True:
        cells.sort(key=lambda cell: cell["last"])
        ends, total = [], 0
        for cell in cells:
            total += cell["size"]
            ends.append(total)
        whole = [cell["n"] == 1 for cell in cells]
        high = _least(ends, whole, shards, False, max(-(-total // shards), biggest), total)
        low = _least(ends, whole, shards, True, max(-(-total // shards), biggest), high)
        near = set()
        if low < high:
            for least, most in zip(_steps(ends, whole, low, shards, False), _steps(ends, whole, high, shards, True), strict=True):
                first, last = bisect_right(ends, least), bisect_right(ends, most)
                near.update(k for k in range(max(0, first - 1), min(last + 1, len(cells))) if not whole[k])
        if not near:
            last_key = dict(zip(ends, (cell["last"] for cell in cells), strict=True))
            return high, [last_key[at] for at in _steps(ends, whole, high, shards, False) if at < total]
        finer = {}
        for k in near:
            finer.setdefault(cells[k]["bits"], []).append(cells[k]["prefix"])
        cells = [cell for k, cell in enumerate(cells) if k not in near]
        for bits, prefixes in finer.items():
            cells += _cells(groups.where(F.shiftright("key", 64 - bits).isin(prefixes)), min(64, bits + FINER_BITS))


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", bins: int = 1024) -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the text's UTF-8 bytes plus 1; a null text counts as an empty one and
    shares its group. Null and repeated ids keep a row each. Fewer groups than
    shards leave shards empty. Other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("key")), "sizes")
    groups = stored(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    _, cuts = minimax_cuts(groups, shards)
    shard = F.lit(0)
    for cut in cuts:
        shard += (F.col("key") > F.lit(cut)).cast("int")
    # Rows of a shard are counted in bins of ids, so that no task numbers a whole shard.
    dealt = rows.select("id", "size", "crc", "key", shard.alias("shard"), F.pmod(F.xxhash64("id", "key"), F.lit(bins)).cast("int").alias("bin"))
    counts = dealt.groupBy("shard", "bin").agg(F.count("*").alias("n")).selectExpr("shard", "bin", "sum(n) OVER (PARTITION BY shard ORDER BY bin) - n AS before")
    numbered = dealt.selectExpr("*", "row_number() OVER (PARTITION BY shard, bin ORDER BY id, key) AS place")
    return numbered.join(F.broadcast(counts), ["shard", "bin"]).select(  # shards x bins rows at most
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.col("place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
