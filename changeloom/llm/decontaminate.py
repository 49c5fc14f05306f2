"""Benchmark decontamination by winnowing.

Texts become words (ASCII lower-cased). Of every ``span - gram + 1`` consecutive
word ``gram``-grams the one of smallest hash is kept, the last of equals. Two
texts that share ``span`` words share such a window, so both keep the same gram
of it: joining kept grams finds every shared span, and extending a joined gram by
up to ``span - gram`` words to both sides measures it.

Items of fewer than ``span`` words are spans of their own length; for each such
length that occurs, every gram of just that length is kept.

A fixed-size bit map of the benchmark's grams goes to all tasks, and document
grams that are not in it never leave their task. It only saves work: the
join on hashes, then on the words themselves, decides.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
GRAM = "struct<pos: long, hash: long, size: int, left: array<string>, mid: array<string>, right: array<string>>"


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "replace").lower())


def gram_hashes(words: list[bytes], size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` words."""
    one = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    one = (one + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    if one.size < size:
        return one[:0]
    total = one[: one.size - size + 1].copy()
    for k in range(1, size):
        total = total * np.uint64(0xC2B2AE3D27D4EB4F) + one[k : one.size - size + 1 + k]
    return (total ^ (total >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the last smallest hash of each run of ``window`` hashes."""
    n = hashes.size - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = hashes[:n].copy(), np.arange(n)
    for k in range(1, window):
        other = hashes[k : n + k]
        less = other <= best
        best[less] = other[less]
        at[less] = np.flatnonzero(less) + k
    return np.unique(at)


def _kept(words: list[bytes], hashes: np.ndarray, chosen: np.ndarray, gram: int, size: int, reach: int) -> list[dict]:
    """The kept grams with the words beside them; ``left`` is nearest first."""
    text = lambda part: [w.decode("utf-8", "replace") for w in part]
    return [
        {"pos": p, "hash": h, "size": size, "left": text(words[max(0, p - reach) : p][::-1]), "mid": text(words[p : p + gram]), "right": text(words[p + gram : p + gram + reach])}
        for p, h in zip(chosen.tolist(), hashes[chosen].view(np.int64).tolist(), strict=True)
    ]


def _run(left: Column, right: Column) -> Column:
    """How many leading elements of two arrays are equal."""
    same = F.zip_with(left, right, lambda a, b: F.coalesce(a == b, F.lit(False)))
    stop = F.array_position(same, F.lit(False))
    return F.when(stop > 0, stop - 1).otherwise(F.size(same))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = 10, gram: int = 6, map_bits: int = 1 << 22, salts: int = 8) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, n_items, items (sorted
    strings), contaminated.

    A word is hit if it lies in an occurrence of an item window. A null or empty
    text has no words and no hits; null ids stay null; repeated document rows get
    a row each; items repeated under one id count once, items of no id hit words
    but are not listed. Other columns are ignored, whatever their names.
    """
    spark, window = docs.sparkSession, span - gram + 1
    reach = span - gram

    def item_grams(rows: dict) -> dict:
        out = []
        for text in rows["text"]:
            words = words_of(text)
            size = min(len(words), span)
            if size == span:
                hashes = gram_hashes(words, gram)
                out.append(_kept(words, hashes, winnow(hashes, window), gram, span, reach))
            else:
                hashes = gram_hashes(words, size) if size else np.zeros(0, np.uint64)
                out.append(_kept(words, hashes, np.arange(hashes.size), size, size, 0))
        return {"item": rows["item"], "grams": out}

    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    items = map_batches(items, item_grams, f"item string, grams array<{GRAM}>").select("item", F.inline("grams")).distinct()
    items = stored(items, "items")
    # Two summaries of bounded size: map_bits slots, and the lengths below span.
    slot = F.pmod("hash", F.lit(map_bits))
    slots = items.select((slot / 32).cast("int").alias("word"), F.expr(f"shiftleft(1L, int(pmod(hash, {map_bits}) % 32))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()
    seen = np.zeros(map_bits // 32 + 1, np.uint32)
    for row in slots:
        seen[row["word"]] = row["bits"]
    sizes = [row["size"] for row in items.where(F.col("size") < span).select("size").distinct().collect()]
    shared = spark.sparkContext.broadcast(seen)

    def doc_grams(rows: dict) -> dict:
        seen, out, counts = shared.value, [], []

        def known(hashes: np.ndarray, chosen: np.ndarray) -> np.ndarray:
            at = np.mod(hashes[chosen].view(np.int64), map_bits)
            return chosen[(seen[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1]

        for text in rows["text"]:
            words = words_of(text)
            hashes = gram_hashes(words, gram)
            grams = _kept(words, hashes, known(hashes, winnow(hashes, window)), gram, span, reach)
            for size in sizes:
                hashes = gram_hashes(words, size)
                grams += _kept(words, hashes, known(hashes, np.arange(hashes.size)), size, size, 0)
            counts.append(len(words))
            out.append(grams)
        return {"rid": rows["rid"], "id": rows["id"], "n_words": counts, "grams": out}

    id_type = dict(docs.dtypes)[id_col]
    read = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    read = stored(map_batches(read, doc_grams, f"rid long, id {id_type}, n_words long, grams array<{GRAM}>"), "grams")

    # A passage that very many documents hold is dealt out over the salts.
    doc_side = read.select("rid", F.inline("grams")).withColumn("salt", F.pmod(F.xxhash64("rid", "pos"), F.lit(salts)).cast("int"))
    item_side = items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select("item", "hash", "size", "salt", *(F.col(c).alias(f"i_{c}") for c in ("left", "mid", "right")))
    before, after = _run(F.col("left"), F.col("i_left")), _run(F.col("right"), F.col("i_right"))
    hits = (
        doc_side.join(item_side, ["hash", "size", "salt"])
        .where(F.col("mid") == F.col("i_mid"))
        .select("rid", "item", "size", (F.col("pos") - before).alias("start"), (F.col("pos") + F.size("mid") + after).alias("stop"))
        .where(F.col("stop") - F.col("start") >= F.col("size"))
    )
    hits = stored(hits.groupBy("rid", "item", "start").agg(F.max("stop").alias("stop")), "hits")
    spans = hits.groupBy("rid", "start").agg(F.max("stop").alias("stop"))
    covered = F.aggregate(
        F.sort_array(F.collect_list(F.struct("start", "stop"))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0).cast("long"), x["stop"] - F.greatest(x["start"], acc["end"]))).alias("n"),
            F.greatest(acc["end"], x["stop"]).alias("end"),
        ),
    )["n"]
    found = spans.groupBy("rid").agg(covered.alias("n_hit")).join(hits.groupBy("rid").agg(F.sort_array(F.collect_set("item")).alias("items")), "rid")
    return (
        read.select("rid", "id", "n_words").join(found, "rid", "left")
        .select(
            F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
        .withColumn("contaminated", F.col("n_hit") > 0)
    )
