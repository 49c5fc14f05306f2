"""Quality classifier: hashed word n-gram logistic regression, trained with
follow-the-regularised-leader updates and scored as sparse dot products.

Tokens are runs of word bytes and runs of other visible bytes; features are
hashed 1- to ``max_n``-grams of tokens. A text's vector is that of its counts at
length ``SCALE``, and beside it the empty n-gram with the logarithm of how many
n-grams there are: long texts need more evidence than short ones.

Training takes at most ``max_rows`` labelled rows (those with the smallest hash
of the id), deals them to ``shards`` tasks by that hash, runs FTRL-proximal in
each and averages the weights. A task holds at most ``max_entries`` entries of
vectors; from the row that exceeds them on, rows of its shard are not learnt from.
Rows of the rarer label weigh more. Everything that is scored is scored whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches

TOKEN = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[^\s0-9A-Za-z_\x80-\xff]+")
BLOCK = 1 << 20
SCALE = 16.0
#: Rows of a label weigh (their share of the rows / (1 / 2)) to the power of minus this.
BALANCE = 0.5


def _blocks(data: bytes) -> Iterator[bytes]:
    """Pieces of about BLOCK bytes, cut behind white space where there is any."""
    at = 0
    while len(data) - at > BLOCK:
        cut = max(data.rfind(b" ", at, at + BLOCK), data.rfind(b"\n", at, at + BLOCK)) + 1
        cut = cut if cut > at else at + BLOCK
        yield data[at:cut]
        at = cut
    yield data[at:]


def features(text: str | None, bits: int, max_n: int) -> Iterator[np.ndarray]:
    """Arrays of feature numbers below 2**bits, together every n-gram of ``text``."""
    mask, reach = np.uint64((1 << bits) - 1), max_n - 1

    def hashed(grams: np.ndarray) -> np.ndarray:
        mixed = (grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((mixed >> np.uint64(32)) & mask).astype(np.int64)

    tail = np.zeros(0, np.uint64)
    for block in _blocks((text or "").encode("utf-8", "replace")):
        tokens = TOKEN.findall(block)
        h = np.concatenate([tail, np.fromiter(map(zlib.crc32, tokens), np.uint64, len(tokens))])
        old, gram = tail.size, h
        for n in range(1, max_n + 1):
            gram = gram if n == 1 else gram[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[n - 1:]
            yield hashed(gram[max(0, old - n + 1):])
            if gram.size < 2:
                break
        tail = h[max(0, h.size - reach):]


def vector(text: str | None, bits: int, max_n: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers, ascending, and values. 2**bits is the intercept, the number
    behind it the empty n-gram. Holds 2**bits counts at most, however long the text."""
    held, size, dense = [np.zeros(0, np.int64)], 0, None
    for part in features(text, bits, max_n):
        held.append(part)
        size += part.size
        if size > 1 << max(bits, 20):
            counted = np.bincount(np.concatenate(held), minlength=1 << bits)
            held, size, dense = [], 0, counted if dense is None else dense + counted
    if dense is None:
        index, count = np.unique(np.concatenate(held), return_counts=True)
    else:
        dense += np.bincount(np.concatenate(held or [np.zeros(0, np.int64)]), minlength=1 << bits)
        index = np.flatnonzero(dense)
        count = dense[index]
    value = count.astype(np.float64)
    length = np.sqrt(value @ value)
    return np.append(index, [1 << bits, (1 << bits) + 1]), np.append(value * (SCALE / length if length else 1.0), [1.0, np.log1p(value.sum())])


@dataclass
class QualityModel:
    """Weights by feature number."""

    weights: np.ndarray
    bits: int
    max_n: int

    def score_text(self, text: str | None) -> float:
        index, value = vector(text, self.bits, self.max_n)
        margin = float(self.weights[index].astype(np.float64) @ value)
        return float(1.0 / (1.0 + np.exp(-np.clip(margin, -40, 40))))

    def score(self, text: Column, spark) -> Column:
        """Probability that a text is good, for null and empty texts too."""
        shared = spark.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def scored(texts: pd.Series) -> pd.Series:
            model = shared.value
            return pd.Series([model.score_text(x) for x in texts], dtype="float64")

        return scored(text)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """Weights by FTRL-proximal over (feature numbers, values, label)."""
    size = (1 << bits) + 2
    z, n = np.zeros(size), np.zeros(size)
    counts = np.bincount([label for _, _, label in rows], minlength=2)
    weight = (len(rows) / 2 / np.maximum(counts, 1)) ** BALANCE

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for index, value, label in rows:
            zi, ni = z[index], n[index]
            wi = weights(zi, ni)
            p = 1.0 / (1.0 + np.exp(-np.clip(wi @ value, -40, 40)))
            g = weight[label] * (p - label) * value
            z[index] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * wi
            n[index] = ni + g * g
    return weights(z, n)


def fit(labelled: DataFrame, text_col: str, label_col: str, key_col: str, shards: int = 6, max_entries: int = 1 << 24, bits: int = 18, max_n: int = 2, epochs: int = 10, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.0, l2: float = 0.0) -> QualityModel:
    """Model of ``label_col`` (1 good, 0 bad; rows with another or no label are left out).

    ``labelled`` should hold no more rows than ``training_rows`` gives. Texts become
    vectors before they are shuffled, so a task holds vectors only, ``max_entries``
    entries of 8 bytes at most. Without any labelled row every text scores 0.5.
    """
    rows = labelled.where(F.col(label_col).isin(0, 1)).select(
        F.xxhash64(F.col(key_col)).alias("order"), F.xxhash64(F.col(text_col)).alias("tie"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"),
    )

    def vectors(batch: dict) -> dict:
        found = [vector(x, bits, max_n) for x in batch["text"]]
        return {n: batch[n] for n in ("shard", "order", "tie", "label")} | {"index": [i for i, _ in found], "value": [v for _, v in found]}

    def learnt(shard: int, rows: list) -> pd.DataFrame:
        w = ftrl(rows, bits, epochs, alpha, beta, l1, l2).astype("<f4")
        return pd.DataFrame({"shard": [shard], "rows": [len(rows)], "weights": [w.tobytes()]})

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, held, entries = None, [], 0
        for batch in batches:
            for at, label, index, value in batch[["shard", "label", "index", "value"]].itertuples(index=False):
                if at != shard:
                    if held:
                        yield learnt(shard, held)
                    shard, held, entries = at, [], 0
                entries += len(index)
                if entries <= max_entries:
                    held.append((np.asarray(index, np.int32), np.asarray(value, np.float32), label))
        if held:
            yield learnt(shard, held)

    dealt = map_batches(rows.withColumn("shard", F.pmod("order", F.lit(shards)).cast("int")), vectors, "shard int, order long, tie long, label int, index array<int>, value array<float>")
    sorted_rows = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "order", "tie", "label")
    found = sorted_rows.mapInPandas(train, "shard int, rows long, weights binary").collect()  # shards x 2**bits numbers
    total = np.zeros((1 << bits) + 2)
    for row in sorted(found, key=lambda r: r["shard"]):
        total += np.frombuffer(row["weights"], "<f4").astype(np.float64) * row["rows"]
    return QualityModel((total / max(1, sum(row["rows"] for row in found))).astype(np.float32), bits, max_n)


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, max_rows: int = 16384, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with labels, the at most ``max_rows`` ids of smallest hash.

    Rows without an id or a label are left out. An id with several labels counts
    with the smallest, so that repeated label rows change nothing. Document rows of
    one id and text count once; of several texts of one id the least counts, so
    that there are no more rows than ids.
    """
    order = F.xxhash64(F.col(id_col))
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias(label_col))
    chosen = known.orderBy(order, id_col).limit(max_rows)
    found = docs.join(F.broadcast(chosen), id_col)  # max_rows ids at most
    others = [F.min_by(F.struct(*(F.col(f"`{c}`") for c in found.columns)), F.coalesce(text_col, F.lit(""))).alias("row")]
    return found.groupBy(id_col).agg(*others).select("row.*")
