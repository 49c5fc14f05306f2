"""Running sums, neighbours and extremes in histories of any length.

The order is cut into cells of so many numbers. Windows run inside cells, and one row
for each cell carries what later cells need, so that no task sorts a whole history.
Cells are named by a struct of keys and number, in which nulls are equal to each other:
rows of null keys or of null order are worked on like others (null order comes first).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = 10_000
END = 1 << 62


def _cut(df: DataFrame, order: str, keys: Sequence[str], cell: int) -> DataFrame:
    """With _at, the cell of a row."""
    return df.withColumn("_at", F.struct(F.struct(*keys).alias("keys"), F.floor(F.col(order) / cell).alias("n")))


def _across():
    return Window.partitionBy("_at.keys").orderBy("_at.n")


def running(df: DataFrame, order: str, value: str, name: str, keys: Sequence[str] = ("repo",), cell: int = CELL) -> DataFrame:
    """With the running sum of ``value`` by keys as ``name``; value goes."""
    cells = _cut(df, order, keys, cell)
    sums = cells.groupBy("_at").agg(F.sum(value).alias("_sum"))
    sums = sums.select("_at", (F.sum("_sum").over(_across()) - F.col("_sum")).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy("_at").orderBy(order))
    return cells.withColumn("_inside", inside).join(sums, "_at").withColumn(name, F.col("_before") + F.col("_inside")).drop("_at", "_inside", "_before", value)


def with_next(df: DataFrame, order: str, name: str, keys: Sequence[str] = ("repo",), cell: int = CELL) -> DataFrame:
    """With the next value of ``order`` by keys, or 2**62 behind the last."""
    cells = _cut(df, order, keys, cell)
    firsts = cells.groupBy("_at").agg(F.min(order).alias("_first"))
    firsts = firsts.select("_at", F.lead("_first").over(_across()).alias("_later"))
    inside = F.lead(order).over(Window.partitionBy("_at").orderBy(order))
    return cells.withColumn("_next", inside).join(firsts, "_at").withColumn(name, F.coalesce("_next", "_later", F.lit(END))).drop("_at", "_next", "_later")


def with_previous(df: DataFrame, order: str, value: str | Column, name: str, keys: Sequence[str] = ("repo",), cell: int = CELL) -> DataFrame:
    """With ``value`` of the row before by keys, null for the first."""
    value = F.col(value) if isinstance(value, str) else value
    cells = _cut(df.withColumn("_value", value), order, keys, cell)
    lasts = cells.groupBy("_at").agg(F.max_by(F.struct(F.col("_value").alias("v")), F.struct(order)).alias("_last"))
    lasts = lasts.select("_at", F.lag("_last").over(_across()).alias("_earlier"))
    w = Window.partitionBy("_at").orderBy(order)
    found = cells.withColumns({"_inside": F.lag("_value").over(w), "_n": F.row_number().over(w)}).join(lasts, "_at")
    return found.withColumn(name, F.when(F.col("_n") == 1, F.col("_earlier.v")).otherwise(F.col("_inside"))).drop("_at", "_value", "_inside", "_n", "_earlier")


def following_least(df: DataFrame, order: str, value: str, name: str, keys: Sequence[str] = ("repo",), cell: int = CELL) -> DataFrame:
    """With the least ``value`` of the row and of all that follow by keys, null if none has one."""
    cells = _cut(df, order, keys, cell)
    least = cells.groupBy("_at").agg(F.min(value).alias("_least"))
    least = least.select("_at", F.min("_least").over(_across().rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
    inside = F.min(value).over(Window.partitionBy("_at").orderBy(order).rangeBetween(Window.currentRow, Window.unboundedFollowing))
    return cells.withColumn("_inside", inside).join(least, "_at").withColumn(name, F.least("_inside", "_later")).drop("_at", "_inside", "_later")


def running_greatest(df: DataFrame, order: str, value: str, name: str, keys: Sequence[str] = ("repo",), cell: int = CELL) -> DataFrame:
    """With the greatest ``value`` up to the row by keys, null before the first."""
    cells = _cut(df, order, keys, cell)
    most = cells.groupBy("_at").agg(F.max(value).alias("_most"))
    most = most.select("_at", F.max("_most").over(_across().rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"))
    inside = F.max(value).over(Window.partitionBy("_at").orderBy(order))
    return cells.withColumn("_inside", inside).join(most, "_at").withColumn(name, F.greatest("_inside", "_earlier")).drop("_at", "_inside", "_earlier")


def group_greatest(df: DataFrame, order: str, group: str, value: str, name: str, keys: Sequence[str] = ("repo",), cell: int = CELL) -> DataFrame:
    """With the greatest ``value`` of all rows of a group by keys. Groups are gathered
    by cell first, so that one of a great part of all rows is in many tasks."""
    parts = df.withColumn("_at", F.struct(F.struct(*keys, group).alias("keys"), F.floor(F.col(order) / cell).alias("n")))
    most = parts.groupBy("_at").agg(F.max(value).alias("_most"))
    most = most.select("_at", F.max("_most").over(Window.partitionBy("_at.keys")).alias(name))
    return parts.join(most, "_at").drop("_at")


#: Blocks of the finest level, and how many blocks make one of the next.
BLOCK, FACTOR, LEVELS = 1024, 16, 12


def starting_within(points: DataFrame, spans: DataFrame, at: str, begin: str, end: str, keys: Sequence[str]) -> DataFrame:
    """Each row of ``points`` beside each row of ``spans`` of equal keys with begin <= at < end.

    Spans are cut into blocks of several sizes, few for each size, and points are in one
    block of each size: what meets in a block is a pair, but for the finest blocks at a
    span's ends. So no more pairs are made than there are, plus those of two blocks a
    span, however long spans are. ``at`` and ends are from 0 to 10**17; spans of null ends have no points.
    """
    sizes = [FACTOR**k for k in range(LEVELS + 1)]
    # Of a span's finest blocks _first to _last, those that make whole blocks of a size.
    low = [f"((_first + {s - 1}) div {s})" for s in sizes]
    high = [f"((_last + 1) div {s} - 1)" for s in sizes]
    some = lambda level, a, b: f"IF({a} <= {b}, transform(sequence({a}, {b}), n -> struct({level} AS level, n AS n)), array())"
    blocks = []
    for k in range(LEVELS):
        ends = f"concat({some(k, low[k], f'{low[k + 1]} * {FACTOR} - 1')}, {some(k, f'({high[k + 1]} + 1) * {FACTOR}', high[k])})"
        blocks.append(some(k, low[k], high[k]) if k == LEVELS - 1 else f"IF({low[k + 1]} > {high[k + 1]}, {some(k, low[k], high[k])}, {ends})")
    rows = spans.where((F.col(begin) < F.col(end)) & (F.col(end) > 0))
    rows = rows.withColumns({"_first": F.expr(f"greatest({begin}, 0L) div {BLOCK}"), "_last": F.expr(f"({end} - 1) div {BLOCK}")})
    rows = rows.withColumn("_block", F.explode(F.expr(f"concat({', '.join(blocks)})")))
    rows = rows.select(F.struct(*keys, "_block.level", "_block.n").alias("_in"), F.struct(*spans.columns).alias("_span"))
    places = F.expr("array(" + ", ".join(f"struct({k} AS level, {at} div {BLOCK * sizes[k]} AS n)" for k in range(LEVELS)) + ")")
    laid = points.withColumn("_block", F.explode(places)).select(F.struct(*keys, "_block.level", "_block.n").alias("_in"), F.struct(*points.columns).alias("_point"))
    met = laid.join(rows, "_in").where((F.col(f"_point.{at}") >= F.col(f"_span.{begin}")) & (F.col(f"_point.{at}") < F.col(f"_span.{end}")))
    return met.select("_point.*", *(F.col(f"_span.{c}").alias(c) for c in spans.columns if c not in keys))
