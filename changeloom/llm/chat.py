"""Chat formatting: transcripts to canonical turns.

A transcript is a sequence of lines; the first line of a turn may carry a speaker
marker, in one of many styles, or none. A hidden Markov model whose states are
(role, begins a turn or not) emits a code of each line's marker, length and
ending; Viterbi's algorithm finds the best states, and lines of one turn are
rendered together under their role.

The model's probabilities are counted from labelled lines. Lines are dealt out in
their order, and a transcript is cut into blocks of so many lines at most: what a
block does to the scores of states is a small matrix, matrices are combined over a
transcript, and every block is then decoded between its known first and last
states. The result is that of one pass, and no task holds a long transcript.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

ROLES = ["system", "user", "assistant"]
STATES = [(role, begins) for role in ROLES for begins in (True, False)]
#: Speaker words of transcripts and the roles they stand for. Fixed values.
SPEAKERS = {"system": "system", "instruction": "system", "user": "user", "human": "user", "q": "user", "assistant": "assistant", "ai": "assistant", "bot": "assistant", "a": "assistant"}
MARKER = r"^\s*(?:#+\s*|\*\*|<\|?|\[)?(?i:(" + "|".join(sorted(SPEAKERS, key=len, reverse=True)) + r"))(?:\s*\*\*\s*:|\s*:\s*\*\*|\|?>|\]|\s*:)\s*"
LENGTHS = [0, 20, 60, 150, 400]
CODES = 4 * (len(LENGTHS) + 1) * 3
BLOCK_LINES = 4096
#: Lines of a transcript are in this order. Rows that are equal in all but row are repeated rows, so their order changes nothing.
ORDER = ["key", "turn", "tie", "row", "pos"]


def line_code(line: Column) -> Column:
    """Marker's role, length class and ending of a line in one number below CODES."""
    speaker = F.lower(F.regexp_extract(line, MARKER, 1))
    role = F.when(speaker == "", 0)
    for word, name in SPEAKERS.items():
        role = role.when(speaker == word, ROLES.index(name) + 1)
    size = F.lit(0)
    for edge in LENGTHS:
        size += (F.length(line) > edge).cast("int")
    ending = F.when(F.endswith(F.rtrim(line), F.lit("?")), 2).when(F.endswith(F.rtrim(line), F.lit(":")), 1).otherwise(0)
    return ((role * (len(LENGTHS) + 1) + size) * 3 + ending).cast("int")


def transcript(conversations: DataFrame, marked_percent: int = 85) -> DataFrame:
    """(conv, turn, tie, row, pos, line, role) lines of a plain transcript of
    ``conversations`` (conv_id, turn, role, text).

    Each conversation has one style of markers; the turns that carry one are
    picked by a hash. Null texts are empty lines, turns without a number come
    first, turns of an unknown role carry no marker, repeated rows are turns of
    their own; an empty table has no lines. Other columns are ignored, whatever
    their names.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    style = F.pmod(F.xxhash64(F.col("conv_id")), F.lit(4))
    words = {"system": ["System:", "### System:", "[system]", "**Instruction:**"], "user": ["User:", "### Human:", "[user]", "**Q:**"], "assistant": ["Assistant:", "### Assistant:", "[assistant]", "**A:**"]}
    marker = F.lit(None).cast("string")
    for role, marks in words.items():
        marker = F.when(F.col("role") == role, F.element_at(F.array(*map(F.lit, marks)), style.cast("int") + 1)).otherwise(marker)
    shown = F.when(F.pmod(F.xxhash64("conv_id", "turn", "role"), F.lit(100)) < marked_percent, F.concat(marker, F.lit(" ")))
    text = F.concat(F.coalesce(shown, F.lit("")), F.coalesce("text", F.lit("")))
    return rows.select(
        F.col("conv_id").alias("conv"), F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"), F.xxhash64("role", "text").alias("tie"), F.monotonically_increasing_id().alias("row"), "role",
        F.posexplode(F.split(text, "\n")).alias("pos", "line"),
    )


@dataclass
class TurnModel:
    """Logarithms of probabilities: state to state, and state to code. The last
    row of ``step`` is for the time before the first line."""

    step: np.ndarray
    emit: np.ndarray

    def best(self, codes: np.ndarray, before: int = len(STATES), last: int | None = None) -> list[int]:
        """The best states for ``codes``, behind state ``before`` and ending in ``last``."""
        score, back = self.step[before] + self.emit[:, codes[0]], np.zeros((len(codes), len(STATES)), np.int8)
        for k in range(1, len(codes)):
            ways = score[:, None] + self.step[:-1]
            back[k] = ways.argmax(axis=0)
            score = ways.max(axis=0) + self.emit[:, codes[k]]
        states = [int(score.argmax()) if last is None else last]
        for k in range(len(codes) - 1, 0, -1):
            states.append(int(back[k, states[-1]]))
        return states[::-1]

    def matrix(self, codes: np.ndarray) -> np.ndarray:
        """Best score from each state before ``codes`` to each state at their end."""
        total = self.step + self.emit[:, codes[0]]
        for code in codes[1:].tolist():
            total = (total[:, :, None] + self.step[None, :-1]).max(axis=1) + self.emit[:, code]
        return total


def borders(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """The best state before and at the end of each block, from its matrix."""
    score, backs = matrices[0][-1], []
    for matrix in matrices[1:]:
        ways = score[:, None] + matrix[:-1]
        backs.append(ways.argmax(axis=0))
        score = ways.max(axis=0)
    ends = [int(score.argmax())]
    for back in backs[::-1]:
        ends.append(int(back[ends[-1]]))
    ends.reverse()
    return list(zip([len(STATES), *ends[:-1]], ends, strict=True))


def numbered(lines: DataFrame, block_lines: int) -> DataFrame:
    """(key, block, place, first, pos, code, role, line): lines (see ``transcript``) by
    the block of their transcript, block numbers and places ascending in order.

    Range partitions follow the order, whatever a transcript's size; in each, a
    block ends with its transcript or when it is full. first marks a transcript's
    first block.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit(""))
    role = F.col("role") if "role" in lines.columns else F.lit(None).cast("string")
    rows = lines.select(key.alias("key"), "turn", "tie", "row", "pos", line_code(F.col("line")).alias("code"), role.alias("role"), "line")
    kept = ["key", "pos", "code", "role", "line"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, place, last, size = TaskContext.get().partitionId() << 40, 0, None, 0
        for batch in batches:
            blocks = []
            for name in batch.column(0).to_pylist():
                if name != last or size == block_lines:
                    block, last, size = block + 1, name, 0
                size += 1
                blocks.append(block)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blocks, pa.int64()), pa.array(np.arange(place, place + n)), *batch.columns[1:]], names=["key", "block", "place", *kept[1:]])
            place += n

    dealt = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).select(*kept)
    placed = stored(dealt.mapInArrow(number, "key string, block long, place long, pos int, code int, role string, line string"), "lines")
    first = placed.groupBy("key").agg(F.min("block").alias("block")).withColumn("first", F.lit(True))
    return placed.join(first, ["key", "block"], "left").withColumn("first", F.coalesce("first", F.lit(False)))


def fit(lines: DataFrame, block_lines: int = BLOCK_LINES) -> TurnModel:
    """Counts over labelled lines (see ``transcript``), plus one half each. Lines of
    other roles are left out; without any line all states are alike."""
    names = F.create_map(*(x for k, (role, begins) in enumerate(STATES) for x in (F.lit(f"{role}{begins}"), F.lit(k))))
    known = numbered(lines.where(F.col("role").isin(ROLES)), block_lines).select(
        "key", "block", "place", "first", "code", F.element_at(names, F.concat("role", F.when(F.col("pos") == 0, "True").otherwise("False"))).alias("state"),
    )
    pairs = known.selectExpr("state", "code", "first", "lag(state) OVER (PARTITION BY key, block ORDER BY place) AS before")
    counted = pairs.groupBy("before", "state", "code", F.expr("before IS NULL AND first").alias("starts")).count().collect()  # a few thousand kinds at most
    size = len(STATES)
    first, step, emit = np.full(size, 0.5), np.full((size, size), 0.5), np.full((size, CODES), 0.5)
    for row in counted:
        emit[row["state"], row["code"]] += row["count"]
        if row["before"] is not None:
            step[row["before"], row["state"]] += row["count"]
        elif row["starts"]:
            first[row["state"]] += row["count"]
    for k, (_, begins) in enumerate(STATES):  # what no turn can do
        if not begins:
            first[k] = 1e-12
            step[[j for j in range(size) if STATES[j][0] != STATES[k][0]], k] = 1e-12
    scaled = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    return TurnModel(np.vstack([scaled(step), scaled(first)]), scaled(emit))


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    return ((key, list(part)) for key, part in groupby(rows, key=lambda r: r[:keys]))


def recover_turns(lines: DataFrame, model: TurnModel, block_lines: int = BLOCK_LINES) -> DataFrame:
    """(conv, turn, role, n_lines, content) of the turns found in ``lines``
    (conv, turn, tie, row, pos, line), numbered from 0 within each transcript.

    The marker goes from a turn's first line. Lines of no conversation form one,
    repeated rows follow each other, an empty table has no turns. Other columns
    are ignored, whatever their names.
    """
    shared = lines.sparkSession.sparkContext.broadcast(model)
    coded = numbered(lines.drop("role") if "role" in lines.columns else lines, block_lines).select("key", "block", "place", "code", "line")
    order = ["key", "block", "place"]

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, block), rows in _groups(batches, 2):
            scores = shared.value.matrix(np.array([r[-1] for r in rows]))
            yield pa.RecordBatch.from_pydict({"key": [key], "block": pa.array([block], pa.int64()), "scores": [scores.ravel().tolist()]})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key,), rows in _groups(batches, 1):
            found = borders([np.array(r[2]).reshape(-1, len(STATES)) for r in rows])
            yield pa.RecordBatch.from_pydict({"key": [key] * len(rows), "block": pa.array([r[1] for r in rows], pa.int64()), "before": pa.array([f[0] for f in found], pa.int32()), "last": pa.array([f[1] for f in found], pa.int32())})

    # Only transcripts of several blocks need to know where blocks meet.
    several = coded.groupBy("key").agg(F.min("block").alias("low"), F.max("block").alias("high")).where("low < high").select("key")
    long = coded.select(*order, "code").join(several, "key", "left_semi").repartition("key", "block").sortWithinPartitions(*order)
    known = long.mapInArrow(matrices, "key string, block long, scores array<double>").repartition("key").sortWithinPartitions("key", "block").mapInArrow(meet, "key string, block long, before int, last int")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, block), rows in _groups(batches, 2):
            before, last = rows[0][5:7]
            states = shared.value.best(np.array([r[3] for r in rows]), len(STATES) if before is None else before, last)
            parts: list[list] = []
            number = 0
            for row, state in zip(rows, states, strict=True):
                role, begins = STATES[state]
                begins |= not parts and before in (None, len(STATES))
                number += begins
                if begins or not parts:
                    parts.append([number, begins, role, 0, []])
                parts[-1][3] += 1
                parts[-1][4].append(re.sub(MARKER, "", row[4], count=1) if begins else row[4])
            columns = list(zip(*parts, strict=True))
            yield pa.RecordBatch.from_pydict({
                "key": [key] * len(parts), "block": pa.array([block] * len(parts), pa.int64()), "number": pa.array(columns[0], pa.int64()), "begins": columns[1],
                "role": columns[2], "n_lines": pa.array(columns[3], pa.int64()), "content": ["\n".join(c) for c in columns[4]],
            })

    placed = coded.join(known, ["key", "block"], "left").select(*order, "code", "line", "before", "last").repartition("key", "block").sortWithinPartitions(*order)
    parts = stored(placed.mapInArrow(decode, "key string, block long, number long, begins boolean, role string, n_lines long, content string"), "turns")
    offsets = parts.groupBy("key", "block").agg(F.max("number").alias("n")).selectExpr("key", "block", "coalesce(sum(n) OVER (PARTITION BY key ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offset")
    pieces = F.sort_array(F.collect_list(F.struct("block", "number", "role", "content")))
    turns = parts.join(offsets, ["key", "block"]).withColumn("turn", F.col("offset") + F.col("number") - 1).groupBy("key", "turn").agg(F.sum("n_lines").alias("n_lines"), pieces.alias("pieces"))
    kind = dict(lines.dtypes)["conv"]
    return turns.select(
        F.when(F.col("key") != "", F.expr("substring(key, 2)")).cast(kind).alias("conv"), "turn", F.col("pieces")[0]["role"].alias("role"), "n_lines",
        F.array_join("pieces.content", "\n").alias("content"),
    )


def rendered(role: Column, content: Column) -> Column:
    """A turn in canonical form; control marks inside its content are broken up."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), F.replace(content, F.lit("<|"), F.lit("< |")), F.lit("<|end|>\n"))
