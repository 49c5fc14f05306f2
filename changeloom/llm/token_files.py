"""Token counts by scanning flat token files for end-of-document identifiers.

A token file is nothing but identifiers, two bytes each, with the end-of-document
identifier behind every document and no index. It is read in ranges of a fixed
number of identifiers, cut anywhere. Each block is searched on its own, all of it
at once; a prefix scan over the blocks' last separators and numbers of separators
then tells where the document that begins in an earlier block began, and which
document of the file it is.

Spark's text writer makes the files: a row is a document's identifiers as raw
bytes, and the separator is what the writer puts behind a row.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import cache
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, scratch_dir, stored

BLOCK_IDS, CHUNK_BLOCKS, PLACE_BITS = 1 << 16, 1 << 12, 33
#: Bytes of token files that a task reads.
TASK_BYTES = 1 << 25
ROW = pa.schema([("file", pa.string()), ("start", pa.int64()), ("data", pa.binary())])
FOUND = pa.schema([("file", pa.string()), ("start", pa.int64()), ("size", pa.int64()), ("ends", pa.list_(pa.int32()))])


@cache
def _encoding(ranks_file: str, pattern: str):
    """One for each worker process."""
    import tiktoken

    with open(ranks_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _raw_lines(separator: int) -> dict[str, str]:
    """Options under which a line ends in the separator's two bytes."""
    return {"encoding": "ISO-8859-1", "lineSep": separator.to_bytes(2, "little").decode("latin-1")}


def write_token_files(docs: DataFrame, path: str, ranks_file: str, pattern: str, separator: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Documents as token files below ``path``/kind=0, one for each partition of
    ``docs``, and beside them, in files of the same numbers and order below
    ``path``/kind=1, the ids, so that counts can be told apart.

    A null text is an empty document. Both kinds are written by the same tasks.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("number"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))

    def encode(rows: dict) -> dict:
        encoding = _encoding(ranks_file, pattern)
        tokens = [np.array(encoding.encode_ordinary(text or ""), "<u2").tobytes() for text in rows["text"]]
        names = [f"{number} {'' if i is None else '=' + quote(i)}".encode() for number, i in zip(rows["number"], rows["id"], strict=True)]
        return {"kind": [0] * len(tokens) + [1] * len(names), "number": rows["number"] * 2, "value": tokens + names}

    coded = map_batches(numbered, encode, "kind int, number long, value binary")
    lines = coded.sortWithinPartitions("kind", "number").select("kind", F.col("value").cast("string").alias("value"))
    lines.write.partitionBy("kind").option("maxRecordsPerFile", 0).options(**_raw_lines(separator)).text(path)


def read_blocks(spark: SparkSession, path: str, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(file, start, data): blocks of the token files at ``path``, each read from its
    own place in the file, so that files may have any size. A file goes by its path."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, store, source = None, None, None
        for batch in batches:
            for file, start, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size % 2:
                    raise ValueError("a token file has half an identifier")
                if file != name:
                    store, where = fs.FileSystem.from_uri(file)
                    name, source = file, store.open_input_file(where)
                data = source.read_at(min(2 * block_ids, size - 2 * start), 2 * start)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([start]), pa.array([data])], schema=ROW)

    files = spark.read.format("binaryFile").load(path).select("path", "length")  # not the content
    total = files.agg(F.sum("length")).first()[0] or 0
    starts = F.explode(F.expr(f"sequence(0L, (length - 1) div 2, {block_ids}L)"))
    ranges = files.where("length > 0").select(F.col("path").alias("file"), starts.alias("start"), "length")
    return ranges.repartition(max(1, -(-total // TASK_BYTES)), "file", F.floor(F.col("start") / (TASK_BYTES // 2))).sortWithinPartitions("file", "start").mapInArrow(read, "file string, start long, data binary")


def scan_blocks(blocks: DataFrame, separator: int) -> DataFrame:
    """(file, start, size, ends): where separators stand in each block."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = [np.frombuffer(data.as_buffer(), "<u2") for data in batch.column(2)]
            ends = [np.flatnonzero(ids == separator).astype(np.int32) for ids in blocks]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(map(len, blocks), pa.int64()), pa.array(ends, pa.list_(pa.int32()))], schema=FOUND)

    return blocks.mapInArrow(scan, "file string, start long, size long, ends array<int>")


def document_counts(scanned: DataFrame, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(file, place, start, n_tokens, closed) of every document in scanned blocks.

    n_tokens does not count the separator. What stands behind a file's last
    separator is a document too, not closed, unless it is empty.

    The scan has two levels, so that one enormous file is never in one task.
    """
    blocks = scanned.select(
        "file", "start", "size", "ends", F.floor(F.col("start") / (block_ids * CHUNK_BLOCKS)).alias("chunk"),
        F.size("ends").cast("long").alias("n"), (F.col("start") + F.try_element_at("ends", F.lit(-1))).alias("last"),
    )
    chunks = blocks.groupBy("file", "chunk").agg(F.sum("n").alias("n"), F.max("last").alias("last")).selectExpr(
        "file", "chunk",
        "coalesce(sum(n) OVER (PARTITION BY file ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk_n",
        "max(last) OVER (PARTITION BY file ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS chunk_last",
        "chunk = max(chunk) OVER (PARTITION BY file) AS final",
    )
    placed = blocks.selectExpr(
        "*",
        "coalesce(sum(n) OVER (PARTITION BY file, chunk ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_n",
        "max(last) OVER (PARTITION BY file, chunk ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_last",
        "start = max(start) OVER (PARTITION BY file, chunk) AS ultimate",
    ).join(chunks, ["file", "chunk"])
    # A document of this block ends at each separator, and one at the end of the file.
    ends = F.when(F.expr("final AND ultimate"), F.array_append("ends", F.col("size").cast("int"))).otherwise(F.col("ends"))
    found = placed.select(
        "file", "start", "size", "n", (F.col("chunk_n") + F.col("before_n")).alias("first"),
        F.coalesce("before_last", "chunk_last", F.lit(-1)).alias("previous"), ends.alias("ends"),
    )
    each = found.select("*", F.posexplode("ends").alias("k", "end")).select(
        "file", (F.col("first") + F.col("k")).alias("place"),
        (F.when(F.col("k") == 0, F.col("previous")).otherwise(F.col("start") + F.expr("get(ends, k - 1)")) + 1).alias("begin"),
        (F.col("start") + F.col("end")).alias("stop"), (F.col("k") < F.col("n")).alias("closed"),
    )
    return each.select("file", "place", F.col("begin").alias("start"), (F.col("stop") - F.col("begin")).alias("n_tokens"), "closed").where("closed OR n_tokens > 0")


def count_tokens(docs: DataFrame, ranks_file: str, pattern: str, separator: int, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, file (number of the token file),
    start (its first identifier's place there).

    Token files are written to the shared folder, read again in ranges and
    scanned. A null text has no tokens; null and repeated ids, numbers or texts, keep a row each; an
    empty table gives no rows; other columns are ignored, whatever their names.
    """
    spark, id_type = docs.sparkSession, dict(docs.dtypes)[id_col]
    path = f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, ranks_file, pattern, separator, id_col, text_col)
    if not spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("length").head(1):
        return spark.createDataFrame([], f"`{id_col}` {id_type}, n_tokens long, file long, start long")
    number = F.split("value", " ")
    written = spark.read.options(**_raw_lines(separator)).text(f"{path}/kind=1").select(
        F.shiftright(number[0].cast("long"), PLACE_BITS).alias("file"), number[0].cast("long").bitwiseAND((1 << PLACE_BITS) - 1).alias("place"), F.when(number[1] != "", F.url_decode(F.substring(number[1], 2, 1 << 30))).cast(id_type).alias("id"),
    )
    scanned = stored(scan_blocks(read_blocks(spark, f"{path}/kind=0", block_ids), separator), "scanned")
    counts = document_counts(scanned, block_ids).withColumn("file", F.regexp_extract("file", r"part-(\d+)-[^/]*$", 1).cast("long"))
    return written.join(counts, ["file", "place"]).select(F.col("id").alias(id_col), "n_tokens", "file", "start")
