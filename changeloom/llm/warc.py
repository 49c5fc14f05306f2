"""WARC archives written from pages, read back, and indexed by merging sorted runs.

Writing is plain Spark: a record is one string, and the text writer with CRLF
CRLF as line separator makes gzipped files of records. Reading streams the pieces
between such separators and puts records together by their lengths, so that files
and pages may have any size; digests are checked.

The index orders captures by URL key, time and id. Every file read gives sorted
runs of ``RUN_RECORDS`` captures at most, which are stored. Runs are dealt to ranges
of bounded size; within a range Spark's external sort brings each run's part
together, and a loser tree merges the parts as they are.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_dir, small_batches, stored

EOL = "\r\n"
CAPTURE = "url_key string, stamp string, capture_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string"
#: Second of the first capture; a page without a time of its own gets its id in seconds after it.
EPOCH = "2024-01-01T00:00:00Z"
#: Seconds behind EPOCH in which captures are dated.
DATED = 1_000_000_000
#: Captures of a sorted run, and captures that a task merges, on average.
RUN_RECORDS, RANGE_RECORDS = 50_000, 100_000


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def base32_sha1(payload: Column) -> Column:
    """The same as a column: five hexadecimal digits are four of base 32."""
    hexadecimal = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(hexadecimal, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query, lower-cased: sorts by site."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return (url or "").lower()
    labels = host.removeprefix("www.").split(".")[::-1]
    tail = (f":{port}" if port not in (None, 80, 443) else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return (",".join(labels) + tail).lower()


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, records_per_file: int = 50_000) -> None:
    """One WARC record per row of ``pages`` in gzipped files below ``path``.

    Of the rows with equal payloads of ``min_bytes`` or more, the one of smallest
    id is a response and holds the payload; the others are revisits that name it.
    Ids are numbers or texts, whatever is in them. Rows of null id follow all others; where all ids of a payload are null, each
    is a response, and so is each row that repeats the smallest id. A null
    payload is an empty one, a null URL an empty target. Other columns are
    ignored, whatever their names.
    """
    text = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\x00-\x20\x7f]", "").alias("url"), text.alias("payload"))

    keyed = rows.select("id", "url", "payload", base32_sha1(F.col("payload")).alias("digest"), F.octet_length("payload").alias("size"))
    # Digests alone are grouped, partly before they are shuffled, and only groups of several rows go on.
    first = keyed.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    known = keyed.join(first, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    uri = lambda c: F.concat(F.lit("<urn:capture:"), F.when(c.isNull(), "").when(c.cast("string") == "", "=").otherwise(F.url_encode(c.cast("string"))), F.lit(">"))
    # An id's own number, or a hash of it, within some thirty years, so that dates have four digits and sort as texts.
    since = F.pmod(F.coalesce(F.col("id").try_cast("long"), F.crc32(F.col("id").cast("string").cast("binary")), F.lit(0)), F.lit(DATED))
    stamp = F.date_format(F.timestamp_seconds(F.unix_seconds(F.lit(EPOCH).cast("timestamp")) + since), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = [
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", uri(F.col("id"))),
        ("WARC-Date", stamp),
        ("WARC-Target-URI", F.col("url")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("X-Payload-Length", F.col("size").cast("string")),
        ("Content-Type", F.lit("text/html; charset=utf-8")),
        ("WARC-Refers-To", F.when(revisit, uri(F.col("first")))),
        ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string"))),
    ]
    lines = F.concat_ws(EOL, F.lit("WARC/1.1"), *(F.concat(F.lit(f"{name}: "), value) for name, value in head))
    record = F.concat(lines, F.lit(EOL * 2), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    known.select(record.alias("value")).write.option("lineSep", EOL * 2).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def records(pieces: Iterator[tuple[str, bytes]]) -> Iterator[tuple[str, dict, bytes]]:
    """(file, header, payload) of each record, from what stands between CRLF CRLFs, in
    order, with the name of its file.

    Separators inside or across the end of a payload are put back, and what is
    beyond the payload's length belongs to the next record.
    """
    end = (2 * EOL).encode()
    for file, piece in pieces:
        rest = piece + end
        while rest:
            head, _, rest = rest.partition(end)
            first, *lines = head.decode("utf-8", "replace").split(EOL)
            if not first.startswith("WARC/"):
                raise ValueError("not a WARC record")
            parts = (line.partition(":") for line in lines)
            header = {name.strip().lower(): value.strip() for name, _, value in parts}
            size, held = int(header["content-length"]), [rest]
            found = len(rest)
            while found < size + len(end):
                other, piece = next(pieces, (None, b""))
                if other != file:
                    raise ValueError("a WARC record is cut short")
                held += [piece, end]
                found += len(piece) + len(end)
            whole = b"".join(held)
            payload, rest = whole[:size], whole[size + len(end) :]
            if whole[size : size + len(end)] != end:
                raise ValueError("a WARC record has another length than it says")
            yield file, header, payload


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """What the gzipped archives below ``path`` hold: sorted runs of captures, each in
    one file only. An archive that is damaged is an error, and so is a payload
    that does not match its digest."""
    fields = [(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in CAPTURE.split(", ")]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        for batch in batches:
            for file, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield file, value.as_py()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, number, name = [], 0, None
        for file, header, payload in records(pieces(batches)):
            if run and (file != name or len(run) == RUN_RECORDS):
                yield sorted_run(run, f"{name}#{number}")
                run, number = [], number + 1
            name = file
            kind, digest = header["warc-type"], header["warc-payload-digest"].removeprefix("sha1:")
            if kind == "response" and digest_of(payload) != digest:
                raise ValueError("a WARC payload does not match its digest")
            bare = lambda x: (x or "").removeprefix("<urn:capture:").removesuffix(">")
            size = len(payload) if kind == "response" else int(header["x-payload-length"])
            run.append((url_key(header["warc-target-uri"]), header["warc-date"], bare(header["warc-record-id"]), header["warc-target-uri"], kind, size, digest, bare(header.get("warc-refers-to")) or None))
        if run:
            yield sorted_run(run, f"{name}#{number}")

    def sorted_run(run: list[tuple], name: str) -> pa.RecordBatch:
        run.sort(key=order_of)
        columns = [pa.array([name] * len(run)), *(pa.array(c, kind) for c, (_, kind) in zip(zip(*run, strict=True), fields, strict=True))]
        return pa.RecordBatch.from_arrays(columns, names=["run", *(n for n, _ in fields)])

    small_batches(spark)
    lines = spark.read.option("lineSep", EOL * 2).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    return stored(lines.mapInArrow(read, f"run string, {CAPTURE}"), "runs")


def order_of(capture: tuple) -> tuple:
    return capture[0], capture[1], len(capture[2]), capture[2]


class LoserTree:
    """Merges sorted iterators; each inner node keeps the loser of its match."""

    def __init__(self, runs: list[Iterator], key: Callable):
        self.runs, self.key = [iter(r) for r in runs], key
        self.size = max(1, len(self.runs))
        self.heads = [self._next(k) for k in range(self.size)] if self.runs else [None]
        self.losers = [-1] * self.size
        for k in range(self.size):
            self._replay(k, build=True)

    def _next(self, k: int):
        item = next(self.runs[k], None)
        return None if item is None else (self.key(item), k, item)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x[:2] < y[:2])

    def _replay(self, k: int, build: bool = False) -> None:
        winner, node = k, (k + self.size) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0 and build:  # the first to come waits here
                self.losers[node] = winner
                return
            if self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator:
        while (head := self.heads[self.losers[0]]) is not None:
            yield head[2]
            k = self.losers[0]
            self.heads[k] = self._next(k)
            self._replay(k)


def merged_index(captures: DataFrame) -> DataFrame:
    """Captures (run and the columns of CAPTURE) in global order of URL key, time and
    id, with their place in the partition's part of that order.

    A partition holds some RANGE_RECORDS captures, one URL's among several where
    it has more, so what a task merges is bounded.
    """
    order = ["url_key", "stamp", F.length("capture_id"), "capture_id"]
    ranges = max(1, -(-captures.count() // RANGE_RECORDS))
    dealt = captures.repartitionByRange(ranges, *order).sortWithinPartitions("run", *order)
    names = [c.split()[0] for c in CAPTURE.split(", ")]
    fields = [pa.field(c, pa.int64() if c == "payload_bytes" else pa.string()) for c in names] + [pa.field("place", pa.int64())]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        runs = table.column("run").combine_chunks().dictionary_encode().indices.to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), len(runs)]
        out = []
        for place, row in enumerate(LoserTree([_rows(table.slice(a, b - a), names) for a, b in zip(edges, edges[1:], strict=False)], order_of)):
            out.append((*row, place))
            if len(out) == 10_000:
                yield _batch(out, fields)
                out = []
        if out:
            yield _batch(out, fields)

    return dealt.mapInArrow(merge, CAPTURE + ", place long")


def _rows(run: pa.Table, names: list[str]) -> Iterator[tuple]:
    """A run's captures one by one, few of them as Python objects at a time."""
    for part in run.select(names).to_batches(max_chunksize=256):
        yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def _batch(rows: list[tuple], fields: list[pa.Field]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=pa.schema(fields))


def archive_round_trip(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes ``pages`` to new archives in the shared folder, reads them back and
    returns the merged index: id, payload_bytes, payload_digest, record_type,
    refers_to, url_key, stamp, place."""
    spark = pages.sparkSession
    path = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, id_col, url_col, payload_col, min_bytes)
    id_type = dict(pages.dtypes)[id_col]
    back = lambda c: F.when(F.col(c) == "=", "").when(F.col(c) != "", F.url_decode(F.col(c))).cast(id_type)
    return merged_index(read_captures(spark, path)).select(
        back("capture_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", back("refers_to").alias("refers_to"), "url_key", "stamp", "place",
    )
