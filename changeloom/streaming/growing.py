"""Logs that are still being written, as streams of whole records.

A Python data source, "growing_logs": its offsets are the sizes of the files, and a part
of a batch is a stretch of bytes of one file. A record belongs to the stretch in which
its end mark ends, wherever it began, so a changeset goes on as soon as it is whole, a
large file is read in many tasks, and no task depends on another. The driver looks at
names and sizes only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from changeloom.sources.file_logs import FILE_END, PATCHSET_END, ingest_file_log, ingest_patchset_log
from changeloom.sources.xml_logs import ingest_patch_xml, ingest_xml_log

#: Bytes of a stretch, and of a read.
SPLIT, CHUNK = 8 << 20, 1 << 20
#: Stretches of a batch beyond which they are made longer, up to SPLIT bytes: each is a task, whose start takes longer than reading little.
STRETCHES = 128

#: Kinds of logs: the mark that ends a record (or begins the next), whether it must be a line of its own, and the parser.
KINDS = {
    "xml_log": ("</logentry>", False, ingest_xml_log),
    "patch_xml": ("</patch>", False, ingest_patch_xml),
    "file_log": (FILE_END + "\n", True, ingest_file_log),
    "patchset_log": (PATCHSET_END + "\n", True, ingest_patchset_log),
}


class Marks:
    """Finds end marks. No end of a mark may be a beginning of it, so that marks never
    overlap and are the same from wherever one looks."""

    def __init__(self, mark: bytes, line: bool, chunk: int = CHUNK):
        if not mark or any(mark.startswith(mark[-k:]) for k in range(1, len(mark))):
            raise ValueError("an end mark must not be empty nor end as it begins")
        if line and not mark.endswith(b"\n"):
            raise ValueError("a mark that is a line ends it")
        self.mark, self.line, self.chunk = mark, line, chunk

    def find(self, data: bytearray, at: int, base: int, begin: int) -> int:
        """The first mark in ``data`` (whose first byte has place ``base``) from index ``at``
        on; ``begin`` is a place at which a record is known to begin, or -1."""
        while (i := data.find(self.mark, at)) >= 0:
            if not self.line or base + i in (0, begin) or (i and data[i - 1] == 10):
                return i
            at = i + 1
        return -1

    def last_end(self, read: Callable[[int, int], bytes], upto: int) -> int:
        """Where the last mark that ends at ``upto`` or before ends; 0 without any."""
        high = upto
        while high > 0:
            low = max(0, high - self.chunk)
            start = max(0, low - 1)
            data = bytearray(read(min(upto, high + len(self.mark) - 1) - start, start))
            last, at = -1, low - start
            while (i := self.find(data, at, start, -1)) >= 0:
                last, at = i, i + 1
            if last >= 0:
                return start + last + len(self.mark)
            high = low
        return 0

    def ends_within(self, read: Callable[[int, int], bytes], start: int, stop: int) -> bool:
        """Whether a mark ends behind ``start``, up to ``stop``."""
        at = max(0, start - len(self.mark))
        while at < stop:
            data = bytearray(read(min(self.chunk + len(self.mark), stop - at), at))
            i = -1
            while (i := self.find(data, i + 1, at, -1)) >= 0:
                if at + i + len(self.mark) > start:
                    return True
            at += self.chunk
        return False

    def records(self, read: Callable[[int, int], bytes], start: int, stop: int, rest: bool) -> Iterator[tuple[int, bytes]]:
        """(place, record with its mark) of the records whose mark ends behind ``start``, up
        to ``stop``; with ``rest`` also what stands behind the last one."""
        if not rest and not self.ends_within(read, start, stop):
            return
        begin = self.last_end(read, start)
        data, base, upto, at, looked = bytearray(), begin, begin, 0, 0  # data[at:] is the record that begins at ``begin``
        while True:
            i = self.find(data, looked, base, begin)
            if i >= 0:
                end = i + len(self.mark)
                yield begin, bytes(data[at:end])
                at = looked = end
                begin = base + end
            elif upto < stop:
                looked = max(at, len(data) - len(self.mark) + 1)
                del data[: max(0, at - 1)]
                looked, base, at = looked - max(0, at - 1), base + max(0, at - 1), min(at, 1)
                more = read(min(self.chunk, stop - upto), upto)
                if not more:
                    raise EOFError(f"a log ends before byte {stop}")
                data += more
                upto += len(more)
            else:
                break
        if rest and data[at:].strip():
            yield begin, bytes(data[at:])


@dataclass
class Stretch(InputPartition):
    path: str
    repo: str
    start: int
    stop: int
    rest: bool


class _Files:
    """What the readers of batches and of streams share."""

    def __init__(self, options: dict):
        self.path, self.folders = options["path"], options.get("repo", "file") == "folder"
        self.mark, self.line = options["end"], options.get("line", "false").lower() == "true"
        self.rest, self.encoding = options.get("rest", "false").lower() == "true", options.get("encoding", "utf-8")
        self.split, self.chunk = int(options.get("split", SPLIT)), int(options.get("chunk", CHUNK))
        Marks(self.mark.encode(self.encoding), self.line)

    def sizes(self) -> dict[str, int]:
        """Size by path below the folder; hidden names and those that begin with _ are left out."""
        store, top = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        found = store.get_file_info(fs.FileSelector(top, allow_not_found=True, recursive=True))
        names = {f.path[len(top.rstrip("/")) + 1 :]: f.size for f in found if f.type == fs.FileType.File}
        return {n: size for n, size in names.items() if not any(part[0] in "._" for part in n.split("/"))}

    def stretches(self, before: dict[str, int], sizes: dict[str, int]) -> list[Stretch]:
        out, new = [], sum(max(0, size - before.get(name, 0)) for name, size in sizes.items())
        split = max(self.split, min(SPLIT, -(-new // STRETCHES)))
        for name, size in sorted(sizes.items()):
            start = before.get(name, 0)
            if size < start:
                raise ValueError(f"{name} has become shorter; logs must only grow")
            folder = name.split("/")[-2] if "/" in name else ""
            repo = folder.split("=")[-1] if self.folders else name.split("/")[-1]
            for at in range(start, size, split):
                stop = min(size, at + split)
                out.append(Stretch(name, repo, at, stop, self.rest and stop == size))
        return out

    def records(self, part: Stretch) -> Iterator[tuple[str, int, str]]:
        store, top = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        marks = Marks(self.mark.encode(self.encoding), self.line, self.chunk)
        with store.open_input_file(f"{top.rstrip('/')}/{part.path}") as log:
            for place, record in marks.records(lambda n, at: log.read_at(n, at), part.start, part.stop, part.rest):
                yield part.repo, place, record.decode(self.encoding, "replace")


class GrowingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = _Files(options)

    def partitions(self) -> list[Stretch]:
        return self.files.stretches({}, self.files.sizes()) or [Stretch("", "", 0, 0, False)]

    def read(self, partition: Stretch) -> Iterator[tuple[str, int, str]]:
        return self.files.records(partition) if partition.path else iter(())


class GrowingStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.files = _Files(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.files.sizes()

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        return self.files.stretches(start, end)

    def read(self, partition: Stretch) -> Iterator[tuple[str, int, str]]:
        return self.files.records(partition)


class GrowingLogs(DataSource):
    """(repo, at, value): records of the logs below ``path``, with the byte at which each begins.

    Options: end, the mark that ends a record and stays in it; line (true: the mark is a
    line); rest (true: what stands behind the last mark is a record too, for files that
    come whole); repo (file: a file's name, or folder: what its folder is called, behind
    the = if there is one); encoding; split and chunk, bytes of a task (at
    least, if there are many) and of a read.
    """

    @classmethod
    def name(cls) -> str:
        return "growing_logs"

    def schema(self) -> str:
        return "repo string, at long, value string"

    def reader(self, schema: StructType) -> GrowingReader:
        return GrowingReader(dict(self.options))

    def streamReader(self, schema: StructType) -> GrowingStreamReader:
        return GrowingStreamReader(dict(self.options))


def _with_options(reader, spark: SparkSession, path: str, kind: str, options: dict):
    spark.dataSource.register(GrowingLogs)
    mark, line, parse = KINDS[kind]
    for key, value in ({"path": path, "end": mark, "line": line} | options).items():
        reader = reader.option(key, str(value).lower() if isinstance(value, bool) else value)
    return reader.format("growing_logs").load(), parse


def stream_log(spark: SparkSession, path: str, kind: str, parse_options: dict | None = None, **options) -> DataFrame:
    """What the parser of ``kind`` gives for the logs below ``path``, as they grow: each
    changeset once, when its record is whole. ``options`` are those of GrowingLogs."""
    rows, parse = _with_options(spark.readStream, spark, path, kind, options)
    return parse(rows.select("repo", "value"), **(parse_options or {}))


def read_log(spark: SparkSession, path: str, kind: str, parse_options: dict | None = None, **options) -> DataFrame:
    """The same of logs as they are now, large files in many tasks."""
    rows, parse = _with_options(spark.read, spark, path, kind, options)
    return parse(rows.select("repo", "value"), **(parse_options or {}))
