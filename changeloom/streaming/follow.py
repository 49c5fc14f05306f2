"""Following histories as they grow, with Structured Streaming.

A history arrives as files of parsed rows or of log text. Queries run with
``availableNow`` triggers and checkpoints, so each start takes what is new and
stops; a batch that was applied before a crash is not applied again, because
applied rows are looked up by identity.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from changeloom.operators import cells
from changeloom.operators.changesets import missing_changesets, order_changesets, with_starts
from changeloom.operators.joins import null_safe
from changeloom.storage import stored

IDENTITY = ("repo", "revision", "date_utc", "author")


def stream_ingest(spark: SparkSession, path: str, schema: str | None = None, parse: Callable[[DataFrame], DataFrame] | None = None, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the files that come to ``path``: parquet rows of ``schema``, or log
    text as (repo, value), one row a file, given to ``parse``.

    ``files_per_batch`` takes a long history in parts.
    """
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if schema:
        rows = reader.schema(schema).parquet(path)
    else:
        rows = reader.option("wholetext", True).format("text").load(path).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("repo"), "value")
    return parse(rows) if parse else rows


def rate_limited(stream: DataFrame, seconds: float | None = None):
    """A writer for ``stream``: all that is there, or a batch each so many seconds."""
    return stream.writeStream.trigger(availableNow=True) if seconds is None else stream.writeStream.trigger(processingTime=f"{seconds} seconds")


def table_at(spark: SparkSession, path: str, schema: str | StructType, base: str | None = None) -> DataFrame:
    """The table at ``path``; an empty one where nothing has been written yet. ``base`` is
    the whole table's path if this one is a part of it."""
    try:
        return (spark.read.option("basePath", base) if base else spark.read).schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def resume_safe_apply(apply: Callable[[DataFrame], DataFrame | None], applied_path: str, key: tuple[str, ...] = IDENTITY, run: str = "") -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that applies each changeset once.

    The batch is what is pending; rows whose identity was recorded at
    ``applied_path`` by other batches were applied before. Records lie in parts by
    identity (``_part``), and only the parts that a batch has rows of are looked into,
    so that its work doesn't grow with the history before. What ``apply`` gives,
    or the batch if it gives nothing, is recorded under ``run`` (name of
    the checkpoint) and batch. A batch that was lost halfway is run again and its
    records replaced, so that applying by returning rows happens once; what
    ``apply`` does besides may be done again for that one batch.
    """

    def step(batch: DataFrame, number: int) -> None:
        pending = batch.dropDuplicates(list(key)).persist()
        fresh = missing_changesets(pending, _done_before(pending, applied_path, key, number, run), key).persist()
        try:
            done = apply(fresh)
            write_state(fresh if done is None else done, applied_path, number, run, key)
        finally:
            fresh.unpersist()
            pending.unpersist()

    return step


def _run_name(run: str) -> str:
    return f"r{zlib.crc32(run.encode()):08x}"


#: Parts of identities without a date, and how many parts a batch may have before all are read.
HASHED, SOME = 1024, 1000


def _part(key: tuple[str, ...]) -> Column:
    """Where an identity is recorded: by day, which equal identities share; by hash if it has no date."""
    if "date_utc" in key:
        return F.coalesce(F.floor(F.unix_seconds(F.col("date_utc").cast("timestamp")) / 86_400).cast("string"), F.lit("none"))
    return F.pmod(F.xxhash64(*key), F.lit(HASHED)).cast("string")


def _done_before(batch: DataFrame, path: str, key: tuple[str, ...], number: int, run: str) -> DataFrame:
    """Records of other batches in the parts that ``batch`` has rows of."""
    parts = [r[0] for r in batch.select(_part(key)).distinct().limit(SOME + 1).collect()]
    where = "*" if len(parts) > SOME else "{" + ",".join(sorted(parts) or ["none"]) + "}"
    schema = StructType([*batch.schema.fields]).add("part", "string").add("run", "string").add("batch", "long")
    found = table_at(batch.sparkSession, f"{path}/part={where}", schema, path)
    return found.where((F.col("run") != _run_name(run)) | (F.col("batch") != number))


def write_state(applied: DataFrame, path: str, number: int, run: str = "", key: tuple[str, ...] = IDENTITY) -> None:
    """Records applied changesets as those of a batch, in one step."""
    rows = applied.drop("part", "run", "batch").withColumns({"part": _part(key), "run": F.lit(_run_name(run)), "batch": F.lit(number).cast("long")})
    rows = rows.repartition("part")  # a file for each part
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "run", "batch").parquet(path)


def last_applied(spark: SparkSession, path: str) -> DataFrame:
    """The last applied changeset of each repo: repo, seq, batch."""
    return spark.read.parquet(path).groupBy("repo").agg(F.max("seq").alias("seq"), F.max("batch").alias("batch"))


def pending_stream(stream: DataFrame, apply: Callable[[DataFrame], DataFrame | None], applied_path: str, checkpoint: str, key: tuple[str, ...] = IDENTITY) -> StreamingQuery:
    """Starts a query that applies what is pending and ends when nothing is. To keep
    back what is not accepted, see ``gated_stream``."""
    return rate_limited(stream).foreachBatch(resume_safe_apply(apply, applied_path, key, checkpoint)).option("checkpointLocation", checkpoint).start()


def gated_stream(stream: DataFrame, accepted: Column, applied_path: str, pending_path: str, checkpoint: str, key: tuple[str, ...] = IDENTITY) -> StreamingQuery:
    """Starts a query that applies, of each repo, what comes before the first changeset
    that is not accepted, and ends when nothing is left to read.

    The rejected changeset and all of higher seq stay pending: they are stored below
    ``pending_path``, which belongs to ``checkpoint``, a folder for each batch, and
    gated again with every later batch. Batches must come in order of seq, as a
    history grows; what has been applied is not taken back.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.unionByName(table_at(spark, f"{pending_path}/{number - 1}", batch.schema))
        # Of rows of one identity a rejected one decides, so that the choice is the same in every batch.
        fresh = fresh.withColumn("_ok", F.coalesce(accepted, F.lit(False)))
        fresh = fresh.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("_ok", "seq"))).where("_n = 1").drop("_n")
        fresh = missing_changesets(fresh, _done_before(fresh, applied_path, key, number, checkpoint), key)
        stop = fresh.where("NOT _ok").groupBy(F.col("repo").alias("_repo")).agg(F.min("seq").alias("_stop"))
        fresh = fresh.join(stop, F.col("repo").eqNullSafe(F.col("_repo")), "left").withColumn("_held", F.coalesce(F.col("seq") >= F.col("_stop"), F.lit(False))).persist()
        try:
            # What is held is stored first: a batch that is lost between the two writes is run again from the last pending folder.
            fresh.where("_held").select(*batch.columns).write.mode("overwrite").parquet(f"{pending_path}/{number}")
            write_state(fresh.where("NOT _held").select(*batch.columns), applied_path, number, checkpoint, key)
        finally:
            fresh.unpersist()

    return rate_limited(stream).foreachBatch(run).option("checkpointLocation", checkpoint).start()


def stream_dedupe(stream: DataFrame, time: str = "date_utc", delay: str = "1 hour", key: tuple[str, ...] = IDENTITY) -> DataFrame:
    """Without rows of an identity that came less than ``delay`` before."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(key))


class _Collapse(StatefulProcessor):
    """Holds the changesets of a repo until no earlier one can come, by the watermark, and
    the group that may still grow, with the actions of its paths in a map. Timers wake it
    when the watermark has passed what is held, whether or not the repo has news."""

    def __init__(self, seconds: int):
        self.gap = timedelta(seconds=seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        row = "date_utc timestamp, author string, log string, revision string, tagged boolean, acts string"
        self.handle = handle
        self.waiting = handle.getListState("waiting", row)
        self.open = handle.getValueState("open", "first timestamp, last timestamp, author string, log string, revision string, n long, tagged boolean")
        self.held = handle.getMapState("held", "path string", "action string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark, out, new = _time(timerValues.getCurrentWatermarkInMs()), [], []
        for frame in rows:
            frame = frame[~frame["polled"]]
            for date, *rest in frame[["date_utc", "author", "log", "revision", "tagged", "acts_json"]].itertuples(index=False):
                row = (pd.Timestamp(date).to_pydatetime(), *(None if x is None or x != x else x for x in rest))
                if row[0] < mark:
                    out.append((row[0], *row[:4], 1, True))
                else:
                    new.append(row)
        if new:
            self.waiting.appendList(new)
        yield from self._advance(key, mark, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, _time(timerValues.getCurrentWatermarkInMs()), [])

    def _advance(self, key, mark: datetime, out: list[tuple]) -> Iterator[pd.DataFrame]:
        waiting = sorted(self.waiting.get(), key=_in_order) if self.waiting.exists() else []
        ready = [r for r in waiting if r[0] < mark]
        group = self.open.get() if self.open.exists() else None
        for date, author, log, revision, tagged, acts in ready:
            here = json.loads(acts) if acts else {}
            if group and group[2] == author and group[3] == log and date - group[1] < self.gap and not group[6] and not any(self.held.containsKey((p,)) and self.held.getValue((p,))[0] != a for p, a in here.items()):
                group = (group[0], date, author, log, group[4], group[5] + 1, bool(tagged))
            else:
                if group:
                    out.append((*group[:6], False))
                self._forget()
                group = (date, date, author, log, revision, 1, bool(tagged))
            for path, action in here.items():
                self.held.updateValue((path,), (action,))
        if group and mark - group[1] >= self.gap:
            out.append((*group[:6], False))
            self._forget()
            group = None
        if group:
            self.open.update(group)
        elif self.open.exists():
            self.open.clear()
        rest = waiting[len(ready) :]
        if ready and rest:
            self.waiting.put(rest)
        elif ready:
            self.waiting.clear()
        self._wake(([group[1] + self.gap] if group else []) + [r[0] for r in rest[:1]])
        if out:
            frame = pd.DataFrame(out, columns=["first_date", "date_utc", "author", "log", "revision", "n", "late"])
            frame.insert(0, "repo", key[0])
            yield frame

    def _forget(self) -> None:
        if self.held.exists():
            self.held.clear()

    def _wake(self, times: list[datetime]) -> None:
        """Timers for when the watermark is past ``times``, and no others."""
        wanted = {math.floor((t - EPOCH) / timedelta(milliseconds=1)) + 1 for t in times}
        there = {t[0] if isinstance(t, tuple) else t for t in self.handle.listTimers()}
        for t in there - wanted:
            self.handle.deleteTimer(t)
        for t in wanted - there:
            self.handle.registerTimer(t)

    def close(self) -> None:
        pass


EPOCH = datetime(1970, 1, 1)


def _time(millis: int) -> datetime:
    return EPOCH + timedelta(milliseconds=millis)


def _in_order(row: tuple) -> tuple:
    return tuple((x is not None, x) for x in row[:4])


COLLAPSED = "repo string, first_date timestamp, date_utc timestamp, author string, log string, revision string, n long, late boolean"


def stream_collapse(stream: DataFrame, seconds: int = 180, delay: str = "10 minutes", polled: DataFrame | None = None) -> DataFrame:
    """Groups of neighbouring changesets as ``collapse_changesets`` makes them, each
    when it cannot grow any more: same author and log, less than ``seconds`` apart, no
    tag in between (tags array) and no path with another action (acts, a map from path
    to action), where the stream has those.

    The watermark, ``delay`` behind the latest date of any repo, tells that nothing
    earlier comes. So a repo's last group is given when others have moved on; where
    there are none, ``polled``, a stream of times (at) up to which the sources have
    been read, moves the watermark as a changeset would. A changeset that comes with a
    date before the watermark is a row of its own with late, to be looked into. Those
    without a date are not for this. Needs the RocksDB state store and UTC sessions.

    What waits of one repo is sorted by one task in memory, so this is for histories
    that come in small batches; ``collapse_stream`` has no such bound.
    """
    tagged = F.coalesce(F.size("tags") > 0, F.lit(False)) if "tags" in stream.columns else F.lit(False)
    acts = F.to_json("acts") if "acts" in stream.columns else F.lit("{}")
    rows = stream.where("date_utc IS NOT NULL").select("repo", "date_utc", "author", "log", "revision", tagged.alias("tagged"), acts.alias("acts_json"), F.lit(False).alias("polled"), F.col("date_utc").alias("_event"))
    if polled is not None:
        none = F.lit(None).cast("string")
        rows = rows.union(polled.select(none, "at", none, none, none, F.lit(False), none, F.lit(True), F.col("at").alias("_event")))
    # The rows go on without the column of the watermark: Spark would drop late ones.
    rows = rows.withWatermark("_event", delay).drop("_event").groupBy("repo")
    return rows.transformWithStateInPandas(_Collapse(seconds), outputStructType=COLLAPSED, outputMode="Append", timeMode="EventTime")


def collapse_stream(stream: DataFrame, path: str, state_path: str, checkpoint: str, seconds: int = 180, delay: str = "10 minutes", polled: DataFrame | None = None) -> StreamingQuery:
    """Starts a query that writes the groups of ``stream_collapse`` to ``path``, a folder
    for each batch, and ends when nothing is left to read.

    A batch is numbered and cut by the steps of ``collapse_changesets``, so a repo's rows
    are in as many tasks as its history has cells. What is left of a batch is stored below
    ``state_path``, which belongs to ``checkpoint``, a folder for each batch: changesets
    that an earlier one may still come before, the last group of each repo if it may
    still grow, as one row, and the action of each of its paths. The watermark is
    that of the batch's own rows, so groups are given in the batch that closes them.
    A batch that was lost is done again and replaces its folders. UTC sessions.
    """
    has = set(stream.columns)
    given = [F.col(c) if c in has else F.lit(None).cast(t).alias(c) for c, t in (("tags", "array<string>"), ("acts", "map<string,string>"))]
    rows = stream.where("date_utc IS NOT NULL").select("repo", F.col("date_utc").cast("timestamp").alias("date_utc"), "author", "log", "revision", *given, F.col("date_utc").cast("timestamp").alias("_event"))
    if polled is not None:
        rows = rows.union(polled.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema[:-1]), F.col("at").alias("_event")))
    waits, first = rows.drop("_event").schema, F.col("date_utc").alias("first_date")

    def run(batch: DataFrame, number: int) -> None:
        spark, last, here = batch.sparkSession, f"{state_path}/{number - 1}", f"{state_path}/{number}"
        mark = lambda at: F.timestamp_micros(F.lit(at).cast("long")) - F.expr(f"INTERVAL {delay}")
        behind = lambda at: F.coalesce(F.col("date_utc") < mark(at), F.lit(False))
        batch = batch.persist()
        try:
            was = table_at(spark, f"{last}/mark", "at long").agg(F.max("at")).first()[0]
            at = batch.agg(F.greatest(F.max(F.unix_micros("_event")), F.lit(was).cast("long"))).first()[0]
            fresh = batch.where("date_utc IS NOT NULL").drop("_event")
            late = fresh.where(behind(was)).select("repo", first, "date_utc", "author", "log", "revision", F.lit(1).cast("long").alias("n"), F.lit(True).alias("late"))
            held = fresh.where(~behind(was)).unionByName(table_at(spark, f"{last}/waiting", waits))
            held.where(~behind(at)).write.mode("overwrite").parquet(f"{here}/waiting")
            # The group that was open is one changeset, before all others.
            ready = order_changesets(held.where(behind(at))).select("repo", "seq", first, "date_utc", "author", "log", "revision", F.lit(1).cast("long").alias("n"), "tags", "acts")
            whole = stored(ready.unionByName(table_at(spark, f"{last}/open", ready.drop("acts").schema), allowMissingColumns=True), "changesets")
            names = None
            if "acts" in has:
                names = whole.select("repo", "seq", F.explode("acts").alias("name", "action")).union(table_at(spark, f"{last}/held", HELD))
            marks = with_starts(whole, names, seconds, "first_date", "date_utc", "author", "log", "revision", "n", "tags")
            ends = marks.groupBy("repo").agg(F.max("_start").alias("_open"), F.max("date_utc").alias("_last")).where(mark(at) - F.col("_last") < F.expr(f"INTERVAL {seconds} SECONDS")).drop("_last")
            still = F.coalesce(F.col("seq") >= F.col("_open"), F.lit(False))
            ended = null_safe(marks, ends, ["repo"], "left")
            pick = [F.min("first_date").alias("first_date"), F.max("date_utc").alias("date_utc"), *(F.min_by(c, "seq").alias(c) for c in ("author", "log", "revision")), F.sum("n").alias("n")]
            grown = ended.where(still).groupBy("repo").agg(*pick, F.max_by("tags", "seq").alias("tags"))
            grown.withColumn("seq", F.lit(-1).cast("long")).write.mode("overwrite").parquet(f"{here}/open")
            if names is not None:
                kept = null_safe(names, ends, ["repo"]).where(still).groupBy("repo", "name").agg(F.max("action").alias("action"))
                kept.select("repo", F.lit(-1).cast("long").alias("seq"), "name", "action").write.mode("overwrite").parquet(f"{here}/held")
            spark.range(1).select(F.lit(at).cast("long").alias("at")).write.mode("overwrite").parquet(f"{here}/mark")
            closed = cells.running_greatest(ended.where(~still).drop("_open", "tags"), "seq", "_start", "group").groupBy("repo", "group").agg(*pick)
            closed.drop("group").withColumn("late", F.lit(False)).unionByName(late).write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            batch.unpersist()

    return rate_limited(rows).foreachBatch(run).option("checkpointLocation", checkpoint).start()


HELD = "repo string, seq long, name string, action string"


def session_collapse(stream: DataFrame, seconds: int = 180, delay: str = "10 minutes") -> DataFrame:
    """The same, nearly: changesets of others in between do not break a group."""
    gap = f"{seconds * 1_000_000 - 1} microseconds"
    grouped = stream.withWatermark("date_utc", delay).groupBy(F.session_window("date_utc", gap).alias("w"), "repo", "author", "log")
    return grouped.agg(F.count("*").alias("n"), F.max("date_utc").alias("date_utc"))


TREE = "repo string, path string, rev string, seq long, live boolean"


def stream_tree(stream: DataFrame, path: str, checkpoint: str, ordered: bool = True) -> StreamingQuery:
    """Keeps updates (repo, path, rev, seq, live) of a tree at ``path``, which belongs to
    ``checkpoint``; ``current_tree`` reads the tree.

    The n-th batch is merged with as many before it as the greatest power of two that
    divides n says. So a row is written once for each doubling of the history, and the
    tree after n batches is in as many folders as n has binary digits of one. What was
    deleted is forgotten in folders that go back to the first batch, unless batches are
    not ``ordered`` by seq: then a later batch may bring what was there before the
    deletion, so the deletion is kept, a row for each path. A batch that was lost is
    done again and replaces its folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, n = batch.sparkSession, number + 1
        rows, size = batch.select("repo", "path", "rev", F.col("seq").cast("long"), "live"), n & -n
        for before in _folders(n - 1)[-(size.bit_length() - 1):] if size > 1 else []:
            rows = rows.union(spark.read.schema(TREE).parquet(f"{path}/upto-{before}"))
        latest = rows.groupBy("repo", "path").agg(F.max_by(F.struct("rev", "seq", "live"), "seq").alias("e")).select("repo", "path", "e.*")
        latest.where("live" if ordered and size == n else "true").write.mode("overwrite").parquet(f"{path}/upto-{n}")
        # Two marks in turn: while one is written the other holds.
        spark.range(1).select(F.lit(n).cast("long").alias("n")).write.mode("overwrite").parquet(f"{path}/mark-{n % 2}")

    return rate_limited(stream).foreachBatch(write).option("checkpointLocation", checkpoint).start()


def _folders(n: int) -> list[int]:
    """The folders that hold the first n batches: n without its lower binary ones, shortest first."""
    out = []
    while n:
        out.append(n)
        n &= n - 1
    return out[::-1]


def current_tree(spark: SparkSession, path: str) -> DataFrame:
    """(repo, path, rev) as of all batches; nothing but the last folders is read."""
    marks = table_at(spark, f"{path}/mark-0", "n long").union(table_at(spark, f"{path}/mark-1", "n long"))
    rows = table_at(spark, f"{path}/none", TREE)
    for n in _folders(marks.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]):
        rows = rows.union(spark.read.schema(TREE).parquet(f"{path}/upto-{n}"))
    return rows.groupBy("repo", "path").agg(F.max_by(F.struct("rev", "live"), "seq").alias("e")).where("e.live").select("repo", "path", "e.rev")


def bootstrap_then_follow(changesets: DataFrame, snapshot_seq: int | None = None, follow: bool = True, source: str = "", text: str = "Import of {source} at {revision}") -> DataFrame:
    """A first changeset that stands for all up to ``snapshot_seq`` (the first if none
    is given), then the later ones; without ``follow`` the snapshot alone.

    A snapshot that is not the first changeset gets an import message.
    """
    ends = changesets.groupBy("repo").agg(F.min("seq").alias("_first"), (F.lit(snapshot_seq) if snapshot_seq is not None else F.min("seq")).alias("_at"))
    rows = changesets.join(ends, "repo")
    made = F.replace(F.replace(F.lit(text), F.lit("{source}"), F.lit(source)), F.lit("{revision}"), F.coalesce(F.col("revision"), F.lit("")))
    log = F.when((F.col("seq") == F.col("_at")) & (F.col("_at") > F.col("_first")), made).otherwise(F.col("log"))
    out = rows.withColumn("log", log).where((F.col("seq") >= F.col("_at")) if follow else (F.col("seq") == F.col("_at")))
    return out.withColumn("snapshot", F.col("seq") == F.col("_at")).select(*changesets.columns, "snapshot")
