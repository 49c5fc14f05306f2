"""Streams over the general tables, run until nothing is left."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from changeloom.operators import adapt
from changeloom.plans import views as V
from changeloom.plans.catalog import query
from changeloom.storage import shared_dir, stored
from changeloom.streaming import follow, growing

#: Parts in which the gated history comes.
PARTS = 3

CHANGES = "repo string, seq long, revision string, date_utc timestamp, author string, log string"


def _landed(spark, df) -> tuple[str, str]:
    """``df`` as files that a stream can follow, and a folder for what it leaves."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    df.write.parquet(f"{base}/inbox")
    return f"{base}/inbox", base


def _changes(spark, sf):
    return V.changes(spark, sf).select("repo", "seq", F.col("event_id").cast("string").alias("revision"), F.col("date_utc").cast("timestamp").alias("date_utc"), "author", "log")


@query("t3_resume_safe_apply", V.sql("changes", "SELECT repo, seq, CAST(event_id AS VARCHAR) AS revision FROM changes"))
def applied(spark, sf):
    """Two starts over the same files, the second from the beginning: each changeset is applied once."""
    inbox, base = _landed(spark, _changes(spark, sf))
    for mark in ("first", "second"):
        follow.pending_stream(follow.stream_ingest(spark, inbox, CHANGES), lambda batch: None, f"{base}/applied", f"{base}/{mark}").awaitTermination()
    return spark.read.parquet(f"{base}/applied").select("repo", "seq", "revision")


@query("k6_last_applied", V.sql("changes", "SELECT repo, max(seq) AS seq FROM changes GROUP BY 1"))
def last(spark, sf):
    inbox, base = _landed(spark, _changes(spark, sf))
    follow.pending_stream(follow.stream_ingest(spark, inbox, CHANGES, files_per_batch=2), lambda batch: None, f"{base}/applied", f"{base}/mark").awaitTermination()
    return follow.last_applied(spark, f"{base}/applied").select("repo", "seq")


def _in_parts(spark, rows, base: str, start):
    """``rows`` land in PARTS by date; after each part ``start`` takes what is there. Gives the latest date."""
    rows = stored(rows, "landing")
    low, high = rows.agg(F.min("date_utc"), F.max("date_utc")).first()
    edges = [low + (high - low) * k / PARTS for k in range(PARTS)] if low else []
    for k, edge in enumerate(edges):
        rows.where((F.col("date_utc") >= edge) & (F.lit(k + 1 == PARTS) | (F.col("date_utc") < (edges[k + 1] if k + 1 < PARTS else edge)))).write.mode("append").parquet(f"{base}/inbox")
        start().awaitTermination()
    return high


@query("t6_stream_dedupe", V.sql("changes", "SELECT repo, seq FROM changes"))
def deduped(spark, sf):
    """Every changeset comes twice within the delay; the state of earlier parts is gone by then."""
    rows, base = _changes(spark, sf), f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def start():
        stream = follow.stream_dedupe(follow.stream_ingest(spark, f"{base}/inbox", CHANGES), delay="1 hour")
        return follow.rate_limited(stream).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/mark").start()

    _in_parts(spark, rows.union(rows), base, start)
    return spark.read.parquet(f"{base}/out").select("repo", "seq")


@query("t1_stream_log", V.sql("acts", "SELECT repo, CAST(event_id AS VARCHAR) AS revision, author, log, CAST(epoch(date_trunc('second', date_utc)) AS BIGINT) AS date, action, path AS name FROM acts"))
def log_stream(spark, sf):
    """A history as XML logs, which land in parts; tasks take 64 KiB, wherever that cuts a record."""
    rows = V.acts(spark, sf).withColumn("date_utc", F.date_trunc("second", F.col("date_utc").cast("timestamp")))
    code = F.translate(F.substring("action", 1, 1), "U", "M")
    value = F.format_string(
        '<logentry revision="%d"><author>%s</author><date>%s</date><paths><path action="%s">/%s</path></paths><msg>%s</msg></logentry>',
        "event_id", "author", F.date_format("date_utc", "yyyy-MM-dd'T'HH:mm:ss.000000'Z'"), code, "path", "log",
    )
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    texts = stored(rows.select("repo", "event_id", value.alias("value")), "texts")
    for part in range(PARTS):
        texts.where(F.col("event_id") % PARTS == part).select("repo", "value").write.mode("append").partitionBy("repo").text(f"{base}/logs")
        stream = growing.stream_log(spark, f"{base}/logs", "xml_log", repo="folder", split=1 << 16)
        stream.writeStream.trigger(availableNow=True).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/mark").start().awaitTermination()
    return spark.read.parquet(f"{base}/out").select("repo", "revision", "author", "log", F.unix_seconds("date_utc").alias("date"), "action", "name")


GROUPS = """, m AS (SELECT *, CASE WHEN lag(author) OVER w = author AND lag(log) OVER w = log AND date_trunc('microseconds', date_utc) - lag(date_utc) OVER w < INTERVAL 6 HOUR AND lag(seq) OVER w % 5 <> 0 THEN 0 ELSE 1 END AS new FROM changes WINDOW w AS (PARTITION BY repo ORDER BY seq)), g AS (SELECT *, sum(new) OVER (PARTITION BY repo ORDER BY seq) AS grp FROM m)
    SELECT repo, min_by(CAST(event_id AS VARCHAR), seq) AS revision, count(*) AS n, false AS late FROM g GROUP BY repo, grp"""


@query("t5_stream_collapse", V.sql("changes", GROUPS).replace(") , m AS", "), m AS"))
def collapsed(spark, sf):
    """Groups across batches, closed by gaps, other changesets, tags and the watermark; polls of the sources move it on."""
    rows = V.changes(spark, sf).select("repo", "seq", F.col("event_id").cast("string").alias("revision"), F.col("date_utc").cast("timestamp").alias("date_utc"), "author", "log", F.when(F.col("seq") % 5 == 0, F.array(F.lit("t"))).alias("tags"))
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    spark.createDataFrame([], "at timestamp").write.parquet(f"{base}/polls")

    def start():
        polled = follow.stream_ingest(spark, f"{base}/polls", "at timestamp")
        stream = follow.stream_ingest(spark, f"{base}/inbox", CHANGES + ", tags array<string>")
        return follow.collapse_stream(stream, f"{base}/out", f"{base}/state", f"{base}/mark", 6 * 3600, "1 day", polled)

    high = _in_parts(spark, rows, base, start)
    spark.range(1).select((F.lit(high).cast("timestamp") + F.expr("INTERVAL 9 DAYS")).alias("at")).write.mode("append").parquet(f"{base}/polls")
    start().awaitTermination()
    return spark.read.schema(follow.COLLAPSED).parquet(f"{base}/out").select("repo", "revision", "n", "late")


@query("h2_after_hooks", V.sql("changes", "SELECT repo, seq, 'release-' || seq AS tag FROM changes WHERE seq % 50 = 49"))
def tagged(spark, sf):
    """After each commit of a batch a hook tags every fiftieth changeset."""
    inbox, base = _landed(spark, _changes(spark, sf))

    def tag(committed):
        rows = committed.where("seq % 50 = 49").select("repo", "seq", F.concat(F.lit("release-"), F.col("seq").cast("string")).alias("tag"))
        rows.write.mode("append").parquet(f"{base}/tags")

    follow.pending_stream(follow.stream_ingest(spark, inbox, CHANGES, files_per_batch=2), lambda batch: adapt.after_hooks(batch, [tag]), f"{base}/applied", f"{base}/mark").awaitTermination()
    return spark.read.parquet(f"{base}/tags")


@query("t9_stream_tree", V.sql("ivals", "SELECT repo, path, rev FROM ivals WHERE to_seq IS NULL"))
def kept_tree(spark, sf):
    """The files of the history are in no order, so neither are batches."""
    rows = V.changes(spark, sf).select("repo", "path", "rev", "seq", (F.col("action") != "DEL").alias("live"))
    inbox, base = _landed(spark, rows)
    follow.stream_tree(follow.stream_ingest(spark, inbox, "repo string, path string, rev string, seq long, live boolean", files_per_batch=2), f"{base}/tree", f"{base}/mark", ordered=False).awaitTermination()
    return follow.current_tree(spark, f"{base}/tree")


@query("t7_gated_stream", V.sql("changes", "SELECT repo, seq FROM changes c WHERE seq < coalesce((SELECT min(seq) FROM changes d WHERE d.repo = c.repo AND d.path LIKE '%/f77'), 1000000000)"))
def gated(spark, sf):
    """What a gate lets through is applied; the rest stays pending, over several batches
    and starts: the history lands in parts by seq, each followed by a start. The files
    of a part are in no order, so a part is one batch."""
    rows = V.changes(spark, sf).select("repo", "seq", F.col("event_id").cast("string").alias("revision"), F.col("date_utc").cast("timestamp").alias("date_utc"), "author", "log", "path")
    rows = stored(rows, "gated")
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    top = rows.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] + 1
    for part in range(PARTS):
        rows.where((F.col("seq") >= top * part // PARTS) & (F.col("seq") < top * (part + 1) // PARTS)).write.mode("append").parquet(f"{base}/inbox")
        stream = follow.stream_ingest(spark, f"{base}/inbox", CHANGES + ", path string")
        follow.gated_stream(stream, ~F.endswith("path", F.lit("/f77")), f"{base}/applied", f"{base}/pending", f"{base}/mark").awaitTermination()
    return spark.read.parquet(f"{base}/applied").select("repo", "seq")
