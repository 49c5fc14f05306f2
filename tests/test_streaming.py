"""Streams give what batches give, once, whatever happens in between."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from changeloom.operators import changesets
from changeloom.plans.registry import queries
from changeloom.storage import shared_dir
from changeloom.streaming import follow, growing

CHANGES = "repo string, seq long, revision string, date_utc timestamp, author string, log string"
START = datetime(2024, 1, 1)


def some(spark, first, n, repo="r"):
    return spark.createDataFrame([(repo, k, str(k), START + timedelta(seconds=60 * k), "u", "m") for k in range(first, first + n)], CHANGES)


def test_pending_changesets_are_applied_once(spark, tmp_path):
    inbox, applied, mark = (str(tmp_path / n) for n in ("inbox", "applied", "mark"))
    seen, fail = [], [True]

    def apply(batch):
        rows = sorted(r["seq"] for r in batch.collect())
        if fail[0] and 7 in rows:
            fail[0] = False
            raise RuntimeError("lost on the way")
        seen.extend(rows)

    some(spark, 0, 5).write.mode("append").parquet(inbox)
    run = lambda: follow.pending_stream(follow.stream_ingest(spark, inbox, CHANGES), apply, applied, mark).awaitTermination()
    run()
    some(spark, 3, 6).write.mode("append").parquet(inbox)
    with pytest.raises(Exception, match="lost on the way"):
        run()
    run()
    run()
    assert seen == list(range(9))
    assert follow.last_applied(spark, applied).first()["seq"] == 8


def test_text_is_parsed_as_it_comes(spark, tmp_path):
    inbox = tmp_path / "logs"
    inbox.mkdir()
    for k in range(4):
        (inbox / f"f{k}").write_text(f"a{k}\nb{k}\n")
    stream = follow.stream_ingest(spark, str(inbox), parse=lambda df: df.select("repo", F.explode(F.split("value", "\n")).alias("line")).where("line <> ''"), files_per_batch=1)
    out, rounds = [], []
    follow.rate_limited(stream).foreachBatch(lambda df, n: (out.extend(r["line"] for r in df.collect()), rounds.append(n))[0]).option("checkpointLocation", str(tmp_path / "mark")).start().awaitTermination()
    assert sorted(out) == sorted(f"{c}{k}" for c in "ab" for k in range(4)) and len(rounds) >= 4


def test_duplicates_within_the_watermark(spark, tmp_path):
    inbox = str(tmp_path / "inbox")
    some(spark, 0, 5).union(some(spark, 2, 3)).coalesce(1).write.parquet(inbox)
    stream = follow.stream_dedupe(follow.stream_ingest(spark, inbox, CHANGES))
    follow.rate_limited(stream).format("memory").queryName("deduped").option("checkpointLocation", str(tmp_path / "mark")).start().awaitTermination()
    assert spark.table("deduped").count() == 5


def test_tree_is_kept(spark, tmp_path):
    """Eleven batches, some in one start: the tree of the last rows, in three folders; what was deleted at first is gone from them."""
    inbox, out, mark = (str(tmp_path / n) for n in ("inbox", "tree", "mark"))
    assert follow._folders(11) == [8, 10, 11] and follow._folders(0) == []
    spark.createDataFrame([], follow.TREE).write.parquet(str(tmp_path / "none"))
    rng, held, seq = random.Random(2), {}, 0
    for part in range(11):
        rows = []
        for _ in range(6):
            seq += 1
            path, live = f"p{rng.randrange(25)}", rng.random() < 0.6
            rows.append(("r", path, str(seq), seq, live))
            held[path] = str(seq) if live else None
        spark.createDataFrame(rows, follow.TREE).coalesce(1).write.mode("append").parquet(inbox)
        if part in (0, 1, 4, 7, 10):
            follow.stream_tree(follow.stream_ingest(spark, inbox, follow.TREE, files_per_batch=1), out, mark).awaitTermination()
            got = {r["path"]: r["rev"] for r in follow.current_tree(spark, out).collect()}
            assert got == {p: rev for p, rev in held.items() if rev}
    assert spark.read.parquet(f"{out}/upto-8").where("NOT live").count() == 0
    assert follow.current_tree(spark, str(tmp_path / "no")).count() == 0


def test_deletions_outlast_batches_in_no_order(spark, tmp_path):
    """A merged folder must still know of a deletion when what was there before it comes later."""
    inbox, out, mark = (str(tmp_path / n) for n in ("inbox", "tree", "mark"))
    for rows in ([("r", "a", "2", 9, False)], [("r", "b", "1", 1, True)], [("r", "a", "1", 3, True)], [("r", "b", "2", 4, True)]):
        spark.createDataFrame(rows, follow.TREE).coalesce(1).write.mode("append").parquet(inbox)
        follow.stream_tree(follow.stream_ingest(spark, inbox, follow.TREE, files_per_batch=1), out, mark, ordered=False).awaitTermination()
        got = {r["path"]: r["rev"] for r in follow.current_tree(spark, out).collect()}
        assert "a" not in got
    assert got == {"b": "2"}


def test_a_batch_reads_only_its_own_days(spark, tmp_path):
    """Records of other days are not even opened: one of them is no parquet file."""
    applied = str(tmp_path / "applied")
    step = follow.resume_safe_apply(lambda rows: None, applied)
    day = lambda k, n: spark.createDataFrame([("r", k, str(k), datetime(2024, 1, 1 + n), "u", "m")], CHANGES)
    for n in range(4):
        step(day(n, n), n)
    broken = tmp_path / "applied" / f"part={(datetime(2024, 1, 2) - datetime(1970, 1, 1)).days}"
    for old in broken.rglob("*.parquet"):
        old.write_bytes(b"no table")
    (old.parent / f".{old.name}.crc").unlink(missing_ok=True)
    step(day(2, 2).union(day(9, 2)).union(day(10, 3)), 4)
    rows = spark.read.option("basePath", applied).parquet(*(str(p) for p in (tmp_path / "applied").glob("part=*") if p != broken))
    assert sorted((r["seq"], r["batch"]) for r in rows.collect()) == [(0, 0), (2, 2), (3, 3), (9, 4), (10, 4)]
    # Without a date in the identity parts go by hash; a null identity has one too.
    again = follow.resume_safe_apply(lambda rows: None, str(tmp_path / "other"), ("repo", "revision"))
    for n in range(2):
        again(day(1, 1).union(day(1, 2)).union(day(3, 3).withColumn("revision", F.lit(None).cast("string"))), n)
    assert spark.read.parquet(str(tmp_path / "other")).count() == 2


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


WITH_ACTS = CHANGES + ", tags array<string>, acts map<string,string>"


def collapsing(spark, tmp_path):
    inbox, polls, mark, out = (str(tmp_path / n) for n in ("inbox", "polls", "mark", "out"))
    spark.createDataFrame([], "at timestamp").write.mode("append").parquet(polls)

    def start(rows=(), polled=None):
        rows = [(repo, k, str(k), START + timedelta(seconds=s), author, "m", tags, {"p": action}) for repo, k, s, author, tags, action in rows]
        spark.createDataFrame(rows, WITH_ACTS).write.mode("append").parquet(inbox)
        if polled is not None:
            spark.createDataFrame([(START + timedelta(seconds=polled),)], "at timestamp").write.mode("append").parquet(polls)
        stream = follow.stream_collapse(follow.stream_ingest(spark, inbox, WITH_ACTS), 180, "1 minute", follow.stream_ingest(spark, polls, "at timestamp"))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return sorted((r["repo"] or "", r["revision"], r["author"], r["n"], r["late"]) for r in spark.read.schema(follow.COLLAPSED).parquet(out).collect())

    return start


def test_stream_collapse_gives_groups_that_cannot_grow(spark, tmp_path, rocksdb):
    """Over batches and starts: gaps, others' changesets, tags and clashing paths end a group; what is late is told."""
    start = collapsing(spark, tmp_path)
    rows = [(0, "u", [], "UPD"), (60, "u", ["t"], "UPD"), (110, "u", [], "UPD"), (150, "u", [], "DEL"), (500, "u", [], "UPD"), (560, "v", [], "UPD"), (2_000, "u", [], "UPD"), (10, "u", [], "UPD")]
    for k, (seconds, author, tags, action) in enumerate(rows):
        got = start([("r", k, seconds, author, tags, action)])
    want = [("r", "0", "u", 2, False), ("r", "2", "u", 1, False), ("r", "3", "u", 1, False), ("r", "4", "u", 1, False), ("r", "5", "v", 1, False), ("r", "7", "u", 1, True)]
    assert got == want
    # Nothing more comes to r: another repo's changeset moves the watermark, and so does a poll.
    assert start([("s", 8, 2_241, "w", [], "UPD")]) == sorted([*want, ("r", "6", "u", 1, False)])
    assert start(polled=2_000) == sorted([*want, ("r", "6", "u", 1, False)])
    assert start(polled=2_482) == sorted([*want, ("r", "6", "u", 1, False), ("s", "8", "w", 1, False)])


def test_stream_collapse_equals_batches(spark, tmp_path, rocksdb):
    """Rows out of order within the delay, in five starts: the groups of the batch operator, the last ones too."""
    rng, rows, at = random.Random(7), [], 0
    for k in range(120):
        at += rng.choice([0, 1, 20, 100, 179, 180, 400])
        rows.append((rng.choice("rs"), k, at, rng.choice("uv"), ["t"] if rng.random() < 0.05 else [], rng.choice(["UPD", "UPD", "DEL"])))
    start = collapsing(spark, tmp_path)
    landed = sorted(rows, key=lambda r: r[2] + rng.uniform(0, 50))
    for part in range(5):
        got = start(landed[part * 24 : (part + 1) * 24], polled=at + 1_000 if part == 4 else None)
    sets = changesets.order_changesets(spark.createDataFrame([(repo, str(k), START + timedelta(seconds=s), author, "m", tags, action) for repo, k, s, author, tags, action in rows], "repo string, revision string, date_utc timestamp, author string, log string, tags array<string>, action string"))
    # Order among equal dates is by author, message and revision in both, since message and first action are the same here.
    sets = sets.drop("seq").withColumn("seq", F.row_number().over(Window.partitionBy("repo").orderBy("date_utc", "author", "log", "revision")))
    found = changesets.collapse_changesets(sets, sets.select("repo", "seq", F.lit("p").alias("name"), "action"))
    groups = found.groupBy("repo", "group").agg(F.min_by("revision", "seq").alias("revision"), F.min_by("author", "seq").alias("author"), F.count("*").alias("n"))
    assert got == sorted((r["repo"], r["revision"], r["author"], r["n"], False) for r in groups.collect())


def test_collapse_stream_equals_batches(spark, tmp_path):
    """Groups that go on over batches, in a repo without a name too: those of the batch
    operator; a lost batch is done again, and late rows are told."""
    inbox, polls, state, mark, out = (str(tmp_path / n) for n in ("inbox", "polls", "state", "mark", "out"))
    rng, rows, at = random.Random(11), [], 0
    for k in range(120):
        at += rng.choice([0, 1, 20, 20, 60, 60, 179, 180])
        tags, acts = rng.choice([None, *[[]] * 15, ["t"]]), {f"p{rng.randrange(9)}": rng.choice([*["UPD"] * 9, "DEL"]) for _ in range(rng.randrange(3))}
        rows.append((rng.choice(["r", None]), k, str(k), START + timedelta(seconds=at), rng.choice([*"uuuuuuuuuv", None]), "m", tags, acts))
    spark.createDataFrame([], "at timestamp").write.parquet(polls)

    def start(rows, polled=None):
        spark.createDataFrame(rows, WITH_ACTS).coalesce(1).write.mode("append").parquet(inbox)
        if polled:
            spark.createDataFrame([(polled,), (None,)], "at timestamp").write.mode("append").parquet(polls)
        stream = follow.stream_ingest(spark, inbox, WITH_ACTS)
        query = follow.collapse_stream(stream, out, state, mark, 180, "1 minute", follow.stream_ingest(spark, polls, "at timestamp"))
        query.awaitTermination()
        return query

    landed = sorted(rows, key=lambda r: r[3] + timedelta(seconds=rng.uniform(0, 50)))
    for part in range(3):
        query = start(landed[part * 40 : (part + 1) * 40])
        assert not query.lastProgress["stateOperators"]  # nothing is kept by repo in one task
    # The last batch is lost before it is committed, and run again.
    for file in (tmp_path / "mark" / "commits").glob("*2*"):
        file.unlink()
    start([("r", 999, "999", START, "u", "m", None, None)], rows[-1][3] + timedelta(hours=1))
    sets = spark.createDataFrame(rows, WITH_ACTS).drop("seq")
    sets = sets.withColumn("seq", F.row_number().over(Window.partitionBy("repo").orderBy("date_utc", "author", "log", "revision")))
    found = changesets.collapse_changesets(sets, sets.select("repo", "seq", F.explode("acts").alias("name", "action")))
    groups = found.groupBy("repo", "group").agg(*(F.min_by(c, "seq").alias(c) for c in ("revision", "author", "log")), F.min("date_utc").alias("first"), F.max("date_utc").alias("last"), F.count("*").alias("n"), F.lit(False).alias("late"))
    fields = lambda rows: sorted(str(tuple(r)) for r in rows)
    got = spark.read.schema(follow.COLLAPSED).parquet(out).select("repo", "revision", "author", "log", "first_date", "date_utc", "n", "late").collect()
    want = [*groups.drop("group").collect(), ("r", "999", "u", "m", START, START, 1, True)]
    assert fields(got) == fields(want) and max(r["n"] for r in got) > 5


def test_streamed_groups_need_no_state_by_repo(spark):
    """A repo's pending changesets of a large batch don't fit one task, so no operator is keyed by repo."""
    shared = Path(shared_dir(spark).removeprefix("file://"))
    before = set(shared.glob("stream-*"))
    queries()["t5_stream_collapse"](spark, "/root/testdata/sf0.001").count()
    new = [p for p in shared.glob("stream-*") if p not in before]
    assert new and not any((p / "mark" / "state").exists() for p in new)


def test_session_windows_and_snapshot(spark):
    batch = some(spark, 0, 4)
    assert [r["n"] for r in follow.session_collapse(batch, 61).collect()] == [4]
    assert len(follow.session_collapse(batch, 60).collect()) == 4
    out = follow.bootstrap_then_follow(batch, 2, source="s").orderBy("seq").collect()
    assert [(r["seq"], r["snapshot"], r["log"]) for r in out] == [(2, True, "Import of s at 2"), (3, False, "m")]
    assert follow.bootstrap_then_follow(batch, None, follow=False).count() == 1


def test_gated_changesets_stay_pending(spark, tmp_path):
    """Over batches and starts nothing passes a rejected changeset, nothing is lost, and
    what is accepted later goes on from there."""
    inbox, applied, pending, mark = (str(tmp_path / n) for n in ("inbox", "applied", "pending", "mark"))

    def run(accepted):
        follow.gated_stream(follow.stream_ingest(spark, inbox, CHANGES, files_per_batch=1), accepted, applied, pending, mark).awaitTermination()
        return sorted((r["repo"], r["seq"]) for r in spark.read.parquet(applied).collect())

    def land(first, n, repo="r"):
        some(spark, first, n, repo).coalesce(1).write.mode("append").parquet(inbox)

    shut, no_three = [("r", k) for k in range(3)], ~((F.col("repo") == "r") & (F.col("seq") == 3))
    land(0, 5)
    land(5, 3)
    assert run(no_three) == shut
    land(8, 2)
    land(0, 2, "s")
    assert run(no_three) == [*shut, ("s", 0), ("s", 1)]
    land(10, 1)
    assert run(F.lit(True)) == [*(("r", k) for k in range(11)), ("s", 0), ("s", 1)]


def entry_of(k, text="m"):
    return f'<logentry revision="{k}"><author>u{k % 3}</author><date>2024-01-02T03:04:05Z</date><paths><path action="M">/a/é{k}</path><path action="A">/b</path></paths><msg>{text}</msg></logentry>\n'


def test_records_whatever_the_cuts():
    """Stretches of all sizes give each record once, in the stretch where its mark ends."""
    text = "head\n----\na--\n----\n----\n x----\nbb\n\n----\ntail"
    data = text.encode()
    read = lambda n, at: data[at : at + n]
    for mark, line in ((b"----\n", True), (b"----\n", False), (b"a-", False)):
        whole, at = [], 0
        for i in range(len(data)):
            if data.startswith(mark, i) and i >= at and (not line or i == 0 or data[i - 1] == 10):
                whole.append((at, data[at : i + len(mark)]))
                at = i + len(mark)
        for size in range(1, len(data) + 1):
            for chunk in (1, 3, 50):
                marks, got = growing.Marks(mark, line, chunk), []
                for start in range(0, len(data), size):
                    stop = min(len(data), start + size)
                    got += marks.records(read, start, stop, stop == len(data))
                assert got == [*whole, (at, data[at:])]
    with pytest.raises(ValueError, match="end as it begins"):
        growing.Marks(b"\n--\n", False)


def test_log_is_read_while_it_grows(spark, tmp_path):
    """Records cut anywhere, over several starts and 100 bytes a task: rows as the batch parser gives."""
    logs, out, mark = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "mark")
    logs.mkdir()
    whole = {name: ("<log>" + "".join(entry_of(k, f"{name} 漢 &lt;") for k in range(25)) + "</log>").encode() for name in ("r1", "r2")}

    def start():
        stream = growing.stream_log(spark, str(logs), "xml_log", split=100, chunk=64)
        stream.writeStream.trigger(availableNow=True).format("parquet").option("path", out).option("checkpointLocation", mark).start().awaitTermination()
        return spark.read.parquet(out)

    seen = []
    for cut in (90, 1_000, 1_001, 3_333, 10**6):
        for name, data in whole.items():
            with open(logs / name, "ab") as log:
                log.write(data[log.tell() : cut])
        rows = start()
        seen.append({r["revision"] for r in rows.collect()})
        for r in seen[-1]:  # whole as soon as its end is there
            assert f'revision="{r}"' in whole["r1"][:cut].decode("utf-8", "ignore")
        assert len(seen[-1]) == whole["r1"][:cut].count(b"</logentry>")
    files = spark.read.option("wholetext", True).text(str(logs)).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("repo"), "value")
    want = sorted(map(str, growing.KINDS["xml_log"][2](files).collect()))
    assert sorted(map(str, rows.select(*growing.KINDS["xml_log"][2](files).columns).collect())) == want
    assert sorted(map(str, growing.read_log(spark, str(logs), "xml_log", split=777).collect())) == want
    (logs / "r1").write_text("short")
    with pytest.raises(Exception, match="become shorter"):
        start()


def test_logs_by_line_marks(spark, tmp_path):
    """A patch set is whole when the next one begins, or at the end of a file that comes whole."""
    text = "".join(f"{'-' * 21}\nPatchSet {k} \nDate: 2024/01/02 03:04:05\nAuthor: u\nBranch: HEAD\nTag: (none) \nLog:\nm {'-' * 21}\n\nMembers: \n\tf{k}:1.1->1.2 \n\n" for k in range(1, 9))
    (tmp_path / "r").write_text(text)
    read = lambda **more: sorted((r["seq"], r["name"], r["log"]) for r in growing.read_log(spark, str(tmp_path), "patchset_log", split=50, **more).collect())
    rows = [(k, f"f{k}", "m " + "-" * 21) for k in range(1, 9)]
    assert read() == rows[:-1] and read(rest=True) == rows


def test_large_batches_are_read_in_few_tasks(tmp_path):
    """Tasks of a batch follow its size only where they are of SPLIT bytes."""
    files = growing._Files({"path": str(tmp_path), "end": "</logentry>", "split": str(1 << 16)})
    for size in (1 << 16, 1 << 24, 1 << 28, 1 << 33):
        sizes = {f"repo={k}/log": size // 4 for k in range(4)}
        found = files.stretches({}, sizes)
        assert len(found) <= max(growing.STRETCHES, size / growing.SPLIT) + 4
        assert all(a.stop == b.start for a, b in zip(found, found[1:]) if a.path == b.path)
        assert sum(s.stop - s.start for s in found) == sum(sizes.values())
    assert len(files.stretches({}, {"log": 1 << 20})) == 16
