"""Operators on the state of a tree: its history as intervals, tags, snapshots, checks.

A path holds a revision from one changeset up to, not including, another:
``tree_intervals`` (repo, path, rev, from_seq, to_seq; to_seq null while it lasts).
The tree after changeset n is a filter of these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changeloom.functions.scalars import ancestors_of, parent_of, rev_key
from changeloom.operators.cells import END, running, running_greatest, starting_within, with_next
from changeloom.operators.changesets import revision_ids
from changeloom.operators.joins import null_safe
from changeloom.schema import ADD, DEL, REN
from changeloom.storage import stored


def tree_intervals(entries: DataFrame) -> DataFrame:
    """Additions and updates open a path's interval, deletions close it, renames
    close the old path and open the new one. Of a changeset's actions on one path
    the last counts."""
    rev = F.col("new_rev") if "new_rev" in entries.columns else F.lit(None).cast("string")
    opens = entries.where(F.col("action") != DEL).select("repo", "seq", "pos", F.col("name").alias("path"), rev.alias("rev"), F.lit(True).alias("live"))
    closes = entries.where(F.col("action") == DEL).select("repo", "seq", "pos", F.col("name").alias("path"))
    left = entries.where(F.col("action") == REN).select("repo", "seq", (F.col("pos") - 0.5).alias("pos"), F.col("old_name").alias("path"))
    events = opens.unionByName(closes.unionByName(left).select("*", F.lit(None).cast("string").alias("rev"), F.lit(False).alias("live")))
    events = events.groupBy("repo", "path", "seq").agg(F.max_by(F.struct("rev", "live"), "pos").alias("e"))
    w = Window.partitionBy("repo", "path").orderBy("seq")
    return events.withColumn("to_seq", F.lead("seq").over(w)).where("e.live").select("repo", "path", F.col("e.rev").alias("rev"), F.col("seq").alias("from_seq"), "to_seq")


def tree_at(intervals: DataFrame, seq: int) -> DataFrame:
    """(repo, path, rev) after changeset ``seq``."""
    return intervals.where((F.col("from_seq") <= seq) & (F.col("to_seq").isNull() | (F.col("to_seq") > seq))).select("repo", "path", "rev")


def live_counts(intervals: DataFrame) -> DataFrame:
    """(repo, seq, live): number of paths after each changeset that changes it."""
    steps = intervals.select("repo", F.col("from_seq").alias("seq"), F.lit(1).alias("d")).union(intervals.where("to_seq IS NOT NULL").select("repo", "to_seq", F.lit(-1)))
    steps = steps.groupBy("repo", "seq").agg(F.sum("d").alias("d")).where("d <> 0")
    return running(steps, "seq", "d", "live")


# Tags


def tag_file_counts(file_tags: DataFrame) -> DataFrame:
    """(repo, tag, n_files) over all files."""
    return file_tags.groupBy("repo", "tag").agg(F.countDistinct("path").alias("n_files"))


def place_tags(intervals: DataFrame, file_tags: DataFrame) -> DataFrame:
    """(repo, tag, from_seq, to_seq): where the live tree is what the tag holds.

    A tag fits while each of its files has the tagged revision and there are no
    other files: between the latest beginning and the earliest end of its files'
    intervals, for changesets with as many live paths as the tag has files. With
    intervals of ``intervals_since`` a from_seq of BEFORE means that the tree before the
    first changeset fits.

    Stretches of equal counts meet tags by blocks of seq, so that a tag is never
    compared with a stretch that it doesn't overlap.
    """
    held = null_safe(file_tags, intervals, ["repo", "path", "rev"])
    spans = held.groupBy("repo", "tag", "path").agg(F.max("from_seq").alias("lo"), F.max_by(F.coalesce("to_seq", F.lit(END)), "from_seq").alias("hi"))
    fits = spans.groupBy("repo", "tag").agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"), F.count("*").alias("matched"))
    fits = stored(null_safe(fits, tag_file_counts(file_tags), ["repo", "tag"]).where("matched = n_files AND lo < hi").drop("matched"), "fits")
    counts = stored(with_next(live_counts(intervals), "seq", "until").select("repo", "seq", F.col("live").alias("n_files"), "until"), "counts")
    # The stretch in which a tag's span begins, and those that begin within it.
    both = fits.select("repo", F.col("lo").alias("seq"), F.struct("tag", "n_files", "lo", "hi").alias("fit"), F.lit(None).cast("struct<seq:bigint,n_files:bigint,until:bigint>").alias("stretch"))
    both = both.union(counts.select("repo", "seq", F.lit(None).cast(both.schema["fit"].dataType), F.struct("seq", "n_files", "until")))
    first = running_greatest(both, "seq", "stretch", "now").where("fit IS NOT NULL AND now.n_files = fit.n_files").select("repo", "fit.tag", "fit.lo", "fit.hi", "now.seq", "now.until")
    last = counts.groupBy("repo").agg((F.max("seq") + 1).alias("_end"))
    spans = null_safe(fits, last, ["repo"]).select("repo", "n_files", "tag", "lo", "hi", (F.col("lo") + 1).alias("_begin"), F.least("hi", "_end").alias("_end"))
    some = null_safe(counts, fits.select("repo", "n_files").distinct(), ["repo", "n_files"], "left_semi")
    later = starting_within(some, spans, "seq", "_begin", "_end", ["repo", "n_files"]).select("repo", "tag", "lo", "hi", "seq", "until")
    return first.union(later).where("until > lo").select("repo", "tag", F.greatest("lo", "seq").alias("from_seq"), F.least("hi", "until").alias("to_seq"))


#: The place of the state before the first changeset.
BEFORE = -1


def intervals_since(entries: DataFrame, before: DataFrame) -> DataFrame:
    """``tree_intervals`` of a history that goes on from a tree (repo, path, rev)."""
    began = before.select("repo", F.lit(BEFORE).cast("long").alias("seq"), F.lit(0).alias("pos"), F.lit(ADD).alias("action"), F.col("path").alias("name"), F.lit(None).cast("string").alias("old_name"), F.col("rev").alias("new_rev"))
    return tree_intervals(entries.select("repo", "seq", "pos", "action", "name", "old_name", "new_rev").union(began))


def tagging_changesets(placed: DataFrame, since: str | None = None) -> DataFrame:
    """The changeset of each repo that does nothing but tag, for tags that fit the tree
    before the first one: repo, seq, revision, date_utc, author, log, tags.

    Its time is ``since``, up to which history was known, or the year 1900. Nobody
    knows when such a tag was set; whether it is there already must be looked up.
    """
    at = F.lit(since or "1900-01-01 00:00:00").cast("timestamp")
    early = placed.where(F.col("from_seq") <= BEFORE).groupBy("repo").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    listed = F.concat(F.lit("["), F.array_join(F.transform("tags", lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", "), F.lit("]"))
    log = F.concat_ws(" ", F.lit("tag"), F.concat(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00")), listed)
    rows = revision_ids(early.select("repo", F.lit(BEFORE).cast("long").alias("seq"), at.alias("date_utc"), F.lit("unknown tagger").alias("author"), log.alias("log"), "tags"))
    return rows.select("repo", "seq", "revision", "date_utc", "author", "log", "tags")


def tags_common_to_all(tree: DataFrame, file_tags: DataFrame) -> DataFrame:
    """(repo, tag) that every path of ``tree`` (repo, path, rev) carries."""
    total = tree.groupBy("repo").agg(F.count("*").alias("_all"))
    carried = tree.join(file_tags, ["repo", "path", "rev"]).groupBy("repo", "tag").agg(F.countDistinct("path").alias("_n"))
    return carried.join(total, "repo").where("_n = _all").select("repo", "tag")


# Working trees


def find_applied(entries: DataFrame, manifest: DataFrame) -> DataFrame:
    """(repo, seq, applied, last) by a working tree's revisions (repo, path, rev):
    applied if no path there is older than the entry and at least one is as new;
    paths that it lacks decide nothing. last marks the latest applied changeset."""
    there = manifest.select("repo", F.col("path").alias("name"), rev_key(F.col("rev")).alias("_there"))
    known = entries.select("repo", "seq", "name", rev_key(F.col("new_rev")).alias("_own")).join(there, ["repo", "name"], "left")
    older, newer = F.col("_there") < F.col("_own"), F.col("_there") >= F.col("_own")
    found = known.groupBy("repo", "seq").agg((~F.coalesce(F.bool_or(older), F.lit(False)) & F.coalesce(F.bool_or(newer), F.lit(False))).alias("applied"))
    out = stored(found, "applied")
    last = out.where("applied").groupBy("repo").agg(F.max("seq").alias("_last"))
    return out.join(last, "repo", "left").withColumn("last", F.coalesce(F.col("seq") == F.col("_last"), F.lit(False))).drop("_last")


def youngest_entry(manifest: DataFrame) -> DataFrame:
    """The manifest row of each repo with the latest time."""
    return manifest.groupBy("repo").agg(F.max_by(F.struct(*manifest.columns), F.struct("ts", "path")).alias("m")).select("m.*")


def flag_deleted_dirs(entries: DataFrame, intervals: DataFrame) -> DataFrame:
    """With is_directory of deletions: whether paths lay below when it happened."""
    gone = entries.where(F.col("action") == DEL).select("repo", F.col("name").alias("path"), "seq", F.lit(None).cast("string").alias("change")).distinct()
    # The last change of the directory before the deletion tells whether it held anything.
    both = gone.union(directory_changes(intervals).select("repo", "path", "seq", F.col("action").alias("change")))
    w = Window.partitionBy("repo", "path").orderBy("seq", F.col("change").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    held = both.withColumn("_last", F.last("change", ignorenulls=True).over(w)).where("change IS NULL AND _last = 'ADD'")
    out = entries.drop("is_directory").join(held.select("repo", "seq", F.col("path").alias("name"), F.lit(True).alias("_dir")), ["repo", "seq", "name"], "left")
    return out.withColumn("is_directory", F.when(F.col("action") == DEL, F.coalesce("_dir", F.lit(False)))).drop("_dir")


def split_snapshot_by_depth(tree: DataFrame, level: int) -> DataFrame:
    """A first tree (repo, path) in parts: with part_dir, the file's directory or its
    ancestor at depth level + 1, and part, its number in order of directories."""
    directory = F.array_join(F.slice(F.split(parent_of(F.col("path")), "/"), 1, level + 1), "/")
    out = tree.withColumn("part_dir", directory)
    parts = out.select("repo", "part_dir").distinct().withColumn("part", (F.row_number().over(Window.partitionBy("repo").orderBy("part_dir")) - 1).cast("int"))
    return out.join(parts, ["repo", "part_dir"])


# Directories


def synthesize_dir_adds(entries: DataFrame, intervals: DataFrame | None = None) -> DataFrame:
    """(repo, seq, path): directories that additions and renames bring into being: all
    those above their paths that held nothing before. One that was left empty and
    is filled again comes again. ``intervals`` are those of the entries."""
    fresh = entries.where(F.col("action").isin(ADD, REN)).select("repo", "seq", F.explode(ancestors_of(F.col("name"))).alias("path")).distinct()
    found = directory_changes(tree_intervals(entries) if intervals is None else intervals).where(F.col("action") == ADD)
    return found.join(fresh, ["repo", "seq", "path"], "left_semi").select("repo", "seq", "path")


def directory_changes(intervals: DataFrame) -> DataFrame:
    """(repo, path, seq, action): ADD where a directory gets its first path below, DEL
    where it loses its last."""
    dirs = intervals.select("repo", "from_seq", "to_seq", F.explode(ancestors_of(F.col("path"))).alias("path"))
    steps = dirs.select("repo", "path", F.col("from_seq").alias("seq"), F.lit(1).alias("d")).union(dirs.where("to_seq IS NOT NULL").select("repo", "path", "to_seq", F.lit(-1)))
    steps = steps.groupBy("repo", "path", "seq").agg(F.sum("d").alias("d"))
    counts = running(steps.withColumn("_d", F.col("d")), "seq", "d", "live", ("repo", "path"))
    before = F.col("live") - F.col("_d")
    action = F.when((before == 0) & (F.col("live") > 0), ADD).when((before > 0) & (F.col("live") == 0), DEL)
    return counts.withColumn("action", action).where("action IS NOT NULL").select("repo", "path", "seq", "action")


def synthesize_dir_deletes(intervals: DataFrame) -> DataFrame:
    """(repo, seq, path): directories that a changeset leaves empty."""
    return directory_changes(intervals).where(F.col("action") == DEL).select("repo", "seq", "path")


def detect_dir_renames(entries: DataFrame, intervals: DataFrame) -> DataFrame:
    """Renames that empty a directory, all into one new directory, as one rename of
    the directory; is_directory tells it apart. Other entries stay."""
    changes = directory_changes(intervals)
    gone = changes.where(F.col("action") == DEL).select("repo", "seq", F.col("path").alias("old_dir"))
    new = changes.where(F.col("action") == ADD).select("repo", "seq", F.col("path").alias("new_dir"))
    moves = entries.where(F.col("action") == REN).select("repo", "seq", "pos", parent_of(F.col("old_name")).alias("old_dir"), parent_of(F.col("name")).alias("new_dir"))
    found = moves.groupBy("repo", "seq", "old_dir").agg(F.min("new_dir").alias("new_dir"), F.max("new_dir").alias("_other"), F.min("pos").alias("pos")).where("new_dir = _other").drop("_other")
    found = found.join(gone, ["repo", "seq", "old_dir"], "left_semi").join(new, ["repo", "seq", "new_dir"], "left_semi")
    covered = moves.join(found.select("repo", "seq", "old_dir"), ["repo", "seq", "old_dir"], "left_semi").select("repo", "seq", "pos")
    rest = entries.drop("is_directory").join(covered, ["repo", "seq", "pos"], "left_anti").withColumn("is_directory", F.lit(False))
    dirs = found.select("repo", "seq", "pos", F.lit(REN).alias("action"), F.col("new_dir").alias("name"), F.col("old_dir").alias("old_name"), F.lit(True).alias("is_directory"))
    return rest.unionByName(dirs, allowMissingColumns=True)


# Checks


def find_conflicts(entries: DataFrame, intervals: DataFrame) -> DataFrame:
    """Entries whose old_rev is not the revision that the tree had before."""
    keyed = entries.where("old_rev IS NOT NULL").select("repo", "seq", "pos", "action", F.col("name").alias("path"), "old_rev")
    # Beginnings and ends of intervals and entries of a path in one order; what stands last before an entry counts.
    begins = intervals.select("repo", "path", F.col("from_seq").alias("_at"), F.struct(F.lit(True).alias("live"), "rev").alias("_state"), F.lit(1).alias("_kind"))
    ends = intervals.where("to_seq IS NOT NULL").select("repo", "path", F.col("to_seq").alias("_at"), F.struct(F.lit(False).alias("live"), F.lit(None).cast("string").alias("rev")).alias("_state"), F.lit(0).alias("_kind"))
    asked = keyed.select("repo", "path", F.col("seq").alias("_at"), F.lit(-1).alias("_kind"), F.struct("seq", "pos", "action", "old_rev").alias("_entry"))
    events = begins.unionByName(ends).unionByName(asked, allowMissingColumns=True)
    w = Window.partitionBy("repo", "path").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    found = events.withColumn("_before", F.last("_state", ignorenulls=True).over(w)).where("_entry IS NOT NULL")
    out = found.select("repo", "_entry.seq", "_entry.pos", "_entry.action", "path", "_entry.old_rev", F.when(F.col("_before.live"), F.col("_before.rev")).alias("live_rev"))
    return out.where("NOT (old_rev <=> live_rev)")


def leftover_check(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows of one side only, with side; none means that both agree."""
    return expected.exceptAll(actual).withColumn("side", F.lit("expected")).union(actual.exceptAll(expected).withColumn("side", F.lit("actual")))


def verify_trees(source: DataFrame, target: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(repo, path, kind) where trees (repo, path, hash) differ outside the excluded
    directories: missing, extra or changed."""
    outside = lambda df: df.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, exclude)))) if exclude else df
    both = outside(source).select("repo", "path", F.col("hash").alias("_a"), F.lit(True).alias("_s")).join(outside(target).select("repo", "path", F.col("hash").alias("_b"), F.lit(True).alias("_t")), ["repo", "path"], "full_outer")
    kind = F.when(F.col("_t").isNull(), "missing").when(F.col("_s").isNull(), "extra").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return both.withColumn("kind", kind).where("kind IS NOT NULL").select("repo", "path", "kind")


def verify_logs(source: DataFrame, target: DataFrame, columns: tuple[str, ...] = ("repo", "author", "log")) -> DataFrame:
    """Changelogs compared after white space at ends and author line ends are gone."""
    plain = lambda df: df.select(*(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"^\s+|\s+$", ""), r"\s*\n\s*", "\n").alias(c) for c in columns))
    return leftover_check(plain(source), plain(target))


def quarantine_bad(df: DataFrame, checks: dict, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good, bad): bad rows fail one of ``checks`` (name: condition that must hold)
    and have errors, the names. With strict, the first bad row is an error."""
    errors = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items())))
    marked = df.withColumn("errors", errors)
    if strict:
        return marked.where(F.when(F.size("errors") > 0, F.raise_error(F.concat_ws(",", "errors")).cast("boolean")).otherwise(True)).drop("errors"), marked.where("false")
    return marked.where(F.size("errors") == 0).drop("errors"), marked.where(F.size("errors") > 0)


def union_live(updates: DataFrame) -> DataFrame:
    """(repo, path, rev): the last state of each path from (repo, path, rev, seq, live)."""
    return updates.groupBy("repo", "path").agg(F.max_by(F.struct("rev", "live"), "seq").alias("e")).where("e.live").select("repo", "path", "e.rev")


