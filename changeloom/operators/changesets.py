"""Operators that make, order, merge and select changesets."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeloom.functions.scalars import default_author as _author
from changeloom.functions.scalars import branch_of, is_branch, rev_key, rev_text, same_branch
from changeloom.operators import cells
from changeloom.operators.cells import running
from changeloom.operators.joins import null_safe as _join
from changeloom.schema import ADD, DEL, UPD
from changeloom.storage import stored


# From file revisions to changesets


def drop_spurious_births(revs: DataFrame) -> DataFrame:
    """Without the dead first revisions that a file born on a branch has."""
    born = (F.col("rev") == "1.1") & (F.col("state") == "dead") & F.startswith("log", F.lit("file ")) & F.contains(F.col("log"), F.lit(" was initially added on branch "))
    return revs.where(~F.coalesce(born, F.lit(False)))


def drop_repeated_dead(revs: DataFrame) -> DataFrame:
    """Without dead revisions that the next newer one of the file repeats."""
    w = Window.partitionBy("repo", "path").orderBy(rev_key(F.col("rev")))
    return revs.withColumn("_next", F.lead("state").over(w)).where(~((F.col("state") == "dead") & F.coalesce(F.col("_next") == "dead", F.lit(False)))).drop("_next")


def classify_file_history(revs: DataFrame) -> DataFrame:
    """With action: a dead revision deletes; one without line counts, and one that
    follows a deletion, adds; others update."""
    kept = drop_repeated_dead(drop_spurious_births(revs))
    w = Window.partitionBy("repo", "path").orderBy(rev_key(F.col("rev")))
    born = ~F.coalesce("has_lines", F.lit(False)) | F.coalesce(F.lag("state").over(w) == "dead", F.lit(False))
    return kept.withColumn("action", F.when(F.col("state") == "dead", DEL).when(born, ADD).otherwise(UPD))


def filter_branch(revs: DataFrame, symbols: DataFrame, branch: str | None = None) -> DataFrame:
    """Revisions on the wanted branch. ``symbols`` (repo, path, tag, number) are all
    files' tags; without a branch the one of the newest revision counts, and a
    file that lacks the branch keeps all its revisions."""
    if branch is None:
        number = revs.groupBy("repo", "path").agg(branch_of(F.max(rev_key(F.col("rev")))).alias("_branch"))
    else:
        number = symbols.where(F.col("tag") == branch).groupBy("repo", "path").agg(F.min(rev_key(F.col("number"))).alias("_branch"))
        number = number.withColumn("_branch", F.when(is_branch(F.col("_branch")), F.col("_branch")).otherwise(branch_of(F.col("_branch"))))
    out = revs.join(number, ["repo", "path"], "left")
    return out.where(F.col("_branch").isNull() | same_branch(rev_key(F.col("rev")), F.col("_branch"))).drop("_branch")


def collect_by_key(revs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classified revisions as (changesets, entries): those with equal date, author
    and message are one changeset. A path that is there twice is one entry, with
    its highest revision and the action of its lowest."""
    key = ["repo", "date_utc", "author", "log"]
    entries = revs.groupBy(*key, "path").agg(F.max(rev_key(F.col("rev"))).alias("_new"), F.min_by("action", rev_key(F.col("rev"))).alias("action"))
    entries = entries.withColumn("pos", (F.row_number().over(Window.partitionBy(*key).orderBy("path")) - 1).cast("int"))
    heads = entries.groupBy(*key).agg(F.min_by("action", "pos").alias("first_action"))
    changesets = order_changesets(heads)
    entries = _join(entries, changesets.select(*key, "seq"), key).select("repo", "seq", "pos", "action", F.col("path").alias("name"), rev_text(F.col("_new")).alias("new_rev"))
    return changesets, entries


def order_changesets(changesets: DataFrame, identity: str = "revision") -> DataFrame:
    """With seq from 0 within each repo: by date, author, first action and message, and
    where all of these are equal by the text of ``identity``, if there is such a column.

    Numbers are dealt within days and then offset, so that no task sorts a whole
    history. Changesets without a date come first.
    """
    order = [F.col("date_utc"), F.col("author"), F.coalesce("first_action", F.lit(" ")) if "first_action" in changesets.columns else F.lit(" "), F.col("log")]
    order += [F.col(identity).cast("string")] if identity in changesets.columns else []
    day = changesets.withColumn("_day", F.to_date("date_utc"))
    days = day.groupBy("repo", "_day").agg(F.count("*").alias("_n"))
    days = days.withColumn("_before", F.sum("_n").over(Window.partitionBy("repo").orderBy("_day")) - F.col("_n")).drop("_n")
    placed = day.withColumn("_place", F.row_number().over(Window.partitionBy("repo", "_day").orderBy(*order)))
    return _join(placed, days, ["repo", "_day"]).withColumn("seq", F.col("_before") + F.col("_place") - 1).drop("_day", "_before", "_place")


def collapse_changesets(changesets: DataFrame, entries: DataFrame | None = None, seconds: int = 180) -> DataFrame:
    """With group, the seq of the first changeset of those that are one commit, and
    group_date, the latest of their dates.

    A changeset joins the one just before it, whoever made that, if author and
    message are equal, it comes less than ``seconds`` later, the group has no tag
    yet and no path occurs in both with different actions.

    Neighbours, numbers of islands and groups go from cell to cell of seq, which must be
    distinct in a repo, so that dense histories and long groups are in many tasks.
    """
    whole = stored(changesets, "changesets")  # each step below reads its input twice
    marks = with_starts(whole, entries, seconds, "date_utc")
    grouped = stored(cells.running_greatest(marks, "seq", "_start", "group").drop("_start"), "grouped")
    dated = cells.group_greatest(grouped, "seq", "group", "date_utc", "group_date").drop("date_utc")
    return _join(whole, dated, ["repo", "seq"])


def with_starts(whole: DataFrame, entries: DataFrame | None, seconds: int, *columns: str) -> DataFrame:
    """(repo, seq, _start) and ``columns`` of stored changesets: _start is the seq where
    a group begins, null where a changeset joins the one before."""
    tags = F.coalesce(F.size("tags") > 0, F.lit(False)) if "tags" in whole.columns else F.lit(False)
    micros = F.unix_micros(F.col("date_utc").cast("timestamp"))
    rows = whole.select("repo", "seq", "author", "log", micros.alias("_micros"), tags.alias("_tagged"), *(c for c in columns if c not in ("author", "log")))
    rows = cells.with_previous(rows, "seq", F.struct("author", "log", F.col("_micros").alias("at"), F.col("_tagged").alias("tagged")), "_prev")
    near = F.col("_prev.author").eqNullSafe(F.col("author")) & F.col("_prev.log").eqNullSafe(F.col("log"))
    near &= (F.col("_micros") - F.col("_prev.at") < seconds * 1_000_000) & ~F.col("_prev.tagged")
    first = F.col("_prev").isNull() | ~F.coalesce(near, F.lit(False))
    marks = stored(rows.select("repo", "seq", *columns, F.when(first, F.col("seq")).alias("_start")), "marks")
    if entries is None:
        return marks
    islands = cells.running_greatest(marks.select("repo", "seq", "_start"), "seq", "_start", "_island").select("repo", "seq", "_island")
    cut = group_starts(stored(islands, "islands"), entries).withColumn("_cut", F.lit(True))
    return stored(_join(marks, cut, ["repo", "seq"], "left").select("repo", "seq", *columns, F.when(F.col("_cut"), F.col("seq")).otherwise(F.col("_start")).alias("_start")), "marks")


def group_starts(islands: DataFrame, entries: DataFrame) -> DataFrame:
    """(repo, seq): where groups begin inside of islands (repo, seq, _island: the seq of
    its first), because a path comes again with another action than the group has.

    A group that begins at g ends before the first changeset of which a path was in g or
    later with another action; it is enough to look at the path's occurrence just
    before. So each possible start has one next start, the least of the clashes that
    begin at it or behind it, and pointer doubling over these tells which are reached
    from the islands' starts. Rounds are as the logarithm of the groups in an island.
    """
    names = entries.groupBy("repo", "seq", "name").agg(F.max("action").alias("action"))
    names = _join(names, islands, ["repo", "seq"])
    pairs = cells.with_previous(names, "seq", F.struct("seq", "action"), "_was", keys=("repo", "_island", "name")).where("_was.action <> action")
    where = F.struct("repo", "_island").alias("_in")
    clashes = stored(pairs.select(where, F.col("_was.seq").alias("seq"), F.col("seq").alias("target")).groupBy("_in", "seq").agg(F.min("target").alias("target")), "clashes")
    firsts = clashes.select("_in", F.col("_in._island").alias("seq")).distinct()
    starts = firsts.union(clashes.select("_in", F.col("target").alias("seq"))).distinct().withColumn("start", F.lit(True))
    places = clashes.withColumn("start", F.lit(False)).unionByName(starts.withColumn("target", F.lit(None).cast("long")))
    places = places.groupBy("_in", "seq").agg(F.min("target").alias("target"), F.bool_or("start").alias("start"))
    nexts = cells.following_least(places, "seq", "target", "next", keys=("_in",)).where("start AND next IS NOT NULL")
    hops = stored(nexts.select("_in", "seq", "next"), "hops")
    reached, found = stored(firsts, "reached"), None
    while True:
        # What hops of the present length reach is new: nothing lies as far from the first as something before it.
        fresh = stored(reached.join(hops, ["_in", "seq"]).select("_in", F.col("next").alias("seq")), "reached")
        if not fresh.head(1):
            break
        found = fresh if found is None else found.union(fresh)
        reached = reached.union(fresh)
        further = hops.select("_in", F.col("seq").alias("next"), F.col("next").alias("_next"))
        hops = stored(hops.join(further, ["_in", "next"]).select("_in", "seq", F.col("_next").alias("next")), "hops")
    found = firsts.where("false") if found is None else found
    return found.select("_in.repo", "seq")


def audit_revision_counts(revs: DataFrame, headers: DataFrame) -> DataFrame:
    """Files whose number of revisions differs from what their header
    (repo, path, selected) announced."""
    found = revs.groupBy("repo", "path").agg(F.count("*").alias("found"))
    out = headers.join(found, ["repo", "path"], "left").withColumn("found", F.coalesce("found", F.lit(0)).cast("long"))
    return out.where("found <> selected")


# Selection


def default_author(changesets: DataFrame) -> DataFrame:
    return changesets.withColumn("author", _author(F.col("author")))


def drop_restricted(changesets: DataFrame, paths: str | None = None) -> DataFrame:
    """Without rows that have a revision and nothing else to show."""
    seen = F.coalesce(F.col("date_utc").cast("string"), F.col("author"), F.col("log"))
    return changesets.where(seen.isNotNull() | (F.col(paths).isNotNull() if paths else F.lit(False)))


def since_revision(changesets: DataFrame, mark: int | str | None, column: str = "seq") -> DataFrame:
    """Rows strictly after a mark: a number, a timestamp, or a known revision's place."""
    if mark is None:
        return changesets
    if column != "revision":
        return changesets.where(F.col(column) > F.lit(mark))
    known = changesets.where(F.col("revision") == mark).groupBy("repo").agg(F.max("seq").alias("_mark"))
    return changesets.join(known, "repo").where("seq > _mark").drop("_mark")


def resolve_start(changesets: DataFrame, spec: str) -> DataFrame:
    """The history from where ``spec`` says on, that place included.

    INITIAL, HEAD, a number, a patch hash, a timestamp, a tag, a revision, or a
    branch followed by INITIAL or a timestamp.
    """
    head, _, tail = spec.partition(" ")
    stamp = r"\d{4}-\d\d-\d\d( \d\d:\d\d(:\d\d)?)?"
    if tail and not re.fullmatch(stamp, spec):
        return resolve_start(branch_subset(changesets, [head]), tail)
    if spec == "INITIAL":
        return changesets
    if spec == "HEAD":
        return head_changeset(changesets)
    if re.fullmatch(stamp, spec):
        return changesets.where(F.col("date_utc") >= F.lit(spec).cast("timestamp"))
    if spec.isdigit():
        return changesets.where(F.col("revision").cast("long") >= int(spec))
    if re.fullmatch(r"\d{14}-[0-9a-f]{5}-[0-9a-f]{40}\.gz", spec):
        found = F.col("patch_hash") == spec
    else:
        found = (F.col("revision") == spec) | F.coalesce(F.array_contains("tags", spec), F.lit(False))
    start = changesets.where(found).groupBy("repo").agg(F.min("seq").alias("_start"))
    return changesets.join(start, "repo").where("seq >= _start").drop("_start")


def first_changeset(changesets: DataFrame) -> DataFrame:
    """The oldest changeset of each repo."""
    return _extreme(changesets, F.min_by)


def head_changeset(changesets: DataFrame) -> DataFrame:
    """The newest changeset of each repo."""
    return _extreme(changesets, F.max_by)


def _extreme(changesets: DataFrame, pick) -> DataFrame:
    row = F.struct(*(c for c in changesets.columns))
    return changesets.groupBy("repo").agg(pick(row, F.col("seq")).alias("r")).select("r.*")


def branch_subset(changesets: DataFrame, branches: list[str]) -> DataFrame:
    return changesets.where(F.arrays_overlap("branches", F.array(*map(F.lit, branches))))


def missing_changesets(upstream: DataFrame, local: DataFrame, key: tuple[str, ...] = ("repo", "revision", "date_utc", "author")) -> DataFrame:
    """Changesets of ``upstream`` that ``local`` has not; null parts of the identity
    are equal to each other."""
    k = list(key)
    other = local.select(*(F.col(c).alias(f"_{c}") for c in k)).distinct()
    same = F.lit(True)
    for c in k:
        same &= upstream[c].eqNullSafe(other[f"_{c}"])
    return upstream.join(other, same, "left_anti")


def dedupe(changesets: DataFrame) -> DataFrame:
    """One row of each identity: repo, revision, date and author, and the patch hash
    where both rows have one."""
    key = ["repo", "revision", "date_utc", "author"]
    hashes = F.array_sort(F.collect_set("patch_hash"))
    kinds = changesets.groupBy(*key).agg(hashes.alias("_hashes"))
    marked = _join(changesets, kinds, key).withColumn("_h", F.coalesce("patch_hash", F.get("_hashes", F.lit(0)), F.lit("")))
    return marked.withColumn("_n", F.row_number().over(Window.partitionBy(*key, "_h").orderBy(F.col("patch_hash").isNull(), "seq"))).where("_n = 1").drop("_n", "_h", "_hashes")


# Tags


def attach_tags(changesets: DataFrame, tags: DataFrame) -> DataFrame:
    """With tags from (repo, revision, tag), sorted; none is an empty array."""
    found = tags.groupBy("repo", "revision").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return changesets.drop("tags").join(found, ["repo", "revision"], "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def attach_parent_tags(changesets: DataFrame, tags: DataFrame) -> DataFrame:
    """For changesets that only tag (tag_only): of the tags, those on their parents."""
    pairs = changesets.where("tag_only").select("repo", F.col("revision").alias("_rev"), F.explode("parents").alias("revision")).join(tags, ["repo", "revision"])
    return attach_tags(changesets, pairs.select("repo", F.col("_rev").alias("revision"), "tag"))


def first_seen_tags(changesets: DataFrame) -> DataFrame:
    """(repo, tag, seq): where each tag is seen first."""
    return changesets.select("repo", "seq", F.explode("tags").alias("tag")).groupBy("repo", "tag").agg(F.min("seq").alias("seq"))


def suppress_repeat_tags(changesets: DataFrame) -> DataFrame:
    """(repo, seq, tag) without tags that the same state already has: a state is a
    changeset with changes (not tag_only) and the tag-only ones that follow."""
    steps = changesets.withColumn("_step", F.when(F.col("tag_only"), 0).otherwise(1))
    rows = running(steps, "seq", "_step", "_state").select("repo", "seq", "_state", F.explode("tags").alias("tag"))
    w = Window.partitionBy("repo", "tag").orderBy("seq")
    return rows.withColumn("_last", F.lag("_state").over(w)).where("_last IS NULL OR _last <> _state").select("repo", "seq", "tag")


def resolve_tag_clash(tags: DataFrame, overwrite: bool = False) -> DataFrame:
    """One row of each (repo, tag): the later wins when overwriting; otherwise the
    first stays and clash tells that there were more."""
    order = F.desc("seq") if overwrite else F.col("seq")
    w = Window.partitionBy("repo", "tag")
    out = tags.withColumns({"_n": F.row_number().over(w.orderBy(order)), "clash": (F.count("*").over(w) > 1) & F.lit(not overwrite)})
    return out.where("_n = 1").drop("_n")


# Identities and people


def revision_ids(changesets: DataFrame) -> DataFrame:
    """With revision '<UTC time> by <author>', as sources without revisions get."""
    stamp = F.date_format("date_utc", "yyyy-MM-dd HH:mm:ss")
    return changesets.withColumn("revision", F.concat(stamp, F.lit(" by "), F.col("author")))


def parse_revision_id(revision: Column) -> tuple[Column, Column]:
    """Time and author of such a revision."""
    return F.try_to_timestamp(F.substring_index(revision, " by ", 1)), F.regexp_extract(revision, "(?s) by (.*)$", 1)


#: Author maps of more than this many names are joined, not sent to all tasks.
MAPPED_INLINE = 1_000


def remap_authors(changesets: DataFrame, mapping: Mapping[str, str] | DataFrame) -> DataFrame:
    """Authors renamed by a dict, or by a table (author, new_author) of any size;
    others stay."""
    if not isinstance(mapping, DataFrame):
        if len(mapping) <= MAPPED_INLINE:
            if not mapping:
                return changesets
            table = F.create_map(*(F.lit(x) for item in mapping.items() for x in item))
            return changesets.withColumn("author", F.coalesce(F.element_at(table, F.col("author")), "author"))
        mapping = changesets.sparkSession.createDataFrame(list(mapping.items()), "author string, new_author string")
    return changesets.join(mapping.dropDuplicates(["author"]), "author", "left").withColumn("author", F.coalesce("new_author", "author")).select(*changesets.columns)


# Certificates


def fold_certs(certs: DataFrame) -> DataFrame:
    """One changeset for each revision of (repo, revision, pos, name, value): authors
    joined by '.', first date, message of test results, logs and comments, all
    branches and tags. A missing author or date makes it bad."""
    of = lambda name: F.transform(F.filter(F.col("c"), lambda x: x["name"] == name), lambda x: x["value"])
    rows = certs.groupBy("repo", "revision").agg(F.sort_array(F.collect_list(F.struct("pos", "name", "value"))).alias("c"))
    notes = F.transform(of("comment"), lambda x: F.concat(F.lit("Note:\n"), x))
    log = F.array_join(F.concat(F.transform(of("testresult"), lambda x: F.concat(F.lit("Test result: "), x)), of("changelog"), notes), "\n")
    return rows.select(
        "repo", "revision", F.nullif(F.array_join(of("author"), "."), F.lit("")).alias("author"), F.try_to_timestamp(F.replace(F.get(of("date"), F.lit(0)), F.lit("T"), F.lit(" "))).alias("date_utc"),
        log.alias("log"), of("branch").alias("branches"), of("tag").alias("tags"),
    ).withColumn("bad", F.col("author").isNull() | F.col("date_utc").isNull())
