"""Operators on path actions.

``entries`` has at least repo, seq, pos, action, name and old_name. Columns that an
operator does not speak of stay as they are. Changesets can be of any size and are
joined by (repo, seq, path), never by patterns: to find what lies below a
directory, the ancestors of each path are exploded and compared for equality.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeloom.functions.scalars import ancestors_of, normalized_path, rev_key, rev_text, trimmed_path
from changeloom.schema import ADD, DEL, REN, UPD
from changeloom.storage import stored

KEY = ["repo", "seq"]
#: Parts into which additions of one directory are dealt where all changesets share a tree.
PARTS = 16
REPLACED = "REP"  # deleted and added again, until resolve_copies
#: Why an entry of resolve_copies visits a path: it is its own, its source or above that, or above its own.
HOME, SOURCE, ABOVE = range(3)


def _self_and_above(path: Column) -> Column:
    return F.array_append(ancestors_of(path), path)


def _below(df: DataFrame, column: str, roots: DataFrame, root: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` lies below a path in ``roots`` (repo, seq, root)."""
    marks = df.select(*KEY, F.col(column).alias("_path")).distinct().select(*KEY, "_path", F.explode(ancestors_of(F.col("_path"))).alias(root))
    inside = marks.join(roots.select(*KEY, root).distinct(), [*KEY, root], "left_semi").select(*KEY, F.col("_path").alias(column)).distinct()
    return df.join(inside, [*KEY, column], "left_semi")


# Projections and filters


def scope_to_module(entries: DataFrame, module: str) -> DataFrame:
    """Entries below module/, with that prefix cut; a source from outside becomes null."""
    prefix = module.strip("/") + "/"
    if prefix == "/":
        return entries
    cut = lambda c: F.when(F.startswith(c, F.lit(prefix)), F.substr(c, F.lit(len(prefix) + 1)))
    return entries.where(F.startswith("name", F.lit(prefix))).withColumns({"name": cut(F.col("name")), "old_name": cut(F.col("old_name"))})


def trim_components(entries: DataFrame, n: int = 1) -> DataFrame:
    return entries.withColumns({c: trimmed_path(F.col(c), n) for c in ("name", "old_name")})


def rebase_paths(entries: DataFrame, prefix: str) -> DataFrame:
    """Every path moved below ``prefix``."""
    return entries.withColumns({c: F.concat(F.lit(prefix.strip("/") + "/"), F.col(c)) for c in ("name", "old_name")})


def normalize_paths(entries: DataFrame) -> DataFrame:
    return entries.withColumns({c: normalized_path(F.col(c)) for c in ("name", "old_name")})


#: Directories in which version control systems keep their own state. Fixed values.
METADATA_DIRS = (".svn", "CVS", "_darcs", ".git", ".hg", "_MTN", ".bzr", "{arch}", ".arch-ids", ".cdv", ",,arx")


def drop_metadata_paths(entries: DataFrame, metadirs: Sequence[str] = METADATA_DIRS, state_file: str | None = None) -> DataFrame:
    """Without entries in control directories, and without the state file, its old
    copy, its journal and its log."""
    inside = F.arrays_overlap(F.split("name", "/"), F.array(*map(F.lit, metadirs)))
    own = F.col("name").isin([f"{state_file}{tail}" for tail in ("", ".old", ".journal", ".log")]) if state_file else F.lit(False)
    return entries.where(~inside & ~own)


def apply_ignore_rules(changesets: DataFrame, entries: DataFrame, rules: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Without entries whose name matches a rule, and without changesets that had
    entries and lost them all."""
    if not rules:
        return changesets, entries
    kept = entries.where(~F.rlike("name", F.lit("|".join(f"(?:{r})" for r in rules))))
    emptied = entries.select(*KEY).distinct().join(kept.select(*KEY).distinct(), KEY, "left_anti")
    return changesets.join(emptied, KEY, "left_anti"), kept


def select_kind(entries: DataFrame, kind: str) -> DataFrame:
    return entries.where(F.col("action") == kind)


def files_only(entries: DataFrame) -> DataFrame:
    """Without directories and symbolic links; null counts as neither."""
    return entries.where(~F.coalesce("is_directory", F.lit(False)) & ~F.coalesce("is_symlink", F.lit(False)))


def drop_missing_paths(entries: DataFrame, manifest: DataFrame) -> DataFrame:
    """Without additions and updates of paths that ``manifest`` (repo, path) lacks."""
    there = manifest.select("repo", F.col("path").alias("name"), F.lit(True).alias("_there")).distinct()
    return entries.join(there, ["repo", "name"], "left").where(~F.col("action").isin(ADD, UPD) | F.col("_there")).drop("_there")


def drop_self_rename(entries: DataFrame) -> DataFrame:
    return entries.where(~((F.col("action") == REN) & F.col("name").eqNullSafe(F.col("old_name"))))


def dedupe_touch(entries: DataFrame) -> DataFrame:
    """Without updates of a path that the changeset names in an earlier entry."""
    first = Window.partitionBy(*KEY, "name").orderBy("pos")
    return entries.withColumn("_n", F.row_number().over(first)).where((F.col("action") != UPD) | (F.col("_n") == 1)).drop("_n")


# Copies, renames and replacements of one changeset


def resolve_copies(entries: DataFrame) -> DataFrame:
    """Turns deletions, copies and replacements into renames, and orders entries.

    Entries have action ADD, DEL, UPD or REP (replaced), old_name where the copied
    path is in scope, and copied (boolean) where there is one at all. In the order
    of names, a deletion makes the copy of its path a rename and vanishes; without
    such a copy it makes the copies from below it renames and goes to the end. A
    replacement does the same and goes to the end as a rename or an addition,
    unless it was made a rename before its turn. Anything else below a copied path
    becomes an addition in its turn. Of several copies of a path the last counts.
    """
    # All steps go by changeset, so that rows are dealt once and only sorted anew: an entry visits
    # the paths that may make it a rename, and those above its own, and takes home what stands there.
    e = entries.withColumn("_copied", F.coalesce("copied", F.lit(False)))
    free, source = F.col("action").isin(DEL, REPLACED), F.col("action").isin(ADD, REPLACED) & F.col("old_name").isNotNull()
    by = lambda *more: Window.partitionBy(*KEY, *more)
    # Of the paths above a name only those as long as some freed or copied path can be one.
    sizes = {"_freed": F.collect_set(F.when(free, F.length("name"))).over(by()), "_roots": F.collect_set(F.when(F.col("_copied"), F.length("name"))).over(by())}
    e = e.withColumns(sizes).withColumn("_mover", source & (F.col("name") == F.max(F.when(source, F.col("name"))).over(by("old_name"))))
    as_long = lambda paths, sizes: F.filter(paths, lambda p: F.array_contains(sizes, F.length(p)))
    visits = lambda paths, kind: F.coalesce(F.transform(paths, lambda p: F.struct(p.alias("at"), F.lit(kind).alias("kind"))), F.array().cast("array<struct<at:string,kind:int>>"))
    sources = F.when(F.col("_mover"), as_long(_self_and_above(F.col("old_name")), F.col("_freed")))
    above = F.when(F.size("_roots") > 0, as_long(ancestors_of(F.col("name")), F.col("_roots")))
    v = e.withColumn("_v", F.explode(F.concat(visits(F.array("name"), HOME), visits(sources, SOURCE), visits(above, ABOVE)))).drop("_freed", "_roots")
    home, seeks, at = F.col("_v.kind") == HOME, F.col("_v.kind") == SOURCE, F.col("_v.at")
    v = v.withColumns({
        "_del": F.max(home & (F.col("action") == DEL)).over(by(at)), "_rep": F.max(home & (F.col("action") == REPLACED)).over(by(at)),
        "_gone": F.max(seeks & (at == F.col("old_name"))).over(by(at)), "_root": F.max(home & F.col("_copied")).over(by(at)),
    })
    hit = seeks & ((at == F.col("old_name")) | ~F.col("_gone"))
    v = v.withColumns({"_was": F.lit(None).cast("boolean")})
    if entries.where((F.col("action") == REPLACED) & F.col("old_name").isNotNull()).select(F.lit(1)).head(1):
        # A replacement that was credited before its own turn frees nothing: settled in order of names.
        v = stored(v.drop("_was"), "visits")
        links = v.where(hit & (F.col("action") == REPLACED) & (at < F.col("name"))).select(*KEY, F.col("name").alias("mover"), at.alias("freed"), "_del", "_rep")
        off = links.where("_del").select(*KEY, F.col("mover").alias("freed")).distinct()
        chain = links.where("_rep")
        if chain.head(1):
            off = _settle(off, chain)
        v = v.withColumn("freed", at).join(off.withColumn("_was", F.lit(True)), [*KEY, "freed"], "left").drop("freed")
    credit = F.when(hit & (F.col("_del") | (F.col("_rep") & F.col("_was").isNull())), at)
    out = v.withColumns({"_credit": F.max(credit).over(by("name")), "_inside": F.max((F.col("_v.kind") == ABOVE) & F.col("_root")).over(by("name"))}).where(home)
    is_mover = F.col("action").isin(ADD, REPLACED) & F.col("_credit").isNotNull()
    own_turn = F.when(F.col("_inside") & F.coalesce(F.col("_credit") < F.col("name"), F.lit(True)), ADD)
    action = (
        F.when(F.col("action") == DEL, DEL)
        .when((F.col("action") == REPLACED) & F.col("_was").isNull(), F.when(F.col("old_name").isNotNull(), REN).otherwise(ADD))
        .otherwise(F.coalesce(own_turn, F.when(is_mover, REN), F.when(F.col("action") == REPLACED, REN), F.col("action")))
    )
    tail = (F.col("action") == DEL) | ((F.col("action") == REPLACED) & F.col("_was").isNull())
    out = out.where((F.col("action") != DEL) | ~F.col("_gone")).withColumns({"_tail": tail, "action": action})
    out = out.withColumn("pos", (F.row_number().over(Window.partitionBy(*KEY).orderBy("_tail", "name", "pos")) - 1).cast("int"))
    return out.select(*[c for c in entries.columns if c != "copied"])


def _settle(off: DataFrame, chain: DataFrame) -> DataFrame:
    """Replacements that free nothing, when replacements credit each other. Each
    round decides those whose crediting replacements are all decided."""
    nodes = chain.select(*KEY, F.col("freed").alias("r")).union(chain.select(*KEY, "mover")).distinct()
    state = nodes.join(off.select(*KEY, F.col("freed").alias("r"), F.lit(True).alias("off")), [*KEY, "r"], "left")
    before, state = -1, stored(state, "settled")
    while True:
        judged = chain.join(state.select(*KEY, F.col("r").alias("freed"), "off"), [*KEY, "freed"])
        verdict = judged.groupBy(*KEY, F.col("mover").alias("r")).agg(
            F.max(F.expr("off IS NOT NULL AND NOT off")).alias("credited"), F.max(F.expr("off IS NULL")).alias("open"),
        )
        state = state.join(verdict, [*KEY, "r"], "left").select(
            *KEY, "r", F.expr("CASE WHEN off IS NOT NULL THEN off WHEN credited THEN true WHEN open THEN NULL ELSE false END").alias("off"),
        )
        state = stored(state, "settled")
        left = state.where("off IS NULL").count()
        if left in (0, before):
            return off.union(state.where("off").select(*KEY, F.col("r"))).distinct()
        before = left


def detect_renames(entries: DataFrame, of_equal: str = "last") -> DataFrame:
    """A deletion and one addition with its path as old_name become one rename: that of
    the greatest name, and of several of that name the last or the first by pos (``of_equal``)."""
    gone = entries.where(F.col("action") == DEL).select(*KEY, F.col("name").alias("old_name"), F.lit(True).alias("_gone")).distinct()
    last = Window.partitionBy(*KEY, "old_name", "action").orderBy(F.desc("name"), F.desc("pos") if of_equal == "last" else F.asc("pos"))
    out = entries.join(gone, [*KEY, "old_name"], "left").withColumn("_ren", F.expr(f"action = '{ADD}' AND _gone") & (F.row_number().over(last) == 1))
    used = out.where("_ren").select(*KEY, F.col("old_name").alias("name")).distinct()
    deleted = entries.where(F.col("action") == DEL).join(used, [*KEY, "name"], "left_semi").select(*KEY, "pos", F.lit(True).alias("_used"))
    out = out.join(deleted, [*KEY, "pos"], "left").where("_used IS NULL")
    return out.withColumn("action", F.when(F.col("_ren"), REN).otherwise(F.col("action"))).select(*entries.columns)


def renames_from_dir(entries: DataFrame) -> DataFrame:
    """Additions copied from below a directory that the changeset deletes are renames."""
    gone = entries.where(F.col("action") == DEL).select(*KEY, F.col("name").alias("_root"))
    moved = _below(entries.where((F.col("action") == ADD) & F.col("old_name").isNotNull()), "old_name", gone, "_root").select(*KEY, "pos", F.lit(True).alias("_ren"))
    return entries.join(moved, [*KEY, "pos"], "left").withColumn("action", F.when(F.col("_ren"), REN).otherwise(F.col("action"))).select(*entries.columns)


def adds_below_copy(entries: DataFrame) -> DataFrame:
    """Entries below a copied path are additions, unless they delete."""
    roots = entries.where((F.col("action") == ADD) & F.col("old_name").isNotNull()).select(*KEY, F.col("name").alias("_root"))
    inside = _below(entries.where(F.col("action") != DEL), "name", roots, "_root").select(*KEY, "pos", F.lit(True).alias("_in"))
    return entries.join(inside, [*KEY, "pos"], "left").withColumn("action", F.when(F.col("_in"), ADD).otherwise(F.col("action"))).select(*entries.columns)


def resolve_replaced(entries: DataFrame) -> DataFrame:
    """Replaced entries are renames where they have a source, else additions, and come last."""
    late = F.col("action") == REPLACED
    out = entries.withColumns({"_late": late, "action": F.when(late & F.col("old_name").isNotNull(), REN).when(late, ADD).otherwise(F.col("action"))})
    return out.withColumn("pos", (F.row_number().over(Window.partitionBy(*KEY).orderBy("_late", "pos")) - 1).cast("int")).drop("_late")


def renames_by_branch_note(entries: DataFrame, notes: DataFrame) -> DataFrame:
    """Additions noted (repo, seq, name, origin) as branched from a path that the
    same changeset deletes are renames, and that deletion goes. Of several additions
    of one name the first by pos is the rename."""
    noted = entries.join(notes.select(*KEY, "name", "origin").distinct(), [*KEY, "name"], "left")
    with_source = noted.withColumn("old_name", F.when(F.col("action") == ADD, F.coalesce("origin", "old_name")).otherwise(F.col("old_name"))).select(*entries.columns)
    found = detect_renames(with_source, of_equal="first")
    return found.withColumn("old_name", F.when(F.col("action") == REN, F.col("old_name")))


def snapshot_diff(before: DataFrame, after: DataFrame, copies: DataFrame, keys: Sequence[str] = ("repo", "seq")) -> DataFrame:
    """Entries that lead from tree to tree (keys, path, rev): changed in both UPD,
    only after ADD or, with a source in ``copies`` (keys, path, source) that is
    gone, REN, only before DEL unless a rename took it. A source goes to the first
    of its copies, and a path comes from the first of its sources."""
    keys = list(keys)
    both = before.select(*keys, "path", F.col("rev").alias("old_rev")).join(after.select(*keys, "path", F.col("rev").alias("new_rev")), [*keys, "path"], "full_outer")
    gone = both.where("new_rev IS NULL").select(*keys, F.col("path").alias("source"))
    first = copies.join(gone, [*keys, "source"], "left_semi").groupBy(*keys, "source").agg(F.min("path").alias("path")).groupBy(*keys, "path").agg(F.min("source").alias("source"))
    renames = both.where("old_rev IS NULL").select(*keys, "path").join(first, [*keys, "path"])
    taken = renames.select(*keys, F.col("source").alias("path"), F.lit(True).alias("_taken"))
    out = both.join(renames, [*keys, "path"], "left").join(taken, [*keys, "path"], "left")
    action = F.when(F.col("old_rev").isNull(), F.when(F.col("source").isNotNull(), REN).otherwise(ADD)).when(F.col("new_rev").isNull(), DEL).when(F.col("old_rev") != F.col("new_rev"), UPD)
    out = out.withColumn("action", action).where("action IS NOT NULL").where(~((F.col("action") == DEL) & F.col("_taken").isNotNull()))
    return out.select(*keys, "action", F.col("path").alias("name"), F.col("source").alias("old_name"), "old_rev", "new_rev")


def align_with_tree(entries: DataFrame, tree: DataFrame) -> DataFrame:
    """Entries made to fit ``tree`` (repo, path), the state before them: no
    directories, links or deletions of unknown paths; nothing but the rename on a
    rename's target; renames of unknown paths are additions; additions of known
    paths are updates and updates of unknown ones additions."""
    e = files_only(entries)
    known = tree.select("repo", F.col("path").alias("name"), F.lit(True).alias("_known")).distinct()
    source = tree.select("repo", F.col("path").alias("old_name"), F.lit(True).alias("_source")).distinct()
    e = e.join(known, ["repo", "name"], "left").where((F.col("action") != DEL) | F.col("_known"))
    targets = e.where(F.col("action") == REN).select(*KEY, "name", F.lit(True).alias("_target")).distinct()
    e = e.join(targets, [*KEY, "name"], "left").join(source, ["repo", "old_name"], "left").where((F.col("action") == REN) | F.col("_target").isNull())
    renamed = F.when((F.col("action") == REN) & F.col("_source").isNull(), ADD).otherwise(F.col("action"))
    e = e.withColumns({"action": renamed, "old_name": F.when((F.col("action") == REN) & F.col("_source").isNull(), F.lit(None)).otherwise(F.col("old_name"))})
    action = F.when((F.col("action") == ADD) & F.col("_known"), UPD).when((F.col("action") == UPD) & F.col("_known").isNull(), ADD).otherwise(F.col("action"))
    return e.withColumn("action", action).select(*entries.columns)


def skip_current(entries: DataFrame, manifest: DataFrame) -> DataFrame:
    """Without updates to the revision that ``manifest`` (repo, path, rev) already
    has, and without deletions of what it has not."""
    there = manifest.select("repo", F.col("path").alias("name"), F.col("rev").alias("_rev"), F.lit(True).alias("_there"))
    out = entries.join(there, ["repo", "name"], "left")
    done = ((F.col("action") == UPD) & F.col("_rev").eqNullSafe(F.col("new_rev"))) | ((F.col("action") == DEL) & F.col("_there").isNull())
    return out.where(~done).select(*entries.columns)


def rebase_old_names(entries: DataFrame) -> DataFrame:
    """old_name of renames as it is after the changeset's earlier renames of its
    nearest ancestor directory."""
    moves = entries.where(F.col("action") == REN).select(*KEY, F.col("pos").alias("_at"), F.col("old_name").alias("_dir"), F.col("name").alias("_to"))
    above = entries.where(F.col("action") == REN).select(*KEY, "pos", "old_name", F.explode(ancestors_of(F.col("old_name"))).alias("_dir"))
    hit = above.join(moves, [*KEY, "_dir"]).where("_at < pos").groupBy(*KEY, "pos", "old_name").agg(F.max_by(F.struct("_dir", "_to"), F.struct(F.length("_dir"), "_at")).alias("m"))
    hit = hit.select(*KEY, "pos", F.concat(F.col("m._to"), F.substr("old_name", F.length("m._dir") + 1)).alias("_new"))
    return entries.join(hit, [*KEY, "pos"], "left").withColumn("old_name", F.coalesce("_new", "old_name")).select(*entries.columns)


def expand_added_dir(entries: DataFrame, tree: DataFrame) -> DataFrame:
    """With an addition of every path of ``tree`` (repo, seq, path), the state after,
    that lies below an added directory and that the changeset does not name. A tree
    without seq is the state after each of the repo's changesets; only what lies below
    added directories is then laid out by changeset."""
    dirs = entries.where(F.expr(f"action = '{ADD}' AND is_directory")).select(*KEY, F.col("name").alias("_root"), F.col("pos").alias("_at"))
    held = KEY if "seq" in tree.columns else KEY[:1]
    paths = tree.select(*held, "path", F.explode(ancestors_of(F.col("path"))).alias("_root"))
    if held != KEY:  # directories added often are dealt to several tasks, their paths copied to each
        dirs = dirs.withColumn("_part", F.pmod(F.xxhash64(*KEY), F.lit(PARTS)).cast("int"))
        paths, held = paths.distinct().withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), [*held, "_part"]
    paths = paths.join(dirs, [*held, "_root"])
    paths = paths.groupBy(*KEY, F.col("path").alias("name")).agg(F.max("_at").alias("pos")).join(entries.select(*KEY, "name").distinct(), [*KEY, "name"], "left_anti")
    return entries.unionByName(paths.withColumn("action", F.lit(ADD)), allowMissingColumns=True)


def rewrite_inverted(entries: DataFrame) -> DataFrame:
    """In inverted patches (column inverted), paths below an earlier move's old
    name, or that name itself, as they are after the move."""
    moves = entries.where(F.col("inverted") & (F.col("action") == REN)).select(*KEY, F.col("pos").alias("_at"), F.col("old_name").alias("_dir"), F.col("name").alias("_to"))
    above = entries.where("inverted").select(*KEY, "pos", "name", F.explode(_self_and_above(F.col("name"))).alias("_dir"))
    hit = above.join(moves, [*KEY, "_dir"]).where("_at < pos").groupBy(*KEY, "pos", "name").agg(F.max_by(F.struct("_dir", "_to"), "_at").alias("m"))
    hit = hit.select(*KEY, "pos", F.concat(F.col("m._to"), F.substr("name", F.length("m._dir") + 1)).alias("_new"))
    return entries.join(hit, [*KEY, "pos"], "left").withColumn("name", F.coalesce("_new", "name")).select(*entries.columns)


def add_unlisted(entries: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """With an addition of each path that is in ``after`` (repo, seq, path), not in
    ``before`` and named by no entry."""
    named = entries.select(*KEY, F.col("name").alias("path")).union(entries.select(*KEY, "old_name")).distinct()
    fresh = after.select(*KEY, "path").join(before.select(*KEY, "path"), [*KEY, "path"], "left_anti").join(named, [*KEY, "path"], "left_anti")
    end = entries.groupBy(*KEY).agg((F.max("pos") + 1).alias("_end"))
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy("path")) - 1
    fresh = fresh.join(end, KEY, "left").select(*KEY, (F.coalesce("_end", F.lit(0)) + place).cast("int").alias("pos"), F.lit(ADD).alias("action"), F.col("path").alias("name"))
    return entries.unionByName(fresh, allowMissingColumns=True)


# Windows over the entries of a changeset


def action_runs(entries: DataFrame) -> DataFrame:
    """With run: consecutive entries of one action have one number, from 0."""
    w = Window.partitionBy(*KEY).orderBy("pos")
    new = F.coalesce((F.lag("action").over(w) != F.col("action")).cast("int"), F.lit(0))
    return entries.withColumn("_new", new).withColumn("run", F.sum("_new").over(w).cast("int")).drop("_new")


def first_rename_wins(entries: DataFrame) -> DataFrame:
    """Of several renames of one path only the first stays; others become additions."""
    nth = F.row_number().over(Window.partitionBy(*KEY, "old_name", "action").orderBy("pos"))
    late = (F.col("action") == REN) & (F.col("_nth") > 1)
    out = entries.withColumn("_nth", nth).withColumns({"_late": late}).withColumns({"action": F.when(F.col("_late"), ADD).otherwise(F.col("action")), "old_name": F.when(~F.col("_late"), F.col("old_name"))})
    return out.drop("_nth", "_late")


def order_entries_by_name(entries: DataFrame) -> DataFrame:
    """pos by name, deletions and replacements after all others."""
    tail = F.col("action").isin(DEL, REPLACED)
    return entries.withColumn("pos", (F.row_number().over(Window.partitionBy(*KEY).orderBy(tail, "name", "pos")) - 1).cast("int"))


def rename_before_dir_delete(entries: DataFrame) -> DataFrame:
    """Renames out of a directory stand before that directory's deletion."""
    gone = entries.where(F.col("action") == DEL).select(*KEY, F.col("name").alias("_root"), F.col("pos").alias("_at"))
    moves = entries.where(F.col("action") == REN).select(*KEY, "pos", F.explode(ancestors_of(F.col("old_name"))).alias("_root")).join(gone, [*KEY, "_root"])
    first = moves.groupBy(*KEY, "pos").agg(F.min("_at").alias("_at"))
    at = F.least(F.col("pos").cast("double"), F.col("_at") - 0.5)
    out = entries.join(first, [*KEY, "pos"], "left").withColumn("_order", at)
    return out.withColumn("pos", (F.row_number().over(Window.partitionBy(*KEY).orderBy("_order", "pos")) - 1).cast("int")).select(*entries.columns)


def collapse_replacements(entries: DataFrame) -> DataFrame:
    """The k-th deletion and the k-th addition of one name cancel each other out."""
    nth = F.row_number().over(Window.partitionBy(*KEY, "name", "action").orderBy("pos"))
    per = Window.partitionBy(*KEY, "name")
    pairs = F.least(F.count(F.when(F.col("action") == DEL, 1)).over(per), F.count(F.when(F.col("action") == ADD, 1)).over(per))
    return entries.withColumns({"_nth": nth, "_pairs": pairs}).where(~F.col("action").isin(ADD, DEL) | (F.col("_nth") > F.col("_pairs"))).drop("_nth", "_pairs")


def readd_to_update(entries: DataFrame) -> DataFrame:
    """An addition right after a deletion of the same path: one update, where the deletion was."""
    w = Window.partitionBy(*KEY, "name").orderBy("pos")
    out = entries.withColumns({"_next": F.lead("action").over(w), "_last": F.lag("action").over(w)})
    out = out.where(~((F.col("action") == ADD) & F.coalesce(F.col("_last") == DEL, F.lit(False))))
    return out.withColumn("action", F.when((F.col("action") == DEL) & (F.col("_next") == ADD), UPD).otherwise(F.col("action"))).select(*entries.columns)


def removal_order(entries: DataFrame) -> DataFrame:
    """Deletions with their pos in reverse order of paths: content before its directory."""
    return entries.where(F.col("action") == DEL).withColumn("pos", (F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("name"))) - 1).cast("int"))


# Aggregates over entries


def merge_members(entries: DataFrame) -> DataFrame:
    """Members listed twice as one, from the least old to the greatest new revision.
    INITIAL means an addition, a '(DEAD)' suffix a deletion. Of members of equal
    revisions the first gives the old and the last the new one."""
    dead = F.endswith("new_rev", F.lit("(DEAD)"))
    m = entries.withColumns({"_dead": dead, "new_rev": F.regexp_replace("new_rev", r"\(DEAD\)$", "")})
    first = F.when(F.col("old_rev") == "INITIAL", F.array(F.lit(0))).otherwise(rev_key(F.col("old_rev")))
    out = m.groupBy(*KEY, "name").agg(F.min("pos").alias("pos"), F.min_by("old_rev", F.struct(first, "pos")).alias("old_rev"), F.max_by(F.struct("new_rev", "_dead"), F.struct(rev_key(F.col("new_rev")), "pos")).alias("n"))
    action = F.when(F.col("n._dead"), DEL).when(F.col("old_rev") == "INITIAL", ADD).otherwise(UPD)
    return out.select(*KEY, "pos", action.alias("action"), "name", F.when(F.col("old_rev") != "INITIAL", F.col("old_rev")).alias("old_rev"), F.col("n.new_rev").alias("new_rev"))


def merge_double_delete(entries: DataFrame) -> DataFrame:
    """Deletions of one path as one, of the latest revision, where the first stood."""
    gone = entries.where(F.col("action") == DEL).groupBy(*KEY, "name", "action").agg(F.min("pos").alias("pos"), F.max(rev_key(F.col("new_rev"))).alias("_key"))
    others = entries.where(F.col("action") != DEL)
    return others.unionByName(gone.withColumn("new_rev", rev_text(F.col("_key"))).drop("_key"), allowMissingColumns=True)


def paths_by_revision(entries: DataFrame) -> DataFrame:
    """Names by target revision, in the revisions' order."""
    out = entries.groupBy(*KEY, "new_rev").agg(F.sort_array(F.collect_list("name")).alias("names"))
    return out.withColumn("place", (F.row_number().over(Window.partitionBy(*KEY).orderBy(rev_key(F.col("new_rev")))) - 1).cast("int"))


def commit_paths(entries: DataFrame) -> DataFrame:
    """(repo, seq, paths): additions first, a rename's old path before its new one."""
    paths = F.when(F.col("action") == REN, F.array("old_name", "name")).otherwise(F.array("name"))
    rows = F.sort_array(F.collect_list(F.struct((F.col("action") != ADD).alias("late"), F.col("pos"), paths.alias("paths"))))
    return entries.groupBy(*KEY).agg(F.flatten(F.transform(rows, lambda r: r["paths"])).alias("paths"))
