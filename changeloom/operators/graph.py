"""Operators on the graph of revisions: ``edges`` (repo, child, parent).

Work goes block by block: revisions of about the same depth are a block, or whole trees
where no revision has several parents, small enough for one task, in which a whole stretch of the graph is walked at once; what crosses from
block to block is joined. So rounds follow the number of blocks that a path goes
through, not merges, forks or depth. Null repos are a repo; edges without a child or a
parent are none.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changeloom.operators.cells import running, with_previous
from changeloom.operators.joins import null_safe
from changeloom.storage import shared_dir, stored

#: Revisions of a block.
BLOCK = 100_000


class CycleError(ValueError):
    """Revisions that come before themselves, and what stands on them."""


def _numbered(edges: DataFrame, nodes: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(id, repo, revision) and edges (c, p) by ids, both stored."""
    whole = edges.where("child IS NOT NULL AND parent IS NOT NULL")
    every = whole.select("repo", F.col("child").alias("revision")).union(whole.select("repo", "parent"))
    every = (every.union(nodes.select("repo", "revision")) if nodes is not None else every).distinct()
    numbered = stored(every.select(F.monotonically_increasing_id().alias("id"), "repo", "revision"), "revisions")
    named = numbered.select(F.struct("repo", "revision").alias("_v"), "id")
    ends = whole.select(F.struct("repo", F.col("child").alias("revision")).alias("_v"), F.struct("repo", F.col("parent").alias("revision")).alias("_p"))
    ends = ends.join(named.withColumnRenamed("id", "c"), "_v").select("c", F.col("_p").alias("_v")).join(named.withColumnRenamed("id", "p"), "_v")
    return numbered, stored(ends.select("c", "p").distinct(), "edges")


def _depths(up: DataFrame, count: int) -> tuple[DataFrame, bool]:
    """(id, at, depth) along single parents (id, up; null at roots), by pointer doubling: at is
    the root. Also whether all roots were found; in a cycle at and depth are what the bounded
    number of rounds gives."""
    state = stored(up.select("id", F.coalesce("up", "id").alias("at"), F.col("up").isNotNull().cast("long").alias("depth")), "depths")
    for _ in range(math.ceil(math.log2(count + 1)) + 1):
        far = state.select(F.col("id").alias("at"), F.col("at").alias("_at"), F.col("depth").alias("_depth"))
        moved = stored(state.join(far, "at").select("id", F.col("_at").alias("at"), (F.col("depth") + F.col("_depth")).alias("depth"), (F.col("_depth") > 0).alias("_moved")), "depths")
        state = moved.drop("_moved")
        if not moved.where("_moved").head(1):
            return state, True
    return state, False


def _trees(numbered: DataFrame, ways: DataFrame) -> tuple[DataFrame, bool, bool]:
    """(id, at, depth), stored, along one parent, of several that which is deepest along any;
    whether there is one with several parents, and whether all roots were found."""
    count = numbered.count()
    parents = ways.groupBy(F.col("c").alias("id")).agg(F.max("p").alias("up"), F.count("*").alias("n"))
    trees, whole = _depths(numbered.select("id").join(parents.drop("n"), "id", "left"), count)
    merged = bool(parents.where("n > 1").head(1))
    if merged:
        deep = ways.join(trees.select(F.col("id").alias("p"), "depth"), "p").groupBy(F.col("c").alias("id")).agg(F.max_by("p", F.struct("depth", "p")).alias("up"))
        trees, whole = _depths(numbered.select("id").join(deep, "id", "left"), count)
    return trees, merged, whole


def _blocks(numbered: DataFrame, trees: DataFrame, merged: bool, block: int) -> DataFrame:
    """(id, block), stored: revisions of neighbouring depths of a repo or, where no revision
    has several parents, whole trees, and of those of more than a block neighbouring depths."""
    # A depth of more than a block is parted by hash, so that no block is much larger.
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / block))
    sized = lambda rows, keys: running(rows.groupBy(*keys, "depth").agg(F.count("*").alias("n")).withColumn("_n", F.col("n")), "depth", "_n", "upto", keys)
    stretch = F.floor((F.col("upto") - F.col("n")) / block)
    if merged:
        place = trees.join(numbered.select("id", "repo"), "id")
        return stored(null_safe(place, sized(place, ["repo"]), ["repo", "depth"]).select("id", F.xxhash64("repo", stretch, part).alias("block")), "blocks")
    parts = math.ceil((trees.count() + 1) / block)
    large = stored(trees.groupBy("at").agg(F.count("*").alias("_size")).where(F.col("_size") > block), "large")  # one for each block at most
    marked = trees.join(F.broadcast(large), "at", "left")
    rows = marked.where("_size IS NULL").select("id", F.pmod(F.xxhash64("at"), F.lit(parts)).alias("block"))
    if large.head(1):
        place = marked.where("_size IS NOT NULL")
        rows = rows.union(null_safe(place, sized(place, ["at"]), ["at", "depth"]).select("id", F.xxhash64("at", stretch, part).alias("block")))
    return stored(rows, "blocks")


def reachable(edges: DataFrame, roots: DataFrame, direction: str = "ancestors", block: int = BLOCK) -> DataFrame:
    """(repo, revision) that can be reached from ``roots`` (repo, revision), which
    are left out unless they can be reached themselves, as in a cycle.

    A round walks as far as it gets within each block, and its finds are added to a table.
    """
    spark = edges.sparkSession
    numbered, ways = _numbered(edges, None)
    a, b = ("c", "p") if direction == "ancestors" else ("p", "c")
    trees, merged, _ = _trees(numbered, ways)
    blocks = _blocks(numbered, trees, merged, block)
    ways = stored(ways.select(F.col(a).alias("id"), F.col(b).alias("to")).join(blocks, "id"), "ways")
    # Ways that lead out of their block, where walking goes on.
    out = stored(ways.join(blocks.select(F.col("id").alias("to"), F.col("block").alias("_block")), "to").where("block <> _block").select(F.col("to").alias("id"), F.col("_block").alias("block")).distinct(), "out")
    path = f"{shared_dir(spark)}/reached-{uuid.uuid4().hex}"
    front = null_safe(numbered, roots.select("repo", "revision").distinct(), ["repo", "revision"], "left_semi").select("id").join(blocks, "id")
    found = None

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        """All that the block's part of the front gets to, whether in the block or just outside."""
        after = defaultdict(list)
        for v, to in rows.loc[rows["to"].notna(), ["id", "to"]].astype("int64").itertuples(index=False):
            after[v].append(to)
        todo, seen = rows.loc[rows["to"].isna(), "id"].tolist(), set()
        while todo:
            fresh = [w for w in after.pop(todo.pop(), ()) if w not in seen]
            seen.update(fresh)
            todo += fresh
        return pd.DataFrame({"id": sorted(seen)}, dtype="int64")

    while True:
        front = stored(front, "front")
        if not front.head(1):
            break
        here = ways.join(front.select("block").distinct(), "block", "left_semi").select("block", "id", "to").union(front.select("block", "id", F.lit(None).cast("long")))
        got = here.groupBy("block").applyInPandas(walk, "id long").distinct()
        if found is not None:
            got = got.join(found, "id", "left_anti")
        got = stored(got, "got")
        got.write.mode("append").parquet(path)
        found = spark.read.schema("id long").parquet(path)
        front = out.join(got, "id", "left_semi").select("id", "block")
    if found is None:
        return numbered.where("false").select("repo", "revision")
    return numbered.join(found, "id", "left_semi").select("repo", "revision")


def topo_order(edges: DataFrame, nodes: DataFrame | None = None, cycles: str = "error", block: int = BLOCK) -> DataFrame:
    """(repo, revision, level, seq): ancestors before descendants; level is the length
    of the longest path to a root, and ids decide within a level.

    In a round each block settles whatever has no unsettled parents, one after the
    other; only what is left goes on. What is left when nothing settles is in a cycle
    or stands on one: a CycleError, or with ``cycles="flag"`` rows of null level and seq.
    """
    if cycles not in ("error", "flag"):
        raise ValueError("cycles are an error or flagged")
    spark = edges.sparkSession
    numbered, ways = _numbered(edges, nodes)
    trees, merged, whole = _trees(numbered, ways)
    if whole and not merged:  # of single parents depths are levels, and there is no cycle
        return _placed(numbered.join(trees.select("id", F.col("depth").alias("level")), "id"))
    left = _blocks(numbered, trees, merged, block)
    open_ = stored(ways.select(F.col("c").alias("id"), "p", F.lit(None).cast("long").alias("level")).join(left, "id"), "open")
    path = f"{shared_dir(spark)}/levels-{uuid.uuid4().hex}"

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        """kind 0: unsettled revisions; 1: the level that settled parents ask for; 2: unsettled parents."""
        ids = rows.loc[rows["kind"] == 0, "id"].tolist()
        level, waits, after = dict.fromkeys(ids, 0), dict.fromkeys(ids, 0), defaultdict(list)
        for v, at in rows.loc[rows["kind"] == 1, ["id", "level"]].astype("int64").itertuples(index=False):
            level[v] = at
        for v, p in rows.loc[rows["kind"] == 2, ["id", "p"]].astype("int64").itertuples(index=False):
            waits[v] += 1
            after[p].append(v)  # if p is of another block, v waits for another round
        ready, done = deque(v for v in ids if not waits[v]), []
        while ready:
            v = ready.popleft()
            done.append(v)
            for w in after.get(v, ()):
                level[w] = max(level[w], level[v] + 1)
                waits[w] -= 1
                if not waits[w]:
                    ready.append(w)
        return pd.DataFrame({"id": done, "level": [level[v] for v in done]}, dtype="int64")

    settled = False
    none = F.lit(None).cast("long")
    while left.head(1):
        known = open_.where("level IS NOT NULL").groupBy("block", "id").agg((F.max("level") + 1).alias("level"))
        rows = left.select("block", "id", none.alias("p"), none.alias("level"), F.lit(0).alias("kind"))
        rows = rows.union(known.select("block", "id", none, "level", F.lit(1))).union(open_.where("level IS NULL").select("block", "id", "p", "level", F.lit(2)))
        done = stored(rows.groupBy("block").applyInPandas(settle, "id long, level long"), "done")
        if not done.head(1):
            break
        settled = True
        done.write.mode("append").parquet(path)
        left = stored(left.join(done, "id", "left_anti"), "left")
        still = open_.join(done, "id", "left_anti").join(done.select(F.col("id").alias("p"), F.col("level").alias("_level")), "p", "left")
        open_ = stored(still.select("id", "p", F.coalesce("level", "_level").alias("level"), "block"), "open")
    stuck = numbered.join(left, "id", "left_semi")
    if cycles == "error" and (some := stuck.orderBy("repo", "revision").head(5)):
        raise CycleError(f"{left.count()} revisions are in cycles or stand on one, such as " + ", ".join(f"{r['revision']} of {r['repo']}" for r in some))
    levels = spark.read.schema("id long, level long").parquet(path) if settled else left.where("false").select("id", none.alias("level"))
    out = _placed(numbered.join(levels, "id"))
    return out.union(stuck.select("repo", "revision", none, none)) if cycles == "flag" else out


def _placed(level: DataFrame) -> DataFrame:
    """(repo, revision, level) with seq, by level and revision."""
    sizes = level.groupBy("repo", "level").agg(F.count("*").alias("n"))
    starts = running(sizes.withColumn("_n", F.col("n")), "level", "_n", "upto")
    placed = level.withColumn("_place", F.row_number().over(Window.partitionBy("repo", "level").orderBy("revision")))
    return null_safe(placed, starts, ["repo", "level"]).select("repo", "revision", "level", (F.col("upto") - F.col("n") + F.col("_place") - 1).alias("seq"))


def linearize(changesets: DataFrame, order: DataFrame, branch: str, first_only: bool = False, start: str | None = None) -> DataFrame:
    """Revisions of one branch in topological order (repo, revision, seq), each with
    lin_parent, the kept one before; the first kept has ``start``."""
    kept = changesets.where(F.array_contains("branches", branch)).drop("seq", "lin_parent")
    kept = null_safe(kept, order.select("repo", "revision", "seq"), ["repo", "revision"])
    out = with_previous(kept, "seq", "revision", "_parent").withColumn("lin_parent", F.coalesce("_parent", F.lit(start))).drop("_parent")
    if first_only:
        first = kept.groupBy("repo").agg(F.min("seq").alias("seq"))
        out = null_safe(out, first, ["repo", "seq"], "left_semi").withColumn("lin_parent", F.lit(start).cast("string"))
    return out


def graft_branch(changesets: DataFrame, branchpoint: str, parents: DataFrame | None = None) -> DataFrame:
    """With lin_parent of an imported branch: its first changeset stands on
    ``branchpoint``, each later one on the one before. With ``parents`` (repo,
    revision), the history that must hold that point, repos without it are left out."""
    if parents is not None:
        changesets = null_safe(changesets, parents.where(F.col("revision") == branchpoint).select("repo").distinct(), ["repo"], "left_semi")
    return with_previous(changesets, "seq", "revision", "_parent").withColumn("lin_parent", F.coalesce("_parent", F.lit(branchpoint))).drop("_parent")
