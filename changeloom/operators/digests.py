"""Trees with a digest for each directory, so that two of them are compared from the top.

A directory's digest sums up hashes of all paths below it with what they hold. Sums
need no order: they are partial aggregates, one shuffle for all depths, and a change is
a subtraction and an addition. Stored trees are sorted by directory, so that a descent
opens the directories that differ and skips the rest of the files by their statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.functions.scalars import ancestors_of, parent_of
from changeloom.storage import stored

DIRS = "repo string, parent string, dir string, n long, total decimal(38,0), mixed long"
FILES = "repo string, dir string, path string, hash string"

#: Directories whose names are sent with the scan, so that it skips files; more are joined.
NAMED = 1_000


def directory_digests(tree: DataFrame) -> DataFrame:
    """(repo, parent, dir, depth, n, total, mixed) of a tree (repo, path, hash): for each
    directory, '' for the top, how many paths are below it, and two sums of their hashes,
    128 bits together. Null hashes are equal to each other."""
    what = F.struct("path", F.col("hash").isNull().alias("none"), "hash")
    rows = tree.select("repo", F.explode(F.concat(F.array(F.lit("")), ancestors_of(F.col("path")))).alias("dir"), F.xxhash64(F.lit(1), what).alias("a"), F.xxhash64(F.lit(2), what).alias("b"))
    sums = rows.groupBy("repo", "dir").agg(F.count("*").alias("n"), F.sum(F.col("a").cast("decimal(38,0)")).alias("total"), F.bit_xor("b").alias("mixed"))
    above = F.when(F.col("dir") != "", parent_of(F.col("dir")))
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    return sums.select("repo", above.alias("parent"), "dir", depth.alias("depth"), "n", "total", "mixed")


def store_tree(tree: DataFrame, path: str) -> None:
    """Writes a tree (repo, path, hash) and its directories' digests to the folder ``path``."""
    digests = directory_digests(tree)
    digests.repartitionByRange("depth", "parent", "repo").sortWithinPartitions("depth", "parent", "repo").write.mode("overwrite").partitionBy("depth").parquet(f"{path}/dirs")
    files = tree.select(F.col("repo").cast("string").alias("repo"), parent_of(F.col("path")).alias("dir"), "path", F.col("hash").cast("string").alias("hash"))
    files.repartitionByRange("dir", "repo").sortWithinPartitions("dir", "repo").write.mode("overwrite").parquet(f"{path}/files")


def _below(rows: DataFrame, column: str, opened: DataFrame) -> DataFrame:
    """Rows whose ``column`` is a directory of ``opened`` (repo, dir): its names go to the
    scan while they are few."""
    names = [r[0] for r in opened.select("dir").distinct().limit(NAMED + 1).collect()]
    if len(names) <= NAMED:
        rows = rows.where(F.col(column).isin(names))
    of = opened.select(F.col("repo").alias("_repo"), F.col("dir").alias("_dir"))
    return rows.join(of, rows["repo"].eqNullSafe(of["_repo"]) & (rows[column] == of["_dir"]), "left_semi")


def _compared(a: DataFrame, b: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(repo, key, kind) of rows that only one side has, or whose values differ."""
    left = a.select("repo", key, F.struct(*values).alias("_a"))
    right = b.select(F.col("repo").alias("_repo"), F.col(key).alias("_key"), F.struct(*values).alias("_b"))
    both = left.join(right, left["repo"].eqNullSafe(right["_repo"]) & (left[key] == right["_key"]), "full_outer")
    kind: Column = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    out = both.select(F.when(F.col("_a").isNull(), F.col("_repo")).otherwise(F.col("repo")).alias("repo"), F.coalesce(key, "_key").alias(key), kind.alias("kind"))
    return out.where("kind IS NOT NULL")


def differing_directories(spark: SparkSession, source: str, target: str) -> DataFrame:
    """(repo, dir) of two stored trees: directories whose digests differ, level by level,
    each level looked for below the ones found before. Those that one side lacks count."""
    read = lambda path: spark.read.schema(DIRS + ", depth int").parquet(f"{path}/dirs")
    a, b, depth, opened, found = read(source), read(target), 0, None, None
    while True:
        here, there = a.where(F.col("depth") == depth), b.where(F.col("depth") == depth)
        if opened is not None:
            here, there = _below(here, "parent", opened), _below(there, "parent", opened)
        opened = stored(_compared(here, there, "dir", ["n", "total", "mixed"]).select("repo", "dir"), "opened")
        if not opened.head(1):
            return found if found is not None else opened
        found, depth = (opened if found is None else found.union(opened)), depth + 1


def verify_stored_trees(spark: SparkSession, source: str, target: str) -> DataFrame:
    """(repo, path, kind) where two stored trees differ: missing, extra or changed. Only
    files of directories that differ are read."""
    opened = stored(differing_directories(spark, source, target), "opened")
    files = lambda path: _below(spark.read.schema(FILES).parquet(f"{path}/files"), "dir", opened)
    return _compared(files(source), files(target), "path", ["hash"])
