"""Sources that describe trees: entry files of checkouts, manifests, delta lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.functions.scalars import parse_date
from changeloom.operators.entries import snapshot_diff
from changeloom.schema import ADD, DEL, REN, UPD

MERGED = "Result of merge"


def read_manifest(spark: SparkSession, root: str, repo: str, now: str = "1970-01-01 00:00:00") -> DataFrame:
    """The manifest of a checkout, from all entry files below ``root``."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "Entries").text(root)
    path = F.regexp_replace(F.col("_metadata.file_path"), r"^file:/+", "/")
    directory = F.regexp_extract(path, rf"\Q{root.rstrip('/').removeprefix('file://')}\E/?(.*?)/?CVS/Entries$", 1)
    return parse_manifest(lines.select(F.lit(repo).alias("repo"), directory.alias("dir"), F.col("value").alias("line")), now)


def parse_manifest(lines: DataFrame, now: str = "1970-01-01 00:00:00") -> DataFrame:
    """(repo, path, rev, ts, tag) of entry lines (repo, dir, line); directories' own
    lines are left out. A merge's result has the time that follows it, or ``now``."""
    f = F.split("line", "/")
    stamp, at = F.col("f")[3], F.regexp_replace(F.col("f")[3], rf"^{MERGED}\+?", "")
    time = F.when(stamp == MERGED, F.lit(now).cast("timestamp")).otherwise(parse_date("short", at))
    rows = lines.withColumn("f", f).where((F.col("f")[0] == "") & (F.size("f") >= 6))
    name = F.when(F.col("dir") == "", F.col("f")[1]).otherwise(F.concat("dir", F.lit("/"), F.col("f")[1]))
    return rows.select("repo", name.alias("path"), F.col("f")[2].alias("rev"), time.alias("ts"), F.nullif(F.regexp_replace(F.col("f")[5], "^T", ""), F.lit("")).alias("tag"))


def ingest_snapshot_history(manifests: DataFrame, parents: DataFrame, copies: DataFrame, tag_file: str = ".hgtags") -> tuple[DataFrame, DataFrame]:
    """Histories given as whole trees (repo, seq, path, rev), each with the seq of its
    first parent (repo, seq, parent) and copies (repo, seq, path, source), as entries
    and (repo, seq, tag_only): the tag file is no entry, and a changeset of nothing
    else only tags."""
    before = parents.join(manifests.select("repo", F.col("seq").alias("parent"), "path", "rev"), ["repo", "parent"]).select("repo", "seq", "path", "rev")
    diff = snapshot_diff(before, manifests.select("repo", "seq", "path", "rev"), copies)
    seen = diff.groupBy("repo", "seq").agg(F.bool_and(F.col("name") == tag_file).alias("tag_only"))
    return diff.where(F.col("name") != tag_file), seen


def ingest_delta_lists(df: DataFrame) -> DataFrame:
    """Revisions (repo, revision, renamed, added, removed, modified) as entries in the
    order of those lists; renamed holds structs (old_name, name, is_directory), the
    others (name, is_directory)."""

    def rows(column: str, action: str):
        old = (lambda x: x["old_name"]) if action == REN else (lambda x: F.lit(None).cast("string"))
        return F.transform(column, lambda x: F.struct(F.lit(action).alias("action"), x["name"].alias("name"), old(x).alias("old_name"), x["is_directory"].alias("is_directory")))

    lists = [rows(c, a) for c, a in (("renamed", REN), ("added", ADD), ("removed", DEL), ("modified", UPD))]
    return df.select("repo", "revision", F.posexplode(F.concat(*lists)).alias("pos", "e")).select("repo", "revision", "pos", "e.*")
