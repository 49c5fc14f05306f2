"""Fitting a history to a destination: commit records, hooks, tags, sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.functions.scalars import safe_tag


def render_commits(changesets: DataFrame, style: str = "full", name: str = "name") -> DataFrame:
    """With message: name and log, and what the destination cannot hold as trailers.
    full: none; date: the date; plain: author and date."""
    date = F.concat(F.lit("Date: "), F.date_format("date_utc", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))
    author = F.concat(F.lit("Original author: "), F.col("author"))
    trailers = {"full": [], "date": [date], "plain": [author, date]}[style]
    parts = [F.nullif(F.col(name), F.lit("")) if name in changesets.columns else F.lit(None).cast("string"), F.nullif(F.col("log"), F.lit("")), *trailers]
    return changesets.withColumn("message", F.concat_ws("\n", F.array_compact(F.array(*parts))))


def commit_date(style: str, date: Column, offset_min: Column | None = None) -> Column:
    """The date as a destination writes it: iso, zone, slash or epoch."""
    offset = F.coalesce(offset_min, F.lit(0)) if offset_min is not None else F.lit(0)
    local = F.timestamp_seconds(F.unix_seconds(date.cast("timestamp")) + offset * 60)
    sign = F.when(offset < 0, "-").otherwise("+")
    zone = F.concat(sign, F.lpad(F.floor(F.abs(offset) / 60).cast("string"), 2, "0"), F.lpad((F.abs(offset) % 60).cast("string"), 2, "0"))
    if style == "iso":
        return F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss")
    if style == "zone":
        return F.concat(F.date_format(local, "yyyy-MM-dd HH:mm:ss"), F.lit(" "), zone)
    if style == "slash":
        return F.concat(F.date_format(date, "yyyy/MM/dd HH:mm:ss"), F.lit(" UTC"))
    if style == "epoch":
        return F.concat(F.unix_seconds(date.cast("timestamp")).cast("string"), F.lit(" "), (-offset * 60).cast("string"))
    raise ValueError(f"no style of date: {style}")


def render_commit_meta(changesets: DataFrame, style: str) -> DataFrame:
    """With commit_date and commit_author; line ends in authors become blanks."""
    offset = F.col("tz_offset_min") if "tz_offset_min" in changesets.columns else None
    return changesets.withColumns({"commit_date": commit_date(style, F.col("date_utc"), offset), "commit_author": F.regexp_replace("author", r"\s*\n\s*", " ")})


def write_tags(changesets: DataFrame, style: str) -> DataFrame:
    """(repo, seq, tag, target_tag, date_utc, author): one row for each tag."""
    rows = changesets.select("repo", "seq", F.explode("tags").alias("tag"), "date_utc", "author")
    return rows.select("repo", "seq", "tag", safe_tag(style, F.col("tag")).alias("target_tag"), "date_utc", "author")


def render_mark_empty(changesets: DataFrame, entries: DataFrame, text: str = "(no files changed)") -> DataFrame:
    """Changesets without entries and tags say so at the end of their log."""
    filled = entries.select("repo", "seq", F.lit(True).alias("_filled")).distinct()
    out = changesets.join(filled, ["repo", "seq"], "left")
    bare = F.col("_filled").isNull() & (F.coalesce(F.size("tags"), F.lit(0)) <= 0 if "tags" in changesets.columns else F.lit(True))
    return out.withColumn("log", F.when(bare, F.concat_ws("\n", F.nullif(F.col("log"), F.lit("")), F.lit(text))).otherwise(F.col("log"))).drop("_filled")


def write_history(changesets: DataFrame, entries: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Changesets and entries below ``path``, by repo and in order."""
    changesets.sortWithinPartitions("repo", "seq").write.mode(mode).partitionBy("repo").parquet(f"{path}/changesets")
    entries.sortWithinPartitions("repo", "seq", "pos").write.mode(mode).partitionBy("repo").parquet(f"{path}/entries")


def before_hooks(df: DataFrame, hooks: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """A chain of functions from changesets to changesets; what one leaves out is dropped."""
    for hook in hooks:
        df = df.transform(hook)
    return df


def after_hooks(df: DataFrame, hooks: Sequence[Callable[[DataFrame], None]]) -> DataFrame:
    """Functions called with what was committed."""
    for hook in hooks:
        hook(df)
    return df


def content_hook(files: DataFrame, change: Callable[[Column], Column], actions: Sequence[str] = ("ADD", "UPD")) -> DataFrame:
    """Contents (repo, seq, name, action, content) changed for added and updated files."""
    return files.withColumn("content", F.when(F.col("action").isin(*actions), change(F.col("content"))).otherwise(F.col("content")))


def unix_newlines(content: Column) -> Column:
    return F.replace(content, F.lit("\r\n"), F.lit("\n"))


def gate(changesets: DataFrame, accepted: Column) -> DataFrame:
    """Changesets before the first of their repo that is not accepted."""
    stop = changesets.where(~F.coalesce(accepted, F.lit(False))).groupBy("repo").agg(F.min("seq").alias("_stop"))
    return changesets.join(stop, "repo", "left").where("_stop IS NULL OR seq < _stop").drop("_stop")


def skip(changesets: DataFrame, replayable: Column) -> DataFrame:
    """With replayed: rejected changesets count as applied but are not replayed."""
    return changesets.withColumn("replayed", F.coalesce(replayable, F.lit(False)))
