"""Logs in XML, and the plain preview of patches that goes with one of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.functions.scalars import map_action, parse_date, patch_hash, strip_noise

LOGENTRY = "_revision string, author string, date string, msg string, paths struct<path: array<struct<_VALUE: string, _action: string, `_copyfrom-path`: string, `_copyfrom-rev`: string>>>"


def read_xml_log(spark: SparkSession, paths: str | list[str], module: str = "") -> DataFrame:
    """Path actions of XML log files, read record by record in parallel."""
    rows = spark.read.format("xml").option("rowTag", "logentry").schema(LOGENTRY).load(paths)
    return _log_entries(rows.withColumn("repo", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)), module)


def ingest_xml_log(df: DataFrame, module: str = "") -> DataFrame:
    """The same from (repo, value) rows that hold whole logs or single records."""
    records = df.select("repo", F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<logentry\b.*?</logentry>"), F.lit(0))).alias("r"))
    return _log_entries(records.select("repo", F.from_xml("r", LOGENTRY).alias("x")).select("repo", "x.*"), module)


def _log_entries(rows: DataFrame, module: str) -> DataFrame:
    """repo, revision, author, date_utc, log, pos, action, name, old_name, copied;
    REP is a replaced path, names are in ``module`` and without it."""
    prefix = "/" + module.strip("/") + "/" if module.strip("/") else "/"
    cut = lambda c: F.when(F.startswith(c, F.lit(prefix)), F.substr(c, F.lit(len(prefix) + 1)))
    out = rows.select("repo", F.col("_revision").alias("revision"), "author", parse_date("iso", F.col("date")).alias("date_utc"), F.coalesce("msg", F.lit("")).alias("log"), F.posexplode_outer("paths.path").alias("pos", "p"))
    action = F.when(F.col("p._action") == "R", "REP").otherwise(map_action("xml", F.col("p._action")))
    out = out.select("repo", "revision", "author", "date_utc", "log", "pos", action.alias("action"), cut(F.trim("p._VALUE")).alias("name"), cut(F.col("p.`_copyfrom-path`")).alias("old_name"), F.col("p.`_copyfrom-path`").isNotNull().alias("copied"))
    return out.where("name IS NOT NULL")


def _unescaped(text: Column) -> Column:
    for code, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _attribute(text: Column, name: str) -> Column:
    return _unescaped(F.regexp_extract(text, rf"\b{name}=['\"]([^'\"]*)['\"]", 1))


def ingest_patch_xml(df: DataFrame) -> DataFrame:
    """Patches with their entries in order: repo, revision, patch_hash, author,
    date_utc, inverted, log, tag, pos, action, name, old_name, is_directory, conflict.

    Dates are compact or in words. A name or comment 'TAG x' gives tag x.
    """
    records = df.select("repo", F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<patch\b.*?</patch>"), F.lit(0))).alias("r"))
    head = F.regexp_extract("r", r"(?s)^<patch\b([^>]*)>", 1)
    name, comment = (_stripped(_unescaped(F.regexp_extract("r", rf"(?s)<{t}>(.*?)</{t}>", 1))) for t in ("name", "comment"))
    comment = strip_noise(comment)
    date = _attribute(head, "date")
    tag = F.coalesce(F.nullif(F.regexp_extract(name, r"^TAG (.*)$", 1), F.lit("")), F.nullif(F.regexp_extract(comment, r"^TAG (.*)$", 1), F.lit("")))
    actions = F.regexp_extract_all(F.regexp_extract("r", r"(?s)<summary>(.*)</summary>", 1), F.lit(r"(?s)<(?:move|(?:add|remove|modify)_(?:file|directory))\b[^>]*?(?:/>|>.*?(?=<(?:/|move|add_|remove_|modify_)))"), F.lit(0))
    # A patch's own columns before its entries are exploded, or they would be found again for each entry.
    patches = records.select(
        "repo", name.alias("revision"), F.nullif(_attribute(head, "hash"), F.lit("")).alias("patch_hash"), _attribute(head, "author").alias("author"),
        F.coalesce(parse_date("compact", date), parse_date("words", date)).alias("date_utc"), (_attribute(head, "inverted") == "True").alias("inverted"),
        comment.alias("log"), tag.alias("tag"), actions.alias("_actions"),
    )
    rows = patches.select("*", F.posexplode_outer("_actions").alias("pos", "a")).drop("_actions")
    kind = F.regexp_extract("a", r"^<(\w+)", 1)
    moved = kind == "move"
    text = _stripped(_unescaped(F.regexp_extract("a", r"(?s)>([^<]*)", 1)))
    clean = lambda c: F.regexp_replace(c, r"^\./", "")
    return rows.withColumns({
        "action": map_action("patch", kind), "name": clean(F.when(moved, _attribute(F.col("a"), "to")).otherwise(text)), "old_name": clean(F.when(moved, _attribute(F.col("a"), "from"))),
        "is_directory": F.endswith(kind, F.lit("directory")), "conflict": _attribute(F.col("a"), "conflict") != "",
    }).drop("a")


def ingest_pull_preview(df: DataFrame, trailer: str = "Making no changes: this is a dry run.") -> DataFrame:
    """Patches of a preview: repo, pos, name, author, date_utc, log, tag, inverted,
    patch_hash. Records are parted by empty lines and end at the trailer."""
    text = F.regexp_replace("value", rf"(?s)\Q{trailer}\E.*$", "")
    records = df.select("repo", F.posexplode(F.regexp_extract_all(text, F.lit(r"(?m)^\w{3} \w{3} +\d+ \d\d:\d\d:\d\d [^\n]*\n  (?:\*|UNDO:|tagged)[^\n]*+(?:\n  [^\n]*+|\n[ \t]*+(?=\n  ))*+"), F.lit(0))).alias("pos", "r"))
    first, second = F.regexp_extract("r", r"^([^\n]*)", 1), F.regexp_extract("r", r"^[^\n]*\n  ([^\n]*)", 1)
    name = F.regexp_replace(second, r"^\* ", "")
    lines = F.transform(F.filter(F.split(F.regexp_extract("r", r"(?s)^[^\n]*\n[^\n]*\n?(.*)$", 1), "\n"), lambda x: x != ""), lambda x: F.regexp_replace(x, "^  ", ""))
    date = parse_date("words", F.regexp_extract(first, r"^(\w{3} \w{3} +\d+ \d\d:\d\d:\d\d \S+ \d{4})", 1))
    author = F.regexp_extract(first, r"^\w{3} \w{3} +\d+ \d\d:\d\d:\d\d \S+ \d{4}\s*(.*)$", 1)
    return records.select(
        "repo", "pos", name.alias("name"), author.alias("author"), date.alias("date_utc"), F.array_join(lines, "\n").alias("log"),
        F.nullif(F.regexp_extract(name, r"^tagged (.*)$", 1), F.lit("")).alias("tag"), F.startswith(name, F.lit("UNDO: ")).alias("inverted"), patch_hash(name, author, date, lines).alias("patch_hash"),
    )
