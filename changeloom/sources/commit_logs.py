"""Logs of commits, changelists, certificates and stanzas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.functions.scalars import map_action, parse_date, tz_minutes
from changeloom.schema import ADD, DEL, REN, UPD


def ingest_commit_raw(commits: DataFrame, name_status: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw commits (repo, value) and their name-status lines (repo, revision, value)
    as changesets and entries. Of several parents all are kept, entries are
    those against the first."""
    head = F.regexp_extract("value", r"(?s)^(.*?)(?:\n\n|$)", 1)
    author = r"(?m)^author (.*) (\d+) ([+-]\d{4})$"
    lines = F.split(F.regexp_extract("value", r"(?s)\n\n(.*)$", 1), "\n")
    log = F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, "^    ", "")), "\n")
    changesets = commits.select(
        "repo", F.regexp_extract(head, r"(?m)^commit (\w+)", 1).alias("revision"), F.regexp_extract_all(head, F.lit(r"(?m)^parent (\w+)"), F.lit(1)).alias("parents"),
        F.regexp_extract(head, author, 1).alias("author"), F.timestamp_seconds(F.regexp_extract(head, author, 2).try_cast("long")).alias("date_utc"),
        tz_minutes(F.regexp_extract(head, author, 3)).alias("tz_offset_min"), F.regexp_replace(log, r"\n+$", "").alias("log"),
    )
    rows = name_status.select("repo", "revision", F.posexplode(F.filter(F.split("value", "\n"), lambda x: x != "")).alias("pos", "line")).withColumn("f", F.split("line", "\t"))
    code = F.substring(F.col("f")[0], 1, 1)
    two = code.isin("R", "C")
    entries = rows.select("repo", "revision", "pos", map_action("commit", code).alias("action"), F.when(two, F.get("f", F.lit(2))).otherwise(F.get("f", F.lit(1))).alias("name"), F.when(code == "R", F.get("f", F.lit(1))).alias("old_name"))
    return changesets, entries


def ingest_changelist(describes: DataFrame, filelogs: DataFrame | None = None, depot: str = "//depot/") -> tuple[DataFrame, DataFrame]:
    """Descriptions of changelists (repo, value) as changesets and entries, paths
    below ``depot`` and without it. ``filelogs`` (repo, path, seq, note) give the
    origin of branched paths."""
    first = r"^Change (\d+) by ([^@]*)@(\S+) on (\S+ \S+)"
    log = F.array_join(F.transform(F.split(F.regexp_extract("value", r"(?s)^[^\n]*\n\n((?:\t[^\n]*+\n?)*+)", 1), "\n"), lambda x: F.regexp_replace(x, r"^\t", "")), "\n")
    changesets = describes.select("repo", F.regexp_extract("value", first, 1).try_cast("long").alias("seq"), F.regexp_extract("value", first, 2).alias("author"), parse_date("slash", F.regexp_extract("value", first, 4)).alias("date_utc"), F.regexp_replace(log, r"\n+$", "").alias("log"))
    lines = describes.select("repo", F.regexp_extract("value", first, 1).try_cast("long").alias("seq"), F.posexplode(F.regexp_extract_all("value", F.lit(r"(?m)^\.\.\. (//[^\n]*#\d+ \w+)"), F.lit(1))).alias("pos", "line"))
    pattern = r"^(//.*)#(\d+) (\w+)$"
    path = F.regexp_extract("line", pattern, 1)
    inside = lambda c: F.when(F.startswith(c, F.lit(depot)), F.substr(c, F.lit(len(depot) + 1)))
    entries = lines.select("repo", "seq", "pos", map_action("changelist", F.regexp_extract("line", pattern, 3)).alias("action"), inside(path).alias("name"), F.regexp_extract("line", pattern, 2).alias("new_rev")).where("name IS NOT NULL")
    if filelogs is not None:
        notes = filelogs.select("repo", "seq", inside(F.col("path")).alias("name"), inside(F.regexp_extract("note", r"^branch from (//[^#]*)#", 1)).alias("origin")).where("origin IS NOT NULL")
        entries = entries.join(notes, ["repo", "seq", "name"], "left")
    return changesets, entries


#: Possessive, so that the matcher does not recurse once for each character.
QUOTED = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def unquoted(text: Column) -> Column:
    """A quoted string's content without its escapes."""
    inner = F.regexp_replace(text, r'(?s)^"(.*)"$', "$1")
    return F.regexp_replace(inner, r'\\(["\\])', "$1")


def ingest_certs(df: DataFrame) -> DataFrame:
    """Certificates of revisions (repo, revision, value) as (repo, revision, pos, name,
    value); values may have several lines."""
    rows = df.select("repo", "revision", F.posexplode(F.regexp_extract_all("value", F.lit(rf"(?s)name {QUOTED}\s+value {QUOTED}"), F.lit(0))).alias("pos", "c"))
    return rows.select("repo", "revision", "pos", unquoted(F.regexp_extract("c", rf"(?s)^name ({QUOTED})", 1)).alias("name"), unquoted(F.regexp_extract("c", rf"(?s)\s+value ({QUOTED})$", 1)).alias("value"))


#: Words that begin a stanza, and what they do. Fixed values.
STANZAS = {"add_file": ADD, "add_directory": ADD, "add_dir": ADD, "delete": DEL, "rename": REN, "patch": UPD}


def ingest_stanza_diff(df: DataFrame) -> DataFrame:
    """Entries of quoted stanzas (repo, revision, value) up to the first line of
    equal signs: repo, revision, pos, action, name, old_name, is_directory."""
    head = F.regexp_replace("value", r"(?sm)^====.*$", "")
    words = "|".join(sorted(STANZAS, key=len, reverse=True))
    found = F.regexp_extract_all(head, F.lit(rf"(?sm)^#?\s*(?:{words}) {QUOTED}(?:\s*?\n#?\s*to {QUOTED})?"), F.lit(0))
    rows = df.select("repo", "revision", F.posexplode(found).alias("pos", "s"))
    word = F.regexp_extract("s", r"^#?\s*(\w+)", 1)
    path, to = unquoted(F.regexp_extract("s", rf"(?s)^#?\s*\w+ ({QUOTED})", 1)), unquoted(F.regexp_extract("s", rf"(?s)\n#?\s*to ({QUOTED})$", 1))
    table = F.create_map(*(F.lit(x) for item in STANZAS.items() for x in item))
    moved = word == "rename"
    return rows.select("repo", "revision", "pos", F.element_at(table, word).alias("action"), F.when(moved, to).otherwise(path).alias("name"), F.when(moved, path).alias("old_name"), F.startswith(word, F.lit("add_dir")).alias("is_directory"))
