"""Logs by file, by patch set and by mail-style header, and reports of applying.

Parsers take (repo, value) rows; a value holds one log, or one record of it where
a reader has cut it already. ``read_logs`` makes such rows from files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.functions.scalars import parse_date
from changeloom.schema import ADD, DEL, UPD

FILE_END, BLOCK_END, PATCHSET_END = "=" * 77, "-" * 28, "-" * 21
NO_MESSAGE = "*** empty log message ***"


def read_logs(spark: SparkSession, paths: str | list[str], record_end: str | None = None, repo: Column | None = None) -> DataFrame:
    """(repo, value): whole files, or their records where ``record_end`` cuts them.

    repo is the name of the file unless another column is given. With a record
    end large files are read in parallel.
    """
    if record_end is None:
        read = spark.read.option("wholetext", True).text(paths)
    else:
        read = spark.read.option("lineSep", record_end).text(paths)
    return read.select((repo if repo is not None else F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)).alias("repo"), "value")


def _field(text: Column, name: str) -> Column:
    return F.regexp_extract(text, rf"(?m)^{name}:[ \t]*(.*?)[ \t]*$", 1)


def _file_sections(df: DataFrame, module: str) -> DataFrame:
    sections = df.select("repo", F.explode(F.split("value", rf"(?m)^{FILE_END}$\n?")).alias("section")).where(F.contains(F.col("section"), F.lit("RCS file: ")))
    path = F.regexp_replace(F.regexp_extract("section", r"(?m)^RCS file: (.*),v$", 1), r"(^|/)Attic/", "$1")
    inside = F.regexp_replace(path, rf"^(?:.*?/)?\Q{module.strip('/')}\E/", "") if module else F.regexp_replace(path, "^/", "")
    blocks = F.split("section", rf"(?m)^{BLOCK_END}\n(?=revision )")
    return sections.select("repo", inside.alias("path"), blocks[0].alias("header"), F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0))).alias("blocks"))


def ingest_file_log(df: DataFrame, module: str = "", trim: int = 0) -> DataFrame:
    """Revisions of files: repo, path, rev, date_utc, author, state, has_lines, log, pos.

    A line of dashes in a message ends it only before a line that begins with
    'revision '. Locked revisions and a branches line are understood; the
    placeholder for no message is ''.
    """
    rows = _file_sections(df, module).select("repo", "path", F.posexplode("blocks").alias("pos", "block"))
    head = F.regexp_extract("block", r"(?m)^date: .*$", 0)
    part = lambda name: F.regexp_extract(head, rf"{name}: ([^;]*)(?:;|$)", 1)
    body = F.regexp_replace("block", r"^revision [^\n]*\ndate: [^\n]*\n(?:branches: [^\n]*\n)?", "")
    log = F.regexp_replace(body, r"\n+$", "")
    out = rows.select(
        "repo", "path", F.regexp_extract("block", r"^revision (\S+)", 1).alias("rev"), parse_date("slash", part("date")).alias("date_utc"), part("author").alias("author"),
        part("state").alias("state"), F.contains(head, F.lit("lines: ")).alias("has_lines"), F.when(log == NO_MESSAGE, "").otherwise(log).alias("log"), "pos",
    )
    if trim:
        from changeloom.functions.scalars import trimmed_path

        out = out.withColumn("path", trimmed_path(F.col("path"), trim))
    return out


def ingest_file_headers(df: DataFrame, module: str = "") -> DataFrame:
    """(repo, path, selected): the number of revisions that each file announces."""
    return _file_sections(df, module).select("repo", "path", F.regexp_extract("header", r"selected revisions: (\d+)", 1).try_cast("long").alias("selected"))


def ingest_symbols(df: DataFrame, module: str = "") -> DataFrame:
    """(repo, path, tag, number) of every file's table of symbols."""
    tables = _file_sections(df, module).select("repo", "path", F.regexp_extract("header", r"(?m)^symbolic names:\n((?:\t[^\n]*+\n)*+)", 1).alias("t"))
    pairs = tables.select("repo", "path", F.explode(F.filter(F.split("t", "\n"), lambda x: x != "")).alias("line"))
    return pairs.select("repo", "path", F.regexp_extract("line", r"^\t(.*): [\d.]+$", 1).alias("tag"), F.regexp_extract("line", r": ([\d.]+)$", 1).alias("number"))


def ingest_patchset_log(df: DataFrame, since: int | None = None) -> DataFrame:
    """Members of numbered patch sets: repo, seq, date_utc, author, branch, tag, log,
    pos, name, old_rev, new_rev. The last colon of a member's line ends its path."""
    records = df.select("repo", F.explode(F.split("value", rf"(?m)^{PATCHSET_END}\n")).alias("r")).withColumn("seq", F.regexp_extract("r", r"^PatchSet (\d+)", 1).try_cast("long")).where("seq IS NOT NULL")
    if since is not None:
        records = records.where(F.col("seq") > since)
    log = F.regexp_extract("r", r"(?s)\nLog:\n(.*?)\n+Members: ?\n", 1)
    members = F.filter(F.split(F.regexp_extract("r", r"(?s)\nMembers: ?\n(.*)$", 1), "\n"), lambda x: F.startswith(x, F.lit("\t")))
    rows = records.select(
        "repo", "seq", parse_date("slash", _field(F.col("r"), "Date")).alias("date_utc"), _field(F.col("r"), "Author").alias("author"), _field(F.col("r"), "Branch").alias("branch"),
        F.nullif(F.regexp_replace(_field(F.col("r"), "Tag"), r"^\(none\)$", ""), F.lit("")).alias("tag"), log.alias("log"), F.posexplode(members).alias("pos", "member"),
    )
    pattern = r"^\t(.*):([^:]*)->(.*?)\s*$"
    return rows.select("repo", "seq", "date_utc", "author", "branch", "tag", "log", "pos", F.regexp_extract("member", pattern, 1).alias("name"), F.regexp_extract("member", pattern, 2).alias("old_rev"), F.regexp_extract("member", pattern, 3).alias("new_rev"))


def ingest_header_log(df: DataFrame) -> DataFrame:
    """Mail-style logs: repo, revision, author, date_utc, log, bad. The message is
    summary, keywords and body; multipart and continued records are bad."""
    head, body = F.regexp_extract("value", r"(?s)^(.*?)(?:\n\n|$)", 1), F.regexp_extract("value", r"(?s)\n\n(.*)$", 1)
    summary, keywords = _field(head, "Summary"), _field(head, "Keywords")
    log = F.concat_ws("\n", F.nullif(summary, F.lit("")), F.nullif(keywords, F.lit("")), F.nullif(F.regexp_replace(body, r"\n+$", ""), F.lit("")))
    date = F.coalesce(parse_date("iso", F.regexp_replace(_field(head, "Standard-date"), r" GMT$", "")), parse_date("words", _field(head, "Date")))
    bad = F.rlike(head, F.lit(r"(?mi)^content-type:\s*multipart|^Archive-continued:")) | date.isNull() | (_field(head, "Creator") == "")
    return df.select("repo", _field(head, "Revision").alias("revision"), _field(head, "Creator").alias("author"), date.alias("date_utc"), log.alias("log"), F.coalesce(bad, F.lit(True)).alias("bad"))


#: Codes of report lines. Fixed values.
REPORT_CODES = {"A": ADD, "A/": ADD, "D": DEL, "D/": DEL, "M": UPD, "Mb": UPD, "M-": UPD, "ch": UPD, "cl": UPD}


def ingest_apply_report(df: DataFrame, start: str = "* applying changeset", end: str = "* reapplying local changes", key: tuple[str, ...] = ("repo",)) -> DataFrame:
    """Entries and conflicts of reports of applying changesets, between their start
    and end lines: repo, pos, action, name, old_name, conflict. A report is a row; other
    columns of ``key`` tell several reports of a repo apart."""
    at = lambda mark: rf"(?m)^\Q{mark}\E"
    parts = F.split("value", at(start))  # what is before the first start is no part of it
    inside = F.flatten(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.slice(F.split(F.split(p, at(end))[0], "\n"), F.lit(2), F.length(p) + 1)))
    coded = lambda line: F.regexp_extract(line, r"^(\S+)\s+", 1)
    rows = df.select(*key, F.posexplode(F.filter(inside, lambda x: ~F.startswith(x, F.lit("*")) & ~coded(x).isin("--", "-/", ""))).alias("pos", "line"))
    code, rest = coded(F.col("line")), F.regexp_extract("line", r"^\S+\s+(.*?)\s*$", 1)
    table = F.create_map(*(F.lit(x) for item in REPORT_CODES.items() for x in item))
    moved = code.isin("=>", "/>")
    name = F.regexp_replace(F.when(moved, F.regexp_extract(rest, r"\t(.*)$", 1)).otherwise(rest), r"^\./", "")
    old = F.when(moved, F.regexp_replace(F.regexp_extract(rest, r"^(.*?)\t", 1), r"^\./", ""))
    return rows.select(*key, F.when(moved, "REN").otherwise(F.element_at(table, code)).alias("action"), name.alias("name"), old.alias("old_name"), code.isin("C", "?").alias("conflict"), "pos")
