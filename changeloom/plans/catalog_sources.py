"""Round trips of the log formats: tables written as log text, and parsed again."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from changeloom.functions import scalars as S
from changeloom.operators import changesets
from changeloom.plans import views as V
from changeloom.plans.catalog import epoch, query
from changeloom.plans.catalog_entries import named_alike
from changeloom.sources import commit_logs, file_logs, trees, xml_logs
from changeloom.storage import stored


def text(*parts) -> Column:
    return F.concat(*(F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts))


def joined(rows, keys, order, line, sep=""):
    """(keys, value): the lines of each group in order."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct(*order, line.alias("line")))), lambda x: x["line"])
    return rows.groupBy(*keys).agg(F.array_join(parts, sep).alias("value"))


def escaped(c: Column) -> Column:
    for char, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&apos;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(char), F.lit(code))
    return c


SECOND = "CAST(epoch(date_trunc('second', date_utc)) AS BIGINT)"


def file_log_text(spark, sf):
    revs = V.revs(spark, sf)
    lines = F.when(F.col("has_lines"), "  lines: +1 -1").otherwise("")
    log = F.when(F.col("log") == "edit", file_logs.NO_MESSAGE).otherwise(text(F.col("log"), "\n", file_logs.BLOCK_END, "\nmore"))
    locked = F.when(F.col("n") % 5 == 0, "\tlocked by: someone;").otherwise("")
    branches = F.when(F.col("n") % 4 == 0, text("branches:  1.", F.col("n"), ".2;\n")).otherwise("")
    block = text(file_logs.BLOCK_END, "\nrevision ", F.col("rev"), locked, "\ndate: ", F.date_format("date_utc", "yyyy/MM/dd HH:mm:ss"), ";  author: ", F.col("author"), ";  state: ", F.col("state"), ";", lines, "\n", branches, log, "\n")
    files = joined(revs, ["repo", "path"], [(-F.col("n")).alias("k")], block).join(revs.groupBy("repo", "path").agg(F.count("*").alias("total")), ["repo", "path"])
    value = text("cvs rlog: Logging mod\n\nRCS file: /root/mod/", F.col("path"), ",v\nhead: 1.", F.col("total"), "\nsymbolic names:\n\tside: 1.1.0.2\n\tv1: 1.1\ntotal revisions: ", F.col("total"), ";\tselected revisions: ", F.col("total"), "\ndescription:\n", F.col("value"), file_logs.FILE_END, "\n")
    return files.select("repo", "path", value.alias("value"))


@query("s1_file_log", V.sql("revs", f"SELECT repo, path, rev, {SECOND} AS at, author, state, has_lines, CASE WHEN log = 'edit' THEN '' ELSE log || chr(10) || repeat('-', 28) || chr(10) || 'more' END AS log FROM revs"))
def file_log(spark, sf):
    return file_logs.ingest_file_log(file_log_text(spark, sf), "mod").select("repo", "path", "rev", epoch("date_utc").alias("at"), "author", "state", "has_lines", "log")


@query("s1_file_log_headers", V.sql("revs", "SELECT repo, path, count(*) AS selected, 'side=1.1.0.2 v1=1.1' AS symbols FROM revs GROUP BY 1, 2"))
def file_headers(spark, sf):
    logs = file_log_text(spark, sf)
    symbols = file_logs.ingest_symbols(logs, "mod").groupBy("repo", "path").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "tag", "number"))), " ").alias("symbols"))
    return file_logs.ingest_file_headers(logs, "mod").join(symbols, ["repo", "path"])


@query("s1_log_to_changesets", V.sql("acts", ", s AS (SELECT repo, date_trunc('second', date_utc) AS d, author, log, path, max(n) AS n, min_by(action, n) AS action FROM acts GROUP BY ALL), h AS (SELECT repo, d, author, log, min_by(action, path) AS fa, count(*) AS n_files FROM s GROUP BY ALL) SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY d, author, fa, CASE WHEN log = 'edit' THEN '' ELSE log END) - 1 AS seq, n_files FROM h").replace(") , s AS", "), s AS"))
def log_to_changesets(spark, sf):
    """The whole way from log text to ordered changesets."""
    revs = file_logs.ingest_file_log(file_log_text(spark, sf), "mod")
    heads, ents = changesets.collect_by_key(changesets.classify_file_history(revs))
    return ents.groupBy("repo", "seq").agg(F.count("*").alias("n_files")).join(heads.select("repo", "seq"), ["repo", "seq"])


@query("s2_patchset_log", V.sql("moves", "SELECT repo, seq, pos, name || ':x' AS name, CASE WHEN action = 'ADD' THEN 'INITIAL' ELSE old_rev END AS old_rev, new_rev || CASE WHEN action = 'DEL' THEN '(DEAD)' ELSE '' END AS new_rev, 'u' || (seq % 5) AS author, 'fix ' || seq || chr(10) || chr(10) || 'x: y' AS log, CASE WHEN seq % 3 = 0 THEN 't' || seq END AS tag FROM moves"))
def patchset(spark, sf):
    seq = F.col("seq")
    line = text("\t", F.col("name"), ":x:", F.when(F.col("action") == "ADD", "INITIAL").otherwise(F.col("old_rev")), "->", F.col("new_rev"), F.when(F.col("action") == "DEL", "(DEAD)").otherwise(""), "\n")
    sets = joined(V.moves(spark, sf), ["repo", "seq"], ["pos"], line)
    record = text(file_logs.PATCHSET_END, "\nPatchSet ", seq, " \nDate: 2024/01/02 03:04:05\nAuthor: u", seq % 5, "\nBranch: HEAD\nTag: ", F.when(seq % 3 == 0, text("t", seq)).otherwise("(none)"), " \nLog:\nfix ", seq, "\n\nx: y\n\nMembers: \n", F.col("value"), "\n")
    found = file_logs.ingest_patchset_log(sets.select("repo", record.alias("value")))
    return found.select("repo", "seq", F.col("pos").cast("long").alias("pos"), "name", "old_rev", "new_rev", "author", "log", "tag")


@query("s3_xml_log", V.sql("moves", "SELECT repo, CAST(seq AS VARCHAR) AS revision, 'a&b' AS author, CAST(1704164645 AS BIGINT) AS at, '<m> ' || seq AS log, CASE action WHEN 'UPD' THEN 'UPD' WHEN 'DEL' THEN 'DEL' WHEN 'REN' THEN 'REP' ELSE 'ADD' END AS action, substr(name, 4) AS name, CASE WHEN old_name LIKE 'd1/%' THEN substr(old_name, 4) END AS old_name, old_name IS NOT NULL AS copied, pos FROM moves WHERE name LIKE 'd1/%'"))
def xml_log(spark, sf):
    code = F.element_at(F.create_map(*(F.lit(x) for x in ("ADD", "A", "DEL", "D", "UPD", "M", "REN", "R"))), F.col("action"))
    copy = F.when(F.col("old_name").isNotNull(), text(' copyfrom-path="/', F.col("old_name"), '" copyfrom-rev="', F.col("seq") - 1, '"')).otherwise("")
    path = text("<path", copy, ' action="', code, '">/', F.col("name"), "</path>\n")
    sets = joined(V.moves(spark, sf), ["repo", "seq"], ["pos"], path)
    record = text('<logentry revision="', F.col("seq"), '">\n<author>a&amp;b</author>\n<date>2024-01-02T03:04:05.678901Z</date>\n<paths>\n', F.col("value"), "</paths>\n<msg>", escaped(text("<m> ", F.col("seq"))), "</msg>\n</logentry>\n")
    found = xml_logs.ingest_xml_log(sets.select("repo", text('<?xml version="1.0"?>\n<log>\n', record, "</log>\n").alias("value")), "d1")
    return found.select("repo", "revision", "author", epoch("date_utc").alias("at"), "log", "action", "name", "old_name", "copied", F.col("pos").cast("long").alias("pos"))


@query("s4_patch_xml", V.sql("moves", "SELECT repo, 'p' || seq AS revision, action, name, old_name, CASE WHEN seq % 2 = 0 THEN 'True' ELSE 'False' END = 'True' AS inverted, pos, CASE WHEN seq % 3 = 0 THEN 't' || seq END AS tag, CAST(1704164645 AS BIGINT) AS at, action IN ('ADD', 'DEL') AND pos % 2 = 1 AS is_directory FROM (SELECT repo, seq, pos, action, name, CASE WHEN action = 'REN' THEN old_name END AS old_name FROM moves)".replace("'p' || seq AS revision", "CASE WHEN seq % 3 = 0 THEN 'TAG t' ELSE 'p' END || seq AS revision")))
def patch_xml(spark, sf):
    seq, name = F.col("seq"), F.col("name")
    kind = F.when(F.col("pos") % 2 == 1, "directory").otherwise("file")
    child = (
        F.when(F.col("action") == "ADD", text("<add_", kind, ">\n./", name, "\n</add_", kind, ">")).when(F.col("action") == "DEL", text("<remove_", kind, ">\n./", name, "\n</remove_", kind, ">"))
        .when(F.col("action") == "REN", text('<move from="', F.col("old_name"), '" to="', name, '"/>')).otherwise(text("<modify_file>\n./", name, "<removed_lines num='1'/>\n</modify_file>"))
    )
    sets = joined(V.moves(spark, sf), ["repo", "seq"], ["pos"], text(child, "\n"))
    date = F.when(seq % 4 == 0, "Tue Jan  2 03:04:05 CEST 2024").otherwise("20240102030405")
    record = text("<patch author='a &lt;x@y&gt;' date='", date, "' local_date='-' inverted='", F.when(seq % 2 == 0, "True").otherwise("False"), "' hash='h", seq, "'>\n<name>", F.when(seq % 3 == 0, "TAG t").otherwise("p"), seq, "</name>\n<comment>Ignore-this: abc0\nsaid</comment>\n<summary>\n", F.col("value"), "</summary>\n</patch>\n")
    found = xml_logs.ingest_patch_xml(sets.select("repo", record.alias("value"))).where("author = 'a <x@y>' AND log = 'said'")
    return found.select("repo", "revision", "action", "name", "old_name", "inverted", F.col("pos").cast("long").alias("pos"), "tag", epoch("date_utc").alias("at"), "is_directory")


@query("s5_pull_preview", V.sql("changes", f"SELECT repo, seq, author, {SECOND} AS at, 'line of ' || seq || chr(10) || 'and more' AS log, CASE WHEN seq % 3 = 1 THEN 'v' || seq END AS tag, seq % 3 = 2 AS inverted FROM changes"))
def preview(spark, sf):
    month = F.element_at(F.array(*map(F.lit, ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"])), F.month("date_utc"))
    seq = F.col("seq")
    name = F.when(seq % 3 == 0, text("* name ", seq)).when(seq % 3 == 1, text("tagged v", seq)).otherwise(text("UNDO: name ", seq))
    record = text("Mon ", month, " ", F.lpad(F.date_format("date_utc", "d"), 2, " "), " ", F.date_format("date_utc", "HH:mm:ss"), " CEST ", F.date_format("date_utc", "yyyy"), " ", F.col("author"), "\n  ", name, "\n  line of ", seq, "\n  and more\n\n")
    part = F.floor(seq / 50).alias("part")
    whole = joined(V.changes(spark, sf).select("repo", part, "seq", record.alias("r")), ["repo", "part"], ["seq"], F.col("r"))
    value = text("Would pull the following changes:\n", F.col("value"), "Making no changes: this is a dry run.\nMon Jan  1 00:00:00 CEST 2024 x\n  * not this\n")
    found = xml_logs.ingest_pull_preview(whole.select(F.concat_ws(":", "repo", "part").alias("repo"), value.alias("value")))
    names = F.split("repo", ":")
    return found.select(names[0].alias("repo"), (names[1].cast("long") * 50 + F.col("pos")).alias("seq"), "author", epoch("date_utc").alias("at"), "log", "tag", "inverted")


@query("s6_commit_raw", V.sql("moves", "SELECT repo, 'c' || seq AS revision, pos, action, name, CASE WHEN action = 'REN' THEN old_name END AS old_name, 'A B <a@b>' AS author, CAST(1700000000 + seq AS BIGINT) AS at, CAST(-210 AS BIGINT) AS tz, 'do ' || seq || chr(10) || chr(10) || 'body' AS log, CASE WHEN seq > 5 THEN 'c1,c2' ELSE '' END AS parents FROM moves"))
def commit_raw(spark, sf):
    seq = F.col("seq")
    code = F.when(F.col("action") == "REN", text("R090\t", F.col("old_name"), "\t")).otherwise(text(F.translate(F.substring("action", 1, 1), "U", "M"), "\t"))
    status = joined(V.moves(spark, sf), ["repo", "seq"], ["pos"], text(code, F.col("name"), "\n")).select("repo", text("c", seq).alias("revision"), "value")
    raw = V.moves(spark, sf).select("repo", "seq").distinct().select("repo", text("commit c", seq, "\ntree t\n", F.when(seq > 5, "parent c1\nparent c2\n").otherwise(""), "author A B <a@b> ", F.lit(1700000000) + seq, " -0330\ncommitter C <c@d> 1 +0000\n\n    do ", seq, "\n    \n    body\n").alias("value"))
    sets, ents = commit_logs.ingest_commit_raw(raw, status)
    found = ents.join(sets, ["repo", "revision"])
    return found.select("repo", "revision", F.col("pos").cast("long").alias("pos"), "action", "name", "old_name", "author", epoch("date_utc").alias("at"), F.col("tz_offset_min").cast("long").alias("tz"), "log", F.concat_ws(",", "parents").alias("parents"))


@query("s7_changelist", V.sql("moves", "SELECT repo, seq, pos, CASE WHEN action = 'REN' THEN 'ADD' ELSE action END AS action, name || CASE WHEN k > 1 THEN '~' || k ELSE '' END AS name, CASE WHEN action = 'REN' THEN old_name END AS origin, 'joe' AS author, CAST(1704164645 AS BIGINT) AS at, 'did ' || seq || chr(10) || 'more' AS log FROM (SELECT *, row_number() OVER (PARTITION BY repo, seq, name ORDER BY pos) AS k FROM moves)"))
def changelist(spark, sf):
    """A changelist names each path once."""
    seq, nth = F.col("seq"), F.row_number().over(Window.partitionBy("repo", "seq", "name").orderBy("pos"))
    moves = V.moves(spark, sf).withColumn("k", nth).withColumn("name", F.concat("name", F.when(F.col("k") > 1, text("~", F.col("k"))).otherwise("")))
    code = F.element_at(F.create_map(*(F.lit(x) for x in ("ADD", "add", "DEL", "delete", "UPD", "edit", "REN", "branch"))), F.col("action"))
    sets = joined(moves, ["repo", "seq"], ["pos"], text("... //depot/", F.col("name"), "#", F.col("pos") + 1, " ", code, "\n"))
    value = text("Change ", seq, " by joe@box on 2024/01/02 03:04:05\n\n\tdid ", seq, "\n\tmore\n\nAffected files ...\n\n", F.col("value"))
    notes = moves.where("action = 'REN'").select("repo", "seq", F.concat(F.lit("//depot/"), "name").alias("path"), text("branch from //depot/", F.col("old_name"), "#1").alias("note"))
    described = stored(sets.select("repo", value.alias("value")), "describes")  # heads and entries are both read from it
    heads, ents = commit_logs.ingest_changelist(described, notes)
    return ents.join(heads, ["repo", "seq"]).select("repo", "seq", F.col("pos").cast("long").alias("pos"), "action", "name", "origin", "author", epoch("date_utc").alias("at"), "log")


@query("s8_header_log", V.sql("logs", "SELECT conv_id, turn, role || ' <r@x>' AS author, CAST(1704164645 AS BIGINT) AS at, 'Sum ' || turn || chr(10) || 'key' || CASE WHEN rtrim(log, chr(10)) = '' THEN '' ELSE chr(10) || rtrim(log, chr(10)) END AS log, turn % 4 = 1 AS bad FROM (SELECT conv_id, turn, role, CASE WHEN turn % 5 = 2 THEN '' ELSE coalesce(log, '') END AS log FROM logs)"))
def header_log(spark, sf):
    rows = V.logs(spark, sf).withColumn("log", F.when(F.col("turn") % 5 == 2, "").otherwise(F.coalesce("log", F.lit(""))))
    extra = F.when(F.col("turn") % 4 == 1, "Content-type: multipart/mixed\n").otherwise("")
    value = text("Revision: p--", F.col("conv_id"), "--", F.col("turn"), "\nCreator: ", F.col("role"), " <r@x>\nDate: Tue Jan  2 05:04:05 CEST 2024\nStandard-date: 2024-01-02 03:04:05 GMT\n", extra, "Summary: Sum ", F.col("turn"), "\nKeywords: key\n\n", F.col("log"), "\n")
    found = file_logs.ingest_header_log(rows.select(F.lit("r").alias("repo"), value.alias("value")))
    ids = F.split("revision", "--")
    return found.select(ids[1].cast("long").alias("conv_id"), ids[2].cast("long").alias("turn"), "author", epoch("date_utc").alias("at"), "log", "bad")


@query("s9_apply_report", V.sql("moves", "SELECT repo, seq, pos, action, name, CASE WHEN action = 'REN' THEN old_name END AS old_name, false AS conflict FROM moves"))
def apply_report(spark, sf):
    """Many reports of each repo, told apart by the changeset that they are about."""
    line = (
        F.when(F.col("action") == "REN", text("=>  ", F.col("old_name"), "\t", F.col("name"))).when(F.col("action") == "ADD", text("A   ", F.col("name")))
        .when(F.col("action") == "DEL", text("D/  ", F.col("name"))).otherwise(text("M   ./", F.col("name")))
    )
    sets = joined(V.moves(spark, sf), ["repo", "seq"], ["pos"], text(line, "\n"))
    value = text("A   before\n* applying changeset x\n", F.col("value"), "--  permission\n* reapplying local changes\nM   after\n")
    found = file_logs.ingest_apply_report(sets.select("repo", "seq", value.alias("value")), key=("repo", "seq"))
    return found.select("repo", "seq", F.col("pos").cast("long").alias("pos"), "action", "name", "old_name", "conflict")


def certs_text(spark, sf):
    quoted = lambda c: text('"', F.regexp_replace(c, r'(["\\])', r"\\$1"), '"')
    cert = lambda n, v: text('   name "', n, '"\n  value ', v, "\n  trust \"trusted\"\n\n")
    rows = V.logs(spark, sf)
    value = text(cert("author", quoted(F.col("role"))), cert("branch", quoted(text("b.", F.col("conv_id")))), cert("date", F.lit('"2024-01-02T03:04:05"')), cert("changelog", quoted(text('say "', F.col("log"), '\\"'))), cert("author", quoted(F.lit("two"))), cert("comment", quoted(F.lit("well\nso"))), cert("tag", quoted(text("t", F.col("turn")))))
    return rows.select(F.col("conv_id").cast("string").alias("repo"), F.col("turn").cast("string").alias("revision"), value.alias("value"))


@query("s10_certs", V.sql("logs", """SELECT CAST(conv_id AS VARCHAR) AS repo, CAST(turn AS VARCHAR) AS revision, p.pos, p.name, CASE p.pos WHEN 0 THEN role WHEN 1 THEN 'b.' || conv_id WHEN 2 THEN '2024-01-02T03:04:05' WHEN 3 THEN 'say "' || log || '\\"' WHEN 4 THEN 'two' WHEN 5 THEN 'well' || chr(10) || 'so' ELSE 't' || turn END AS value FROM logs, (VALUES (0, 'author'), (1, 'branch'), (2, 'date'), (3, 'changelog'), (4, 'author'), (5, 'comment'), (6, 'tag')) p(pos, name)"""))
def certs(spark, sf):
    return commit_logs.ingest_certs(certs_text(spark, sf))


@query("a8_fold_certs", V.sql("logs", """SELECT CAST(conv_id AS VARCHAR) AS repo, CAST(turn AS VARCHAR) AS revision, role || '.two' AS author, CAST(1704164645 AS BIGINT) AS at, 'say "' || log || '\\"' || chr(10) || 'Note:' || chr(10) || 'well' || chr(10) || 'so' AS log, 'b.' || conv_id AS branches, 't' || turn AS tags, false AS bad FROM logs"""))
def fold_certs(spark, sf):
    found = changesets.fold_certs(commit_logs.ingest_certs(certs_text(spark, sf)))
    return found.select("repo", "revision", "author", epoch("date_utc").alias("at"), "log", F.concat_ws(",", "branches").alias("branches"), F.concat_ws(",", "tags").alias("tags"), "bad")


@query("s11_stanza_diff", V.sql("moves", """SELECT repo, seq, pos, action, name || '"q' AS name, CASE WHEN action = 'REN' THEN old_name END AS old_name, action = 'ADD' AND pos % 2 = 1 AS is_directory FROM moves"""))
def stanza(spark, sf):
    name = text('"', F.col("name"), '\\"q"')
    word = F.when(F.col("pos") % 2 == 1, "add_dir").otherwise("add_file")
    block = (
        F.when(F.col("action") == "REN", text('# rename "', F.col("old_name"), '"\n#     to ', name, "\n")).when(F.col("action") == "ADD", text("# ", word, " ", name, "\n#  content [aa]\n"))
        .when(F.col("action") == "DEL", text("# delete ", name, "\n")).otherwise(text("# patch ", name, "\n#  from [a]\n#    to [b]\n"))
    )
    sets = joined(V.moves(spark, sf), ["repo", "seq"], ["pos"], text(block, "#\n"))
    found = commit_logs.ingest_stanza_diff(sets.select("repo", F.col("seq").alias("revision"), text("# old_revision [x]\n#\n", F.col("value"), "============\n# delete \"not\"\n").alias("value")))
    return found.select("repo", F.col("revision").alias("seq"), F.col("pos").cast("long").alias("pos"), "action", "name", "old_name", "is_directory")


@query("s12_manifest", V.sql("revs", f"SELECT repo, path, rev, CASE WHEN n % 7 = 0 THEN 0 ELSE {SECOND} END AS at, CASE WHEN n % 3 = 0 THEN 'v1' END AS tag FROM revs"))
def manifest(spark, sf):
    month = F.element_at(F.array(*map(F.lit, ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"])), F.month("date_utc"))
    stamp = text("Mon ", month, " ", F.lpad(F.date_format("date_utc", "d"), 2, " "), " ", F.date_format("date_utc", "HH:mm:ss yyyy"))
    time = F.when(F.col("n") % 7 == 0, "Result of merge").when(F.col("n") % 7 == 1, text("Result of merge+", stamp)).otherwise(stamp)
    line = text("/", F.regexp_extract("path", "[^/]+$", 0), "/", F.col("rev"), "/", time, "//", F.when(F.col("n") % 3 == 0, "Tv1").otherwise(""))
    rows = V.revs(spark, sf).select("repo", S.parent_of(F.col("path")).alias("dir"), line.alias("line"))
    found = trees.parse_manifest(rows.union(rows.select("repo", "dir", F.lit("D/sub////")).distinct()))
    return found.select("repo", "path", "rev", epoch("ts").alias("at"), "tag")


@query("s13_snapshot_history", V.sql("trees", ", b AS (SELECT repo, seq + 1 AS seq, path, rev FROM trees WHERE (repo, seq + 1) IN (SELECT (repo, seq) FROM trees)), o AS (SELECT coalesce(b.repo, a.repo) AS repo, coalesce(b.seq, a.seq) AS seq, coalesce(b.path, a.path) AS name, b.rev AS o, a.rev AS n FROM b FULL JOIN trees a USING (repo, seq, path)), cp AS (SELECT x.repo, x.seq, y.name AS source, min(x.name) AS path FROM o x JOIN o y ON y.repo = x.repo AND y.seq = x.seq AND split_part(y.name, '/', 3) = split_part(x.name, '/', 3) WHERE x.o IS NULL AND y.n IS NULL GROUP BY ALL), k AS (SELECT repo, seq, path, min(source) AS source FROM cp GROUP BY ALL) SELECT repo, seq, CASE WHEN o IS NULL AND (repo, seq, name) IN (SELECT (repo, seq, path) FROM k) THEN 'REN' WHEN o IS NULL THEN 'ADD' WHEN n IS NULL THEN 'DEL' ELSE 'UPD' END AS action, name, CASE WHEN o IS NULL THEN (SELECT source FROM k WHERE k.repo = o.repo AND k.seq = o.seq AND k.path = o.name) END AS old_name FROM o WHERE o IS DISTINCT FROM n AND NOT (n IS NULL AND (repo, seq, name) IN (SELECT (repo, seq, source) FROM k))").replace(") , b AS", "), b AS"))
def snapshots(spark, sf):
    """Files that moved are noted as copies of files of the same name."""
    rows = V.trees(spark, sf)
    years = rows.select("repo", "seq").distinct()
    parents = years.withColumn("parent", F.col("seq") - 1)
    before = rows.withColumn("seq", F.col("seq") + 1).join(years, ["repo", "seq"], "left_semi")
    ents, _ = trees.ingest_snapshot_history(rows, parents, named_alike(before, rows))
    return ents.select("repo", "seq", "action", "name", "old_name")


@query("s14_delta_lists", V.sql("moves", "SELECT repo, seq AS revision, row_number() OVER (PARTITION BY repo, seq ORDER BY CASE action WHEN 'REN' THEN 0 WHEN 'ADD' THEN 1 WHEN 'DEL' THEN 2 ELSE 3 END, pos) - 1 AS pos, action, name, CASE WHEN action = 'REN' THEN old_name END AS old_name FROM moves"))
def deltas(spark, sf):
    of = lambda a: F.transform(F.sort_array(F.collect_list(F.when(F.col("action") == a, F.struct("pos", "name", "old_name", F.lit(False).alias("is_directory"))))), lambda x: F.struct(x["old_name"].alias("old_name"), x["name"].alias("name"), x["is_directory"].alias("is_directory")))
    lists = V.moves(spark, sf).groupBy("repo", F.col("seq").alias("revision")).agg(of("REN").alias("renamed"), of("ADD").alias("added"), of("DEL").alias("removed"), of("UPD").alias("modified"))
    return trees.ingest_delta_lists(lists).select("repo", "revision", F.col("pos").cast("long").alias("pos"), "action", "name", "old_name")
