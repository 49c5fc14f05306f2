"""Queries over path actions, trees, graphs and destinations."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from changeloom.operators import adapt, changesets, digests, entries, folds, graph, tree
from changeloom.plans import views as V
from changeloom.plans.catalog import epoch, query
from changeloom.storage import shared_dir, stored

E_COLS = "repo, seq, pos, action, name, old_name"
M = V.sql("moves", "").rstrip()


def out(df, *more):
    return df.select("repo", F.col("seq").cast("long").alias("seq"), F.col("pos").cast("long").alias("pos"), "action", "name", "old_name", *more)


# Filters and projections


@query("p1_scope_to_module", M + " SELECT repo, seq, pos, action, substr(name, 4) AS name, CASE WHEN old_name LIKE 'd1/%' THEN substr(old_name, 4) END AS old_name FROM moves WHERE name LIKE 'd1/%'")
def scope(spark, sf):
    return out(entries.scope_to_module(V.moves(spark, sf), "d1"))


@query("p2_trim_components", M + " SELECT repo, seq, pos, action, split_part(name, '/', 2) || '/' || split_part(name, '/', 3) AS name, split_part(old_name, '/', 2) || '/' || split_part(old_name, '/', 3) AS old_name FROM moves")
def trim(spark, sf):
    return out(entries.trim_components(V.moves(spark, sf)))


@query("p3_rebase_paths", M + " SELECT repo, seq, pos, action, 'sub/dir/' || name AS name, 'sub/dir/' || old_name AS old_name FROM moves")
def rebase(spark, sf):
    return out(entries.rebase_paths(V.moves(spark, sf), "/sub/dir/"))


@query("p4_normalize_paths", M + f" SELECT {E_COLS} FROM moves")
def normalize(spark, sf):
    rough = V.moves(spark, sf).withColumns({"name": F.concat(F.lit("./x/..//"), "name", F.lit("/")), "old_name": F.concat(F.lit("./"), F.replace("old_name", F.lit("/"), F.lit("/./")))})
    return out(entries.normalize_paths(rough))


@query("p5_drop_metadata_paths", M + f" SELECT {E_COLS} FROM moves WHERE split_part(name, '/', 2) <> 'e1' AND name <> 'd0/e0/f0'")
def metadata(spark, sf):
    return out(entries.drop_metadata_paths(V.moves(spark, sf), ("e1",), "d0/e0/f0"))


@query("p6_apply_ignore_rules", M + " SELECT repo, seq, count(*) AS n FROM moves WHERE NOT regexp_matches(name, 'f[0-4]$') AND name NOT LIKE 'd2/%' GROUP BY 1, 2")
def ignore(spark, sf):
    moves = V.moves(spark, sf)
    sets, kept = entries.apply_ignore_rules(moves.select("repo", "seq").distinct(), moves, ["f[0-4]$", "^d2/"])
    return sets.join(kept, ["repo", "seq"]).groupBy("repo", "seq").agg(F.count("*").alias("n"))


@query("p10_select_kind", M + f" SELECT {E_COLS} FROM moves WHERE action = 'REN'")
def kind(spark, sf):
    return out(entries.select_kind(V.moves(spark, sf), "REN"))


@query("p11_since_revision", V.sql("changes", "SELECT repo, seq, rev, path FROM changes c WHERE seq > 40 AND date_utc > TIMESTAMP '2024-01-03' AND seq > (SELECT max(seq) FROM changes d WHERE d.repo = c.repo AND d.rev = '1.2')"))
def since(spark, sf):
    rows = V.changes(spark, sf).withColumn("revision", F.col("rev"))
    rows = changesets.since_revision(changesets.since_revision(rows, 40), "2024-01-03 00:00:00", "date_utc")
    full = V.changes(spark, sf).withColumn("revision", F.col("rev"))
    late = changesets.since_revision(full, "1.2", "revision").select("repo", "seq")
    return rows.join(late, ["repo", "seq"], "left_semi").select("repo", "seq", "rev", "path")


@query("p12_resolve_start", V.sql("changes", """SELECT 'stamp' AS spec, repo, count(*) AS n FROM changes WHERE date_utc >= TIMESTAMP '2024-01-05' GROUP BY repo UNION ALL SELECT 'head', repo, 1 FROM changes GROUP BY repo
    UNION ALL SELECT 'rev', repo, count(*) FROM changes c WHERE seq >= (SELECT min(seq) FROM changes d WHERE d.repo = c.repo AND d.rev = '1.5') GROUP BY repo UNION ALL SELECT 'branch', repo, count(*) FROM changes WHERE author = 'a1' AND date_utc >= TIMESTAMP '2024-01-05' GROUP BY repo"""))
def start(spark, sf):
    rows = V.changes(spark, sf).select("repo", "seq", F.col("rev").alias("revision"), "date_utc", F.array("author").alias("branches"), F.array().cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("patch_hash"))
    parts = [changesets.resolve_start(rows, spec).select(F.lit(name).alias("spec"), "repo") for name, spec in (("stamp", "2024-01-05"), ("head", "HEAD"), ("rev", "1.5"), ("branch", "a1 2024-01-05"))]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).groupBy("spec", "repo").agg(F.count("*").alias("n"))


@query("p13_drop_restricted", "SELECT event_id FROM events WHERE event_id % 5 <> 0")
def restricted(spark, sf):
    hide = F.col("event_id") % 5 == 0
    rows = V.load(spark, sf, "events").select("event_id", *(F.when(~hide, c).alias(n) for n, c in (("date_utc", F.col("ts")), ("author", F.col("event_type")), ("log", F.col("props")))))
    return changesets.drop_restricted(rows).select("event_id")


@query("p14_files_only", M + f" SELECT {E_COLS} FROM moves WHERE pos <> 1 AND pos <> 2")
def files(spark, sf):
    return out(entries.files_only(V.moves(spark, sf).withColumns({"is_directory": F.when(F.col("pos") == 1, True), "is_symlink": F.col("pos") == 2})))


@query("p15_default_author", "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN 'anonymous' ELSE event_type END AS author FROM events")
def author(spark, sf):
    rows = V.load(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 2, F.col("event_type")).alias("author"))
    return changesets.default_author(rows)


LATEST = ", man AS (SELECT repo, path, rev FROM ivals WHERE to_seq IS NULL)"


@query("p16_drop_missing_paths", V.sql("ivals", "").rstrip() + LATEST + " SELECT repo, seq, action, path AS name FROM changes c WHERE action = 'DEL' OR EXISTS (SELECT 1 FROM man m WHERE m.repo = c.repo AND m.path = c.path)")
def missing_paths(spark, sf):
    rows = V.changes(spark, sf)
    man = tree.tree_intervals(rows).where("to_seq IS NULL")
    return entries.drop_missing_paths(rows, man).select("repo", "seq", "action", "name")


@query("p17_drop_self_rename", M + f" SELECT {E_COLS} FROM moves WHERE NOT (action = 'REN' AND name = old_name)")
def self_rename(spark, sf):
    return out(entries.drop_self_rename(V.moves(spark, sf)))


@query("p18_dedupe_touch", M + f" SELECT {E_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY repo, seq, name ORDER BY pos) AS k FROM moves) WHERE action <> 'UPD' OR k = 1")
def touch(spark, sf):
    return out(entries.dedupe_touch(V.moves(spark, sf)))


# Renames, copies and trees

BELOW = "{0} LIKE {1} || '/%'"


@query("j1_detect_renames", M + f""", gone AS (SELECT DISTINCT repo, seq, name FROM moves WHERE action = 'DEL'), c AS (SELECT m.*, row_number() OVER (PARTITION BY repo, seq, old_name, action ORDER BY name DESC, pos DESC) AS k FROM moves m),
    r AS (SELECT c.repo, c.seq, c.pos FROM c JOIN gone g ON g.repo = c.repo AND g.seq = c.seq AND g.name = c.old_name WHERE action = 'ADD' AND k = 1), u AS (SELECT repo, seq, old_name AS name FROM moves JOIN r USING (repo, seq, pos))
    SELECT repo, seq, pos, CASE WHEN (repo, seq, pos) IN (SELECT (repo, seq, pos) FROM r) THEN 'REN' ELSE action END AS action, name, old_name FROM moves WHERE NOT (action = 'DEL' AND (repo, seq, name) IN (SELECT (repo, seq, name) FROM u))""")
def renames(spark, sf):
    return out(entries.detect_renames(V.moves(spark, sf)))


DIRS = M + ", dirs AS (SELECT repo, seq, pos, CASE WHEN action = 'DEL' AND pos % 2 = 0 THEN 'DEL' ELSE action END AS action, CASE WHEN action = 'DEL' AND pos % 2 = 0 THEN split_part(name, '/', 1) ELSE name END AS name, old_name FROM moves)"


def with_dirs(spark, sf):
    whole = (F.col("action") == "DEL") & (F.col("pos") % 2 == 0)
    return V.moves(spark, sf).withColumn("name", F.when(whole, F.substring_index("name", "/", 1)).otherwise(F.col("name")))


@query("j2_renames_from_dir", DIRS + f""" SELECT repo, seq, pos, CASE WHEN action = 'ADD' AND EXISTS (SELECT 1 FROM dirs d WHERE d.repo = m.repo AND d.seq = m.seq AND d.action = 'DEL' AND m.old_name LIKE d.name || '/%') THEN 'REN' ELSE action END AS action, name, old_name FROM dirs m""")
def renames_dir(spark, sf):
    return out(entries.renames_from_dir(with_dirs(spark, sf)))


COPYDIRS = M + ", dirs AS (SELECT repo, seq, pos, action, CASE WHEN action = 'ADD' AND old_name IS NOT NULL THEN split_part(name, '/', 1) ELSE name END AS name, old_name FROM moves)"


@query("j3_adds_below_copy", COPYDIRS + """ SELECT repo, seq, pos, CASE WHEN action <> 'DEL' AND EXISTS (SELECT 1 FROM dirs d WHERE d.repo = m.repo AND d.seq = m.seq AND d.action = 'ADD' AND d.old_name IS NOT NULL AND m.name LIKE d.name || '/%') THEN 'ADD' ELSE action END AS action, name, old_name FROM dirs m""")
def below_copy(spark, sf):
    name = F.when((F.col("action") == "ADD") & F.col("old_name").isNotNull(), F.substring_index("name", "/", 1)).otherwise(F.col("name"))
    return out(entries.adds_below_copy(V.moves(spark, sf).withColumn("name", name)))


@query("j4_resolve_replaced", M + " SELECT repo, seq, row_number() OVER (PARTITION BY repo, seq ORDER BY action = 'UPD' AND pos % 2 = 0, pos) - 1 AS pos, CASE WHEN action = 'UPD' AND pos % 2 = 0 THEN 'ADD' ELSE action END AS action, name, old_name FROM moves")
def replaced(spark, sf):
    return out(entries.resolve_replaced(V.moves(spark, sf).withColumn("action", F.expr("CASE WHEN action = 'UPD' AND pos % 2 = 0 THEN 'REP' ELSE action END"))))


@query("j1_to_j4_resolve_copies")
def resolve(spark, sf):
    rows = with_dirs(spark, sf).withColumn("action", F.expr("CASE WHEN action = 'UPD' THEN 'REP' WHEN action = 'REN' THEN 'ADD' ELSE action END"))
    nth = F.row_number().over(Window.partitionBy("repo", "seq", "name").orderBy("pos"))
    rows = rows.withColumn("name", F.concat("name", F.when(nth > 1, F.concat(F.lit("~"), nth.cast("string"))).otherwise("")))  # each path is named once
    return out(entries.resolve_copies(rows.withColumn("copied", F.col("old_name").isNotNull())))


@query("j5_renames_by_branch_note", M + """, c AS (SELECT repo, seq, pos, action, name, CASE WHEN action = 'ADD' THEN 'd0/e' || (pos % 2) || '/f' || (pos % 9) END AS old_name FROM moves), n AS (SELECT repo, seq, name, min(old_name) AS origin FROM c WHERE action = 'ADD' GROUP BY ALL),
    e AS (SELECT c.repo, c.seq, c.pos, c.action, c.name, CASE WHEN c.action = 'ADD' THEN n.origin END AS old_name FROM c LEFT JOIN n USING (repo, seq, name)), gone AS (SELECT DISTINCT repo, seq, name FROM e WHERE action = 'DEL'),
    k AS (SELECT *, row_number() OVER (PARTITION BY repo, seq, old_name, action ORDER BY name DESC) AS k FROM e), r AS (SELECT k.repo, k.seq, k.pos, k.old_name FROM k JOIN gone g ON g.repo = k.repo AND g.seq = k.seq AND g.name = k.old_name WHERE action = 'ADD' AND k = 1)
    SELECT e.repo, e.seq, e.pos, CASE WHEN r.pos IS NOT NULL THEN 'REN' ELSE action END AS action, name, r.old_name FROM e LEFT JOIN r ON r.repo = e.repo AND r.seq = e.seq AND r.pos = e.pos WHERE NOT (action = 'DEL' AND (e.repo, e.seq, name) IN (SELECT (repo, seq, old_name) FROM r))""")
def branch_note(spark, sf):
    rows = V.moves(spark, sf).withColumn("old_name", F.lit(None).cast("string"))
    notes = rows.where("action = 'ADD'").groupBy("repo", "seq", "name").agg(F.min(F.format_string("d0/e%d/f%d", F.col("pos") % 2, F.col("pos") % 9)).alias("origin"))
    return out(entries.renames_by_branch_note(rows, notes))


TREES = V.sql("trees", "").rstrip() + ", bef AS (SELECT repo, seq + 1 AS seq, path, rev FROM trees)"


COPIED = """, o AS (SELECT coalesce(b.repo, a.repo) AS repo, coalesce(b.seq, a.seq) AS seq, coalesce(b.path, a.path) AS name, b.rev AS old_rev, a.rev AS new_rev FROM bef b FULL JOIN trees a USING (repo, seq, path)),
    cp AS (SELECT n.repo, n.seq, n.name AS path, g.name AS source FROM o n JOIN o g ON g.repo = n.repo AND g.seq = n.seq AND split_part(g.name, '/', 3) = split_part(n.name, '/', 3) WHERE n.old_rev IS NULL AND g.new_rev IS NULL), cf AS (SELECT repo, seq, source, min(path) AS path FROM cp GROUP BY ALL)"""


def named_alike(before, after, file="[^/]+$"):
    """Copies (repo, seq, path, source) as a log that looks for equal file names would note them."""
    part = lambda df, other, name: df.join(other, ["repo", "seq", "path"], "left_anti").select("repo", "seq", F.col("path").alias(name), F.regexp_extract("path", file, 0).alias("file"))
    return part(after, before, "path").join(part(before, after, "source"), ["repo", "seq", "file"]).drop("file")


@query("j6_snapshot_diff", TREES.replace("'/f' || (o_custkey % 500)", "'/f' || (o_custkey % 50)") + COPIED + """, ren AS (SELECT o.repo, o.seq, o.name, min(cf.source) AS source FROM o JOIN cf ON cf.repo = o.repo AND cf.seq = o.seq AND cf.path = o.name GROUP BY ALL) SELECT o.repo, o.seq, o.name, CASE WHEN old_rev IS NULL THEN CASE WHEN ren.source IS NULL THEN 'ADD' ELSE 'REN' END WHEN new_rev IS NULL THEN 'DEL' ELSE 'UPD' END AS action, ren.source AS old_name, old_rev, new_rev
    FROM o LEFT JOIN ren USING (repo, seq, name) WHERE (old_rev IS NULL OR new_rev IS NULL OR old_rev <> new_rev) AND NOT (new_rev IS NULL AND (o.repo, o.seq, o.name) IN (SELECT (repo, seq, source) FROM ren))""")
def diff(spark, sf):
    """Trees of which some paths move: a new path with the file name of one that went is noted as its copy."""
    path = F.format_string("c%d/s%d/f%d", F.col("o_custkey") % 13, F.col("o_custkey") % 4, F.col("o_custkey") % 50)
    trees = V.load(spark, sf, "orders").groupBy(F.concat(F.lit("r"), (F.col("o_custkey") % 3).cast("string")).alias("repo"), F.year("o_orderdate").cast("long").alias("seq"), path.alias("path")).agg((F.max("o_orderkey") % 7).cast("string").alias("rev"))
    before = trees.withColumn("seq", F.col("seq") + 1)
    return entries.snapshot_diff(before, trees, named_alike(before, trees)).select("repo", "seq", "name", "action", "old_name", "old_rev", "new_rev")


KNOWN = M + ", known AS (SELECT DISTINCT repo, name AS path FROM moves WHERE seq % 50 = 0 AND name NOT LIKE '%/f3')"


def known_paths(rows):
    return rows.where("seq % 50 = 0 AND name NOT LIKE '%/f3'").select("repo", F.col("name").alias("path"), F.lit("1.1").alias("rev")).distinct()


@query("j7_align_with_tree", KNOWN + """, a AS (SELECT m.*, k.path IS NOT NULL AS known, s.path IS NOT NULL AS src FROM moves m LEFT JOIN known k ON k.repo = m.repo AND k.path = m.name LEFT JOIN known s ON s.repo = m.repo AND s.path = m.old_name), b AS (SELECT * FROM a WHERE action <> 'DEL' OR known),
    t AS (SELECT DISTINCT repo, seq, name FROM b WHERE action = 'REN'), c AS (SELECT * FROM b WHERE action = 'REN' OR (repo, seq, name) NOT IN (SELECT (repo, seq, name) FROM t)), d AS (SELECT *, CASE WHEN action = 'REN' AND NOT src THEN 'ADD' ELSE action END AS act FROM c)
    SELECT repo, seq, pos, CASE WHEN act = 'ADD' AND known THEN 'UPD' WHEN act = 'UPD' AND NOT known THEN 'ADD' ELSE act END AS action, name, CASE WHEN NOT (action = 'REN' AND NOT src) THEN old_name END AS old_name FROM d""")
def align(spark, sf):
    rows = V.moves(spark, sf)
    return out(entries.align_with_tree(rows.withColumns({"is_directory": F.lit(False), "is_symlink": F.lit(False)}), known_paths(rows)))


@query("j8_skip_current", KNOWN + f" SELECT {E_COLS} FROM moves m LEFT JOIN known k ON k.repo = m.repo AND k.path = m.name WHERE NOT (action = 'UPD' AND k.path IS NOT NULL AND new_rev = '1.1') AND NOT (action = 'DEL' AND k.path IS NULL)".replace("repo, seq", "m.repo, seq"))
def current(spark, sf):
    rows = V.moves(spark, sf)
    return out(entries.skip_current(rows, known_paths(rows)))


@query("j9_attach_tags", V.sql("changes", "SELECT repo, seq, CASE WHEN seq % 4 = 0 THEN 't' || (seq % 7) || '|v' || (seq % 3) ELSE '' END AS tags FROM changes"))
def attach(spark, sf):
    rows = V.changes(spark, sf).select("repo", "seq", F.col("seq").cast("string").alias("revision"))
    tags = rows.where("seq % 4 = 0").select("repo", "revision", F.explode(F.array(F.concat(F.lit("v"), (F.col("seq") % 3).cast("string")), F.concat(F.lit("t"), (F.col("seq") % 7).cast("string")))).alias("tag"))
    return changesets.attach_tags(rows, tags).select("repo", "seq", F.concat_ws("|", "tags").alias("tags"))


@query("j10_find_applied", V.sql("ivals", "").rstrip() + """, man AS (SELECT repo, path, CAST(split_part(rev, '.', 2) AS INT) AS v FROM ivals WHERE from_seq <= 300 AND (to_seq IS NULL OR to_seq > 300)), a AS (SELECT c.repo, seq, NOT coalesce(bool_or(v < n), false) AND coalesce(bool_or(v >= n), false) AS applied FROM changes c LEFT JOIN man m ON m.repo = c.repo AND m.path = c.path GROUP BY 1, 2)
    SELECT repo, seq, applied, seq = coalesce(max(CASE WHEN applied THEN seq END) OVER (PARTITION BY repo), -1) AS last FROM a""")
def applied(spark, sf):
    rows = V.changes(spark, sf)
    return tree.find_applied(rows, tree.tree_at(tree.tree_intervals(rows), 300))


TAGGED = ", ft AS (SELECT repo, path, rev, 't' || s AS tag FROM ivals, (VALUES (50), (200), (500)) v(s) WHERE from_seq <= s AND (to_seq IS NULL OR to_seq > s))"


def file_tags(rows):
    intervals = stored(tree.tree_intervals(rows), "intervals")  # read once for each tag and again
    parts = [tree.tree_at(intervals, s).withColumn("tag", F.lit(f"t{s}")) for s in (50, 200, 500)]
    return intervals, parts[0].union(parts[1]).union(parts[2])


@query("j11_place_tags", V.sql("ivals", "").rstrip() + TAGGED + """, cnt AS (SELECT repo, tag, count(*) AS n FROM ft GROUP BY ALL), sp AS (SELECT repo, tag, max(from_seq) AS lo, min(coalesce(to_seq, 4611686018427387904)) AS hi FROM ft JOIN ivals USING (repo, path, rev) GROUP BY ALL),
    st AS (SELECT repo, seq, sum(d) AS d FROM (SELECT repo, from_seq AS seq, 1 AS d FROM ivals UNION ALL SELECT repo, to_seq, -1 FROM ivals WHERE to_seq IS NOT NULL) GROUP BY ALL HAVING sum(d) <> 0), lc AS (SELECT repo, seq, sum(d) OVER (PARTITION BY repo ORDER BY seq) AS live, coalesce(lead(seq) OVER (PARTITION BY repo ORDER BY seq), 4611686018427387904) AS until FROM st)
    SELECT repo, tag, CAST(greatest(lo, seq) AS BIGINT) AS from_seq, CAST(least(hi, until) AS BIGINT) AS to_seq FROM sp JOIN cnt USING (repo, tag) JOIN lc USING (repo) WHERE live = n AND until > lo AND seq < hi AND lo < hi""")
def place(spark, sf):
    return tree.place_tags(*file_tags(V.changes(spark, sf)))


SINCE = """, later AS (SELECT repo, path, rev, CASE WHEN from_seq <= 50 THEN -1 ELSE from_seq END AS from_seq, to_seq FROM ivals WHERE to_seq IS NULL OR to_seq > 50), cnt AS (SELECT repo, tag, count(*) AS n FROM ft GROUP BY ALL), sp AS (SELECT repo, tag, max(from_seq) AS lo, min(coalesce(to_seq, 4611686018427387904)) AS hi, count(*) AS m FROM ft JOIN later USING (repo, path, rev) GROUP BY ALL),
    st AS (SELECT * FROM (SELECT repo, seq, sum(d) AS d FROM (SELECT repo, from_seq AS seq, 1 AS d FROM later UNION ALL SELECT repo, to_seq, -1 FROM later WHERE to_seq IS NOT NULL) GROUP BY ALL) WHERE d <> 0), lc AS (SELECT repo, seq, sum(d) OVER (PARTITION BY repo ORDER BY seq) AS live, coalesce(lead(seq) OVER (PARTITION BY repo ORDER BY seq), 4611686018427387904) AS until FROM st),
    pl AS (SELECT repo, tag, CAST(greatest(lo, seq) AS BIGINT) AS from_seq, CAST(least(hi, until) AS BIGINT) AS to_seq FROM sp JOIN cnt USING (repo, tag) JOIN lc USING (repo) WHERE live = n AND m = n AND until > lo AND seq < hi AND lo < hi)
    SELECT repo, tag, from_seq, to_seq, CASE WHEN from_seq = -1 THEN '1900-01-01 00:00:00 by unknown tagger' END AS revision, CASE WHEN from_seq = -1 THEN concat('tag 1900-01-01 00:00:00+00:00 [', chr(39), tag, chr(39), ']') END AS log FROM pl"""


@query("j11_tags_before_first", V.sql("ivals", "").rstrip() + TAGGED + SINCE)
def place_since(spark, sf):
    """A history that goes on from the tree after changeset 50, which a tag fits."""
    rows = V.changes(spark, sf)
    intervals, tags = file_tags(rows)
    since = stored(tree.intervals_since(rows.where("seq > 50"), tree.tree_at(intervals, 50)), "since")
    placed = stored(tree.place_tags(since, tags), "placed")
    made = tree.tagging_changesets(placed).select("repo", F.col("seq").alias("from_seq"), "revision", "log")
    return placed.join(made, ["repo", "from_seq"], "left").select("repo", "tag", "from_seq", "to_seq", "revision", "log")


@query("j12_remap_authors", "SELECT event_id, CASE event_type WHEN 'click' THEN 'Clicker <c@x>' WHEN 'view' THEN 'Viewer <v@x>' ELSE event_type END AS author, CASE event_type WHEN 'click' THEN 'C' ELSE event_type END AS joined FROM events")
def remap(spark, sf):
    rows = V.load(spark, sf, "events").select("event_id", F.col("event_type").alias("author"))
    table = spark.createDataFrame([("click", "C")], "author string, new_author string")
    return changesets.remap_authors(rows, {"click": "Clicker <c@x>", "view": "Viewer <v@x>"}).join(changesets.remap_authors(rows, table).withColumnRenamed("author", "joined"), "event_id")


@query("j13_rebase_old_names", M + """, e AS (SELECT repo, seq, pos, action, CASE WHEN action = 'REN' AND pos < 2 THEN 'moved' || pos ELSE name END AS name, CASE WHEN action = 'REN' AND pos = 0 THEN split_part(old_name, '/', 1) WHEN action = 'REN' AND pos = 1 THEN split_part(old_name, '/', 1) || '/' || split_part(old_name, '/', 2) ELSE old_name END AS old_name FROM moves),
    one AS (SELECT repo, seq, old_name AS dir, name AS dst FROM e WHERE action = 'REN' AND pos = 0), two AS (SELECT repo, seq, old_name AS dir, name AS dst FROM e WHERE action = 'REN' AND pos = 1)
    SELECT e.repo, e.seq, pos, action, name, CASE WHEN action = 'REN' AND pos > 1 AND starts_with(old_name, two.dir || '/') THEN two.dst || substr(old_name, length(two.dir) + 1) WHEN action = 'REN' AND pos > 0 AND starts_with(old_name, one.dir || '/') THEN one.dst || substr(old_name, length(one.dir) + 1) ELSE old_name END AS old_name
    FROM e LEFT JOIN one ON one.repo = e.repo AND one.seq = e.seq LEFT JOIN two ON two.repo = e.repo AND two.seq = e.seq""")
def rebase_old(spark, sf):
    """A first rename moves a directory, a second one the directory below; all other entries are there too."""
    moves, pos = F.col("action") == "REN", F.col("pos")
    name = F.when(moves & (pos < 2), F.concat(F.lit("moved"), pos.cast("string"))).otherwise(F.col("name"))
    old = F.when(moves & (pos < 2), F.substring_index("old_name", "/", 1)).otherwise(F.col("old_name"))
    old = F.when(moves & (pos == 1), F.substring_index("old_name", "/", 2)).otherwise(old)
    return out(entries.rebase_old_names(V.moves(spark, sf).withColumns({"name": name, "old_name": old})))


@query("j14_expand_added_dir", M + ", t AS (SELECT DISTINCT repo, name AS path FROM moves), adds AS (SELECT repo, seq, min(split_part(name, '/', 1)) AS dir FROM moves WHERE pos = 0 AND seq % 20 = 0 GROUP BY ALL) SELECT repo, seq, dir AS name FROM adds UNION ALL SELECT a.repo, a.seq, t.path FROM adds a JOIN t ON t.repo = a.repo AND t.path LIKE a.dir || '/%'")
def expand(spark, sf):
    rows = V.moves(spark, sf)
    adds = rows.where("pos = 0 AND seq % 20 = 0").groupBy("repo", "seq").agg(F.min(F.substring_index("name", "/", 1)).alias("name")).withColumns({"pos": F.lit(0), "action": F.lit("ADD"), "is_directory": F.lit(True)})
    state = rows.select("repo", F.col("name").alias("path")).distinct()
    return entries.expand_added_dir(adds, state).select("repo", "seq", "name")


@query("j15_flag_deleted_dirs", V.sql("ivals", "").rstrip() + ", d AS (SELECT repo, seq, split_part(path, '/', 1) AS name FROM changes WHERE action = 'DEL') SELECT repo, seq, name, EXISTS (SELECT 1 FROM ivals i WHERE i.repo = d.repo AND i.path LIKE d.name || '/%' AND from_seq < d.seq AND (to_seq IS NULL OR to_seq >= d.seq)) AS is_directory FROM d")
def deleted_dirs(spark, sf):
    rows = V.changes(spark, sf)
    gone = rows.where("action = 'DEL'").select("repo", "seq", "action", F.substring_index("name", "/", 1).alias("name"))
    return tree.flag_deleted_dirs(gone, tree.tree_intervals(rows)).select("repo", "seq", "name", "is_directory")


@query("j16_rewrite_inverted", M + """, mv AS (SELECT repo, seq, pos, split_part(old_name, '/', 1) AS dir FROM moves WHERE action = 'REN'), hit AS (SELECT m.repo, m.seq, m.pos, max_by(v.dir, v.pos) AS dir, max(v.pos) AS at FROM moves m JOIN mv v ON v.repo = m.repo AND v.seq = m.seq AND v.pos < m.pos AND m.name LIKE v.dir || '/%' WHERE m.action <> 'REN' GROUP BY ALL)
    SELECT m.repo, m.seq, m.pos, CASE WHEN m.action = 'REN' THEN 'new' || m.pos WHEN h.dir IS NOT NULL THEN 'new' || h.at || substr(name, length(h.dir) + 1) ELSE name END AS name FROM moves m LEFT JOIN hit h USING (repo, seq, pos)""")
def inverted(spark, sf):
    """Every rename of a changeset is one of a whole directory."""
    moved = F.col("action") == "REN"
    rows = V.moves(spark, sf).withColumns({"name": F.when(moved, F.concat(F.lit("new"), F.col("pos").cast("string"))).otherwise(F.col("name")), "old_name": F.when(moved, F.substring_index("old_name", "/", 1)), "inverted": F.lit(True)})
    return entries.rewrite_inverted(rows).select("repo", "seq", F.col("pos").cast("long").alias("pos"), "name")


@query("j17_add_unlisted", TREES + " SELECT t.repo, t.seq, t.path AS name FROM trees t ANTI JOIN bef b ON b.repo = t.repo AND b.seq = t.seq AND b.path = t.path")
def unlisted(spark, sf):
    trees = V.trees(spark, sf)
    before = trees.withColumn("seq", F.col("seq") + 1)
    fresh = trees.join(before, ["repo", "seq", "path"], "left_anti")
    half = fresh.where("path LIKE '%1'").select("repo", "seq", F.lit(0).alias("pos"), F.lit("ADD").alias("action"), F.col("path").alias("name"), F.lit(None).cast("string").alias("old_name"))
    return entries.add_unlisted(half, before, trees).select("repo", "seq", "name")


# Orders and windows


@query("w2_tree_intervals", V.sql("ivals", "SELECT repo, path, rev, from_seq, to_seq FROM ivals"))
def intervals(spark, sf):
    return tree.tree_intervals(V.changes(spark, sf))


@query("w4_action_runs", M + ", x AS (SELECT *, CASE WHEN lag(action) OVER w <> action THEN 1 ELSE 0 END AS d FROM moves WINDOW w AS (PARTITION BY repo, seq ORDER BY pos)) SELECT repo, seq, pos, CAST(sum(d) OVER (PARTITION BY repo, seq ORDER BY pos) AS INT) AS run FROM x")
def runs(spark, sf):
    return entries.action_runs(V.moves(spark, sf)).select("repo", "seq", F.col("pos").cast("long").alias("pos"), "run")


@query("w5_first_rename_wins", M + " SELECT repo, seq, pos, CASE WHEN action = 'REN' AND k > 1 THEN 'ADD' ELSE action END AS action, name, CASE WHEN NOT (action = 'REN' AND k > 1) THEN old_name END AS old_name FROM (SELECT *, row_number() OVER (PARTITION BY repo, seq, old_name, action ORDER BY pos) AS k FROM moves)")
def first_rename(spark, sf):
    return out(entries.first_rename_wins(V.moves(spark, sf)))


@query("w6_order_entries_by_name", M + " SELECT repo, seq, row_number() OVER (PARTITION BY repo, seq ORDER BY action = 'DEL', name, pos) - 1 AS pos, action, name, old_name FROM moves")
def by_name(spark, sf):
    return out(entries.order_entries_by_name(V.moves(spark, sf)))


DELTAS = M + """, deltas AS (SELECT repo, seq, row_number() OVER (PARTITION BY repo, seq ORDER BY CASE action WHEN 'REN' THEN 0 WHEN 'ADD' THEN 1 WHEN 'DEL' THEN 2 ELSE 3 END, pos) - 1 AS pos, action, CASE WHEN pos % 3 = 1 THEN split_part(name, '/', 1) WHEN pos % 3 = 2 AND action <> 'UPD' THEN split_part(name, '/', 1) || '/' || split_part(name, '/', 2) ELSE name END AS name, old_name FROM moves),
    flags AS (SELECT *, length(name) < 6 AS dir, action IN ('REN', 'ADD') AND length(name) < 6 AS ent, len(string_split(name, '/')) AS depth FROM deltas)"""


@query("w7_order_directories_first", DELTAS + """, p AS (SELECT f.repo, f.seq, f.pos, any_value(f.action) AS action, any_value(f.name) AS name, any_value(f.old_name) AS old_name, any_value(f.dir) AS dir, any_value(f.ent) AS ent, any_value(f.depth) AS depth, least(f.pos, coalesce(min(x.pos), f.pos)) AS place
        FROM flags f LEFT JOIN flags x ON f.ent AND x.repo = f.repo AND x.seq = f.seq AND x.pos < f.pos AND starts_with(x.name, f.name || '/') GROUP BY f.repo, f.seq, f.pos),
    own AS (SELECT d.repo, d.seq, d.pos, any_value(d.name) AS name, any_value(d.dir) AS dir, coalesce(min(CASE WHEN a.pos IS NOT NULL THEN a.place * 2000000000 + a.depth END), any_value(d.pos) * 2000000000 + 1073741824) AS at FROM p d LEFT JOIN p a ON a.repo = d.repo AND a.seq = d.seq AND a.name = d.name AND a.action IN ('REN', 'ADD') AND a.pos < d.pos WHERE d.action = 'DEL' GROUP BY d.repo, d.seq, d.pos),
    del AS (SELECT d.repo, d.seq, d.pos, least(any_value(d.at), coalesce(min(o.at), any_value(d.at))) AS at, count(o.pos) AS nested FROM own d LEFT JOIN own o ON o.repo = d.repo AND o.seq = d.seq AND o.dir AND o.pos < d.pos AND starts_with(d.name, o.name) GROUP BY d.repo, d.seq, d.pos),
    k AS (SELECT p.repo, p.seq, p.pos, action, name, old_name, ent, coalesce(d.at // 2000000000, place) AS place, coalesce(d.at // 2000000000, place) = p.pos AS stays, CASE WHEN action = 'DEL' AND d.at // 2000000000 < p.pos THEN d.at % 2000000000 WHEN ent THEN depth ELSE 1073741824 END AS level, coalesce(d.nested, 0) AS nested FROM p LEFT JOIN del d USING (repo, seq, pos))
    SELECT repo, seq, row_number() OVER (PARTITION BY repo, seq ORDER BY place, level, stays AND NOT ent, ent, -nested, pos) - 1 AS pos, action, name, old_name FROM k""")
def dirs_first(spark, sf):
    """Changesets as delta lists with directories at two depths."""
    pos, top = F.col("pos"), F.substring_index("name", "/", 1)
    rank = F.element_at(F.create_map(*(F.lit(x) for x in ("REN", 0, "ADD", 1, "DEL", 2, "UPD", 3))), F.col("action"))
    name = F.when(pos % 3 == 1, top).when((pos % 3 == 2) & (F.col("action") != "UPD"), F.substring_index("name", "/", 2)).otherwise(F.col("name"))
    rows = V.moves(spark, sf).withColumns({"name": name, "pos": F.row_number().over(Window.partitionBy("repo", "seq").orderBy(rank, "pos")) - 1})
    return out(folds.order_directories_first(rows.withColumn("is_directory", F.length("name") < 6)))


@query("w8_rename_before_dir_delete", DIRS + """, f AS (SELECT m.repo, m.seq, m.pos, min(d.pos) AS first_at FROM dirs m JOIN dirs d ON d.repo = m.repo AND d.seq = m.seq AND d.action = 'DEL' AND m.action = 'REN' AND m.old_name LIKE d.name || '/%' GROUP BY ALL)
    SELECT repo, seq, row_number() OVER (PARTITION BY repo, seq ORDER BY least(pos, coalesce(first_at - 0.5, pos)), pos) - 1 AS pos, action, name, old_name FROM dirs LEFT JOIN f USING (repo, seq, pos)""")
def before_delete(spark, sf):
    return out(entries.rename_before_dir_delete(with_dirs(spark, sf)))


#: Folding walked step by step over a list of what has been touched (no path of ``moves`` lies below another).
FOLDED = """, n AS (SELECT *, max(pos) OVER (PARTITION BY repo, seq) AS last FROM moves),
    w(repo, seq, k, last, t) AS (SELECT repo, seq, CAST(-1 AS BIGINT), any_value(last), CAST([] AS STRUCT(place BIGINT, src VARCHAR, path VARCHAR, here BOOLEAN, gone BOOLEAN, upd BOOLEAN, void BOOLEAN, moved BOOLEAN)[]) FROM n GROUP BY repo, seq
        UNION ALL SELECT repo, seq, pos, last, CASE
            WHEN action = 'ADD' AND len(lefts) > 0 THEN list_transform(t, lambda x: CASE WHEN x.gone AND x.src = name THEN {place: x.place, src: NULL, path: x.path, here: x.here, gone: false, upd: false, void: x.void, moved: true} ELSE x END)
            WHEN action = 'ADD' AND len(at_name) > 0 AND at_name[1].src IS NULL THEN t
            WHEN action = 'ADD' AND len(at_name) > 0 THEN list_append(list_transform(t, lambda x: CASE WHEN x.here AND x.path = name THEN {place: x.place, src: x.src, path: x.path, here: false, gone: false, upd: x.upd, void: true, moved: x.moved} WHEN x.src = at_name[1].src THEN {place: x.place, src: x.src, path: x.path, here: x.here, gone: false, upd: x.upd, void: x.void, moved: x.moved} ELSE x END), {place: at_name[1].place, src: NULL, path: name, here: true, gone: false, upd: false, void: false, moved: false})
            WHEN action = 'ADD' THEN list_append(t, {place: pos, src: NULL, path: name, here: true, gone: false, upd: false, void: false, moved: false})
            WHEN action = 'DEL' AND len(at_name) = 0 THEN list_append(t, {place: pos, src: name, path: NULL, here: false, gone: false, upd: false, void: false, moved: false})
            WHEN action = 'DEL' AND at_name[1].src IS NULL THEN list_transform(t, lambda x: CASE WHEN x.here AND x.path = name THEN {place: x.place, src: x.src, path: x.path, here: false, gone: x.gone, upd: x.upd, void: true, moved: x.moved} ELSE x END)
            WHEN action = 'DEL' THEN list_transform(t, lambda x: CASE WHEN x.here AND x.path = name THEN {place: x.place, src: x.src, path: NULL, here: false, gone: false, upd: x.upd, void: x.void, moved: x.moved} WHEN x.src = at_name[1].src THEN {place: x.place, src: x.src, path: x.path, here: x.here, gone: false, upd: x.upd, void: x.void, moved: x.moved} ELSE x END)
            WHEN action = 'REN' AND len(at_old) = 0 AND len(at_name) > 0 AND at_name[1].src IS NULL THEN t
            WHEN action = 'REN' AND len(at_old) = 0 THEN list_append(list_transform(t, lambda x: {place: x.place, src: x.src, path: x.path, here: x.here AND x.path <> name, gone: x.gone AND x.src <> old_name, upd: x.upd, void: x.void, moved: x.moved}), {place: pos, src: old_name, path: name, here: true, gone: true, upd: false, void: false, moved: true})
            WHEN action = 'REN' THEN list_transform(t, lambda x: CASE WHEN x.here AND x.path = old_name THEN {place: x.place, src: x.src, path: name, here: true, gone: x.gone, upd: x.upd, void: x.void, moved: x.moved} ELSE {place: x.place, src: x.src, path: x.path, here: x.here AND x.path <> name, gone: x.gone, upd: x.upd, void: x.void, moved: x.moved} END)
            WHEN len(at_name) > 0 AND at_name[1].src IS NULL THEN t
            ELSE list_append(t, {place: pos, src: NULL, path: name, here: false, gone: false, upd: true, void: false, moved: false}) END
        FROM (SELECT w.repo, w.seq, n.pos, n.last, w.t, n.action, n.name, n.old_name, list_filter(w.t, lambda x: x.gone AND x.src = n.name) AS lefts, list_filter(w.t, lambda x: x.here AND x.path = n.name) AS at_name, list_filter(w.t, lambda x: x.here AND x.path = n.old_name) AS at_old FROM w JOIN n ON n.repo = w.repo AND n.seq = w.seq AND n.pos = w.k + 1)),
    e AS (SELECT repo, seq, x.place AS place, x.upd AS upd, CASE WHEN x.upd THEN 'UPD' WHEN x.path IS NULL THEN 'DEL' WHEN x.src IS NULL THEN 'ADD' ELSE 'REN' END AS action, coalesce(x.path, x.src) AS name, CASE WHEN x.path IS NOT NULL THEN x.src END AS old_name FROM (SELECT repo, seq, unnest(t) AS x FROM w WHERE k = last) WHERE NOT x.void),
    o AS (SELECT *, min(place) OVER (PARTITION BY repo, seq, name) AS low, bool_or(action = 'ADD') OVER (PARTITION BY repo, seq, name) AS added FROM e)
    SELECT repo, seq, row_number() OVER (PARTITION BY repo, seq ORDER BY CASE WHEN action = 'ADD' THEN low ELSE place END, action <> 'ADD', place) - 1 AS pos, action, name, old_name FROM o WHERE NOT (upd AND added)"""


@query("e1_fold_patch_entries", M.replace("WITH ", "WITH RECURSIVE ", 1) + FOLDED)
def fold(spark, sf):
    return out(folds.fold_patch_entries(V.moves(spark, sf).withColumn("is_directory", F.lit(False))))


@query("e2_collapse_replacements", M + f" SELECT {E_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY repo, seq, name, action ORDER BY pos) AS k, least(count(*) FILTER (WHERE action = 'DEL') OVER p, count(*) FILTER (WHERE action = 'ADD') OVER p) AS pairs FROM moves WINDOW p AS (PARTITION BY repo, seq, name)) WHERE action NOT IN ('ADD', 'DEL') OR k > pairs")
def collapse_replaced(spark, sf):
    return out(entries.collapse_replacements(V.moves(spark, sf)))


@query("e3_readd_to_update", M + " SELECT repo, seq, pos, CASE WHEN action = 'DEL' AND nxt = 'ADD' THEN 'UPD' ELSE action END AS action, name, old_name FROM (SELECT *, lead(action) OVER w AS nxt, lag(action) OVER w AS prv FROM moves WINDOW w AS (PARTITION BY repo, seq, name ORDER BY pos)) WHERE NOT (action = 'ADD' AND coalesce(prv = 'DEL', false))")
def readd(spark, sf):
    return out(entries.readd_to_update(V.moves(spark, sf)))


@query("o4_removal_order", M + " SELECT repo, seq, row_number() OVER (PARTITION BY repo, seq ORDER BY name DESC, k) - 1 AS pos, name FROM (SELECT repo, seq, name, pos AS k FROM moves WHERE action = 'DEL')")
def removal(spark, sf):
    return entries.removal_order(V.moves(spark, sf)).select("repo", "seq", F.col("pos").cast("long").alias("pos"), "name")


# Aggregates

NUM = "CAST(split_part({0}, '.', 2) AS INT)"


@query("a3_merge_double_delete", M + f", g AS (SELECT repo, seq, min(pos) AS pos, action, name, '1.' || max({NUM.format('new_rev')}) AS new_rev FROM moves WHERE action = 'DEL' GROUP BY repo, seq, name, action) SELECT repo, seq, pos, action, name, new_rev FROM g UNION ALL SELECT repo, seq, pos, action, name, new_rev FROM moves WHERE action <> 'DEL'")
def double_delete(spark, sf):
    return entries.merge_double_delete(V.moves(spark, sf)).select("repo", "seq", F.col("pos").cast("long").alias("pos"), "action", "name", "new_rev")


@query("a4_merge_members", M + f", m AS (SELECT repo, seq, pos, name, pos = 0 AS initial, CASE WHEN pos = 0 THEN 0 ELSE {NUM.format('old_rev')} END AS o, {NUM.format('new_rev')} AS n, action = 'DEL' AS dead FROM moves), g AS (SELECT repo, seq, name, min_by(initial, o * 100000 + (CASE WHEN initial THEN -50000 ELSE 0 END) + pos) AS initial, max_by(dead, n * 100000 + pos) AS dead, max(n) AS n FROM m GROUP BY 1, 2, 3) SELECT repo, seq, name, CASE WHEN dead THEN 'DEL' WHEN initial THEN 'ADD' ELSE 'UPD' END AS action, '1.' || n AS new_rev FROM g")
def members(spark, sf):
    rows = V.moves(spark, sf).withColumns({"old_rev": F.when(F.col("pos") == 0, "INITIAL").otherwise(F.col("old_rev")), "new_rev": F.when(F.col("action") == "DEL", F.concat("new_rev", F.lit("(DEAD)"))).otherwise(F.col("new_rev"))})
    return entries.merge_members(rows).select("repo", "seq", "name", "action", "new_rev")


@query("a5_tag_file_counts", V.sql("ivals", "").rstrip() + TAGGED + " SELECT repo, tag, count(DISTINCT path) AS n_files FROM ft GROUP BY 1, 2")
def tag_counts(spark, sf):
    return tree.tag_file_counts(file_tags(V.changes(spark, sf))[1])


@query("a7_youngest_entry", V.sql("revs", "SELECT repo, max_by(path, date_utc) AS path, max_by(rev, date_utc) AS rev FROM revs GROUP BY 1"))
def youngest(spark, sf):
    return tree.youngest_entry(V.revs(spark, sf).select("repo", "path", "rev", F.col("date_utc").alias("ts"))).select("repo", "path", "rev")


@query("a9_paths_by_revision", M + f" SELECT repo, seq, new_rev, string_agg(name, '|' ORDER BY name) AS names, CAST(row_number() OVER (PARTITION BY repo, seq ORDER BY {NUM.format('new_rev')}) - 1 AS INT) AS place FROM moves GROUP BY repo, seq, new_rev")
def by_revision(spark, sf):
    return entries.paths_by_revision(V.moves(spark, sf)).select("repo", "seq", "new_rev", F.concat_ws("|", "names").alias("names"), "place")


@query("a10_split_snapshot_by_depth", V.sql("trees", "SELECT repo, path, split_part(path, '/', 1) AS part_dir, CAST(dense_rank() OVER (PARTITION BY repo ORDER BY split_part(path, '/', 1)) - 1 AS INT) AS part FROM (SELECT DISTINCT repo, path FROM trees)"))
def split_tree(spark, sf):
    return tree.split_snapshot_by_depth(V.trees(spark, sf).select("repo", "path").distinct(), 0).select("repo", "path", "part_dir", "part")


def tagged_changes(spark, sf):
    tags = F.when(F.col("seq") % 5 == 0, F.array(F.concat(F.lit("t"), (F.floor(F.col("seq") / 10) % 4).cast("string")))).otherwise(F.array().cast("array<string>"))
    return V.changes(spark, sf).withColumns({"tags": tags, "tag_only": F.col("seq") % 5 == 0})


@query("a11_first_seen_tags", V.sql("changes", "SELECT repo, 't' || ((seq // 10) % 4) AS tag, min(seq) AS seq FROM changes WHERE seq % 5 = 0 GROUP BY 1, 2"))
def first_tags(spark, sf):
    return changesets.first_seen_tags(tagged_changes(spark, sf))


@query("w9_suppress_repeat_tags", V.sql("changes", ", st AS (SELECT repo, seq, 't' || ((seq // 10) % 4) AS tag, sum(CASE WHEN seq % 5 = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY repo ORDER BY seq) AS state FROM changes) SELECT repo, seq, tag FROM (SELECT *, lag(state) OVER (PARTITION BY repo, tag ORDER BY seq) AS prv FROM st WHERE seq % 5 = 0) WHERE prv IS NULL OR prv <> state").replace("  ,", " ,").replace(") , st", "), st"))
def repeat_tags(spark, sf):
    return changesets.suppress_repeat_tags(tagged_changes(spark, sf))


@query("w10_revision_ids", V.sql("changes", "SELECT repo, seq, strftime(date_utc, '%Y-%m-%d %H:%M:%S') || ' by ' || author AS revision, CAST(epoch(date_trunc('second', date_utc)) AS BIGINT) AS at, author AS who FROM changes"))
def revision_ids(spark, sf):
    rows = changesets.revision_ids(V.changes(spark, sf))
    at, who = changesets.parse_revision_id(F.col("revision"))
    return rows.select("repo", "seq", "revision", F.unix_seconds(at).alias("at"), who.alias("who"))


@query("w11_resolve_tag_clash", V.sql("changes", "SELECT repo, tag, max(seq) AS late, min(seq) AS early, count(*) > 1 AS clash FROM (SELECT repo, seq, 't' || (seq % 40) AS tag FROM changes) GROUP BY 1, 2"))
def tag_clash(spark, sf):
    tags = V.changes(spark, sf).select("repo", "seq", F.concat(F.lit("t"), (F.col("seq") % 40).cast("string")).alias("tag"))
    late = changesets.resolve_tag_clash(tags, True).select("repo", "tag", F.col("seq").alias("late"))
    return late.join(changesets.resolve_tag_clash(tags).select("repo", "tag", F.col("seq").alias("early"), "clash"), ["repo", "tag"])


@query("a12_commit_paths", M + " SELECT repo, seq, string_agg(CASE WHEN action = 'REN' THEN old_name || '|' || name ELSE name END, '|' ORDER BY action <> 'ADD', pos) AS paths FROM moves GROUP BY 1, 2")
def commit_paths(spark, sf):
    return entries.commit_paths(V.moves(spark, sf)).select("repo", "seq", F.concat_ws("|", "paths").alias("paths"))


# Directories and checks

DIRSQL = V.sql("ivals", "").rstrip() + """, dv AS (SELECT repo, split_part(path, '/', 1) AS path, from_seq, to_seq FROM ivals), st AS (SELECT repo, path, seq, sum(d) AS d FROM (SELECT repo, path, from_seq AS seq, 1 AS d FROM dv UNION ALL SELECT repo, path, to_seq, -1 FROM dv WHERE to_seq IS NOT NULL) GROUP BY ALL),
    lv AS (SELECT *, sum(d) OVER (PARTITION BY repo, path ORDER BY seq) AS live FROM st), ch AS (SELECT repo, path, seq, CASE WHEN live - d = 0 AND live > 0 THEN 'ADD' WHEN live - d > 0 AND live = 0 THEN 'DEL' END AS action FROM lv)"""


DEEPSQL = DIRSQL.replace("to_seq FROM ivals), st AS", "to_seq FROM ivals UNION ALL SELECT repo, replace(path, '/f', '/e'), from_seq, to_seq FROM ivals), st AS")


def deeper(spark, sf):
    """Each file in a directory of its own, which comes and goes with it, below one of ten."""
    name = F.concat(F.replace("path", F.lit("/f"), F.lit("/e")), F.lit("/x"))
    return V.changes(spark, sf).withColumns({"path": name, "name": name})


@query("d1_synthesize_dir_adds", DEEPSQL + " SELECT repo, seq, path FROM ch WHERE action = 'ADD'")
def dir_adds(spark, sf):
    return tree.synthesize_dir_adds(deeper(spark, sf))


@query("d2_synthesize_dir_deletes", DEEPSQL + " SELECT repo, seq, path FROM ch WHERE action = 'DEL'")
def dir_deletes(spark, sf):
    return tree.synthesize_dir_deletes(tree.tree_intervals(deeper(spark, sf)))


@query("d2_directory_changes", DIRSQL + " SELECT repo, path, seq, action FROM ch WHERE action IS NOT NULL")
def dir_changes(spark, sf):
    return tree.directory_changes(tree.tree_intervals(V.changes(spark, sf)))


def year_moves(spark, sf):
    """Every file of year y moves from its directory to one named by the next year."""
    files = V.trees(spark, sf).select("repo", "path").distinct()
    w = Window.partitionBy("repo", "seq").orderBy("path")
    rows = files.select("repo", "path", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("y")).withColumn("file", F.regexp_extract("path", "[^/]+$", 0))
    where = lambda y: F.concat(F.substring_index("path", "/", 1), F.lit("-"), y.cast("string"), F.lit("/"), F.replace("path", F.lit("/"), F.lit("_")))
    return rows.select("repo", F.col("y").cast("long").alias("seq"), F.when(F.col("y") == 0, "ADD").otherwise("REN").alias("action"), where(F.col("y")).alias("name"), F.when(F.col("y") > 0, where(F.col("y") - 1)).alias("old_name"), F.lit("1").alias("new_rev"), "path").withColumn("pos", F.row_number().over(w) - 1)


@query("d3_detect_dir_renames", V.sql("trees", "SELECT repo, CAST(y AS BIGINT) AS seq, split_part(path, '/', 1) || '-' || (y - 1) AS old_name, split_part(path, '/', 1) || '-' || y AS name FROM trees, range(1, 4) r(y) GROUP BY ALL"))
def dir_renames(spark, sf):
    rows = year_moves(spark, sf)
    return tree.detect_dir_renames(rows, tree.tree_intervals(rows)).where("is_directory").select("repo", "seq", "old_name", "name")


@query("q1_find_conflicts", V.sql("ivals", "SELECT c.repo, c.seq, c.path, i.rev AS live_rev FROM changes c LEFT JOIN ivals i ON i.repo = c.repo AND i.path = c.path AND from_seq < c.seq AND (to_seq IS NULL OR to_seq >= c.seq) WHERE c.n > 1 AND i.rev IS DISTINCT FROM '1.' || (c.n - 1)"))
def conflicts(spark, sf):
    rows = V.changes(spark, sf).withColumn("old_rev", F.when(F.col("n") > 1, F.format_string("1.%d", F.col("n") - 1)))
    return tree.find_conflicts(rows, tree.tree_intervals(rows)).select("repo", "seq", "path", "live_rev")


@query("q2_leftover_check", V.sql("trees", "SELECT CASE WHEN side = 1 THEN 'expected' ELSE 'actual' END AS side, count(*) AS n FROM (SELECT 1 AS side, seq FROM trees WHERE seq = (SELECT min(seq) FROM trees) UNION ALL SELECT 2, seq FROM trees WHERE seq = (SELECT max(seq) FROM trees)) GROUP BY 1"))
def leftover(spark, sf):
    trees = V.trees(spark, sf)
    ends = trees.agg(F.min("seq").alias("low"), F.max("seq").alias("high"))
    old, new = (trees.join(ends, trees["seq"] == ends[c], "left_semi") for c in ("low", "high"))
    return tree.leftover_check(old, new).groupBy("side").agg(F.count("*").alias("n"))


Q3_SQL = TREES + ", a AS (SELECT repo, seq || '/' || path AS path, rev FROM bef WHERE path NOT LIKE '%/s1/%'), b AS (SELECT repo, seq || '/' || path AS path, rev FROM trees WHERE path NOT LIKE '%/s1/%') SELECT repo, path, CASE WHEN b.rev IS NULL THEN 'missing' WHEN a.rev IS NULL THEN 'extra' ELSE 'changed' END AS kind FROM a FULL JOIN b USING (repo, path) WHERE a.rev IS DISTINCT FROM b.rev"


@query("q3_verify_trees", Q3_SQL)
def verify_trees(spark, sf):
    trees = V.trees(spark, sf)
    at = lambda df: df.select("repo", F.concat(F.col("seq").cast("string"), F.lit("/"), "path").alias("path"), F.col("rev").alias("hash"))
    return tree.verify_trees(at(trees.withColumn("seq", F.col("seq") + 1)), at(trees), ("s1",))


@query("q3_verify_stored_trees", Q3_SQL.replace("WHERE path NOT LIKE '%/s1/%'", ""))
def verify_stored(spark, sf):
    """The same trees, all of their directories, stored with digests and compared from the top."""
    trees, base = V.trees(spark, sf), f"{shared_dir(spark)}/trees-{uuid.uuid4().hex}"
    at = lambda df: df.select("repo", F.concat(F.col("seq").cast("string"), F.lit("/"), "path").alias("path"), F.col("rev").alias("hash"))
    digests.store_tree(at(trees.withColumn("seq", F.col("seq") + 1)), f"{base}/source")
    digests.store_tree(at(trees), f"{base}/target")
    return digests.verify_stored_trees(spark, f"{base}/source", f"{base}/target")


@query("q4_verify_logs", V.sql("logs", "SELECT 'expected' AS side, role AS author, count(*) AS n FROM logs WHERE turn % 7 = 3 GROUP BY 2 UNION ALL SELECT 'actual', 'new ' || role, count(*) FROM logs WHERE turn % 5 = 1 GROUP BY 2"))
def verify_logs(spark, sf):
    """The target lacks some logs, has some of other authors, and other white space at line ends."""
    source = V.logs(spark, sf).select(F.col("conv_id").cast("string").alias("repo"), F.col("role").alias("author"), "log", "turn")
    new = source.where("turn % 5 = 1").withColumn("author", F.concat(F.lit("new "), "author"))
    target = source.where("turn % 7 <> 3").union(new).withColumn("log", F.concat("log", F.lit(" \n ")))
    return tree.verify_logs(source, target).groupBy("side", "author").agg(F.count("*").alias("n"))


@query("q5_quarantine_bad", "SELECT CASE WHEN event_type = 'error' AND value < 0 THEN 'kind,value' WHEN event_type = 'error' THEN 'kind' WHEN value < 0 THEN 'value' ELSE '' END AS errors, count(*) AS n FROM events GROUP BY 1")
def quarantine(spark, sf):
    good, bad = tree.quarantine_bad(V.load(spark, sf, "events"), {"kind": F.col("event_type") != "error", "value": F.col("value") >= 0})
    rows = bad.select(F.concat_ws(",", "errors").alias("errors")).union(good.select(F.lit("")))
    return rows.groupBy("errors").agg(F.count("*").alias("n"))


# Sets, ends and graphs


@query("u1_missing_changesets", V.sql("changes", "SELECT repo, seq FROM changes WHERE seq % 3 = 1"))
def missing(spark, sf):
    rows = V.changes(spark, sf).withColumn("revision", F.when(F.col("seq") % 2 == 0, F.col("event_id").cast("string")))
    return changesets.missing_changesets(rows, rows.where("seq % 3 <> 1")).select("repo", "seq")


@query("u3_tags_common_to_all", V.sql("ivals", "").rstrip() + TAGGED + ", t AS (SELECT repo, path, rev FROM ivals WHERE from_seq <= 200 AND (to_seq IS NULL OR to_seq > 200)) SELECT t.repo, tag FROM t JOIN ft USING (repo, path, rev) GROUP BY t.repo, tag HAVING count(DISTINCT path) = (SELECT count(*) FROM t u WHERE u.repo = t.repo)")
def common(spark, sf):
    intervals, tags = file_tags(V.changes(spark, sf))
    return tree.tags_common_to_all(tree.tree_at(intervals, 200), tags)


@query("u4_union_projects", "SELECT repo, count(*) AS n FROM (SELECT 'shop' AS repo FROM orders UNION ALL SELECT 'site' FROM events WHERE event_type <> 'error') GROUP BY 1 UNION ALL SELECT 'gone', 0")
def projects(spark, sf):
    from changeloom.operators.projects import ProjectSpec, union_projects

    specs = [
        ProjectSpec("shop", lambda s: V.load(s, sf, "orders").select(F.col("o_orderkey").alias("seq"))),
        ProjectSpec("site", lambda s: V.load(s, sf, "events").select(F.col("event_id").alias("seq"), "event_type"), [lambda df: df.where("event_type <> 'error'")]),
        ProjectSpec("gone", lambda s: V.load(s, sf, "no_such_table")),
    ]
    rows, status = union_projects(spark, specs)
    return status.join(rows.groupBy("repo").agg(F.count("*").alias("n")), "repo", "left").select("repo", F.coalesce("n", F.lit(0)).alias("n"))


@query("u5_branch_subset", V.sql("changes", "SELECT repo, seq FROM changes WHERE author = 'a1'"))
def branches(spark, sf):
    return changesets.branch_subset(V.changes(spark, sf).withColumn("branches", F.array("author", F.lit("all"))), ["a1", "other"]).select("repo", "seq")


@query("o3_first_and_head", V.sql("changes", "SELECT repo, min_by(event_id, seq) AS first, max_by(event_id, seq) AS head FROM changes GROUP BY 1"))
def ends(spark, sf):
    rows = V.changes(spark, sf).select("repo", "seq", "event_id")
    return changesets.first_changeset(rows).select("repo", F.col("event_id").alias("first")).join(changesets.head_changeset(rows).select("repo", F.col("event_id").alias("head")), "repo")


TOPO = V.sql("dag", "").rstrip() + ", lv AS (SELECT repo, child AS revision, row_number() OVER (PARTITION BY user_id ORDER BY child) - 1 AS level FROM (SELECT CAST(user_id % 4 AS VARCHAR) AS repo, user_id, event_id AS child FROM events))"


@query("o2_topo_order", TOPO + " SELECT repo, revision, level, row_number() OVER (PARTITION BY repo ORDER BY level, revision) - 1 AS seq FROM lv")
def topo(spark, sf):
    nodes = V.load(spark, sf, "events").select((F.col("user_id") % 4).cast("string").alias("repo"), F.col("event_id").alias("revision"))
    return graph.topo_order(V.edges(spark, sf), nodes)


@query("u2_reachable", "SELECT CAST(user_id % 4 AS VARCHAR) AS repo, event_id AS revision FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k > 1")
def reach(spark, sf):
    """All that came before each user's last event: as deep as histories are long."""
    roots = V.load(spark, sf, "events").groupBy("user_id").agg(F.max("event_id").alias("revision")).select((F.col("user_id") % 4).cast("string").alias("repo"), "revision")
    return graph.reachable(V.edges(spark, sf), roots)


@query("w3_linearize", TOPO + ", b AS (SELECT repo, revision, row_number() OVER (PARTITION BY repo ORDER BY level, revision) - 1 AS seq FROM lv) SELECT repo, revision, seq, coalesce(lag(revision) OVER (PARTITION BY repo ORDER BY seq), -1) AS lin_parent FROM b WHERE revision % 3 = 0")
def linear(spark, sf):
    nodes = V.load(spark, sf, "events").select((F.col("user_id") % 4).cast("string").alias("repo"), F.col("event_id").alias("revision"))
    sets = nodes.withColumn("branches", F.when(F.col("revision") % 3 == 0, F.array(F.lit("b"))).otherwise(F.array(F.lit("c"))))
    return graph.linearize(sets, graph.topo_order(V.edges(spark, sf), nodes), "b", start=-1).select("repo", "revision", "seq", "lin_parent")


@query("o5_graft_branch", V.sql("changes", "SELECT repo, seq, coalesce(lag(CAST(event_id AS VARCHAR)) OVER (PARTITION BY repo ORDER BY seq), 'base') AS lin_parent FROM changes WHERE repo <> '3'"))
def graft(spark, sf):
    rows = V.changes(spark, sf).withColumn("revision", F.col("event_id").cast("string"))
    parents = rows.where("repo <> '3'").select("repo", F.lit("base").alias("revision")).distinct()
    return graph.graft_branch(rows, "base", parents).select("repo", "seq", "lin_parent")


# Destinations and hooks


@query("k2_render_commits", V.sql("changes", "SELECT repo, seq, path || chr(10) || log || chr(10) || 'Original author: ' || author || chr(10) || 'Date: ' || strftime(date_utc, '%Y-%m-%d %H:%M:%S') || ' UTC' AS plain, log || chr(10) || 'Date: ' || strftime(date_utc, '%Y-%m-%d %H:%M:%S') || ' UTC' AS dated FROM changes"))
def commits(spark, sf):
    rows = V.changes(spark, sf).select("repo", "seq", "author", "date_utc", "log", F.col("path").alias("name"))
    plain = adapt.render_commits(rows, "plain").withColumnRenamed("message", "plain")
    return adapt.render_commits(plain.withColumn("name", F.lit("")), "date").select("repo", "seq", "plain", F.col("message").alias("dated"))


@query("k3_render_commit_meta", V.sql("changes", "SELECT repo, seq, strftime(date_utc, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(date_utc + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') || ' +0130' AS zone, strftime(date_utc, '%Y/%m/%d %H:%M:%S') || ' UTC' AS slash, CAST(CAST(epoch(date_trunc('second', date_utc)) AS BIGINT) AS VARCHAR) || ' -5400' AS epoch, author || ' x' AS author FROM changes"))
def meta(spark, sf):
    rows = V.changes(spark, sf).withColumns({"tz_offset_min": F.lit(90), "author": F.concat("author", F.lit("\n x"))})
    styles = ("iso", "zone", "slash", "epoch")
    dates = [adapt.commit_date(s, F.col("date_utc"), F.col("tz_offset_min")).alias(s) for s in styles]
    return adapt.render_commit_meta(rows, "iso").select("repo", "seq", *dates, F.col("commit_author").alias("author"))


@query("k4_write_tags", V.sql("changes", "SELECT repo, seq, 't' || ((seq // 10) % 4) AS target_tag FROM changes WHERE seq % 5 = 0"))
def tags(spark, sf):
    return adapt.write_tags(tagged_changes(spark, sf), "file").select("repo", "seq", "target_tag")


@query("k5_render_mark_empty", V.sql("changes", "SELECT repo, seq, CASE WHEN seq % 5 <> 0 AND seq % 3 = 0 THEN log || chr(10) || '(no files changed)' ELSE log END AS log FROM changes"))
def mark_empty(spark, sf):
    rows = tagged_changes(spark, sf)
    return adapt.render_mark_empty(rows, rows.where("seq % 3 <> 0")).select("repo", "seq", "log")


@query("k1_write_history", V.sql("changes", "SELECT repo, seq, path AS name, action, log FROM changes"))
def history(spark, sf):
    import uuid

    from changeloom.storage import shared_dir

    rows, path = V.changes(spark, sf), f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
    adapt.write_history(rows.select("repo", "seq", "log"), rows.select("repo", "seq", "pos", "action", "name"), path)
    read = lambda n: spark.read.option("basePath", f"{path}/{n}").schema({"changesets": "seq long, log string, repo string", "entries": "seq long, pos int, action string, name string, repo string"}[n]).parquet(f"{path}/{n}")
    return read("changesets").join(read("entries"), ["repo", "seq"]).select("repo", "seq", "name", "action", "log")


@query("h1_before_hooks", V.sql("changes", "SELECT repo, seq, upper(author) AS author, 'x ' || log AS log FROM changes WHERE log <> 'drop'"))
def hooks(spark, sf):
    chain = [lambda df: df.where("log <> 'drop'"), lambda df: df.withColumn("author", F.upper("author")), lambda df: df.withColumn("log", F.concat(F.lit("x "), "log"))]
    return adapt.before_hooks(V.changes(spark, sf), chain).select("repo", "seq", "author", "log")


@query("h3_content_hook", "SELECT doc_id, sha256(text) AS hash FROM documents")
def content(spark, sf):
    files = V.load(spark, sf, "documents").select("doc_id", F.lit("ADD").alias("action"), F.replace("text", F.lit("\n"), F.lit("\r\n")).alias("content"))
    return adapt.content_hook(files, adapt.unix_newlines).select("doc_id", F.sha2("content", 256).alias("hash"))


@query("t6_dedupe", V.sql("changes", "SELECT repo, seq FROM changes"))
def deduped(spark, sf):
    rows = V.changes(spark, sf).select("repo", "seq", F.col("event_id").cast("string").alias("revision"), "date_utc", "author", F.lit(None).cast("string").alias("patch_hash"))
    return changesets.dedupe(rows.union(rows.withColumn("patch_hash", F.lit("h")).where("seq % 4 = 0")).union(rows)).select("repo", "seq")


@query("t7_gate", V.sql("changes", "SELECT repo, seq FROM changes c WHERE seq < coalesce((SELECT min(seq) FROM changes d WHERE d.repo = c.repo AND d.path LIKE '%/f77'), 1000000000)"))
def gate(spark, sf):
    return adapt.gate(V.changes(spark, sf), ~F.endswith("path", F.lit("/f77"))).select("repo", "seq")


@query("t8_skip", V.sql("changes", "SELECT repo, seq, log <> 'drop' AS replayed FROM changes"))
def skipped(spark, sf):
    return adapt.skip(V.changes(spark, sf), F.col("log") != "drop").select("repo", "seq", "replayed")


@query("t10_bootstrap_then_follow", V.sql("changes", "SELECT repo, seq, seq = 100 AS snapshot, CASE WHEN seq = 100 THEN 'Import of src at ' || event_id ELSE log END AS log FROM changes WHERE seq >= 100"))
def bootstrap(spark, sf):
    from changeloom.streaming.follow import bootstrap_then_follow

    rows = V.changes(spark, sf).select("repo", "seq", F.col("event_id").cast("string").alias("revision"), "log")
    return bootstrap_then_follow(rows, 100, source="src").select("repo", "seq", "snapshot", "log")
