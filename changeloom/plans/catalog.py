"""The registered queries: each operator on the general tables, with SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.functions import scalars as S
from changeloom.functions.reflow import refill
from changeloom.operators import changesets
from changeloom.plans import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return put


def epoch(c: str):
    return F.unix_seconds(F.col(c).cast("timestamp"))


# The flagship: changesets of file revisions, and their size by author

LIST = "array_to_string(list_transform({0}, lambda x: CAST(x AS VARCHAR)), '.')"
GROUPED = """, sets AS (SELECT repo, date_utc, author, log, path, max(n) AS n, min_by(action, n) AS action FROM acts GROUP BY ALL),
    heads AS (SELECT repo, date_utc, author, log, min_by(action, path) AS fa FROM sets GROUP BY ALL),
    nums AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY date_utc, author, fa, log) - 1 AS seq FROM heads)"""
COLLAPSED = GROUPED + """, marks AS (SELECT *, coalesce(author = lag(author) OVER w AND log = lag(log) OVER w AND epoch_us(date_utc) - epoch_us(lag(date_utc) OVER w) < CAST({gap} AS BIGINT) * 1000000, false) AS near FROM nums WINDOW w AS (PARTITION BY repo ORDER BY seq)),
    isl AS (SELECT *, sum(CASE WHEN near THEN 0 ELSE 1 END) OVER (PARTITION BY repo ORDER BY seq) AS island FROM marks),
    grp AS (SELECT repo, seq, author, log, min(seq) OVER (PARTITION BY repo, island) AS grp, max(date_utc) OVER (PARTITION BY repo, island) AS gdate FROM isl)"""
SIX_HOURS = 21_600


@query("a2_changesets_by_author", V.sql("acts", "").rstrip() + COLLAPSED.format(gap=SIX_HOURS) + " SELECT repo, author, count(DISTINCT grp) AS n_groups, count(*) AS n_changesets FROM grp GROUP BY 1, 2")
def changesets_by_author(spark, sf):
    heads, _ = changesets.collect_by_key(V.acts(spark, sf))
    found = changesets.collapse_changesets(heads, seconds=SIX_HOURS)
    return found.groupBy("repo", "author").agg(F.countDistinct("group").alias("n_groups"), F.count("*").alias("n_changesets"))


@query("a2_collapse", V.sql("acts", "").rstrip() + COLLAPSED.format(gap=SIX_HOURS) + " SELECT repo, seq, grp AS grp, CAST(epoch(date_trunc('second', gdate)) AS BIGINT) AS group_date FROM grp")
def collapse(spark, sf):
    heads, _ = changesets.collect_by_key(V.acts(spark, sf))
    return changesets.collapse_changesets(heads, seconds=SIX_HOURS).select("repo", "seq", F.col("group").alias("grp"), epoch("group_date").alias("group_date"))


@query("a2_collapse_with_conflicts", V.sql("acts", "").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + COLLAPSED.format(gap=SIX_HOURS) + """,
    ents AS (SELECT i.repo, i.island, i.seq, s.path, s.action FROM isl i JOIN sets s USING (repo, date_utc, author, log)),
    steps AS (SELECT repo, island, seq, map_from_entries(list((path, action))) AS m, row_number() OVER (PARTITION BY repo, island ORDER BY seq) AS k FROM ents GROUP BY repo, island, seq),
    fold AS (SELECT repo, island, seq, k, 0 AS part, m AS held FROM steps WHERE k = 1
      UNION ALL SELECT s.repo, s.island, s.seq, s.k, CASE WHEN c.clash THEN f.part + 1 ELSE f.part END, CASE WHEN c.clash THEN s.m ELSE map_concat(f.held, s.m) END
      FROM fold f JOIN steps s ON s.repo = f.repo AND s.island = f.island AND s.k = f.k + 1,
      LATERAL (SELECT len(list_filter(map_keys(s.m), lambda x: f.held[x] IS NOT NULL AND f.held[x] <> s.m[x])) > 0 AS clash) c)
    SELECT repo, seq, min(seq) OVER (PARTITION BY repo, island, part) AS grp FROM fold""")
def collapse_with_conflicts(spark, sf):
    heads, ents = changesets.collect_by_key(V.acts(spark, sf))
    return changesets.collapse_changesets(heads, ents, seconds=SIX_HOURS).select("repo", "seq", F.col("group").alias("grp"))


@query("a1_collect_by_key", V.sql("acts", "").rstrip() + GROUPED + " SELECT n.repo, n.seq, s.path AS name, s.action, '1.' || s.n AS new_rev FROM nums n JOIN sets s USING (repo, date_utc, author, log)")
def collect_by_key(spark, sf):
    return changesets.collect_by_key(V.acts(spark, sf))[1].select("repo", "seq", "name", "action", "new_rev")


@query("o1_order_changesets", V.sql("changes", "SELECT repo, seq, event_id FROM changes"))
def order_changesets(spark, sf):
    return V.changes(spark, sf).select("repo", "seq", "event_id")


@query("w1_classify_file_history", V.sql("acts", "SELECT repo, path, rev, action FROM acts"))
def classify(spark, sf):
    return V.acts(spark, sf).select("repo", "path", "rev", "action")


@query("p9_drop_repeated_dead", V.sql("kept", "SELECT repo, path, rev, state FROM kept"))
def repeated_dead(spark, sf):
    return changesets.drop_repeated_dead(V.revs(spark, sf)).select("repo", "path", "rev", "state")


@query("p8_drop_spurious_births", V.sql("revs", "SELECT repo, path, rev, log FROM (SELECT repo, path, rev, state, CASE WHEN n = 1 THEN 'file f was initially added on branch b' ELSE log END AS log FROM revs) WHERE NOT (rev = '1.1' AND state = 'dead' AND log LIKE 'file % was initially added on branch %')"))
def spurious(spark, sf):
    log = F.when(F.col("n") == 1, "file f was initially added on branch b").otherwise(F.col("log"))
    return changesets.drop_spurious_births(V.revs(spark, sf).withColumn("log", log)).select("repo", "path", "rev", "log")


@query("p7_filter_branch", V.sql("revs", "SELECT repo, path, rev FROM (SELECT repo, path, CASE WHEN n % 3 = 0 THEN '1.2.2.' || n ELSE rev END AS rev, n % 3 = 0 AS side, max(n) OVER (PARTITION BY repo, path) AS top, split_part(path, '/', 2) LIKE '%1' AS named FROM revs) WHERE NOT named OR side OR rev = '1.2'"))
def filter_branch(spark, sf):
    revs = V.revs(spark, sf)
    revs = revs.withColumn("rev", F.when(F.col("n") % 3 == 0, F.format_string("1.2.2.%d", "n")).otherwise(F.col("rev")))
    symbols = revs.where("path LIKE '%1'").select("repo", "path", F.lit("side").alias("tag"), F.lit("1.2.0.2").alias("number")).distinct()
    return changesets.filter_branch(revs, symbols, "side").select("repo", "path", "rev")


@query("a6_audit_revision_counts", V.sql("revs kept", "SELECT repo, path, a.n AS selected, b.n AS found FROM (SELECT repo, path, count(*) AS n FROM revs GROUP BY ALL) a JOIN (SELECT repo, path, count(*) AS n FROM kept GROUP BY ALL) b USING (repo, path) WHERE a.n <> b.n"))
def audit(spark, sf):
    revs = V.revs(spark, sf)
    return changesets.audit_revision_counts(changesets.drop_repeated_dead(revs), revs.groupBy("repo", "path").agg(F.count("*").alias("selected")))


# Scalar functions

REV_INPUT = "CASE n % 5 WHEN 0 THEN rev WHEN 1 THEN rev || '.0.' || (n % 3 + 1) WHEN 2 THEN rev || '.2.1 locked by x' WHEN 3 THEN '1.1.1.1' ELSE '' END"
KEYS = V.sql("revs", "").rstrip() + f""", ins AS (SELECT repo, path, n, {REV_INPUT} AS r FROM revs), nums AS (SELECT *, CASE WHEN split_part(r, ' ', 1) = '' THEN [0] ELSE list_transform(string_split(split_part(r, ' ', 1), '.'), lambda x: CAST(x AS INT)) END AS l FROM ins),
    keys AS (SELECT repo, path, n, r, CASE WHEN l = [1, 1, 1, 1] THEN [1, 1] WHEN len(l) > 2 AND l[len(l) - 1] = 0 THEN list_concat(l[:len(l) - 2], l[len(l):]) ELSE l END AS k FROM nums)"""


def rev_inputs(spark, sf):
    return V.revs(spark, sf).select("repo", "path", "n", F.expr(REV_INPUT).alias("r"))


@query("f1_rev_key", KEYS + " SELECT repo, path, n, " + LIST.format("k") + " AS key FROM keys")
def rev_key(spark, sf):
    return rev_inputs(spark, sf).select("repo", "path", F.col("n").cast("long").alias("n"), S.rev_text(S.rev_key(F.col("r"))).alias("key"))


@query("f2_rev_cmp", KEYS + ", p AS (SELECT repo, path, n, k, lag(k) OVER (PARTITION BY repo, path ORDER BY n) AS b FROM keys) SELECT repo, path, n, CASE WHEN k < b THEN -1 WHEN k = b THEN 0 ELSE 1 END AS cmp FROM p WHERE b IS NOT NULL")
def rev_cmp(spark, sf):
    rows = rev_inputs(spark, sf).selectExpr("repo", "path", "n", "r", "lag(r) OVER (PARTITION BY repo, path ORDER BY n) AS b").where("b IS NOT NULL")
    return rows.select("repo", "path", F.col("n").cast("long").alias("n"), S.rev_cmp(F.col("r"), F.col("b")).alias("cmp"))


@query("f3_same_branch", KEYS + """, p AS (SELECT repo, path, n, k AS a, lag(k) OVER (PARTITION BY repo, path ORDER BY n) AS b FROM keys) SELECT repo, path, n, len(a) % 2 = 1 AS is_branch, """ + LIST.format("a[:len(a) - 1]") + """ AS branch,
    CASE WHEN len(a) % 2 = 1 AND len(b) % 2 = 1 THEN a = b WHEN len(a) % 2 = 0 AND len(b) % 2 = 0 THEN a[:len(a) - 1] = b[:len(b) - 1] ELSE a[:len(a) - 1] = b OR a = b[:len(b) - 1] END AS same FROM p WHERE b IS NOT NULL""")
def same_branch(spark, sf):
    rows = rev_inputs(spark, sf).selectExpr("repo", "path", "n", "r", "lag(r) OVER (PARTITION BY repo, path ORDER BY n) AS b").where("b IS NOT NULL")
    a, b = S.rev_key(F.col("r")), S.rev_key(F.col("b"))
    return rows.select("repo", "path", F.col("n").cast("long").alias("n"), S.is_branch(a).alias("is_branch"), S.rev_text(S.branch_of(a)).alias("branch"), S.same_branch(a, b).alias("same"))


#: Codes of each kind of source, and one that none has.
NATIVE = {
    "xml": ["A", "D", "M", "R", "?"], "commit": ["A", "D", "M", "T", "R", "C", "?"], "changelist": ["add", "branch", "delete", "edit", "integrate", "?"],
    "patch": ["add_file", "add_directory", "remove_file", "remove_directory", "modify_file", "move", "?"], "report": ["A", "D", "M", "ch", "cl", "=>", "/>", "?"],
}
NATIVE_SQL = ", ".join(f"('{kind}', {k}, {len(codes)}, '{code}')" for kind, codes in NATIVE.items() for k, code in enumerate(codes))


@query("f5_map_action", V.sql("moves", f"""SELECT kind, native, count(*) AS n, CASE WHEN native IN ('A', 'C', 'add', 'branch', 'add_file', 'add_directory') THEN 'ADD' WHEN native IN ('D', 'delete', 'remove_file', 'remove_directory') THEN 'DEL'
    WHEN native IN ('M', 'T', 'edit', 'integrate', 'modify_file', 'ch', 'cl') THEN 'UPD' WHEN native IN ('R', 'move', '=>', '/>') THEN 'REN' END AS mapped FROM moves JOIN (VALUES {NATIVE_SQL}) v(kind, k, size, native) ON (seq + pos) % size = k GROUP BY kind, native"""))
def map_action(spark, sf):
    """Codes of all kinds, dealt over all entries."""
    coded = lambda kind: F.element_at(F.array(*map(F.lit, NATIVE[kind])), ((F.col("seq") + F.col("pos")) % len(NATIVE[kind]) + 1).cast("int"))
    rows = V.moves(spark, sf).select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), coded(k).alias("native"), S.map_action(k, coded(k)).alias("mapped")) for k in NATIVE))).alias("c"))
    return rows.groupBy("c.kind", "c.native", "c.mapped").agg(F.count("*").alias("n"))


@query("f6_refill", V.sql("logs", r"SELECT conv_id, turn, list_reduce(string_split(trim(regexp_replace(log, '\s+', ' ', 'g')), ' '), lambda acc, w: acc || CASE WHEN length(regexp_extract(acc, '[^\n]*$')) + 1 + length(w) <= 70 THEN ' ' ELSE chr(10) END || w) AS log FROM logs"))
def refilled(spark, sf):
    return V.logs(spark, sf).select("conv_id", "turn", refill(F.col("log")).alias("log"))


@query("f7_first_and_remaining_lines", V.sql("logs", r"SELECT conv_id, turn, CASE WHEN coalesce(log, '') = '' THEN 'Empty log message' ELSE split_part(log, chr(10), 1) END AS first_line, CASE WHEN position(chr(10) IN log) > 0 THEN substr(log, position(chr(10) IN log) + 1) ELSE '' END AS rest FROM logs"))
def log_lines(spark, sf):
    return V.logs(spark, sf).select("conv_id", "turn", S.first_log_line(F.col("log")).alias("first_line"), S.remaining_log(F.col("log")).alias("rest"))


@query("f8_patch_name", V.sql("logs", "SELECT conv_id, turn, '[' || conv_id || '] ' || role || ': ' || CASE WHEN coalesce(log, '') = '' THEN 'Empty log message' ELSE split_part(log, chr(10), 1) END AS name, CASE WHEN position(chr(10) IN log) > 0 THEN substr(log, position(chr(10) IN log) + 1) ELSE '' END AS body FROM logs"))
def patch_name(spark, sf):
    template = "[%(project)s] %(author)s: %(firstlogline)s"
    name = S.patch_name(template, {"project": F.col("conv_id"), "author": F.col("role")}, F.col("log"))
    return V.logs(spark, sf).select("conv_id", "turn", name.alias("name"), S.patch_body(template, F.col("log"), True).alias("body"))


@query("f10_parse_author", "SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'u' || c_custkey || '@x.org' WHEN c_custkey % 3 = 1 THEN 'u' || c_custkey || '@x.org' ELSE c_name || '@localhost' END AS email FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN 'u' || c_custkey ELSE c_name END AS c_name FROM customer)")
def parse_author(spark, sf):
    address = F.format_string("u%d@x.org", "c_custkey")
    kind = F.col("c_custkey") % 3
    author = F.when(kind == 0, F.concat("c_name", F.lit(" <"), address, F.lit(">"))).when(kind == 1, address).otherwise(F.col("c_name"))
    rows = V.load(spark, sf, "customer").select("c_custkey", author.alias("a"))
    return rows.select("c_custkey", S.author_name(F.col("a")).alias("name"), S.author_email(F.col("a")).alias("email"))


@query("f11_parse_date", "SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS compact, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS words, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS iso, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS slash, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS short FROM events")
def parse_date(spark, sf):
    month = F.element_at(F.array(*map(F.lit, ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"])), F.month("ts"))
    clock, day, year = F.date_format("ts", "HH:mm:ss"), F.date_format("ts", "d"), F.date_format("ts", "yyyy")
    texts = {
        "compact": F.date_format("ts", "yyyyMMddHHmmss"), "words": F.concat_ws(" ", F.lit("Mon"), month, day, clock, F.lit("CEST"), year),
        "iso": F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".123456Z")), "slash": F.concat(F.date_format("ts", "yyyy/MM/dd HH:mm:ss"), F.lit(" +0000")), "short": F.concat_ws(" ", F.lit("Mon"), month, day, clock, year),
    }
    return V.load(spark, sf, "events").select("event_id", *(F.unix_seconds(S.parse_date(k, t)).alias(k) for k, t in texts.items()))


@query("f12_tz_minutes", "SELECT event_id, m AS minutes, -m AS flipped FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END * ((event_id % 14) * 60 + (event_id % 4) * 15) AS m FROM events)")
def tz_minutes(spark, sf):
    text = F.concat(F.when(F.col("event_id") % 2 == 0, "+").otherwise("-"), F.lpad((F.col("event_id") % 14).cast("string"), 2, "0"), F.lpad((F.col("event_id") % 4 * 15).cast("string"), 2, "0"))
    rows = V.load(spark, sf, "events").select("event_id", text.alias("t"))
    return rows.select("event_id", S.tz_minutes(F.col("t")).cast("long").alias("minutes"), S.tz_minutes(F.col("t"), True).cast("long").alias("flipped"))


@query("f13_tz_from_pair", "SELECT event_id, (event_id % 27 - 13) * 60 AS minutes FROM events")
def tz_from_pair(spark, sf):
    utc = F.col("ts").cast("timestamp")
    local = F.timestamp_seconds(F.unix_seconds(utc) + (F.col("event_id") % 27 - 13) * 3600)
    return V.load(spark, sf, "events").select("event_id", S.tz_from_pair(local, utc).cast("long").alias("minutes"))


@query("f14_patch_hash", "SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') || '-' || substr(sha1('u' || user_id), 1, 5) || '-' || sha1(CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN 'TAG ' || event_type ELSE event_type END || 'u' || user_id || strftime(ts, '%Y%m%d%H%M%S') || props || 'end' || CASE WHEN event_id % 3 = 0 THEN 't' ELSE 'f' END) || '.gz' AS hash FROM events")
def patch_hash(spark, sf):
    kind = F.col("event_id") % 3
    name = F.concat(F.when(kind == 0, "UNDO: ").when(kind == 1, "tagged ").otherwise(""), "event_type")
    author = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    return V.load(spark, sf, "events").select("event_id", S.patch_hash(name, author, F.col("ts"), F.array("props", F.lit("end"))).alias("hash"))


@query("f15_safe_tag", r"""SELECT page_id, CASE WHEN regexp_matches(p, '^[A-Za-z]') THEN p ELSE 'tag-' || p END AS file, regexp_replace(replace(p, '__', '_'), '_+$', '') AS hash, replace(t, '/', '_') AS path FROM (SELECT page_id, t, regexp_replace(t, '[^A-Za-z0-9_-]', '_', 'g') AS p FROM (SELECT page_id, substr(url, page_id % 9 + 1) AS t FROM pages))""")
def safe_tag(spark, sf):
    rows = V.load(spark, sf, "pages").select("page_id", F.expr("substr(url, int(page_id % 9 + 1))").alias("t"))
    return rows.select("page_id", *(S.safe_tag(style, F.col("t")).alias(style) for style in ("file", "hash", "path")))


@query("f16_strip_noise", V.sql("logs", "SELECT conv_id, turn, log FROM logs"))
def strip_noise(spark, sf):
    noisy = F.concat(F.lit("Ignore-this: "), F.sha1(F.col("log").cast("binary")), F.lit("\n"), "log")
    return V.logs(spark, sf).select("conv_id", "turn", S.strip_noise(noisy).alias("log"))


@query("f17_default_message", V.sql("logs", "SELECT conv_id, turn, CASE WHEN m = '' THEN 'Empty changelog' ELSE m END AS changelog, CASE WHEN m = '' THEN 'No commit message' || chr(10) WHEN m LIKE '%' || chr(10) THEN m ELSE m || chr(10) END AS commit, CASE WHEN m = '' THEN ' ' ELSE m END AS space, m AS lines FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '' ELSE log END AS m FROM logs)"))
def default_message(spark, sf):
    m = F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("log"))
    styles = {s: S.default_message(s, m) for s in ("changelog", "commit", "space")} | {"lines": S.default_message("lines", F.concat(F.lit("\n\n"), m))}
    return V.logs(spark, sf).select("conv_id", "turn", *(c.alias(s) for s, c in styles.items()))


@query("f18_ancestors", V.sql("moves", "SELECT repo, seq, pos, split_part(name, '/', 1) || '|' || split_part(name, '/', 1) || '/' || split_part(name, '/', 2) AS above, split_part(name, '/', 1) || '/' || split_part(name, '/', 2) AS parent FROM moves"))
def ancestors(spark, sf):
    return V.moves(spark, sf).select("repo", "seq", "pos", F.concat_ws("|", S.ancestors_of(F.col("name"))).alias("above"), S.parent_of(F.col("name")).alias("parent"))


@query("s15_decode_text", "SELECT doc_id, text, sha256(text || chr(65533)) AS ignored FROM documents")
def decode_text(spark, sf):
    docs = V.load(spark, sf, "documents")
    broken = F.concat(F.unhex(F.lit("FF")), F.col("text").cast("binary"), F.unhex(F.lit("EFBFBDC3")))  # bad bytes, and one U+FFFD of its own
    return docs.select("doc_id", S.decode_text(F.col("text").cast("binary")).alias("text"), F.sha2(S.decode_text(broken, policy="ignore").cast("binary"), 256).alias("ignored"))


@query("s16_encode_text", r"SELECT doc_id, sha256(encode(text)) AS strict, length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) AS n_ignore, length(text) AS n_replace FROM documents")
def encode_text(spark, sf):
    t = F.col("text")
    return V.load(spark, sf, "documents").select("doc_id", F.sha2(S.encode_text(t), 256).alias("strict"), F.octet_length(S.encode_text(t, "US-ASCII", "ignore")).cast("long").alias("n_ignore"), F.octet_length(S.encode_text(t, "US-ASCII", "replace")).cast("long").alias("n_replace"))


@query("s17_scrub_chars", r"SELECT doc_id, regexp_replace(translate(text, 'ae', chr(1) || chr(9)), '[\x00-\x09\x0B\x0C\x0E-\x1F\x7F]', '?', 'g') AS text FROM documents")
def scrub(spark, sf):
    return V.load(spark, sf, "documents").select("doc_id", S.scrub_chars(F.translate("text", "ae", "\x01\x09")).alias("text"))


ENTITY_SQL = "text"
for _char, _entity in S.ENTITIES.items():
    ENTITY_SQL = f"replace({ENTITY_SQL}, '{_char}', '{_entity}')"


@query("s18_map_chars", f"SELECT doc_id, {ENTITY_SQL} AS text FROM documents")
def map_chars(spark, sf):
    return V.load(spark, sf, "documents").select("doc_id", S.map_chars(F.col("text")).alias("text"))
