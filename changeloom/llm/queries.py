"""The registered queries of this package, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate as decon
from . import byte_pieces, chat, periods, pieces, quality, repeats, sharding, simhash, spelling, token_files, transport_stream, warc
from .common import stored, table

#: Rows that are held out; of no other rows with an id labels are learnt.
HELD_OUT = "coalesce(crc32(binary(string(doc_id))) % 3 = 1, false)"


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.QualityModel:
    labels = table(spark, sf_dir, "labels").where(f"doc_id IS NOT NULL AND NOT {HELD_OUT}").select("doc_id", "quality")
    rows = quality.training_rows(docs.select("doc_id", "text"), labels, "quality")
    return quality.fit(rows, "text", "quality", "doc_id")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model(spark, docs, sf_dir)
    scored = docs.select("doc_id", F.expr(HELD_OUT).alias("held_out"), model.score(F.col("text"), spark).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decon.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("items_sha256", F.sha2(F.concat_ws(",", "items"), 256)).drop("items").select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = chat.transcript(table(spark, sf_dir, "conversations"))
    model = chat.fit(lines.where(f"conv IS NOT NULL AND NOT {HELD_OUT.replace('doc_id', 'conv')}"))
    turns = chat.recover_turns(lines, model)
    return turns.select(F.col("conv").alias("conv_id"), "turn", "role", "n_lines", chat.rendered(F.col("role"), F.col("content")).alias("rendered"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 50256)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = stored(transport_stream.with_media(table(spark, sf_dir, "documents")), "media")  # read back from there
    found = transport_stream.media_features(media)
    feature = F.format_string("packets=%d breaks=%d units=%d last=%d rap=%s", "packets", "breaks", F.size("times"), F.element_at("times", -1), F.concat_ws(",", F.col("random_access").cast("array<string>")))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "stamp")


def op11_byte_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = byte_pieces.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """Every tenth text, by its id's hash, has the words from a on repeat those of p words."""
    h, w = "crc32(binary(string(doc_id)))", r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)"
    n, g = "size(w)", f"({h} div 10)"
    a, p = f"int({g} % {n})", f"(1 + int(({n} - int({g} % {n})) div (3 + {g} % 8)))"
    planted = f"array_join(concat(slice(w, 1, {a}), slice(flatten(array_repeat(slice(w, {a} + 1, {p}), int(ceil(({n} - {a}) / {p})))), 1, {n} - {a})), ' ')"
    # A lambda's variable: the words are looked for once.
    return docs.select("doc_id", F.expr(f"CASE WHEN {h} % 10 = 0 AND text IS NOT NULL THEN get(transform(array({w}), w -> CASE WHEN {n} > 0 THEN {planted} ELSE '' END), 0) ELSE text END").alias("text"))


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.periodic_runs(with_planted_periods(table(spark, sf_dir, "documents")))
    longest = F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    best = F.get(longest, F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.less")).alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * -best.less div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"),
    )


def edited_words(docs: DataFrame) -> DataFrame:
    """(word): the runs of letters of every text, of which every 199th or so lacks a letter.

    Shorter runs than six letters make no word of six. Without an id nothing is taken away.
    """
    letters = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(letters, F.lit("[a-z\u00C0-\u00FF]{6,}"), F.lit(0))).alias("run"))
    hashed = runs.select("run", F.expr("crc32(binary(concat(string(doc_id), ':', run)))").alias("h"))
    at = "int(h % length(run))"
    return hashed.select(F.expr(f"CASE WHEN h % 199 = 0 THEN concat(substring(run, 1, {at}), substring(run, {at} + 2)) ELSE run END").alias("word"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = edited_words(table(spark, sf_dir, "documents")).where("length(word) >= 6").groupBy("word").agg(F.count("*").alias("n")).where("n >= 5")
    return spelling.spelling_groups(words).select("word", "form", "root", "n", "n_near", "form_n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_decontaminate": op2_decontaminate,
        "op3_repeats": op3_repeats,
        "op4_chat": op4_chat,
        "op5_sharding": op5_sharding,
        "op6_token_counts": op6_token_counts,
        "op7_simhash": op7_simhash,
        "op8_transport_stream": op8_transport_stream,
        "op9_pieces": op9_pieces,
        "op10_warc": op10_warc,
        "op11_byte_pieces": op11_byte_pieces,
        "op12_periods": op12_periods,
        "op13_spelling": op13_spelling,
    }


WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP2_SQL = f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents), b AS (SELECT item_id, {WORDS} AS w FROM benchmark), bm AS (SELECT item_id, w, least(len(w), 10) AS m FROM b WHERE len(w) > 0),
    bw AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS win FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM bm)),
    dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS win FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
    h AS (SELECT doc_id, item_id, i, m FROM dw JOIN bw USING (m, win)), p AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS place FROM h) GROUP BY 1),
    t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)"""
OP10_SQL = """WITH p AS (SELECT page_id, lower(url) AS url, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS hex FROM pages), n AS (SELECT page_id, url, t, list_transform(range(0, 40), lambda k: position(substr(hex, CAST(k + 1 AS BIGINT), 1) IN '0123456789abcdef') - 1) AS x FROM p),
    g AS (SELECT page_id, url, t, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((x[CAST(k // 4 * 5 + 1 AS BIGINT)] * 65536 + x[CAST(k // 4 * 5 + 2 AS BIGINT)] * 4096 + x[CAST(k // 4 * 5 + 3 AS BIGINT)] * 256 + x[CAST(k // 4 * 5 + 4 AS BIGINT)] * 16 + x[CAST(k // 4 * 5 + 5 AS BIGINT)]) // CASE k % 4 WHEN 0 THEN 32768 WHEN 1 THEN 1024 WHEN 2 THEN 32 ELSE 1 END) % 32 + 1 AS BIGINT), 1)), '') AS digest FROM n),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '(\\?[^#]*)', 1) AS q FROM g)
    SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to,
    array_to_string(list_reverse(string_split(regexp_replace(host, '^www\\.', ''), '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END || q AS url_key, strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM f"""


def oracle_sql() -> dict[str, str]:
    """The others cannot be said in SQL: trained weights, XXH64 bits, indexes,
    tokenizers, binary formats, least capacities."""
    return {"op2_decontaminate": OP2_SQL, "op10_warc": OP10_SQL}
