"""From raw documents to token digests of a clean corpus, in five stages.

Each stage takes all rows that the one before kept, and each but the last returns
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.llm import decontaminate as decon
from changeloom.llm import pieces, queries, repeats, similar
from changeloom.llm.common import map_batches, stored, table, with_row_id

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects (score below 0.5).

    Each row is judged by its text alone; a null text counts as an empty one.
    Labels are those of ``sf_dir``; without any, all scores are 0.5 and all rows
    stay. Null and repeated ids change nothing, an empty table gives one.
    """
    model = queries.quality_model(spark, table(spark, sf_dir, "documents"), sf_dir)
    return docs.select(*COLUMNS).where(model.score(F.col("text"), spark) >= 0.5)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates: of its smallest id, and of
    rows with that id the first.

    Documents are linked if the Jaccard similarity of their sets of five-word
    shingles is 0.8 or more, which is verified; groups are what links connect.
    SimHash fingerprints of the sets only propose pairs: of pairs of similarity
    0.8 some 96.6 % by ``similar.search_for``, of more similar ones more.
    Documents without an id all stay, and so do rows of one id that are in
    different groups; texts without words are alike. An empty table gives one.
    """
    rows = with_row_id(docs.select(*COLUMNS), "doc_id", "text")
    groups = similar.groups(rows, words=5, least=0.8)
    ids = rows.select("rid", "id").join(groups, "rid").where("id IS NOT NULL")
    kept = ids.groupBy("root").agg(F.min(F.struct("id", "rid")).alias("best")).select("best.rid")
    kept = stored(kept.union(rows.where("id IS NULL").select("rid")), "kept")
    return _documents(rows.join(kept, "rid", "left_semi"))


def _documents(rows: DataFrame) -> DataFrame:
    """Rows of ``with_row_id`` as documents again."""
    return rows.select(F.col("id").alias("doc_id"), "text", "rest.lang", "rest.source", "rest.n_chars")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every passage of 200 bytes or more that stands elsewhere too.

    A character that is cut in part goes as a whole. Documents stay, even empty;
    null texts become empty ones. Rows are documents whatever their ids, so repeated
    rows lose what they repeat; an empty table gives one.
    """
    found = repeats.remove_repeats(docs.select(*COLUMNS))

    def text(rows: dict) -> dict:
        return rows | {"kept": [bytes(k).decode("utf-8", "ignore") for k in rows["kept"]]}

    cut = map_batches(found.select("id", "kept", "rest.lang", "rest.source"), text, f"id {dict(found.dtypes)['id']}, kept string, lang string, source string")
    return cut.select(F.col("id").alias("doc_id"), F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that hold a window of a benchmark item, whatever their ids.

    Null and empty texts hold none; without items all rows stay; an empty table
    gives one.
    """
    rows = with_row_id(docs.select(*COLUMNS), "doc_id", "text")
    found = decon.decontaminate(rows, table(spark, sf_dir, "benchmark"), id_col="rid")
    bad = stored(found.where("contaminated").select("rid"), "contaminated")
    return _documents(rows.join(bad, "rid", "left_anti"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the text they decode to, as digests: a row for each row, with its
    id, null or repeated as it is. A null text counts as an empty one, which has no
    ids; an empty table gives one.
    """
    import public_tokenizers

    return pieces.token_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality classifier", keep_good), ("simhash near-dedup", keep_one_of_each), ("suffix-array dedup", cut_repeats), ("benchmark decontamination", drop_contaminated), ("sentencepiece", encode)]

#: The classifier, the fingerprints and the tokenizer cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
