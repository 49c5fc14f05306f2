"""Helpers that every operator of this package shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of an Arrow batch. Texts are long, and both Spark and the worker hold whole batches.
ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of the session have ROWS rows at most, if it does
    not ask for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS:
        spark.conf.set(key, str(ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by spark.checkpoint.dir.

    Only where that setting is absent and Spark runs on one machine (tests) a
    temporary folder is made and set for the session; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-llm-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again.

    Cuts the lineage: what follows survives lost executors, and a table that is
    used twice is computed once.
    """
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_row_id(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rid, id, text, rest): rid names a row even when ids are null or repeated;
    rest holds the other columns, whatever their names.

    Where ids are unique they serve as rid and nothing is written. Otherwise
    numbers are dealt out and stored, so that every later pass sees the same.
    """
    others = [F.col(f"`{c}`") for c in df.columns if c not in (id_col, text_col)]
    base = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(*(others or [F.lit(0).alias("none")])).alias("rest"))
    seen = base.groupBy("id").count().agg(
        F.coalesce(F.max("count"), F.lit(1)).alias("most"), F.coalesce(F.max(F.col("id").isNull()), F.lit(False)).alias("nulls"),
    ).first()
    if seen["most"] == 1 and not seen["nulls"] and dict(base.dtypes)["id"] == "bigint":
        return base.select(F.col("id").alias("rid"), "id", "text", "rest")
    return stored(base.select(F.monotonically_increasing_id().alias("rid"), "id", "text", "rest"), "rows")


def map_batches(df: DataFrame, fn: Callable[[dict], dict], schema: str) -> DataFrame:
    """``fn`` over columns of Arrow batches: dict of Python lists in and out, at
    most ROWS rows at a time, so that a task holds few texts."""
    arrow = _arrow_schema(df.sparkSession, schema)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                out = fn({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))
