"""Several histories at once."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


@dataclass
class ProjectSpec:
    """Where a history comes from and how it is read."""

    name: str
    read: Callable[[SparkSession], DataFrame]
    hooks: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)


def union_projects(spark: SparkSession, specs: Iterable[ProjectSpec], chosen: set[str] | None = None) -> tuple[DataFrame | None, DataFrame]:
    """(rows, status): all projects, or the chosen ones, under one ``repo`` column.

    A source that cannot be read does not stop the others; status (repo, ok, error)
    tells of it.
    """
    rows, status = None, []
    for spec in specs:
        if chosen is not None and spec.name not in chosen:
            continue
        try:
            df = spec.read(spark).withColumn("repo", F.lit(spec.name))
            for hook in spec.hooks:
                df = df.transform(hook)
            df.schema  # noqa: B018  a source that cannot be resolved fails here
            rows = df if rows is None else rows.unionByName(df, allowMissingColumns=True)
            status.append((spec.name, True, None))
        except (AnalysisException, ValueError, OSError) as error:
            status.append((spec.name, False, str(error)[:300]))
    return rows, spark.createDataFrame(status, "repo string, ok boolean, error string")
