"""Registry of named queries: ``name -> (spark builder, oracle SQL or None)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..session import scratch_path

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: add a ``(spark, sf_dir) -> DataFrame`` builder."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6, only: list[str] | None = None) -> DataFrame:
    """Round double columns so that two engines agree on the printed value."""
    out = []
    for f in df.schema.fields:
        n = f"`{f.name}`"
        if isinstance(f.dataType, (DoubleType, FloatType)) and (only is None or f.name in only):
            out.append(F.round(F.col(n).cast("double"), digits).alias(f.name))
        else:
            out.append(F.col(n))
    return df.select(out)


def freeze(df: DataFrame) -> DataFrame:
    """A small fitted result (one row, or one row per class / feature) as a
    local relation, so plans that reuse it embed its values instead of
    re-running the computation that produced it."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def materialize(df: DataFrame) -> DataFrame:
    """Write a table that several passes will read to the shared checkpoint
    folder, by columns."""
    path = scratch_path(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over the cluster: a table file of one row group is
    read by a single task, and so would be every pass over what it wrote."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
