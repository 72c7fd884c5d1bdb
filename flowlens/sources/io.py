"""Sources and sinks.

Reads never infer schemas in production paths: flow CSVs are read with an
all-text schema built from their header and coerced by ``enforce_numeric``.
Log tables are append-only parquet partitioned by day, so date filters prune
whole folders.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import constants as K


# Timestamps in JSON logs keep microseconds.
JSON_TIME = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
             "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


# --------------------------------------------------------------- paths ----

def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def glob_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Files matching a glob (a listing: names only, never data)."""
    fs, p = _fs(spark, pattern)
    st = fs.globStatus(p)
    return [] if st is None else [s.getPath().toString() for s in st]


# ------------------------------------------------------------- readers ----

def read_parquet_glob(spark: SparkSession, pattern: str, merge_schema: bool = True) -> DataFrame:
    """Every parquet file matching ``pattern`` as one table (schemas merged by name)."""
    return spark.read.option("mergeSchema", str(merge_schema).lower()).parquet(pattern)


def raw_flow_schema(columns: list[str] | None = None) -> StructType:
    return StructType([StructField(n, StringType(), True) for n in (columns or K.RAW_FLOW_COLUMNS)])


def read_flow_csvs(spark: SparkSession, folder: str, columns: list[str] | None = None,
                   pattern: str = "*.csv") -> DataFrame:
    """All flow CSVs of a folder as text columns; error when there is none."""
    files = glob_paths(spark, f"{folder.rstrip('/')}/{pattern}")
    if not files:
        raise FileNotFoundError(f"no flow CSV files in {folder}")
    return (spark.read.schema(raw_flow_schema(columns)).option("header", "true").option("mode", "PERMISSIVE")
            .csv(files))


def union_by_name(dfs: list[DataFrame]) -> DataFrame:
    """Stack frames by column name; a column missing in one frame is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def read_results_safe(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    """The result table, or an empty table of the known schema when the path
    is absent.  A path that is there but cannot be read raises."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.format(fmt).schema(schema).load(path)


def read_split_tables(spark: SparkSession, path: str) -> DataFrame:
    """Train/test rows as one table with a ``split`` column (partition pruning
    on ``split`` reads only the wanted half)."""
    return spark.read.parquet(path)


def read_json_log_tail(spark: SparkSession, path: str, n: int, schema: StructType | str) -> DataFrame:
    """Newest ``n`` entries of a JSON-lines log (top-k, ties by id)."""
    df = spark.read.schema(schema).options(**JSON_TIME).json(path)
    return df.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(n)


# --------------------------------------------------------------- sinks ----

def write_results(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("overwrite").format(fmt).option("header", "true").save(path)


def write_split_tables(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def append_log(df: DataFrame, path: str, ts: str = "ts", json_path: str | None = None,
               run_id: int | None = None) -> None:
    """Append rows to a day-partitioned log table (and to a JSON-lines copy).
    With a ``run_id`` they become that run's part of the table, in place of
    what an earlier attempt at the run has written."""
    out = df.withColumn("date", F.to_date(F.col(ts))).write.partitionBy("date")
    if run_id is None:
        out.mode("append").parquet(path)
    else:
        out.mode("overwrite").parquet(f"{path}/run_id={run_id}")
    if json_path:
        write_json_log(df, json_path, "append")


def write_json_log(df: DataFrame, path: str, mode: str = "append") -> None:
    """JSON-lines log copy; timestamps keep their microseconds."""
    df.write.mode(mode).options(**JSON_TIME).json(path)


# ------------------------------------------------- published versions ----

def publish(spark: SparkSession, base: str, name: str) -> int:
    """Makes the finished folder ``base/name`` the newest version, by creating
    one empty file whose name says so: it is there whole or not at all.
    Returns its number; versions published at the same time get different
    ones."""
    fs, folder = _fs(spark, f"{base}/published")
    fs.mkdirs(folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    number = max((n for n, _ in published(spark, base)), default=0) + 1
    while not fs.createNewFile(path(folder, f"{number:012d}-{name}")):
        number += 1
    return number


def published(spark: SparkSession, base: str) -> list[tuple[int, str]]:
    """``(number, folder)`` of the published versions, oldest first.  Two that
    drew the same number at once come in the order of their names."""
    fs, folder = _fs(spark, f"{base}/published")
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return sorted((int(n[:12]), n[13:]) for n in names if not n.startswith((".", "_")))


def save_params(df: DataFrame, path: str) -> None:
    """A fitted parameter table (one or a few rows) as parquet."""
    df.coalesce(1).write.mode("overwrite").parquet(path)


def save_model(model, path: str, spark: SparkSession | None = None) -> None:
    """A fitted pipeline, or a model that is a table (trees, a network)."""
    if hasattr(model, "table"):
        save_params(model.table(spark), path)
    else:
        model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
