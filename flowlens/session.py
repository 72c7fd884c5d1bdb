"""SparkSession construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.sql.codegen.hugeMethodLimit": "8000",       # see METHOD_LIMIT
    # Broadcast only what is tiny by construction; everything else is a
    # planned shuffle join.  Parameter tables and rule tables are a few rows.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


#: Bytecode of a generated method above which Spark compiles a stage's
#: expressions apart.  HotSpot does not compile longer methods to machine code:
#: the projections of all flow features then ran in its interpreter.
METHOD_LIMIT = 8000


def configure(spark: SparkSession) -> None:
    """Settings that every registered query of the flow tables runs under."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(METHOD_LIMIT))


def get_session(master: str | None = None, app: str = "flowlens",
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with UTC time, AQE and skew handling on.

    ``master`` is only set for local runs; on a cluster the launcher decides.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    The cluster names it in ``spark.checkpoint.dir``; it is read from the
    session.  Only when it is unset in a local session (tests) a scratch folder
    is created; on a cluster a machine-local folder would lose data, so an
    unset folder raises there.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="flowlens-ckpt-", dir=os.environ.get("FLOWLENS_SCRATCH", "/tmp"))
        try:
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:          # a session may refuse runtime core settings;
            pass                   # the context's checkpoint dir below is what matters
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return (spark.sparkContext.getCheckpointDir() or d).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique path under the shared checkpoint folder for derived tables."""
    import uuid
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
