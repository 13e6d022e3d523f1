"""Session helpers: local sessions for tests, lineage cuts for iterative jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.sql.parquet.filterPushdown": "true",
}


def local_session(cores: int | str = 8, app: str = "assaylake", **conf: str) -> SparkSession:
    """A local session for tests and the bench. On a cluster the caller brings the session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    builder = builder.config("spark.sql.shuffle.partitions", str(cores))
    builder = builder.config("spark.driver.memory", "16g")
    for key, value in {**_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session (`spark.checkpoint.dir`).

    Where it is unset a temporary folder is taken in local mode only; on a cluster a machine-local
    folder would lose data with its executor, so there the setting is required.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="assaylake-ckpt-")
    sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss, and later rounds do not recompute earlier ones."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def packed_lineage(df: DataFrame) -> DataFrame:
    """`cut_lineage` for long strings: a compressed table in the checkpoint folder. What making it has shuffled goes as it ends."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = df.sparkSession.conf.get(name, None)
    df.sparkSession.conf.set(name, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        df.sparkSession.conf.set(name, before) if before is not None else df.sparkSession.conf.unset(name)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
