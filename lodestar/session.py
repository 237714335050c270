"""Session helpers: a local session for tests/bench, table loading and the lineage-cut folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def local_session(cpus: int | str = "*", app: str = "lodestar", shuffle_partitions: int = 8) -> SparkSession:
    """A local session configured the way the library expects (AQE on, UI off, UTC, Arrow)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is configured by the operator of the cluster and is only read here.
    Only when it is unset (local tests) a private scratch folder is created and set.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    path = tempfile.mkdtemp(prefix="lodestar-ckpt-")
    sc.setCheckpointDir(path)
    return path


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder, for written intermediate tables."""
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


#: Rows of keys that a join may send to every task.
SMALL_ROWS = 1 << 20


def cut(df: DataFrame) -> DataFrame:
    """The rows written once, so that what reads them more than once does not work them out again."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame) -> DataFrame:
    """``df`` (written rows) marked for a broadcast when it has few rows, so that the large side of a join stays where it is."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the test tables (parquet) lazily; column pruning and filters reach the scan."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
