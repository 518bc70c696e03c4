"""Session settings and lineage control."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def build_session(app_name: str = "pvlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are designed for.

    Wall-clock times are TIMESTAMP_NTZ, so the session zone matters only when a
    result is shown; it is pinned to UTC. Adaptive execution splits skewed joins
    and merges small shuffle partitions, so the partition count may start high.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Only a local-mode session without the setting gets a scratch folder: on a
    cluster a machine-local folder would be lost with its machine.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="pvlake-checkpoint-")
    context.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read on from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting (never past ``max_rows``); otherwise leave the join to the planner.

    Worth a job where the other side is a fact table: without a known size the
    planner shuffles both sides before it can learn that one of them is tiny.
    """
    rows = df.limit(max_rows + 1).count()
    return F.broadcast(df) if rows <= max_rows else df
