"""Session set-up, the shared scratch folder, and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
BROADCAST_LIMIT = 256 << 20


def build_session(app: str = "capsonde", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Vector sums keep one buffer per group; past this many a task sorts its rows instead.
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "1024")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; on a local master a fresh folder where none is configured."""
    sc = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_KEY, None) or sc.getConf().get(CHECKPOINT_KEY)
    current = sc.getCheckpointDir()
    if configured:
        if current is None:
            sc.setCheckpointDir(configured)
        return configured
    if current is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that driver and executors of {sc.master} share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="capsonde-"))
        current = sc.getCheckpointDir()
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def materialize(df: DataFrame) -> DataFrame:
    """Write df once to the shared checkpoint folder: cuts lineage, survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(
    df: DataFrame,
    row_bytes: int,
    limit: int = BROADCAST_LIMIT,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """Hint a broadcast only when rows x row_bytes is proven to stay under the limit.

    Counting stops one row past the limit. Beyond it the frame comes back unhinted and
    the join is a shuffle join, which AQE may split by skew. A frame whose rows hold lists
    is sized by the table the lists were collected from.
    """
    counted = df if sized_by is None else sized_by
    most = max(limit // row_bytes, 1)
    rows = counted.limit(most + 1).count()
    return F.broadcast(df) if rows <= most else df
