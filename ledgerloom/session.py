"""Session settings and the few physical choices the operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A row-count bound, not a tuning knob: 200,000 narrow rows stay far below the
# 8 GB / 512M-row broadcast limits and within any executor's memory.
BROADCAST_MAX_ROWS = 200_000


def build_session(app_name: str = "ledgerloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and skew handling switched on."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  A local-mode session that names
    none uses a folder beside its warehouse; on a cluster that could be a path no
    other machine can read, so it is an error there.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if current is None:
        if configured is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
            configured = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints-{context.applicationId}"
        context.setCheckpointDir(configured)
        current = configured
    return configured or current


def pin(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared checkpoint folder and cut its lineage.

    Used where two branches of one plan must see the very same partition
    boundaries, and where a reduced table is read several times.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Hint a broadcast only after counting, at most, ``max_rows + 1`` rows.

    Beyond the bound the frame is returned unhinted: the join is then a shuffle
    join whose skewed partitions adaptive execution splits.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df
