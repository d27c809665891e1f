"""Session settings, size-checked broadcast and lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str | int = "*", shuffle_partitions: int = 8,
                  memory: str = "8g", app: str = "hedgewatch") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    Taken from ``spark.checkpoint.dir``. Only a local session without that
    setting gets a temporary folder of its own.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="hedgewatch-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the written rows."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_up_to(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` if it has at most ``max_rows`` rows, else leave the join
    strategy to the optimizer. The check reads at most ``max_rows + 1`` rows."""
    small = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if small else df
