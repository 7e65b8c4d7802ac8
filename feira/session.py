"""Session-level helpers: checkpoint location and lineage cutting.

The checkpoint folder is the cluster's ``spark.checkpoint.dir`` (a shared,
reliable folder). A private temporary folder is used only for local-mode
sessions that have none configured (tests); a cluster session without one
is an error rather than a silent fall-back to an executor-local disk.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if re.fullmatch(r"local(\[.*\])?", sc.master):  # one process; not local-cluster
        path = tempfile.mkdtemp(prefix="feira-checkpoint-")
        sc.setCheckpointDir(path)
        return path
    raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder (e.g. on the cluster's DFS)")


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computed once, written to the checkpoint folder, lineage cut.

    Used where one intermediate result feeds several passes (e.g. cut points,
    counts and numbering of a global ranking). A lost executor then re-reads
    the written files instead of recomputing the joins behind them.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "feira") -> SparkSession:
    """Session for tests and benchmarks on one machine (UI off, UTC, AQE on)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
