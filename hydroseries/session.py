"""SparkSession helpers.

The engine treats ``TIMESTAMP_NTZ`` values as UTC instants, so the session time
zone must be UTC.  Checkpoints go to the shared folder named by
``spark.checkpoint.dir``; a folder of our own is set only where the session has
none (local runs and tests).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, app: str = "hydroseries",
                shuffle_partitions: int | None = None,
                extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators rely on."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    prepare(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Pin what correctness depends on, on an existing session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; set a scratch one only if none is set
    and the master is local (tests, local runs)."""
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no SparkContext; the server owns the setting
        d = spark.conf.get("spark.checkpoint.dir", None)
        if not d:
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        return d
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = sc.master or ""
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        d = tempfile.mkdtemp(prefix="hydroseries-ckpt-")  # local runs and tests only
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def materialize(df, mode: str | None = "checkpoint"):
    """Cut a plan that later steps read more than once.

    ``checkpoint``: reliable checkpoint to the shared checkpoint folder (cuts
    lineage, survives executor loss); ``persist``: memory-and-disk cache;
    ``None``: unchanged.  Never a local checkpoint.
    """
    if mode is None:
        return df
    if mode == "checkpoint":
        checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    if mode == "persist":
        from pyspark import StorageLevel
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    raise ValueError(mode)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the checkpoint folder for intermediate tables."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "tables", name)


def recommended_settings(input_bytes: int, total_cores: int, target_partition_mb: int = 256,
                         max_file_split_mb: int = 512) -> dict[str, str]:
    """Shuffle and scan sizing for a run over ``input_bytes`` of parquet on
    ``total_cores`` executor cores: enough shuffle partitions that each holds
    about ``target_partition_mb`` (and at least two waves of tasks), file splits
    no larger than ``max_file_split_mb``; AQE then coalesces small partitions
    and splits skewed ones at run time."""
    target = target_partition_mb * 1024 * 1024
    parts = max(2 * total_cores, -(-int(input_bytes) // target))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.files.maxPartitionBytes": str(min(max_file_split_mb, target_partition_mb) * 1024 * 1024),
    }
