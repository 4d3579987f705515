"""Session helpers.

The library never creates its own cluster settings beyond what a job needs:
UTC session time zone (every date rule in the operators is UTC), AQE on
(runtime broadcast of small aggregated sides, skew-join splitting, partition
coalescing), shuffle files that go with their job and a reliable checkpoint
directory for the iterative graph jobs.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SCALE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # parquet footers answer count(*) without reading pages (dataset_status)
    "spark.sql.parquet.aggregatePushdown": "true",
    # the shuffle files of a job go when it ends, not when the driver happens to
    # collect its garbage (Spark 4.1; a plan that runs again makes them again)
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def get_spark(master: str | None = None, app: str = "bidlens",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Return the active session or build one with the settings the
    operators rely on.  On a cluster ``master`` stays ``None`` and the
    launcher's settings win; only unset keys are filled in."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = b.config("spark.ui.enabled", "false")
    # per-level graph checkpoints are removed once no DataFrame references them
    b = b.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    for k, v in _SCALE_CONF.items():
        if k == "spark.sql.session.timeZone":
            spark.conf.set(k, v)  # operators assume UTC wall-clock semantics
        elif spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the launcher sets it to shared storage and it is used as is;
    unset, it is an error there.  Only in local mode (tests), where all tasks
    share one machine, a scratch folder is created.  Removing unreferenced
    checkpoints (spark.cleaner.referenceTracking.cleanCheckpoints) is a
    launcher setting: it can't be changed in a running session."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="bidlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss; never a local checkpoint)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of ``df`` as Parquet in a folder of their own under the shared
    checkpoint folder (or ``path``), read back.  For wide tables that several
    aggregates read: a checkpoint holds whole uncompressed rows, this about a
    fifth of it, and every reader takes only its columns."""
    path = path or f"{checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
