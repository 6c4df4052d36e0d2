"""Session helpers.

Library code never creates a session; it receives DataFrames.  These
helpers are for tests, the bench and command-line use.
"""

from __future__ import annotations

import gc
import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files of dropped intermediates are removed by the context cleaner
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def recommended_conf(input_bytes: int, executors: int, cores_per_executor: int = 4,
                     target_partition_bytes: int = 256 << 20) -> dict:
    """Settings for a cluster run sized from the input: scan splits and shuffle partitions of
    about ``target_partition_bytes`` (so a task's share fits executor memory and spills
    little), at least two tasks per core, AQE coalescing and skew splitting on."""
    slots = max(1, executors * cores_per_executor)
    # shuffles carry projected columns (ids, hashes, scores), about a quarter of the input or less;
    # AQE coalesces partitions that come out smaller
    shuffle_parts = max(2 * slots, -(-input_bytes // (4 * target_partition_bytes)))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(shuffle_parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }


def local_session(cores: int = 8, shuffle_partitions: int | None = None,
                  app: str = "prefspark", driver_memory: str = "16g",
                  extra: dict | None = None) -> SparkSession:
    """A local session for tests and the bench (no UI, UTC, AQE on)."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.driver.memory", driver_memory)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores)))
    for k, v in {**DEFAULT_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` names a shared folder and is used as is.  Only a local session without it gets a
    fresh scratch folder; on a cluster a machine-local folder would be lost with its executor, so that is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="prefspark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


_open_scopes: list[list] = []


def scratch_table_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table inside the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    path = os.path.join(base, "tables", name)
    when_scratch_drops(lambda: delete_scratch(spark, path))
    return path


def delete_scratch(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def when_scratch_drops(action) -> None:
    """Call ``action`` when the innermost ``scratch_dropped`` block ends; without one the scratch stays."""
    if _open_scopes:
        _open_scopes[-1].append(action)


@contextmanager
def scratch_dropped():
    """Delete the intermediate tables made within the block when it ends.  Results are lazy and read them, so what
    is wanted must be written inside (to a path that the caller chose before)."""
    made: list = []
    _open_scopes.append(made)
    try:
        yield
    finally:
        _open_scopes.remove(made)
        for action in reversed(made):
            action()


def materialize(df):
    """Cut lineage: write ``df`` to the shared checkpoint folder and read it back.

    Used where one intermediate feeds many branches of a plan (each branch
    would otherwise recompute it) and to make recovery after a lost executor
    start from the written table instead of the sources.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_finished(spark) -> None:
    """Let Spark remove the shuffle files of finished rounds now; its cleaner acts when the driver's garbage is
    collected, which a driver with little to do puts off."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
