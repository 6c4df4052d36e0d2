"""Structured Streaming operators.

Late rows follow the watermark: rows older than (max event time seen - delay)
are dropped by the stateful operators.  Sinks are idempotent per micro-batch
(a re-run batch rewrites the same version), so a lost executor or a restarted
query does not double count.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..functions.report import RunTable
from ..session import ensure_checkpoint_dir
from ..sources.growing import GrowingText


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


# ---------------------------------------------------------------- replay (F8)
def replay_by_day(df: DataFrame, root: str, ts: str = "ts", late_every: int | None = None,
                  late_days: int = 2) -> list[str]:
    """Write ``df`` as one parquet folder per event day, oldest first, each with a later
    modification time, so a file stream reads them in day order (one day per trigger with
    ``maxFilesPerTrigger=1``).  With ``late_every`` every n-th row (by ``event_id``) is moved
    ``late_days`` files later.  Returns the day folders in order."""
    spark = df.sparkSession
    d = df.withColumn("_day", F.to_date(F.col(ts)))
    if late_every:
        d = d.withColumn("_file_day", F.when(F.col("event_id") % late_every == 0, F.date_add("_day", late_days))
                         .otherwise(F.col("_day")))
    else:
        d = d.withColumn("_file_day", F.col("_day"))
    # one job writes every day folder (each task writes its own rows of each day, so no task
    # holds a whole day); then the folders get increasing modification times
    d.withColumn("day", F.col("_file_day").cast("string")).drop("_day", "_file_day") \
        .write.mode("overwrite").partitionBy("day").parquet(root)
    path, fs = _fs(spark, root)
    dirs = sorted((st.getPath() for st in fs.listStatus(path) if st.getPath().getName().startswith("day=")),
                  key=lambda p: p.getName())
    t0 = 1_700_000_000_000
    paths = []
    for i, dp in enumerate(dirs):  # one folder per day: a bounded listing
        for st in fs.listStatus(dp):
            fs.setTimes(st.getPath(), t0 + i * 60_000, -1)
        paths.append(dp.toString())
    return paths


def read_replay(spark: SparkSession, root: str, schema: T.StructType, max_files: int = 1) -> DataFrame:
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
            .option("recursiveFileLookup", "true").parquet(root))


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]):
    """Session settings for the time of a block."""
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], name: str,
                  output_mode: str = "update", checkpoint: str | None = None) -> None:
    """Run a streaming query over everything available, then stop (``availableNow``).  With a ``checkpoint`` of
    its own the next run goes on where this one stopped."""
    spark = stream.sparkSession
    q = (stream.writeStream.outputMode(output_mode).foreachBatch(sink)
         .option("checkpointLocation", checkpoint or scratch(spark, f"ckpt-{name}"))
         .trigger(availableNow=True).start())
    q.awaitTermination()


# ---------------------------------------------------------------- versioned upsert sink
def latest_version(spark: SparkSession, root: str) -> str | None:
    path, fs = _fs(spark, root)
    if not fs.exists(path):
        return None
    vs = sorted(st.getPath().getName() for st in fs.listStatus(path) if st.getPath().getName().startswith("v"))
    return f"{root.rstrip('/')}/{vs[-1]}" if vs else None


def upsert_versioned(batch: DataFrame, batch_id: int, root: str, keys: list[str]) -> None:
    """Append a micro-batch to a change log kept as ``v<batch id>`` folders.

    Only the batch's rows are written (no rewrite of the table per batch);
    re-running a batch overwrites its own folder, so a retried batch is not
    counted twice.  ``read_latest`` resolves the log: per key the row of the
    highest batch id wins (last value wins)."""
    target = f"{root.rstrip('/')}/v{batch_id:010d}"
    batch.withColumn("_batch", F.lit(int(batch_id)).cast("long")).withColumn(
        "_keys", F.array(*[F.lit(k) for k in keys])).write.mode("overwrite").parquet(target)


def read_latest(spark: SparkSession, root: str, schema: T.StructType | None = None) -> DataFrame:
    """The current table: per key, the row from the newest batch (a ``max_by`` aggregate, so a
    hot key is reduced map-side)."""
    if latest_version(spark, root) is None:
        return spark.createDataFrame([], schema)
    log = spark.read.option("recursiveFileLookup", "true").parquet(root)
    keys = log.select("_keys").first()[0]
    rest = [c for c in log.columns if c not in keys and c not in ("_batch", "_keys")]
    cur = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_row"))
    return cur.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


# ---------------------------------------------------------------- T01
def stream_dedupe_annotations(stream: DataFrame, keys: list[str], ts: str = "ts",
                              delay: str = "1 day") -> DataFrame:
    """Append-only, unique keys, first wins (within the watermark)."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


# ---------------------------------------------------------------- T02
def stream_user_accuracy(stream: DataFrame, window: str = "1 day", ts: str = "ts", uid: str = "user_id",
                         value: str = "value", delay: str = "1 day") -> DataFrame:
    """Tumbling-window mean per user (a window flushes like one logging phase)."""
    return (stream.withWatermark(ts, delay)
            .groupBy(F.window(ts, window).alias("w"), F.col(uid))
            .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value")))


# ---------------------------------------------------------------- T03
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RunProcessor(StatefulProcessor):
    """The run table of one log file, carried from batch to batch (``functions.report.RunTable``).

    A batch's lines of a file continue the table where the last ones left it: the header above, the users seen.  Every row of
    the file is sent again, and rows that no longer stand (a training log without metrics was read by ids
    until its first metric) once more without a kind."""

    def init(self, handle) -> None:
        self.run = handle.getValueState("run", "body string")

    def handleInputRows(self, key, rows, timerValues):
        import json

        (file,) = key
        lines = pd.concat(list(rows)).sort_values("at", kind="stable")
        fmt = lines["fmt"].iloc[0]
        table = RunTable(fmt, json.loads(self.run.get()[0])) if self.run.exists() else RunTable(fmt)
        before = {r[:2] for r in table.rows()}
        for kind, uid, dataset, value in zip(*(lines[c].tolist() for c in ("kind", "uid", "dataset", "value"))):
            table.feed(kind, None if pd.isna(uid) else int(uid), dataset, value)
        self.run.update((json.dumps(table.state),))
        now = table.rows()
        gone = [(u, m, None, None) for u, m in sorted(before - {r[:2] for r in now})]
        # values as text: pandas has no null beside NaN
        yield pd.DataFrame([(file, u, m, None if v is None else repr(v), k) for u, m, v, k in now + gone], columns=["file", "uid", "metric", "value", "user_kind"])

    def close(self) -> None:
        pass


def growing_lines(spark: SparkSession, log_dir: str, pattern: str = "*", finished: bool = False) -> DataFrame:
    """A stream of (file, at, line) over the files under ``log_dir``, which may grow while it runs."""
    spark.dataSource.register(GrowingText)
    return (spark.readStream.format("growing_text").option("path", log_dir).option("pattern", pattern)
            .option("finished", str(finished).lower()).load())


def stream_log_metrics(spark: SparkSession, log_dir: str, table_root: str, name: str = "logs", pattern: str = "*",
                       finished: bool = False, checkpoint: str | None = None) -> DataFrame:
    """Growing run logs -> the metrics table (F29/F30); the last value per (file, uid, metric) wins.

    Reads what the files under ``log_dir`` have gained since the last call with the same ``checkpoint`` and
    returns the table as it then stands.  Each file's run table is keyed state, so a header or a
    user of an earlier trigger still counts; lines without metrics go before the exchange.  ``finished``
    also takes a last line without an end."""
    from ..operators.report import METRIC_ROWS, metric_lines
    lines = metric_lines(growing_lines(spark, log_dir, pattern, finished), order="at")
    rows = lines.groupBy("file").transformWithStateInPandas(
        RunProcessor(), METRIC_ROWS.replace("value double", "value string"), "Update", "None")
    rows = rows.withColumn("value", F.col("value").cast("double"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        upsert_versioned(batch, batch_id, table_root, ["file", "uid", "metric"])

    with settings(spark, {STATE_STORE: ROCKS}):
        run_available(rows, sink, name, checkpoint=checkpoint)
    return read_latest(spark, table_root, METRIC_ROWS).filter("user_kind IS NOT NULL")
