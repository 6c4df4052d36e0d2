"""Run logs -> metric tables -> reports.

A log file is one run; ordering rules ("the latest header above", "users
seen so far", "last value wins") are evaluated per file, by one table per run.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import report as R
from .joins import broadcast_if_small


# S07 ------------------------------------------------------------------------
def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """All log files under ``path`` (a glob) -> (file, line_no, line); line numbers from 0.

    Files are read by byte blocks, so a large one is many tasks.  A line's number is its rank in its
    block, which is read in order, plus the lines of the file's blocks before: one narrow row a block, broadcast while
    they are few."""
    m = F.col("_metadata")
    raw = (spark.read.option("lineSep", "\n").text(path)
           .select(m["file_path"].alias("file"), m["file_block_start"].alias("_block"), F.monotonically_increasing_id().alias("_id"),
                   F.col("value").alias("line")))
    blocks = raw.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_block")) - F.col("_n")
    starts = broadcast_if_small(blocks.select("file", "_block", (before - F.col("_first")).alias("_shift")))
    return raw.join(starts, ["file", "_block"]).select("file", (F.col("_id") + F.col("_shift")).alias("line_no"), "line")


def lines_from_text(df: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """Whole log texts held in a table -> (file, line_no, line)."""
    return df.select(F.col(file).alias("file"), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))


# F30 ------------------------------------------------------------------------
METRIC_ROWS = "file string, uid long, metric string, value double, user_kind string"


def _assemble(batches):
    """Parsed lines, sorted by file and line -> the rows of each file.  Only the run table of one file is held."""
    schema = pa.schema([("file", pa.string()), ("uid", pa.int64()), ("metric", pa.string()), ("value", pa.float64()), ("user_kind", pa.string())])
    now, run = None, None

    def rows():
        cols = zip(*((now, *r) for r in run.rows()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)] or [pa.array([], t) for t in schema.types], schema=schema)

    for b in batches:
        for file, fmt, kind, uid, dataset, value in zip(*(c.to_pylist() for c in b.columns)):
            if run is None or file != now:
                if run is not None:
                    yield rows()
                now, run = file, R.RunTable(fmt)
            run.feed(kind, uid, dataset, value)
    if run is not None:
        yield rows()


def metric_lines(lines: DataFrame, order: str = "line_no") -> DataFrame:
    """(file, ``order``, fmt, kind, uid, dataset, value): the lines that carry metrics, parsed."""
    return (lines.select("file", order, R.log_format(F.col("file")).alias("fmt"), R.parse_line(F.col("line")).alias("_p"))
            .filter(F.col("_p.kind").isNotNull()).select("file", order, "fmt", "_p.*"))


def assemble_run_metrics(lines: DataFrame) -> DataFrame:
    """Combine parsed lines into (file, uid, metric, value, user_kind) with the reference's rules.

    * training format: a category score belongs to the latest header above it;
    * id format: a category score applies to every user seen *before* it;
    * dictionary format: category scores given before a user apply to it;
    * prm format: user accuracies only;
    * the format comes from the path (``log_format``); a training-format file
      without any user metric is re-read in the id format; an unknown format goes through all
      parsers with one user table;
    * always the last value wins; uid 0 is then the mean over the other users.

    Lines without metrics go before the exchange; a file's lines are then streamed in order through one run table.
    """
    return (metric_lines(lines).repartition("file").sortWithinPartitions("file", "line_no")
            .select("file", "fmt", "kind", "uid", "dataset", "value").mapInArrow(_assemble, METRIC_ROWS))


# G09 / G10 ------------------------------------------------------------------
def macro_average(metrics: DataFrame, by=("run", "metric"), uid: str = "uid", value: str = "value") -> DataFrame:
    from .aggregate import macro_average as _m
    return _m(metrics, by, uid, value)


# G23 ------------------------------------------------------------------------
def report_wide(metrics: DataFrame, metric: str = "accuracy", missing: str = "NA",
                users: list[int] | None = None) -> DataFrame:
    """One row per run: the average then one column per user, formatted ``%.3f`` / ``nan`` /
    ``missing``.  ``users`` fixes the pivot columns (else they are discovered with one small
    distinct query)."""
    m = metrics.filter(F.col("metric") == metric)
    cfg = R.run_config(F.col("file"))
    base = m.select("file", *[v.alias(k) for k, v in cfg.items()]).distinct()
    if users is None:
        piv = m.groupBy("file").pivot("uid")
    else:
        piv = m.groupBy("file").pivot("uid", users)
    wide = piv.agg(F.first("value"))
    cols = [c for c in wide.columns if c != "file"]
    out = wide.select("file", *[R.format_metric(F.col(f"`{c}`"), missing).alias(f"user_{c}" if c != "0" else "average")
                                for c in cols])
    return base.join(out, "file")
