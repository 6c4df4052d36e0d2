"""Streaming queries: the driver tables replayed as file streams, run to completion, and the
final state compared with the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import streams as ST
from . import fixtures as FX
from . import logs as LG
from .registry import query, with_ctes


def replayed_events(spark: SparkSession, sf: str, late_every: int | None = None) -> tuple[DataFrame, str]:
    # watermarks need TIMESTAMP (the table stores TIMESTAMP_NTZ wall-clock times)
    ev = FX.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id",
                                              "event_type", "value")
    root = ST.scratch(spark, "events-replay")
    ST.replay_by_day(ev, root, late_every=late_every)
    # five day-files per micro-batch: still in event-time order, fewer state-store commits
    return ST.read_replay(spark, root, ev.schema, max_files=5), root


@query("t01_stream_dedupe_annotations", """
SELECT DISTINCT user_id, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events""")
def t01(spark, sf):
    stream, _ = replayed_events(spark, sf)
    s = stream.withColumn("day", F.to_date("ts").cast("string"))
    d = ST.stream_dedupe_annotations(s, ["user_id", "event_type", "day"])
    out = ST.scratch(spark, "t01-out")

    def sink(batch, batch_id):
        # one folder per batch id, overwritten on a retry: exactly-once output
        batch.select("user_id", "event_type", "day").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    ST.run_available(d, sink, "t01", output_mode="append")
    return spark.read.parquet(out).select("user_id", "event_type", "day")


@query("t02_stream_user_accuracy", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS window_start, user_id, count(*) AS n, round(avg(value), 6) AS mean_value
FROM events GROUP BY 1, 2""")
def t02(spark, sf):
    stream, _ = replayed_events(spark, sf)
    agg = ST.stream_user_accuracy(stream)
    table = ST.scratch(spark, "t02-table")

    def sink(batch, batch_id):
        b = batch.select(F.date_format(F.col("w.start"), "yyyy-MM-dd").alias("window_start"), "user_id", "n",
                         "mean_value")
        ST.upsert_versioned(b, batch_id, table, ["window_start", "user_id"])
    ST.run_available(agg, sink, "t02", output_mode="update")
    res = ST.read_latest(spark, table)
    return res.select("window_start", "user_id", "n", F.round("mean_value", 6).alias("mean_value"))


@query("t03_stream_log_metrics", LG.BASE + """
SELECT regexp_extract(file, '[^/]+$', 0) AS file, CAST(uid AS BIGINT) AS uid, metric, round(value, 12) AS value, user_kind
FROM expect""")
def t03(spark, sf):
    texts = LG.log_texts(spark, sf).withColumn("name", F.regexp_extract("file", "[^/]+$", 0))
    log_dir = ST.scratch(spark, "logs-in")
    texts.select("name", "text").write.mode("overwrite").partitionBy("name").text(log_dir)
    res = ST.stream_log_metrics(spark, log_dir, ST.scratch(spark, "t03-table"), "t03", pattern="part-*")
    return res.select(F.regexp_extract("file", "name=([^/]+)", 1).alias("file"), "uid", "metric",
                      F.round("value", 12).alias("value"), "user_kind")
