"""Run logs read from files (F6 fixture) and streaming behaviour (late rows, final state)."""

import os
import tempfile

from pyspark.sql import functions as F

from prefspark.functions import report as R
from prefspark.operators import report as RP
from prefspark.streaming import streams as ST


def _write_logs(d):
    files = {
        # training format, repeated line, category before the first header (ignored)
        "ft_rm_UID_llama_30000_1000_0.0003_personal_llm.log": [
            "Metrics for dataset ['chat']: 0.9",
            "Training and Evaluating for user 1",
            "Metrics for User 1: 0.5", "Metrics for User 1: 0.5", "Metrics for User 1: 0.5", "Metrics for User 1: 0.5",
            "Metrics for dataset ['chat']: 0.7",
            "Training and Evaluating for user 2",
            "Metrics for User 2: 0.6",
            "Metrics for dataset ['safety']: 0.4",
        ],
        "id_rm_gemma_psoups.log": [
            "Metrics for dataset [1]: 0.5",
            "Metrics for dataset ['chat']: 0.8",
            "Metrics for dataset [2]: 0.7",
        ],
        "rag_llama_summarization.log": [
            "User accuracy: {'chat': 0.9, 1: 0.5, 'safety': nan, 2: 0.25, 3: None} for model x",
        ],
        "prm_llama_ultrafeedback.log": ["eval_rewards/user_3_accuracies: 0.75", "eval_rewards/user_4_accuracies: 0.25"],
    }
    for name, lines in files.items():
        with open(os.path.join(d, name), "w") as f:
            f.write("\n".join(lines) + "\n")


def _metrics(spark, d):
    a = RP.assemble_run_metrics(RP.read_logs(spark, os.path.join(d, "*.log")))
    out = {}
    for r in a.collect():
        out[(os.path.basename(r.file), r.uid, r.metric)] = r.value
    return out


def test_log_formats(spark):
    d = tempfile.mkdtemp(prefix="logs-", dir="/tmp")
    _write_logs(d)
    m = _metrics(spark, d)
    ft = "ft_rm_UID_llama_30000_1000_0.0003_personal_llm.log"
    assert m[(ft, 1, "accuracy")] == 0.5 and m[(ft, 1, "chat")] == 0.7 and m[(ft, 2, "safety")] == 0.4
    assert (ft, 2, "chat") not in m  # category before the first header belongs to nobody
    assert m[("id_rm_gemma_psoups.log", 1, "chat")] == 0.8
    assert ("id_rm_gemma_psoups.log", 2, "chat") not in m  # user 2 not seen yet
    rag = "rag_llama_summarization.log"
    assert m[(rag, 1, "chat")] == 0.9 and m[(rag, 2, "accuracy")] == 0.25
    assert m[(rag, 2, "safety")] != m[(rag, 2, "safety")]  # nan kept
    assert (rag, 3, "accuracy") not in m  # 'None' is not a number
    assert m[("prm_llama_ultrafeedback.log", 0, "accuracy")] == 0.5  # average of users 3 and 4


def test_run_config_quirks(spark):
    df = spark.createDataFrame([("ft_rm_UID_llama_30000_1000_0.0003_personal_llm.log",), ("x_50__100_y",)], "f string")
    cfg = R.run_config(F.col("f"))
    rows = df.select(*[v.alias(k) for k, v in cfg.items()]).collect()
    assert rows[0].train_size == "30000" and rows[0].method == "ft_rm" and rows[0].learning_rate == "0.0003"
    assert rows[1].epoch == "_50__100_"


def test_stream_final_state_equals_batch(spark):
    ev = spark.createDataFrame(
        [(i, f"2024-01-{1 + i % 6:02d} 0{i % 9}:00:00", i % 5, float(i % 7)) for i in range(300)],
        "event_id long, ts string, user_id long, value double").withColumn("ts", F.to_timestamp("ts"))
    root = ST.scratch(spark, "test-replay")
    ST.replay_by_day(ev, root)
    stream = ST.read_replay(spark, root, ev.schema)
    table = ST.scratch(spark, "test-t02")

    def sink(batch, batch_id):
        ST.upsert_versioned(batch.select(F.date_format("w.start", "yyyy-MM-dd").alias("d"), "user_id", "n"),
                            batch_id, table, ["d", "user_id"])
    ST.run_available(ST.stream_user_accuracy(stream), sink, "test-t02")
    got = sorted(tuple(r) for r in ST.read_latest(spark, table).collect())
    want = sorted(tuple(r) for r in ev.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("d"), "user_id")
                  .agg(F.count(F.lit(1)).alias("n")).collect())
    assert got == want


def test_late_rows_are_dropped(spark):
    # every 10th row is written 6 day-files late: by then its window's state is evicted by the
    # 1-day watermark, so it is dropped (rows arriving while the state still exists are merged)
    ev = spark.createDataFrame(
        [(i, f"2024-01-{1 + i // 50:02d} 12:00:00", i % 3, 1.0) for i in range(300)],
        "event_id long, ts string, user_id long, value double").withColumn("ts", F.to_timestamp("ts"))
    root = ST.scratch(spark, "test-late")
    ST.replay_by_day(ev, root, late_every=10, late_days=6)
    stream = ST.read_replay(spark, root, ev.schema)
    table = ST.scratch(spark, "test-late-t")

    def sink(batch, batch_id):
        ST.upsert_versioned(batch.select(F.date_format("w.start", "yyyy-MM-dd").alias("d"), "user_id", "n"),
                            batch_id, table, ["d", "user_id"])
    ST.run_available(ST.stream_user_accuracy(stream), sink, "test-late")
    total = sum(r.n for r in ST.read_latest(spark, table).collect())
    assert total < 300  # late rows past the watermark were dropped
    assert total >= 300 - 30


def _rows(df):
    return {(os.path.basename(r.file), r.uid, r.metric): (r.value, r.user_kind) for r in df.collect()}


def test_unknown_format_has_one_user_table(spark):
    """All parsers in turn, one table: a category line of the id parser reaches the users of every parser before it, wherever
    the line stands, and its own users only from then on."""
    text = """Metrics for dataset ['chat']: 0.25
Training and Evaluating for user 1
Metrics for User 1: 0.5
Metrics for dataset ['safety']: 0.125
User accuracy: {2: 0.75, 'reasoning': 0.5, 3: 0.25} for model m
User accuracy: {9: 0.75} for model ignored
eval_rewards/user_4_accuracies: 0.625
Metrics for dataset [5]: 0.375
Metrics for dataset ['chat hard']: 0.875
Metrics for dataset [6]: 0.5
Metrics for dataset ['other']: 0.1
Metrics for User 0: 0.9"""
    df = spark.createDataFrame([("/x/run_of_some_kind.log", text)], "file string, text string")
    got = {k[1:]: v[0] for k, v in _rows(RP.assemble_run_metrics(RP.lines_from_text(df))).items()}
    known = {"chat": 0.25, "safety": 0.125, "chat_hard": 0.875}
    want = {(u, m): v for u in (1, 2, 3, 4) for m, v in known.items()}
    want |= {(1, "accuracy"): 0.5, (2, "accuracy"): 0.75, (3, "accuracy"): 0.25, (3, "reasoning"): 0.5, (4, "accuracy"): 0.625,
             (5, "accuracy"): 0.375, (5, "chat_hard"): 0.875, (6, "accuracy"): 0.5}
    want |= {(0, "accuracy"): 0.5, (0, "chat"): 0.25, (0, "safety"): 0.125, (0, "chat_hard"): 0.875, (0, "reasoning"): 0.5}
    assert got == want


def test_training_log_without_metrics_is_read_by_ids(spark):
    text = "Metrics for dataset [3]: 0.5\nMetrics for dataset ['chat']: 0.25\nMetrics for dataset [4]: 0.75"
    df = spark.createDataFrame([("a/FT_RM_x.log", text), ("b/ft_rm_y.log", text + "\nMetrics for User 7: 0.5")], "file string, text string")
    got = {k: v[0] for k, v in _rows(RP.assemble_run_metrics(RP.lines_from_text(df))).items()}
    assert got == {("FT_RM_x.log", 3, "accuracy"): 0.5, ("FT_RM_x.log", 3, "chat"): 0.25, ("FT_RM_x.log", 4, "accuracy"): 0.75,
                   ("FT_RM_x.log", 0, "accuracy"): 0.625, ("FT_RM_x.log", 0, "chat"): 0.25,
                   ("ft_rm_y.log", 7, "accuracy"): 0.5, ("ft_rm_y.log", 0, "accuracy"): 0.5}


def test_assembling_takes_few_exchanges(spark):
    df = spark.createDataFrame([("a.log", "x")], "file string, text string")
    plan = RP.assemble_run_metrics(RP.lines_from_text(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_line_numbers_over_blocks(spark, tmp_path):
    """Files of many blocks have the line numbers of the whole file; empty lines count; no end at the end."""
    texts = {f"{k}.log": "\n".join(f"line {i} " + "é" * (i * k % 50) if i % 7 else "" for i in range(3000)) + "\n" * (k % 2) for k in range(3)}
    for name, t in texts.items():
        (tmp_path / name).write_text(t)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        df = RP.read_logs(spark, str(tmp_path / "*.log"))
        assert df.rdd.getNumPartitions() > 10
        got = sorted((os.path.basename(r.file), r.line_no, r.line) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == sorted((n, i, x) for n, t in texts.items() for i, x in enumerate(t.removesuffix("\n").split("\n")))


def test_growing_logs_equal_one_full_read(spark, tmp_path):
    """Logs grow between triggers, within lines too; headers and users of earlier triggers count; a training log is read by ids
    until its first metric."""
    texts = {
        "ft_rm_a.log": "Metrics for dataset ['chat']: 0.9\nTraining and Evaluating for user 1\nnoise\nMetrics for User 1: 0.5\n"
                       "Metrics for dataset ['chat']: 0.7\nTraining and Evaluating for user 2\nMetrics for dataset ['safety']: 0.25\nMetrics for User 2: 0.75\n",
        "id_rm_b.log": "Metrics for dataset [1]: 0.5\nMetrics for dataset ['chat']: 0.75\nMetrics for dataset [2]: 0.25\nMetrics for dataset ['chat']: 0.5\n",
        "ft_rm_c.log": "Metrics for dataset [8]: 0.5\nMetrics for dataset ['safety']: 0.75\nMetrics for User 3: 0.125\n",
        "other.log": "Metrics for dataset [1]: 0.5\nMetrics for dataset ['chat']: 0.75\neval_rewards/user_5_accuracies: 0.5\nUser accuracy: {6: 0.25} for model x\n",
    }
    logs, table, ckpt = str(tmp_path / "logs"), ST.scratch(spark, "grow-table"), ST.scratch(spark, "grow-ckpt")
    os.makedirs(logs)
    shares = (0.0, 0.3, 0.37, 0.7, 1.0)
    for a, b in zip(shares, shares[1:]):
        for name, t in texts.items():
            with open(os.path.join(logs, name), "a") as f:
                f.write(t[int(len(t) * a): int(len(t) * b)])
        got = _rows(ST.stream_log_metrics(spark, logs, table, "grow", pattern="*.log", checkpoint=ckpt))
    assert got == _rows(RP.assemble_run_metrics(RP.read_logs(spark, logs + "/*.log")))
    assert ("ft_rm_c.log", 8, "accuracy") not in got and got[("ft_rm_c.log", 3, "accuracy")][0] == 0.125
    with open(os.path.join(logs, "id_rm_b.log"), "a") as f:
        f.write("Metrics for dataset [2]: 0.875")
    held = _rows(ST.stream_log_metrics(spark, logs, table, "grow", pattern="*.log", checkpoint=ckpt))
    assert held[("id_rm_b.log", 2, "accuracy")][0] == 0.25    # not a whole line yet
    done = _rows(ST.stream_log_metrics(spark, logs, table, "grow", pattern="*.log", checkpoint=ckpt, finished=True))
    assert done[("id_rm_b.log", 2, "accuracy")][0] == 0.875


def test_growing_source_blocks(tmp_path):
    """Every line comes once, whatever the block size and wherever ranges start."""
    from prefspark.sources.growing import GrowingTextReader
    text = "".join("x" * (i * 7 % 23) + f"{i}" + "\n" for i in range(200)) + "tail"
    path = tmp_path / "a.txt"
    for size in (1, 2, 5, 64, 10_000):
        path.write_text(text[:777])
        reader = GrowingTextReader({"path": str(tmp_path), "block_bytes": str(size)})
        one = reader.latestOffset()
        path.write_text(text)
        two = reader.latestOffset()
        done = GrowingTextReader({"path": str(tmp_path), "finished": "true"}).latestOffset()
        lines = [(at, x) for a, b in ((reader.initialOffset(), one), (one, two), (two, done)) for p in reader.partitions(a, b)
                 for batch in reader.read(p) for at, x in zip(batch["at"].to_pylist(), batch["line"].to_pylist())]
        assert [x for _, x in lines] == text.split("\n")
        assert [text.encode()[at: at + len(x)].decode() for at, x in lines] == [x for _, x in lines]
