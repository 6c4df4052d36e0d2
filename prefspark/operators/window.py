"""Window / order-dependent operators and global numbering.

Global numbering (``dense_position``) never uses a window without
``partitionBy`` (which would pull every row into one task).  The input is computed once
and written to the shared folder; the written rows go through one range exchange, are sorted
and written again with their place in their partition; a partition's offset (one
narrow row a partition, a proven bound) is added on read.  So every branch and every
retried stage reads the same numbers.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa  # the Arrow UDF's type hints are resolved in this module
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.util import at
from ..session import delete_scratch, scratch_table_path


ROWS_PER_BUCKET = 1_000_000   # target rows sorted by one task
MAX_BUCKETS = 1 << 16
PREFIX = 64                   # characters of a text key that choose its partition
_LOCAL = (1 << 33) - 1        # a row's number within its partition (monotonically_increasing_id)


def _stored(df: DataFrame, name: str) -> tuple[str, int]:
    """The path in the shared folder to which ``df`` is written, and its row count."""
    path = scratch_table_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    # Parquet has no column of nulls only
    void = {f.name: F.col(f.name).cast("string") for f in df.schema.fields if isinstance(f.dataType, T.NullType)}
    seen = Observation()
    df.withColumns(void).observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return path, seen.get["n"]


def written(df: DataFrame, name: str = "written") -> tuple[DataFrame, int]:
    """``df`` computed once into the shared folder, as read back from there, and its row count."""
    path, n = _stored(df, name)
    return df.sparkSession.read.parquet(path), n


def _columns(order) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in ([order] if isinstance(order, (str, Column)) else list(order))]


def _ordered(df: DataFrame, order, n_buckets: int | None = None) -> tuple[DataFrame, int, int]:
    """(rows with ``_bk`` and ``_local``, buckets, row count): sorted by ``order`` over order-preserving buckets.

    Text keys choose their bucket by their first ``PREFIX`` characters, so bounds stay short; a task sorts by the
    whole key.  Equal keys share a bucket.  NULL keys come first.
    """
    cols = _columns(order)
    path, n = _stored(df, "numbered")
    src = df.sparkSession.read.parquet(path)
    nb = n_buckets or min(MAX_BUCKETS, max(1, -(-n // ROWS_PER_BUCKET)))
    kinds = src.select(*[c.alias(f"k{i}") for i, c in enumerate(cols)]).schema.fields
    # behind a longer text the keys after it say nothing about the order, so such rows have none
    bounds, whole = [], F.lit(True)
    for c, k in zip(cols, kinds):
        if isinstance(k.dataType, T.StringType):
            longer = F.coalesce(F.length(c) > PREFIX, F.lit(False))
            bounds += [F.when(whole, F.substring(c, 1, PREFIX)), F.when(whole, longer)]
            whole = whole & ~longer
        else:
            bounds.append(F.when(whole, c))
    rows = (src.repartition(1) if nb == 1 else src.repartitionByRange(nb, *bounds)).sortWithinPartitions(*cols)
    rows = rows.withColumns({"_bk": F.spark_partition_id(), "_local": F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL))})
    if nb == 1:
        return rows, nb, n
    rows = written(rows, "ordered")[0]
    # nothing reads the unsorted copy any more
    delete_scratch(df.sparkSession, path)
    return rows, nb, n


def range_buckets(df: DataFrame, order, n_buckets: int | None = None, out: str = "_bucket") -> DataFrame:
    """Assign every row an order-preserving bucket, the same for every reader of the result."""
    return _ordered(df, order, n_buckets)[0].withColumnRenamed("_bk", out).drop("_local")


def numbered(df: DataFrame, order, out: str = "pos", base: int = 0, n_buckets: int | None = None) -> tuple[DataFrame, int]:
    """``dense_position`` and the row count."""
    rows, nb, n = _ordered(df, order, n_buckets)
    if nb == 1:
        return rows.withColumn(out, F.col("_local") + F.lit(base)).drop("_bk", "_local"), n
    counts = rows.groupBy("_bk").agg(F.count(F.lit(1)).alias("_n"))
    offs = counts.select("_bk", F.coalesce(F.sum("_n").over(Window.orderBy("_bk").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    res = rows.join(F.broadcast(offs), "_bk")
    return res.withColumn(out, F.col("_off") + F.col("_local") + F.lit(base)).drop("_bk", "_local", "_off"), n


def dense_position(df: DataFrame, order, out: str = "pos", base: int = 0,
                   n_buckets: int | None = None) -> DataFrame:
    """Add a dense ``base``-based position in ``order`` (a unique key; NULLs first)."""
    return numbered(df, order, out, base, n_buckets)[0]


def group_position(df: DataFrame, keys, order, out: str = "rank", base: int = 1,
                   n_buckets: int | None = None) -> DataFrame:
    """Per-group ``row_number`` (``base``-based) that survives hot keys.

    ``Window.partitionBy(key)`` sends a whole group to one task; here rows are
    numbered globally in (keys, order) by order-preserving buckets -- which
    split a hot group over many tasks -- and each row's rank is its global
    position minus its group's first position (a per-group ``min`` with
    partial aggregation, joined back on the keys).
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, (str, Column)) else list(order)
    pos = dense_position(df, keys + order, "_gpos", base=0, n_buckets=n_buckets)
    first = pos.groupBy(*keys).agg(F.min("_gpos").alias("_gfirst"))
    return (pos.join(first, keys, "inner")
               .withColumn(out, F.col("_gpos") - F.col("_gfirst") + F.lit(base))
               .drop("_gpos", "_gfirst"))


def first_by(df: DataFrame, keys, order) -> DataFrame:
    """First row per key by ``order`` as an aggregate (``min_by`` of the row), so a hot key is
    reduced map-side instead of being sorted in one task."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, (str, Column)) else list(order)
    rest = [c for c in df.columns if c not in keys]
    ordk = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    g = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), ordk).alias("_row"))
    return g.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


# W01 ------------------------------------------------------------------------
def sample_number(df: DataFrame, samples: str = "outputs", out: str = "output",
                  pos: str = "sample_no") -> DataFrame:
    """Explode a list of samples, numbered 0.. within each source row."""
    rest = [c for c in df.columns if c != samples]
    return df.select(*rest, F.posexplode(samples).alias(pos, out))


# W02 ------------------------------------------------------------------------
def question_key(df: DataFrame, split: str = "split", order: str = "cmp_id",
                 split_order: Iterable[str] = ("train", "test"), out: str = "qkey") -> DataFrame:
    """Running 1-based key continuing from the first split into the next."""
    rank = None
    for i, s in enumerate(split_order):
        cond = F.col(split) == s
        rank = F.when(cond, i) if rank is None else rank.when(cond, i)
    rank = rank.otherwise(len(list(split_order)))
    d = df.withColumn("_split_rank", rank)
    return dense_position(d, ["_split_rank", order], out, base=1).drop("_split_rank")


# W03 ------------------------------------------------------------------------
def segment_offsets(df: DataFrame, n: str = "context_length", order: str = "Index",
                    start: str = "start", end: str = "end") -> DataFrame:
    """Cumulative sum of counts in ``order`` -> (start, end) per row (end exclusive).

    Distributed prefix sum: per-partition totals after range partitioning,
    offsets from the small total table, then a within-partition running sum.
    """
    rows, nb, _ = _ordered(df, order)
    w = Window.partitionBy("_bk").orderBy("_local").rowsBetween(Window.unboundedPreceding, 0)
    res = rows.withColumn(end, F.sum(n).over(w))
    if nb > 1:
        tot = rows.groupBy("_bk").agg(F.sum(n).alias("_t"))
        offs = tot.select("_bk", F.coalesce(F.sum("_t").over(
            Window.orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
        res = res.join(F.broadcast(offs), "_bk").withColumn(end, F.col("_off") + F.col(end)).drop("_off")
    return res.withColumn(start, F.col(end) - F.col(n)).drop("_bk", "_local")


# W04 / W05 ----------------------------------------------------------------
def _take(batch: pa.RecordBatch, rows: list[int], keep: list[str], **more) -> pa.RecordBatch:
    """Some rows of a batch with further text columns."""
    at_rows = pa.array(rows, pa.int64())
    arrays = [batch.column(batch.schema.get_field_index(c)).take(at_rows) for c in keep]
    return pa.RecordBatch.from_arrays([*arrays, *(pa.array(v, pa.string()) for v in more.values())], names=[*keep, *more])


def _streamed(df: DataFrame, dialog: str, order: list[str]) -> DataFrame:
    """Rows dealt by dialog, each dialog's rows adjacent and in order."""
    return df.repartition(dialog).sortWithinPartitions(dialog, *order)


def _schema(df: DataFrame, keep: list[str], *texts: str) -> T.StructType:
    return T.StructType([df.schema[c] for c in keep] + [T.StructField(t, T.StringType()) for t in texts])


def dialog_history(turns: DataFrame, max_prompt_chars: int, prefix_len: int = 0,
                   max_text: int | None = None, dialog: str = "conv_id", turn: str = "turn",
                   user_text: str = "user_text", chosen: str = "chosen",
                   rejected: str = "rejected", user_wrap=("", ""), chosen_wrap=("", "")) -> DataFrame:
    """Running prompt per dialog with *persistent* truncation.

    ``user_wrap`` / ``chosen_wrap`` are (prefix, suffix) put around the texts
    when they enter the history (role headers); the length rules use the bare
    texts.

    Per turn, in order: history += user text; if the turn is usable (user and
    chosen present and ``len(user)+len(chosen) < max_text``) the history is
    cut to its last ``max_prompt_chars - prefix_len`` characters -- the cut
    persists for later turns -- and the pair is emitted when also
    ``len(user)+len(rejected) <= max_text``; then history += chosen text.

    Turns are streamed in order through Arrow batches; a task holds one batch and the history, which
    goes on over batches, so a dialog may have any number of turns.  Turns of equal
    number follow their texts.
    """
    keep = max(max_prompt_chars - prefix_len, 0)
    limit = float("inf") if max_text is None else max_text
    cols = [dialog, turn, user_text, chosen, rejected]

    def fold(batches):
        now, history = None, ""
        for b in batches:
            rows, histories = [], []
            for i, (d, _, u, c, r) in enumerate(zip(*(x.to_pylist() for x in b.columns))):
                if (d,) != now:
                    now, history = (d,), ""
                if u is not None:
                    history += user_wrap[0] + u + user_wrap[1]
                if u is not None and c is not None and len(u) + len(c) < limit:
                    history = history[len(history) - keep:] if len(history) > keep else history
                    if r is not None and len(u) + len(r) <= limit:
                        rows.append(i)
                        histories.append(history)
                if c is not None:
                    history += chosen_wrap[0] + c + chosen_wrap[1]
            yield _take(b, rows, [dialog, turn, chosen, rejected], history=histories)

    out = _streamed(turns.select(*cols), dialog, [turn, user_text, chosen, rejected]).mapInArrow(
        fold, _schema(turns, [dialog, turn, chosen, rejected], "history"))
    return out.select(dialog, turn, "history", chosen, rejected)


def running_history(df: DataFrame, max_chars: int, sep: str = "|", dialog: str = "conv_id", turn: str = "turn",
                    text: str = "text", out: str = "history") -> DataFrame:
    """Per turn the last ``max_chars`` characters of the dialog's texts so far, joined by ``sep`` (W05 works on it: a
    shorter tail of a row is the tail of the whole history).  Streamed as ``dialog_history``; NULL texts are left out."""
    def fold(batches):
        now, history, empty = None, "", True
        for b in batches:
            histories = []
            for d, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if (d,) != now:
                    now, history, empty = (d,), "", True
                if x is not None:
                    history = (history if empty else history + sep) + x
                    history, empty = history[max(0, len(history) - max_chars):], False
                histories.append(history)
            yield _take(b, list(range(b.num_rows)), [dialog, turn], **{out: histories})

    return _streamed(df.select(dialog, turn, text), dialog, [turn, text]).mapInArrow(fold, _schema(df, [dialog, turn], out))


def history_tail(df: DataFrame, max_chars: int, prefix: str | None = None, history: str = "history",
                 out: str | None = None) -> DataFrame:
    """Non-persistent cut: keep the last ``max_chars - len(prefix)`` characters (none if <= 0)."""
    h = F.col(history)
    n = F.lit(max_chars) - (F.length(prefix) if prefix else F.lit(0))
    res = F.when(n <= 0, F.lit("")).when(F.length(h) > n, F.right(h, n)).otherwise(h)
    return df.withColumn(out or history, res)


# W06 ------------------------------------------------------------------------
SCAN_BLOCK = 128


def discounted_sums(values: np.ndarray, starts: np.ndarray, factor: float) -> np.ndarray:
    """out[i] = values[i] + factor * out[i + 1], anew from each of ``starts`` (ascending, the first is 0).

    Segments are cut into blocks of ``SCAN_BLOCK`` from their ends; a block's inner sums are one product with the powers of the
    factor, and block ends pass on what comes behind, for all segments at once.
    """
    n, size = len(values), SCAN_BLOCK
    lens = np.diff(np.append(starts, n))
    blocks = -(-lens // size)
    first = np.cumsum(blocks) - blocks
    # a segment's last value ends its last block
    seg = np.repeat(np.arange(len(starts)), lens)
    place = first[seg] * size + (blocks * size - lens)[seg] + np.arange(n) - np.repeat(starts, lens)
    grid = np.zeros((int(blocks.sum()), size))
    grid.ravel()[place] = values
    power = np.subtract.outer(np.arange(size), np.arange(size))
    grid = grid @ np.where(power >= 0, factor ** np.maximum(power, 0), 0.0)
    tail = factor ** np.arange(size, 0, -1)
    for k in range(2, int(blocks.max(initial=0)) + 1):
        at_block = (first + blocks - k)[blocks >= k]
        grid[at_block] += grid[at_block + 1, :1] * tail
    return grid.ravel()[place]


def gae(df: DataFrame, gamma: float, lam: float, rewards: str = "rewards", values: str = "values",
        out_adv: str = "advantages", out_ret: str = "returns") -> DataFrame:
    """Generalised advantage estimate on one row per trajectory (arrays).

    A_t = d_t + gamma*lam*A_{t+1}, d_t = r_t + gamma*V_{t+1} - V_t, V_T = 0; returns = A + V.  One scan over all
    arrays of an Arrow batch (``discounted_sums``); a NULL delta gives NULL and counts as 0 for those before it.
    """
    g, gl = float(gamma), float(gamma) * float(lam)
    r, v = F.col(rewards), F.col(values)
    n = F.size(r)
    nxt_v = F.transform(v, lambda x, i: F.when(i + 1 < n, at(v, i + 2)).otherwise(F.lit(0.0)))
    delta = F.zip_with(F.zip_with(r, nxt_v, lambda a, b: a + F.lit(g) * b), v, lambda a, b: a - b).cast("array<double>")

    @F.arrow_udf("array<double>")
    def scan(deltas: pa.Array) -> pa.Array:
        flat = deltas.flatten()
        lens = np.array(pc.fill_null(pc.list_value_length(deltas), 0), np.int64)
        ends = np.cumsum(lens)
        bad = flat.is_null().to_numpy(zero_copy_only=False)
        x = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
        # nothing passes an array's end or a missing value
        starts = np.unique(np.concatenate([[0], (ends - lens)[lens > 0], np.flatnonzero(bad) + 1]))
        out = discounted_sums(x, starts[starts < len(x)], gl) if len(x) else x
        sums = pa.array(out, pa.float64(), mask=bad)
        offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
        return pa.ListArray.from_arrays(offsets, sums, mask=deltas.is_null())

    adv = scan(delta)
    return (df.withColumn(out_adv, adv)
              .withColumn(out_ret, F.zip_with(F.col(out_adv), v, lambda a, b: a + b)))


# W07 ------------------------------------------------------------------------
def segment_softmax(df: DataFrame, score: str, by: Iterable[str] | str, out: str = "prob") -> DataFrame:
    """Softmax of ``score`` within each group only (stable: minus the group max)."""
    by = [by] if isinstance(by, str) else list(by)
    w = Window.partitionBy(*by)
    e = F.exp(F.col(score) - F.max(score).over(w))
    return df.withColumn("_e", e).withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_e")


# W08 ------------------------------------------------------------------------
def first_per_key(df: DataFrame, keys: Iterable[str], order: str | list = "cmp_id") -> DataFrame:
    """First row per key by ``order`` (stable; an aggregate, so hot keys are reduced map-side)."""
    return first_by(df, list(keys), order)


# W09 ------------------------------------------------------------------------
def pack_batches(df: DataFrame, size: int, template: str, placeholders: Iterable[str],
                 order: str | list = "row_id", dummy: dict | None = None, out: str = "prompt") -> DataFrame:
    """Consecutive groups of ``size`` rows fill one template.

    Each placeholder ``{name}`` must occur ``size`` times in ``template``;
    the k-th occurrence is replaced by the k-th row's value.  The last group
    is padded with ``dummy`` rows (flagged ``n_padded``).  Output: one row per
    batch with ``batch_no``, the filled prompt, the member ids and padding.
    """
    placeholders = list(placeholders)
    for p in placeholders:
        if template.count("{" + p + "}") != size:
            raise ValueError(f"placeholder {{{p}}} must occur {size} times")
    dummy = dummy or {p: "" for p in placeholders}
    pos = dense_position(df, order, "_pos", base=0)
    pos = pos.withColumn("batch_no", F.floor(F.col("_pos") / size).cast("long"))
    ids = [order] if isinstance(order, str) else list(order)
    st = F.struct(F.col("_pos").alias("p"), F.concat_ws(":", *[F.col(c).cast("string") for c in ids]).alias("id"),
                  *[F.col(p).cast("string").alias(p) for p in placeholders])
    g = pos.groupBy("batch_no").agg(F.sort_array(F.collect_list(st)).alias("_rows"))
    pad_struct = F.struct(F.lit(None).cast("long").alias("p"), F.lit(None).cast("string").alias("id"),
                          *[F.lit(str(dummy.get(p, ""))).alias(p) for p in placeholders])
    g = g.withColumn("n_padded", F.lit(size) - F.size("_rows"))
    g = g.withColumn("_rows", F.concat("_rows", F.array_repeat(pad_struct, F.col("n_padded").cast("int"))))
    # successive first-occurrence replacement: split the template on the placeholders once,
    # then interleave literal pieces with the k-th row's values
    import re
    pieces = re.split(r"(\{(?:" + "|".join(re.escape(p) for p in placeholders) + r")\})", template)
    counters = {p: 0 for p in placeholders}
    parts = []
    for piece in pieces:
        m = re.fullmatch(r"\{(.+)\}", piece) if piece else None
        if m and m.group(1) in counters:
            k = counters[m.group(1)]
            counters[m.group(1)] += 1
            parts.append(at("_rows", k + 1).getField(m.group(1)))
        elif piece:
            parts.append(F.lit(piece))
    return g.select("batch_no", F.concat(*parts).alias(out),
                    F.filter(F.transform("_rows", lambda r: r.getField("id")), lambda x: x.isNotNull()).alias("ids"),
                    "n_padded")


def unpack_batches(batches: DataFrame, size: int, labels: str = "labels", out: str = "label", pos: str = "position") -> DataFrame:
    """Back from batches to rows (the inverse of ``pack_batches``): one row per real member with its id, its position
    in source order and its label; padding is dropped, and a batch without labels gives NULL labels."""
    d = batches.select("batch_no", F.col(labels).alias("_l"), F.posexplode("ids").alias("_i", "id"))
    return d.select("id", (F.col("batch_no") * size + F.col("_i")).alias(pos),
                    F.when(F.col("_l").isNotNull() & (F.size("_l") > F.col("_i")), at("_l", F.col("_i") + 1)).alias(out))


# W10 ------------------------------------------------------------------------
def previous_choices(turns: DataFrame, dialog: str = "conv_id", turn: str = "turn",
                     user_text: str = "user_text", chosen: str = "chosen",
                     rejected: str = "rejected", out: str = "examples") -> DataFrame:
    """For each turn, all *other* turns of its dialog as numbered examples.

    A turn without a rejected reply is written as a tie; A/B alternate by
    example number.  One aggregate per dialog, then a filter of the turn
    itself (no self-join: the dialog's turns are collected once).  The result holds each dialog's
    text once a turn, so it is for dialogs of some hundred turns: a row needs memory for its dialog's text twice.
    """
    st = F.struct(F.col(turn).alias("t"), F.col(user_text).alias("u"), F.col(chosen).alias("c"),
                  F.col(rejected).alias("r"))
    g = turns.groupBy(dialog).agg(F.sort_array(F.collect_list(st)).alias("_all"))
    j = turns.select(dialog, turn).join(g, dialog)

    def fmt(x, i):
        n = (i + 1).cast("string")
        a_first = (i % 2) == 0
        first = F.when(a_first, x.getField("c")).otherwise(x.getField("r"))
        second = F.when(a_first, x.getField("r")).otherwise(x.getField("c"))
        pick = F.when(a_first, F.lit("A")).otherwise(F.lit("B"))
        return F.when(x.getField("r").isNull(), F.concat(
            F.lit("Example "), n, F.lit(":\nQuestion: "), x.getField("u"), F.lit("\nAnswer: "), x.getField("c"),
            F.lit("\n(no preference)\n"))).otherwise(F.concat(
            F.lit("Example "), n, F.lit(":\nQuestion: "), x.getField("u"), F.lit("\nA: "), first,
            F.lit("\nB: "), second, F.lit("\nPreferred: "), pick, F.lit("\n")))
    others = F.filter("_all", lambda x: x.getField("t") != F.col(turn))
    return j.select(dialog, turn, F.array_join(F.transform(others, fmt), "\n").alias(out),
                    F.size(others).alias("n_examples"))
