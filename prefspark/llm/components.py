"""Connected components of an edge table.

Edges run from a node to a smaller one.  First each node's edges meet by the larger end: a task joins what it has (labels over arrays)
and sends one edge a node.  Most nodes are leaves then: they have one edge and nobody points at them, so they wait.  The other
edges, few where a few parents have many children, go through rounds: every edge goes to its larger end, where a node's parents
meet, and to its smaller end, where a parent's own parents reach its children, and each task joins again.  A round is one exchange; when
no edge changes, all point at their component's smallest node, and the leaves look up what their parent has found.
The children of one node are dealt over ``SPREAD`` tasks and its parents sent to each, so a
node with a third of all edges is no hot task.  Each round is written to the shared folder.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import drop_finished, scratch_table_path
from .hot_join import lookup

SPREAD = 8


def local_roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's component, for edges between nodes 0 to n - 1."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


_SCHEMA = pa.schema([("u", pa.binary()), ("v", pa.binary()), ("moved", pa.bool_())])


def _join(batches):
    """Edges (u, v, own) of a task, u > v -> (u, root, moved).  Of the copies of an edge the one with ``own`` is always
    sent on, the others only where they have learnt something."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    ends = pa.concat_arrays([b.column(i) for i in (0, 1) for b in held]).dictionary_encode()
    # numbered in order, so that the smallest number is the smallest node
    order = pc.sort_indices(ends.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    names = ends.dictionary.take(order)
    u, v = np.split(rank[ends.indices.to_numpy()], 2)
    own = np.concatenate([b.column(2).to_numpy(zero_copy_only=False) for b in held])
    root = local_roots(u, v, len(names))
    moved = root[u] != v
    # smaller ends that have found a smaller node are nodes of their own
    low = v[root[v] != v]
    send = np.concatenate([u[own | moved], low])
    fresh = np.concatenate([moved[own | moved], np.ones(len(low), bool)])
    node, at = np.unique(send, return_inverse=True)
    changed = np.zeros(len(node), bool)
    np.logical_or.at(changed, at, fresh)
    for i in range(0, len(node), 100_000):
        j = slice(i, i + 100_000)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(node[j])), names.take(pa.array(root[node[j]])), pa.array(changed[j])], schema=_SCHEMA)


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 200) -> DataFrame:
    """(node, root): root is the smallest node of the component.  Nodes that are their own root are absent.

    ``a`` and ``b`` are binary columns; an edge of a node with itself says nothing."""
    spark, tag = edges.sparkSession, uuid.uuid4().hex
    cur = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v")

    def joined(sent, step, seen):
        path = scratch_table_path(spark, f"components-{tag}-{step}")
        (sent.mapInArrow(_join, "u binary, v binary, moved boolean").observe(seen, F.max("moved").alias("moved"))
         .write.mode("overwrite").parquet(path))
        return spark.read.parquet(path).select("u", "v")

    # a node's parents first: what many edges say of a few parents becomes an edge a node
    cur = joined(cur.select("u", "v", F.lit(True).alias("own")).repartition("u"), "first", Observation())
    ends = cur.select(F.col("u").alias("node"), F.col("v").alias("up"), F.lit(0).alias("parent")).union(
        cur.select(F.col("v").alias("node"), F.lit(None).cast("binary").alias("up"), F.lit(1).alias("parent")))
    path = scratch_table_path(spark, f"components-{tag}-nodes")
    (ends.groupBy("node").agg(F.collect_set("up").alias("ups"), F.max("parent").alias("parent")).where(F.size("ups") > 0)
     .write.mode("overwrite").parquet(path))
    nodes = spark.read.parquet(path)
    leaf = (F.size("ups") == 1) & (F.col("parent") == 0)
    leaves = nodes.where(leaf).select("node", F.get("ups", F.lit(0)).alias("up"))
    inner = _rounds(nodes.where(~leaf).select(F.col("node").alias("u"), F.explode("ups").alias("v")), joined, max_rounds)
    load = leaves.groupBy("up").agg(F.count(F.lit(1)).alias("rows"))
    found = inner.join(load, inner["node"] == load["up"]).select("up", "root", "rows")
    out = lookup(leaves, found, ["up"], "rows", F.col("node"))
    drop_finished(spark)
    return out.select("node", F.coalesce("root", "up").alias("root")).union(inner)


def _rounds(cur: DataFrame, joined, max_rounds: int) -> DataFrame:
    """(node, root) of edges (u, v), by rounds."""
    every = F.array(*[F.lit(i) for i in range(SPREAD)])
    for step in range(max_rounds):
        ends = F.concat(
            F.transform(every, lambda s: F.struct(F.col("u").alias("at"), s.alias("salt"), (s == 0).alias("own"))),
            F.array(F.struct(F.col("v").alias("at"), F.pmod(F.xxhash64("u"), F.lit(SPREAD)).cast("int").alias("salt"), F.lit(False).alias("own"))))
        sent = cur.select("u", "v", F.inline(ends)).repartition("at", "salt").select("u", "v", "own")
        seen = Observation()
        cur = joined(sent, step, seen)
        if not seen.get["moved"]:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError("components did not settle")
