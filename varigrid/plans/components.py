"""Connected components of an edge table: contraction inside tasks, then alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varigrid.plans.storage import discard, stored

#: Edges that a task contracts at once.
RUN = 1 << 20
#: A node with more children than this, and than a share of all edges, has them dealt into parts.
HUB = 1000
HUB_SHARE = 50_000


def _labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least node that each of n nodes reaches by edges (a, b): hooking onto lower labels and pointer jumping."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            return label
        label = new


def _contracted(keys: list[str]):
    """mapInArrow: each run of edges as one star for each of its components."""

    def stars(table: pa.Table) -> pa.RecordBatch:
        a, b = np.asarray(table["a"]), np.asarray(table["b"])
        group = np.zeros(len(a), np.int64)
        for k in keys:
            values, code = np.unique(np.asarray(table[k]), return_inverse=True)
            group = group * len(values) + code
        g, v = np.concatenate([group, group]), np.concatenate([a, b])
        order = np.lexsort((v, g))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(g[order]) != 0) | (np.diff(v[order]) != 0)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        nodes, row = v[order][new], order[new] % max(len(a), 1)  # nodes of a group ascend, so the least label is the least node
        label = _labels(place[: len(a)], place[len(a) :], len(nodes))
        some = np.flatnonzero(label != np.arange(len(nodes)))
        out = [table[k].take(pa.array(row[some])).combine_chunks() for k in keys]
        return pa.RecordBatch.from_arrays([*out, pa.array(nodes[some], pa.int64()), pa.array(nodes[label[some]], pa.int64())], names=[*keys, "a", "b"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= RUN:
                yield stars(pa.Table.from_batches(held))
                held, rows = [], 0
        if rows:
            yield stars(pa.Table.from_batches(held))

    return run


def _contract(edges: DataFrame, keys: list[str]) -> DataFrame:
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in edges.select(*keys, "a", "b").schema)
    return edges.select(*keys, "a", "b").mapInArrow(_contracted(keys), schema)


def _stars(edges: DataFrame, keys: list[str], n: int) -> DataFrame:
    """One large and one small star over n edges (keys..., a, b) with a > b.

    Large star: a's edge to b moves to the least neighbour of b. Roots have none, so
    only nodes in the middle have a row in ``low``. A node with a large share of
    all children, the hub that every large component ends as, has its children
    dealt into parts by a hash; there are at most n / HUB and HUB_SHARE hubs, so they
    can be broadcast. Small star: a node has few parents, one a task that had it.
    """
    low = edges.groupBy(*keys, "a").agg(F.min("b").alias("low"))
    by = [*keys, "b"]
    up = low.withColumnRenamed("a", "b")
    least = max(HUB, n // HUB_SHARE)
    if n > least:
        hubs = F.broadcast(edges.groupBy(*by).agg(F.count("*").alias("c")).filter(F.col("c") > least).select(*by, F.ceil(F.col("c") / least).cast("int").alias("parts")))
        child = edges.join(hubs, by, "left").withColumn("part", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        up = up.join(hubs, by, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        moved = child.join(up, [*by, "part"], "left")
    else:
        moved = edges.join(up, by, "left")
    large = moved.select(*keys, "a", F.coalesce("low", "b").alias("b")).distinct()
    least_of = large.groupBy(*keys, "a").agg(F.min("b").alias("low"))
    chained = large.join(least_of, [*keys, "a"]).filter("b > low").select(*keys, F.col("b").alias("a"), F.col("low").alias("b"))
    return chained.unionByName(least_of.select(*keys, "a", F.col("low").alias("b"))).distinct()


def _unsettled(edges: DataFrame, keys: list[str]) -> tuple[int, int]:
    """Number of edges, and of nodes that have two parents or a parent and children: none if all is stars."""
    child = edges.select(*keys, F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    parent = edges.select(*keys, F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    nodes = child.unionByName(parent).groupBy(*keys, "node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    open_ = F.when((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1)), 1).otherwise(0)
    r = nodes.agg(F.sum("up"), F.sum(open_)).first()
    return int(r[0] or 0), int(r[1] or 0)


def connected_components(edges: DataFrame, keys: tuple[str, ...] = (), name: str = "components") -> DataFrame:
    """(keys..., a, b) edges to (keys..., node, component): the smallest node that each node reaches.

    Nodes without an edge to another node don't occur in the result. ``keys``,
    columns of whole numbers, separate graphs that share node numbers; all of them
    converge together. Tasks first replace the edges they hold by one star for each
    component of them, at most ``RUN`` edges at a time, so that what is left grows
    with nodes. Each round is written to the shared folder, the one before is
    removed, and the driver sees two counts. Rounds grow with the logarithm of the
    longest path; ``discard`` removes the last one's table.
    """
    ks = list(keys)
    e = stored(_contract(edges.filter("a <> b"), ks).distinct(), name)
    n, open_ = _unsettled(e, ks)
    while open_:
        last = e
        e = stored(_contract(_stars(e, ks, n), ks).distinct(), name)
        discard(last)
        n, open_ = _unsettled(e, ks)
    roots = e.select(*ks, F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    out = e.select(*ks, F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
    out._stored_path = e._stored_path
    return out
