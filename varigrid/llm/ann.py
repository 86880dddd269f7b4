"""Approximate nearest neighbours by a forest of random-projection trees (operator 2).

Trees are fitted on a bounded sample of distinct vectors, those with the smallest
hashes: one in ``SAMPLE_SHARE`` of the table, from ``SAMPLE`` to ``SAMPLE_MOST``, so that
trees have more leaves where the table has more rows. Each inner node splits by the sign of a projection on the
difference of two random sample points, at the median, until ``LEAF`` points are
left. Every distinct vector of the table is then dealt to one leaf of each tree.

A query walks all trees at once through one shared priority queue: it holds the
roots first, the entry with the largest margin so far is taken, its near side is
entered and its far side is queued with the smaller of the margin so far and the
distance to the plane. Leaves are taken until, over all trees, they hold
SCALE * n ** POWER entries, n being the number of vectors; leaf sizes are counted
over the whole index. In each leaf the vectors are ranked by exact distance in
double precision, and each query keeps its ``k + 1`` nearest there; the lists of its
leaves are merged. A vector is in one leaf of each tree, so a query meets fewer
vectors than entries, and a share of the table that falls as the table grows.
``scale=math.inf`` searches every leaf and is exact.

SCALE is high because it has to be: where distances in 64 dimensions hardly
differ, as in the test tables, fewer leaves don't reach a recall of 0.9.

Equal vectors are one entry with their ``k + 1`` smallest ids, which are all that
a list of k can need, and equal queries are searched once. So no group of copies
is ever joined with itself.

The forest and its leaf counts are broadcast: planes for SAMPLE_MOST / LEAF leaves a
tree at most, whatever the table. Beyond SAMPLE_MOST * SAMPLE_SHARE rows leaves grow with the table: one with more than
``CELL`` entries, or that more than ``ASKED`` queries visit, is dealt into parts,
and each part of entries meets each part of queries in a task of its own.

Defined cases: vectors that are null, empty, all zero, or hold a null, NaN or
infinite component take no part, neither do rows without vec_id or of another
length than most (ties: the longer). Fewer candidates than k give shorter lists.
Repeated ids with the same vector count once; an id with several vectors is a
row with each of them: lists of its vectors are merged, and each vec_id has its
least distance. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varigrid.llm.blocks import bounded, first_by_hash, hash_place, stored

TREES = 8
LEAF = 64
SAMPLE = 4096
SAMPLE_MOST = 1 << 16
SAMPLE_SHARE = 8
SCALE = 3.4
POWER = 0.85
K = 10
QUERY_MOD = 100
CELL = 20_000
ASKED = 10_000
_SALTS = 64


class Tree:
    """One random-projection tree; node i splits by planes[i] at cuts[i]; children below zero are leaves."""

    def __init__(self, points: np.ndarray, rng: np.random.Generator, leaf: int):
        self.planes, self.cuts, self.children = [], [], []
        self.leaves = 0
        self.root = self._grow(points, np.arange(len(points)), rng, leaf)
        dim = points.shape[1] if len(points) else 0
        self.planes = np.array(self.planes, np.float64).reshape(len(self.cuts), dim)
        self.cuts = np.array(self.cuts)
        self.children = np.array(self.children, np.int64).reshape(-1, 2)

    def _grow(self, points, rows, rng, leaf) -> int:
        if len(rows) > leaf:
            for _ in range(4):
                a, b = points[rng.choice(rows, 2, replace=False)]
                plane = a - b
                size = np.linalg.norm(plane)
                if size == 0:
                    continue
                plane = plane / size
                at = points[rows] @ plane
                cut = float(np.median(at))
                near = at > cut
                if near.any() and not near.all():
                    i = len(self.cuts)
                    self.planes.append(plane)
                    self.cuts.append(cut)
                    self.children.append([0, 0])
                    for side, part in enumerate((rows[~near], rows[near])):
                        self.children[i][side] = self._grow(points, part, rng, leaf)
                    return i
        self.leaves += 1
        return -self.leaves

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.full(len(x), self.root)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            side = np.einsum("ij,ij->i", x[inner], self.planes[node]) > self.cuts[node]
            at[inner] = self.children[node, side.astype(np.int64)]
        return -at - 1


def search_leaves(forest: list[Tree], sizes: dict[tuple[int, int], int], x: np.ndarray, want: float) -> list[tuple[int, int]]:
    """Leaves of all trees by descending margin, until they hold ``want`` vectors."""
    queue = [(-np.inf, t, tree.root) for t, tree in enumerate(forest)]
    heapq.heapify(queue)
    out, held = [], 0
    while queue and held < want:
        margin, t, node = heapq.heappop(queue)
        tree = forest[t]
        while node >= 0:
            d = float(x @ tree.planes[node]) - tree.cuts[node]
            side = int(d > 0)
            heapq.heappush(queue, (max(margin, abs(d)), t, int(tree.children[node, 1 - side])))
            node = int(tree.children[node, side])
        out.append((t, -node - 1))
        held += sizes.get((t, -node - 1), 0)
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.filter(fine)
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.filter(F.size("v") == (length.n if length else 0))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(key, v, ids): each distinct vector with its k + 1 smallest ids, first by salted parts, then together."""
    ids = rows.select(F.transform("v", lambda x: x + F.lit(0.0)).alias("v"), "vec_id").withColumn("salt", F.pmod("vec_id", F.lit(_SALTS)))
    part = F.row_number().over(Window.partitionBy("v", "salt").orderBy("vec_id"))
    few = ids.distinct().withColumn("r", part).filter(F.col("r") <= k + 1)
    whole = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = few.withColumn("r", whole).filter(F.col("r") <= k + 1)
    got = few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return got.withColumn("key", F.element_at("ids", 1))


def plant(points: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 11) -> list[Tree]:
    rng = np.random.default_rng(seed)
    return [Tree(points, rng, leaf) for _ in range(trees)]


def _deal(shared):
    def run(batches):
        for batch in bounded(batches):
            n = batch.num_rows
            x = np.asarray(batch.column(2).flatten()).reshape(n, -1)
            for t, tree in enumerate(shared.value):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), pa.array(tree.leaf_of(x).astype(np.int32)), *batch.columns], names=["tree", "leaf", "entry", "key", "v"])

    return run


def _walk(shared, sizes, want):
    schema = pa.schema([("query", pa.int64()), ("x", pa.list_(pa.float64())), ("tree", pa.int32()), ("leaf", pa.int32())])

    def run(batches):
        for batch in bounded(batches):
            for q, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = search_leaves(shared.value, sizes.value, np.array(v), want)
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([q] * n, pa.int64()), pa.array([v] * n, pa.list_(pa.float64())), pa.array([t for t, _ in found], pa.int32()), pa.array([leaf for _, leaf in found], pa.int32())], schema=schema)

    return run


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of one vector to many, by differences."""
    d = y - x
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def _rank(k: int):
    schema = pa.schema([("query", pa.int64()), ("entry", pa.int64()), ("key", pa.int64()), ("score", pa.float64())])

    def run(entries: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(entries) or not len(asked):
            return pa.Table.from_pylist([], schema)
        flat = lambda c: np.asarray(c.combine_chunks().flatten())
        keys, number = np.asarray(entries["key"]), np.asarray(entries["entry"])
        y = flat(entries["v"]).reshape(len(keys), -1)
        queries = np.asarray(asked["query"])
        q, near, first, score = [], [], [], []
        for one, x in zip(queries, flat(asked["x"]).reshape(len(queries), -1), strict=True):
            d = distances(x, y)
            some = np.flatnonzero(d <= np.partition(d, k)[k]) if len(d) > k + 1 else np.arange(len(d))
            some = some[np.lexsort((keys[some], d[some]))][: k + 1]
            q.append(np.full(len(some), one))
            near.append(number[some])
            first.append(keys[some])
            score.append(d[some])
        return pa.table([np.concatenate(q), np.concatenate(near), np.concatenate(first), np.concatenate(score)], schema=schema)

    return run


def _counts(df: DataFrame) -> dict[tuple[int, int], int]:
    """Rows of each leaf; there are at most TREES * SAMPLE_MOST leaves."""
    return {(r.tree, r.leaf): r["count"] for r in df.groupBy("tree", "leaf").count().collect()}


def _parts(spark, sizes: dict, asked: dict) -> DataFrame:
    rows = [(t, leaf, max(1, -(-n // CELL)), max(1, -(-asked.get((t, leaf), 0) // ASKED))) for (t, leaf), n in sizes.items()]
    return F.broadcast(spark.createDataFrame(rows or [(-1, -1, 1, 1)], "tree int, leaf int, cells int, blocks int"))


def neighbours(vectors: DataFrame, queries, k: int = K, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, scale: float = SCALE, power: float = POWER) -> DataFrame:
    """(vec_id, embedding) to (query_id, rank, vec_id, score): the k nearest found of each row for which ``queries``, a column, holds."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    index = stored(distinct_vectors(rows, k).withColumn("entry", F.monotonically_increasing_id()), "vectors")  # key, the least id, orders ties
    place = hash_place(F.xxhash64("key"))
    n = index.count()
    sample = max(sample, min(SAMPLE_MOST, n // SAMPLE_SHARE))
    some = index.filter(first_by_hash(place, n, sample)).select("v", "key", place.alias("place")).collect()
    points = np.array([r.v for r in sorted(some, key=lambda r: (r.place, r.key))[:sample]])
    forest = plant(points.reshape(len(points), -1), trees, leaf) if len(points) else []
    shared = spark.sparkContext.broadcast(forest)
    dealt = stored(index.select("entry", "key", "v").mapInArrow(_deal(shared), "tree int, leaf int, entry long, key long, v array<double>"), "leaves")
    counted = _counts(dealt)
    sizes = spark.sparkContext.broadcast(counted)
    want = scale * n**power
    # A query's class is the index entry that has its vector; each class is searched once.
    asked = rows.filter(queries).select("vec_id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v")).distinct()
    asked = stored(asked.join(index.select("v", "entry"), "v").select(F.col("vec_id").alias("query_id"), F.col("entry").alias("query"), "v"), "queries")
    heads = asked.groupBy("query").agg(F.first("v").alias("x"))
    probes = stored(heads.mapInArrow(_walk(shared, sizes, want), "query long, x array<double>, tree int, leaf int"), "probes")
    parts = _parts(spark, counted, _counts(probes))
    left = dealt.join(parts, ["tree", "leaf"]).withColumn("cell", F.pmod(F.xxhash64("entry"), F.col("cells"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = probes.join(parts, ["tree", "leaf"]).withColumn("block", F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int")).withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells").cast("long") - 1)))
    by = ["tree", "leaf", "cell", "block"]
    found = left.select(*by, "entry", "key", "v").groupBy(*by).cogroup(right.select(*by, "query", "x").groupBy(*by)).applyInArrow(_rank(k), "query long, entry long, key long, score double").distinct()
    # The k + 1 nearest entries of each class of queries hold all that its lists need.
    near = found.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("score", "key", "entry"))).filter(F.col("r") <= k + 1)
    lists = near.join(index.select("entry", "ids"), "entry").select("query", "score", F.explode("ids").alias("vec_id"))
    top = lists.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))).filter(F.col("r") <= k + 1).select("query", "score", "vec_id")
    top = stored(top, "lists")  # read plainly, so that a class with most of the queries is split where they meet it
    out = asked.select("query_id", "query").join(top, "query").filter("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours(vectors, F.col("vec_id") % QUERY_MOD == 0)
