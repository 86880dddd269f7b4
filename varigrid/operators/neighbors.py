"""Neighbourhoods: epsilon self-joins, range queries and what is counted over them.

A neighbour of a point is every point, itself included, at a distance of at most
epsilon. Directed pairs: (i, j) and (j, i) are two rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varigrid.functions.geometry import cell, distance, overlap
from varigrid.plans.scan import extent, ranked

#: A little wider than epsilon, so that rounding can't put points at that distance two cells apart while |x| / epsilon is below 4e9.
SLACK = 1 + 1e-6


def with_cells(points: DataFrame, width: float) -> DataFrame:
    return points.withColumn("cx", cell("x", width)).withColumn("cy", cell("y", width))


def _around(n: int = 1):
    steps = [(a, b) for a in range(-n, n + 1) for b in range(-n, n + 1)]
    return F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in steps]))


def eps_join(points: DataFrame, eps: float, others: DataFrame | None = None) -> DataFrame:
    """(i, j, dist) of all pairs within eps: an equi-join on grid cells and their eight neighbours, then the exact distance.

    Columns of ``points`` besides id, x, y come with the prefix ``i_``, those of
    ``others`` with ``j_``. Empty cells meet nothing, so no grid is stored.
    """
    others = points if others is None else others
    more = lambda df, p: [F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in ("id", "x", "y")]
    if eps == 0:
        a = points.select(F.col("id").alias("i"), "x", "y", *more(points, "i"))
        b = others.select(F.col("id").alias("j"), "x", "y", *more(others, "j"))
        return a.join(b, ["x", "y"]).drop("x", "y").withColumn("dist", F.lit(0.0))
    width = eps * SLACK
    a = with_cells(points.select(F.col("id").alias("i"), "x", "y", *more(points, "i")), width).withColumn("o", _around())
    a = a.select("*", (F.col("cx") + F.col("o.dx")).alias("kx"), (F.col("cy") + F.col("o.dy")).alias("ky")).drop("cx", "cy", "o").withColumnsRenamed({"x": "x1", "y": "y1"})
    b = with_cells(others.select(F.col("id").alias("j"), "x", "y", *more(others, "j")), width).withColumnsRenamed({"cx": "kx", "cy": "ky", "x": "x2", "y": "y2"})
    near = a.join(b, ["kx", "ky"]).withColumn("dist", distance("x1", "y1", "x2", "y2")).filter(F.col("dist") <= F.lit(float(eps)))
    return near.drop("kx", "ky", "x1", "y1", "x2", "y2")


def eps_join_brute(points: DataFrame, eps: float, blocks: int = 8) -> DataFrame:
    """The same pairs by comparing all with all, block by block; only to check the grid on small tables."""
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    a = points.select(F.col("id").alias("i"), F.col("x").alias("x1"), F.col("y").alias("y1"), block.alias("p"), every.alias("q"))
    b = points.select(F.col("id").alias("j"), F.col("x").alias("x2"), F.col("y").alias("y2"), block.alias("q"), every.alias("p"))
    return a.join(b, ["p", "q"]).select("i", "j", distance("x1", "y1", "x2", "y2").alias("dist")).filter(F.col("dist") <= F.lit(float(eps)))


def narrowed(edges: DataFrame, eps: float) -> DataFrame:
    """The pairs of a smaller epsilon from those of a larger one."""
    return edges.filter(F.col("dist") <= F.lit(float(eps)))


def neighbor_counts(edges: DataFrame) -> DataFrame:
    """(id, neighbors): points within epsilon, itself counted."""
    return edges.groupBy(F.col("i").alias("id")).agg(F.count("*").alias("neighbors"))


def neighbor_table(edges: DataFrame) -> DataFrame:
    """(id, neighbors array<bigint> ascending)."""
    return edges.groupBy(F.col("i").alias("id")).agg(F.array_sort(F.collect_list("j")).alias("neighbors"))


def neighbor_offsets(table: DataFrame) -> DataFrame:
    """(id, first, last, neighbors): where each list lies in all lists laid end to end in id order, both ends inclusive."""
    sized = ranked(table.withColumn("n", F.size("neighbors").cast("long")), [F.col("id")], name="row")
    # Running sums by blocks of rows: a sum of each block, then inside blocks.
    blocks = sized.withColumn("block", F.floor((F.col("row") - 1) / 10_000))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.groupBy("block").agg(F.sum("n").alias("s")).withColumn("before", F.coalesce(F.sum("s").over(before), F.lit(0))).drop("s")
    inside = F.sum("n").over(Window.partitionBy("block").orderBy("row"))
    out = blocks.withColumn("inside", inside).join(sums, "block")
    return out.select("id", (F.col("before") + F.col("inside") - F.col("n")).alias("first"), (F.col("before") + F.col("inside") - 1).alias("last"), "neighbors")


def total_neighbors(edges: DataFrame, epsilons: list[float]) -> DataFrame:
    """(epsilon, pairs) for several epsilons up to that of the edges, in one pass."""
    steps = F.explode(F.array(*[F.lit(float(e)) for e in epsilons])).alias("epsilon")
    return edges.select("dist", steps).filter("dist <= epsilon").groupBy("epsilon").agg(F.count("*").alias("pairs"))


def estimated_pairs(points: DataFrame, eps: float, every: int = 100) -> DataFrame:
    """One row: pairs of every ``every``-th point in id order, times ``every``, and that plus 5 %."""
    sample = ranked(points, [F.col("id")], name="row").filter(F.col("row") % every == 1 % every).drop("row")
    found = eps_join(sample, eps, points)
    return found.agg((F.count("*") * every).alias("estimate")).withColumn("bound", F.col("estimate") * 1.05)


def estimated_from_larger(pairs, eps: float, larger: float, alpha: float = 1.0):
    """Pairs expected at eps if there are ``pairs``, a number or column, at a larger epsilon: by the ratio of areas."""
    return alpha * pairs * (eps / larger) ** 2


def range_query(points: DataFrame, boxes: DataFrame, width: float, where: Column | None = None) -> DataFrame:
    """(box_id, id) of the points in closed boxes (box_id, xmin, ymin, xmax, ymax), and for which ``where`` holds.

    A box is looked up in a grid of its own size, ``width`` doubled until the box
    meets three cells at most on each side; points are dealt to the grids that
    occur, of which there are as many as the boxes' sizes have powers of two.
    """
    side = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(side, F.lit(0.0)) / F.lit(float(width)))).cast("int"))
    asked = boxes.withColumn("level", F.coalesce(level, F.lit(0)))
    levels = [r.level for r in asked.select("level").distinct().collect()]
    at = lambda c: F.floor(F.col(c) / (F.lit(float(width)) * F.pow(F.lit(2.0), F.col("level")))).cast("long")
    span = lambda a, b: F.explode(F.sequence(at(a), at(b)))
    cells = asked.filter("xmin <= xmax AND ymin <= ymax").withColumn("cx", span("xmin", "xmax")).withColumn("cy", span("ymin", "ymax"))
    some = points if where is None else points.filter(where)
    dealt = some.select("id", "x", "y").withColumn("level", F.explode(F.array(*[F.lit(k) for k in levels or [0]]))).withColumn("cx", at("x")).withColumn("cy", at("y"))
    inside = F.col("x").between(F.col("xmin"), F.col("xmax")) & F.col("y").between(F.col("ymin"), F.col("ymax"))
    return dealt.join(cells, ["level", "cx", "cy"]).filter(inside).select("box_id", "id")


def box_overlaps(a: DataFrame, b: DataFrame, width: float) -> DataFrame:
    """(a_id, b_id) of boxes that meet, each pair once: boxes share a cell, and the pair counts in the first that they share."""
    span = lambda p, q: F.explode(F.sequence(cell(p, width), cell(q, width)))
    side = lambda df, p: df.select(*[F.col(c).alias(f"{p}{c}") for c in ("box_id", "xmin", "ymin", "xmax", "ymax")]).withColumn("cx", span(f"{p}xmin", f"{p}xmax")).withColumn("cy", span(f"{p}ymin", f"{p}ymax"))
    both = side(a, "a_").join(side(b, "b_"), ["cx", "cy"]).filter(overlap("a_", "b_"))
    first = (F.col("cx") == cell(F.greatest("a_xmin", "b_xmin"), width)) & (F.col("cy") == cell(F.greatest("a_ymin", "b_ymin"), width))
    return both.filter(first).select(F.col("a_box_id").alias("a_id"), F.col("b_box_id").alias("b_id"))


def point_neighborhood(points: DataFrame, x: float, y: float, eps: float) -> DataFrame:
    """(id, dist) of the points within eps of a place: the box prunes files, the distance decides."""
    box = F.col("x").between(x - eps, x + eps) & F.col("y").between(y - eps, y + eps)
    near = points.filter(box).withColumn("dist", distance("x", "y", F.lit(float(x)), F.lit(float(y))))
    return near.filter(F.col("dist") <= F.lit(float(eps))).select("id", "dist")


def grid_cells(points: DataFrame, eps: float) -> DataFrame:
    """(cx, cy, n): points of each non-empty cell of side eps, from half a cell below the least coordinates."""
    e = extent(points).first()
    low = lambda v: 0.0 if v is None else v - 0.5 * eps
    p = points.withColumn("cx", cell("x", eps, low(e.xmin))).withColumn("cy", cell("y", eps, low(e.ymin)))
    return p.groupBy("cx", "cy").agg(F.count("*").alias("n"))


def grid_summary(points: DataFrame, eps: float) -> DataFrame:
    """One row: cells in the grid, full and empty ones, and the most points of a cell."""
    e = extent(points).first()
    side = lambda a, b: 0 if a is None else int(-(-(b - (a - 0.5 * eps)) // eps)) + 1
    total = side(e.xmin, e.xmax) * side(e.ymin, e.ymax)
    c = grid_cells(points, eps).agg(F.count("*").alias("full_cells"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))
    return c.select(F.lit(total).cast("long").alias("cells"), "full_cells", (F.lit(total) - F.col("full_cells")).cast("long").alias("empty_cells"), "most")


def fullest_neighborhood(cells: DataFrame) -> DataFrame:
    """One row: the most points in any 3 x 3 cells around a non-empty cell."""
    moved = cells.withColumn("o", _around()).select((F.col("cx") + F.col("o.dx")).alias("cx"), (F.col("cy") + F.col("o.dy")).alias("cy"), "n")
    around = moved.groupBy("cx", "cy").agg(F.sum("n").alias("around"))
    return around.join(cells.select("cx", "cy"), ["cx", "cy"], "left_semi").agg(F.max("around").alias("most_points"))


def batches(points: DataFrame, n: int) -> DataFrame:
    """Points with ``batch``: position in id order modulo n, so that batches are alike."""
    return ranked(points, [F.col("id")], name="row").withColumn("batch", F.pmod(F.col("row") - 1, F.lit(n)).cast("int")).drop("row")
