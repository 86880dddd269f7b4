"""Density clustering by cells: labels of many settings without a table of pairs.

Each setting has a grid whose cells are a little narrower than epsilon / sqrt(2), so
that all points of a cell are neighbours. Three things follow:

* a cell of minpts or more points has core points only; neighbours are counted only
  for points of other cells, which hold fewer than minpts points each, so a point
  meets at most 25 * (minpts - 1) of those that are counted for;
* the core points of a cell are in one cluster, so components are those of cells;
* two cells are linked if any two of their core points are neighbours. Most pairs of
  cells are settled by the boxes around their core points: by the boxes' least and
  greatest distance. What is left is settled by boxes of halves, quarters and so on,
  only where the cells are not joined by other links, and by the points
  themselves as soon as these are few.

Bounds and distances are made by the same expression, whose rounding is monotone, so
a box settles nothing that its points would not. All work grows with points and not
with pairs, but for points of the third kind, up to ``DIRECT`` comparisons a level.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varigrid.functions.geometry import distance
from varigrid.plans import variants as V
from varigrid.plans.components import connected_components
from varigrid.plans.scan import extent, ranked
from varigrid.plans.storage import discard, stored

#: A cell's side is less than epsilon / sqrt(2) by this share: rounding of coordinates up to ``MOST_CELLS`` cells is less.
SLACK = 1e-6
MOST_CELLS = 1e9
#: Comparisons of points that are made without looking at smaller boxes first.
DIRECT = 20_000_000

Low = tuple[float, float]


def fits(points: DataFrame, rows: Sequence[tuple[int, float, int]]) -> Low | None:
    """The least x and y, if each setting's cells can be told apart in double precision; else None."""
    e = extent(points).first()
    if e.xmin is None:
        return 0.0, 0.0
    side = max(e.xmax - e.xmin, e.ymax - e.ymin)
    fine = all(eps == 0 or (1e-140 < eps < 1e140 and side / eps < MOST_CELLS) for _, eps, _ in rows)
    return (e.xmin, e.ymin) if fine else None


def cell_width(eps: float) -> float:
    return eps / math.sqrt(2) * (1 - SLACK)


def _q(v: str, low: float, width: Column | float) -> Column:
    """Position in cells. Times a power of two it is exact, so cells nest."""
    return (F.col(v) - F.lit(float(low))) / (F.lit(width) if isinstance(width, float) else width)


def _sub(v: str, low: float, level: int, width: Column | float | None = None) -> Column:
    """Number of the part that a coordinate lies in, a cell's side halved ``level`` times."""
    return F.floor(_q(v, low, F.col("width") if width is None else width) * F.lit(float(2**level))).cast("long")


def _offsets(steps: list[tuple[int, int]]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in steps]))


_AROUND = [(a, b) for a in range(-2, 3) for b in range(-2, 3)]
_FORWARD = [s for s in _AROUND if s > (0, 0)]


def box() -> list[Column]:
    """Aggregates: the box around points and their number."""
    return [F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").alias("n")]


def least_distance(a: str, b: str) -> Column:
    """Of points in two boxes, column prefixes a and b."""
    gap = lambda v: F.greatest(F.lit(0.0), F.col(f"{b}{v}0") - F.col(f"{a}{v}1"), F.col(f"{a}{v}0") - F.col(f"{b}{v}1"))
    return F.sqrt(gap("x") * gap("x") + gap("y") * gap("y"))


def greatest_distance(a: str, b: str) -> Column:
    far = lambda v: F.greatest(F.col(f"{b}{v}1") - F.col(f"{a}{v}0"), F.col(f"{a}{v}1") - F.col(f"{b}{v}0"))
    return F.sqrt(far("x") * far("x") + far("y") * far("y"))


def named(df: DataFrame, prefix: str, keep: Sequence[str] = ("variant_id",)) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns if c not in keep})


def _near_cells(df: DataFrame, low: Low) -> DataFrame:
    """Rows for each cell (kx, ky) that a point's circle may reach."""
    q = df.withColumn("o", _offsets(_AROUND)).withColumn("kx", F.col("cx") + F.col("o.dx")).withColumn("ky", F.col("cy") + F.col("o.dy")).drop("o")
    gap = lambda k, v, o: F.greatest(F.lit(0.0), F.col(k) - _q(v, o, F.col("width")), _q(v, o, F.col("width")) - F.col(k) - 1)
    gx, gy = gap("kx", "x", low[0]), gap("ky", "y", low[1])
    return q.filter(gx * gx + gy * gy <= 2.0001)


def by_cell(place: DataFrame, rows: Sequence[tuple[int, float, int]], low: Low) -> DataFrame:
    """Places (id, x, y, xbin, ybin, w) times settings: with variant_id, eps, minpts, width, cx and cy. With epsilon 0 a place is a cell."""
    v = [F.struct(F.lit(i).alias("variant_id"), F.lit(e).alias("eps"), F.lit(m).alias("minpts"), F.lit(cell_width(e) if e else 1.0).alias("width")) for i, e, m in rows]
    p = place.select("id", "x", "y", "xbin", "ybin", "w", F.explode(F.array(*v)).alias("v")).select("v.*", "id", "x", "y", "xbin", "ybin", "w")
    own = F.col("eps") == 0
    return p.withColumn("cx", F.when(own, F.col("id")).otherwise(_sub("x", low[0], 0))).withColumn("cy", F.when(own, F.lit(0)).otherwise(_sub("y", low[1], 0)))


_CELL = ["variant_id", "cx", "cy"]


def _met(loose: DataFrame, others: DataFrame, low: Low) -> DataFrame:
    """(variant_id, i, kx, ky, w): neighbours among ``others`` of points in cells that aren't full, with the neighbour's cell."""
    a = _near_cells(loose.filter("eps > 0").select("variant_id", "eps", "width", F.col("id").alias("i"), "x", "y", "cx", "cy"), low)
    a = a.select("variant_id", "eps", "i", F.col("x").alias("ax"), F.col("y").alias("ay"), "kx", "ky")
    b = others.select("variant_id", F.col("cx").alias("kx"), F.col("cy").alias("ky"), "x", "y", "w")
    # the side that has few rows for a cell comes second, as a merge join holds those
    return b.join(a, ["variant_id", "kx", "ky"]).filter(distance("ax", "ay", "x", "y") <= F.col("eps")).select("variant_id", "i", "kx", "ky", "w")


def classified(place: DataFrame, rows: Sequence[tuple[int, float, int]], low: Low) -> DataFrame:
    """by_cell, stored, with ``core``."""
    p = by_cell(place, rows, low)
    full = p.groupBy(*_CELL).agg(F.sum("w").alias("cell_w"))
    held = stored(p.join(full, _CELL).withColumn("full", F.col("cell_w") >= F.col("minpts")).drop("cell_w"), "cells")
    n = _met(held.filter("NOT full"), held, low).groupBy("variant_id", F.col("i").alias("id")).agg(F.sum("w").alias("met"))
    # a join by hash of all points: what is read back is far smaller on disk than in memory
    core = F.col("full") | F.coalesce(F.col("met") >= F.col("minpts"), F.lit(False))
    loose = held.filter("NOT full").join(n, ["variant_id", "id"], "left").withColumn("core", core).drop("met", "full")
    out = stored(held.filter("full").drop("full").withColumn("core", F.lit(True)).unionByName(loose), "kinds")
    discard(held)
    return out


def _parts(core: DataFrame, level: int, low: Low) -> DataFrame:
    """Boxes of core points by parts of cells."""
    p = core.withColumn("sx", _sub("x", low[0], level)).withColumn("sy", _sub("y", low[1], level))
    return p.groupBy("variant_id", "sx", "sy").agg(*box())


def _settled(pairs: DataFrame) -> DataFrame:
    """Pairs of boxes a_ and b_ that may hold neighbours: ``hit`` if all of their points are, else the comparisons to make."""
    hit = greatest_distance("a_", "b_") <= F.col("eps")
    return pairs.filter(least_distance("a_", "b_") <= F.col("eps")).withColumn("hit", hit).withColumn("work", (F.col("a_n") * F.col("b_n")).cast("double"))


_PAIR = ["variant_id", "eps", "a", "b", "ax", "ay", "bx", "by"]


def _halved(pairs: DataFrame, core: DataFrame, level: int, low: Low) -> DataFrame:
    """Open pairs of parts, one level up, as pairs of their halves."""
    s = _parts(core, level, low)
    side = lambda p: named(s.withColumn(f"{p}x", F.shiftright("sx", 1)).withColumn(f"{p}y", F.shiftright("sy", 1)), f"{p}_", ("variant_id", f"{p}x", f"{p}y"))
    both = pairs.select(*_PAIR).join(side("a"), ["variant_id", "ax", "ay"]).join(side("b"), ["variant_id", "bx", "by"]).drop("ax", "ay", "bx", "by")
    return _settled(both).withColumnsRenamed({"a_sx": "ax", "a_sy": "ay", "b_sx": "bx", "b_sy": "by"}).select(*_PAIR, "hit", "work")


def _compared(pairs: DataFrame, core: DataFrame, level: int, low: Low) -> DataFrame:
    """(variant_id, a, b) of the open pairs that hold two neighbours, by comparing their points."""
    p = core.select("variant_id", "x", "y", _sub("x", low[0], level).alias("sx"), _sub("y", low[1], level).alias("sy"))
    side = lambda k: p.withColumnsRenamed({"sx": f"{k}x", "sy": f"{k}y", "x": f"{k}_x", "y": f"{k}_y"})
    both = pairs.select(*_PAIR).join(side("a"), ["variant_id", "ax", "ay"]).join(side("b"), ["variant_id", "bx", "by"])
    return both.filter(distance("a_x", "a_y", "b_x", "b_y") <= F.col("eps")).select("variant_id", "a", "b").distinct()


def _open(pairs: DataFrame) -> tuple[int, float]:
    r = pairs.filter("NOT hit").agg(F.count("*"), F.sum("work")).first()
    return r[0], r[1] or 0.0


def _renumbered(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """Pairs (a, b) as pairs of what ``of`` (variant_id, node, to) gives for them, the smaller first; a node that it doesn't have stays."""
    for side in ("a", "b"):
        pairs = pairs.join(of.select("variant_id", F.col("node").alias(side), F.col("to").alias(f"to_{side}")), ["variant_id", side], "left").withColumn(side, F.coalesce(f"to_{side}", side)).drop(f"to_{side}")
    return pairs.filter("a <> b")


def cell_components(core: DataFrame, cells: DataFrame, low: Low, start: DataFrame | None = None) -> DataFrame:
    """(variant_id, node, component), stored, of cells (variant_id, eps, width, cx, cy, node and their box).

    ``start`` (variant_id, node, to) has what is known to be joined.
    """
    core = core.filter("eps > 0")
    a = named(cells.filter("eps > 0").select("variant_id", "eps", "cx", "cy", "node", "x0", "x1", "y0", "y1", "n"), "a_", ("variant_id", "eps"))
    b = named(cells.filter("eps > 0").select("variant_id", "cx", "cy", "node", "x0", "x1", "y0", "y1", "n"), "b_")
    a = a.withColumn("o", _offsets(_FORWARD)).withColumn("b_cx", F.col("a_cx") + F.col("o.dx")).withColumn("b_cy", F.col("a_cy") + F.col("o.dy")).drop("o")
    pairs = _settled(a.join(b, ["variant_id", "b_cx", "b_cy"]))
    pairs = pairs.withColumnsRenamed({"a_node": "a", "b_node": "b", "a_cx": "ax", "a_cy": "ay", "b_cx": "bx", "b_cy": "by"}).select(*_PAIR, "hit", "work")
    pairs = stored(pairs if start is None else _renumbered(pairs, start), "links")
    edge = lambda df: df.select("variant_id", "a", "b")
    tables, level, maps = [pairs], 0, [] if start is None else [start]
    links = edge(pairs.filter("hit"))
    n, work = _open(pairs)
    if n and work > DIRECT:
        level = 1
        halves = stored(_halved(pairs.filter("NOT hit"), core, level, low), "halves")
        links = links.unionByName(edge(halves.filter("hit")))
        pairs = halves
        tables.append(halves)
    while True:
        if n and work <= DIRECT:
            links, n = links.unionByName(_compared(pairs.filter("NOT hit"), core, level, low)), 0
        joined = connected_components(links, ("variant_id",))
        maps.append(stored(joined.select("variant_id", "node", F.col("component").alias("to")), "joined"))
        discard(joined)
        if n:  # what other links have joined needs no further look
            pairs = stored(_renumbered(pairs.filter("NOT hit"), maps[-1]), "open")
            tables.append(pairs)
            n, work = _open(pairs)
        if not n:
            break
        if work > DIRECT:
            level += 1
            pairs = stored(_halved(pairs, core, level, low), "halves")
            tables.append(pairs)
            links = edge(pairs.filter("hit"))
            n, work = _open(pairs)
        else:
            links = edge(pairs).limit(0)
    out = cells.select("variant_id", "node", F.col("node").alias("component"))
    for m in maps:
        out = out.join(m.select("variant_id", F.col("node").alias("component"), "to"), ["variant_id", "component"], "left").withColumn("component", F.coalesce("to", "component")).drop("to")
    out = stored(out.select("variant_id", "node", "component"), "components")
    discard(*tables, *(maps if start is None else maps[1:]))
    return out


def _reusing(core: DataFrame, cells: DataFrame, rows, low: Low) -> DataFrame:
    """As cell_components, but each variant starts from its parent's components.

    A parent has no larger epsilon and no smaller minpts, so its core places are core
    here and what it joined stays joined: cells that hold places of one of its
    components start as one, and no distance between them is looked at. All variants
    with as many ancestors run together.
    """
    parent, left, done, spark = V.parents_of(rows), [v[0] for v in rows], None, core.sparkSession
    at = cells.select(*_CELL, "node")
    while left:
        ready = [v for v in left if parent[v] not in left]
        left = [v for v in left if v not in ready]
        own, some, start = core.filter(F.col("variant_id").isin(ready)), cells.filter(F.col("variant_id").isin(ready)), None
        if done is not None:
            of = F.broadcast(spark.createDataFrame([(v, parent[v]) for v in ready if parent[v] is not None] or [(-1, -1)], "variant_id int, parent int"))  # the caller's list
            before = core.join(at, _CELL).join(done, ["variant_id", "node"]).select(F.col("variant_id").alias("parent"), "id", F.col("component").alias("known"))
            known = own.join(before.join(of, "parent").drop("parent"), ["variant_id", "id"]).groupBy(*_CELL).agg(F.min("known").alias("known"))
            held = stored(known.join(at, _CELL).select("variant_id", "node", "known"), "known")
            least = held.groupBy("variant_id", "known").agg(F.min("node").alias("to"))
            start = stored(held.join(least, ["variant_id", "known"]).select("variant_id", "node", "to"), "start")
            discard(held)
        new = cell_components(own, some, low, start)
        last, done = done, new if done is None else stored(done.unionByName(new), "components")
        discard(*([] if last is None else [last, new, start]))
    return done


def variant_labels(points: DataFrame, place: DataFrame, rows: Sequence[tuple[int, float, int]], low: Low, border: str = "scan", reuse: bool = False) -> DataFrame:
    """(variant_id, id, cluster) of every point, as a stored table; ``place`` as made by ``cluster.places``, ``low`` by ``fits``."""
    kind = classified(place, rows, low)
    core = kind.filter("core")
    cells = stored(core.groupBy("variant_id", "eps", "cx", "cy").agg(F.min("id").alias("node"), F.min(F.struct("xbin", "ybin", "id")).alias("seed"), *box()), "core-cells")
    comp = _reusing(core, cells, rows, low) if reuse else cell_components(core, cells, low)
    of_cell = cells.join(comp, ["variant_id", "node"])
    ranks = ranked(of_cell.groupBy("variant_id", "component").agg(F.min("seed").alias("seed")), [F.col("seed")], ("variant_id",), "cluster")
    numbers = ranks.select("variant_id", "component", "seed", F.col("cluster").cast("int").alias("cluster"))
    number = stored(of_cell.select(*_CELL, "component").join(numbers, ["variant_id", "component"]).select(*_CELL, "cluster", "seed"), "numbers")
    of_core = core.select(*_CELL, "x", "y", "xbin", "ybin").join(number, _CELL).drop("cx", "cy").withColumn("core", F.lit(True))
    # a place that isn't core takes the first cluster among its core neighbours'
    rest = kind.filter("NOT core")
    near = _met(rest, core, low).select("variant_id", "i", "kx", "ky").distinct().join(number.withColumnsRenamed({"cx": "kx", "cy": "ky"}), ["variant_id", "kx", "ky"])
    first = near.groupBy("variant_id", F.col("i").alias("id")).agg(F.min(F.struct("seed", "cluster")).alias("m"))
    edge = rest.select("variant_id", "id", "x", "y", "xbin", "ybin").join(first, ["variant_id", "id"]).select("variant_id", "x", "y", "xbin", "ybin", F.col("m.cluster").alias("cluster"), F.col("m.seed").alias("seed"), F.lit(False).alias("core"))
    known = of_core.select(*edge.columns).unionByName(edge)
    p = points.select("id", (F.col("x") + F.lit(0.0)).alias("x"), (F.col("y") + F.lit(0.0)).alias("y"), F.explode(F.array(*[F.lit(i) for i, _, _ in rows])).alias("variant_id"))
    late = F.struct("xbin", "ybin", "id") > F.col("seed")
    joins = F.col("core") | (late if border == "scan" else F.lit(True))
    all_ = p.join(known, ["variant_id", "x", "y"], "left")
    out = stored(all_.select("variant_id", "id", F.when(F.col("cluster").isNotNull() & joins, F.col("cluster")).otherwise(0).cast("int").alias("cluster")), "labels")
    discard(kind, cells, comp, ranks, number)
    return out
