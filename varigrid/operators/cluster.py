"""Density clustering of points for many (epsilon, minpts) settings at once.

A point is core if at least minpts points, itself counted, lie within epsilon.
Clusters are connected components of core points. They are numbered from 1 by
their first core point in scan order; 0 is noise. A point that is not core gets
the first-started cluster among its core neighbours', unless it comes before that
cluster's first core point in scan order: then the scan has already passed it, and
with ``border="scan"`` it stays 0. With ``border="textbook"`` it joins anyway.

All labels follow from minima and comparisons over a total order, so they don't
depend on partitions. Points with equal coordinates are joined as one point with a
weight, so a heap of copies costs one row in every join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varigrid.operators import cells
from varigrid.operators.neighbors import eps_join
from varigrid.plans import variants as V
from varigrid.plans.components import connected_components
from varigrid.plans.scan import ranked, scan_bins
from varigrid.plans.storage import discard, stored


def places(points: DataFrame) -> DataFrame:
    """(id, x, y, xbin, ybin, w): one row for each pair of coordinates, with its least id and its number of points."""
    # -0.0 and 0.0 are one place
    p = points.withColumn("x", F.col("x") + F.lit(0.0)).withColumn("y", F.col("y") + F.lit(0.0))
    return scan_bins(p.groupBy("x", "y").agg(F.min("id").alias("id"), F.count("*").alias("w")))


def variant_edges(place: DataFrame, rows: Sequence[tuple[int, float, int]]) -> DataFrame:
    """(variant_id, minpts, i, j, j_w) from one join at the largest epsilon, narrowed for each variant."""
    spark = place.sparkSession
    edges = eps_join(place.select("id", "x", "y", "w"), max(e for _, e, _ in rows)).select("i", "j", "dist", "j_w")
    v = F.broadcast(V.variants_frame(spark, rows))  # the caller's list
    return edges.join(v, F.col("dist") <= F.col("epsilon")).select("variant_id", "minpts", "i", "j", "j_w")


def core_places(edges: DataFrame) -> DataFrame:
    """(variant_id, id) of core places."""
    n = edges.groupBy("variant_id", "minpts", "i").agg(F.sum("j_w").alias("n"))
    return n.filter("n >= minpts").select("variant_id", F.col("i").alias("id"))


def _components(core: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(variant_id, id, component) of all core places, one without a core neighbour is its own; and the table that it reads."""
    c = connected_components(links.select("variant_id", F.col("i").alias("a"), F.col("j").alias("b")), ("variant_id",))
    return core.join(c.withColumnRenamed("node", "id"), ["variant_id", "id"], "left").withColumn("component", F.coalesce("component", "id")), c


def _components_reusing(core: DataFrame, links: DataFrame, rows) -> tuple[DataFrame, DataFrame]:
    """As _components, but each variant starts from its parent's components.

    A parent has no larger epsilon and no smaller minpts, so its core places are
    core here and what it joined stays joined: its components become single nodes.
    All variants with as many ancestors run together; ``links`` is narrowed to what
    still joins two components before the stars.
    """
    parent, left, done = V.parents_of(rows), [v[0] for v in rows], None
    spark = core.sparkSession
    while left:
        ready = [v for v in left if parent[v] not in left]
        left = [v for v in left if v not in ready]
        own = core.filter(F.col("variant_id").isin(ready))
        if done is None:
            start, met = own.withColumn("start", F.col("id")), links.filter(F.col("variant_id").isin(ready)).select("variant_id", F.col("i").alias("a"), F.col("j").alias("b"))
        else:
            of = F.broadcast(spark.createDataFrame([(v, parent[v]) for v in ready if parent[v] is not None] or [(-1, -1)], "variant_id int, parent int"))  # the caller's list
            known = done.select(F.col("variant_id").alias("parent"), "id", F.col("component").alias("known")).join(of, "parent").select("variant_id", "id", "known")
            start = stored(own.join(known, ["variant_id", "id"], "left").select("variant_id", "id", F.coalesce("known", "id").alias("start")), "start")
            s = lambda side: start.select("variant_id", F.col("id").alias(side), F.col("start").alias(f"s{side}"))
            met = links.filter(F.col("variant_id").isin(ready)).join(s("i"), ["variant_id", "i"]).join(s("j"), ["variant_id", "j"]).filter("si <> sj").select("variant_id", F.col("si").alias("a"), F.col("sj").alias("b"))
        stars = connected_components(met, ("variant_id",))
        joined = stars.select("variant_id", F.col("node").alias("start"), F.col("component").alias("root"))
        new = start.join(joined, ["variant_id", "start"], "left").select("variant_id", "id", F.coalesce("root", "start").alias("component"))
        before, done = done, stored(new if done is None else done.unionByName(new), "components")
        discard(stars, *([] if before is None else [before, start]))
    return done, done


def label(member: DataFrame, place: DataFrame, edges: DataFrame, rows, border: str = "scan", reuse: bool = False) -> DataFrame:
    """(variant_id, id, cluster) of every point, as a stored table.

    ``member`` has (id, place, xbin, ybin) of each point, ``place`` (id, xbin, ybin) of
    each place, ``edges`` (variant_id, minpts, i, j, j_w) between places. Joins on a
    component, a place or a pair of coordinates may meet one that holds most rows;
    both their sides are plain reads or shuffles, so that adaptive execution
    splits such a key's partition. Tables made on the way are removed.
    """
    if border not in ("scan", "textbook"):
        raise ValueError(f"border {border!r}")
    spark = member.sparkSession
    core = stored(core_places(edges), "core")
    is_i, is_j = (core.select("variant_id", F.col("id").alias(c)) for c in ("i", "j"))
    links = edges.filter("i <> j").select("variant_id", "i", "j").join(is_j, ["variant_id", "j"], "left_semi")
    inner = links.filter("i > j").join(is_i, ["variant_id", "i"], "left_semi")
    kept = [stored(inner, "links")] if reuse else []
    found, table = _components_reusing(core, kept[0], rows) if reuse else _components(core, inner)
    key = F.struct("xbin", "ybin", "id")
    comp = stored(found.join(place.select("id", "xbin", "ybin"), "id"), "components")
    seeds = comp.groupBy("variant_id", "component").agg(F.min(key).alias("seed"))
    ranks = ranked(seeds, [F.col("seed")], ("variant_id",), "cluster")
    numbers = stored(ranks.select("variant_id", "component", "seed", F.col("cluster").cast("int").alias("cluster")), "numbers")
    of_core = comp.select("variant_id", "id", "component").join(numbers, ["variant_id", "component"]).select("variant_id", "id", "cluster", "seed")
    # a place that isn't core takes the first cluster among its core neighbours'
    outer = links.join(is_i, ["variant_id", "i"], "left_anti").join(of_core.withColumnRenamed("id", "j"), ["variant_id", "j"])
    edge = outer.groupBy("variant_id", F.col("i").alias("id")).agg(F.min(F.struct("seed", "cluster")).alias("m")).select("variant_id", "id", F.col("m.cluster").alias("cluster"), F.col("m.seed").alias("seed"), F.lit(False).alias("core"))
    known = of_core.withColumn("core", F.lit(True)).unionByName(edge)
    ids = F.broadcast(V.variants_frame(spark, rows).select("variant_id"))
    all_ = member.join(ids).join(known.withColumnRenamed("id", "place"), ["variant_id", "place"], "left")
    late = F.struct("xbin", "ybin", "id") > F.col("seed")
    joins = F.col("core") | (late if border == "scan" else F.lit(True))
    out = stored(all_.select("variant_id", "id", F.when(F.col("cluster").isNotNull() & joins, F.col("cluster")).otherwise(0).cast("int").alias("cluster")), "labels")
    discard(core, comp, ranks, numbers, table, *kept)
    return out


def dbscan_from_edges(points: DataFrame, edges: DataFrame, minpts: int, border: str = "scan") -> DataFrame:
    """(id, cluster) from a given neighbour table (i, j) of points, self pairs included; narrow it first for a smaller epsilon.

    Copies of a point are separate rows of such a table, so each point is a place of its own.
    """
    p = scan_bins(points).select("id", F.col("id").alias("place"), "xbin", "ybin")
    e = edges.select(F.lit(0).alias("variant_id"), F.lit(minpts).alias("minpts"), "i", "j", F.lit(1).cast("long").alias("j_w"))
    return label(p, p.select("id", "xbin", "ybin"), e, [(0, 0.0, minpts)], border).select("id", "cluster")


def variant_dbscan(points: DataFrame, eps: Sequence[float], minpts: Sequence[float], border: str = "scan", reuse: bool = False, mbbsize: int = 70) -> DataFrame:
    """(variant_id, id, cluster) for points (id, x, y) and each setting; variant ids are positions in the lists.

    ``mbbsize``, points per index box, is taken for callers that set it: it never
    changed labels, and here there is no index. ``reuse`` starts each setting from
    the components of an earlier one; labels are the same.
    """
    rows = V.checked(eps, minpts)
    if not rows or mbbsize < 1:
        raise ValueError("no variants" if not rows else f"mbbsize {mbbsize}")
    if border not in ("scan", "textbook"):
        raise ValueError(f"border {border!r}")
    place = stored(places(points), "places")
    low = cells.fits(place, rows)
    if low is not None:
        out = cells.variant_labels(points, place, rows, low, border, reuse)
        discard(place)
        return out
    pairs = stored(variant_edges(place, rows), "pairs")
    p = points.withColumn("x", F.col("x") + F.lit(0.0)).withColumn("y", F.col("y") + F.lit(0.0))
    member = p.join(place.select("x", "y", F.col("id").alias("place"), "xbin", "ybin"), ["x", "y"]).select("id", "place", "xbin", "ybin")
    out = label(member, place, pairs, rows, border, reuse)
    discard(place, pairs)
    return out


def cluster_arrays(eps_array, mp_array, x_array, y_array, mbbsize: int = 70, verbose: bool = False, spark=None):
    """Labels of in-memory points as a numpy array: (points,) for one setting, else (points, settings)."""
    import logging

    import numpy as np
    from pyspark.sql import SparkSession

    from varigrid.sources.points import from_arrays

    spark = spark or SparkSession.builder.getOrCreate()
    rows = V.checked(list(eps_array), list(mp_array))
    if verbose:
        logging.getLogger(__name__).info("%d points, variants %s", len(x_array), rows)
    out = np.zeros((len(x_array), len(rows)), np.uint32)
    if len(x_array):
        got = variant_dbscan(from_arrays(spark, x_array, y_array), [e for _, e, _ in rows], [m for _, _, m in rows], mbbsize=mbbsize).toArrow()
        out[np.asarray(got["id"]), np.asarray(got["variant_id"])] = np.asarray(got["cluster"])
    return out[:, 0] if len(rows) == 1 else out
