"""Registered queries of the clustering engine, and the same in DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varigrid.functions.geometry import box_around, box_of_corners, degree_bin
from varigrid.operators import cluster as C
from varigrid.operators import neighbors as N
from varigrid.operators import stats as S
from varigrid.plans import variants as V
from varigrid.plans.scan import extent, ranked
from varigrid.plans.storage import shared_dir, stored
from varigrid.sources import points as P

SETTINGS = {
    "embeddings": [(0.02, 4), (0.03, 4), (0.05, 8)],
    "part": [(1.0, 4), (2.0, 4)],
    "customer": [(20.0, 4), (50.0, 4)],
    "events": [(2.0, 4), (3.0, 5), (5.0, 8)],
}
GROWING = [(0.05, 8), (0.02, 4), (0.03, 4), (0.02, 8), (0.03, 3), (0.05, 4)]
EPS = 0.03


def load(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """A table as points."""
    t = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    if source == "embeddings":
        p = t.select(F.col("vec_id").alias("id"), F.element_at("embedding", 1).cast("double").alias("x"), F.element_at("embedding", 2).cast("double").alias("y"))
    elif source == "part":
        p = t.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("x"), F.col("p_retailprice").alias("y"))
    elif source == "customer":
        p = t.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("x"), F.col("c_acctbal").alias("y"))
    elif source == "events":
        hours = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))") / F.lit(3.6e9)
        p = t.select(F.col("event_id").alias("id"), hours.alias("x"), F.col("value").alias("y"))
    else:
        raise ValueError(source)
    return P.as_points(p)


def labels(spark, d, source, settings=None, **how) -> DataFrame:
    v = settings or SETTINGS[source]
    return C.variant_dbscan(load(spark, d, source), [e for e, _ in v], [m for _, m in v], **how)


_POINTS = {
    "embeddings": "SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings",
    "part": "SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, CAST(p_retailprice AS DOUBLE) AS y FROM part",
    "customer": "SELECT c_custkey AS id, CAST(c_nationkey AS DOUBLE) AS x, CAST(c_acctbal AS DOUBLE) AS y FROM customer",
    "events": "SELECT event_id AS id, epoch_us(ts) / CAST(3.6e9 AS DOUBLE) AS x, CAST(value AS DOUBLE) AS y FROM events",
}
_FINE = "id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND isfinite(x) AND isfinite(y)"


def _pts(source: str) -> str:
    return f"""pts AS (SELECT id, x, y FROM ({_POINTS[source]}) WHERE {_FINE}),
ext AS (SELECT min(x) AS x0, min(y) AS y0, (greatest(max(x), CAST(2.2250738585072014e-308 AS DOUBLE)) - min(x)) * CAST(1.01 AS DOUBLE) AS wx, (greatest(max(y), CAST(2.2250738585072014e-308 AS DOUBLE)) - min(y)) * CAST(1.01 AS DOUBLE) AS wy FROM pts),
bins AS (SELECT id, x, y, CASE WHEN wx = 0 THEN 0 ELSE CAST(floor((x + -x0) / wx * 300) AS BIGINT) END AS xbin, CASE WHEN wy = 0 THEN 0 ELSE CAST(floor((y + -y0) / wy * 300) AS BIGINT) END AS ybin FROM pts, ext),
p AS (SELECT *, row_number() OVER (ORDER BY xbin, ybin, id) AS r FROM bins)"""


def _near(eps: str) -> str:
    return f"abs(a.x - b.x) <= {eps} AND abs(a.y - b.y) <= {eps} AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {eps}"


def _label_ctes(source: str, settings, border: str = "scan") -> str:
    values = ", ".join(f"({i}, CAST({e!r} AS DOUBLE), {m})" for i, (e, m) in enumerate(settings))
    late = "p.r > bord.s" if border == "scan" else "TRUE"
    return f"""WITH RECURSIVE {_pts(source)},
v(variant_id, eps, minpts) AS (VALUES {values}),
e AS (SELECT v.variant_id, a.r AS i, b.r AS j FROM v, p a, p b WHERE {_near("v.eps")}),
core AS (SELECT e.variant_id, e.i AS r FROM e JOIN v ON e.variant_id = v.variant_id GROUP BY e.variant_id, e.i, v.minpts HAVING count(*) >= v.minpts),
ce AS (SELECT e.* FROM e JOIN core a ON e.variant_id = a.variant_id AND e.i = a.r JOIN core b ON e.variant_id = b.variant_id AND e.j = b.r),
lab(variant_id, r, l) AS (SELECT variant_id, r, r FROM core UNION SELECT ce.variant_id, ce.j, lab.l FROM lab JOIN ce ON lab.variant_id = ce.variant_id AND lab.r = ce.i WHERE lab.l < ce.j),
seed AS (SELECT variant_id, r, min(l) AS s FROM lab GROUP BY variant_id, r),
num AS (SELECT variant_id, s, dense_rank() OVER (PARTITION BY variant_id ORDER BY s) AS c FROM (SELECT DISTINCT variant_id, s FROM seed)),
bord AS (SELECT e.variant_id, e.i AS r, min(seed.s) AS s FROM e JOIN seed ON e.variant_id = seed.variant_id AND e.j = seed.r LEFT JOIN core ON e.variant_id = core.variant_id AND e.i = core.r WHERE core.r IS NULL GROUP BY e.variant_id, e.i),
labels AS (SELECT v.variant_id, p.id, CAST(coalesce(nc.c, CASE WHEN {late} THEN nb.c END, 0) AS INTEGER) AS cluster, p.x, p.y, seed.r IS NOT NULL AS is_core
 FROM v CROSS JOIN p LEFT JOIN seed ON seed.variant_id = v.variant_id AND seed.r = p.r LEFT JOIN num nc ON nc.variant_id = v.variant_id AND nc.s = seed.s
 LEFT JOIN bord ON bord.variant_id = v.variant_id AND bord.r = p.r LEFT JOIN num nb ON nb.variant_id = v.variant_id AND nb.s = bord.s)"""


def _labels_sql(source: str, settings=None, border: str = "scan", select: str = "SELECT variant_id, id, cluster FROM labels") -> str:
    return f"{_label_ctes(source, settings or SETTINGS[source], border)}\n{select}"


def _edges_sql(source: str, eps: float, select: str) -> str:
    return f"WITH {_pts(source)}, e AS (SELECT a.id AS i, b.id AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist FROM p a, p b WHERE {_near(f'CAST({eps!r} AS DOUBLE)')}) {select}"


def _edges(spark, d, eps=EPS, source="embeddings"):
    return N.eps_join(load(spark, d, source), eps)


def _core(spark, d):
    (eps, minpts) = SETTINGS["embeddings"][1]
    return N.neighbor_counts(_edges(spark, d, eps)).filter(F.col("neighbors") >= minpts).select("id")


def _border(spark, d):
    core, e = _core(spark, d), _edges(spark, d)
    return e.join(core.withColumnRenamed("id", "j"), "j", "left_semi").select(F.col("i").alias("id")).distinct().join(core, "id", "left_anti")


def _noise(spark, d):
    return labels(spark, d, "embeddings", [SETTINGS["embeddings"][1]], border="textbook").filter("cluster = 0").select("id")


def _minpts_sweep(spark, d):
    """One neighbour table, several minpts."""
    n = N.neighbor_counts(_edges(spark, d))
    steps = F.explode(F.array(*[F.lit(m) for m in (2, 4, 8, 16)])).alias("minpts")
    return n.select("id", "neighbors", steps).groupBy("minpts").agg(F.sum(F.when(F.col("neighbors") >= F.col("minpts"), 1).otherwise(0)).alias("core_points"))


BOXES = [(0, -0.1, -0.1, 0.1, 0.1), (1, 0.0, -0.2, 0.15, 0.05), (2, 5.0, 5.0, 6.0, 6.0), (3, -0.05, 0.02, 0.3, 0.3)]


def _range_query(spark, d):
    b = spark.createDataFrame(BOXES, "box_id int, xmin double, ymin double, xmax double, ymax double")
    return N.range_query(load(spark, d, "embeddings"), b, 0.1)


def _boxes(spark, d, source="part"):
    points = load(spark, d, source)
    return S.cluster_boxes(labels(spark, d, source), points)


def _expanded_overlap(spark, d):
    from varigrid.functions.geometry import expand_box

    b = stored(_boxes(spark, d).filter("variant_id = 0").select(F.col("cluster").alias("box_id"), *expand_box(SETTINGS["part"][0][0])), "boxes")
    return N.box_overlaps(b, b, 50.0).filter("a_id < b_id")


def _estimate(spark, d):
    return N.estimated_pairs(load(spark, d, "part"), 2.0)


def _frame(spark, settings):
    return V.variants_frame(spark, V.checked([e for e, _ in settings], [m for _, m in settings]))


def _outside(spark, d):
    points, got = load(spark, d, "part"), stored(labels(spark, d, "part"), "labels")
    return S.outside_candidates(got, points, S.cluster_boxes(got, points), 2.0, 50.0)


def _frontier(spark, d):
    return S.frontier(labels(spark, d, "part", border="scan"), load(spark, d, "part"), 2.0)


def _wide(spark, d):
    return P.wide(labels(spark, d, "embeddings"), [0, 1, 2])


def _geo_columns(spark, d):
    t = spark.read.parquet(f"{d}/customer.parquet")
    return t.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 120.0).alias("latitude"), F.col("c_nationkey").cast("double").alias("longitude"))


def _geo(spark, d):
    return P.geo_points(_geo_columns(spark, d))


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/varigrid-{name}-{uuid.uuid4().hex}"


def _points_csv(spark, d):
    """Points written as CSV in id order and read back."""
    path = _folder(spark, "points-csv")
    load(spark, d, "part").orderBy("id").select("x", "y").write.csv(path)
    return P.read_points_csv(spark, path)


def _geo_csv(spark, d):
    path = _folder(spark, "geo-csv")
    _geo_columns(spark, d).orderBy("id").select("longitude", "latitude", F.lit(5.0).alias("tec"), F.lit("noon").alias("time")).write.csv(path)
    return P.read_geo_csv(spark, path)


def _variants_csv(spark, d):
    path = _folder(spark, "variants-csv")
    spark.createDataFrame([(float(e), m) for e, m in GROWING], "epsilon double, minpts int").coalesce(1).write.csv(path)
    return P.read_variants_csv(spark, path)


def _array_labels(spark, d):
    """In-memory points through the array entry point; its callers hold the arrays."""
    import numpy as np
    import pyarrow as pa

    t = load(spark, d, "embeddings").orderBy("id").toArrow()
    out = C.cluster_arrays([e for e, _ in SETTINGS["embeddings"]], [m for _, m in SETTINGS["embeddings"]], np.asarray(t["x"]), np.asarray(t["y"]), spark=spark)
    return spark.createDataFrame(pa.table({"id": np.asarray(t["id"]), **{f"cluster_{k}": out[:, k].astype(np.int32) for k in range(out.shape[1])}}))


def _wide_csv(spark, d):
    """The CSV sink's lines, read back as text."""
    path, points = _folder(spark, "labels-csv"), load(spark, d, "embeddings")
    P.write_wide_csv(P.wide(labels(spark, d, "embeddings"), [0, 1, 2], points), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


TRIALS = [(eps, trial, 10.0 * eps + trial * trial) for eps in (0.5, 1.0, 2.0) for trial in range(4)]


def _metrics(spark):
    path = _folder(spark, "metrics")
    for eps, trial, seconds in TRIALS:
        P.append_metrics(spark, {"epsilon": eps, "trial": trial, "seconds": seconds}, path)
    return spark.read.schema("epsilon double, trial long, seconds double").parquet(path)


def _corner_boxes(spark, d):
    p = load(spark, d, "part").withColumn("x2", F.col("y") - F.col("x")).withColumn("y2", F.col("x") * 2)
    own = [c.alias(f"own_{n}") for c, n in zip(box_around("x", "y", 1.5), ("xmin", "ymin", "xmax", "ymax"), strict=True)]
    return p.select("id", *box_of_corners("x", "y", "x2", "y2"), *own)


def _saved_range(spark, d):
    path = _folder(spark, "cells")
    P.save_cells(load(spark, d, "embeddings"), 0.1, path)
    return P.saved_range_query(spark, path, spark.createDataFrame(BOXES, "box_id int, xmin double, ymin double, xmax double, ymax double"), 0.1)


def _range_where(spark, d):
    t = spark.read.parquet(f"{d}/embeddings.parquet")
    p = P.as_points(t.select(F.col("vec_id").alias("id"), F.element_at("embedding", 1).alias("x"), F.element_at("embedding", 2).alias("y"), "label"), keep=["label"])
    return N.range_query(p, spark.createDataFrame(BOXES, "box_id int, xmin double, ymin double, xmax double, ymax double"), 0.1, F.col("label") % 2 == 0)


def _grid_against_brute(spark, d):
    """Pairs that the grid join and the brute-force join don't share."""
    points = load(spark, d, "embeddings")
    a, b = N.eps_join(points, EPS).select("i", "j"), N.eps_join_brute(points, EPS).select("i", "j")
    apart = a.withColumn("side", F.lit(1)).unionByName(b.withColumn("side", F.lit(2))).groupBy("i", "j").agg(F.sum("side").alias("sides")).filter("sides <> 3")
    return apart.agg(F.count("*").alias("pairs_apart"))


def _estimate_from_larger(spark, d):
    pairs = N.total_neighbors(_edges(spark, d, 0.05), [0.05]).select("pairs")
    return pairs.select(*[N.estimated_from_larger(F.col("pairs"), e, 0.05).alias(f"at_{int(e * 100)}") for e in (0.01, 0.02, 0.03)])


def _counts(spark, d):
    sources = [load(spark, d, source).agg(F.count("*").alias("points")).select(F.lit(source).alias("source"), "points") for source in sorted(SETTINGS)]
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out


def _degree_bins(spark, d):
    p = load(spark, d, "customer").withColumn("bin_x", degree_bin("x")).withColumn("bin_y", degree_bin("y"))
    return ranked(p, [F.col("bin_x"), F.col("bin_y"), F.col("id")], name="position").select("id", "bin_x", "bin_y", "position")


def _table_text(df):
    return df.select("id", F.array_join("neighbors", ",").alias("neighbors"))


def _listing(spark, d):
    return P.listing(labels(spark, d, "customer"), load(spark, d, "customer"))


def _csr(spark, d):
    return N.neighbor_offsets(N.neighbor_table(_edges(spark, d))).select("id", "first", "last")


def _from_edges(spark, d):
    return C.dbscan_from_edges(load(spark, d, "embeddings"), N.narrowed(stored(_edges(spark, d, 0.05), "edges"), EPS), 4)


def _variants_sql(select: str) -> str:
    values = ", ".join(f"({i}, CAST({e!r} AS DOUBLE), {m})" for i, (e, m) in enumerate(GROWING))
    return f"WITH v(variant_id, epsilon, minpts) AS (VALUES {values}), o AS (SELECT *, row_number() OVER (ORDER BY epsilon, minpts DESC, variant_id) AS position FROM v) {select}"


_CELL = "CAST(floor((x - (x0 - 0.5 * {e})) / {e}) AS BIGINT) AS cx, CAST(floor((y - (y0 - 0.5 * {e})) / {e}) AS BIGINT) AS cy"


def _cells_sql(select: str, eps: float = 2.0, source: str = "part") -> str:
    e = f"CAST({eps!r} AS DOUBLE)"
    return f"WITH {_pts(source)}, x AS (SELECT min(x) AS x0, min(y) AS y0 FROM pts), cells AS (SELECT cx, cy, count(*) AS n FROM (SELECT {_CELL.format(e=e)} FROM pts, x) GROUP BY cx, cy) {select}"


def _uniform_sql(seed: int) -> str:
    return f"(CAST(CAST(concat('0x', md5(concat('{seed}:', id))[1:8]) AS BIGINT) AS DOUBLE) / CAST(4294967296 AS DOUBLE))"


#: Centres of the clustered generator.
_CENTRES = ", ".join(f"({i}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for i, (a, b) in enumerate(P.CENTRES))
_POINTS["clustered"] = f"SELECT id, cx + ({_uniform_sql(0)} * 2 - 1) * 5 AS x, cy + ({_uniform_sql(1)} * 2 - 1) * 5 AS y FROM (SELECT range AS id FROM range(1400)) JOIN (VALUES {_CENTRES}) c(k, cx, cy) ON id // 200 = k"
_POINTS["uniform"] = f"SELECT id, {_uniform_sql(0)} * 180 AS x, {_uniform_sql(1)} * 360 AS y FROM (SELECT range AS id FROM range(20000))"
_GRID = "SELECT full_cells + empty_cells AS cells, * FROM (SELECT count(*) AS full_cells, (SELECT (CAST(ceil((max(x) - (min(x) - 2.5)) / 5) AS BIGINT) + 1) * (CAST(ceil((max(y) - (min(y) - 2.5)) / 5) AS BIGINT) + 1) FROM pts) - count(*) AS empty_cells, max(n) AS most FROM cells)"

_EMB1 = [SETTINGS["embeddings"][1]]
_BOX = "SELECT variant_id, cluster, count(*) AS n, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM labels WHERE cluster > 0 GROUP BY variant_id, cluster"
_BOX_VALUES = ", ".join(f"({i}, " + ", ".join(f"CAST({v!r} AS DOUBLE)" for v in b) + ")" for i, *b in BOXES)

#: name: (query, DuckDB SQL or None)
_ALL = {
    "dbscan_embeddings": (lambda s, d: labels(s, d, "embeddings", _EMB1).select("id", "cluster"), _labels_sql("embeddings", _EMB1, select="SELECT id, cluster FROM labels")),
    "dbscan_part": (lambda s, d: labels(s, d, "part"), _labels_sql("part")),
    "dbscan_customer": (lambda s, d: labels(s, d, "customer"), _labels_sql("customer")),
    "dbscan_events": (lambda s, d: labels(s, d, "events"), _labels_sql("events")),
    "dbscan_textbook": (lambda s, d: labels(s, d, "part", border="textbook"), _labels_sql("part", border="textbook")),
    "dbscan_from_edges": (_from_edges, _labels_sql("embeddings", [(EPS, 4)], select="SELECT id, cluster FROM labels")),
    "variant_dbscan_long": (lambda s, d: labels(s, d, "embeddings"), _labels_sql("embeddings")),
    "variant_dbscan_wide": (_wide, _labels_sql("embeddings", select="SELECT id, max(CASE WHEN variant_id = 0 THEN cluster END) AS cluster_0, max(CASE WHEN variant_id = 1 THEN cluster END) AS cluster_1, max(CASE WHEN variant_id = 2 THEN cluster END) AS cluster_2 FROM labels GROUP BY id")),
    "variant_dbscan_reuse": (lambda s, d: labels(s, d, "embeddings", GROWING, reuse=True), _labels_sql("embeddings", GROWING)),
    "minpts_sweep": (_minpts_sweep, _edges_sql("embeddings", EPS, ", n AS (SELECT i, count(*) AS c FROM e GROUP BY i) SELECT m.minpts, CAST(sum(CASE WHEN c >= m.minpts THEN 1 ELSE 0 END) AS BIGINT) AS core_points FROM n, (VALUES (2), (4), (8), (16)) m(minpts) GROUP BY m.minpts")),
    "eps_join_pairs": (lambda s, d: _edges(s, d), _edges_sql("embeddings", EPS, "SELECT i, j, dist FROM e")),
    "eps_join_brute": (lambda s, d: N.eps_join_brute(load(s, d, "embeddings"), EPS), _edges_sql("embeddings", EPS, "SELECT i, j, dist FROM e")),
    "pairs_from_larger_eps": (lambda s, d: N.narrowed(_edges(s, d, 0.05), 0.02), _edges_sql("embeddings", 0.02, "SELECT i, j, dist FROM e")),
    "neighbor_counts": (lambda s, d: N.neighbor_counts(_edges(s, d)), _edges_sql("embeddings", EPS, "SELECT i AS id, count(*) AS neighbors FROM e GROUP BY i")),
    "neighbor_table": (lambda s, d: _table_text(N.neighbor_table(_edges(s, d))), _edges_sql("embeddings", EPS, "SELECT i AS id, string_agg(CAST(j AS VARCHAR), ',' ORDER BY j) AS neighbors FROM e GROUP BY i")),
    "neighbor_offsets": (_csr, _edges_sql("embeddings", EPS, ", n AS (SELECT i AS id, count(*) AS c FROM e GROUP BY i), t AS (SELECT id, c, CAST(sum(c) OVER (ORDER BY id) AS BIGINT) AS s FROM n) SELECT id, s - c AS first, s - 1 AS last FROM t")),
    "core_points": (_core, _edges_sql("embeddings", EPS, "SELECT i AS id FROM e GROUP BY i HAVING count(*) >= 4")),
    "border_points": (_border, _edges_sql("embeddings", EPS, ", c AS (SELECT i FROM e GROUP BY i HAVING count(*) >= 4) SELECT DISTINCT e.i AS id FROM e WHERE j IN (SELECT i FROM c) AND e.i NOT IN (SELECT i FROM c)")),
    "noise_points": (_noise, _edges_sql("embeddings", EPS, ", c AS (SELECT i FROM e GROUP BY i HAVING count(*) >= 4) SELECT id FROM p WHERE id NOT IN (SELECT e.i FROM e WHERE j IN (SELECT i FROM c))")),
    "total_neighbors_by_eps": (lambda s, d: N.total_neighbors(_edges(s, d, 0.05), [0.01, 0.02, 0.03, 0.05]), _edges_sql("embeddings", 0.05, "SELECT t.epsilon, count(*) AS pairs FROM e JOIN (VALUES (CAST(0.01 AS DOUBLE)), (CAST(0.02 AS DOUBLE)), (CAST(0.03 AS DOUBLE)), (CAST(0.05 AS DOUBLE))) t(epsilon) ON e.dist <= t.epsilon GROUP BY t.epsilon")),
    "neighbor_estimate": (_estimate, f"WITH {_pts('part')}, k AS (SELECT *, row_number() OVER (ORDER BY id) AS n FROM p) SELECT count(*) * 100 AS estimate, CAST(count(*) * 100 * 1.05 AS DOUBLE) AS bound FROM (SELECT * FROM k WHERE n % 100 = 1) a, p b WHERE {_near('CAST(2.0 AS DOUBLE)')}"),
    "range_query": (_range_query, f"WITH {_pts('embeddings')}, b(box_id, xmin, ymin, xmax, ymax) AS (VALUES {_BOX_VALUES}) SELECT box_id, id FROM b, p WHERE x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax"),
    "point_neighborhood": (lambda s, d: N.point_neighborhood(load(s, d, "embeddings"), 0.05, 0.05, 0.1), f"WITH {_pts('embeddings')} SELECT * FROM (SELECT id, sqrt((x - CAST(0.05 AS DOUBLE)) * (x - CAST(0.05 AS DOUBLE)) + (y - CAST(0.05 AS DOUBLE)) * (y - CAST(0.05 AS DOUBLE))) AS dist FROM p) WHERE dist <= CAST(0.1 AS DOUBLE)"),
    "mbb_per_cluster": (_boxes, _labels_sql("part", select=_BOX)),
    "mbb_expanded_overlap": (_expanded_overlap, _labels_sql("part", select=f", b AS (SELECT cluster, xmin - 1.0 AS xmin, ymin - 1.0 AS ymin, xmax + 1.0 AS xmax, ymax + 1.0 AS ymax FROM ({_BOX}) WHERE variant_id = 0) SELECT a.cluster AS a_id, b.cluster AS b_id FROM b a, b WHERE a.cluster < b.cluster AND a.xmin <= b.xmax AND b.xmin <= a.xmax AND a.ymin <= b.ymax AND b.ymin <= a.ymax")),
    "cluster_density_rank": (lambda s, d: S.density_ranks(_boxes(s, d, "customer"), 20.0), _labels_sql("customer", select=f"SELECT variant_id, cluster, n, density, row_number() OVER (PARTITION BY variant_id ORDER BY density DESC, cluster) AS density_rank FROM (SELECT variant_id, cluster, n, n / (((xmax + CAST(20.0 AS DOUBLE)) - (xmin - CAST(20.0 AS DOUBLE))) * ((ymax + CAST(20.0 AS DOUBLE)) - (ymin - CAST(20.0 AS DOUBLE)))) AS density FROM ({_BOX}) WHERE n >= 100)")),
    "cluster_sizes": (lambda s, d: S.cluster_sizes(labels(s, d, "part")), _labels_sql("part", select="SELECT variant_id, cluster, count(*) AS n FROM labels GROUP BY variant_id, cluster")),
    "variant_summary": (lambda s, d: S.variant_summary(labels(s, d, "customer")), _labels_sql("customer", select="SELECT variant_id, count(*) AS points, CAST(sum(CASE WHEN cluster = 0 THEN 1 ELSE 0 END) AS BIGINT) AS noise, CAST(max(cluster) AS BIGINT) AS clusters, CAST(max(cluster) + 1 AS BIGINT) AS clusters_with_noise FROM labels GROUP BY variant_id")),
    "label_listing": (_listing, _labels_sql("customer", select="SELECT variant_id, id, printf('%d, %.6f, %.6f, %d', id, x, y, cluster) AS line FROM labels")),
    "scan_order": (lambda s, d: S.scan_order(load(s, d, "embeddings")), f"WITH {_pts('embeddings')} SELECT id, xbin, ybin, r - 1 AS position FROM p"),
    "mpb_boxes": (lambda s, d: S.packed_boxes(load(s, d, "part")), f"WITH {_pts('part')} SELECT CAST(floor((r - 1) / 70) AS BIGINT) AS box_id, count(*) AS n, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM p GROUP BY 1"),
    "grid_cells": (lambda s, d: N.grid_cells(load(s, d, "part"), 2.0), _cells_sql("SELECT cx, cy, n FROM cells")),
    "non_empty_cells": (lambda s, d: N.grid_cells(load(s, d, "part"), 2.0).select("cx", "cy"), _cells_sql("SELECT cx, cy FROM cells")),
    "grid_3x3_max": (lambda s, d: N.fullest_neighborhood(N.grid_cells(load(s, d, "part"), 2.0)), _cells_sql("SELECT CAST(max(s) AS BIGINT) AS most_points FROM (SELECT sum(b.n) AS s FROM cells a JOIN cells b ON abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1 GROUP BY a.cx, a.cy)")),
    "extent": (lambda s, d: extent(load(s, d, "events")), f"WITH {_pts('events')} SELECT min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM pts"),
    "variant_order": (lambda s, d: V.growing_order(_frame(s, GROWING)).join(V.shrinking_order(_frame(s, GROWING)).select("variant_id", F.col("position").alias("shrinking_position")), "variant_id"), _variants_sql("SELECT variant_id, epsilon, minpts, position, row_number() OVER (ORDER BY epsilon DESC, minpts, variant_id) AS shrinking_position FROM o")),
    "variant_parents": (lambda s, d: V.parents(_frame(s, GROWING)), _variants_sql("SELECT a.variant_id, arg_max(b.variant_id, b.position) AS parent_id FROM o a LEFT JOIN o b ON b.position < a.position AND b.minpts >= a.minpts GROUP BY a.variant_id")),
    "scratch_list": (lambda s, d: V.scratch_list(_frame(s, GROWING)), _variants_sql("SELECT variant_id, epsilon, minpts, position, coalesce(lag(epsilon) OVER (ORDER BY position) <> epsilon, TRUE) AS scratch FROM o")),
    "candidates_outside_cluster": (_outside, _labels_sql("part", select=f", b AS ({_BOX}) SELECT b.variant_id, b.cluster, l.id FROM b JOIN labels l ON l.variant_id = b.variant_id AND l.cluster <> b.cluster AND l.x BETWEEN b.xmin - 2.0 AND b.xmax + 2.0 AND l.y BETWEEN b.ymin - 2.0 AND b.ymax + 2.0")),
    "growth_frontier": (_frontier, _labels_sql("part", select=f"SELECT DISTINCT a.variant_id, a.cluster, a.id FROM labels a JOIN labels b ON a.variant_id = b.variant_id AND a.cluster > 0 AND a.cluster <> b.cluster AND {_near('CAST(2.0 AS DOUBLE)')}")),
    "geo_remap": (_geo, "SELECT c_custkey AS id, CASE WHEN l > 0 THEN (90 - l) / 90 * 90 ELSE (-l / 90) * 90 + 90 END AS x, CAST(c_nationkey AS DOUBLE) AS y FROM (SELECT *, c_acctbal / CAST(120.0 AS DOUBLE) AS l FROM customer)"),
    "strided_batches": (lambda s, d: N.batches(load(s, d, "part"), 7).groupBy("batch").agg(F.count("*").alias("n"), F.min("id").alias("first_id")), f"WITH {_pts('part')}, k AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM p) SELECT CAST(n % 7 AS INTEGER) AS batch, count(*) AS n, min(id) AS first_id FROM k GROUP BY 1"),
    "degree_bin_sort": (_degree_bins, f"WITH {_pts('customer')}, b AS (SELECT id, CAST(ceil(x) AS BIGINT) AS bin_x, CAST(ceil(y) AS BIGINT) AS bin_y FROM p) SELECT id, bin_x, bin_y, row_number() OVER (ORDER BY bin_x, bin_y, id) AS position FROM b"),
    "generated_clusters": (lambda s, d: C.variant_dbscan(P.clustered_points(s, 1400), [0.6], [4]), _labels_sql("clustered", [(0.6, 4)])),
    "generated_uniform": (lambda s, d: N.grid_summary(P.random_points(s, 20000), 5.0), _cells_sql(_GRID, 5.0, "uniform")),
    "points_csv": (_points_csv, f"WITH {_pts('part')} SELECT row_number() OVER (ORDER BY id) - 1 AS id, x, y FROM p"),
    "geo_csv": (_geo_csv, "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS id, CASE WHEN l > 0 THEN (90 - l) / 90 * 90 ELSE (-l / 90) * 90 + 90 END AS x, CAST(c_nationkey AS DOUBLE) AS y FROM (SELECT *, c_acctbal / CAST(120.0 AS DOUBLE) AS l FROM customer)"),
    "variants_csv": (_variants_csv, _variants_sql("SELECT variant_id, epsilon, minpts, row_number() OVER (ORDER BY epsilon DESC, minpts, variant_id) AS position FROM o")),
    "array_labels": (_array_labels, _labels_sql("embeddings", select="SELECT id, max(CASE WHEN variant_id = 0 THEN cluster END) AS cluster_0, max(CASE WHEN variant_id = 1 THEN cluster END) AS cluster_1, max(CASE WHEN variant_id = 2 THEN cluster END) AS cluster_2 FROM labels GROUP BY id")),
    "labels_csv": (_wide_csv, _labels_sql("embeddings", select="SELECT printf('%.4f,%.4f,%d,%d,%d', x, y, max(CASE WHEN variant_id = 0 THEN cluster END), max(CASE WHEN variant_id = 1 THEN cluster END), max(CASE WHEN variant_id = 2 THEN cluster END)) AS line FROM labels GROUP BY id, x, y")),
    "metrics_appended": (lambda s, d: _metrics(s), f"SELECT CAST(a AS DOUBLE) AS epsilon, CAST(b AS BIGINT) AS trial, CAST(c AS DOUBLE) AS seconds FROM (VALUES {', '.join(map(str, TRIALS))}) t(a, b, c)"),
    "trial_means": (lambda s, d: P.trial_means(_metrics(s), ["epsilon"], "seconds"), f"SELECT CAST(a AS DOUBLE) AS epsilon, avg(CAST(c AS DOUBLE)) AS mean_seconds FROM (VALUES {', '.join(map(str, TRIALS))}) t(a, b, c) WHERE b > 0 GROUP BY a"),
    "corner_boxes": (_corner_boxes, f"WITH {_pts('part')} SELECT id, least(x, y - x) AS xmin, least(y, x * 2) AS ymin, greatest(x, y - x) AS xmax, greatest(y, x * 2) AS ymax, x - 1.5 AS own_xmin, y - 1.5 AS own_ymin, x + 1.5 AS own_xmax, y + 1.5 AS own_ymax FROM p"),
    "saved_range_query": (_saved_range, f"WITH {_pts('embeddings')}, b(box_id, xmin, ymin, xmax, ymax) AS (VALUES {_BOX_VALUES}) SELECT box_id, id FROM b, p WHERE x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax"),
    "range_query_where": (_range_where, f"WITH {_pts('embeddings')}, b(box_id, xmin, ymin, xmax, ymax) AS (VALUES {_BOX_VALUES}) SELECT box_id, id FROM b, p JOIN embeddings ON id = vec_id WHERE x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax AND label % 2 = 0"),
    "grid_against_brute": (_grid_against_brute, "SELECT CAST(0 AS BIGINT) AS pairs_apart"),
    "estimate_from_larger": (_estimate_from_larger, _edges_sql("embeddings", 0.05, ", n AS (SELECT CAST(count(*) AS DOUBLE) AS c FROM e) SELECT c * pow(CAST(0.01 AS DOUBLE) / CAST(0.05 AS DOUBLE), 2) AS at_1, c * pow(CAST(0.02 AS DOUBLE) / CAST(0.05 AS DOUBLE), 2) AS at_2, c * pow(CAST(0.03 AS DOUBLE) / CAST(0.05 AS DOUBLE), 2) AS at_3 FROM n")),
    "checked_variants": (lambda s, d: _frame(s, [(1, 8.9), (2.5, 4)]), "SELECT * FROM (VALUES (0, CAST(1 AS DOUBLE), 8), (1, CAST(2.5 AS DOUBLE), 4)) t(variant_id, epsilon, minpts)"),
    "point_counts": (_counts, " UNION ALL ".join(f"SELECT '{source}' AS source, count(*) AS points FROM ({_POINTS[source]}) WHERE {_FINE}" for source in SETTINGS)),
}

QUERIES = {k: q for k, (q, _) in _ALL.items()}
ORACLE_SQL = {k: sql for k, (_, sql) in _ALL.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir, "embeddings")

