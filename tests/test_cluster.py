"""Labels against a plain sequential scan."""

import collections
import math
import os
import random
from pathlib import Path

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from varigrid.operators import cluster as C
from varigrid.operators import neighbors as N
from varigrid.operators import stats as S
from varigrid.plans import variants as V
from varigrid.plans.components import connected_components
from varigrid.plans.scan import scan_bins
from varigrid.sources import points as P


def scan(points, eps, minpts, border="scan"):
    """Visit points in scan order; grow a cluster from each core point that is met unvisited."""
    ids = sorted(points)
    low = [min(points[i][k] for i in ids) for k in (0, 1)]
    width = [(max(max(points[i][k] for i in ids), 2.2250738585072014e-308) - low[k]) * 1.01 for k in (0, 1)]
    bin_ = lambda i: tuple(math.floor((points[i][k] + -low[k]) / width[k] * 300) if width[k] else 0 for k in (0, 1))
    near = {i: [j for j in ids if math.sqrt((points[i][0] - points[j][0]) ** 2 + (points[i][1] - points[j][1]) ** 2) <= eps] for i in ids}
    label, seen, n = dict.fromkeys(ids, 0), set(), 0
    for i in sorted(ids, key=lambda i: (*bin_(i), i)):
        if i in seen:
            continue
        if len(near[i]) < minpts:
            if border == "scan":
                seen.add(i)
            continue
        n += 1
        todo = [i]
        while todo:
            j = todo.pop()
            if j in seen:
                continue
            seen.add(j)
            label[j] = n
            if len(near[j]) >= minpts:
                todo += near[j]
    return label


def got(spark, points, variants, **how):
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in points.items()], "id long, x double, y double")
    rows = C.variant_dbscan(P.as_points(df), [e for e, _ in variants], [m for _, m in variants], **how).collect()
    out = [{} for _ in variants]
    for r in rows:
        out[r.variant_id][r.id] = r.cluster
    return out


def cloud(seed, n=90, negative=False):
    r = random.Random(seed)
    shift = -50 if negative else 0
    return {i: (round(r.choice((1, 3, 7)) + r.gauss(0, 0.5), 1) + shift, round(r.choice((2, 6)) + r.gauss(0, 0.5), 1) + shift) for i in range(n)}


@pytest.mark.parametrize(("seed", "negative"), [(1, False), (2, True)])
def test_labels_of_several_settings(spark, seed, negative):
    points, variants = cloud(seed, negative=negative), [(0.5, 4), (0.3, 4), (0.5, 9), (0.0, 2), (0.4, 1), (0.3, 4)]
    want = [scan(points, e, m) for e, m in variants]
    assert got(spark, points, variants) == want
    assert got(spark, points, variants, reuse=True) == want


def test_textbook_border_and_ids_in_any_row_order(spark):
    points, variants = cloud(3), [(0.4, 6)]
    assert got(spark, points, variants, border="textbook") == [scan(points, 0.4, 6, "textbook")]
    order = list(points)
    random.Random(0).shuffle(order)
    assert got(spark, {i: points[i] for i in order}, variants) == [scan(points, 0.4, 6)]


def test_diagonal(spark):
    x = [3, 2, 8, 1]
    out = C.cluster_arrays([math.sqrt(2) + 0.01, math.sqrt(2) - 0.01], [2, 2], x, x, spark=spark)
    assert out.T.tolist() == [[1, 1, 0, 1], [0, 0, 0, 0]]
    assert C.cluster_arrays([2.0], [2], x, x, spark=spark).shape == (4,)
    assert C.cluster_arrays([2.0], [2], [], [], spark=spark).shape == (0,)


def test_defined_cases(spark):
    same = dict.fromkeys(range(5), (1.0, 1.0))
    assert got(spark, same, [(0.0, 5), (1.0, 6)]) == [dict.fromkeys(range(5), 1), dict.fromkeys(range(5), 0)]
    assert got(spark, {7: (0.0, -0.0), 8: (-0.0, 0.0)}, [(0.0, 2)]) == [{7: 1, 8: 1}]
    assert got(spark, {}, [(1.0, 2)]) == [{}]
    df = spark.createDataFrame([(1, None, 1.0), (2, float("nan"), 1.0), (None, 1.0, 1.0), (3, float("inf"), 0.0)], "id long, x double, y double")
    assert P.as_points(df).count() == 0
    with pytest.raises(ValueError, match="2 values"):
        V.checked([1, 2], [3])
    with pytest.raises(ValueError, match="epsilon"):
        V.checked([float("nan")], [3])


def test_from_edges_keeps_copies_apart(spark):
    points = {0: (0.0, 0.0), 1: (0.0, 0.0), 2: (0.4, 0.0), 3: (5.0, 5.0)}
    df = spark.createDataFrame([(i, *p) for i, p in points.items()], "id long, x double, y double")
    rows = C.dbscan_from_edges(df, N.eps_join(df, 0.5), 3).collect()
    assert {r.id: r.cluster for r in rows} == scan(points, 0.5, 3)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), min_size=1, max_size=40), st.sampled_from([1.0, 2.0, 2.5]))
def test_grid_join_is_the_brute_join(spark, xy, eps):
    df = spark.createDataFrame([(i, x / 2, y / 2) for i, (x, y) in enumerate(xy)], "id long, x double, y double")
    pairs = {(r.i, r.j) for r in N.eps_join(df, eps).collect()}
    assert pairs == {(r.i, r.j) for r in N.eps_join_brute(df, eps).collect()}
    assert pairs == {(j, i) for i, j in pairs}
    assert {(i, i) for i in range(len(xy))} <= pairs


def test_core_points_grow_with_epsilon_and_fewer_points(spark):
    points = cloud(5)
    clusters = got(spark, points, [(0.3, 6), (0.4, 6), (0.4, 4)])
    member = [{i for i, c in x.items() if c} for x in clusters]
    assert len(member[0]) <= len(member[1]) <= len(member[2])


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (3, 3), *[(100 + i, 101 + i) for i in range(40)]]
    df = spark.createDataFrame(edges, "a long, b long")
    comp = {r.node: r.component for r in connected_components(df).collect()}
    assert comp == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8} | dict.fromkeys(range(100, 141), 100)


def test_scan_bins_of_negative_and_flat_data(spark):
    df = spark.createDataFrame([(0, -10.0, 2.0), (1, -1.0, 2.0)], "id long, x double, y double")
    rows = {r.id: (r.xbin, r.ybin) for r in scan_bins(df).collect()}
    assert rows == {0: (0, 0), 1: (math.floor(9 / 10.1 * 300), 0)}


def test_variant_plans(spark):
    rows = V.checked([1.0, 0.5, 0.5, 2.0], [10, 12, 8.9, 9])
    assert rows[2] == (2, 0.5, 8)
    f = V.variants_frame(spark, rows)
    assert [r.variant_id for r in V.growing_order(f).orderBy("position").collect()] == [1, 2, 0, 3]
    assert [r.variant_id for r in V.shrinking_order(f).orderBy("position").collect()] == [3, 0, 2, 1]
    want = {1: None, 2: 1, 0: 1, 3: 0}
    assert {r.variant_id: r.parent_id for r in V.parents(f).collect()} == want == V.parents_of(rows)
    assert {r.variant_id: r.scratch for r in V.scratch_list(f).collect()} == {1: True, 2: False, 0: True, 3: True}


def test_files(spark, tmp_path):
    (tmp_path / "p.csv").write_text("6.6899,-0.1313\n-3.9898,-1.1137\n4.2687,-0.6871\n")
    (tmp_path / "v.csv").write_text("0.5,12\n1.0,10\n")
    (tmp_path / "g.csv").write_text("10,90,5\n20,0,5,noon\n30,-90,5\n")
    p = P.read_points_csv(spark, str(tmp_path / "p.csv"))
    assert [tuple(r) for r in p.orderBy("id").collect()] == [(0, 6.6899, -0.1313), (1, -3.9898, -1.1137), (2, 4.2687, -0.6871)]
    v = P.read_variants_csv(spark, str(tmp_path / "v.csv"))
    assert [(r.variant_id, r.epsilon, r.minpts) for r in v.orderBy("position").collect()] == [(1, 1.0, 10), (0, 0.5, 12)]
    g = P.read_geo_csv(spark, str(tmp_path / "g.csv")).orderBy("id").collect()
    assert [(r.x, r.y) for r in g] == [(0.0, 10.0), (90.0, 20.0), (180.0, 30.0)]
    labels = C.variant_dbscan(p, [20.0, 0.1], [2, 2])
    P.write_wide_csv(P.wide(labels, [0, 1], p), str(tmp_path / "out"))
    text = "".join(f.read_text() for f in sorted((tmp_path / "out").glob("part*")))
    assert text.splitlines() == ["6.6899,-0.1313,1,0", "-3.9898,-1.1137,1,0", "4.2687,-0.6871,1,0"]
    P.append_metrics(spark, {"trial": 0, "s": 9.0}, str(tmp_path / "m"))
    P.append_metrics(spark, {"trial": 1, "s": 2.0}, str(tmp_path / "m"))
    assert P.trial_means(spark.read.parquet(str(tmp_path / "m")), [], "s").first().mean_s == 2.0
    P.save_cells(p, 1.0, str(tmp_path / "cells"))
    assert P.load_cells(spark, str(tmp_path / "cells")).count() == 3


def test_generators_and_figures(spark):
    c = P.clustered_points(spark, 700, seed=3)
    xy = np.array([(r.x, r.y) for r in c.orderBy("id").collect()])
    centre = np.repeat(np.array(P.CENTRES), 100, axis=0)
    assert len(xy) == 700
    assert np.abs(xy - centre).max() <= 5
    labels = C.variant_dbscan(c, [3.0], [4])
    boxes = S.cluster_boxes(labels, c)
    assert boxes.agg({"n": "sum"}).first()[0] == labels.filter("cluster > 0").count()
    ranks = S.density_ranks(boxes, 3.0).orderBy("density_rank").collect()
    assert [r.density for r in ranks] == sorted((r.density for r in ranks), reverse=True)
    assert P.random_points(spark, 50).filter("x < 0 OR x > 180 OR y < 0 OR y > 360").count() == 0
    assert N.estimated_from_larger(400, 1.0, 2.0) == 100


def test_components_of_hubs_and_groups(spark):
    """A component of 200,000 nodes with one hub, long paths, and the same numbers in two groups."""
    hub = spark.range(1, 200_001).select(F.lit(0).cast("int").alias("g"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
    path = spark.range(0, 3000).select(F.lit(1).cast("int").alias("g"), (F.col("id") * 7919 % 3001).alias("a"), ((F.col("id") + 1) * 7919 % 3001).alias("b"))
    alone = spark.createDataFrame([(2, 5, 5), (2, 9, 8), (2, 8, 9), (3, 2**53 + 1, 2**53)], "g int, a long, b long")
    got = connected_components(hub.unionByName(path).unionByName(alone).repartition(16), ("g",))
    sizes = {(r.g, r.component): r.n for r in got.groupBy("g", "component").agg(F.count("*").alias("n")).collect()}
    assert sizes == {(0, 0): 200_001, (1, 0): 3001, (2, 8): 2, (3, 2**53): 2}


def test_stars_deal_a_hubs_children_into_parts(spark, monkeypatch):
    from varigrid.plans import components

    monkeypatch.setattr(components, "HUB", 10)
    edges = spark.createDataFrame([(1000 + k, 50 + k % 2) for k in range(300)] + [(51, 50), (50, 3), (9000, 8000)], "a long, b long")
    comp = {r.node: r.component for r in connected_components(edges).collect()}
    assert comp == dict.fromkeys([*range(1000, 1300), 3, 50, 51], 3) | {9000: 8000, 8000: 8000}
    plan = components._stars(edges, [], 303)._jdf.queryExecution().toString()
    assert "part" in plan and "BroadcastHashJoin" in plan


def test_neighbour_tables_of_large_ids(spark):
    """Ids that a double can't tell apart."""
    big = 2**53
    df = spark.createDataFrame([(big, 0.0, 0.0), (big + 1, 0.1, 0.0), (big + 2, 9.0, 9.0), (-big - 1, 0.0, 0.1)], "id long, x double, y double")
    rows = C.dbscan_from_edges(df, N.eps_join(df, 0.5), 3).collect()
    assert sorted((r.id, r.cluster) for r in rows) == [(-big - 1, 1), (big, 1), (big + 1, 1), (big + 2, 0)]


def test_tables_made_on_the_way_are_removed(spark):
    """One clustering leaves one table, its labels; the shared folder is this machine's in tests."""
    from varigrid.plans.storage import discard, shared_dir

    points = P.as_points(spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in cloud(6).items()], "id long, x double, y double"))
    folder = Path(shared_dir(spark).removeprefix("file:"))
    for reuse in (False, True):
        before = set(folder.glob("varigrid-*"))
        labels = C.variant_dbscan(points, [0.5, 0.3, 0.4], [4, 6, 4], reuse=reuse)
        assert len(set(folder.glob("varigrid-*")) - before) == 1
        assert labels.count() == 270
        discard(labels)
        assert set(folder.glob("varigrid-*")) == before
    with pytest.raises(ValueError, match="stored"):
        discard(points)


def test_golden_labels(spark):
    """A file of known labels (FIXTURES.md, F-2), headerless x,y,cluster_0,cluster_1, is named by GOLDEN_LABELS."""
    if "GOLDEN_LABELS" not in os.environ:
        pytest.skip("GOLDEN_LABELS names no file")
    want = [tuple(map(float, r.split(","))) for r in Path(os.environ["GOLDEN_LABELS"]).read_text().split()]
    points = P.as_points(spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(want)], "id long, x double, y double"))
    rows = P.wide(C.variant_dbscan(points, [1.0, 0.5], [10, 12]), [0, 1]).collect()
    assert {r.id: (r.cluster_0, r.cluster_1) for r in rows} == {i: (int(r[2]), int(r[3])) for i, r in enumerate(want)}
    assert [sorted(collections.Counter(r[k] for r in rows).items()) for k in ("cluster_0", "cluster_1")] == [[(0, 22), (1, 98), (2, 105)], [(0, 59), (1, 87), (2, 70), (3, 9)]]


def test_range_queries_of_small_and_large_boxes(spark):
    r = random.Random(8)
    points = {i: (r.uniform(-50, 50), r.uniform(-50, 50)) for i in range(300)}
    boxes = [(k, *sorted((x, x + w))[:1], y, x + w, y + h) for k, (x, y, w, h) in enumerate([(0, 0, 0.01, 0.01), (-60, -60, 1e6, 1e6), (-3, 4, 20, 0.5), (10, 10, 0, 0), (-1e7, -1, 2e7, 2)])]
    df = spark.createDataFrame([(i, *p, i % 3) for i, p in points.items()], "id long, x double, y double, v int")
    b = spark.createDataFrame([tuple(map(float, x[1:])) for x in boxes], "xmin double, ymin double, xmax double, ymax double").withColumn("box_id", F.monotonically_increasing_id())
    b = spark.createDataFrame([(int(x[0]), *map(float, x[1:])) for x in boxes], "box_id long, xmin double, ymin double, xmax double, ymax double")
    want = {(k, i, i % 3) for k, x0, y0, x1, y1 in boxes for i, (x, y) in points.items() if x0 <= x <= x1 and y0 <= y <= y1}
    assert {(q.box_id, q.id) for q in N.range_query(df, b, 0.5).collect()} == {w[:2] for w in want}
    assert {(q.box_id, q.id) for q in N.range_query(df, b, 0.5, F.col("v") == 1).collect()} == {w[:2] for w in want if w[2] == 1}


def test_row_positions_over_several_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part-{k}.csv").write_text("".join(f"{k},{i}\n" for i in range(5 + 40 * k)))
    got = [tuple(r) for r in P.read_points_csv(spark, str(tmp_path)).orderBy("id").collect()]
    assert got == [(n, float(k), float(i)) for n, (k, i) in enumerate((k, i) for k in range(3) for i in range(5 + 40 * k))]


def test_one_place_of_many_copies_and_one_large_cluster(spark):
    """200,000 copies of one point and a cluster of 20,000 points in a row."""
    copies = spark.range(200_000).select("id", F.lit(1.0).alias("x"), F.lit(1.0).alias("y"))
    row = spark.range(200_000, 220_000).select("id", (F.col("id") / 10).alias("x"), F.lit(50.0).alias("y"))
    labels = C.variant_dbscan(copies.unionByName(row), [0.15, 0.05], [3, 2])
    got = {(r.variant_id, r.cluster): r.n for r in S.cluster_sizes(labels).collect()}
    # the row's first point is no core point and is scanned before its cluster
    assert got == {(0, 0): 1, (0, 1): 200_000, (0, 2): 19_999, (1, 0): 20_000, (1, 1): 200_000}
