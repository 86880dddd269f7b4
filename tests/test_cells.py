"""Labels by cells: no table of pairs, the same labels as the plain scan's."""

import random
from pathlib import Path

import pytest

from tests.test_cluster import cloud, got, scan
from varigrid import queries
from varigrid.operators import cells, cluster, stats
from varigrid.operators import neighbors as N
from varigrid.plans.storage import shared_dir
from varigrid.sources import points as P


def test_no_table_holds_pairs(spark, monkeypatch):
    """2,000 different points in reach of each other: 4,000,000 pairs, and no table of more than a few rows a point."""
    r = random.Random(1)
    points = [(i, r.random(), r.random()) for i in range(2000)]
    for m in (cells, cluster):
        monkeypatch.setattr(m, "discard", lambda *tables: None)
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.glob("varigrid-*"))
    df = P.as_points(spark.createDataFrame(points, "id long, x double, y double"))
    labels = cluster.variant_dbscan(df, [2.0, 0.7, 0.01], [4, 4, 2])
    assert labels.filter("variant_id < 2 AND cluster <> 1").count() == 0
    made = set(folder.glob("varigrid-*")) - before
    assert made
    assert max(spark.read.parquet(str(p)).count() for p in made) <= 4 * 3 * 2000


@pytest.mark.parametrize("seed", [11, 12])
def test_levels_of_boxes_settle_as_points_do(spark, monkeypatch, seed):
    """No comparison of points before boxes are single points; long gaps that are a little wider or narrower than epsilon."""
    monkeypatch.setattr(cells, "DIRECT", 0)
    points = cloud(seed, 150, negative=seed == 12)
    n = len(points)
    for k in range(40):  # two rows at distance 0.41 and two at 0.4
        for row, (x, y) in enumerate([(20, 0.0), (20, 0.41), (40, 0.0), (40, 0.4)]):
            points[n + 4 * k + row] = (x + k / 16, y)
    variants = [(0.4, 4), (0.3, 3), (0.0, 2), (0.4, 2), (1.0, 30), (1.5, 5)]
    want = [scan(points, e, m) for e, m in variants]
    assert got(spark, points, variants) == want
    assert got(spark, points, variants, reuse=True) == want
    assert got(spark, points, variants[:1], border="textbook") == [scan(points, 0.4, 4, "textbook")]


def test_cells_too_many_for_double_precision(spark):
    points = {0: (0.0, 0.0), 1: (1e-5, 0.0), 2: (1e9, 0.0), 3: (1e9, 1e-5)}
    df = P.as_points(spark.createDataFrame([(i, *p) for i, p in points.items()], "id long, x double, y double"))
    assert cells.fits(df, [(0, 1e-5, 2)]) is None
    assert cells.fits(df, [(0, 2.0, 2), (1, 0.0, 2)]) == (0.0, 0.0)
    assert got(spark, points, [(2e-5, 2)]) == [scan(points, 2e-5, 2)]


@pytest.mark.parametrize("direct", [0, 10**6])
def test_frontier_without_pairs(spark, monkeypatch, direct):
    """The same points as all pairs give; copies of a place with one label and with two."""
    monkeypatch.setattr(cells, "DIRECT", direct)
    r = random.Random(4)
    points = [(i, r.randrange(60) / 10, r.randrange(40) / 10) for i in range(500)]
    df = P.as_points(spark.createDataFrame(points, "id long, x double, y double"))
    rows = [(v, i, r.choice((0, 1, 2)) if v else int(x > 3.1) + int(y > 3.9)) for v in (0, 1) for i, x, y in points]
    labels = spark.createDataFrame(rows, "variant_id int, id long, cluster int")
    for eps in (0.0, 0.35) if direct else (0.35,):
        near = {i: [j for j, u, w in points if ((x - u) ** 2 + (y - w) ** 2) ** 0.5 <= eps] for i, x, y in points}
        of = {(v, i): c for v, i, c in rows}
        want = {(v, c, i) for v, i, c in rows if c and any(of[v, j] != c for j in near[i])}
        assert sorted(map(tuple, stats.frontier(labels, df, eps).collect())) == sorted(want)
    if direct:
        monkeypatch.setattr(N, "eps_join", None)  # pairs aren't made
        assert stats.frontier(labels, df, 0.35).count() == len(want)


#: Queries whose labels are made without a join of points in reach.
NO_PAIRS = ["cluster_density_rank", "label_listing", "variant_summary", "dbscan_events", "array_labels", "labels_csv", "variant_dbscan_wide", "variant_dbscan_reuse"]


@pytest.mark.parametrize("name", NO_PAIRS)
def test_query_makes_no_pairs(spark, sf_dir, monkeypatch, name):
    monkeypatch.setattr(cluster, "eps_join", None)
    queries.QUERIES[name](spark, sf_dir).collect()
