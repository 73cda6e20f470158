from collections import Counter

import numpy as np
import pandas as pd
import pytest

from tidemark.llm import clusters

F3 = ["artist_hotness", "loudness", "beat"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "song_id string, artist_hotness double, loudness double, beat double, cluster string, cell int")


def blobs(seed, sizes, centers, spread=0.02):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, spread, (n, 3)) for n, c in zip(sizes, centers)])
    x = np.abs(x) * [1, -50, 200] + [0.001, -0.001, 0.001]
    return x, np.repeat(np.arange(len(sizes)), sizes)


CENTERS = [(0.2, 0.2, 0.2), (0.8, 0.2, 0.3), (0.2, 0.8, 0.7), (0.7, 0.7, 0.8), (0.8, 0.8, 0.2)]


@pytest.mark.parametrize("sizes", [(200, 200, 200, 200), (600, 100, 80, 300, 150), (3000, 150, 150, 150)])
def test_blobs_are_found(spark, sizes):
    x, truth = blobs(len(sizes), sizes, CENTERS)
    rng = np.random.default_rng(9)
    noise = rng.random((15, 3)) * [1, -50, 200] + [0.001, -0.001, 0.001]
    rows = [(f"s{i}", *map(float, p), "clash", 1) for i, p in enumerate(np.concatenate([x, noise]))]
    rows += rows[:20] + [("null", None, -1.0, 1.0, "x", 1), ("nan", 0.5, float("nan"), 1.0, "x", 1), ("zero", 0.0, -3.0, 1.0, "x", 1), (None, 0.1, -1.0, 1.0, "x", 1)]
    found = clusters.cluster(frame(spark, rows), "song_id", F3)
    rows = {r.song_id: r for r in found.collect()}
    label = {i: r.nearest for i, r in rows.items()}
    assert all(r.nearest == r.cluster or r.cluster == -1 and r.persistence == 0 for r in rows.values())
    assert set(label) == {f"s{i}" for i in range(len(x) + 15)}
    own = np.array([label[f"s{i}"] for i in range(len(x))])
    pairs = {(t, c): int(((truth == t) & (own == c)).sum()) for t in range(len(sizes)) for c in set(own)}
    assert len(set(own)) == len(sizes)
    for t, n in enumerate(sizes):
        assert max(pairs[t, c] for c in set(own)) >= 0.99 * n
    described = clusters.describe(found, "song_id", F3).collect()
    assert sum(r["size"] for r in described) == len(x) + 15
    for r in described:
        if r.cluster >= 0:
            assert len(r.typical) == 5 and all(rows[s].cluster == r.cluster for s in r.typical)
            mine = [i for i in range(len(x)) if own[i] == r.cluster]
            assert abs(r.avg_beat - x[mine, 2].mean()) < 5
    assert sum(r.close for r in described if r.cluster >= 0) == sum(r["size"] for r in described if r.cluster < 0)


def indexed(points, most):
    order, starts = clusters.near_order(points, most)
    assert sorted(order) == list(range(len(points))) and np.diff(starts).max() <= most
    return order, clusters.blocks_of(points[order], starts)


@pytest.mark.parametrize("most", [7, 64, 1000])
def test_spanning_tree_is_minimal(spark, most):
    rng = np.random.default_rng(0)
    order, blocks = indexed(np.concatenate([rng.random((200, 3)), rng.normal(0.5, 0.01, (100, 3))]), most)
    core, points = rng.random(300) * 0.2, blocks.points
    edges = clusters.spanning_tree(spark, blocks, core)
    d = np.maximum(np.maximum(np.sqrt(((points[:, None] - points[None]) ** 2).sum(2)), core[:, None]), core[None])
    inside, weight, best = np.zeros(300, dtype=bool), 0.0, np.full(300, np.inf)
    best[0] = 0
    for _ in range(300):
        i = int(np.where(inside, np.inf, best).argmin())
        inside[i], weight = True, weight + best[i]
        best = np.minimum(best, d[i])
    assert len(edges) == 299 and abs(sum(e[0] for e in edges) - weight) < 1e-9


@pytest.mark.parametrize("most", [3, 20, 400])
def test_core_distances(most):
    rng = np.random.default_rng(1)
    order, blocks = indexed(rng.random((150, 2)), most)
    weight = rng.integers(1, 4, 150).astype(float)
    for neighbours in (1, 5, 40, 10_000):
        found = np.concatenate([clusters.core_distances(blocks, weight, k, neighbours, 0.01) for k in range(len(blocks.starts) - 1)])
        for i, p in enumerate(blocks.points):
            d = np.sqrt(((blocks.points - p) ** 2).sum(axis=1))
            at = np.argsort(d)
            upto = np.cumsum(weight[at]) >= neighbours
            assert abs(found[i] - max(0.01, d[at][upto.argmax() if upto.any() else -1])) < 1e-12


def test_clusters_nearer_than_a_coarse_cell(spark):
    """Two dense clusters at a fiftieth of the features' range from each other, which the coarsest grid may put into one cell."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0.30, 0.0015, (300, 3)), rng.normal(0.32, 0.0015, (300, 3)), rng.normal(0.9, 0.02, (300, 3)), rng.random((10, 3))]) + 0.1
    rows = [(f"s{i}", *map(float, p), "x", 1) for i, p in enumerate(x)]
    label = {r.song_id: r.cluster for r in clusters.cluster(frame(spark, rows), "song_id", F3).collect()}
    found = [{label[f"s{i}"] for i in range(lo, lo + 300)} - {-1} for lo in (0, 300, 600)]
    assert all(len(f) == 1 for f in found) and len(set.union(*found)) == 3


def test_near_clusters_among_many_records(spark):
    """Two clusters nearer than a fortieth of the range, among as many records as fill a grid of such cells: how fine cells are doesn't depend on the number of records."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0.310, 0.0006, (9000, 3)), rng.normal(0.318, 0.0006, (9000, 3)), rng.random((82_000, 3))]) + 0.1
    rows = spark.createDataFrame(pd.DataFrame(x, columns=F3).assign(song_id=np.arange(len(x)).astype(str)))
    label = {r.song_id: r.cluster for r in clusters.cluster(rows, "song_id", F3).select("song_id", "cluster").collect()}
    found = [Counter(label[str(i)] for i in range(lo, lo + 9000)).most_common(1)[0] for lo in (0, 9000)]
    assert found[0][0] != found[1][0] and min(f[0] for f in found) >= 0 and min(f[1] for f in found) > 8900


@pytest.mark.parametrize("most", [1, 3, 40])
def test_cells_hold_a_bounded_number_of_records(spark, most):
    rng = np.random.default_rng(most)
    place = np.unique(clusters.places(np.concatenate([rng.random((500, 3)), rng.normal(0.5, 0.001, (500, 3))]), 20))
    n = rng.integers(1, 4, len(place))
    counts = spark.createDataFrame(pd.DataFrame({"place": place, "n": n}))
    starts = clusters.grid_cells(counts, 20, 3, most)
    assert (starts == clusters.grid_cells(counts, 20, 3, most, gathered=0)).all()
    held = np.bincount(np.searchsorted(starts, place, side="right") - 1, n, len(starts))
    alone = np.bincount(np.searchsorted(starts, place, side="right") - 1, minlength=len(starts)) == 1
    assert ((held > 0) & ((held <= most) | alone)).all()


def test_ties_single_and_empty(spark):
    same = clusters.cluster(frame(spark, [(f"s{i}", 0.5, -5.0, 100.0, "x", 1) for i in range(30)]), "song_id", F3)
    assert {(r.cluster, r.nearest) for r in same.collect()} == {(0, 0)} and same.count() == 30
    one = clusters.cluster(frame(spark, [("a", 0.5, -5.0, 100.0, "x", 1)]), "song_id", F3)
    assert one.count() == 1
    none = clusters.cluster(frame(spark, [("a", None, -5.0, 100.0, "x", 1)]), "song_id", F3)
    assert none.count() == 0 and clusters.describe(none, "song_id", F3).count() == 0
