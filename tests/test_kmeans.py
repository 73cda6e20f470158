import numpy as np
import pytest

from tidemark.operators import kmeans
from tidemark.sources import readers


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(3)
    return np.concatenate([rng.normal(c, 1.0, (60, 3)) for c in ((0, 0, 0), (8, 0, 0), (0, 9, 0), (4, 4, 9))])


def frame(spark, x):
    return spark.createDataFrame([(f"s{i:04d}", *map(float, p)) for i, p in enumerate(x)], "id string, hotness double, loudness double, beat double")


def lloyd(x, centers, still=True, threshold=1.0):
    names, old = sorted(centers), None
    centers = {c: np.array(v) for c, v in centers.items()}
    while True:
        names = sorted(centers)
        now = np.array(names)[np.argmin([np.sqrt(((x - centers[c]) ** 2).sum(1)) for c in names], axis=0)]
        new = {c: x[now == c].mean(0) for c in names if (now == c).any()}
        moved = max(np.linalg.norm(new[c] - centers[c]) for c in new)
        done = (old is not None and (now == old).all()) if still else (old is not None and moved <= threshold and len(new) == len(centers))
        old, centers = now, new
        if done:
            return centers, {c: int((now == c).sum()) for c in new}


def starts(x):
    return {(k, i): {n + 1: tuple(map(float, x[(i + n) * 37 % len(x)])) for n in range(k)} for k in (4, 5) for i in (0, 1)}


def test_fixpoint(spark, blobs):
    for run in kmeans.until_still(frame(spark, blobs), starts(blobs)):
        centers, sizes = lloyd(blobs, starts(blobs)[run.k, run.initial])
        assert run.sizes == sizes and sum(sizes.values()) == len(blobs)
        for c in centers:
            assert np.allclose(run.centers[c], centers[c])


def test_threshold(spark, blobs):
    for run in kmeans.until_close(frame(spark, blobs), starts(blobs), 0.5):
        centers, _ = lloyd(blobs, starts(blobs)[run.k, run.initial], False, 0.5)
        assert run.rounds >= 2
        for c in centers:
            assert np.allclose(run.centers[c], centers[c])


def test_ties_go_to_the_lowest_cluster(spark):
    df = kmeans.assign(frame(spark, [[0.0, 0.0, 0.0]]), {2: (1.0, 0.0, 0.0), 1: (-1.0, 0.0, 0.0)})
    assert df.first().cluster == 1


def test_cluster_without_points_is_dropped(spark, blobs):
    (run,) = kmeans.until_still(frame(spark, blobs), {(2, 0): {1: (0.0, 0.0, 0.0), 2: (1e6, 0.0, 0.0)}})
    assert run.sizes == {1: len(blobs)}


def test_sample_too_small(spark, blobs):
    with pytest.raises(ValueError):
        kmeans.sampled_seeds(frame(spark, blobs), 4, share=0.0)
    assert sorted(kmeans.sampled_seeds(frame(spark, blobs), 4, share=1.0)) == [1, 2, 3, 4]
    with pytest.raises(ValueError):  # the share of the query is too small for a small table
        kmeans.sampled_seeds(frame(spark, blobs).limit(100), 4)


def test_missing_features(spark):
    raw = spark.createDataFrame([("a", "", "1", "2"), ("b", "x", "1", None), ("c", "3", "1", "2")], "i string, h string, l string, b string")
    assert readers.points_of(raw, "i", "h", "l", "b").filter("hotness = 0").count() == 2
    assert readers.points_of(raw, "i", "h", "l", "b", missing_as_zero=False).count() == 1


@pytest.mark.parametrize("run", [kmeans.until_still, kmeans.until_close])
def test_a_run_that_is_cut_off_is_an_error(spark, blobs, run):
    with pytest.raises(RuntimeError, match="within 1 rounds"):
        run(frame(spark, blobs), starts(blobs), rounds=1)
