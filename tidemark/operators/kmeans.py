"""K-means: runs of several numbers of clusters and starts advance together, a round being one pass over the points."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import distance
from ..runtime import staged

FEATURES = ("hotness", "loudness", "beat")
Center = tuple[float, float, float]


@dataclass
class Run:
    """A run: its number of clusters, its start, its centres by cluster number, and what the last round counted."""

    k: int
    initial: int
    centers: dict[int, Center]
    sizes: dict[int, int]
    rounds: int = 0
    done: bool = False


def seed_rows(rows: int, count: int = 300, step: int = 7919) -> list[int]:
    """Row numbers (from 1) for starts, spread by a rule over `rows` rows."""
    return [i * step % rows + 1 for i in range(count)]


def sampled_seeds(points: DataFrame, k: int, share: float = 0.005, seed: int = 1) -> dict[int, Center]:
    """The first k points, by id, of a sample of `share` of the rows; an error if it holds fewer. A row is drawn by the first 32 bits of the
    MD5 of `seed:id`, so the sample is the same wherever and whenever it is taken."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "id")), 1, 8), 16, 10).cast("bigint") < int(share * (1 << 32))
    found = points.filter(draw).orderBy("id", *FEATURES).limit(k).collect()
    if len(found) < k:
        raise ValueError(f"the sample has {len(found)} rows, {k} are needed")
    return {i + 1: tuple(r[f] for f in FEATURES) for i, r in enumerate(found)}  # type: ignore[misc]


def grid_of(parameters: DataFrame) -> list[tuple[int, int]]:
    """(k, initial) of each parameter line, without those that aren't two numbers: a line is a run, so they are few."""
    return sorted({(r.k, r.initial) for r in parameters.select("k", "initial").collect() if r.k is not None and r.initial is not None})


def seeds_at(numbered: DataFrame, rows: list[int]) -> dict[int, Center]:
    """Centres 1..k from the points at the given `row_no`."""
    at = {r.row_no: tuple(r[f] for f in FEATURES) for r in numbered.filter(F.col("row_no").isin(rows)).select("row_no", *FEATURES).collect()}
    return {i + 1: at[r] for i, r in enumerate(rows)}  # type: ignore[misc]


def nearest(centers: dict[int, Center]) -> Column:
    """Number of the nearest centre, the lowest among equals."""
    own = [F.col(f) for f in FEATURES]
    return F.array_min(F.array(*[F.struct(distance(own, [F.lit(float(x)) for x in c]).alias("d"), F.lit(n).alias("n")) for n, c in sorted(centers.items())]))["n"]


def assign(points: DataFrame, centers: dict[int, Center]) -> DataFrame:
    """`points` with the column cluster."""
    return points.withColumn("cluster", nearest(centers))


def update(assigned: DataFrame) -> DataFrame:
    """cluster, the mean of each feature, n."""
    return assigned.groupBy("cluster").agg(*[F.avg(f).alias(f) for f in FEATURES], F.count(F.lit(1)).alias("n"))


def _round(points: DataFrame, runs: list[Run], before: dict[tuple[int, int], dict[int, Center]]) -> tuple[dict, dict]:
    """New centres with sizes, and the points that changed their cluster since `before`, of each run: one scan, which the tasks end with
    one row per run and cluster."""
    plans = []
    for run in runs:
        old = before.get((run.k, run.initial))
        plans.append((sorted(run.centers), np.array([run.centers[c] for c in sorted(run.centers)]), sorted(old) if old else None, np.array([old[c] for c in sorted(old)]) if old else None))

    def closest(x: np.ndarray, names: list[int], centers: np.ndarray) -> np.ndarray:
        d = [np.sqrt((x[:, 0] - c[0]) ** 2 + (x[:, 1] - c[1]) ** 2 + (x[:, 2] - c[2]) ** 2) for c in centers]
        return np.array(names)[np.argmin(d, axis=0)]  # the first, hence lowest, among equals

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
            for i, (names, centers, old_names, old_centers) in enumerate(plans):
                now = closest(x, names, centers)
                moved = now != closest(x, old_names, old_centers) if old_names else np.ones(len(x), dtype=bool)
                for c in np.unique(now):
                    own = now == c
                    sums[i, int(c)] = sums.get((i, int(c)), np.zeros(5)) + np.array([*x[own].sum(axis=0), own.sum(), moved[own].sum()])
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([k[j] for k in sums], pa.int32()) for j in range(2)] + [pa.array([v[j] for v in sums.values()]) for j in range(5)], names=["run", "cluster", *"xyz", "n", "moved"])

    rows = points.select(*FEATURES).mapInArrow(partial, "run int, cluster int, x double, y double, z double, n double, moved double").groupBy("run", "cluster").agg(*[F.sum(c).alias(c) for c in (*"xyz", "n", "moved")]).collect()
    found: dict = {i: {} for i in range(len(runs))}
    moved = dict.fromkeys(range(len(runs)), 0)
    for r in rows:
        found[r.run][r.cluster] = ((r.x / r.n, r.y / r.n, r.z / r.n), int(r.n))
        moved[r.run] += int(r.moved)
    return found, moved


def _advance(points: DataFrame, runs: list[Run], rounds: int, finished) -> list[Run]:
    points = staged(points.select(*FEATURES), "points")
    before: dict[tuple[int, int], dict[int, Center]] = {}
    for _ in range(rounds):
        active = [r for r in runs if not r.done]
        if not active:
            break
        found, moved = _round(points, active, before)
        for i, run in enumerate(active):
            old = run.centers
            run.sizes = {c: n for c, (_, n) in found[i].items()}
            run.rounds += 1
            new = {c: center for c, (center, _) in found[i].items()}
            run.done = finished(old, new, moved[i], run.rounds)
            before[run.k, run.initial] = old
            run.centers = new
    if cut := [(r.k, r.initial) for r in runs if not r.done]:
        raise RuntimeError(f"runs (k, initial) {cut} didn't end within {rounds} rounds")
    return runs


def until_still(points: DataFrame, starts: dict[tuple[int, int], dict[int, Center]], rounds: int = 200) -> list[Run]:
    """Rounds until no point changes its cluster, for each start {(k, initial): centres}. A cluster without points is dropped. A run
    that needs more than `rounds` is an error.

    Sums of doubles depend on the order of rows in their last bits; points at equal distances may differ by that.
    """
    runs = [Run(k, initial, dict(c), {}) for (k, initial), c in sorted(starts.items())]
    return _advance(points, runs, rounds, lambda old, new, moved, n: n > 1 and moved == 0)


def until_close(points: DataFrame, starts: dict[tuple[int, int], dict[int, Center]], threshold: float = 1.0, rounds: int = 200) -> list[Run]:
    """Two rounds at least, then until each centre moved by `threshold` or less; a round in which a cluster lost its points isn't the last.
    A run that needs more than `rounds` is an error."""

    def close(old: dict[int, Center], new: dict[int, Center], _: int, n: int) -> bool:
        far = any(sum((a - b) ** 2 for a, b in zip(old[c], new[c])) ** 0.5 > threshold for c in new if c in old)
        return n > 1 and not far and set(old) == set(new)

    return _advance(points, [Run(k, initial, dict(c), {}) for (k, initial), c in sorted(starts.items())], rounds, close)


def centers_frame(points: DataFrame, runs: list[Run]) -> DataFrame:
    """k, initial, cluster, the features, n."""
    rows = [(r.k, r.initial, c, *center, r.sizes.get(c, 0)) for r in runs for c, center in sorted(r.centers.items())]
    return points.sparkSession.createDataFrame(rows, "k int, initial int, cluster int, hotness double, loudness double, beat double, n bigint")


def sizes_frame(points: DataFrame, runs: list[Run]) -> DataFrame:
    """k, initial, sizes: the members of each cluster by number, each followed by a blank."""
    rows = [(r.k, r.initial, "".join(f"{r.sizes[c]} " for c in sorted(r.sizes))) for r in runs]
    return points.sparkSession.createDataFrame(rows, "k int, initial int, sizes string")
