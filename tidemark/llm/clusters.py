"""Grouping records into similarity clusters: hierarchical density clustering over weighted cells."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import staged

#: A cell is halved in each feature until it has at most this part of the records that a core distance reaches, or a single place, whatever
#: the number of records; so there are at most some multiples of PARTS / neighbours_share cells.
PARTS = 32
#: Halvings of each feature at most, and those that all cells have; a place of all features has PLACE_BITS bits.
BITS, FIRST_BITS, PLACE_BITS = 20, 3, 62
#: Up to so many records that are still in cells to be halved are gathered with their places, which gives the same cells in one pass.
GATHERED = 262_144
#: Quantiles that stand for a feature's range; half the range is added on either side and what lies beyond is clipped to the edge.
LOW, HIGH = 0.005, 0.995
#: Cells of a block, whose distances to the cells of another block are computed at a time.
BLOCK = 256


def places(units: np.ndarray, bits: int) -> np.ndarray:
    """Places of rows (-0.5 to 1.5 in each feature) on a grid of `bits` halvings: the bits of the features in turn, so a cell of any
    number of halvings is a range of places."""
    at = np.clip(np.floor((units + 0.5) * (1 << (bits - 1))), 0, (1 << bits) - 1).astype(np.int64)
    out = np.zeros(len(at), dtype=np.int64)
    for bit in range(bits - 1, -1, -1):
        for f in range(at.shape[1]):
            out = (out << 1) | ((at[:, f] >> bit) & 1)
    return out


def cell_starts(place: np.ndarray, n: np.ndarray, halved: int, bits: int, features: int, most: int) -> list[np.ndarray]:
    """First places of the cells of `place`, from cells that are `halved` so often on: of at most `most` records, or a single place."""
    order = np.argsort(place)
    place, n = place[order], n[order]
    out = []
    while len(place):
        shift = (bits - halved) * features
        cell, at = np.unique(place >> shift, return_index=True)
        light = (np.add.reduceat(n, at) <= most) | (halved == bits)
        out.append(cell[light] << shift)
        rest = np.repeat(~light, np.diff(np.append(at, len(place))))
        place, n, halved = place[rest], n[rest], halved + 1
    return out


def grid_cells(counts: DataFrame, bits: int, features: int, most: int, gathered: int = GATHERED) -> np.ndarray:
    """First places of the cells of `counts` (place, n) in order, see `cell_starts`. A pass counts the records of the cells that were too
    large before, so what is gathered has a bound, as there are few of these."""
    spark = counts.sparkSession
    rest, left, halved, out = counts, counts.agg(F.sum("n")).first()[0], min(FIRST_BITS, bits), []
    while left > gathered:
        shift = (bits - halved) * features
        found = rest.groupBy(F.shiftright("place", shift).alias("cell")).agg(F.sum("n").alias("n")).toArrow()
        cell, n = found.column("cell").to_numpy(), found.column("n").to_numpy()
        light = (n <= most) | (halved == bits)
        out.append(cell[light] << shift)
        left, halved = n[~light].sum(), halved + 1
        if left:
            large = F.broadcast(spark.createDataFrame(pa.table({"_cell": cell[~light]})))
            rest = counts.join(large, F.shiftright("place", shift) == F.col("_cell"), "left_semi")
    if left:
        found = rest.select("place", "n").toArrow()
        out += cell_starts(found.column("place").to_numpy(), found.column("n").to_numpy(), halved, bits, features, most)
    return np.sort(np.concatenate(out))


@dataclass
class Hierarchy:
    """Selected clusters of cells: label of each cell (-1 noise), persistence of each cell in its cluster, stability of each label."""

    label: np.ndarray
    persistence: np.ndarray
    stability: np.ndarray


@dataclass
class Blocks:
    """Cells in an order in which neighbours are near each other, cut into blocks with their bounding boxes: the index for searches."""

    points: np.ndarray
    starts: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def rows(self, block: int) -> slice:
        return slice(int(self.starts[block]), int(self.starts[block + 1]))

    def bounds(self, block: int) -> np.ndarray:
        """Least distance of any cell of `block` to any of each block."""
        gap = np.maximum(np.maximum(self.low - self.high[block], self.low[block] - self.high), 0)
        return np.sqrt((gap**2).sum(axis=1))


def near_order(points: np.ndarray, most: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Order of points by halving at the median of the widest feature until at most `most` are together, and the starts of these blocks."""
    done: list[np.ndarray] = []
    stack = [np.arange(len(points))]
    while stack:
        own = stack.pop()
        if len(own) <= most:
            done.append(own)
            continue
        x = points[own]
        feature = int(np.argmax(x.max(axis=0) - x.min(axis=0)))
        half = len(own) // 2
        split = np.argpartition(x[:, feature], half)
        stack += [own[split[half:]], own[split[:half]]]
    return np.concatenate(done), np.concatenate([[0], np.cumsum([len(d) for d in done])])


def blocks_of(points: np.ndarray, starts: np.ndarray) -> Blocks:
    return Blocks(points, starts, np.minimum.reduceat(points, starts[:-1], axis=0), np.maximum.reduceat(points, starts[:-1], axis=0))


def _distances(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.sqrt(sum((own[:, f, None] - other[None, :, f]) ** 2 for f in range(own.shape[1])))


def core_distances(blocks: Blocks, weight: np.ndarray, block: int, neighbours: int, floor: float) -> np.ndarray:
    """Distance from each cell of `block` within which `neighbours` records lie, its own included; at least `floor`. Blocks are taken from
    the nearest on, until no further one can hold a nearer record."""
    own = blocks.points[blocks.rows(block)]
    bounds = blocks.bounds(block)
    order = np.argsort(bounds, kind="stable")
    d, w = np.zeros((len(own), 0)), np.zeros((len(own), 0))
    out = np.full(len(own), np.inf)
    for other in order:
        if bounds[other] >= out.max():
            break
        rows = blocks.rows(int(other))
        more = _distances(own, blocks.points[rows])
        near = np.flatnonzero((more < out[:, None]).any(axis=0))
        if not len(near):
            continue
        d = np.concatenate([d, more[:, near]], axis=1)
        w = np.concatenate([w, np.broadcast_to(weight[rows][near], (len(own), len(near)))], axis=1)
        at = np.argsort(d, axis=1, kind="stable")
        d, w = np.take_along_axis(d, at, 1), np.take_along_axis(w, at, 1)
        reached = np.cumsum(w, axis=1) >= neighbours
        if reached[:, -1].all():  # of all cells at once, as each saw the same weight; what lies further is of no use
            first = reached.argmax(axis=1)
            out = d[np.arange(len(d)), first]
            d, w = d[:, : first.max() + 1], w[:, : first.max() + 1]
    out = np.where(np.isfinite(out), out, d[:, -1])
    return np.maximum(out, floor)


def nearest_other(blocks: Blocks, core: np.ndarray, component: np.ndarray, block: int) -> list[tuple[int, float, int, int]]:
    """(component, mutual reachability distance, cell, other cell): for each component in `block` the nearest pair of one of its cells there
    with a cell of another component. Blocks are taken from the nearest on, until none can hold a nearer pair."""
    rows = blocks.rows(block)
    own, own_core = blocks.points[rows], core[rows]
    names, of = np.unique(component[rows], return_inverse=True)
    best, pair = np.full(len(names), np.inf), np.zeros((len(names), 2), dtype=np.int64)
    least = np.minimum.reduceat(core, blocks.starts[:-1])
    bounds = np.maximum(np.maximum(blocks.bounds(block), least), own_core.min())
    ends = np.minimum.reduceat(component, blocks.starts[:-1]), np.maximum.reduceat(component, blocks.starts[:-1])
    for other in np.argsort(bounds, kind="stable"):
        if bounds[other] >= best.max():
            break
        wanted = best[of] > bounds[other]
        if ends[0][other] == ends[1][other]:
            wanted &= names[of] != ends[0][other]
        active = np.flatnonzero(wanted)
        if not len(active):
            continue
        there = blocks.rows(int(other))
        d = _distances(own[active], blocks.points[there])
        np.maximum(d, core[there][None, :], out=d)
        np.maximum(d, own_core[active][:, None], out=d)
        d[names[of[active]][:, None] == component[there][None, :]] = np.inf
        to = d.argmin(axis=1)
        d = d[np.arange(len(d)), to]
        order = np.lexsort((d, of[active]))
        first = order[np.append(True, np.diff(of[active][order]) != 0)]
        better = first[d[first] < best[of[active][first]]]
        best[of[active][better]] = d[better]
        pair[of[active][better]] = np.column_stack([rows.start + active[better], there.start + to[better]])
    return [(int(c), float(x), int(a), int(b)) for c, x, (a, b) in zip(names, best, pair) if np.isfinite(x)]


def condensed(edges: list[tuple[float, int, int]], weight: np.ndarray, least: float) -> Hierarchy:
    """Clusters of the spanning tree `edges` (distance, a, b): condensed hierarchy and selection by stability (excess of mass).

    A split counts if both sides weigh at least `least`; smaller sides fall out of their cluster as noise. A cell's persistence is the
    inverse distance at which it leaves its selected cluster. The root is never selected, unless nothing splits.
    """
    n = len(weight)
    parent = list(range(n))
    node = list(range(n))  # node of the merge tree at the root of each set
    mass = list(map(float, weight))
    left, right, height = [-1] * n, [-1] * n, [0.0] * n

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for d, a, b in sorted(edges):
        ra, rb = find(a), find(b)
        left.append(node[ra])
        right.append(node[rb])
        height.append(d)
        mass.append(mass[node[ra]] + mass[node[rb]])
        parent[ra] = rb
        node[rb] = len(left) - 1
    top = len(left) - 1
    cluster_of, born, children, stability = {top: 0}, [0.0], [[]], [0.0]
    leaves_at: list[tuple[int, int, float]] = []  # (cell, cluster, inverse distance)

    def drop(at: int, cluster: int, inverse: float) -> None:
        stack = [at]
        while stack:
            x = stack.pop()
            if x < n:
                leaves_at.append((x, cluster, inverse))
                stability[cluster] += (inverse - born[cluster]) * mass[x]
            else:
                stack += [left[x], right[x]]

    walk = [top]
    while walk:
        at = walk.pop()
        cluster = cluster_of[at]
        if at < n:
            drop(at, cluster, born[cluster] if n > 1 else 1.0)
            continue
        inverse = 1.0 / max(height[at], 1e-12)
        large = [x for x in (left[at], right[at]) if mass[x] >= least]
        if len(large) == 2:
            for x in large:
                cluster_of[x] = len(born)
                children[cluster].append(len(born))
                stability[cluster] += (inverse - born[cluster]) * mass[x]
                born.append(inverse)
                children.append([])
                stability.append(0.0)
                walk.append(x)
        else:
            for x in (left[at], right[at]):
                if x in large and x >= n:
                    cluster_of[x] = cluster
                    walk.append(x)
                else:
                    drop(x, cluster, inverse)
    best = list(stability)
    chosen = [True] * len(born)
    for c in range(len(born) - 1, -1, -1):
        below = sum(best[k] for k in children[c])
        if children[c] and (below > best[c] or c == 0):
            chosen[c], best[c] = False, below
    selected: dict[int, int] = {}
    label_of = [-1] * len(born)
    above = [-1] * len(born)
    for c, kids in enumerate(children):
        for k in kids:
            above[k] = c
    for c in range(len(born)):  # a parent comes before its children
        up = above[c]
        if up >= 0 and label_of[up] >= 0:
            label_of[c] = label_of[up]
        elif chosen[c]:
            label_of[c] = selected.setdefault(c, len(selected))
    label, persistence = np.full(n, -1), np.zeros(n)
    for cell, c, inverse in leaves_at:
        label[cell], persistence[cell] = label_of[c], inverse
    return Hierarchy(label, persistence, np.array([stability[c] for c in selected]))


def spanning_tree(spark, blocks: Blocks, core: np.ndarray) -> list[tuple[float, int, int]]:
    """Minimum spanning tree of mutual reachability by rounds of Boruvka: in each, the tasks find the nearest pair of each component in their
    blocks, the nearest per component are kept and the components merged. At most one row per component is gathered."""
    n = len(blocks.points)
    component = np.arange(n)
    edges: list[tuple[float, int, int]] = []
    count = len(blocks.starts) - 1
    shared = spark.sparkContext.broadcast((blocks, core))  # cells are bounded
    while len(np.unique(component)) > 1:
        now = spark.sparkContext.broadcast(component.astype(np.int32))

        def nearest(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            index, cores = shared.value
            for batch in batches:
                found = [f for block in batch.column(0).to_pylist() for f in nearest_other(index, cores, now.value, block)]
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.float64(), pa.int64(), pa.int64()))], names=["component", "d", "a", "b"])

        at = spark.range(0, count, 1, min(count, 2 * spark.sparkContext.defaultParallelism))
        rows = at.mapInArrow(nearest, "component bigint, d double, a bigint, b bigint").groupBy("component").agg(F.min(F.struct("d", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).alias("e")).select("e.*").collect()
        parent = {int(c): int(c) for c in np.unique(component)}

        def find(x: int, parent: dict[int, int] = parent) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for d, a, b in sorted((r.d, r.a, r.b) for r in rows):
            ra, rb = find(int(component[a])), find(int(component[b]))
            if ra != rb:
                parent[ra] = rb
                edges.append((d, a, b))
        names = np.array(sorted(parent))
        roots = np.array([find(int(x)) for x in names])
        component = roots[np.searchsorted(names, component)]
        now.unpersist()
    return edges


def cluster(df: DataFrame, id_col: str, features: list[str], missing: float | None = 0.0, neighbours_share: float = 0.001, least_neighbours: int = 8, cluster_share: float = 0.02, parts: int = PARTS) -> DataFrame:
    """Cluster of each record: id, the features, cluster (0.., -1 for noise), nearest (its cluster, of noise that of the nearest member),
    persistence (of the record's cell in its cluster; 0 for noise).

    Each feature counts alike: it is scaled by its range between two quantiles. That space is halved in each feature into cells until a
    cell has at most a part, 1 / `parts`, of the records that a core distance reaches, or one record: the same rule for tables of any
    size, by shares of the records. Cells are weighted by their records and stand at their mean; two records of a cell aren't told apart.
    Where a core distance reaches fewer than 2 * `parts` records each record has a cell of its own, but for those that all but coincide. A cell's core distance
    reaches `neighbours_share` of all records (`least_neighbours` at least); the minimum spanning tree of mutual reachability over all cells
    is condensed with clusters of `cluster_share` of all records at least, and clusters are selected by stability.

    Records with a null id, or with a feature that is null, NaN, infinite or equal to `missing`, make no case. Rows of one id count
    once, with the smallest features. Other columns are ignored. Empty tables give no rows; a single cell is a single cluster.
    """
    spark = df.sparkSession
    known = [F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")) & (F.abs(F.col(f).cast("double")) != float("inf")) & (F.lit(True) if missing is None else F.col(f) != missing) for f in features]
    usable = df.filter(F.col(id_col).isNotNull())
    for k in known:
        usable = usable.filter(k)
    names = [f"f{i}" for i in range(len(features))]
    usable = usable.select(F.col(id_col).alias("id"), *[F.col(f).cast("double").alias(n) for f, n in zip(features, names)])
    records = staged(usable.groupBy("id").agg(F.min(F.struct(*names)).alias("f")).select("id", "f.*"), "points")
    spans = records.select(*[F.percentile_approx(n, [LOW, HIGH], 10_000).alias(n) for n in names]).first()
    out_names = [*features, "cluster", "nearest", "persistence"]
    if spans[0] is None:
        return records.select(F.col("id").alias(id_col), *[F.col(n).alias(f) for n, f in zip(names, features)], F.lit(0).alias("cluster"), F.lit(0).alias("nearest"), F.lit(0.0).alias("persistence"))
    low = [s[0] for s in spans]
    width = [(s[1] - s[0]) or 1.0 for s in spans]
    unit = [F.least(F.greatest((F.col(n) - F.lit(lo)) / F.lit(w), F.lit(-0.5)), F.lit(1.5)) for n, lo, w in zip(names, low, width)]
    scaled = records.select("id", *names, *[u.alias(f"u{i}") for i, u in enumerate(unit)])
    units = [f"u{i}" for i in range(len(names))]
    bits = min(BITS, PLACE_BITS // len(names))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.column_stack([batch.column(f"u{i}").to_numpy() for i in range(len(units))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places(own, bits))], names=[*batch.schema.names, "place"])

    at_places = scaled.select(*units).mapInArrow(placed, f"{', '.join(f'{u} double' for u in units)}, place bigint")
    counts = staged(at_places.groupBy("place").agg(F.count(F.lit(1)).alias("n"), *[F.sum(u).alias(u) for u in units]), "places")
    total = counts.agg(F.sum("n")).first()[0]
    neighbours, least = max(least_neighbours, int(np.ceil(total * neighbours_share))), max(2.0 * least_neighbours, total * cluster_share)
    cell = grid_cells(counts, bits, len(names), max(neighbours // parts, 1))
    cells_of = spark.sparkContext.broadcast(cell)

    def in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = np.searchsorted(cells_of.value, batch.column("place").to_numpy(), side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(i), *batch.columns[1:]], names=["cell", *batch.schema.names[1:]])

    held = counts.select("place", "n", *units).mapInArrow(in_cells, f"cell bigint, n bigint, {', '.join(f'{u} double' for u in units)}")
    found = held.groupBy("cell").agg(F.sum("n").alias("n"), *[F.round(F.sum(u) / F.sum("n"), 12).alias(u) for u in units]).orderBy("cell").toArrow()  # as many as cells
    weight = found.column("n").to_numpy().astype(np.float64)
    points = np.column_stack([found.column(u).to_numpy() for u in units])
    order, starts = near_order(points)
    cell, weight, blocks = cell[order], weight[order], blocks_of(points[order], starts)
    shared = spark.sparkContext.broadcast((blocks, weight))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, weights = shared.value
        for batch in batches:
            for block in batch.column(0).to_pylist():
                rows = index.rows(block)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows.start, rows.stop)), pa.array(core_distances(index, weights, block, neighbours, 2.0**-bits))], names=["at", "core"])

    count = len(starts) - 1
    reached = spark.range(0, count, 1, min(count, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(reach, "at bigint, core double").toArrow()  # one row per cell
    core = np.zeros(len(cell))
    core[reached.column("at").to_numpy()] = reached.column("core").to_numpy()
    tree = condensed(spanning_tree(spark, blocks, core), weight, least)
    if not (tree.label >= 0).any():
        tree.label[:] = 0
    nearest = tree.label.copy()
    homes = blocks.points[tree.label >= 0]
    for i in np.flatnonzero(tree.label < 0):
        nearest[i] = tree.label[tree.label >= 0][((homes - blocks.points[i]) ** 2).sum(axis=1).argmin()]
    by = np.argsort(cell)
    answer = spark.sparkContext.broadcast((cell[by], tree.label[by], nearest[by], np.where(tree.label >= 0, tree.persistence, 0.0)[by]))
    carried = ["id", *names]

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells_at, labels, nearests, persistences = answer.value
        for batch in batches:
            own = np.column_stack([batch.column(u).to_numpy() for u in units])
            i = np.searchsorted(cells_at, places(own, bits), side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], pa.array(labels[i].astype(np.int32)), pa.array(nearests[i].astype(np.int32)), pa.array(persistences[i])], names=[*carried, "cluster", "nearest", "persistence"])

    kind = records.schema["id"].dataType.simpleString()
    named = scaled.select(*carried, *units).mapInArrow(name, f"id {kind}, {', '.join(f'{n} double' for n in names)}, cluster int, nearest int, persistence double")
    return named.select(F.col("id").alias(id_col), *[F.col(n).alias(o) for n, o in zip([*names, "cluster", "nearest", "persistence"], out_names)])


def describe(clustered: DataFrame, id_col: str, features: list[str], typical: int = 5) -> DataFrame:
    """One row per cluster, and one for noise, -1, if there is any: cluster, size, the mean of each feature, close (noise records that are
    nearest to it) and `typical` ids.

    The typical ids are those of the most persistent members; among equals those nearest to the means, then the smallest id.
    """
    means = clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), *[F.avg(f).alias(f"avg_{f}") for f in features], *[F.stddev_pop(f).alias(f"_sd_{f}") for f in features])
    close = clustered.filter("cluster < 0").groupBy(F.col("nearest").alias("_near")).agg(F.count(F.lit(1)).alias("_close"))
    means = means.join(close, F.col("cluster") == F.col("_near"), "left").withColumn("close", F.coalesce("_close", F.lit(0))).drop("_near", "_close")
    means = staged(means, "means")  # one row per cluster, of which there are at most 1 / cluster_share
    near = sum((F.pow((F.col(f) - F.col(f"avg_{f}")) / F.when(F.col(f"_sd_{f}") > 0, F.col(f"_sd_{f}")).otherwise(1.0), 2) for f in features), F.lit(0.0))
    ranked = clustered.join(F.broadcast(means), "cluster").select("cluster", F.struct((-F.col("persistence")).alias("p"), near.alias("d"), F.col(id_col).alias("id")).alias("r"))
    best = ranked.mapInArrow(_best_of(typical), ranked.schema).groupBy("cluster").agg(F.slice(F.sort_array(F.collect_list("r")), 1, typical).alias("r"))
    return means.join(best, "cluster").select("cluster", "size", "close", *[F.round(f"avg_{f}", 6).alias(f"avg_{f}") for f in features], F.transform("r", lambda x: x["id"]).alias("typical"))


def _best_of(k: int):
    """The k first rows of each cluster in a task, so that few rows are brought together."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            kept = table if kept is None else pa.concat_tables([kept, table])
            flat = kept.flatten()
            order = np.array(flat.append_column("_at", pa.array(np.arange(len(flat)))).sort_by([("cluster", "ascending"), ("r.p", "ascending"), ("r.d", "ascending"), ("r.id", "ascending")]).column("_at"))
            own = kept.column("cluster").to_numpy()[order]
            start = np.append(True, np.diff(own) != 0)
            place = np.arange(len(own)) - np.maximum.accumulate(np.where(start, np.arange(len(own)), 0))
            kept = kept.take(pa.array(order[place < k]))
        if kept is not None:
            yield from kept.combine_chunks().to_batches()

    return best
