"""Overlap sizes between many sets: a blocked product of the incidence matrix with itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.itemsets import numbered
from ..runtime import parallelism, staged
from .kernels import mix64, runs, slices, within

#: Incidences of a block of identifiers, which one task multiplies.
BLOCK_VALUES = 1_000_000
#: Sets of a tile of sets. Beyond it, blocks are also split by pairs of such tiles, so an identifier that is in every set is spread.
TILE_SETS = 4_000_000
#: An identifier in more sets than this is hot: its pairs are not emitted but counted for candidates, or by dense tiles.
HOT_DEGREE = 256
#: Most sets of a dense tile of hot identifiers, and its incidences, which make it smaller where sets are large.
DENSE_SETS = 2048
DENSE_VALUES = 10_000_000


def _clean(sets: DataFrame, set_id: str, ids: str) -> DataFrame:
    kept = sets.select(F.col(set_id).cast("bigint").alias("set_id"), F.array_distinct(F.array_compact(ids)).alias("ids"))
    kept = kept.filter(F.col("set_id").isNotNull() & (F.size("ids") > 0))
    kind = kept.schema["ids"].dataType.elementType.simpleString()
    return kept if kind == "bigint" else kept.withColumn("ids", F.transform("ids", (lambda x: x.cast("bigint")) if kind in ("int", "smallint", "tinyint") else (lambda x: F.xxhash64(x))))


def set_sizes(clean: DataFrame) -> DataFrame:
    """set_id and its number of distinct identifiers; rows of one set are united."""
    per = clean.groupBy("set_id").agg(F.max(F.size("ids")).alias("n"), F.count(F.lit(1)).alias("_rows"))
    several = per.filter("_rows > 1").select("set_id")
    united = clean.join(several, "set_id", "left_semi").select("set_id", F.explode("ids").alias("id")).distinct().groupBy("set_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return per.filter("_rows = 1").select("set_id", "n").unionByName(united)


def incidence_blocks(clean: DataFrame, blocks: int, tiles: int) -> DataFrame:
    """The incidence matrix cut into blocks: rows (block, tile_a, tile_b, sets, ids), the latter two packed as 64-bit integers.

    An identifier's incidences are all in one block. With several tiles of sets, an incidence goes to every pair of tiles that has
    its own.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            for first, row, ids in slices(batch.column(1), 4 * BLOCK_VALUES):
                sets = own[first + row]
                tile = (mix64(sets, 7) % np.uint64(tiles)).astype(np.int64) if tiles > 1 else np.zeros(len(sets), dtype=np.int64)
                block = (mix64(ids) % np.uint64(blocks)).astype(np.int64)
                out = {k: [] for k in ("block", "tile_a", "tile_b", "sets", "ids")}
                for other in range(tiles):
                    lo, hi = np.minimum(tile, other), np.maximum(tile, other)
                    order = np.lexsort((ids, hi, lo, block))
                    starts, lengths = runs(block[order], lo[order], hi[order])
                    for s, n in zip(starts, lengths):
                        at = order[s : s + n]
                        for k, v in zip(out, (int(block[at[0]]), int(lo[at[0]]), int(hi[at[0]]), sets[at].tobytes(), ids[at].tobytes())):
                            out[k].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in zip(out, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=list(out))

    return clean.mapInArrow(cut, "block int, tile_a int, tile_b int, sets binary, ids binary")


def tile_products(sets: np.ndarray, degree: np.ndarray, width: int, batch: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Co-occurrences (a, b, n) with a < b of `sets`, which lists for each identifier in turn the `degree` sets that have it.

    Identifiers are put into tiles whose degrees add up to at most `width`, so a tile has at most `width` columns; each tile is
    written as a 0/1 matrix and multiplied, transposed, by itself.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    ends = np.cumsum(degree)
    tile = (ends - 1) // width  # may exceed the width by less than one identifier's degree
    tile_of, id_of = np.repeat(tile, degree), np.repeat(np.arange(len(degree)), degree)
    starts, lengths = runs(tile_of)
    ids_first = id_of[starts] if len(starts) else starts
    for lo in range(0, len(starts), batch):
        hi = min(lo + batch, len(starts))
        span = slice(starts[lo], starts[hi - 1] + lengths[hi - 1])
        which = np.repeat(np.arange(hi - lo), lengths[lo:hi])
        value, row = sets[span], id_of[span] - ids_first[lo + which]
        order = np.lexsort((value, which))
        new, n = runs(which[order], value[order])
        column = np.empty(len(order), dtype=np.int64)
        per_tile = which[order][new]
        _, columns = runs(per_tile)
        column[order] = np.repeat(within(columns), n)
        names = np.zeros((hi - lo, int(columns.max())), dtype=np.int64)
        names[per_tile, within(columns)] = value[order][new]
        matrix = np.zeros((hi - lo, int(row.max()) + 1, int(columns.max())), dtype=np.float32)
        matrix[which, row, column] = 1
        product = np.matmul(matrix.transpose(0, 2, 1), matrix)
        product *= np.triu(np.ones(product.shape[1:], dtype=np.float32), 1)
        t, i, j = np.nonzero(product)
        found.append((names[t, i], names[t, j], product[t, i, j].astype(np.int64)))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, dtype=np.int64) for k in range(3))  # type: ignore[return-value]


def _multiply(sets: np.ndarray, ids: np.ndarray, hot_degree: int, known: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """(set_a, set_b, n) of a block, and (set, id) of its hot identifiers: those of too high a degree, or `known` if given."""
    order = np.lexsort((sets, ids))
    sets, ids = sets[order], ids[order]
    once, _ = runs(ids, sets)
    sets, ids = sets[once], ids[once]
    starts, degree = runs(ids)
    each = np.repeat(degree, degree)
    hot = each > hot_degree if known is None else np.isin(ids, known)
    light = (each > 1) & ~hot
    degree = degree[(degree > 1) & ~hot[starts]]
    names, local = np.unique(sets[light], return_inverse=True)
    found = []
    for least, most, width, batch in ((2, 32, 64, 256), (33, hot_degree + 1, 512, 8)):
        pick = (degree >= least) & (degree <= most)
        if not pick.any():
            continue
        own, own_degree = local[np.repeat(pick, degree)], degree[pick]
        at = np.cumsum(own_degree) - own_degree
        # identifiers of the same sets come together, so that a tile adds them up
        by = np.lexsort((own[at + own_degree - 1], own[at + 1], own[at]))
        own = own[np.repeat(at[by], own_degree[by]) + within(own_degree[by])]
        found.append(tile_products(own, own_degree[by], width, batch))
    a, b, n = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, dtype=np.int64) for k in range(3))
    code, back = np.unique(a * max(len(names), 1) + b, return_inverse=True)
    n = np.bincount(back, n, len(code)).astype(np.int64)
    a, b = names[code // max(len(names), 1)], names[code % max(len(names), 1)]
    hot_sets, hot_ids = sets[hot], ids[hot]
    return a, b, n, hot_sets, hot_ids


def hot_identifiers(blocks: DataFrame, hot_degree: int, tiles: int) -> DataFrame:
    """block, id of the identifiers that more than hot_degree / tiles sets of one tile have; all of more than `hot_degree` sets are there.

    Only needed with several tiles of sets, where no task sees all sets of an identifier.
    """

    def count(group: pa.Table) -> pa.Table:
        sets, ids = (np.concatenate([np.frombuffer(x, dtype=np.int64) for x in group.column(c).to_pylist()]) for c in ("sets", "ids"))
        order = np.lexsort((sets, ids))
        once, _ = runs(ids[order], sets[order])
        ids = ids[order][once]
        starts, degree = runs(ids)
        found = ids[starts[degree > hot_degree // tiles]]
        return pa.table({"block": pa.array([group.column("block")[0].as_py()] * len(found), pa.int32()), "id": pa.array(found)})

    return blocks.filter("tile_a = tile_b").groupBy("block", "tile_a").applyInArrow(count, "block int, id bigint").distinct()


def block_products(blocks: DataFrame, hot_degree: int = HOT_DEGREE, tiles: int = 1) -> DataFrame:
    """Partial co-occurrences (a, b, n) of each block with a < b; and rows (a set, b hot identifier, n 0)."""
    if tiles > 1:
        blocks = staged(blocks, "blocks")
        hot = hot_identifiers(blocks, hot_degree, tiles)
        pairs = [F.struct(F.lit(x).alias("tile_a"), F.lit(y).alias("tile_b")) for x in range(tiles) for y in range(x, tiles)]
        # a hot identifier goes along with each pair of tiles, marked by a null set
        marks = hot.select("block", F.explode(F.array(*pairs)).alias("t"), "id").groupBy("block", "t").agg(F.collect_list("id").alias("hot")).select("block", "t.tile_a", "t.tile_b", "hot")
        blocks = blocks.withColumn("hot", F.lit(None).cast("array<bigint>")).unionByName(marks.withColumns({"sets": F.lit(None).cast("binary"), "ids": F.lit(None).cast("binary")}))
    else:
        blocks = blocks.withColumn("hot", F.lit(None).cast("array<bigint>"))

    def multiply(key: tuple, group: pa.Table) -> pa.Table:
        tile_a, tile_b = key[1].as_py(), key[2].as_py()
        sets, ids = (np.concatenate([np.zeros(0, dtype=np.int64), *[np.frombuffer(x, dtype=np.int64) for x in group.column(c).to_pylist() if x is not None]]) for c in ("sets", "ids"))
        known = np.array([x for hot in group.column("hot").to_pylist() if hot for x in hot], dtype=np.int64) if tiles > 1 else None
        a, b, n, hot_sets, hot_ids = _multiply(sets, ids, hot_degree, known)
        if tiles > 1:
            ta, tb = ((mix64(x, 7) % np.uint64(tiles)).astype(np.int64) for x in (a, b))
            own = (np.minimum(ta, tb) == tile_a) & (np.maximum(ta, tb) == tile_b)
            a, b, n = a[own], b[own], n[own]
        return pa.table({"a": np.concatenate([a, hot_sets]), "b": np.concatenate([b, hot_ids]), "n": np.concatenate([n, np.zeros(len(hot_sets), dtype=np.int64)])})

    return blocks.groupBy("block", "tile_a", "tile_b").applyInArrow(multiply, "a bigint, b bigint, n bigint")


def _held(hot: DataFrame, sizes: DataFrame) -> tuple[DataFrame, int]:
    """set_id, n, h (its hot identifiers) and these as `ids`, for sets that have any; and the sets of a dense tile."""
    held = staged(sizes.join(hot.groupBy("set_id").agg(F.collect_list("id").alias("ids"), F.count(F.lit(1)).cast("int").alias("h")), "set_id"), "held")
    sets, values = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("h"), F.lit(0))).first()
    return held, max(16, min(DENSE_SETS, DENSE_VALUES * sets // max(values, 1)))


def _product(left: np.ndarray, right: np.ndarray, sets: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Common identifiers of the sets at `left` with those at `right`: 0/1 tiles of 4,096 identifiers, multiplied and added up."""
    used = np.unique(np.concatenate([left, right]))
    _, row, ids = next(slices(lists.take(pa.array(used)), 1 << 62))
    _, column = np.unique(ids, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(left), len(right)), dtype=np.float32)
    own, other = np.searchsorted(used, left), np.searchsorted(used, right)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        part = slice(*np.searchsorted(column, [lo, lo + 4096]))
        tile = np.zeros((len(used), 4096), dtype=np.float32)
        tile[row[part], column[part] - lo] = 1
        total += tile[own] @ tile[other].T
    return total


def _hot_counts(pairs: DataFrame, held: DataFrame, tile_sets: int) -> DataFrame:
    """a, b, n: the hot identifiers that the sets of each pair share, where there are any.

    Sets are hashed to tiles; a pair of tiles has the sets that pairs name there, writes their hot columns as 0/1 tiles, multiplies these
    and reads the pairs' entries from the product. A set goes to at most as many pairs of tiles as it has pairs.
    """
    tiles = -(-held.count() // tile_sets)
    of = lambda x: F.pmod(F.xxhash64(x), F.lit(max(tiles, 1))).cast("int")
    keyed = pairs.select("a", "b", of("a").alias("ta"), of("b").alias("tb"))
    names = lambda x: keyed.select(F.col("ta").alias("xa"), F.col("tb").alias("xb"), F.col(x).alias("set_id"))
    named = names("a").unionByName(names("b")).distinct().join(held.select("set_id", "ids"), "set_id").select("xa", "xb", "set_id", "ids")

    def count(wanted: pa.Table, rows: pa.Table) -> pa.Table:
        a, b, sets = wanted.column("a").to_numpy(), wanted.column("b").to_numpy(), rows.column("set_id").to_numpy()
        order = np.argsort(sets)
        at = [order[np.searchsorted(sets[order], x)] for x in (a, b)]
        (left, i), (right, j) = (np.unique(x, return_inverse=True) for x in at)
        n = _product(left, right, sets, rows.column("ids").combine_chunks())[i, j].astype(np.int64)
        return pa.table({"a": a[n > 0], "b": b[n > 0], "n": n[n > 0]})

    return keyed.groupBy("ta", "tb").cogroup(named.groupBy("xa", "xb")).applyInArrow(count, "a bigint, b bigint, n bigint")


def _dense_pairs(held: DataFrame, share: float, tile_sets: int) -> DataFrame:
    """Pairs that reach `share` by hot identifiers alone, from dense tiles of sets; rows a, b, n.

    The smaller set of such a pair consists of hot identifiers to that share. Those sets are put into tiles by their size, all sets into
    tiles by their hot identifiers; two tiles meet only if some set of the second has as many of these as the smallest of the first needs.
    """
    mostly = numbered(held.filter(F.col("h") >= F.col("n") * share), ["n", "set_id"], "_row", 0).withColumn("ta", F.floor(F.col("_row") / tile_sets).cast("int"))
    every = numbered(held, ["h", "set_id"], "_row", 0).withColumn("tb", F.floor(F.col("_row") / tile_sets).cast("int"))
    mostly, every = (staged(x.select("set_id", "n", "ids", t), "tiles") for x, t in ((mostly, "ta"), (every, "tb")))
    least = mostly.groupBy("ta").agg(F.min("n").alias("_least"))
    most = every.groupBy("tb").agg(F.max(F.size("ids")).alias("_most"))
    meet = staged(least.join(most, F.col("_most") >= F.col("_least") * share).select("ta", "tb"), "meet")
    small = mostly.join(meet, "ta").select("set_id", "n", "ids", F.lit(True).alias("small"), "ta", "tb")
    rows = small.unionByName(every.join(meet, "tb").select("set_id", "n", "ids", F.lit(False).alias("small"), "ta", "tb"))

    def product(group: pa.Table) -> pa.Table:
        sets, n, small = (group.column(c).to_numpy() for c in ("set_id", "n", "small"))
        left, right = np.flatnonzero(small), np.flatnonzero(~small)
        total = _product(left, right, sets, group.column("ids").combine_chunks())
        i, j = np.nonzero((total >= share * np.minimum(n[left][:, None], n[right][None, :])) & (total > 0) & (sets[left][:, None] != sets[right][None, :]))
        a, b = sets[left][i], sets[right][j]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "n": total[i, j].astype(np.int64)})

    return rows.groupBy("ta", "tb").applyInArrow(product, "a bigint, b bigint, n bigint").distinct()


def set_overlaps(sets: DataFrame, set_id: str = "set_id", ids: str = "users", min_share: float = 0.5, hot_degree: int = HOT_DEGREE, block_values: int = BLOCK_VALUES, tile_sets: int = TILE_SETS) -> DataFrame:
    """Pairs of sets that share at least `min_share` (above 0) of the distinct identifiers of the smaller one.

    `sets` has an integer `set_id` and an array of identifiers. Columns: set_a < set_b, shared, size_a, size_b; counts are exact and
    no shared list is built. Rows of one set are united; null or empty sets, null identifiers and null set ids make no case; other
    columns are ignored; no sets, no rows.

    Identifiers are hashed into blocks; a task encodes its block as 0/1 tiles, multiplies each transposed tile by itself and adds up
    the products; blocks are then summed. An identifier that only one set has can't count and is left out. Hot identifiers (in more
    than `hot_degree` sets) would give a number of pairs that grows with the square of their sets: pairs that share another identifier
    and could still reach the share have theirs counted by products of tiles of just these sets, see `_hot_counts`; pairs that reach it
    by hot identifiers alone need a set that consists of them to that share, see `_dense_pairs`.
    """
    if not 0 < min_share <= 1:
        raise ValueError("min_share must be above 0 and at most 1")
    clean = _clean(sets, set_id, ids)
    rows, values = clean.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
    tiles = max(1, -(-rows // tile_sets))
    blocks = max(min(parallelism(sets.sparkSession), 64), -(-values * tiles // block_values))
    cut = incidence_blocks(clean, blocks, tiles).repartition(max(blocks, 1), "block", "tile_a", "tile_b")
    parts = staged(block_products(cut, hot_degree, tiles), "products")
    sizes = staged(set_sizes(clean), "sizes")
    light = parts.filter("n > 0").groupBy("a", "b").agg(F.sum("n").alias("n"))
    hot = parts.filter("n = 0").select(F.col("a").alias("set_id"), F.col("b").alias("id")).distinct()
    side = lambda x: sizes.select(F.col("set_id").alias(x), F.col("n").alias(f"size_{x}"))
    least = F.least("size_a", "size_b") * F.lit(min_share)
    named = ["set_a", "set_b", "shared", "size_a", "size_b"]
    shown = lambda pairs, n: pairs.withColumn("shared", n.cast("bigint")).filter(F.col("shared") >= least).select(F.col("a").alias("set_a"), F.col("b").alias("set_b"), *named[2:])
    if not hot.take(1):
        return shown(light.join(side("a"), "a").join(side("b"), "b"), F.col("n"))
    held, tile_sets = _held(hot, sizes)
    own = sizes.join(held.select("set_id", "h"), "set_id", "left")
    side = lambda x: own.select(F.col("set_id").alias(x), F.col("n").alias(f"size_{x}"), F.coalesce("h", F.lit(0)).alias(f"h_{x}"))
    more = F.least("h_a", "h_b")
    pairs = staged(light.join(side("a"), "a").join(side("b"), "b").filter(F.col("n") + more >= least).withColumn("more", more), "pairs")
    counts = _hot_counts(pairs.filter("more > 0"), held, tile_sets).withColumnRenamed("n", "both")
    out = staged(shown(pairs.join(counts, ["a", "b"], "left"), F.col("n") + F.coalesce("both", F.lit(0))), "overlaps")
    dense = _dense_pairs(held, min_share, tile_sets).select(F.col("a").alias("set_a"), F.col("b").alias("set_b"), F.col("n").alias("shared")).join(out.select("set_a", "set_b"), ["set_a", "set_b"], "left_anti")
    a, b = (sizes.select(F.col("set_id").alias(f"set_{x}"), F.col("n").alias(f"size_{x}")) for x in "ab")
    return out.unionByName(dense.join(a, "set_a").join(b, "set_b").select(*named))
