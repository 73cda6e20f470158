"""All similar pairs between set-valued records: pigeonhole partitioning of the token universe, exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import staged
from .kernels import mix64, runs, slices, within

#: Entries of the table of token frequencies, by hash; it steers which segments are probed and never what is found.
FREQUENCY_CELLS = 1 << 16
#: Most bits of the filter of tokens of the other table, whatever the tables' sizes.
FILTER_BITS = 1 << 27
#: Growth of the record sizes in a class.
CLASS_GROWTH = 1.2
#: Tables of up to this number of short rows are broadcast, beyond it shuffled: classes of copies, and candidates.
BROADCAST_ROWS = 200_000
SLICE_VALUES = 500_000


@dataclass(frozen=True)
class Shape:
    """How the universe is split: `each` segments for a token of a class's largest record, so a segment holds 1 / each of its tokens on
    average; and the `most` tokens of a segment whose deletions are indexed, records with a fuller one are hard."""

    each: float = 1.0
    most: int = 10


SHAPE = Shape()


def size_classes(most: int = 1 << 40) -> np.ndarray:
    """First size of each class; the last entry is above `most`."""
    bounds = [1]
    while bounds[-1] <= most:
        bounds.append(max(bounds[-1] + 1, int(bounds[-1] * CLASS_GROWTH)))
    return np.array(bounds, dtype=np.int64)


BOUNDS = size_classes()


def least_common(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Fewest values that sets of sizes a and b share if common / united reaches `threshold`."""
    return np.ceil(threshold / (1 + threshold) * (a + b) - 1e-9).astype(np.int64)


def _segments(record: np.ndarray, token: np.ndarray, size_class: np.ndarray, each: float):
    """Occurrences in order of their segment: (order, starts, tokens per segment, token hashes, key base).

    The universe of a class has `each` segments for each token of its largest record.
    """
    count = np.ceil((BOUNDS[size_class + 1] - 1) * each).astype(np.uint64)
    segment = (mix64(token, 3) % count).astype(np.int64)
    order = np.lexsort((segment, record))
    starts, sizes = runs(record[order], segment[order])
    return order, starts, sizes, mix64(token[order], 5), mix64(segment[order] * 1024 + size_class[order], 8)


def _key(total: np.ndarray, base: np.ndarray) -> np.ndarray:
    return mix64((mix64(total.view(np.int64), 11) ^ base).view(np.int64), 13).view(np.int64)


def _class_of(size: np.ndarray) -> np.ndarray:
    return np.searchsorted(BOUNDS, size, "right") - 1


def index_signatures(record: np.ndarray, token: np.ndarray, size: np.ndarray, shape: Shape = SHAPE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, key) for each segment of the record's class that holds tokens, with those of the segment less one token, and less more
    where it holds more than two; and the records with a segment of more than `shape.most` tokens, too full for that."""
    order, starts, sizes, hashed, base = _segments(record, token, _class_of(size)[record], shape.each)
    found = []
    for n in np.unique(sizes):
        if n > shape.most:
            continue
        at = starts[sizes == n]
        own = hashed[at[:, None] + np.arange(n)[None, :]]
        for subset in range(1, 1 << int(n)):
            part = [i for i in range(n) if subset >> i & 1]
            found.append((record[order][at], _key(own[:, part].sum(axis=1, dtype=np.uint64), base[at])))
    full = np.unique(record[order][starts[sizes > shape.most]])
    return *(np.concatenate([f[k] for f in found]) if found else np.zeros(0, dtype=np.int64) for k in range(2)), full


def probe_signatures(record: np.ndarray, token: np.ndarray, size: np.ndarray, threshold: float, frequency: np.ndarray | None, shape: Shape = SHAPE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, key) that find every similar record at least as large that isn't too full; and the records with too few segments.

    In each class that a partner may be in, at most M of the record's values are missing from the partner. A missing value spoils one
    segment; in each other one the partner holds the record's tokens, perhaps with more, and has indexed them. So of M + 1 segments
    one matches; those of the rarest tokens are probed.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    lacking: list[np.ndarray] = []
    first = _class_of(size)
    last = _class_of(np.floor(size / threshold + 1e-9).astype(np.int64))
    for step in range(int((last - first).max()) + 1 if len(size) else 0):
        pick = (first + step <= last)[record]
        rec, tok = record[pick], token[pick]
        if not len(rec):
            continue
        own = (first + step)[rec]
        order, starts, sizes, hashed, base = _segments(rec, tok, own, shape.each)
        of = rec[order][starts]
        least = np.maximum(BOUNDS[own[order][starts]], size[of])
        need = np.maximum(size[of] - least_common(size[of], least, threshold), 0) + 1
        cost = np.zeros(len(starts), dtype=np.int64)
        if frequency is not None:
            cost = np.minimum.reduceat(frequency[(mix64(tok[order], 21) % np.uint64(len(frequency))).astype(np.int64)], starts)
        rank_order = np.lexsort((-sizes, cost, of))
        _, per = runs(of)
        rank = np.empty(len(of), dtype=np.int64)
        rank[rank_order] = within(per)
        lacking.append(np.unique(of[np.repeat(per, per) < need]))
        probe = rank < need
        found.append((of[probe], _key(np.add.reduceat(hashed, starts)[probe], base[starts][probe])))
    return *(np.concatenate([f[k] for f in found]) if found else np.zeros(0, dtype=np.int64) for k in range(2)), np.unique(np.concatenate(lacking)) if lacking else np.zeros(0, dtype=np.int64)


def _bitmap(record: np.ndarray, token: np.ndarray, records: int) -> np.ndarray:
    """64 bits per record; sets differ at least in as many values as their bits."""
    out = np.zeros(records, dtype=np.uint64)
    np.bitwise_or.at(out, record, np.uint64(1) << (mix64(token, 9) % np.uint64(64)))
    return out.view(np.int64)


def _raw(df: DataFrame, id_col: str, values: str) -> DataFrame:
    """id and tokens: the values, or 64-bit hashes of values that aren't integers."""
    kind = df.schema[values].dataType.elementType.simpleString()
    tokens = F.col(values) if kind == "bigint" else F.transform(values, (lambda x: x.cast("bigint")) if kind in ("int", "smallint", "tinyint") else (lambda x: F.when(x.isNotNull(), F.xxhash64(x))))
    return df.select(F.col(id_col).cast("bigint").alias("id"), tokens.alias("tokens")).filter(F.col("id").isNotNull() & (F.size("tokens") > 0))


RECORD = "id bigint, h1 bigint, h2 bigint, n int, bits bigint, hard boolean, tokens array<bigint>"


def _records(raw: DataFrame, least: int, threshold: float, other: tuple | None = None, shape: Shape = SHAPE) -> DataFrame:
    """Records with distinct, sorted tokens, two hashes of them and `hard`, which marks those that segments don't suffice for.

    Left out are records below `least` values, and those of which less than `threshold` is in the filter of the `other` table.
    """

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, row, token in slices(batch.column(1), SLICE_VALUES):
                order = np.lexsort((token, row))
                once, _ = runs(row[order], token[order])
                row, token = row[order][once], token[order][once]
                size = np.bincount(row)
                good = size >= max(least, 1)
                if other is not None:
                    bits, whole = other[0], other[1].value
                    there = np.ones(len(token), dtype=bool)
                    for seed in (31, 32):
                        at = (mix64(token, seed) % np.uint64(bits)).astype(np.int64)
                        there &= (whole[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                    good &= np.bincount(row, there, len(size)) >= size * threshold - 1e-9
                kept = good[row]
                token, place = token[kept], np.cumsum(good) - 1
                row, who, size = place[row[kept]], np.flatnonzero(good), size[good]
                if not len(who):
                    continue
                starts = np.cumsum(size) - size
                h1, h2 = (np.add.reduceat(mix64(token, seed), starts).view(np.int64) for seed in (41, 42))
                hard = np.zeros(len(who), dtype=bool)
                hard[index_signatures(row, token, size, shape)[2]] = True
                hard[probe_signatures(row, token, size, threshold, None, shape)[2]] = True
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(token)).astype(np.int32)), pa.array(token))
                yield pa.RecordBatch.from_arrays([pa.array(ids[first + who]), pa.array(h1), pa.array(h2), pa.array(size.astype(np.int32)), pa.array(_bitmap(row, token, len(who))), pa.array(hard), lists], names=["id", "h1", "h2", "n", "bits", "hard", "tokens"])

    return raw.mapInArrow(normal, RECORD)


def _filter_of(records: DataFrame, values: int) -> tuple:
    """(bits, broadcast bytes) of a filter of the tokens that `records` have, two bits a token."""
    bits = min(FILTER_BITS, max(1 << 16, 1 << math.ceil(math.log2(max(values, 1) * 16))))
    parts = 64
    part_bytes = bits // 8 // parts

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bits, dtype=bool)
        for batch in batches:
            for _, _, token in slices(batch.column(0), SLICE_VALUES):
                for seed in (31, 32):
                    seen[(mix64(token, seed) % np.uint64(bits)).astype(np.int64)] = True
        if seen.any():
            packed = np.packbits(seen, bitorder="little")
            for i in range(parts):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([packed[i * part_bytes : (i + 1) * part_bytes].tobytes()], pa.binary())], names=["part", "bytes"])

    def united(group: pa.Table) -> pa.Table:
        out = np.zeros(part_bytes, dtype=np.uint8)
        for x in group.column("bytes").to_pylist():
            out |= np.frombuffer(x, dtype=np.uint8)
        return pa.table({"part": group.column("part").slice(0, 1), "bytes": pa.array([out.tobytes()], pa.binary())})

    rows = records.select("tokens").mapInArrow(local, "part int, bytes binary").groupBy("part").applyInArrow(united, "part int, bytes binary").collect()
    whole = np.zeros(bits // 8, dtype=np.uint8)
    for r in rows:  # 64 rows, `bits` bits together
        whole[r.part * part_bytes : (r.part + 1) * part_bytes] = np.frombuffer(bytes(r.bytes), dtype=np.uint8)
    return bits, records.sparkSession.sparkContext.broadcast(whole)  # at most FILTER_BITS / 8 bytes


def _frequencies(content: DataFrame) -> np.ndarray:
    """How many tokens fall into each cell of a table of fixed size."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(FREQUENCY_CELLS, dtype=np.int64)
        for batch in batches:
            for _, _, token in slices(batch.column(0), SLICE_VALUES):
                own += np.bincount((mix64(token, 21) % np.uint64(FREQUENCY_CELLS)).astype(np.int64), minlength=FREQUENCY_CELLS)
        used = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(own[used])], names=["cell", "n"])

    out = np.zeros(FREQUENCY_CELLS, dtype=np.int64)
    for r in content.select("tokens").mapInArrow(tally, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # FREQUENCY_CELLS rows at most
        out[r.cell] = r.n
    return out


def _signatures(content: DataFrame, probe: bool, threshold: float, frequency: np.ndarray, shape: Shape) -> DataFrame:
    """key, rec, side, n, bits for the index or the probes."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rec, side, n, bits = (batch.column(i).to_numpy() for i in range(4))
            for first, row, token in slices(batch.column(4), SLICE_VALUES):
                size = np.bincount(row)
                who, key, _ = probe_signatures(row, token, size, threshold, frequency, shape) if probe else index_signatures(row, token, size, shape)
                who = first + who
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(rec[who]), pa.array(side[who]), pa.array(n[who]), pa.array(bits[who])], names=["key", "rec", "side", "n", "bits"])

    return content.select("rec", "side", "n", "bits", "tokens").mapInArrow(sign, "key bigint, rec bigint, side int, n int, bits bigint")


def _by_rarest(content: DataFrame, threshold: float, frequency: np.ndarray) -> DataFrame:
    """Candidates of the hard records with all others: of a hard record's values at most n - ceil(threshold * n) are missing from a
    similar one, so one of so many and one more of its rarest is there."""

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rec, side, n, bits = (batch.column(i).to_numpy() for i in range(4))
            for first, row, token in slices(batch.column(4), SLICE_VALUES):
                cost = frequency[(mix64(token, 21) % np.uint64(len(frequency))).astype(np.int64)]
                order = np.lexsort((token, cost, row))
                _, size = runs(row[order])
                need = size - np.ceil(size * threshold - 1e-9).astype(np.int64) + 1
                at = order[within(size) < np.repeat(need, size)]
                who = first + row[at]
                yield pa.RecordBatch.from_arrays([pa.array(token[at]), pa.array(rec[who]), pa.array(side[who]), pa.array(n[who]), pa.array(bits[who])], names=["key", "rec", "side", "n", "bits"])

    return content.filter("hard").select("rec", "side", "n", "bits", "tokens").mapInArrow(rarest, "key bigint, rec bigint, side int, n int, bits bigint")


@dataclass
class Joined:
    """Classes of records of equal values: `members` (side, h1, h2, n, id), `links` between similar classes (the keys of the first with a,
    of the second with b, similarity), `copied` the keys of classes of several rows, None if there are none."""

    members: DataFrame
    links: DataFrame
    copied: DataFrame | None


KEYS = ["side", "h1", "h2", "n"]


def join_classes(left: DataFrame, left_id: str, left_values: str, right: DataFrame | None = None, right_id: str = "", right_values: str = "", threshold: float = 0.6, least: int = 1, shape: Shape = SHAPE) -> Joined:
    """Similar classes of records, see `similar_pairs`. Within one table a link is there once, its classes in any order."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    if right is None:
        rows = _records(_raw(left, left_id, left_values), least, threshold, None, shape).withColumn("side", F.lit(0))
    else:
        raw = [_raw(left, left_id, left_values), _raw(right, right_id, right_values)]
        n = [r.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0] for r in raw]
        few, many = (0, 1) if n[0] <= n[1] else (1, 0)
        large = staged(_records(raw[many], least, threshold, _filter_of(raw[few], n[few]), shape).withColumn("side", F.lit(many)), "large")
        rest = large.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        rows = large.unionByName(_records(raw[few], least, threshold, _filter_of(large, rest), shape).withColumn("side", F.lit(few)))
    rows = staged(rows.withColumn("rec", F.monotonically_increasing_id()), "records")  # rec is fixed by staging
    several = staged(rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1").select(*KEYS), "copied")
    copied = several.count()
    content = rows
    if copied:
        listed = F.broadcast(several) if copied <= BROADCAST_ROWS else several
        content = rows.join(listed, KEYS, "left_anti").unionByName(staged(rows.join(listed, KEYS, "left_semi").dropDuplicates(KEYS).select(*rows.columns), "classes"))
    content = content.drop("id")
    frequency = _frequencies(content)
    index, probes = _signatures(content, False, threshold, frequency, shape), _signatures(content, True, threshold, frequency, shape)
    named = lambda df, x: df.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("rec", "side", "n", "bits")])
    cross = (F.col("side_a") != F.col("side_b")) if right is not None else (F.col("rec_a") != F.col("rec_b"))
    budget = F.floor((F.col("n_a") + F.col("n_b")) * F.lit((1 - threshold) / (1 + threshold)) + 1e-9)
    near = cross & (F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b"))) <= budget) & (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(threshold) - 1e-9)
    found = named(probes, "a").join(named(index, "b"), "key").filter(near & (F.col("n_a") <= F.col("n_b")))
    pair = (F.when(F.col("side_a") <= F.col("side_b"), F.col("rec_a")).otherwise(F.col("rec_b")), F.when(F.col("side_a") <= F.col("side_b"), F.col("rec_b")).otherwise(F.col("rec_a"))) if right is not None else (F.least("rec_a", "rec_b"), F.greatest("rec_a", "rec_b"))
    pairs = found.select(pair[0].alias("ra"), pair[1].alias("rb"))
    if content.filter("hard").take(1):
        every = content.select(F.explode("tokens").alias("key"), "rec", "side", "n", "bits")
        pairs = pairs.unionByName(named(_by_rarest(content, threshold, frequency), "a").join(named(every, "b"), "key").filter(near).select(pair[0].alias("ra"), pair[1].alias("rb")))
    pairs = staged(pairs.distinct(), "candidates")
    needed = content
    if pairs.count() <= BROADCAST_ROWS:
        named_in = pairs.select(F.col("ra").alias("rec")).unionByName(pairs.select(F.col("rb").alias("rec"))).distinct()
        needed = content.join(F.broadcast(named_in), "rec", "left_semi")  # at most twice BROADCAST_ROWS
    own_side = lambda x, s: needed.filter(F.col("side") == s).select(F.col("rec").alias(f"r{x}"), *[F.col(k).alias(f"{k}_{x}") for k in KEYS], F.col("tokens").alias(f"t{x}"))
    last = 0 if right is None else 1
    checked = pairs.join(own_side("a", 0), "ra").join(own_side("b", last), "rb").withColumn("_c", F.size(F.array_intersect("ta", "tb")))
    checked = checked.withColumn("similarity", F.col("_c") / (F.col("n_a") + F.col("n_b") - F.col("_c"))).filter(F.col("similarity") >= threshold)
    links = checked.select(*[f"{k}_{x}" for x in "ab" for k in KEYS], "similarity")
    return Joined(rows.select(*KEYS, "id").distinct(), staged(links, "links"), listed if copied else None)


def similar_pairs(left: DataFrame, left_id: str, left_values: str, right: DataFrame | None = None, right_id: str = "", right_values: str = "", threshold: float = 0.6, least: int = 1, shape: Shape = SHAPE) -> DataFrame:
    """Pairs of records whose distinct values overlap with common / united >= `threshold`, within `left` or between two tables.

    Columns: id_a, id_b, similarity. Within one table id_a < id_b; between two id_a is of `left` and id_b of `right`. Records of fewer
    than `least` distinct values make no case, nor do null ids, null or empty arrays; null values are ignored. Rows of one id with the
    same values are one record; rows of one id with different values are each compared, and a pair counts once. Other columns are
    ignored, empty tables give no rows. No pair is lost or capped, each is verified on its values; values that aren't integers are
    compared by 64-bit hashes.

    Records of the same values are one class; classes are joined and expanded to their members at the end. Of two tables, records
    that can't reach the threshold because too few of their values occur in the other are left out first, by a filter of bounded
    size. The universe of values is hashed into segments, whose number depends on the size class; the smaller record of a pair probes
    the segments of its rarest values in the larger's class, which has indexed its segments, whole and with tokens deleted, see
    `probe_signatures`. Records that this can't suffice for (more than `shape.most` tokens in one segment, or too few segments) are joined by
    their rarest values instead.
    """
    joined = join_classes(left, left_id, left_values, right, right_id, right_values, threshold, least, shape)
    own = lambda x: joined.members.select(*[F.col(k).alias(f"{k}_{x}") for k in KEYS], F.col("id").alias(f"id_{x}"))
    between = joined.links.join(own("a"), [f"{k}_a" for k in KEYS]).join(own("b"), [f"{k}_b" for k in KEYS])
    out = between.select("id_a", "id_b", "similarity")
    if right is None:
        out = out.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "similarity").filter("id_a < id_b")
        if joined.copied is not None:
            copies = joined.members.join(joined.copied, KEYS, "left_semi")
            twins = copies.withColumnRenamed("id", "id_a").join(copies.withColumnRenamed("id", "id_b"), KEYS).filter("id_a < id_b")
            out = out.unionByName(twins.select("id_a", "id_b", F.lit(1.0).alias("similarity")))
    return out.groupBy("id_a", "id_b").agg(F.max("similarity").alias("similarity"))


def record_links(left: DataFrame, left_id: str, left_values: str, right: DataFrame | None = None, right_id: str = "", right_values: str = "", threshold: float = 0.6, least: int = 1, linked_only: bool = False) -> DataFrame:
    """One row per record: side (0 of `left`, 1 of `right`), id, class_id, copies, links. With `linked_only`, a record that the filter
    between two tables left out, having no similar one, has no row; for callers that drop records without links anyway.

    class_id is the smallest id of the records of the same table with the same values, copies their number (1 without another), links
    the number of similar records: of the other table, or of the same one without itself. Copies aren't expanded into pairs, so a
    group of them costs no more than its rows. An id that comes with different values has a row for each. See `similar_pairs`.
    """
    joined = join_classes(left, left_id, left_values, right, right_id, right_values, threshold, least)
    members = joined.members
    if right is not None and not linked_only:
        every = [_records(_raw(*x), least, threshold).select(F.lit(side).alias("side"), *KEYS[1:], "id") for side, x in enumerate(((left, left_id, left_values), (right, right_id, right_values)))]
        members = staged(every[0].unionByName(every[1]).distinct(), "members")
    sizes = members.groupBy(*KEYS).agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    keys_of = lambda x: [F.col(f"{k}_{x}").alias(k) for k in KEYS]
    other = lambda x: [F.col(f"{k}_{x}").alias(f"{k}_o") for k in KEYS]
    both = joined.links.select(*keys_of("a"), *other("b")).unionByName(joined.links.select(*keys_of("b"), *other("a")))
    theirs = sizes.select(*[F.col(k).alias(f"{k}_o") for k in KEYS], F.col("copies").alias("_theirs"))
    counted = both.join(theirs, [f"{k}_o" for k in KEYS]).groupBy(*KEYS).agg(F.sum("_theirs").alias("_links"))
    own = F.col("copies") - 1 if right is None else F.lit(0)
    classes = sizes.join(counted, KEYS, "left").withColumn("links", F.coalesce("_links", F.lit(0)) + own)
    return members.join(classes, KEYS).select("side", "id", "class_id", "copies", F.col("links").cast("bigint").alias("links"))
