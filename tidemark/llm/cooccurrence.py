"""Items that appear together: a pair table that is kept up to date by signed deltas of changed baskets."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.itemsets import numbered
from ..runtime import parallelism, staged
from .kernels import mix64, runs, within

#: Items of a basket that one task pairs; larger baskets are cut into chunks and each pair of chunks is a group of its own.
BASKET_ITEMS = 2048
#: Pairs that are generated, or gathered, before they are added up.
PAIRS_AT_ONCE = 1_000_000
GATHERED = 4_000_000
#: Rows of baskets that go to one group, and pairs that go to one bucket.
GROUP_ROWS = 1_000_000
BUCKET_PAIRS = 2_000_000
#: Segments of a table before they are compacted; they are earlier if those after the first hold more pairs than it.
SEGMENTS = 8

_SEGMENT = "bucket int, n bigint, packed binary"
_BASKETS = -1  # bucket of the number of baskets; those of the items' counts are below it


def pack(ordered: np.ndarray, *others: np.ndarray) -> bytes:
    """Integers as bytes: the first column, ascending, by its steps, all by byte planes, compressed."""
    columns = [np.diff(ordered, prepend=np.int64(0)), *[(x << 1) ^ (x >> 63) for x in others]]
    planes = np.concatenate([np.ascontiguousarray(x, dtype=np.int64).view(np.uint8).reshape(-1, 8).T.ravel() for x in columns])
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(packed: bytes, n: int, columns: int) -> list[np.ndarray]:
    """The columns that `pack` was given."""
    planes = np.frombuffer(pa.decompress(packed, n * 8 * columns, codec="zstd", asbytes=True), dtype=np.uint8).reshape(columns, 8, n)
    first, *others = (np.ascontiguousarray(p.T).view(np.int64).ravel() for p in planes)
    return [np.cumsum(first), *[(x >> 1 & ((1 << 63) - 1)) ^ -(x & 1) for x in others]]


def _added(keys: list[np.ndarray], deltas: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their deltas where these aren't 0."""
    key, delta = np.concatenate([np.zeros(0, dtype=np.int64), *keys]), np.concatenate([np.zeros(0, dtype=np.int64), *deltas])
    order = np.argsort(key, kind="stable")
    first, _ = runs(key[order])
    total = np.add.reduceat(delta[order], first) if len(first) else delta
    return key[order][first][total != 0], total[total != 0]


def _by_bucket(key: np.ndarray, delta: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Rows of a segment; `key` is ascending."""
    order = np.argsort(bucket, kind="stable")
    for s, n in zip(*runs(bucket[order])):
        at = order[s : s + n]
        yield int(bucket[at[0]]), int(n), pack(key[at], delta[at])


def _pair_bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(key >> 10) % np.uint64(buckets)).astype(np.int64)  # neighbours share a bucket, so that steps are small


def _segment_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], names=["bucket", "n", "packed"])


def _pair_deltas(group: np.ndarray, chunk: np.ndarray, item: np.ndarray, was: np.ndarray, now: np.ndarray, crossed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pair, delta) of groups that are contiguous and ascending in their items; in crossed groups only items of different chunks are
    paired. A pair is a * 2^31 + b, a < b."""
    starts, lengths = runs(group)
    later = lengths.repeat(lengths) - within(lengths) - 1  # items after each one in its group
    total = np.cumsum(later)
    lo = 0
    while lo < len(item):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS_AT_ONCE, "right")))
        i = np.repeat(np.arange(lo, hi), later[lo:hi])
        j = i + 1 + within(later[lo:hi])
        if crossed.any():
            kept = ~crossed[i] | (chunk[i] != chunk[j])
            i, j = i[kept], j[kept]
        sign = (now[i] & now[j]).astype(np.int64) - (was[i] & was[j])
        i, j, sign = i[sign != 0], j[sign != 0], sign[sign != 0]
        yield (item[i] << 31) + item[j], sign
        lo = hi


def _paired(held: list[np.ndarray], large: bool, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """Rows of a segment from the rows (basket, code) of whole baskets, or (basket, place, code) of whole pairs of chunks."""
    order = np.lexsort(held[::-1])
    held = [x[order] for x in held]
    once, _ = runs(*held)
    held = [x[once] for x in held]
    basket, code = held[0], held[-1]
    item, was, now = code >> 2, (code & 1).astype(bool), (code & 2).astype(bool)
    place = held[1] if large else np.zeros(len(basket), dtype=np.int64)
    x, y, chunks = place >> 42, place >> 21 & 0x1FFFFF, (place & 0x1FFFFF) + 1
    chunk = (mix64(item, 3) % chunks.astype(np.uint64)).astype(np.int64)
    starts, lengths = runs(basket, place)
    delta = now.astype(np.int64) - was
    own = x == y  # an item of a large basket counts in the group of its own chunk
    key, total = _added([item[own]], [delta[own]])
    if len(key):
        yield from _by_bucket(key, total, _BASKETS - 1 - _pair_bucket(key, buckets))
    if not large and len(starts):
        ever = lambda state: np.maximum.reduceat(state.astype(np.int64), starts).sum()
        yield _BASKETS, 1, pack(np.array([ever(now) - ever(was)]))
    keys: list[np.ndarray] = []
    deltas: list[np.ndarray] = []
    for pair, sign in _pair_deltas(np.repeat(np.arange(len(starts)), lengths), chunk, item, was, now, x != y):
        keys.append(pair)
        deltas.append(sign)
        if sum(map(len, keys)) >= GATHERED:
            key, total = _added(keys, deltas)
            yield from _by_bucket(key, total, _pair_bucket(key, buckets))
            keys, deltas = [], []
    key, total = _added(keys, deltas)
    yield from _by_bucket(key, total, _pair_bucket(key, buckets))


def _packed_rows(rows: DataFrame, columns: list[str], groups: int) -> DataFrame:
    """`rows` of integer columns as (part, n, packed), so that little is shuffled. Rows that agree in all columns but the last share a part."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            held = [np.concatenate([b.column(i).to_numpy() for b in kept]) for i in range(len(columns))]
            part = mix64(held[0])
            for x in held[1:-1]:
                part = mix64((part ^ mix64(x, 1)).view(np.int64), 2)
            part = (part % np.uint64(groups)).astype(np.int64)
            order = np.lexsort((held[0], part))
            out = [(int(part[order[s]]), int(n), pack(*[x[order[s : s + n]] for x in held])) for s, n in zip(*runs(part[order]))]
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], names=["part", "n", "packed"])

        for batch in batches:
            if len(batch):
                kept.append(batch)
            if sum(map(len, kept)) >= GROUP_ROWS:
                yield flush()
                kept = []
        if kept:
            yield flush()

    return rows.select(*columns).mapInArrow(cut, "part int, n bigint, packed binary")


def _merge(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys and sums of one bucket's rows, added up in turn."""
    keys: list[np.ndarray] = []
    deltas: list[np.ndarray] = []
    for n, packed in zip(group.column("n").to_pylist(), group.column("packed").to_pylist()):
        key, delta = unpack(packed, n, 2)
        keys.append(key)
        deltas.append(delta)
        if sum(map(len, keys[1:])) >= GATHERED:
            key, delta = _added(keys, deltas)
            keys, deltas = [key], [delta]
    return _added(keys, deltas)


def _merged(rows: DataFrame) -> DataFrame:
    """One row for each bucket of `rows`."""

    def merge(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        if bucket == _BASKETS:
            total = sum(int(unpack(x, 1, 1)[0][0]) for x in group.column("packed").to_pylist())
            return pa.Table.from_batches([_segment_batch([(bucket, 1, pack(np.array([total])))])])
        key, delta = _merge(group)
        return pa.Table.from_batches([_segment_batch([(bucket, len(key), pack(key, delta))] if len(key) else [])])

    return rows.groupBy("bucket").applyInArrow(merge, _SEGMENT)


class PairTable:
    """Persistent counts of pairs and items below a folder, in hash buckets.

    `apply` appends a segment of signed deltas: a packed row for each bucket of pairs, and of items, that the batch touches; nothing that
    is there is rewritten, so a batch costs what it changes. Readers add up the segments of a bucket. When segments become many, or hold
    more than the first one, they are compacted to one, with more buckets if these have grown. The manifest is written last, so a batch
    that fails leaves the table as it was. Items have dense ids from an append-only dictionary. Files of earlier versions stay.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.buckets = buckets
        self.version, self.baskets, self.next_id = 0, 0, 0
        self.segments: list[tuple[int, int]] = []  # version and pairs of each
        self.named: list[int] = []  # versions that brought new items
        self.last = 0  # segment of the last batch
        jvm = spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest")
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(root):
            self.version = max(int(x.getPath().getName()) for x in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS")))
            kept = json.loads(spark.read.text(f"{self.folder}/manifest/{self.version}").first()[0])
            self.buckets, self.baskets, self.next_id, self.named, self.last = (kept[k] for k in ("buckets", "baskets", "next_id", "named", "last"))
            self.segments = [tuple(x) for x in kept["segments"]]

    def _segments(self, versions: list[int]) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], _SEGMENT)
        return self.spark.read.schema(_SEGMENT).parquet(*[f"{self.folder}/segments/{v}" for v in versions])

    def _counts(self, versions: list[int], of_pairs: bool, least: int | None) -> DataFrame:
        """key, n of the buckets of pairs or items, added up over segments; of n >= `least` only, if given."""
        rows = self._segments(versions).filter(F.col("bucket") >= 0 if of_pairs else F.col("bucket") < _BASKETS)

        def shown(key: np.ndarray, n: np.ndarray) -> list[pa.Array]:
            kept = n >= least if least is not None else np.ones(len(n), dtype=bool)
            return [pa.array(key[kept]), pa.array(n[kept])]

        def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n, packed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    yield pa.RecordBatch.from_arrays(shown(*unpack(packed, n, 2)), names=["key", "n"])

        if len(versions) <= 1:  # a segment has one row for a bucket
            return rows.mapInArrow(single, "key bigint, n bigint")
        return rows.groupBy("bucket").applyInArrow(lambda group: pa.Table.from_arrays(shown(*_merge(group)), names=["key", "n"]), "key bigint, n bigint")

    def dictionary(self) -> DataFrame:
        """item and its id."""
        if not self.named:
            return self.spark.createDataFrame([], "item string, id bigint")
        return self.spark.read.schema("item string, id bigint").parquet(*[f"{self.folder}/items/{v}" for v in self.named])

    def items(self) -> DataFrame:
        """item, id, n (baskets that have it)."""
        return self.dictionary().join(self._counts([v for v, _ in self.segments], False, None).withColumnRenamed("key", "id"), "id").select("item", "id", "n")

    def _pairs(self, least: int) -> DataFrame:
        found = self._counts([v for v, _ in self.segments], True, least)
        return found.select(F.shiftright("key", 31).alias("a"), F.col("key").bitwiseAND(F.lit((1 << 31) - 1)).alias("b"), F.col("n").alias("n_ab"))

    def apply(self, changes: DataFrame, stage: bool = True) -> PairTable:
        """Add a batch: rows basket, item, was, now for all items, old and new, of each changed basket.

        A basket that is new has `was` false throughout, one that is dropped has `now` false throughout. Repeated rows count once. Rows
        with a null basket or item are ignored. Only pairs whose state changes give deltas. `changes` is read three times; it is staged
        before unless `stage` is false. Baskets that aren't integers are told apart by 64-bit hashes.
        """
        integers = dict(changes.dtypes)["basket"] in ("bigint", "int", "smallint", "tinyint")
        basket = F.col("basket").cast("bigint") if integers else F.xxhash64("basket")
        rows = changes.filter("basket is not null and item is not null").select(basket.alias("basket"), F.col("item").cast("string").alias("item"), "was", "now")
        rows = staged(rows, "changes") if stage else rows
        version = self.version + 1
        new = rows.select("item").distinct().join(self.dictionary(), "item", "left_anti")
        numbered(new, ["item"], "id", self.next_id).select("item", "id").write.mode("overwrite").parquet(f"{self.folder}/items/{version}")
        brought = self.spark.read.parquet(f"{self.folder}/items/{version}").count()
        self.named, self.next_id = [*self.named, version] if brought else self.named, self.next_id + brought
        if self.next_id >= 1 << 31:
            raise ValueError("a pair table holds 2^31 items at most")

        per = rows.groupBy("basket").agg(F.count(F.lit(1)).alias("n"))
        n_rows, increments, most = per.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2), F.lit(0.0)), F.coalesce(F.max("n"), F.lit(0))).first()
        self.buckets = self.buckets or 1 << max(3, int(np.ceil(np.log2(max(increments, 1) / BUCKET_PAIRS))))
        groups = max(parallelism(self.spark), -(-n_rows // GROUP_ROWS)) * 4
        state = F.col("was").cast("int") + F.col("now").cast("int") * 2
        coded = rows.join(self.dictionary(), "item").select("basket", (F.col("id") * 4 + state).alias("code"))
        dropped = 0
        if most > BASKET_ITEMS:
            large = staged(per.filter(F.col("n") > BASKET_ITEMS).select(F.col("basket").alias("_basket"), F.ceil(F.col("n") / BASKET_ITEMS).cast("bigint").alias("chunks")), "large")
            parts = self._partial(coded.join(large, F.col("basket") == F.col("_basket"), "left_anti"), groups, False)
            parts = parts.unionByName(self._partial(_chunked(coded.join(large, F.col("basket") == F.col("_basket"))), groups, True))
            dropped = rows.join(large, F.col("basket") == F.col("_basket"), "left_semi").groupBy("basket").agg((F.max("now").cast("int") - F.max("was").cast("int")).alias("d")).agg(F.coalesce(F.sum("d"), F.lit(0))).first()[0]
        else:
            parts = self._partial(coded, groups, False)
        _merged(parts).write.mode("overwrite").parquet(f"{self.folder}/segments/{version}")
        written = self._segments([version])
        pairs = written.filter("bucket >= 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        self.baskets += dropped + sum(int(unpack(bytes(r.packed), 1, 1)[0][0]) for r in written.filter(F.col("bucket") == _BASKETS).collect())  # one row
        self.segments, self.last = [*self.segments, (version, pairs)], version
        if len(self.segments) > SEGMENTS or sum(n for _, n in self.segments[1:]) > self.segments[0][1]:
            self.compact(version)
        manifest = json.dumps({"buckets": self.buckets, "baskets": self.baskets, "next_id": self.next_id, "named": self.named, "last": self.last, "segments": self.segments})
        self.spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/manifest/{version}")
        self.version = version
        return self

    def _partial(self, coded: DataFrame, groups: int, large: bool) -> DataFrame:
        buckets, columns = self.buckets, ["basket", "place", "code"] if large else ["basket", "code"]

        def pair(group: pa.Table) -> pa.Table:
            held = [unpack(x, n, len(columns)) for n, x in zip(group.column("n").to_pylist(), group.column("packed").to_pylist())]
            return pa.Table.from_batches([_segment_batch(list(_paired([np.concatenate([h[i] for h in held]) for i in range(len(columns))], large, buckets)))])

        return _packed_rows(coded, columns, groups).groupBy("part").applyInArrow(pair, _SEGMENT)

    def compact(self, version: int) -> None:
        """One segment, `version` of a folder of its own, in place of all."""
        total, buckets = sum(n for _, n in self.segments), self.buckets
        rows = self._segments([v for v, _ in self.segments])
        if total > 4 * BUCKET_PAIRS * buckets:  # more buckets
            self.buckets = buckets = 1 << int(np.ceil(np.log2(total / BUCKET_PAIRS)))

            def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for bucket, n, packed in zip(*(c.to_pylist() for c in batch.columns)):
                        if bucket == _BASKETS:
                            yield _segment_batch([(bucket, n, packed)])
                            continue
                        key, delta = unpack(packed, n, 2)
                        own = _pair_bucket(key, buckets)
                        yield _segment_batch(list(_by_bucket(key, delta, own if bucket >= 0 else _BASKETS - 1 - own)))

            rows = rows.mapInArrow(split, _SEGMENT)
        _merged(rows).write.mode("overwrite").parquet(f"{self.folder}/segments/{version}-whole")
        pairs = self._segments([f"{version}-whole"]).filter("bucket >= 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        self.segments = [(f"{version}-whole", pairs)]

    def _scored(self, pairs: DataFrame, items: DataFrame) -> DataFrame:
        a, b = (items.select(F.col("id").alias(x), F.col("item").alias(f"item_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
        both = pairs.join(a, "a").join(b, "b")
        swap = F.col("item_a") > F.col("item_b")
        pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x)
        return both.select(pick("item_a", "item_b"), pick("item_b", "item_a"), "n_ab", pick("n_a", "n_b"), pick("n_b", "n_a"))

    def with_lift(self, scored: DataFrame, min_lift: float = 0.0) -> DataFrame:
        """`scored` (item_a, item_b, n_ab, n_a, n_b) with lift = n_ab * n / (n_a * n_b), n the baskets that hold anything, filtered."""
        lift = F.col("n_ab").cast("double") * self.baskets / (F.col("n_a").cast("double") * F.col("n_b"))
        return scored.filter(F.col("n_ab").cast("double") * self.baskets >= F.lit(float(min_lift)) * F.col("n_a") * F.col("n_b")).withColumn("lift", lift)

    def scores(self, min_together: int = 1, min_lift: float = 0.0) -> DataFrame:
        """item_a < item_b, n_ab, n_a, n_b, lift, see `with_lift`, of all pairs in at least `min_together` baskets."""
        return self.with_lift(self._scored(self._pairs(max(min_together, 1)), self.items()), min_lift)

    def rescored(self) -> DataFrame:
        """item_a < item_b, n_ab, n_a, n_b of the pairs that the last batch affects: their count, or that of one of their items, changed.

        Pairs that no basket has any more are there with n_ab 0. All other pairs keep these numbers; their lift changes with the number
        of baskets only, so `with_lift` brings stored rows up to date.
        """
        ids = self._counts([self.last], False, None).select(F.col("key").alias("id")).distinct()
        changed = self._counts([self.last], True, None).select("key")
        every = self._counts([v for v, _ in self.segments], True, None)
        a, b = F.shiftright("key", 31), F.col("key").bitwiseAND(F.lit((1 << 31) - 1))
        touched = every.join(ids.select(F.col("id").alias("_a")), a == F.col("_a"), "left_semi").select("key")
        touched = touched.unionByName(every.join(ids.select(F.col("id").alias("_b")), b == F.col("_b"), "left_semi").select("key"))
        keys = touched.unionByName(changed).distinct()
        pairs = keys.join(every, "key", "left").select(a.alias("a"), b.alias("b"), F.coalesce("n", F.lit(0)).alias("n_ab"))
        items = self.dictionary().join(self._counts([v for v, _ in self.segments], False, None).withColumnRenamed("key", "id"), "id", "left").select("item", "id", F.coalesce("n", F.lit(0)).alias("n"))
        return self._scored(pairs, items)


def _chunked(coded: DataFrame) -> DataFrame:
    """Rows of large baskets for each pair of chunks that has their own: basket, place (both chunks, and how many there are), code."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            basket, code, chunks = (batch.column(i).to_numpy() for i in range(3))
            own = (mix64(code >> 2, 3) % chunks.astype(np.uint64)).astype(np.int64)
            for lo in range(0, len(basket), 1000):  # a row becomes as many as its basket has chunks
                at = np.repeat(np.arange(lo, min(lo + 1000, len(basket))), chunks[lo : lo + 1000])
                other = within(chunks[lo : lo + 1000])
                place = (np.minimum(own[at], other) << 42) | (np.maximum(own[at], other) << 21) | (chunks[at] - 1)
                yield pa.RecordBatch.from_arrays([pa.array(basket[at]), pa.array(place), pa.array(code[at])], names=["basket", "place", "code"])

    return coded.select("basket", "code", "chunks").mapInArrow(cut, "basket bigint, place bigint, code bigint")


def new_baskets(lists: DataFrame, item: str = "itemset", baskets: str = "users", batch: int = 0, batches: int = 1) -> DataFrame:
    """Changes for a table without these baskets from vertical rows (item, list of its baskets): each basket is new.

    Of several `batches` the one of that number has the baskets that a hash gives it.
    """
    rows = lists.filter(F.col(item).isNotNull()).select(F.explode(baskets).alias("basket"), F.col(item).alias("item")).filter("basket is not null")
    rows = rows.filter(F.pmod(F.xxhash64("basket"), F.lit(batches)) == batch) if batches > 1 else rows
    return rows.select("basket", "item", F.lit(False).alias("was"), F.lit(True).alias("now"))


def load_lists(table: PairTable, lists: DataFrame, batches: int = 2) -> PairTable:
    """Vertical rows added to `table` in batches of baskets."""
    for batch in range(batches):
        table.apply(new_baskets(lists, batch=batch, batches=batches), stage=False)
    return table


def changes_between(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes from the distinct (basket, item) rows of `old` to those of `new`, for baskets that differ only."""
    marked = old.select("basket", "item").distinct().withColumn("_o", F.lit(True)).join(new.select("basket", "item").distinct().withColumn("_n", F.lit(True)), ["basket", "item"], "full")
    marked = marked.select("basket", "item", F.coalesce("_o", F.lit(False)).alias("was"), F.coalesce("_n", F.lit(False)).alias("now"))
    differ = marked.filter("was != now").select("basket").distinct()
    return marked.join(differ, "basket", "left_semi")
