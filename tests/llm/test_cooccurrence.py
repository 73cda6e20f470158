import itertools
import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import cooccurrence
from tidemark.llm.cooccurrence import PairTable, changes_between, new_baskets


def frame(spark, baskets):
    return spark.createDataFrame([(b, i) for b, items in baskets.items() for i in items] or [], "basket bigint, item string")


def counts(baskets):
    return Counter(p for items in baskets.values() for p in itertools.combinations(sorted(items), 2))


def check(found, baskets):
    live = {b: i for b, i in baskets.items() if i}
    single = Counter(i for items in live.values() for i in items)
    rows = {(r.item_a, r.item_b): r for r in found.collect()}
    expected = counts(live)
    assert {k: r.n_ab for k, r in rows.items()} == dict(expected)
    for (a, b), r in rows.items():
        assert (r.n_a, r.n_b) == (single[a], single[b])
        assert abs(r.lift - r.n_ab * len(live) / (single[a] * single[b])) < 1e-9


@pytest.mark.parametrize("most", [2048, 3])
def test_updates_equal_a_new_table(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(cooccurrence, "BASKET_ITEMS", most)
    rng = random.Random(1)
    items = [f"s{i}" for i in range(12)]
    baskets = {b: set(rng.sample(items, rng.randint(1, 8))) for b in range(80)}
    table = PairTable(spark, str(tmp_path), buckets=5)
    empty = frame(spark, {})
    table.apply(changes_between(empty, frame(spark, baskets)))
    check(table.scores(), baskets)
    for _ in range(2):
        new = {b: set(x) for b, x in baskets.items()}
        for b in rng.sample(sorted(new), 10):
            new[b] = set(rng.sample(items, rng.randint(0, 8)))
        new[max(new) + 1] = set(items[:4])
        del new[min(new)]
        table.apply(changes_between(frame(spark, baskets), frame(spark, new)))
        baskets = new
        check(table.scores(), baskets)
    check(PairTable(spark, str(tmp_path)).scores(), baskets)  # as read from the folder
    assert table.apply(changes_between(frame(spark, baskets), frame(spark, baskets))).baskets == len([b for b in baskets.values() if b])
    check(table.scores(), baskets)


def test_a_batch_writes_what_it_changes(spark, tmp_path):
    baskets = {b: {f"s{b}", f"t{b}", f"u{b}"} for b in range(30)}
    table = PairTable(spark, str(tmp_path), buckets=64).apply(changes_between(frame(spark, {}), frame(spark, baskets)))
    table.apply(changes_between(frame(spark, {0: baskets[0]}), frame(spark, {0: {"s0", "t0"}})))
    assert [n for _, n in table.segments] == [90, 2]
    found = {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b) for r in table.rescored().collect()}
    assert found == {("s0", "u0"): (0, 1, 0), ("t0", "u0"): (0, 1, 0)}
    assert table.scores().count() == 88


def test_compaction(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cooccurrence, "SEGMENTS", 2)
    monkeypatch.setattr(cooccurrence, "BUCKET_PAIRS", 4)
    baskets, table = {}, PairTable(spark, str(tmp_path), buckets=2)
    for b in range(5):
        new = baskets | {b: {f"s{i}" for i in range(b, b + 6)}}
        table.apply(changes_between(frame(spark, baskets), frame(spark, new)))
        baskets = new
        assert len(table.segments) <= 2
        check(table.scores(), baskets)
    assert table.buckets > 2
    check(PairTable(spark, str(tmp_path)).scores(), baskets)


def test_packed_columns():
    rng = np.random.default_rng(0)
    first, other = np.sort(rng.integers(-(2**62), 2**62, 1000)), rng.integers(-(2**62), 2**62, 1000)
    assert all((x == y).all() for x, y in zip(cooccurrence.unpack(cooccurrence.pack(first, other), 1000, 2), (first, other)))


def test_text_baskets_and_repeated_rows(spark, tmp_path):
    rows = spark.createDataFrame([(b, i, False, True) for b in ("x", "y") for i in ("p", "q", "p")] + [(None, "p", False, True), ("x", None, False, True)], "basket string, item string, was boolean, now boolean")
    (row,) = PairTable(spark, str(tmp_path)).apply(rows).scores().collect()
    assert tuple(row) == ("p", "q", 2, 2, 2, 1.0)


def test_vertical_lists(spark, tmp_path):
    lists = spark.createDataFrame([("a", [1, 2, 2, None]), ("a", [3]), ("b", [3, 1]), ("b", [1]), ("c", None), ("c", []), (None, [1, 2])], "itemset string, users array<bigint>")
    (row,) = PairTable(spark, str(tmp_path)).apply(new_baskets(lists)).scores(1).collect()
    assert (row.item_a, row.item_b, row.n_ab, row.n_a, row.n_b, row.lift) == ("a", "b", 2, 3, 2, 1.0)


def test_thresholds_and_empty(spark, tmp_path):
    lists = spark.createDataFrame([("a", list(range(20))), ("b", list(range(20))), ("c", list(range(19))), ("z", list(range(20, 101)))], "itemset string, users array<bigint>")
    table = PairTable(spark, str(tmp_path / "x")).apply(new_baskets(lists))
    assert [(r.item_a, r.item_b) for r in table.scores(20, 5.0).collect()] == [("a", "b")]  # 20 * 101 >= 5 * 20 * 20
    assert [(r.item_a, r.item_b) for r in table.scores(20, 5.06).collect()] == []
    assert PairTable(spark, str(tmp_path / "y")).apply(new_baskets(lists.limit(0))).scores().count() == 0
