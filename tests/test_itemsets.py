import itertools
import random

from tidemark.operators import itemsets

from .conftest import same_rows


def level(spark, rows):
    return spark.createDataFrame([(list(i), x) for i, u in rows for x in u], "items array<string>, uid bigint")


def lists(rows):
    return itemsets.listed(rows).collect()


def test_transactions_are_numbered_from_two(spark):
    listens = spark.createDataFrame([("u1", "B"), ("u1", "A"), ("u1", "A"), ("u0", "C"), (None, "A"), ("u2", None)], "user string, song string")
    same_rows(itemsets.transactions(listens).collect(), [("u0", 2, ["C"]), ("u1", 3, ["A", "A", "B"])])


def test_numbers_are_dense_over_many_ranges(spark):
    df = itemsets.numbered(spark.range(1000).repartition(7), ["id"], "no")
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(i, i + 1) for i in range(1000)]


def test_thresholds(spark):
    baskets = [(i, ["A"]) for i in range(51)] + [(i + 100, ["B"]) for i in range(50)] + [(1, ["A"]), (200, None), (201, [None])]
    df = spark.createDataFrame(baskets, "id bigint, songs array<string>")
    rows = itemsets.frequent_items(itemsets.holdings(df))
    assert lists(rows) == [(["A"], list(range(51)))] and {r.support for r in rows.collect()} == {52}
    singles = level(spark, [("A", range(20)), ("B", range(10)), ("C", range(11))])
    same_rows(lists(itemsets.frequent_pairs(singles)), [(["A", "C"], list(range(11)))])


def test_large_baskets_are_paired_in_chunks(spark, monkeypatch):
    rng = random.Random(2)
    baskets = {u: rng.sample("ABCDEFGHIJKLMNOP", 14 if u % 9 == 0 else rng.randint(1, 4)) for u in range(70)}
    singles = spark.createDataFrame([([i], u) for u, b in baskets.items() for i in b], "items array<string>, uid bigint")
    found = sorted(lists(itemsets.frequent_pairs(singles, 3)))
    expected = {p: sorted(u for u, b in baskets.items() if set(p) <= set(b)) for p in itertools.combinations("ABCDEFGHIJKLMNOP", 2)}
    assert [(tuple(r["items"]), r.users) for r in found] == sorted((p, u) for p, u in expected.items() if len(u) > 3)
    monkeypatch.setattr(itemsets, "BASKET_ITEMS", 5)
    assert sorted(lists(itemsets.frequent_pairs(singles, 3))) == found


def test_join_and_prune(spark):
    same_rows(lists(itemsets.next_level(level(spark, [("AB", [1, 2]), ("AC", [1, 2]), ("BC", [1, 2])]), 3)), [(["A", "B", "C"], [1, 2])])
    assert itemsets.next_level(level(spark, [("AB", [1, 2]), ("AC", [1, 2])]), 3).count() == 0
    assert len(lists(itemsets.next_level(level(spark, [("AB", [1, 2]), ("AC", [1, 2])]), 3, prune=False))) == 1
    assert itemsets.next_level(level(spark, [("AB", [1]), ("AC", [2]), ("BC", [3])]), 3).count() == 0
    assert itemsets.next_level(level(spark, [("AB", [1, 2]), ("AC", [1, 2]), ("BC", [1, 2])]), 3, least=3).count() == 0
    mixed = spark.createDataFrame([(["a", "b"], 1), (["A", "c"], 1)], "items array<string>, uid bigint")
    assert lists(itemsets.next_level(mixed, 3, prune=False, ignore_case=True)) == [(["a", "b", "c"], [1])]
    assert itemsets.next_level(mixed, 3, prune=False).count() == 0


def test_levels_against_brute_force(spark):
    rng = random.Random(5)
    baskets = {u: set(rng.sample("ABCDEFGHIJ", rng.randint(2, 7))) for u in range(60)}
    users = {k: {c: sorted(u for u, b in baskets.items() if set(c) <= b) for c in itertools.combinations("ABCDEFGHIJ", k)} for k in range(2, 8)}
    pairs = {c: u for c, u in users[2].items() if len(u) > 10}
    known, expected = set(pairs), {}
    for k in range(3, 8):
        expected[k] = {c: u for c, u in users[k].items() if u and all(s in known for s in itertools.combinations(c, k - 1))}
        known = set(expected[k])
    found = itemsets.itemsets(level(spark, pairs.items()))
    for k in range(3, 8):
        same_rows(lists(found[k]), [(list(c), u) for c, u in expected[k].items()])


def test_levels_of_nothing(spark):
    assert [df.count() for df in itemsets.itemsets(level(spark, [])).values()] == [0] * 5
