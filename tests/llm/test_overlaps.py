import itertools
import random

import pytest

from tidemark.llm import overlaps


def brute(sets, share):
    out = []
    for (a, x), (b, y) in itertools.combinations(sorted(sets.items()), 2):
        both = len(x & y)
        if x and y and both and both >= share * min(len(x), len(y)):
            out.append((a, b, both, len(x), len(y)))
    return sorted(out)


def planted(rng, hot):
    sets = {}
    for i in range(150):
        sets[i] = {rng.randint(0, 3000) for _ in range(rng.randint(1, 60))} | set(rng.sample(hot, rng.randint(0, len(hot))))
        if i % 5 == 4:
            sets[i] = set(rng.sample(sorted(sets[i - 1]), max(1, len(sets[i - 1]) * 2 // 3)))
        if i % 11 == 10:
            sets[i] = set(rng.sample(hot, rng.randint(1, len(hot))))
    return sets


@pytest.mark.parametrize(("share", "hot_degree", "tile_sets", "dense"), [(0.5, 256, 10**6, 10**7), (0.5, 8, 10**6, 10**7), (0.5, 20, 40, 100), (0.9, 3, 10**6, 300), (0.05, 12, 10**6, 100), (1e-12, 5, 50, 200)])
def test_against_brute_force(spark, monkeypatch, share, hot_degree, tile_sets, dense):
    monkeypatch.setattr(overlaps, "DENSE_VALUES", dense)
    rng = random.Random(hot_degree)
    sets = planted(rng, [10_000 + i for i in range(12)])
    rows = [(i, list(x) + [None] + list(x)[:2], 1, "clash") for i, x in sets.items()]
    rows += rows[:10] + [(7, [], 1, "x"), (500, None, 1, "x"), (501, [None], 1, "x"), (None, [1, 2], 1, "x")]
    rows[3] = (3, rows[3][1][: len(rows[3][1]) // 2], 1, "x")  # one set in two rows
    rows.append((3, [x for x in sets[3] if x not in (rows[3][1] or [])] or [next(iter(sets[3]))], 1, "x"))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "set_id bigint, users array<bigint>, n int, a string")
    found = overlaps.set_overlaps(df, "set_id", "users", share, hot_degree=hot_degree, block_values=500, tile_sets=tile_sets)
    assert sorted(map(tuple, found.collect())) == brute(sets, share)


def test_an_identifier_in_every_set(spark):
    rows = [(i, [1, *range(100 * i + 10, 100 * i + 14)]) for i in range(400)] + [(1000, [1]), (1001, [1, 2])]
    df = spark.createDataFrame(rows, "set_id bigint, users array<bigint>")
    found = {tuple(r)[:3] for r in overlaps.set_overlaps(df, min_share=0.5, hot_degree=50).collect()}
    assert found == {(i, j, 1) for i in range(400) for j in (1000, 1001)} | {(1000, 1001, 1)}


def test_strings_and_empty(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "a"]), (3, ["z"])], "set_id int, users array<string>")
    assert [tuple(r) for r in overlaps.set_overlaps(df).collect()] == [(1, 2, 2, 2, 2)]
    assert overlaps.set_overlaps(df.limit(0)).count() == 0
