import itertools
import random

import pytest

from tidemark.llm import simjoin


def similar(x, y, threshold):
    return len(x & y) / len(x | y) >= threshold


def mutated(rng, x, universe, share):
    out = {v for v in x if rng.random() > share}
    return out | {rng.randint(0, universe) for _ in range(int(len(x) * rng.random() * share))} or {1}


def records(rng, n, universe, longest):
    out = {}
    for i in range(n):
        if i and rng.random() < 0.6:
            out[i] = mutated(rng, out[rng.randrange(i)], universe, rng.choice([0.0, 0.1, 0.3, 0.5]))
        else:
            out[i] = {int(universe * rng.random() ** 3) for _ in range(rng.randint(1, longest))}
    return out


def frame(spark, sets, extra=()):
    return spark.createDataFrame([(i, [*x, None, next(iter(x))], "clash", 1) for i, x in sets.items()] + list(extra), "id bigint, songs array<bigint>, key string, n int")


@pytest.mark.parametrize(("universe", "longest", "threshold", "full"), [(40, 8, 0.6, 6), (1000, 40, 0.6, 6), (1000, 40, 0.6, 1), (30, 12, 0.8, 2), (200, 20, 0.3, 6), (50, 6, 1.0, 6)])
def test_within_a_table(spark, universe, longest, threshold, full):
    sets = records(random.Random(universe + full), 160, universe, longest)
    df = frame(spark, sets, [(0, list(sets[0]), "x", 1), (900, [], "x", 1), (901, None, "x", 1), (902, [None], "x", 1), (None, [1, 2], "x", 1)])
    found = simjoin.similar_pairs(df, "id", "songs", threshold=threshold, shape=simjoin.Shape(most=full))
    expected = {(a, b) for (a, x), (b, y) in itertools.combinations(sets.items(), 2) if similar(x, y, threshold)}
    rows = [(r.id_a, r.id_b) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected


@pytest.mark.parametrize("each", [0.5, 1, 8])
def test_segments(spark, each):
    """Whatever the number of segments, and however many records are hard for them, all pairs are found."""
    sets = records(random.Random(8), 150, 300, 12)
    expected = {(a, b) for (a, x), (b, y) in itertools.combinations(sets.items(), 2) if similar(x, y, 0.6)}
    for most in (1, 2, 10):
        assert {(r.id_a, r.id_b) for r in simjoin.similar_pairs(frame(spark, sets), "id", "songs", threshold=0.6, shape=simjoin.Shape(each, most)).collect()} == expected


@pytest.mark.parametrize("least", [1, 5])
def test_between_tables(spark, least):
    rng = random.Random(least)
    left = records(rng, 100, 500, 30)
    right = {i: mutated(rng, left[i % 100], 500, 0.2) for i in range(130)}
    found = simjoin.similar_pairs(frame(spark, left), "id", "songs", frame(spark, right), "id", "songs", threshold=0.6, least=least)
    expected = {(a, b) for a, x in left.items() for b, y in right.items() if min(len(x), len(y)) >= least and similar(x, y, 0.6)}
    rows = [(r.id_a, r.id_b) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected


def test_links_count_every_similar_record(spark):
    rng = random.Random(9)
    sets = records(rng, 120, 60, 8)
    sets |= {200 + i: set(sets[i % 7]) for i in range(40)}
    rows = {r.id: r for r in simjoin.record_links(frame(spark, sets), "id", "songs", threshold=0.6).collect()}
    assert set(rows) == set(sets)
    for i, x in sets.items():
        same = [j for j, y in sets.items() if x == y]
        assert (rows[i].class_id, rows[i].copies) == (min(same), len(same))
        assert rows[i].links == sum(similar(x, y, 0.6) for j, y in sets.items() if j != i)
    right = {i: x for i, x in sets.items() if i % 3 == 0}
    for r in simjoin.record_links(frame(spark, sets), "id", "songs", frame(spark, right), "id", "songs", threshold=0.6).collect():
        assert r.links == sum(similar(sets[r.id], y, 0.6) for y in (sets if r.side else right).values())


def test_strings_copies_and_empty(spark):
    df = spark.createDataFrame([(i, ["a", "b", "c"]) for i in range(20)] + [(50, ["a", "b", "c", "d"]), (51, ["x"])], "id int, songs array<string>")
    rows = {(r.id_a, r.id_b): r.similarity for r in simjoin.similar_pairs(df, "id", "songs", threshold=0.6).collect()}
    assert rows == {(a, b): 1.0 for a, b in itertools.combinations(range(20), 2)} | {(a, 50): 0.75 for a in range(20)}
    assert simjoin.similar_pairs(df.limit(0), "id", "songs").count() == 0
    assert simjoin.similar_pairs(df, "id", "songs", df.limit(0), "id", "songs").count() == 0


def test_long_records(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(50) for _ in range(60_000)]
    df = spark.createDataFrame([(1, base), (2, base[:40_000]), (3, base[30_000:])], "id bigint, songs array<bigint>")
    assert [(r.id_a, r.id_b) for r in simjoin.similar_pairs(df, "id", "songs").collect()] == [(1, 2)]
