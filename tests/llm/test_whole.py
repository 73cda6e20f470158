"""Queries return all that their problem asks for, also what falls below the cuts of other queries."""

from pyspark.sql import functions as F

from tidemark.llm import mixing, queries


def write(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_p2_every_pair_that_shares_a_listener(spark, tmp_path):
    items = [(1, list(range(100))), (2, list(range(99, 199))), (3, [500, 501])]
    # 9 is in 300 sets of their own, which makes it hot
    items += [(100 + i, [9, *range(10_000 + 20 * i, 10_010 + 20 * i)]) for i in range(300)]
    pairs = [(1, list(range(10))), (2, list(range(9, 19))), (3, [])]
    d = write(spark, tmp_path, frequent_items=(items, "set_id bigint, users array<bigint>"), frequent_pairs=(pairs, "set_id bigint, commons array<bigint>"))
    found = {tuple(r) for r in queries.p2_all_overlaps(spark, d).collect()}
    hot = [1, *range(100, 400)]
    size = lambda s: 100 if s == 1 else 11
    expected = {("users", a, b, 1, size(a), size(b)) for a in hot for b in hot if a < b}
    assert found == expected | {("users", 1, 2, 1, 100, 100), ("commons", 1, 2, 1, 10, 10)}


def test_p3_pairs_of_a_single_user(spark, tmp_path):
    lists = [("a", [1]), ("b", [1]), ("c", [2, 3, 4]), ("d", [2, 3])]
    d = write(spark, tmp_path, itemset_user_set=(lists, "itemset string, users array<bigint>"))
    assert {tuple(r) for r in queries.p3_all_pairs(spark, d).collect()} == {("a", "b", 1, 4.0), ("c", "d", 2, 1.3333)}


SIZED = "doc_id bigint, source string, lang string, topic string, n_tokens int"
TARGETS = "source string, target_share double, max_repeats int"


def test_p9_infeasible_sources_come_from_the_mix(spark, monkeypatch):
    raked = []
    rake = mixing.rake
    monkeypatch.setattr(mixing, "rake", lambda *x: raked.append(x) or rake(*x))
    rows = [(i, ("big", "mid", "small", "other", None)[i % 5], "en" if i % 3 else "de", "srt", 1 + i % 7) for i in range(700)] + [(1000, "blank", "en", "srt", 0)]
    sized = spark.createDataFrame(rows, SIZED)
    have = {s: sum(r[4] for r in rows if r[1] == s) for s in ("big", "mid", "small")}
    total = sum(r[4] for r in rows)
    wanted = [("big", have["big"] * 2 / total, 2), ("big", 0.9, 2), ("mid", have["mid"] * 3 / total + 1e-9, 3), ("small", 0.1, 1), ("small", 0.1, 0), ("absent", 0.1, 5), ("blank", 0.1, 5), (None, 0.1, 1), ("other", None, None)]
    targets = spark.createDataFrame(wanted, TARGETS)
    key = lambda r: repr((r.source, r.target_share, r.max_repeats))
    expected = sorted(map(key, mixing.capacities(sized, targets).filter("not feasible").collect()))
    assert sorted(map(key, mixing.infeasible(sized, targets).collect())) == expected and len(expected) == 6
    assert len(raked) == 1  # the operator's own method was run


def test_p9_a_mix_of_all_texts_size(spark):
    rows = [(i, "big" if i % 4 else "small", "en", "srt", 10) for i in range(400)]
    sized, targets = spark.createDataFrame(rows, SIZED), spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 1)], TARGETS)
    tokens = lambda **x: {r.source: r[1] for r in mixing.mix(sized, targets, **x).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies"))).collect()}
    assert tokens() == {"big": 1000, "small": 1000}
    assert tokens(shrink=False) == {"big": 2000, "small": 1000}


def test_p5_records_without_a_similar_one(spark, tmp_path):
    items = [(1, [1, 2, 3]), (2, [70, 71, 72]), (3, [72, 71, 70, None]), (4, [80, 81])]
    pairs = [(1, [1, 2, 3]), (5, [90, 91, 92]), (6, [])]
    d = write(spark, tmp_path, user_transactions=([(1, list("abcde"))], "tx_id bigint, songs array<string>"), frequent_items=(items, "set_id bigint, users array<bigint>"), frequent_pairs=(pairs, "set_id bigint, commons array<bigint>"))
    found = {tuple(r) for r in queries.p5_all_links(spark, d).collect()}
    assert found == {("songs", 1, 1, 0), ("users", 1, 1, 1), ("users", 2, 2, 0), ("users", 3, 2, 0), ("users", 4, 4, 0), ("commons", 1, 1, 1), ("commons", 5, 5, 0)}
