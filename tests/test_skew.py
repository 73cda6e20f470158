from tidemark.operators import skew

from .conftest import same_rows


def test_heavy_and_light_keys(spark):
    rows = [("big", float(i % 7), i) for i in range(4000)] + [(f"k{i % 300}", 2.0, 4000 + i) for i in range(3000)] + [(None, 1.0, 8000 + i) for i in range(2000)] + [("nan", float("nan"), 9000), ("nan", None, 9001)]
    df = spark.createDataFrame(rows, "n string, total double, row bigint")
    found = {r.key_value: r for r in skew.key_statistics(df, "n", "total", ["row"]).collect()}
    assert len(found) == 303
    assert (found["big"].n, found["big"].total, found["big"].is_heavy) == (4000, sum(float(i % 7) for i in range(4000)), True)
    assert (found[None].n, found[None].mean, found[None].is_heavy) == (2000, 1.0, False)
    assert (found["nan"].n, found["nan"].n_value, found["nan"].total, found["nan"].mean) == (2, 0, None, None)
    assert found["k5"].n == 10 and not found["k5"].is_heavy


def test_share_is_met_exactly(spark):
    df = spark.createDataFrame([("a", 1.0, i) for i in range(5)] + [("b", 1.0, i) for i in range(95)], "k string, v double, row bigint")
    assert {r.key_value for r in skew.key_statistics(df, "k", "v", ["row"]).collect() if r.is_heavy} == {"a", "b"}


def test_only_heavy_keys_are_salted(spark):
    df = spark.createDataFrame([("a", i) for i in range(1000)] + [("b", 1), ("c", 1)], "k string, row bigint")
    assert skew.heavy_keys(df, "k", 0.01) == ["a"]


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([("a", 1.0, 1)] * 3, "k string, v double, row bigint")
    same_rows(skew.key_statistics(df, "k", "v", ["row"]).collect(), [("a", 3, 3, 3.0, 1.0, True)])
    assert skew.key_statistics(df.limit(0), "k", "v", ["row"]).count() == 0


def test_share_of_more_rows_than_an_int_holds_ten_thousandths_of(spark):
    df = spark.range(300_000).selectExpr("if(id < 299999, 'a', 'b') as k", "1.0D as v", "id as row")
    found = skew.key_statistics(df, "k", "v", ["row"], named_share=0.99)
    same_rows([(r.key_value, r.n, r.is_heavy) for r in found.collect()], [("a", 299_999, True), ("b", 1, False)])
