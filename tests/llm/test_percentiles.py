import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from tidemark.llm import percentiles

PERCENTS = {"p1": 1, "p50": 50, "p90": 90, "p100": 100}


def ordered_bits(x):
    bits = struct.unpack(">q", struct.pack(">d", x))[0] & (1 << 63) - 1
    return -bits - 1 if x < 0 else bits


def test_codes_are_the_ordered_bits(spark):
    rng = random.Random(2)
    values = [0.0, 1.0, 2.0, 3.0, 0.1, 5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, math.inf, 8.0, 7.999999999999999, 1e22, 2.0**53, 0.5, 0.49999999999999994]
    values += [math.ldexp(rng.random(), rng.randint(-1070, 1020)) for _ in range(3000)]
    values += [-v for v in values if v]
    rows = spark.createDataFrame([(v,) for v in values], "v double").withColumn("c", percentiles.ordered_code(F.col("v"))).withColumn("back", percentiles.coded_value(F.col("c"))).collect()
    for r in rows:
        assert r.c == ordered_bits(r.v) and r.back == r.v
    (bad,) = spark.createDataFrame([(float("nan"),)], "v double").select(percentiles.ordered_code(F.col("v")).alias("c")).collect()
    assert bad.c is None
    assert spark.createDataFrame([(-0.0,)], "v double").select(percentiles.ordered_code(F.col("v")).alias("c")).first().c == 0


def brute(values, percent):
    kept = sorted(values)
    return kept[(len(kept) * percent + 99) // 100 - 1]


@pytest.mark.parametrize("bits", [18, 36, 63])
def test_groups_against_brute_force(spark, bits):
    rng = random.Random(bits)
    rows = [(rng.choice(["a", "b", None]), rng.randint(1, 4), rng.choice([rng.gauss(0, 100), float(rng.randint(0, 5)), rng.expovariate(0.001)]), "x") for _ in range(4000)]
    rows += [("hot", 1, 7.5, "x")] * 3000 + [("a", 1, None, "x"), ("a", 1, float("nan"), "x"), ("none", 1, None, "x")]
    df = spark.createDataFrame(rows, "k string, day int, v double, digit string")
    found = {r.k: r for r in percentiles.percentiles(df, ["k"], "v", PERCENTS, part="day", bits=bits, digit_bits=9).collect()}
    assert set(found) == {"a", "b", None, "hot"}
    for k, r in found.items():
        own = [v for g, _, v, _ in rows if g == k and v is not None and not math.isnan(v)]
        assert r.n == len(own)
        for name, p in PERCENTS.items():
            true = brute(own, p)
            assert abs(r[name] - true) <= abs(true) * 2.0 ** (12 - bits)


def test_summaries_of_days_merge(spark):
    df = spark.createDataFrame([("a", d, float(d * i % 17)) for d in range(1, 6) for i in range(100)], "k string, day int, v double")
    days = [percentiles.digit_histogram(df.filter(F.col("day") == d), ["k"], "v") for d in range(1, 6)]
    merged = days[0]
    for x in days[1:]:
        merged = percentiles.merge(merged.unionByName(x), ["k"])
    assert percentiles.select_percentiles(merged, ["k"], PERCENTS).first() == percentiles.percentiles(df, ["k"], "v", PERCENTS).first()


def test_summary_has_a_bound(spark):
    df = spark.range(300_000).select((F.lit(1.0) + F.col("id") / 300_000).alias("v"), F.lit("a").alias("k"))
    summary = percentiles.digit_histogram(df, ["k"], "v")
    assert df.select("v").distinct().count() == 300_000 and summary.count() == 512
    exact = {name: 1 + ((300_000 * p + 99) // 100 - 1) / 300_000 for name, p in PERCENTS.items()}
    for name, x in exact.items():
        assert abs(percentiles.select_percentiles(summary, ["k"], PERCENTS).first()[name] / x - 1) < 2**-9
        assert abs(percentiles.percentiles(df, ["k"], "v", PERCENTS).first()[name] / x - 1) < 2**-24


def test_many_groups_are_shuffled(spark, monkeypatch):
    df = spark.range(4000).select((F.col("id") * F.col("id") % 997 / 7).alias("v"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 > 0, F.concat(F.lit("k"), F.col("id") % 50)).alias("k"))
    found = sorted(map(repr, percentiles.percentiles(df, ["k"], "v", PERCENTS).collect()))
    monkeypatch.setattr(percentiles, "BROADCAST_GROUPS", 10)
    assert sorted(map(repr, percentiles.percentiles(df, ["k"], "v", PERCENTS).collect())) == found


def test_no_keys(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    assert tuple(percentiles.percentiles(df, [], "v", PERCENTS).first()) == (1000, 9.0, 499.0, 899.0, 999.0)


def test_empty(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert percentiles.percentiles(df, ["k"], "v", PERCENTS).count() == 0


def test_reserved_keys(spark):
    with pytest.raises(ValueError):
        percentiles.percentiles(spark.createDataFrame([], "n string, v double"), ["n"], "v", PERCENTS)
