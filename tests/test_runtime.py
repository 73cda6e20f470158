import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark import runtime


def test_staged_tables_are_read_back_and_released(spark):
    df = runtime.staged(spark.range(10).withColumn("x", F.lit(None).cast("string")))
    assert df.count() == 10 and os.path.isdir(df._staged_path) and df._staged_path.startswith(runtime.shared_folder(spark))
    assert "Range" not in df._jdf.queryExecution().optimizedPlan().toString()
    runtime.release(df)
    assert not os.path.isdir(df._staged_path)
    kept = runtime.staged(spark.range(3))
    runtime.clear(spark)
    assert not os.path.isdir(kept._staged_path)


@pytest.mark.parametrize("salts", [1, 7])
def test_running_sums(spark, salts):
    rng = random.Random(salts)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([1, 2, 2, None]), rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "id bigint, k string, o int, v bigint")
    found = runtime.before_within(df, ["k"], ["o"], ["id"], salts, F.col("v"), "before").collect()
    ranks = {r.id: r.rank for r in runtime.rank_within(df, ["k"], ["o"], ["id"], salts, "rank").collect()}
    assert len(found) == 500
    for k in ("a", "b", None):
        own = sorted((r for r in found if r.k == k), key=lambda r: ranks[r.id])
        assert [ranks[r.id] for r in own] == list(range(len(own)))
        assert [r.o or 0 for r in own] == sorted(r.o or 0 for r in own)
        total = 0
        for r in own:
            assert r.before == total
            total += r.v


def test_the_rest_stands_without_the_optional_part():
    top = os.path.dirname(runtime.__file__)
    for folder, _, files in os.walk(top):
        if os.path.basename(folder) not in ("llm", "__pycache__"):
            for name in files:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name)) as f:
                        assert ".llm" not in f.read() and "import llm" not in name
