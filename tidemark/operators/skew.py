"""Per-key results while a few keys hold most rows: two-stage salted aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import salt, staged


def key_counts(df: DataFrame, key: str) -> DataFrame:
    """_key and _n, its rows, for each key, null among them; staged, as little is left of the table."""
    return staged(df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")), "keys")


def heavy_of(counts: DataFrame, share: float) -> list:
    """Keys of `key_counts` that hold at least `share` of all rows: 1 / share keys at most, so they can be gathered."""
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    return [r._key for r in counts.filter(F.col("_n") >= F.lit(total) * F.lit(share)).select("_key").collect()]


def heavy_keys(df: DataFrame, key: str, share: float) -> list:
    """Keys, null among them, that hold at least `share` of all rows."""
    return heavy_of(key_counts(df, key), share)


def salted_aggregate(df: DataFrame, key: str, partials: dict[str, Column], merges: dict[str, Column], spread: list[str], heavy: list, salts: int = 32) -> DataFrame:
    """Aggregate per `key` in two stages: partial results per (key, salt), then the merge of a key's partials.

    `partials` are aggregates over rows by name, `merges` aggregates over the partials' names. Only rows of the `heavy` keys, see
    `heavy_keys`, get a salt 1..salts, by a hash of `spread`, so no task sees more than a share of the rows of one key and light keys
    aren't split. Null keys are a key.
    """
    named = [k for k in heavy if k is not None]
    is_heavy = F.col(key).isin(named) if named else F.lit(False)
    if None in heavy:
        is_heavy = F.col(key).isNull() | is_heavy
    salted = df.withColumn("_salt", F.when(is_heavy, salt(*spread, salts=salts) + 1).otherwise(F.lit(0)))
    first = salted.groupBy(key, "_salt").agg(*[c.alias(n) for n, c in partials.items()])
    return first.groupBy(key).agg(*[c.alias(n) for n, c in merges.items()])


def key_statistics(df: DataFrame, key: str, value: str, spread: list[str], named_share: float = 0.05, salts: int = 32) -> DataFrame:
    """key_value, n (rows), n_value (rows with a value), total, mean and is_heavy (at least `named_share` of all rows) per key.

    Null and NaN values count as rows but not in total and mean, which are null for keys without values. A null key is a key of its
    own and can't be heavy by name. Repeated rows count. An empty table gives no rows. The table is read twice: for the rows of each key,
    which give the heavy keys and the number of all rows, and for the statistics.
    """
    rows_of = df.select(F.col(key).alias("key_value"), F.col(value).alias("_value"), *[F.col(c).alias(f"_spread{i}") for i, c in enumerate(spread)])
    counts = key_counts(rows_of, "key_value")
    rows = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    known = F.when(~F.isnan("_value"), F.col("_value"))
    partials = {"n": F.count(F.lit(1)), "n_value": F.count(known), "total": F.sum(known)}
    heavy = heavy_of(counts, min(named_share, 0.01))
    per = salted_aggregate(rows_of, "key_value", partials, {"n": F.sum("n"), "n_value": F.sum("n_value"), "total": F.sum("total")}, [f"_spread{i}" for i in range(len(spread))], heavy, salts)
    least = -(-rows * round(named_share * 10_000) // 10_000)  # rounded up, in Python, as products of columns overflow
    is_heavy = F.col("key_value").isNotNull() & (F.col("n") >= F.lit(least))
    return per.select("key_value", "n", "n_value", "total", (F.col("total") / F.nullif(F.col("n_value"), F.lit(0))).alias("mean"), is_heavy.alias("is_heavy"))
