"""Frequent itemsets, level by level, in a vertical layout: rows of an itemset and a user that holds it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import folded, leave_one_out
from ..runtime import scratch, staged
from ..sinks.writers import write_levels

#: Items of a basket that are paired in one group.
BASKET_ITEMS = 2048


def numbered(df: DataFrame, order: list[str], name: str, first: int = 1) -> DataFrame:
    """Add `name`: first, first + 1, .. in `order`, without bringing all rows into one task.

    Rows are split by ranges of `order` and numbered within, and shifted by the counts of the ranges before. Equal rows are numbered in
    any order.
    """
    placed = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    placed = staged(placed, "ranges")
    counts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # one row per range
    shifted = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shift"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return placed.withColumn("_own", own).join(F.broadcast(shifted), "_range").withColumn(name, (F.col("_own") + F.col("_shift") + (first - 1)).cast("bigint")).drop("_range", "_own", "_shift")


def transactions(listens: DataFrame, user: str = "user", song: str = "song") -> DataFrame:
    """user, id, songs: each user's songs, sorted, duplicates kept; ids are 2, 3, .. in the order of users. Null users or songs make no listen."""
    kept = listens.select(F.col(user).alias("user"), F.col(song).alias("song")).filter("user is not null and song is not null")
    held = kept.groupBy("user").agg(F.sort_array(F.collect_list("song")).alias("songs"))
    return numbered(held, ["user"], "id", 2).select("user", "id", "songs")


def holdings(baskets: DataFrame, uid: str = "id", songs: str = "songs") -> DataFrame:
    """Rows item, uid for each element of each basket, duplicates kept."""
    return baskets.select(F.explode(songs).alias("item"), F.col(uid).alias("uid")).filter("item is not null and uid is not null")


def listed(rows: DataFrame) -> DataFrame:
    """items, users (sorted): the lists of a level, for output; levels themselves are rows items, uid, so that no group is in one task."""
    return rows.groupBy("items").agg(F.sort_array(F.collect_list("uid")).alias("users"))


def supports(rows: DataFrame) -> DataFrame:
    """items, support: the users of each itemset of a level."""
    return rows.groupBy("items").agg(F.count(F.lit(1)).alias("support"))


def frequent_items(held: DataFrame, above: int = 50) -> DataFrame:
    """items (of one), uid (each once), support: the number of elements, duplicates counted; it has to exceed `above`."""
    counted = held.groupBy("item").agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") > above)
    return held.join(counted, "item").select(F.array("item").alias("items"), "uid", "support").distinct()


def frequent_pairs(singles: DataFrame, above: int = 10) -> DataFrame:
    """items (two, ascending), uid (each once) for the pairs of frequent items that more than `above` users hold.

    Pairs come from users that hold both, so pairs without a common user aren't formed. Baskets of more than BASKET_ITEMS items are cut into
    chunks, whose pairs are formed in different groups. The frequent items are staged, as both sides of both joins read them.
    """
    held = staged(singles.select(F.col("items")[0].alias("item"), "uid"), "singles")
    a, b = held.withColumnRenamed("item", "a"), held.withColumnRenamed("item", "b")
    large = held.groupBy("uid").agg(F.ceil(F.count(F.lit(1)) / BASKET_ITEMS).cast("int").alias("chunks")).filter("chunks > 1")
    on = ["uid"]
    if large.take(1):
        large, on = staged(large, "large"), ["uid", "x", "y"]
        chunk = lambda name: F.pmod(F.xxhash64(name), F.coalesce("chunks", F.lit(1))).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1))
        a = a.join(large, "uid", "left").select("a", "uid", chunk("a").alias("x"), every.alias("y"))
        b = b.join(large, "uid", "left").select("b", "uid", every.alias("x"), chunk("b").alias("y"))
    met = a.join(b, on).filter("a < b").select("a", "b", "uid")
    counted = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > above).select("a", "b")
    return met.join(counted, ["a", "b"]).select(F.array("a", "b").alias("items"), "uid")


def next_level(level: DataFrame, size: int, least: int = 1, prune: bool = True, ignore_case: bool = False) -> DataFrame:
    """Itemsets of `size` from those of size - 1 as rows items, uid: joined on all but the last item, pruned, users that hold both, `least` or more.

    Pruning keeps a candidate whose every subset of size - 1 is in `level`; the two it was joined from are so by construction. It
    comes before users are brought in. With `ignore_case` the items joined on agree but for their case.
    """
    sets = level.select("items").distinct()
    prefix = F.slice("items", 1, size - 2)
    keyed = sets.select(F.transform(prefix, folded).alias("prefix") if ignore_case else prefix.alias("prefix"), F.element_at("items", -1).alias("last"), "items")
    a, b = keyed.select("prefix", F.col("last").alias("x"), F.col("items").alias("left")), keyed.select("prefix", F.col("last").alias("y"), F.col("items").alias("right"))
    joined = a.join(b, "prefix").filter("x < y").select(F.concat("left", F.array("y")).alias("items"), "left", "right")
    if prune:
        known = sets.select(F.col("items").alias("subset"))
        for drop in range(1, size - 1):
            joined = joined.join(known, leave_one_out(F.col("items"), size, drop) == F.col("subset"), "left_semi")
    held = level.select("items", "uid")
    out = joined.join(held.withColumnRenamed("items", "left"), "left").join(held.withColumnRenamed("items", "right"), ["right", "uid"]).select("items", "uid")
    if least > 1:
        out = staged(out, "met")
        out = out.join(supports(out).filter(F.col("support") >= least).select("items"), "items", "left_semi")
    return out


def itemsets(pairs: DataFrame, last: int = 7, least: int = 1, prune: bool = True, folder: str | None = None) -> dict[int, DataFrame]:
    """Levels 3..last as rows items, uid; after an empty level the rest are empty too.

    Each level is written to the folder `pass=<size>` below `folder` (one of the session's own if not given) and the next reads it.
    """
    spark = pairs.sparkSession
    folder = folder or scratch(spark, "levels")
    schema = pairs.select("items", "uid").schema
    level, out = staged(pairs.select("items", "uid"), "level2"), {}
    empty = False
    for size in range(3, last + 1):
        if not empty:
            write_levels({size: next_level(level, size, least, prune)}, folder)
        level = out[size] = spark.read.schema(schema).parquet(f"{folder}/pass={size}") if not empty else level
        empty = empty or not level.take(1)
    return out
