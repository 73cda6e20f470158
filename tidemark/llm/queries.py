"""Queries of this subpackage: (session, folder of tables) -> DataFrame. Their SQL is in `sql`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import scratch, staged, table
from . import clusters, cooccurrence, mixing, overlaps, packing, percentiles, simjoin, splitting

FEATURES = ["artist_hotness", "loudness", "beat"]
PERCENTS = {"p50": 50, "p90": 90, "p99": 99}
#: A share that one common identifier reaches in any set of fewer than 10^12.
ANY_SHARE = 1e-12


def _year(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "flights").filter("yearstring = '2008'").select("unique_carrier", F.expr("try_cast(monthstring as int)").alias("month"), "flight_date", "arr_delay_minutes")


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.percentiles(_year(spark, d), ["unique_carrier", "month"], "arr_delay_minutes", PERCENTS, part="flight_date")


def p1_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Summaries per day that can be merged to percentiles known to 2 ** -9 of their value, with the smallest value of each prefix."""
    found = percentiles.digit_histogram(_year(spark, d), ["unique_carrier", "month", "flight_date"], "arr_delay_minutes")
    return found.select("unique_carrier", "month", "flight_date", percentiles.coded_value(F.shiftleft("prefix", 64 - percentiles.SUMMARY_BITS)).alias("value"), "n")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    items = overlaps.set_overlaps(table(spark, d, "frequent_items"), "set_id", "users", 0.5)
    pairs = overlaps.set_overlaps(table(spark, d, "frequent_pairs"), "set_id", "commons", 0.5)
    named = lambda df, name: df.select(F.lit(name).alias("field_name"), "set_a", "set_b")
    return named(items, "users").unionByName(named(pairs, "commons"))


def _overlaps(spark: SparkSession, d: str, share: float) -> DataFrame:
    items = overlaps.set_overlaps(table(spark, d, "frequent_items"), "set_id", "users", share)
    pairs = overlaps.set_overlaps(table(spark, d, "frequent_pairs"), "set_id", "commons", share)
    named = lambda df, name: df.select(F.lit(name).alias("field_name"), "*")
    return named(items, "users").unionByName(named(pairs, "commons"))


def p2_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Shared listeners, with both sizes, of all pairs that share at least a quarter of the smaller set; p2_all_overlaps has the others too."""
    return _overlaps(spark, d, 0.25)


def p2_all_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Shared listeners, with both sizes, of every pair that shares any."""
    return _overlaps(spark, d, ANY_SHARE)


def hot_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """p2_overlaps of the commons with identifiers hot from five sets on, so that they are counted by dense tiles."""
    return overlaps.set_overlaps(table(spark, d, "frequent_pairs"), "set_id", "commons", 0.25, hot_degree=4).select(F.lit("commons").alias("field_name"), "*")


def _pair_table(spark: SparkSession, d: str) -> cooccurrence.PairTable:
    return cooccurrence.load_lists(cooccurrence.PairTable(spark, scratch(spark, "pairs")), table(spark, d, "itemset_user_set"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _pair_table(spark, d).scores(20, 5.0).select(F.col("item_a").alias("song_a"), F.col("item_b").alias("song_b"))


def _lifts(scores: DataFrame) -> DataFrame:
    return scores.select(F.col("item_a").alias("song_a"), F.col("item_b").alias("song_b"), "n_ab", F.round("lift", 4).alias("lift"))


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Common users and lift of pairs that five users or more have; p3_all_pairs has the others too."""
    return _lifts(_pair_table(spark, d).scores(5))


def p3_all_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Common users and lift of every pair that any user has."""
    return _lifts(_pair_table(spark, d).scores())


def p3_incremental(spark: SparkSession, d: str) -> DataFrame:
    """p3_found by a table and a batch: each song's first row loads the table and its pairs are scored; its further rows then change
    baskets, and only the pairs that they affect are scored anew."""
    lists = table(spark, d, "itemset_user_set")
    earliest = lists.groupBy("itemset").agg(F.min("list_id").alias("list_id"))
    held = lambda rows: rows.filter("itemset is not null").select(F.explode("users").alias("basket"), F.col("itemset").alias("item")).filter("basket is not null")
    old = held(lists.join(earliest, ["itemset", "list_id"], "left_semi"))
    built = cooccurrence.PairTable(spark, scratch(spark, "pairs"))
    built.apply(cooccurrence.changes_between(old.limit(0), old))
    kept = ["item_a", "item_b", "n_ab", "n_a", "n_b"]
    before = staged(built.scores(20).select(*kept), "scores")
    anew = staged(built.apply(cooccurrence.changes_between(old, held(lists))).rescored(), "rescored")
    scored = before.join(anew, ["item_a", "item_b"], "left_anti").unionByName(anew.filter("n_ab >= 20"))
    return built.with_lift(scored, 5.0).select(F.col("item_a").alias("song_a"), F.col("item_b").alias("song_b"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    songs = simjoin.similar_pairs(table(spark, d, "user_transactions"), "tx_id", "songs", threshold=0.6, least=5)
    users = simjoin.similar_pairs(table(spark, d, "frequent_items"), "set_id", "users", table(spark, d, "frequent_pairs"), "set_id", "commons", threshold=0.6)
    named = lambda df, name: df.select(F.lit(name).alias("field_name"), F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    return named(songs, "songs").unionByName(named(users, "users"))


def similar_baskets_by_rarest(spark: SparkSession, d: str) -> DataFrame:
    """The baskets of p5_found with deletions of single tokens only, so that most are joined by their rarest values."""
    return simjoin.similar_pairs(table(spark, d, "user_transactions"), "tx_id", "songs", threshold=0.6, least=5, shape=simjoin.Shape(most=1)).select("id_a", "id_b")


def _links(spark: SparkSession, d: str, linked_only: bool) -> DataFrame:
    songs = simjoin.record_links(table(spark, d, "user_transactions"), "tx_id", "songs", threshold=0.6, least=5)
    users = simjoin.record_links(table(spark, d, "frequent_items"), "set_id", "users", table(spark, d, "frequent_pairs"), "set_id", "commons", threshold=0.6, linked_only=linked_only)
    name = F.when(F.col("side") == 0, "users").otherwise("commons")
    users = users.filter("links > 0") if linked_only else users
    return songs.select(F.lit("songs").alias("field_name"), "id", "class_id", "links").unionByName(users.select(name.alias("field_name"), "id", "class_id", "links"))


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    """One row per record with its class of equal records and the number of similar ones; of users and commons only records that have any."""
    return _links(spark, d, True)


def p5_all_links(spark: SparkSession, d: str) -> DataFrame:
    """p5_links with the users and commons that have no similar record."""
    return _links(spark, d, False)


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters.cluster(table(spark, d, "song_features"), "song_id", FEATURES)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    probes = table(spark, d, "song_probes").filter("probe_no is not null and song_id is not null").distinct()
    named = probes.join(_clusters(spark, d).select("song_id", F.col("nearest").alias("cluster")), "song_id")  # noise counts with the nearest cluster
    a, b = (named.select("probe_no", "cluster", F.col("song_id").alias(f"song_{x}")) for x in "ab")
    return a.join(b, ["probe_no", "cluster"]).filter("song_a < song_b").select("probe_no", "song_a", "song_b")


def p7_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters.describe(_clusters(spark, d), "song_id", FEATURES)


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_texts(table(spark, d, "documents"))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.sized_documents(table(spark, d, "documents")), table(spark, d, "mix_targets")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.infeasible(*_mix(spark, d)).select("source")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(*_mix(spark, d))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    sized, targets = _mix(spark, d)
    return mixing.shares(mixing.mix(sized, targets), targets)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(table(spark, d, "documents"), 2000, 100)


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_texts(table(spark, d, "documents"), 2000, 100)


def cluster_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of p7_clusters: every song that has all features is in one cluster or noise, and the clusters are four to seven."""
    found = clusters.describe(_clusters(spark, d), "song_id", FEATURES)
    return found.agg(F.sum("size").alias("songs"), F.count_if(F.col("cluster") >= 0).between(4, 7).alias("as_many"), F.max(F.when(F.col("cluster") < 0, F.col("size")).otherwise(0)).alias("_noise"), F.sum("close").alias("_close")).select(
        "songs", "as_many", (F.col("_noise") == F.col("_close")).alias("noise_is_near")
    )


def packing_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of p8_packed: all texts, those that fit uncut, nothing above 2,000 tokens or its window, little unused where
    there are enough texts (a thousand)."""
    packed = staged(p8_packed(spark, d), "packed")
    texts = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("k"))
    cut = texts.agg(F.count(F.lit(1)).alias("texts"), F.count_if((F.col("k") > 1) & (F.col("n") <= 2000)).alias("cut_small"))
    windows = packed.filter("container is not null").groupBy("container", "window", "tier").agg(F.sum("n_tokens").alias("n"))
    full = windows.groupBy("container").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > F.floor(F.lit(2000) / F.pow(F.lit(2), F.col("tier")))).alias("over"))
    held = full.agg(F.coalesce(F.count_if((F.col("n") > 2000) | (F.col("over") > 0)), F.lit(0)).alias("overfull"), (F.sum("n") >= F.count(F.lit(1)) * 2000 * 0.98 - 2000).alias("well_filled"))
    return cut.crossJoin(F.broadcast(held))  # one row each


def mix_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of p9_shares: each source with texts has its share among those, within 0.01 where there are enough texts (a thousand), and
    no text has more copies than allowed."""
    found = staged(p9_shares(spark, d), "shares")
    whole = found.agg(F.sum(F.when(F.col("mix_tokens") > 0, F.col("target_share"))).alias("_whole"))
    share = F.when(F.col("mix_tokens") > 0, F.col("target_share") / F.col("_whole")).otherwise(0.0)
    joined = found.crossJoin(F.broadcast(whole))  # whole: one row
    return joined.select("source", (F.col("texts") > 0).alias("has_texts"), (F.abs(F.col("actual_share") - share) < 0.01).alias("share_kept"), (F.col("most_copies") <= F.col("max_repeats")).alias("repeats_kept"))


def split_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """doc_id and the MD5 of each text, put together from the pieces of p10_pieces without their overlaps where it has any."""
    pieces = p10_pieces(spark, d).select("doc_id", F.struct("piece_no", "start", "end", "piece").alias("p"))
    whole = pieces.groupBy("doc_id").agg(F.sort_array(F.collect_list("p")).alias("p"))  # a text and its overlaps
    new = F.transform("p", lambda x, i: F.when(i == 0, x["piece"]).otherwise(F.substring(x["piece"], (F.get(F.col("p"), i - 1)["end"] - x["start"] + 1).cast("int"), F.length(x["piece"]))))
    joined = table(spark, d, "documents").select("doc_id", "text").join(whole.select("doc_id", F.array_join(new, "").alias("again")), "doc_id", "left")
    return joined.select("doc_id", F.md5(F.coalesce("again", "text", F.lit(""))).alias("md5"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (p1_percentiles, p1_summaries, p2_found, p2_overlaps, p2_all_overlaps, hot_overlaps, p3_found, p3_pairs, p3_all_pairs, p3_incremental, p5_found, p5_links, p5_all_links, similar_baskets_by_rarest, p7_found, p7_clusters, p8_packed, p9_found, p9_mix, p9_shares, p10_found, p10_pieces, cluster_checks, packing_checks, mix_checks, split_round_trip)
    return {f.__name__: f for f in own}
