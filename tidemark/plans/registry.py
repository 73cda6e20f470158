"""Queries by name: (session, folder of tables) -> DataFrame. Their SQL is in `sql`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import rendered, two_digits
from ..operators import carrier_month, flights, itemsets, kmeans, skew, wordcount
from ..runtime import scratch, table
from ..sinks import writers
from ..sources import readers, records
from . import sql

GRID = [(k, initial) for k in (4, 5, 6, 7) for initial in range(3)]


def _flights(spark: SparkSession, d: str) -> DataFrame:
    return readers.flights_of(table(spark, d, "flights"))


def wc_counts(spark: SparkSession, d: str) -> DataFrame:
    return wordcount.word_counts(table(spark, d, "documents"), "text")


def wc_by_letter(spark: SparkSession, d: str) -> DataFrame:
    return wordcount.letter_totals(table(spark, d, "documents"), "text")


def flight_pairs(spark: SparkSession, d: str) -> DataFrame:
    return flights.connection_delays(_flights(spark, d))


def flight_avg_filter_first(spark: SparkSession, d: str) -> DataFrame:
    return flights.mean_delay(flights.connection_delays(_flights(spark, d)))


def flight_avg_join_first_v1(spark: SparkSession, d: str) -> DataFrame:
    return flights.mean_delay(flights.connection_delays_filtered_late(_flights(spark, d), both=True))


def flight_avg_join_first_v2(spark: SparkSession, d: str) -> DataFrame:
    return flights.mean_delay(flights.connection_delays_filtered_late(_flights(spark, d), both=False))


def flight_count_avg(spark: SparkSession, d: str) -> DataFrame:
    return flights.count_and_mean(flights.connection_delays(_flights(spark, d)))


def connections_count_avg(spark: SparkSession, d: str) -> DataFrame:
    return flights.count_and_mean(table(spark, d, "connections"))


def carrier_month_flat(spark: SparkSession, d: str) -> DataFrame:
    return carrier_month.monthly_means(_flights(spark, d))


def carrier_month_nested(spark: SparkSession, d: str) -> DataFrame:
    return carrier_month.nested_means(_flights(spark, d))


def flight_row_keys(spark: SparkSession, d: str) -> DataFrame:
    return carrier_month.keyed_flights(_flights(spark, d)).select("row_key", "year", "carrier", "month", "row_id")


def flight_key_scan(spark: SparkSession, d: str) -> DataFrame:
    return carrier_month.key_scan(carrier_month.keyed_flights(_flights(spark, d)))


def wide_table_scan(spark: SparkSession, d: str) -> DataFrame:
    """The keyed flights written as a table partitioned by year, and a year read from it."""
    path = scratch(spark, "wide")
    writers.write_wide_table(carrier_month.keyed_flights(_flights(spark, d)), path)
    return carrier_month.key_scan(readers.wide_table(spark, path))


def wide_table_upserts(spark: SparkSession, d: str) -> DataFrame:
    """Flights put into a wide table in two deliveries, by the key of the flight itself: a later delivery of a flight replaces it."""
    rows = table(spark, d, "flights").select("row_id", F.col("yearstring").try_cast("int").alias("year"), F.col("unique_carrier").alias("carrier"), F.col("monthstring").try_cast("int").alias("month"), "flight_date", "flight_num", "origin", "arr_delay_minutes", "loaded_at")
    keyed = rows.na.drop(subset=["year", "carrier", "month", "flight_date", "flight_num", "origin", "row_id"])
    keyed = keyed.withColumn("row_key", F.concat_ws(",", F.col("year").cast("string"), "carrier", two_digits(F.col("month")), F.col("flight_date").cast("string"), F.col("flight_num").cast("string"), "origin"))
    early = F.coalesce(F.col("loaded_at") < F.lit("2008-03-01").cast("timestamp_ntz"), F.lit(True))
    path = scratch(spark, "wide")
    for delivery in (keyed.filter(early), keyed.filter(~early)):
        writers.upsert_wide_table(delivery, path, ["loaded_at", "row_id"])
    return readers.wide_table(spark, path).select("row_key", "row_id", "year", "arr_delay_minutes")


def letter_sink(spark: SparkSession, d: str) -> DataFrame:
    """Word counts written to a folder for each letter and read again."""
    path = scratch(spark, "letters")
    writers.write_by_letter(wc_counts(spark, d), path, tasks=5)
    return spark.read.parquet(path).select("letter", "word", "cnt")


def text_sink(spark: SparkSession, d: str) -> DataFrame:
    """Monthly means written as lines of text and read again."""
    path = scratch(spark, "text")
    writers.write_text(carrier_month_flat(spark, d).filter("carrier is not null"), path)
    return readers.text_lines(spark, path)


def _flight_files(spark: SparkSession, d: str) -> DataFrame:
    """Flights from CSV files: the flight lines that load, written as they are and read as delimited files."""
    path = scratch(spark, "csv")
    records.parsed(table(spark, d, "flight_lines"), records.FLIGHTS).filter("loads").select("raw_line").write.text(path)
    return readers.flights_of_text(readers.delimited(spark, path, multi_line=True))


def csv_file_carrier_month(spark: SparkSession, d: str) -> DataFrame:
    return carrier_month.monthly_means(_flight_files(spark, d))


def csv_file_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The two-leg connections of the flights in the files."""
    return flights.connection_delays(_flight_files(spark, d))


def transactions_tabs(spark: SparkSession, d: str) -> DataFrame:
    """Listens written with tabs, read again, and gathered to transactions."""
    path = scratch(spark, "tabs")
    writers.write_tabs(table(spark, d, "listens").select("user_key", "song").filter("user_key is not null and song is not null"), path)
    return itemsets.transactions(readers.tab_separated(spark, path)).select("user", "id", rendered(F.col("songs")).alias("songs"))


def csv_carrier_month(spark: SparkSession, d: str) -> DataFrame:
    """Monthly means of the flight lines that load."""
    rows = records.loaded(table(spark, d, "flight_lines"), records.FLIGHTS)
    named = {"year": "Year", "month": "Month", "flight_date": "FlightDate", "carrier": "UniqueCarrier", "origin": "Origin", "dest": "Dest", "dep_time": "DepTime", "arr_time": "ArrTime", "arr_delay": "ArrDelayMinutes", "cancelled": "Cancelled", "diverted": "Diverted"}
    return carrier_month.monthly_means(rows.select(F.col("line_id").alias("row_id"), *[F.col(old).alias(new) for new, old in named.items()]))


def csv_points(spark: SparkSession, d: str) -> DataFrame:
    """Points of the song lines that load; an empty feature is 0."""
    return readers.points_of(records.loaded(table(spark, d, "song_lines"), records.SONGS), "song_id", "artist_hotness", "loudness", "beat")


def tail_supports(spark: SparkSession, d: str) -> DataFrame:
    """Supports of all items, repeated elements counted and not: item, support, users."""
    return _held(spark, d).groupBy("item").agg(F.count(F.lit(1)).alias("support"), F.countDistinct("uid").alias("users"))


def transactions(spark: SparkSession, d: str) -> DataFrame:
    return itemsets.transactions(table(spark, d, "listens"), "user_key", "song").select("user", "id", rendered(F.col("songs")).alias("songs"))


def _held(spark: SparkSession, d: str) -> DataFrame:
    return itemsets.holdings(table(spark, d, "user_transactions"), "tx_id", "songs")


def frequent_items(spark: SparkSession, d: str) -> DataFrame:
    rows = itemsets.frequent_items(_held(spark, d))
    found = itemsets.listed(rows).join(rows.select("items", "support").distinct(), "items")
    return found.select(F.col("items")[0].alias("item"), "support", rendered(F.col("users")).alias("users"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return itemsets.frequent_pairs(itemsets.frequent_items(_held(spark, d)))


def _shown(level: DataFrame) -> DataFrame:
    return itemsets.supports(level).select(rendered(F.col("items")).alias("itemset"), "support")


def _pairs_shown(pairs: DataFrame) -> DataFrame:
    return pairs.select(rendered(F.col("items")).alias("pair"), F.size("users").cast("bigint").alias("support"), rendered(F.col("users")).alias("users"))


def frequent_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs_shown(itemsets.listed(_pairs(spark, d)))


def itemset_lines(spark: SparkSession, d: str) -> DataFrame:
    """frequent_pairs written as lines of items and users, and read from them."""
    path = scratch(spark, "lines")
    writers.write_text(itemsets.listed(_pairs(spark, d)), path)
    return _pairs_shown(readers.itemset_lines(spark, path))


def _level(size: int) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _shown(itemsets.itemsets(_pairs(spark, d), size)[size])


def itemset_levels(spark: SparkSession, d: str) -> DataFrame:
    """Itemsets of three to seven songs, from the numbered outputs of the passes."""
    folder = scratch(spark, "levels")
    itemsets.itemsets(_pairs(spark, d), 7, folder=folder)
    return spark.read.parquet(folder).groupBy("pass", "items").agg(F.count(F.lit(1)).alias("support")).select("pass", rendered(F.col("items")).alias("itemset"), "support")


def itemsets_unpruned_k3(spark: SparkSession, d: str) -> DataFrame:
    return _shown(itemsets.next_level(_pairs(spark, d), 3, prune=False))


def itemsets_any_case_k3(spark: SparkSession, d: str) -> DataFrame:
    return _shown(itemsets.next_level(_pairs(spark, d), 3, ignore_case=True))


def _points(spark: SparkSession, d: str) -> DataFrame:
    return readers.points_of(table(spark, d, "song_features"), "song_id", "artist_hotness", "loudness", "beat")


def _starts(spark: SparkSession, d: str, grid: list[tuple[int, int]]) -> tuple[DataFrame, dict]:
    points = _points(spark, d)
    placed = itemsets.numbered(points, ["id", "hotness", "loudness", "beat"], "row_no")
    seeds = kmeans.seed_rows(points.count())
    at = kmeans.seeds_at(placed, sorted({r for k, i in grid for r in seeds[i : i + k]}))
    by_row = dict(zip(sorted({r for k, i in grid for r in seeds[i : i + k]}), at.values()))
    return points, {(k, i): {n + 1: by_row[r] for n, r in enumerate(seeds[i : i + k])} for k, i in grid}


def kmeans_seeds(spark: SparkSession, d: str) -> DataFrame:
    points, starts = _starts(spark, d, [(4, 0)])
    return points.sparkSession.createDataFrame([(c, *x) for c, x in starts[4, 0].items()], "cluster int, hotness double, loudness double, beat double")


def kmeans_sampled_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Seeds from a sample of 0.5 % of the points; an error where that is fewer than four."""
    points = _points(spark, d)
    return points.sparkSession.createDataFrame([(c, *x) for c, x in kmeans.sampled_seeds(points, 4).items()], "cluster int, hotness double, loudness double, beat double")


def kmeans_assign(spark: SparkSession, d: str) -> DataFrame:
    points, starts = _starts(spark, d, [(4, 0)])
    return kmeans.assign(points, starts[4, 0]).select("id", "cluster")


def kmeans_step(spark: SparkSession, d: str) -> DataFrame:
    points, starts = _starts(spark, d, [(4, 0)])
    return kmeans.update(kmeans.assign(points, starts[4, 0])).select("cluster", *[F.round(f, 6).alias(f) for f in kmeans.FEATURES], "n")


def kmeans_threshold(spark: SparkSession, d: str) -> DataFrame:
    points, starts = _starts(spark, d, GRID)
    found = kmeans.centers_frame(points, kmeans.until_close(points, starts))
    return found.select("k", "initial", "cluster", *[F.round(f, 6).alias(f) for f in kmeans.FEATURES], "n")


def kmeans_sweep(spark: SparkSession, d: str) -> DataFrame:
    points, starts = _starts(spark, d, GRID)
    return kmeans.sizes_frame(points, kmeans.until_still(points, starts))


def kmeans_parameter_lines(spark: SparkSession, d: str) -> DataFrame:
    """kmeans_sweep with its runs given as lines of parameters."""
    path = scratch(spark, "parameters")
    writers.write_text(spark.createDataFrame(GRID, "k int, initial int"), path, ",")
    points, starts = _starts(spark, d, kmeans.grid_of(readers.parameter_lines(spark, path)))
    return kmeans.sizes_frame(points, kmeans.until_still(points, starts))


def _rejected(spark: SparkSession, d: str, listed: bool) -> DataFrame:
    feeds = [records.rejected(table(spark, d, feed.name), feed, listed) for feed in (records.FLIGHTS, records.SONGS)]
    return feeds[0].unionByName(feeds[1])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _rejected(spark, d, False).select("feed", "line_id", "reason")


def p4_rejected(spark: SparkSession, d: str) -> DataFrame:
    """Rejected lines with the number of edits and a cheapest list of them, or the value that isn't valid."""
    return _rejected(spark, d, True)


def p4_edits(spark: SparkSession, d: str) -> DataFrame:
    """Rejected lines without a quote, whose least edits are known by their delimiters, with what is wrong with a value."""
    bare = lambda feed: table(spark, d, feed.name).filter("raw_line is null or not contains(raw_line, '\"')")
    feeds = [records.rejected(bare(feed), feed) for feed in (records.FLIGHTS, records.SONGS)]
    return feeds[0].unionByName(feeds[1]).select("feed", "line_id", "reason", "edits", F.when(F.col("reason") == "value", F.col("operations")).alias("wrong"))


def p4_flights(spark: SparkSession, d: str) -> DataFrame:
    return records.loaded(table(spark, d, "flight_lines"), records.FLIGHTS)


def p4_songs(spark: SparkSession, d: str) -> DataFrame:
    found = records.loaded(table(spark, d, "song_lines"), records.SONGS)
    return found.withColumn("others", rendered(F.col("others"), "|"))


def _key_statistics(spark: SparkSession, d: str) -> DataFrame:
    carriers = skew.key_statistics(table(spark, d, "flights"), "unique_carrier", "arr_delay_minutes", ["row_id"])
    dummies = skew.key_statistics(table(spark, d, "connections"), "dummy", "total_delay", ["pair_id"])
    named = lambda df, name: df.select(F.lit(name).alias("field_name"), "*")
    return named(carriers, "unique_carrier").unionByName(named(dummies, "dummy"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _key_statistics(spark, d).filter("is_heavy").select("field_name", "key_value")


def p6_statistics(spark: SparkSession, d: str) -> DataFrame:
    return _key_statistics(spark, d).select("field_name", "key_value", "n", "n_value", F.round("total", 3).alias("total"), F.round("mean", 6).alias("mean"), "is_heavy")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        wc_counts, wc_by_letter, flight_pairs, flight_avg_filter_first, flight_avg_join_first_v1, flight_avg_join_first_v2, flight_count_avg, connections_count_avg, carrier_month_flat,
        carrier_month_nested, flight_row_keys, flight_key_scan, wide_table_scan, wide_table_upserts, letter_sink, text_sink, transactions_tabs, csv_carrier_month, csv_file_carrier_month, csv_file_pairs, csv_points, tail_supports, kmeans_sampled_seeds, transactions, frequent_items, frequent_pairs, itemset_lines, itemset_levels, itemsets_unpruned_k3, itemsets_any_case_k3, kmeans_seeds, kmeans_assign, kmeans_step,
        kmeans_threshold, kmeans_sweep, kmeans_parameter_lines, p4_found, p4_rejected, p4_edits, p4_flights, p4_songs, p6_found, p6_statistics,
    )
    return {f.__name__: f for f in own} | {f"itemsets_k{k}": _level(k) for k in range(3, 8)}


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
