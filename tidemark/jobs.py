"""Jobs on files: `python -m tidemark.jobs <job> <inputs> <output>`, or `run(spark, arguments)` within a session."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import rendered
from .operators import carrier_month, flights, itemsets, kmeans, wordcount
from .sinks import writers
from .sources import readers


def _flights(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    return readers.flights_of_text(readers.delimited(spark, path, multi_line=multi_line))


def _word_count(spark: SparkSession, a: argparse.Namespace) -> None:
    writers.write_by_letter(wordcount.word_counts(readers.text_lines(spark, a.input)), a.output, tasks=a.tasks)


def _connections(spark: SparkSession, a: argparse.Namespace) -> None:
    delays = flights.connection_delays(_flights(spark, a.input, a.multi_line), a.start, a.end, tasks=a.tasks)
    writers.write_text(flights.count_and_mean(delays), a.output)


def _populate(spark: SparkSession, a: argparse.Namespace) -> None:
    text = readers.delimited(spark, a.input, multi_line=a.multi_line)
    # a hash of the whole record keeps keys apart, and the same record in its place if a file is loaded again
    writers.upsert_wide_table(carrier_month.keyed_flights(readers.flights_of_text(text, F.xxhash64(*text.columns))), a.output, ["row_id"])


def _carrier_month(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = readers.wide_table(spark, a.input) if a.table else _flights(spark, a.input, a.multi_line)
    writers.write_text(carrier_month.nested_means(rows, a.year), a.output)


def _transactions(spark: SparkSession, a: argparse.Namespace) -> None:
    found = itemsets.transactions(readers.tab_separated(spark, a.input))
    writers.write_text(found.select("user", "id", rendered(F.col("songs")).alias("songs")), a.output)


def _itemsets(spark: SparkSession, a: argparse.Namespace) -> None:
    held = itemsets.holdings(itemsets.transactions(readers.tab_separated(spark, a.input)))
    pairs = itemsets.frequent_pairs(itemsets.frequent_items(held, a.item_support), a.pair_support)
    itemsets.itemsets(pairs, a.last, folder=a.output)


def _kmeans(spark: SparkSession, a: argparse.Namespace) -> None:
    points = readers.points_of(spark.read.csv(a.input), "_c0", "_c1", "_c7", "_c8")
    placed = itemsets.numbered(points, ["id", *kmeans.FEATURES], "row_no")
    rows = points.count()
    starts = {(k, i): kmeans.seeds_at(placed, [(i + n) % rows + 1 for n in range(k)]) for k, i in kmeans.grid_of(readers.parameter_lines(spark, a.parameters))}
    writers.write_text(kmeans.sizes_frame(points, kmeans.until_still(points, starts)), a.output)


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tidemark.jobs", description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)

    def job(name: str, run, text: str, csv: bool = False) -> argparse.ArgumentParser:
        own = jobs.add_parser(name, help=text)
        own.set_defaults(run=run)
        own.add_argument("input")
        own.add_argument("output")
        if csv:
            own.add_argument("--multi-line", action="store_true", help="quoted fields may hold line breaks")
        return own

    job("word-count", _word_count, "words of text files by first letter").add_argument("--tasks", type=int, help="tasks that write")
    own = job("connections", _connections, "number and mean delay of two-leg connections in flight files", csv=True)
    own.add_argument("--start", default="ORD")
    own.add_argument("--end", default="JFK")
    own.add_argument("--tasks", type=int, help="tasks that join")
    job("populate", _populate, "flight files into a wide table, which is created if it isn't there", csv=True)
    own = job("carrier-month", _carrier_month, "mean delays per carrier and month from flight files or a wide table", csv=True)
    own.add_argument("--table", action="store_true", help="the input is a wide table")
    own.add_argument("--year", type=int, default=2008)
    job("transactions", _transactions, "baskets of users from lines of user and song")
    own = job("itemsets", _itemsets, "frequent itemsets from lines of user and song, a numbered folder for each size")
    own.add_argument("--item-support", type=int, default=50)
    own.add_argument("--pair-support", type=int, default=10)
    own.add_argument("--last", type=int, default=7)
    job("k-means", _kmeans, "cluster sizes of song files for each parameter line (k, first start row less one)").add_argument("--parameters", required=True)
    return parser


def run(spark: SparkSession, arguments: Sequence[str]) -> None:
    """Run the job that `arguments` name, as on the command line."""
    parsed = _arguments().parse_args(arguments)
    parsed.run(spark, parsed)


if __name__ == "__main__":
    import sys

    run(SparkSession.builder.appName("tidemark").getOrCreate(), sys.argv[1:])
