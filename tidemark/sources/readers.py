"""Sources: lines, delimited files, tables, and the tables' adapters to the operators' inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import known, number, trimmed
from ..schemas import FLIGHT_TEXT, LISTEN_TEXT


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files below `path` as `value`; files that begin with `_` are left out."""
    return spark.read.text(path)


def delimited(spark: SparkSession, path: str, schema: T.StructType = FLIGHT_TEXT, malformed: str = "PERMISSIVE", multi_line: bool = False) -> DataFrame:
    """Comma-separated files without a header, quoted with `"`; `malformed` is PERMISSIVE, DROPMALFORMED or FAILFAST.

    Quoted fields may hold delimiters and, with `multi_line`, line breaks; a file is then read by one task. To separate bad records with
    a reason see `records`.
    """
    return spark.read.csv(path, schema=schema, header=False, quote='"', escape='"', multiLine=multi_line, mode=malformed)


def tab_separated(spark: SparkSession, path: str, schema: T.StructType = LISTEN_TEXT) -> DataFrame:
    """Tab-separated lines without quoting: what stands between tabs is the value, empty ones too. Missing fields are null, as are
    texts that aren't of their column's type; fields beyond the schema are ignored."""
    fields = F.split("value", "\t", -1)
    return spark.read.text(path).select(*[F.get(fields, F.lit(i)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)])


def itemset_lines(spark: SparkSession, path: str) -> DataFrame:
    """items, users from lines `item,item<tab>user,user`; blanks around an entry are trimmed, lines without a tab left out."""
    entries = lambda i: F.transform(F.split(F.get(F.split("value", "\t", -1), F.lit(i)), ","), trimmed)
    return spark.read.text(path).filter(F.contains("value", F.lit("\t"))).select(entries(0).alias("items"), F.transform(entries(1), lambda x: x.try_cast("bigint")).alias("users"))


def wide_table(spark: SparkSession, path: str) -> DataFrame:
    """A table written by `writers.write_wide_table`; a filter on `year` reads its partitions only."""
    return spark.read.parquet(path)


def parameter_lines(spark: SparkSession, path: str, lines_per_task: int = 4) -> DataFrame:
    """Rows k, initial from `k,initial` lines, spread so that a task gets about `lines_per_task`."""
    rows = spark.read.csv(path, schema="k int, initial int")
    return rows.repartition(max(1, -(-rows.count() // lines_per_task)))


def flights_of(raw: DataFrame) -> DataFrame:
    """Flights from the columns of the flights table: texts parsed once; what isn't a number is null, NaN delays too."""
    return raw.select(
        "row_id", number(F.col("yearstring"), "int").alias("year"), number(F.col("monthstring"), "int").alias("month"), "flight_date", F.col("unique_carrier").alias("carrier"),
        "origin", "dest", number(F.col("dep_time"), "int").alias("dep_time"), number(F.col("arr_time"), "int").alias("arr_time"), known(F.col("arr_delay_minutes")).alias("arr_delay"),
        number(F.col("cancelled"), "double").alias("cancelled"), number(F.col("diverted"), "double").alias("diverted"),
    )


def flights_of_text(text: DataFrame, row_id: Column | None = None) -> DataFrame:
    """Flights from the 55 text columns of a flight record; row_id is a surrogate, unique within the frame but not dense, if not given."""
    return text.select(
        (F.monotonically_increasing_id() if row_id is None else row_id).alias("row_id"), number(F.col("Year"), "int").alias("year"), number(F.col("Month"), "int").alias("month"), F.col("FlightDate").try_cast("date").alias("flight_date"),
        F.col("UniqueCarrier").alias("carrier"), F.col("Origin").alias("origin"), F.col("Dest").alias("dest"), number(F.col("DepTime"), "int").alias("dep_time"), number(F.col("ArrTime"), "int").alias("arr_time"),
        number(F.col("ArrDelayMinutes"), "double").alias("arr_delay"), number(F.col("Cancelled"), "double").alias("cancelled"), number(F.col("Diverted"), "double").alias("diverted"),
    )


def points_of(raw: DataFrame, id_col: str, hotness: str, loudness: str, beat: str, missing_as_zero: bool = True) -> DataFrame:
    """Points id, hotness, loudness, beat. A feature that is null, NaN or no number is 0, or drops the row if not `missing_as_zero`."""
    kept = raw.select(F.col(id_col).cast("string").alias("id"), *[known(F.col(c).try_cast("double")).alias(n) for c, n in ((hotness, "hotness"), (loudness, "loudness"), (beat, "beat"))])
    return kept.na.fill(0.0, ["hotness", "loudness", "beat"]) if missing_as_zero else kept.na.drop(subset=["hotness", "loudness", "beat"])
