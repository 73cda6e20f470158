"""Mean delays per carrier and month, and the keyed table of flights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import two_digits


def row_key() -> Column:
    """`year,carrier,MM,row_id`: keys sort by year, carrier and month, and the surrogate keeps them apart."""
    return F.concat_ws(",", F.col("year").cast("string"), F.col("carrier"), two_digits(F.col("month")), F.col("row_id").cast("string"))


def keyed_flights(flights: DataFrame) -> DataFrame:
    """Flights with their row_key; rows whose key lacks a part are left out."""
    return flights.filter("year is not null and carrier is not null and month is not null and row_id is not null").withColumn("row_key", row_key())


def key_scan(keyed: DataFrame, year: int = 2008) -> DataFrame:
    """row_key, arr_delay of a year's flights that weren't cancelled and have a delay: a scan by key prefix with filters at the source."""
    return keyed.filter((F.col("year") == year) & (F.col("cancelled") == 0) & F.col("arr_delay").isNotNull()).select("row_key", "arr_delay")


def monthly_means(flights: DataFrame, year: int = 2008) -> DataFrame:
    """carrier, month, avg_delay: the mean rounded up, of the year's flights that weren't cancelled and have a delay."""
    kept = flights.filter((F.col("year") == year) & (F.col("cancelled") == 0) & F.col("arr_delay").isNotNull())
    return kept.groupBy("carrier", "month").agg(F.ceil(F.sum("arr_delay") / F.count("arr_delay")).cast("int").alias("avg_delay"))


def nested_means(flights: DataFrame, year: int = 2008) -> DataFrame:
    """carrier, delays: `(month,mean),` for each of its months, ascending. A carrier has at most a dozen entries."""
    listed = F.sort_array(F.collect_list(F.struct("month", "avg_delay")))
    nested = monthly_means(flights, year).groupBy("carrier").agg(listed.alias("m"))
    entry = lambda x: F.concat(F.lit("("), x["month"].cast("string"), F.lit(","), x["avg_delay"].cast("string"), F.lit("),"))
    return nested.select("carrier", F.array_join(F.transform("m", entry), "").alias("delays"))
