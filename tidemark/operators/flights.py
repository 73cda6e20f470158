"""Two-leg connections: leg 1 from an airport, leg 2 to another, the same day, in the order of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIRST = (2007, 6)
LAST = (2008, 5)


def in_period(year: Column, month: Column, first: tuple[int, int] = FIRST, last: tuple[int, int] = LAST) -> Column:
    """(year, month) lies in the closed range."""
    at = year * 12 + month
    return at.between(first[0] * 12 + first[1], last[0] * 12 + last[1])


def flew() -> Column:
    """Neither cancelled nor diverted; a flag that is no number counts as not flown."""
    return (F.col("cancelled") == 0) & (F.col("diverted") == 0)


def legs(flights: DataFrame, start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """First and second legs that flew and have all that a connection needs; column names end in 1 and 2."""
    flown = flights.filter(flew() & F.col("arr_time").isNotNull() & F.col("dep_time").isNotNull() & F.col("arr_delay").isNotNull() & (F.length("origin") > 0) & (F.length("dest") > 0))
    named = lambda df, n: df.select(*[F.col(c).alias(f"{c}{n}") for c in ("year", "month", "flight_date", "origin", "dest", "dep_time", "arr_time", "arr_delay")])
    return named(flown.filter(F.col("origin") == start), 1), named(flown.filter(F.col("dest") == end), 2)


def connect(first: DataFrame, second: DataFrame, tasks: int | None = None) -> DataFrame:
    """Legs that meet: the same day and airport, the first landing before the second departs. Null keys don't meet. With `tasks` both
    sides are placed among so many tasks by day and airport, which the join keeps; else the session and the planner decide."""
    if tasks:
        first, second = first.repartition(tasks, "flight_date1", "dest1"), second.repartition(tasks, "flight_date2", "origin2")
    return first.join(second, (F.col("flight_date1") == F.col("flight_date2")) & (F.col("dest1") == F.col("origin2")) & (F.col("arr_time1") < F.col("dep_time2")))


def connection_delays(flights: DataFrame, start: str = "ORD", end: str = "JFK", first: tuple[int, int] = FIRST, last: tuple[int, int] = LAST, tasks: int | None = None) -> DataFrame:
    """flight_date, total_delay for each connection. Repeated flights give repeated connections."""
    one, two = legs(flights.filter(in_period(F.col("year"), F.col("month"), first, last)), start, end)
    return connect(one, two, tasks).select(F.col("flight_date1").alias("flight_date"), (F.col("arr_delay1") + F.col("arr_delay2")).alias("total_delay"))


def connection_delays_filtered_late(flights: DataFrame, both: bool, start: str = "ORD", end: str = "JFK", first: tuple[int, int] = FIRST, last: tuple[int, int] = LAST) -> DataFrame:
    """As `connection_delays` with the period asked of the joined rows: of both legs, or of the first only.

    The plans of the former are the same after pushdown. The latter agrees where a flight's year and month are those of its date.
    """
    met = connect(*legs(flights, start, end)).filter(in_period(F.col("year1"), F.col("month1"), first, last))
    if both:
        met = met.filter(in_period(F.col("year2"), F.col("month2"), first, last))
    return met.select(F.col("flight_date1").alias("flight_date"), (F.col("arr_delay1") + F.col("arr_delay2")).alias("total_delay"))


def mean_delay(delays: DataFrame, value: str = "total_delay") -> DataFrame:
    """avg_delay, one row; none where there is no value."""
    return count_and_mean(delays, value).select("avg_delay")


def count_and_mean(delays: DataFrame, value: str = "total_delay") -> DataFrame:
    """cnt, avg_delay over the rows that have a value; no row where there is none."""
    found = delays.agg(F.count(value).alias("cnt"), F.sum(value).alias("_sum")).filter("cnt > 0")
    return found.select("cnt", F.round(F.col("_sum") / F.col("cnt"), 6).alias("avg_delay"))
