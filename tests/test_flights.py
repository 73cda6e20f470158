import datetime

import pytest

from tidemark.operators import carrier_month, flights
from tidemark.sources import readers

from .conftest import SMALL, same_rows

D1, D2 = datetime.date(2007, 6, 1), datetime.date(2007, 6, 2)

FLIGHT = "row_id bigint, year int, month int, flight_date date, carrier string, origin string, dest string, dep_time int, arr_time int, arr_delay double, cancelled double, diverted double"


def flight(n, date=D1, origin="ORD", dest="ATL", dep=800, arr=1000, delay=10.0, cancelled=0.0, diverted=0.0, carrier="AA"):
    return (n, date.year if date else None, date.month if date else None, date, carrier, origin, dest, dep, arr, delay, cancelled, diverted)


@pytest.mark.parametrize(
    ("second", "pairs"),
    [
        (dict(), 1), (dict(dep=1000), 0), (dict(date=D2), 0), (dict(origin="BOS"), 0), (dict(cancelled=1.0), 0), (dict(diverted=1.0), 0), (dict(diverted=None), 0), (dict(delay=None), 0),
        (dict(dep=None), 0), (dict(arr=None), 0), (dict(date=None), 0), (dict(origin=None), 0),
    ],
)
def test_second_leg(spark, second, pairs):
    rows = [flight(1), flight(2, **(dict(origin="ATL", dest="JFK", dep=1030, arr=1200, delay=5.0) | second))]
    found = flights.connection_delays(spark.createDataFrame(rows, FLIGHT))
    same_rows(found.collect(), [(D1, 15.0)] * pairs)
    same_rows(flights.count_and_mean(found).collect(), [(1, 15.0)] * pairs)


@pytest.mark.parametrize(("date", "inside"), [((2007, 5, 31), 0), ((2007, 6, 1), 1), ((2007, 12, 31), 1), ((2008, 1, 1), 1), ((2008, 5, 31), 1), ((2008, 6, 1), 0)])
def test_period_in_three_orders(spark, date, inside):
    day = datetime.date(*date)
    rows = spark.createDataFrame([flight(1, day), flight(2, day, "ATL", "JFK", 1030, 1200, 5.0)], FLIGHT)
    for found in (flights.connection_delays(rows), flights.connection_delays_filtered_late(rows, True), flights.connection_delays_filtered_late(rows, False)):
        assert found.count() == inside


def test_late_filters_are_pushed_down(spark):
    raw = readers.flights_of(spark.read.parquet(f"{SMALL}/flights.parquet"))
    early, late = (flights.connection_delays(raw), flights.connection_delays_filtered_late(raw, True))
    plan = late._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Filter")  # the only filters are below the join
    assert sorted(map(tuple, early.collect())) == sorted(map(tuple, late.collect()))
    assert "EqualTo(origin,ORD)" in late._jdf.queryExecution().executedPlan().toString()


def test_carrier_months(spark):
    jan, feb, october = (datetime.date(2008, m, 1) for m in (1, 2, 10))
    rows = [flight(1, jan, delay=10.0), flight(2, jan, delay=11.0), flight(3, feb, delay=4.0), flight(4, october, delay=7.0), flight(5, jan, delay=None, carrier="UA"), flight(6, jan, cancelled=1.0), flight(7, datetime.date(2007, 1, 1))]
    df = spark.createDataFrame(rows, FLIGHT)
    same_rows(carrier_month.monthly_means(df).collect(), [("AA", 1, 11), ("AA", 2, 4), ("AA", 10, 7)])
    same_rows(carrier_month.nested_means(df).collect(), [("AA", "(1,11),(2,4),(10,7),")])
    keys = [r.row_key for r in carrier_month.keyed_flights(df).collect()]
    assert "2008,AA,01,1" in keys and "2008,AA,10,4" in keys
    same_rows(carrier_month.key_scan(carrier_month.keyed_flights(df)).collect(), [("2008,AA,01,1", 10.0), ("2008,AA,01,2", 11.0), ("2008,AA,02,3", 4.0), ("2008,AA,10,4", 7.0)])


def test_empty_tables(spark):
    none = spark.createDataFrame([], FLIGHT)
    assert flights.count_and_mean(flights.connection_delays(none)).count() == 0
    assert carrier_month.nested_means(none).count() == 0
