"""Schemas of the inputs."""

from __future__ import annotations

from pyspark.sql import types as T

# fixed values: the order of the columns of a flight record
FLIGHT_COLUMNS = [
    "Year", "Quarter", "Month", "DayofMonth", "DayOfWeek", "FlightDate", "UniqueCarrier", "AirlineID", "Carrier", "TailNum",
    "FlightNum", "Origin", "OriginCityName", "OriginState", "OriginStateFips", "OriginStateName", "OriginWac", "Dest",
    "DestCityName", "DestState", "DestStateFips", "DestStateName", "DestWac", "CRSDepTime", "DepTime", "DepDelay",
    "DepDelayMinutes", "DepDel15", "DepartureDelayGroups", "DepTimeBlk", "TaxiOut", "WheelsOff", "WheelsOn", "TaxiIn",
    "CRSArrTime", "ArrTime", "ArrDelay", "ArrDelayMinutes", "ArrDel15", "ArrivalDelayGroups", "ArrTimeBlk", "Cancelled",
    "CancellationCode", "Diverted", "CRSElapsedTime", "ActualElapsedTime", "AirTime", "Flights", "Distance",
    "DistanceGroup", "CarrierDelay", "WeatherDelay", "NASDelay", "SecurityDelay", "LateAircraftDelay",
]

#: A flight record as text.
FLIGHT_TEXT = T.StructType([T.StructField(c, T.StringType()) for c in FLIGHT_COLUMNS])

#: Listens: who heard what.
LISTEN_TEXT = T.StructType([T.StructField("user", T.StringType()), T.StructField("song", T.StringType())])
