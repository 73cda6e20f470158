import random

import pytest

from tidemark import jobs
from tidemark.operators import flights

from .test_records import flight


def lines(spark, path):
    return sorted(r.value for r in spark.read.text(str(path)).collect())


@pytest.fixture()
def flight_file(tmp_path):
    rows = [flight(Year="2008", Month="2", FlightDate="2008-02-03", Origin=o, Dest=d, DepTime=t, ArrTime=a, ArrDelayMinutes=x, Cancelled="0.00", Diverted="0.00", OriginCityName="c", UniqueCarrier=c)
            for o, d, t, a, x, c in (("ORD", "BOS", "0700", "0900", "3.00", "AA"), ("BOS", "JFK", "1000", "1100", "4.00", "BB"), ("BOS", "JFK", "0800", "0830", "9.00", "AA"))]
    (tmp_path / "f.csv").write_text("\n".join(rows) + "\n")
    return str(tmp_path / "f.csv")


def test_words(spark, tmp_path):
    (tmp_path / "t.txt").write_text("map Map old cat\nmap\n")
    jobs.run(spark, ["word-count", str(tmp_path / "t.txt"), f"{tmp_path}/out", "--tasks", "3"])
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == [("Map", 1, "m"), ("map", 2, "m"), ("old", 1, "o")]


def test_flights(spark, tmp_path, flight_file):
    jobs.run(spark, ["connections", flight_file, f"{tmp_path}/c", "--tasks", "2"])
    assert lines(spark, f"{tmp_path}/c") == ["1\t7.0"]
    for _ in range(2):
        jobs.run(spark, ["populate", flight_file, f"{tmp_path}/wide"])
    jobs.run(spark, ["carrier-month", f"{tmp_path}/wide", f"{tmp_path}/m", "--table"])
    jobs.run(spark, ["carrier-month", flight_file, f"{tmp_path}/n"])
    assert lines(spark, f"{tmp_path}/m") == lines(spark, f"{tmp_path}/n") == ["AA\t(2,6),", "BB\t(2,4),"]


def test_itemsets(spark, tmp_path):
    (tmp_path / "l.tsv").write_text("".join(f"u{u:02d}\t{s}\n" for u in range(20) for s in "CAB"))
    jobs.run(spark, ["transactions", str(tmp_path / "l.tsv"), f"{tmp_path}/t"])
    assert lines(spark, f"{tmp_path}/t")[:2] == ["u00\t2\tA,B,C", "u01\t3\tA,B,C"]
    jobs.run(spark, ["itemsets", str(tmp_path / "l.tsv"), f"{tmp_path}/i", "--item-support", "10", "--last", "4"])
    found = spark.read.parquet(f"{tmp_path}/i").groupBy("pass", "items").count().collect()
    assert [tuple(r) for r in found] == [(3, ["A", "B", "C"], 20)]


def test_kmeans(spark, tmp_path):
    rng = random.Random(1)
    (tmp_path / "s.csv").write_text("".join(f"s{i:03d},{c + rng.random() / 9},x,x,x,x,x,{-c},{c * 9}\n" for i in range(40) for c in (1, 7)))
    (tmp_path / "p.csv").write_text("2,0\n2,3\nbad\n")
    jobs.run(spark, ["k-means", str(tmp_path / "s.csv"), f"{tmp_path}/k", "--parameters", str(tmp_path / "p.csv")])
    assert lines(spark, f"{tmp_path}/k") == ["2\t0\t40 40 ", "2\t3\t40 40 "]


def test_tasks_of_a_join(spark):
    df = spark.createDataFrame([], "year int, month int, flight_date date, origin string, dest string, dep_time int, arr_time int, arr_delay double, cancelled double, diverted double")
    assert flights.connection_delays(df, tasks=10)._jdf.queryExecution().toString().count("RepartitionByExpression [flight_date") >= 2
