import pytest
from pyspark.sql import types as T

from tidemark.operators import carrier_month
from tidemark.sinks import writers
from tidemark.sources import readers

from .conftest import SMALL, same_rows


def test_delimited_and_tabs(spark, tmp_path):
    values = [str(i) for i in range(55)]
    values[12], values[0], values[2], values[5], values[24], values[35], values[37] = '"Chicago, IL"', "2008", "3", "2008-03-01", "0905", "", "12.00"
    (tmp_path / "f.csv").write_text(",".join(values) + "\nbad line\n")
    text = readers.delimited(spark, str(tmp_path / "f.csv"))
    assert text.filter("Year = '2008'").first().OriginCityName == "Chicago, IL"
    row = readers.flights_of_text(text).filter("year = 2008").first()
    assert (row.dep_time, row.arr_time, row.arr_delay, str(row.flight_date)) == (905, None, 12.0, "2008-03-01")
    (tmp_path / "l.tsv").write_text('u1\t"S\nu2\tT\n')
    same_rows(readers.tab_separated(spark, str(tmp_path / "l.tsv")).collect(), [("u1", '"S'), ("u2", "T")])
    (tmp_path / "p.csv").write_text("".join(f"4,{i}\n" for i in range(9)))
    assert readers.parameter_lines(spark, str(tmp_path / "p.csv")).rdd.getNumPartitions() == 3


def test_tabs_round_trip(spark, tmp_path):
    df = spark.createDataFrame([('a"b', ""), ('"q"', "\\"), ("", None)], "user string, song string")
    writers.write_tabs(df, f"{tmp_path}/c")
    same_rows(readers.tab_separated(spark, f"{tmp_path}/c").collect(), [('a"b', ""), ('"q"', "\\"), ("", "")])
    with pytest.raises(Exception, match="holds a tab"):
        writers.write_tabs(spark.createDataFrame([("x\ty", "z")], "user string, song string"), f"{tmp_path}/d")
    (tmp_path / "short.tsv").write_text("only\na\t7\textra\nb\tx\n")
    same_rows(readers.tab_separated(spark, str(tmp_path / "short.tsv"), T.StructType().add("k", T.StringType()).add("n", T.IntegerType())).collect(), [("only", None), ("a", 7), ("b", None)])


def test_files_are_split_unless_fields_hold_line_breaks(spark, tmp_path):
    values = ["2008"] + ["x" * 20] * 54
    (tmp_path / "f.csv").write_text((",".join(values) + "\n") * 3000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 20)
    try:
        assert readers.delimited(spark, str(tmp_path / "f.csv")).rdd.getNumPartitions() > 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    values[12] = '"Chicago,\nIL"'
    (tmp_path / "g.csv").write_text(",".join(values) + "\n")
    assert readers.delimited(spark, str(tmp_path / "g.csv"), multi_line=True).first().OriginCityName == "Chicago,\nIL"


def test_itemset_lines(spark, tmp_path):
    (tmp_path / "l.txt").write_text("A, B\t3,4\nno tab\n C\t5 ,x\n")
    same_rows([(r["items"], r.users) for r in readers.itemset_lines(spark, str(tmp_path / "l.txt")).collect()], [(["A", "B"], [3, 4]), (["C"], [5, None])])


def test_upserts(spark, tmp_path):
    def batch(*rows):
        return spark.createDataFrame(rows, "row_key string, year int, carrier string, month int, v string, at int")

    path = f"{tmp_path}/wide"
    writers.upsert_wide_table(batch(("2007,A", 2007, "A", 1, "old", 1), ("2008,A", 2008, "A", 1, "old", 1), ("2008,B", 2008, "B", 1, "older", 1), ("2008,B", 2008, "B", 1, "old", 2)), path, ["at"])
    kept = {f for f in (tmp_path / "wide" / "year=2007").iterdir()}
    writers.upsert_wide_table(batch(("2008,A", 2008, "A", 1, "new", 0), ("2009,C", 2009, "C", 2, "new", None)), path, ["at"])
    same_rows([(r.row_key, r.v) for r in readers.wide_table(spark, path).collect()], [("2007,A", "old"), ("2008,A", "new"), ("2008,B", "old"), ("2009,C", "new")])
    assert {f for f in (tmp_path / "wide" / "year=2007").iterdir()} == kept  # a year without changes isn't written again
    writers.upsert_wide_table(batch().limit(0), path, ["at"])
    assert readers.wide_table(spark, path).count() == 4


def test_text_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, ["x", "y"]), (None, 2, [])], "k string, n int, l array<string>")
    writers.write_text(df, f"{tmp_path}/t")
    same_rows([r.value for r in readers.text_lines(spark, f"{tmp_path}/t").collect()], ["a\t1\tx,y", "\t2\t"])
    writers.write_tabs(df.drop("l"), f"{tmp_path}/c")
    assert spark.read.text(f"{tmp_path}/c").count() == 2
    writers.write_levels({3: df, 4: df.limit(0)}, f"{tmp_path}/levels")
    assert spark.read.parquet(f"{tmp_path}/levels").filter("pass = 3").count() == 2


def test_letters(spark, tmp_path):
    writers.write_by_letter(spark.createDataFrame([("Map", 1), ("map", 2), ("old", 3)], "word string, cnt bigint"), f"{tmp_path}/w")
    assert sorted(p.name for p in (tmp_path / "w").glob("letter=*")) == ["letter=m", "letter=o"]


def test_wide_table_is_pruned_by_year(spark, tmp_path):
    keyed = carrier_month.keyed_flights(readers.flights_of(spark.read.parquet(f"{SMALL}/flights.parquet")))
    writers.write_wide_table(keyed, f"{tmp_path}/wide")
    scan = carrier_month.key_scan(readers.wide_table(spark, f"{tmp_path}/wide"))
    assert "PartitionFilters: [isnotnull(year" in scan._jdf.queryExecution().executedPlan().toString()
    assert scan.count() == carrier_month.key_scan(keyed).count()


def test_last_write_wins(spark):
    df = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("j", None, "only")], "key string, at int, v string")
    same_rows([(r.key, r.v) for r in writers.latest_by_key(df, ["key"], ["at"]).collect()], [("k", "new"), ("j", "only")])
