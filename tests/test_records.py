import csv
import io
import random

import pytest

from tidemark.sources import records
from tidemark.sources.records import minimum_edits

from .conftest import same_rows


@pytest.mark.parametrize(
    ("line", "fields", "exact", "found"),
    [
        ("a,b,c", 3, True, (0, 0)), ('"a,b",b,"c ""d"""', 3, True, (0, 0)), ("", 1, True, (0, 0)), ("", 3, True, (0, 2)), (None, 3, True, (0, 2)), ("a,b", 3, True, (0, 1)), ("a,b,c,d", 3, True, (0, 1)),
        ("a,b,c,d", 3, False, (0, 0)), ('a,"b,c', 3, True, (1, 1)), ('a,"b,c', 2, True, (1, 1)), ('a,b"x,c', 3, True, (1, 1)), ('a,"b"x,c', 3, True, (1, 2)), ('"a\nb",c', 2, True, (0, 0)), ('a,"b', 2, True, (1, 1)),
    ],
)
def test_edits(line, fields, exact, found):
    assert minimum_edits(line, fields, exact)[:2] == found


def edited(line, operations):
    """The line after its listed edits."""
    out, done = [], 0
    for op in operations.split("; ") if operations else []:
        what, kind, _, at = op.split(" ")
        at = int(at)
        out.append(line[done:at])
        done = at
        if what == "insert":
            out.append('"' if kind == "quote" else ",")
        else:
            assert line[at] == ('"' if kind == "quote" else ",")
            done = at + 1
    return "".join(out) + line[done:]


def test_listed_edits_give_a_record_and_none_is_cheaper():
    rng = random.Random(11)
    for _ in range(400):
        line = "".join(rng.choice('a,"') for _ in range(rng.randint(0, 9)))
        fields, exact = rng.randint(1, 4), rng.random() < 0.7
        _, total, operations = minimum_edits(line, fields, exact)
        assert len(operations.split("; ")) == total if total else operations == ""
        assert minimum_edits(edited(line, operations), fields, exact)[1] == 0
        seen, front = {line}, [line]
        for _ in range(total - 1 if total < 3 else 1 if total > 1 else 0):  # all lines that fewer edits reach
            front = [y for x in front for i in range(len(x) + 1) for y in (x[:i] + '"' + x[i:], x[:i] + "," + x[i:], *([x[:i] + x[i + 1 :]] if i < len(x) and x[i] in ',"' else []))]
            seen |= set(front)
        assert total == 0 or all(minimum_edits(x, fields, exact, False)[1] > 0 for x in seen)


@pytest.mark.parametrize("kept", [1, 3, 256])
def test_edits_are_listed_whatever_the_length(monkeypatch, kept):
    monkeypatch.setattr(records, "KEPT_MARKS", kept)
    rng = random.Random(kept)
    lines = ["".join(rng.choice('aa,,"') for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, ""]
    for fields, exact in ((1, True), (7, True), (9, False)):
        for line, (_, total, operations) in zip(lines, records.edits_of(lines, fields, exact)):
            assert len(operations.split("; ")) == total if total else operations == ""
            assert minimum_edits(edited(line or "", operations), fields, exact)[1] == 0
            assert total == minimum_edits(line, fields, exact, False)[1]


def test_many_marks():
    line = 'a,"' + 'y""' * 12_000 + ",c"
    _, total, operations = minimum_edits(line, 3, True)
    assert total == 1 and minimum_edits(edited(line, operations), 3, True)[1] == 0


def flight(**changes):
    values = ["x"] * 55
    for name, value in ({"Year": "2008", "Month": "3", "FlightDate": "2008-02-29", "UniqueCarrier": "AA", "Origin": "ORD", "Dest": "JFK", "DepTime": "0905", "ArrTime": "", "ArrDelayMinutes": "1.5", "Cancelled": "0.00", "Diverted": "1.00", "OriginCityName": 'Chi "x"\n, IL'} | changes).items():
        values[records.FLIGHT_COLUMNS.index(name)] = value
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(values)
    return out.getvalue()


@pytest.mark.parametrize(
    ("changes", "valid"),
    [
        ({}, True), ({"Year": "08"}, False), ({"Month": "13"}, False), ({"Month": "0"}, False), ({"Month": "01"}, True), ({"FlightDate": "2007-02-29"}, False), ({"FlightDate": "2008-2-09"}, False), ({"Origin": "Ord"}, False),
        ({"Dest": ""}, False), ({"DepTime": "2460"}, False), ({"DepTime": "2459"}, True), ({"DepTime": "2500"}, False), ({"DepTime": "60"}, False), ({"DepTime": "5"}, True), ({"ArrTime": "99999"}, False), ({"ArrDelayMinutes": ""}, True),
        ({"ArrDelayMinutes": "-1"}, False), ({"ArrDelayMinutes": "1e3"}, False), ({"Cancelled": "0"}, False), ({"Year": "2008\n"}, False),
    ],
)
def test_flight_values(spark, changes, valid):
    df = spark.createDataFrame([(1, flight(**changes), "clash")], "line_id bigint, raw_line string, fields string")
    assert records.loaded(df, records.FLIGHTS).count() == valid
    same_rows([r.reason for r in records.rejected(df, records.FLIGHTS).collect()], [] if valid else ["value"])


def test_reasons(spark):
    good = "id,0.5,a,b,c,1,2,-3.25,+90"
    rows = [(1, good), (2, good + ",extra"), (3, "id,0.5,a"), (4, 'id,"0.5,a,b,c,1,2,3,4'), (5, ",0.5,a,b,c,1,2,-3,90"), (6, None), (7, ""), (8, good.replace("0.5", ".5")), (9, 'i"d,0.5'), (10, good.replace("0.5", "٣")), (1, good)]
    df = spark.createDataFrame(rows, "line_id bigint, raw_line string")
    same_rows([(r.line_id, r.reason) for r in records.rejected(df, records.SONGS).collect()], [(3, "columns"), (4, "quoting"), (5, "value"), (6, "columns"), (7, "columns"), (8, "value"), (9, "quoting"), (10, "value")])
    rest = ["a", "b", "c", "1", "2"]
    same_rows(records.loaded(df, records.SONGS).collect(), [(1, "id", 0.5, -3.25, 90.0, rest)] * 2 + [(2, "id", 0.5, -3.25, 90.0, [*rest, "extra"])])
    wrong = {r.line_id: r.operations for r in records.rejected(df, records.SONGS).collect() if r.reason == "value"}
    assert wrong == {5: "value of song_id: ", 8: "value of artist_hotness: .5", 10: "value of artist_hotness: ٣"}


def test_all_fields_are_loaded(spark):
    df = spark.createDataFrame([(1, flight(TailNum="N1", FlightNum="07"))], "line_id bigint, raw_line string")
    (row,) = records.loaded(df, records.FLIGHTS).collect()
    assert (row.TailNum, row.FlightNum, row.Year, row.OriginCityName, row.ArrTime) == ("N1", "07", 2008, 'Chi "x"\n, IL', None) and len(row) == 56


def test_very_long_and_empty(spark):
    long = "id,0.5," + "x" * 300_000 + ',"' + 'y""' * 50_000 + '",c,1,2,3,4'
    df = spark.createDataFrame([(1, long), (2, long + '"')], "line_id bigint, raw_line string")
    assert records.loaded(df, records.SONGS).count() == 1
    assert records.rejected(df, records.SONGS).first().reason == "quoting"
    assert records.rejected(df.limit(0), records.SONGS).count() == 0
