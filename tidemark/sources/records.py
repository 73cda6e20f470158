"""Loading delimited records, one per row, and separating those that fail to parse with the reason.

A record is parsed at minimum cost: an edit inserts or deletes a quote or a delimiter. Records that parse at no cost into the right
number of fields with valid values are loaded; this is decided by built-in expressions. All others go through the dynamic programme
of `minimum_edits`, whose operations state the reason.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import FLIGHT_COLUMNS

#: A field that parses at no cost: quoted, with quotes doubled, or without quotes and delimiters.
FIELD = r'(?:"(?:[^"]++|"")*+"|[^",]*+)'
#: Marks between two tables of costs that are kept; those between are made again where edits are listed.
KEPT_MARKS = 256
#: Records that are parsed at a time.
RECORDS_AT_ONCE = 128

_DIGITS = r"[0-9]+(?:\.[0-9]+)?"


@dataclass(frozen=True)
class Rule:
    """A column of a feed: position, name, type that it is loaded as, and what its value has to match."""

    at: int
    name: str
    kind: str
    pattern: str
    real_date: bool = False


@dataclass(frozen=True)
class Feed:
    """How the records of a feed look: number of fields (`exact` or at least), rules for the values that count, names of all fields if they have any."""

    name: str
    fields: int
    exact: bool
    rules: tuple[Rule, ...]
    names: tuple[str, ...] = ()


_HHMM = r"(?:|[0-9]|[0-5][0-9]|[0-9][0-5][0-9]|(?:[01][0-9]|2[0-4])[0-5][0-9])"
FLIGHTS = Feed(
    "flight_lines", 55, True,
    tuple(
        Rule(FLIGHT_COLUMNS.index(name), name, kind, pattern, name == "FlightDate")
        for name, kind, pattern in (
            ("Year", "int", r"[0-9]{4}"), ("Month", "int", r"(?:0?[1-9]|1[0-2])"), ("FlightDate", "date", r"[0-9]{4}-[0-9]{2}-[0-9]{2}"),
            ("UniqueCarrier", "string", r"(?s).*"), ("Origin", "string", r"[A-Z]{3}"), ("Dest", "string", r"[A-Z]{3}"), ("DepTime", "int", _HHMM),
            ("ArrTime", "int", _HHMM), ("ArrDelayMinutes", "double", f"(?:{_DIGITS})?"), ("Cancelled", "double", r"[01]\.00"), ("Diverted", "double", r"[01]\.00"),
        )
    ),
    tuple(FLIGHT_COLUMNS),
)
_SIGNED = rf"(?:[+-]?{_DIGITS})?"
SONGS = Feed("song_lines", 9, False, (Rule(0, "song_id", "string", r"(?s).+"), Rule(1, "artist_hotness", "double", _SIGNED), Rule(7, "loudness", "double", _SIGNED), Rule(8, "beat", "double", _SIGNED)))


def fields_of(line: Column) -> Column:
    """Fields of a record that parses at no cost, without their quotes."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(f",({FIELD})"), F.lit(1))
    return F.transform(raw, lambda x: F.when(F.startswith(x, F.lit('"')), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))


def _valid(value: Column, rule: Rule) -> Column:
    fits = value.rlike(rf"\A{rule.pattern}\z")
    return fits & value.try_cast("date").isNotNull() if rule.real_date else fits


def parsed(lines: DataFrame, feed: Feed) -> DataFrame:
    """`line_id`, `raw_line`, `fields` (null unless it parses at no cost), `loads` for the rows of `lines`."""
    whole = F.coalesce(F.col("raw_line").rlike(rf"\A{FIELD}(?:,{FIELD})*+\z"), F.lit(False))
    rows = lines.select("line_id", "raw_line", F.when(whole, fields_of(F.col("raw_line"))).alias("fields"))
    count = F.size("fields") == feed.fields if feed.exact else F.size("fields") >= feed.fields
    loads = F.col("fields").isNotNull() & count
    for rule in feed.rules:
        loads = loads & F.coalesce(_valid(F.get("fields", F.lit(rule.at)), rule), F.lit(False))
    return rows.withColumn("loads", loads)


def loaded(lines: DataFrame, feed: Feed) -> DataFrame:
    """Valid records with typed fields: line_id and all fields of a feed that names them, else those that its rules name and `others`, an
    array of the rest. Fields without a rule are strings. An empty value of a number is null.

    `lines` has line_id and raw_line; other columns are ignored. Repeated rows are loaded as often as they come.
    """
    field = lambda at: F.get("fields", F.lit(at))
    rules = {r.at: r for r in feed.rules}
    if feed.names:
        typed = [(field(i).try_cast(rules[i].kind) if i in rules else field(i)).alias(name) for i, name in enumerate(feed.names)]
    else:
        typed = [field(r.at).try_cast(r.kind).alias(r.name) for r in feed.rules]
        typed.append(F.filter("fields", lambda x, i: ~i.isin(list(rules))).alias("others"))
    return parsed(lines, feed).filter("loads").select("line_id", *typed)


_START, _PLAIN, _QUOTED, _AFTER = range(4)
_OTHER, _DELIMITER, _QUOTE = range(3)
_FAR = np.int32(1 << 28)


def _marks(line: str) -> tuple[np.ndarray, np.ndarray]:
    """Kinds and offsets of quotes, delimiters and runs of anything else."""
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = np.where(codes == 34, _QUOTE, np.where(codes == 44, _DELIMITER, _OTHER)).astype(np.int8)
    first = np.flatnonzero((kinds != _OTHER) | (np.concatenate([[_QUOTE], kinds[:-1]]) != _OTHER))
    return kinds[first], first


def _inserted(cost: np.ndarray, step: np.ndarray, capped: bool) -> np.ndarray:
    """Cheapest costs after any insertions. Axes are records, states and the delimiters so far; the last column means `or more` if capped."""
    out = cost.copy()
    start, plain, quoted, after = (out[:, s] for s in range(4))
    np.minimum(after, quoted + 1, out=after)  # close
    ended = np.minimum(np.minimum(start, plain), after)
    run = np.minimum.accumulate(ended - step, axis=1) + step  # any number of delimiters
    np.minimum(start[:, 1:], run[:, :-1] + 1, out=start[:, 1:])
    if capped:
        np.minimum(start[:, -1], ended[:, -1] + 1, out=start[:, -1])
    np.minimum(quoted, np.minimum(start, after) + 1, out=quoted)  # open, or double a quote
    np.minimum(after, quoted + 1, out=after)
    return out


def _moved(wide: np.ndarray, mark: np.ndarray, capped: bool) -> np.ndarray:
    """Costs after each record's `mark` was read, or deleted at cost 1 if it is a quote or a delimiter."""
    out = np.full_like(wide, _FAR)
    start, plain, quoted, after = (wide[:, s] for s in range(4))
    other, delimiter, quote = ((mark == k)[:, None] for k in (_OTHER, _DELIMITER, _QUOTE))
    ended = np.minimum(np.minimum(start, plain), after)
    out[:, _START, 1:] = np.where(delimiter, ended[:, :-1], _FAR)
    if capped:
        out[:, _START, -1] = np.where(delimiter[:, 0], np.minimum(out[:, _START, -1], ended[:, -1]), _FAR)
    out[:, _PLAIN] = np.where(other, np.minimum(start, plain), _FAR)
    out[:, _QUOTED] = np.where(quote, np.minimum(start, after), quoted)
    out[:, _AFTER] = np.where(quote, quoted, _FAR)
    return np.where(other[:, :, None], out, np.minimum(out, wide + 1))


class _Programme:
    """The dynamic programme over several records, longest first, to `columns` fields (or more, if capped)."""

    def __init__(self, marks: list[np.ndarray], columns: int, capped: bool) -> None:
        self.length = np.array([len(m) for m in marks])
        self.marks = np.zeros((len(marks), int(self.length.max(initial=0))), dtype=np.int8)
        for i, m in enumerate(marks):
            self.marks[i, : len(m)] = m
        self.capped, self.step = capped, np.arange(columns, dtype=np.int32)
        self.kept: list[np.ndarray] = []  # costs before every KEPT_MARKS-th mark
        cost = np.full((len(marks), 4, columns), _FAR, dtype=np.int32)
        cost[:, _START, 0] = 0
        for t in range(self.marks.shape[1]):
            if t % KEPT_MARKS == 0:
                self.kept.append(cost)
                cost = cost.copy()
            n = int((self.length > t).sum())
            cost[:n] = _moved(_inserted(cost[:n], self.step, capped), self.marks[:n, t], capped)
        self.end = _inserted(cost, self.step, capped)
        self.total = np.minimum(np.minimum(self.end[:, _START], self.end[:, _PLAIN]), self.end[:, _AFTER])[:, -1]

    def edits(self, offsets: list[np.ndarray], ends: list[int]) -> list[str]:
        """The edits of one cheapest way for each record, found backwards; positions are 0-based offsets in the line."""
        found: list[list[str]] = [[] for _ in ends]
        at = {int(r): (min((_START, _PLAIN, _AFTER), key=lambda s: self.end[r, s, -1]), len(self.step) - 1) for r in np.flatnonzero(self.total)}
        open_rows = dict.fromkeys(at, False)  # whether the insertions at the place are done
        for part in range(max(len(self.kept), 1) - 1, -1, -1):
            low, high = part * KEPT_MARKS, min((part + 1) * KEPT_MARKS, self.marks.shape[1])
            rows = np.array([r for r in at if self.length[r] >= low], dtype=np.int64)
            if not len(rows):
                continue
            first = self.kept[part] if self.kept else np.where(np.arange(4)[:, None] + self.step == 0, 0, _FAR)[None].repeat(len(ends), 0).astype(np.int32)
            plain = [first[rows]]
            for t in range(low, high):
                plain.append(_moved(_inserted(plain[-1], self.step, self.capped), self.marks[rows, t], self.capped))
            wide = [_inserted(x, self.step, self.capped) for x in plain]
            for i, r in enumerate(rows):
                r = int(r)
                begin = int(min(self.length[r], high))
                state = self._back(r, at[r], begin, low, [p[i] for p in plain], [w[i] for w in wide], offsets[r], ends[r], found[r], open_rows[r])
                if state is None:
                    del at[r]
                else:
                    at[r], open_rows[r] = state, True
        return ["; ".join(f[::-1]) for f in found]

    def _back(self, r: int, place: tuple[int, int], at: int, low: int, plain: list[np.ndarray], wide: list[np.ndarray], offsets: np.ndarray, end: int, edits: list[str], done: bool) -> tuple[int, int] | None:
        """Go back from mark `at` to mark `low`; the state there, or None once no edits are left."""
        (state, column), most = place, len(self.step) - 1
        before = lambda c: {c - 1, c} if self.capped and c == most else {c - 1}
        while True:
            offset = int(offsets[at]) if at < len(offsets) else end
            if not done:  # go back over insertions at this place
                here, own, grown = int(wide[at - low][state, column]), plain[at - low], wide[at - low]
                while own[state, column] != here:
                    options = []
                    if state == _AFTER:
                        options = [(_QUOTED, column, "insert quote")]
                    elif state == _QUOTED:
                        options = [(_START, column, "insert quote"), (_AFTER, column, "insert quote")]
                    elif state == _START:
                        options = [(s, c, "insert delimiter") for c in before(column) if c >= 0 for s in (_START, _PLAIN, _AFTER)]
                    cheaper = [o for o in options if grown[o[0], o[1]] == here - 1]
                    if not cheaper:
                        break
                    state, column, what = cheaper[0]
                    here -= 1
                    edits.append(f"{what} at {offset}")
            done = False
            if at == 0 or plain[at - low][state, column] == 0:
                return None
            if at == low:
                return state, column
            at -= 1
            mark, now = self.marks[r, at], plain[at + 1 - low][state, column]
            sources = []
            if mark == _OTHER:
                sources = [(s, column) for s in ((_START, _PLAIN) if state == _PLAIN else (_QUOTED,) if state == _QUOTED else ())]
            elif mark == _DELIMITER:
                if state == _QUOTED:
                    sources = [(_QUOTED, column)]
                elif state == _START:
                    sources = [(s, c) for c in before(column) if c >= 0 for s in (_START, _PLAIN, _AFTER)]
            elif state == _QUOTED:
                sources = [(_START, column), (_AFTER, column)]
            elif state == _AFTER:
                sources = [(_QUOTED, column)]
            same = [s for s in sources if wide[at - low][s] == now]
            if same:
                state, column = same[0]
            else:
                edits.append(f"delete {'quote' if mark == _QUOTE else 'delimiter'} at {int(offsets[at])}")


def edits_of(lines: list[str | None], fields: int, exact: bool, listed: bool = True) -> list[tuple[int, int, str]]:
    """(edits that quoting needs, edits in all, the edits) to make each line a record of `fields` fields (or at least so many).

    The first number leaves the number of fields open. A null line has no marks and needs all its delimiters. The programme runs over
    quotes, delimiters and runs of other characters; its states are the start of a field, an unquoted field, a quoted field, and the
    place after a quote in a quoted field; with each state goes the number of delimiters so far. Records advance together.
    """
    marks = [_marks(x or "") for x in lines]
    order = sorted(range(len(lines)), key=lambda i: -len(marks[i][0]))
    out: list[tuple[int, int, str]] = [(0, 0, "")] * len(lines)
    for lo in range(0, len(lines), RECORDS_AT_ONCE):
        own = order[lo : lo + RECORDS_AT_ONCE]
        kinds = [marks[i][0] for i in own]
        quoting = _Programme(kinds, 1, True).total
        whole = _Programme(kinds, fields, not exact)
        text = whole.edits([marks[i][1] for i in own], [len(lines[i] or "") for i in own]) if listed else [""] * len(own)
        for i, q, n, e in zip(own, quoting, whole.total, text):
            out[i] = (int(q), int(n), e)
    return out


def minimum_edits(line: str | None, fields: int, exact: bool, listed: bool = True) -> tuple[int, int, str]:
    """`edits_of` one line."""
    return edits_of([line], fields, exact, listed)[0]


def rejected(lines: DataFrame, feed: Feed, listed: bool = True) -> DataFrame:
    """Records that don't load: feed, line_id, reason, edits, operations.

    reason is `quoting` if quotes have to be edited or the text around them cut for the record to be read at all, else `columns` if
    delimiters have to be edited for the right number of fields, else `value`: it parses at no cost but a value isn't valid. `edits`
    is the least number of insertions and deletions, `operations` one cheapest list of them, or for `value` the first field whose value
    isn't valid with that value; it is empty unless `listed`. A null or empty line has too few columns. Repeated rows are reported as
    often as they come; no rows, no rows.
    """
    value = lambda rule: F.get("fields", F.lit(rule.at))
    wrong = F.coalesce(*[F.when(~F.coalesce(_valid(value(r), r), F.lit(False)), F.concat(F.lit(f"value of {r.name}: "), value(r))) for r in feed.rules])
    failed = parsed(lines, feed).filter(~F.col("loads")).select("line_id", "raw_line", (wrong if listed else F.lit("")).alias("wrong"))
    name, fields, exact = feed.name, feed.fields, feed.exact

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = edits_of(batch.column(1).to_pylist(), fields, exact, listed)
            reason = ["quoting" if q else "columns" if n else "value" for q, n, _ in found]
            text = [e if n else w for (_, n, e), w in zip(found, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), batch.column(0), pa.array(reason, pa.string()), pa.array([f[1] for f in found], pa.int32()), pa.array(text, pa.string())], names=["feed", "line_id", "reason", "edits", "operations"])

    return failed.mapInArrow(explain, "feed string, line_id bigint, reason string, edits int, operations string")
