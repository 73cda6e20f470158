"""Column expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Words of a line: split at blanks, tabs, line feeds, carriage returns and form feeds; empty strings at the edges stay."""
    return F.split(text, r"[ \t\n\r\f]+")


def number(text: Column, kind: str) -> Column:
    """`text` as a number, null where it is none."""
    return text.try_cast(kind)


def trimmed(text: Column) -> Column:
    """`text` without blanks at its ends."""
    return F.trim(text)


def folded(text: Column) -> Column:
    """`text` as it is compared where case doesn't count."""
    return F.lower(text)


def known(value: Column) -> Column:
    """A double, null where it is NaN."""
    return F.when(~F.isnan(value), value)


def two_digits(value: Column) -> Column:
    """A number with a leading zero below ten."""
    return F.lpad(value.cast("string"), 2, "0")


def leave_one_out(items: Column, size: int, drop: int) -> Column:
    """`items`, an array of `size` elements, without the element at `drop` (from 1)."""
    return F.concat(F.slice(items, 1, drop - 1), F.slice(items, drop + 1, size - drop))


def distance(a: list[Column], b: list[Column]) -> Column:
    """Euclidean distance; of one feature, the absolute difference."""
    if len(a) == 1:
        return F.abs(a[0] - b[0])
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a[1:], b[1:])), (a[0] - b[0]) * (a[0] - b[0])))


def rendered(items: Column, separator: str = ",") -> Column:
    """An array as text."""
    return F.array_join(items, separator)
