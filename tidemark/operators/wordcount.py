"""Counts of the words that begin with one of a range of letters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import tokens

LETTERS = "mnopq"


def filtered_words(lines: DataFrame, column: str = "value", letters: str = LETTERS) -> DataFrame:
    """`word` for each token whose first letter, in lower case, is one of `letters`; case and punctuation stay. Null lines have none."""
    words = lines.select(F.explode(tokens(F.col(column))).alias("word"))
    return words.filter(F.col("word").rlike(f"^[{letters.lower()}{letters.upper()}]"))


def word_counts(lines: DataFrame, column: str = "value", letters: str = LETTERS) -> DataFrame:
    """word, cnt. Tasks count before the shuffle, so its size goes with the distinct words of a task."""
    return filtered_words(lines, column, letters).groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))


def letter_totals(lines: DataFrame, column: str = "value", letters: str = LETTERS) -> DataFrame:
    """letter, bucket (its place in `letters`, from 0), words (distinct), cnt."""
    counted = word_counts(lines, column, letters).withColumn("letter", F.lower(F.substring("word", 1, 1)))
    totals = counted.groupBy("letter").agg(F.count(F.lit(1)).alias("words"), F.sum("cnt").alias("cnt"))
    return totals.select("letter", (F.ascii("letter") - F.lit(ord(letters[0]))).alias("bucket"), "words", "cnt")
