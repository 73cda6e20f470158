from tidemark.operators import wordcount

from .conftest import same_rows


def test_words(spark):
    lines = spark.createDataFrame([("Map map nope Quiet, zebra",), ("  oPen\tpen   ",), ("élan 3 -minus",), ("",), (None,), ("map\fmap\r\nmap",)], "value string")
    same_rows(wordcount.word_counts(lines).collect(), [("Map", 1), ("map", 4), ("nope", 1), ("Quiet,", 1), ("oPen", 1), ("pen", 1)])
    same_rows(wordcount.letter_totals(lines).collect(), [("m", 0, 2, 5), ("n", 1, 1, 1), ("o", 2, 1, 1), ("p", 3, 1, 1), ("q", 4, 1, 1)])


def test_empty_table(spark):
    assert wordcount.letter_totals(spark.createDataFrame([], "value string, word int")).count() == 0


def test_long_line(spark):
    assert wordcount.word_counts(spark.createDataFrame([("no " * 300_000,)], "value string")).first().cnt == 300_000


def test_counts_before_the_shuffle(spark):
    plan = wordcount.word_counts(spark.createDataFrame([("a",)], "value string"))._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan
