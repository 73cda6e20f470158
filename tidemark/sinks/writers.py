"""Sinks. Operators return frames; these write them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import staged


def write_text(df: DataFrame, path: str, separator: str = "\t", mode: str = "errorifexists") -> None:
    """One line per row, columns joined by `separator`; arrays are joined by commas, nulls are empty."""
    columns = [F.array_join(c, ",") if t.startswith("array") else F.col(c).cast("string") for c, t in df.dtypes]
    df.select(F.concat_ws(separator, *[F.coalesce(c, F.lit("")) for c in columns]).alias("value")).write.mode(mode).text(path)


def write_tabs(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Tab-separated lines without a header and without quoting. Nulls are empty; a value with a tab or a line break is an error, as the
    format can't hold it."""

    def plain(name: str) -> Column:
        text = F.coalesce(F.col(name).cast("string"), F.lit(""))
        return F.when(text.rlike(r"[\t\n\r]"), F.raise_error(F.lit(f"a value of {name} holds a tab or a line break")).cast("string")).otherwise(text)

    df.select(F.concat_ws("\t", *[plain(c) for c in df.columns]).alias("value")).write.mode(mode).text(path)


def write_by_letter(counts: DataFrame, path: str, word: str = "word", mode: str = "errorifexists", tasks: int | None = None) -> None:
    """Word counts as Parquet, one folder for each first letter. Tasks, `tasks` of them if given, share the words by ranges, so a letter may
    be written by several."""
    ranged = counts.withColumn("letter", F.lower(F.substring(word, 1, 1)))
    ranged = ranged.repartitionByRange(tasks, "letter", word) if tasks else ranged.repartitionByRange("letter", word)
    ranged.write.mode(mode).partitionBy("letter").parquet(path)


def write_levels(levels: dict[int, DataFrame], path: str, name: str = "pass", mode: str = "overwrite") -> None:
    """Frames numbered by pass or iteration, one folder each."""
    for number, df in levels.items():
        df.write.mode(mode).parquet(f"{path}/{name}={number}")


def latest_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in `order`, nulls first, as a store that overwrites keeps it; tasks keep one row of a key each before
    the shuffle. Of rows equal in `order` any one is kept."""
    own = [F.col(k).alias(k) for k in keys]
    return df.groupBy(*own).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_r")).select("_r.*")


def write_wide_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows with year, carrier, month, row_key as Parquet partitioned by year and sorted by carrier and month, for scans by key prefix.
    Tasks share the rows by ranges of the key, so a carrier with most rows is written by several."""
    order = ["year", "carrier", "month", "row_key"]
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).partitionBy("year").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def upsert_wide_table(batch: DataFrame, path: str, order: list[str]) -> None:
    """Put the rows of `batch` into a wide table, which is created if it isn't there: a row replaces the one of its row_key; of several rows
    of a key in the batch the last in `order` stays. Only the years of the batch are rewritten; all else stays as it is.

    The new partitions are staged before they replace the old ones. A key belongs to one year, as it begins with it.
    """
    spark = batch.sparkSession
    latest = staged(latest_by_key(batch, ["row_key"], order), "batch")
    if not exists(spark, path):
        return write_wide_table(latest, path)
    years = [r.year for r in latest.select("year").distinct().collect()]  # as many as years
    old = spark.read.parquet(path).filter(F.col("year").isin(years)).select(*latest.columns)
    kept = old.join(latest.select("row_key"), "row_key", "left_anti").select(*latest.columns)
    merged = staged(kept.unionByName(latest), "merged")
    order = ["year", "carrier", "month", "row_key"]
    merged.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)
