"""Session helpers: table access, the shared folder, staged tables and distributed ranks."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

_STAGED: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` below `folder`."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can read, for tables that cut lineage.

    `spark.checkpoint.dir` names it, or else the checkpoint folder that was set on the context. Where there is neither (tests on a
    local master) a temporary folder is made and set; on a cluster that is an error, as a machine-local folder would not be shared.
    """
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own and spark.sparkContext.applicationId not in _STAGED:
        own = spark.sparkContext.getCheckpointDir()
    if own:
        return own.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _STAGED:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _STAGED[app] = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(_STAGED[app])
        atexit.register(_remove_local, _STAGED[app])
    return _STAGED[app]


def _remove_local(folder: str) -> None:
    import shutil

    shutil.rmtree(folder, ignore_errors=True)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, which `clear` deletes with all else that this application staged."""
    return f"{shared_folder(spark)}/tidemark/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str = "stage") -> DataFrame:
    """`df` written to the shared folder as Parquet and read again: its lineage ends there and a lost executor costs nothing.

    The files stay until `release`, `clear` or, below a folder made by `shared_folder`, the end of the process.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path  # type: ignore[attr-defined]
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a frame that `staged` returned; later reads of it fail."""
    path = getattr(df, "_staged_path", None)
    if path:
        _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all that this application staged, once its results are written."""
    _delete(spark, f"{shared_folder(spark)}/tidemark/{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def parallelism(spark: SparkSession) -> int:
    """Number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def salt(*columns: Column | str, salts: int) -> Column:
    """Salt 0..salts-1 from a row's own content, so that a task that runs again salts its rows as before."""
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def before_within(df: DataFrame, keys: list[str], order: list[str], spread: list[str], salts: int, value: Column, name: str) -> DataFrame:
    """Add `name`: the sum of `value` (an integer) over the rows of the same `keys` that come before in `order`.

    No task holds a whole group: rows are summed per (keys, order, salt), salts being taken from `spread`, and shifted by the sums of
    the salts before. Rows equal in `order` follow their salt. Null keys form groups like other values. The table of sums is
    joined on null-safe keys, and its windows see one row per distinct (keys, order, salt) only.
    """
    salted = df.withColumn("_salt", salt(*spread, salts=salts)).withColumn("_v", value.cast("bigint"))
    parts = [*keys, *order, "_salt"]
    sums = salted.groupBy(*parts).agg(F.sum("_v").alias("_n"))
    above = F.sum("_n").over(Window.partitionBy(*keys).orderBy(*order, "_salt").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("_before", F.coalesce(above, F.lit(0))).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(parts)], "_before")
    inside = F.sum("_v").over(Window.partitionBy(*parts).orderBy(*spread).rowsBetween(Window.unboundedPreceding, -1))
    numbered = salted.withColumn("_at", F.coalesce(inside, F.lit(0)))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(parts)]
    joined = numbered.join(sums, same, "inner")
    return joined.withColumn(name, F.col("_before") + F.col("_at")).drop("_salt", "_v", "_at", "_before", *[f"_k{i}" for i in range(len(parts))])


def rank_within(df: DataFrame, keys: list[str], order: list[str], spread: list[str], salts: int, name: str) -> DataFrame:
    """Add `name`: the 0-based position of a row among the rows of `keys`, see `before_within`."""
    return before_within(df, keys, order, spread, salts, F.lit(1), name)
