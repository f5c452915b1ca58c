"""Tables written between steps, in a folder that the driver and all executors share, and tables in a total order."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_staged: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a folder of our own if all runs on this machine; a cluster
    must name one, since its executors don't share their temporary folders."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or f"{tempfile.gettempdir()}/lexispark-checkpoint").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of our own in the shared folder, that goes with `release_path` or at the end of the session."""
    at = f"{shared_dir(spark)}/lexispark/{name}-{uuid.uuid4().hex}"
    _staged[at] = spark
    return at


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """`df`, written as Parquet in the shared folder and read again: its lineage is cut, and a lost executor costs no
    more than what it was doing."""
    at = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out.staged_at = at
    return out


def file_system(spark: SparkSession, path: str):
    """(Hadoop's file system of a path, the path as it names it)."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def release_path(at: str) -> None:
    fs, path = file_system(_staged.pop(at), at)
    fs.delete(path, True)


def release(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for table in tables:
        release_path(table.staged_at)


def _release_all() -> None:
    for at in list(_staged):
        try:
            release_path(at)
        except Exception:  # noqa: BLE001 - the session has ended; the shared folder's own cleaning takes over
            pass


atexit.register(_release_all)


def in_order(df: DataFrame, *order: str) -> DataFrame:
    """`df` in the total order of `order` (and, of ties, of a hash of the whole row), with `_file` and `_row`: written once in sampled
    ranges that are sorted each, so files follow one another and rows within them, and no task holds more than its range."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    table = staged(ranged, "ordered")
    return table.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def files_before(ordered: DataFrame, value) -> DataFrame:
    """_file and `_before`: the sum of `value` in the files before it. One short row a file."""
    totals = ordered.groupBy("_file").agg(F.sum(value).alias("_total"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_file", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))


def numbered(df: DataFrame, *order: str, name: str) -> DataFrame:
    """`df` with `name` counting from 0 in the total order."""
    rows = in_order(df, *order)
    return rows.join(files_before(rows, F.lit(1)), "_file").withColumn(name, (F.col("_before") + F.col("_row")).cast("long")).drop("_file", "_row", "_before")


def summed_before(df: DataFrame, *order: str, value: str, name: str) -> DataFrame:
    """`df` with `name`: the sum of `value` in all rows before, in the total order."""
    rows = in_order(df, *order)
    own = Window.partitionBy("_file").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    within = rows.withColumn("_within", F.coalesce(F.sum(value).over(own), F.lit(0)))
    return within.join(files_before(rows, F.col(value)), "_file").withColumn(name, (F.col("_before") + F.col("_within")).cast("long")).drop("_file", "_row", "_before", "_within")
