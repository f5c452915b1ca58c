"""Rank and frequency of terms, and the straight line through their logarithms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexispark.storage import staged

#: Ranks that one row stands for until they are rows of their own.
CHUNK = 1 << 14


def by_frequency(totals: DataFrame) -> DataFrame:
    """Of terms and their freq: real_freq, lo and hi, the ranks of each different frequency. Only these few rows are ever in one task."""
    groups = totals.groupBy(F.col("freq").alias("real_freq")).agg(F.count(F.lit(1)).alias("terms"))
    hi = F.sum("terms").over(Window.orderBy(F.desc("real_freq")).rowsBetween(Window.unboundedPreceding, 0))
    return groups.withColumn("hi", hi).select("real_freq", (F.col("hi") - F.col("terms") + 1).alias("lo"), "hi")


def _ranks(groups: DataFrame) -> DataFrame:
    """A group's ranks are cut into chunks that are dealt out before they become rows: most terms have frequency 1."""
    chunks = groups.select("real_freq", "hi", F.explode(F.sequence("lo", "hi", F.lit(CHUNK).cast("long"))).alias("first")).repartition("first")
    return chunks.select(F.explode(F.sequence("first", F.least(F.col("first") + CHUNK - 1, F.col("hi")))).alias("rank"), "real_freq")


def ranks(totals: DataFrame) -> DataFrame:
    """rank (from 1; equal frequencies get consecutive ones), real_freq."""
    return _ranks(by_frequency(totals))


def _fit(groups: DataFrame) -> DataFrame:
    x, y = F.log(F.col("rank").cast("double")), F.log(F.col("real_freq").cast("double"))
    got = _ranks(groups).agg(F.count(F.lit(1)).alias("terms"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.max("real_freq").alias("c"))
    alone, nan = F.col("terms") == 1, F.lit(float("nan"))
    return got.where("terms > 0").select("terms", F.when(alone, nan).otherwise(-F.col("slope")).alias("s"), F.when(alone, nan).otherwise(F.exp("intercept")).alias("c_fit"), "c")


def fit(totals: DataFrame) -> DataFrame:
    """One row: terms, s (the exponent), c_fit, c (the largest frequency). NaN for a single term, no row for none."""
    return _fit(by_frequency(totals))


def table(totals: DataFrame) -> DataFrame:
    """rank, real_freq, zipf_ideal (c / rank), zipf_fit (c_fit / rank^s). Terms are counted once; what is read twice is a row a frequency."""
    groups, r = staged(by_frequency(totals), "frequencies"), F.col("rank").cast("double")
    return _ranks(groups).crossJoin(F.broadcast(_fit(groups))).select("rank", "real_freq", (F.col("c") / r).alias("zipf_ideal"), (F.col("c_fit") / F.pow(r, F.col("s"))).alias("zipf_fit"))
