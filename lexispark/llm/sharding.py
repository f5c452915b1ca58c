"""9. Sharding: a two-pass external shuffle.

Pass one scatters whole records uniformly into buckets that fit a task's memory, by seeded hashes of doc_id: first the
shard (rendezvous hashing, so one more shard takes records only into itself), then a bucket within the shard. Pass two
shuffles each bucket with Fisher-Yates under a seed of its own. A record's slot is its place in its bucket plus the
sizes of the shard's earlier buckets, so slots of a shard run from 0 without gaps.

Equal texts with different doc_ids are scattered like any others, so no group of copies is a hot bucket. Rows that repeat
one doc_id all belong to one shard (the key decides); within it different texts are spread over buckets by their hash, and a bucket
that identical rows make more than `OVERFULL` times too large is split by the rows' numbers.

Defined results: a null text has size 1 and the CRC of no bytes; a null doc_id hashes like any value; an empty table gives
an empty table; other columns travel with the record; columns named like ours (shard, bucket, slot, grown_shard, size)
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexispark.session import ready
from lexispark.storage import staged

OURS = ("size", "shard", "grown_shard", "bucket", "slot")
#: A bucket of more than so many times `bucket_bytes` is split.
OVERFULL = 4
#: Bytes that a task of pass two reads, bucket by bucket.
TASK_BYTES = 64 << 20


def rendezvous(key: Column, n: int, seed: int) -> Column:
    """The shard of 0..n-1 whose hash with the key is largest; another shard takes keys only into itself."""
    best = F.array_max(F.array(*[F.struct(F.xxhash64(key, F.lit(s), F.lit(seed)).alias("h"), F.lit(s).alias("s")) for s in range(n)]))
    return best["s"]


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform order of 0..n-1: place i takes one of those not yet placed. Draws are made at once, swaps one by one."""
    order = list(range(n))
    picks = (rng.random(n) * (n - np.arange(n))).astype(np.int64).tolist()
    for i, j in enumerate(picks):
        j += i
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def assign(docs: DataFrame, n_shards: int = 16, bucket_bytes: int = 16 << 20, seed: int = 7) -> DataFrame:
    """Pass one's plan: size, shard, grown_shard (with one more shard) and bucket of each record. The number of buckets
    follows the bytes of the whole table; a bucket holds about `bucket_bytes`."""
    docs = docs.drop(*OURS)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    total = docs.agg(F.sum(size)).first()[0] or 0
    n_buckets = max(1, -(-total // (bucket_bytes * n_shards)))
    key = F.col("doc_id")
    return docs.withColumns(
        {
            "size": size,
            "shard": rendezvous(key, n_shards, seed),
            "grown_shard": rendezvous(key, n_shards + 1, seed),
            "bucket": F.pmod(F.xxhash64(key, F.col("text"), F.lit(seed + 1)), F.lit(n_buckets)).cast("int"),
        }
    )


def _split(dealt: DataFrame, bucket_bytes: int, seed: int) -> DataFrame:
    """`dealt` with overfull buckets split: their parts follow one after another, and other buckets keep their place in the order."""
    loads = dealt.groupBy("shard", "bucket").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > OVERFULL * bucket_bytes)
    if loads.isEmpty():
        return dealt.withColumn("part", F.lit(0).cast("long"))
    parts = loads.select("shard", "bucket", F.ceil(F.col("bytes") / bucket_bytes).alias("parts"))
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed + 2)), F.col("parts"))
    # written once: numbers of rows may differ the next time
    return staged(dealt.join(parts, ["shard", "bucket"], "left").withColumn("part", F.coalesce(part, F.lit(0).cast("long"))).select(*dealt.columns, "part"), "split")


def shuffled(docs: DataFrame, n_shards: int = 16, bucket_bytes: int = 16 << 20, seed: int = 7) -> DataFrame:
    """Every record of `docs` with all its columns, and size, shard, grown_shard, bucket and slot."""
    dealt = assign(docs, n_shards, bucket_bytes, seed)
    names = dealt.columns
    clash = [c for c in ("part",) if c in names]
    dealt = _split(dealt.withColumnsRenamed({c: f"_{c}_" for c in clash}), bucket_bytes, seed)
    counts = dealt.groupBy("shard", "bucket", "part").agg(F.count(F.lit(1)).alias("count"), F.sum("size").alias("bytes"))
    before = Window.partitionBy("shard").orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first_slot"))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(counts.agg(F.sum("bytes")).first()[0] or 0) // TASK_BYTES))
    schema = T.StructType([*dealt.schema.fields, T.StructField("slot", T.LongType())])

    ready(docs.sparkSession)

    def order(group: tuple, table: pa.Table, start: pa.Table) -> pa.Table:
        # a fixed order first, whatever order the rows arrived in
        table = table.take(pa.compute.sort_indices(table, [("doc_id", "ascending"), ("text", "ascending")]))
        place = fisher_yates(len(table), np.random.default_rng([seed, *(int(x.as_py()) for x in group)])) + start.column("first_slot")[0].as_py()
        return table.append_column("slot", pa.array(place, pa.int64())).select([f.name for f in schema])

    keys = ["shard", "bucket", "part"]
    out = dealt.repartition(tasks, *keys).groupBy(*keys).cogroup(starts.groupBy(*keys)).applyInArrow(order, schema)
    return out.drop("part").withColumnsRenamed({f"_{c}_": c for c in clash}).select(*names, "slot")


def write_shards(shards: DataFrame, path: str) -> None:
    """One folder for each shard, its buckets' records in order of slot; the writer of each bucket works alone."""
    shards.repartition("shard", "bucket").sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)


def read_shard(spark: SparkSession, path: str, shard: int) -> Iterator:
    """A shard's records in their shuffled order."""
    return spark.read.parquet(path).where(F.col("shard") == shard).orderBy("slot").toLocalIterator()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: law `key`, 16 shards."""
    out = shuffled(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "size", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.col("grown_shard").cast("int").alias("grown_shard"))
