"""Documents as a stream: each micro-batch adds its postings to an index, and old versions of a document give way.

A document's frequencies depend on no other document, so an index grows by appending. A batch writes under its own
number, so a batch that is run again after a failure replaces what it wrote and counts nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexispark.operators.index import Index, build, exploded
from lexispark.storage import release, staged


def stream_documents(spark: SparkSession, path: str, schema: str = "doc_id long, text string", per_batch: int = 16) -> DataFrame:
    """New Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def ingest(docs: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append the stream's documents to the index at `path`."""

    def add(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("doc_id").agg(F.max("text").alias("text"))
        index = build(last)
        index.docs.write.mode("overwrite").parquet(f"{path}/docs/batch={number}")
        found = staged(index.blocks, "blocks")
        exploded(found).repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings/batch={number}")
        release(found)

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_ingested(spark: SparkSession, path: str) -> Index:
    """The index so far: of a document that came more than once the last batch counts."""
    docs, post = spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/postings")
    last = docs.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return Index(docs.join(last, ["doc_id", "batch"]).drop("batch"), post.join(last, ["doc_id", "batch"]).select("term", "doc_id", "tf"))


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window of time and type; for a stream, later ones than `late` are left out."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", window)
    return timed.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
