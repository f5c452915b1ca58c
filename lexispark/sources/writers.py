"""Where tables go: metadata lines, text and binary indexes, rank tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.operators.index import Index, as_blocks, frequencies, lists, placed
from lexispark.sources import binary
from lexispark.sources.readers import LAYOUT, MAGIC, VERSION
from lexispark.storage import file_system, release, staged


def write_corpus(extracted: DataFrame, path: str) -> None:
    """One text file for each extracted document, by its `file` name, in a folder that is emptied first. Executors write; the driver only
    gives the files their names, of which there are as many as documents are extracted at most."""
    spark = extracted.sparkSession
    fs, folder = file_system(spark, path)
    fs.delete(folder, True)
    _, parts = file_system(spark, f"{path}/_parts")
    # the writer ends each row with the line end that ends a document
    extracted.select("file", F.regexp_replace("doc_text", r"\n\z", "").alias("value")).write.partitionBy("file").text(parts.toString())
    for found in fs.globStatus(file_system(spark, f"{path}/_parts/file=*/part-*")[1]) or []:
        at = found.getPath()
        fs.rename(at, file_system(spark, f"{path}/{at.getParent().getName().removeprefix('file=')}")[1])
    fs.delete(parts, True)


def write_metadata(meta: DataFrame, path: str) -> None:
    """JSON lines, letters outside ASCII as they are."""
    meta.write.mode("overwrite").json(path)


def _blocks(index: Index) -> DataFrame:
    return as_blocks(index.postings) if index.blocks is None else index.blocks


def postings_lines(blocks: DataFrame) -> DataFrame:
    """value: term and its id:tf items, tab-separated."""
    items = F.transform("postings", lambda p: F.concat_ws(":", p["doc_id"].cast("string"), p["tf"].cast("string")))
    return lists(blocks).select(F.concat_ws("\t", "term", F.concat_ws("\t", items)).alias("value"))


def write_text_index(index: Index, path: str) -> None:
    index.docs.select(F.concat_ws("\t", F.col("doc_id").cast("string"), "path")).write.mode("overwrite").text(f"{path}/docs")
    index.frequencies.select(F.concat_ws("\t", "term", F.col("df").cast("string"))).write.mode("overwrite").text(f"{path}/dictionary")
    postings_lines(_blocks(index)).write.mode("overwrite").text(f"{path}/postings")


def write_index(index: Index, path: str) -> None:
    """docs, postings, vocabulary and meta as Parquet. Postings lie in blocks, which are dealt out by ranges of terms and sorted, so a search
    reads the few row groups that can hold its terms; Bloom filters settle the rest. Blocks are written before they are dealt out, since
    ranges are sampled in a pass of its own."""
    spark = index.docs.sparkSession
    index.docs.write.mode("overwrite").parquet(f"{path}/docs")
    found = staged(_blocks(index), "blocks")
    dealt = found.withColumn("first", F.col("doc_ids")[0]).repartitionByRange("term", "first").sortWithinPartitions("term", "first").drop("first")
    dealt.write.mode("overwrite").option("parquet.bloom.filter.enabled#term", "true").option("parquet.block.size", str(16 << 20)).parquet(f"{path}/postings")
    release(found)
    placed(frequencies(spark.read.parquet(f"{path}/postings"))).write.mode("overwrite").parquet(f"{path}/vocabulary")
    spark.createDataFrame([(LAYOUT,)], "version int").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def write_binary_index(index: Index, path: str) -> None:
    """The four-file binary layout, for interchange; executors write it in parts, in a folder that they share with the driver."""
    binary.write(index.docs, index.vocabulary, index.postings, path, MAGIC, VERSION)


def rank_lines(table: DataFrame) -> DataFrame:
    """The rank table with ten decimals."""
    return table.select("rank", "real_freq", *[F.format_string("%.10f", c).alias(c) for c in ("zipf_ideal", "zipf_fit")])


def write_rank_table(table: DataFrame, path: str) -> None:
    rank_lines(table).write.mode("overwrite").option("header", "true").csv(path)


def plot_script(csv_path: str, image: str = "zipf.png") -> str:
    """A gnuplot script of the three series over logarithmic axes."""
    series = ", ".join(f"'{csv_path}' using 1:{i} every ::1 with lines title '{t}'" for i, t in ((2, "observed"), (3, "ideal"), (4, "fitted")))
    return f"set datafile separator ','\nset terminal png size 1200,800\nset output '{image}'\nset logscale xy\nset xlabel 'rank'\nset ylabel 'frequency'\nplot {series}\n"
