"""5. Token counts: a separator scan over flat, unindexed token files.

A token file is a stream of ids in which each document ends with a separator id; nothing says where documents lie.
It is read as blocks of a fixed number of ids. A vectorised search finds the separators of each block; what a block
can't know (how many documents and ids came before it, where the last separator was) comes from a prefix scan over one
short row for each block. Blocks are independent, so a file is scanned by as many tasks as it has blocks.

The files are kept as a table (file_id, block_no, ids): the ids of a file cut into equal blocks without regard to
documents. `read_files` makes the same table from plain binary files of ids.

Defined results: a null or empty text has 0 tokens; ids after a file's last separator are a document with closed =
false; a file without ids has no documents; repeated rows count each; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexispark.llm.common import text_slices, tidy
from lexispark.llm.tokens import bpe, default_path
from lexispark.session import ready
from lexispark.storage import staged

#: Ids a block: half a million, 1 MB at two bytes an id.
BLOCK = 1 << 19
#: The vocabulary's own end-of-text id; texts are encoded as ordinary text, so no text holds it.
SEPARATOR = 50256
KIND = "<u2"
#: Blocks of a run, the unit of the prefix scan.
RUN = 1024


def write_files(docs: DataFrame, tokenizer: str | None = None, separator: int = SEPARATOR, block: int = BLOCK, kind: str = KIND) -> tuple[DataFrame, DataFrame]:
    """Tokenize into flat files, one a partition: (blocks: file_id, block_no, ids; manifest: file_id, nth, doc_id). The
    manifest only names the documents in the order in which they were written."""
    path = tokenizer or default_path()
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"file_id int, block_no long, ids binary, nth long, doc_id {key}"

    ready(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, file_id, nth, block_no = bpe(path), TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        n_held = 0

        def blocks(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n_held, block_no
            if n_held < block and not (last and n_held):
                return
            flat = np.concatenate(held)
            cuts = range(0, len(flat) if last else len(flat) // block * block, block)
            out = [flat[c : c + block].tobytes() for c in cuts]
            none = pa.nulls(len(out), pa.int64())
            yield batch_of([pa.array([file_id] * len(out), pa.int32()), pa.array(range(block_no, block_no + len(out)), pa.int64()), pa.array(out, pa.binary()), none, pa.nulls(len(out), id_type)])
            block_no += len(out)
            held = [flat[len(out) * block :]]
            n_held = len(held[0])

        id_type = None
        for batch in batches:
            id_type = batch.column("doc_id").type
            batch_of = lambda cols: pa.RecordBatch.from_arrays(cols, ["file_id", "block_no", "ids", "nth", "doc_id"])
            n = batch.num_rows
            for _, _, data, offsets in text_slices(batch.column("text")):
                ids, counts = model.encode_slice(data, offsets)
                if max(separator, int(ids.max(initial=0))) > np.iinfo(kind).max:
                    raise ValueError(f"ids of this tokenizer don't fit {kind}")
                held.append(np.insert(ids, np.cumsum(counts), np.uint32(separator)).astype(kind))
                n_held += len(held[-1])
                yield from blocks(False)
            yield batch_of([pa.array(np.full(n, file_id, np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(np.arange(nth, nth + n)), batch.column("doc_id")])
            nth += n
        if n_held:
            yield from blocks(True)

    both = staged(docs.select("doc_id", "text").mapInArrow(tidy(write), schema), "token-files")
    return both.where("block_no is not null").select("file_id", "block_no", "ids"), both.where("nth is not null").select("file_id", "nth", "doc_id")


def read_files(spark: SparkSession, path: str, block: int = BLOCK, kind: str = KIND) -> DataFrame:
    """Blocks of plain binary files of ids, each of at most 2 GB (a row of Spark's binary source); a file's id is its path."""
    size = block * np.dtype(kind).itemsize
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file_id"), "content")
    return files.select("file_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), (F.octet_length("content") - 1) / size).cast("int")), lambda i: F.substring("content", i * size + 1, F.lit(size)))).alias("block_no", "ids"))


def count_tokens(blocks: DataFrame, separator: int = SEPARATOR, kind: str = KIND) -> DataFrame:
    """file_id, nth (the document's place in its file, from 0), n_tokens (without the separator), closed."""
    key = blocks.schema["file_id"].dataType.simpleString()

    ready(blocks.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in batch.column("ids"):
                ids = np.frombuffer(raw.as_buffer() if raw.is_valid else b"", kind)
                at = np.flatnonzero(ids == separator)
                rows.append((len(ids), len(at), int(at[0]) if len(at) else None, int(at[-1]) if len(at) else None, np.diff(at) - 1))
            n, n_seps, first, last, inner = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("file_id"), batch.column("block_no").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(n_seps, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(inner, pa.list_(pa.int64()))],
                ["file_id", "block_no", "n", "n_seps", "first", "last", "inner"],
            )

    found = staged(blocks.mapInArrow(tidy(scan), f"file_id {key}, block_no long, n long, n_seps long, first long, last long, inner array<long>"), "separators")
    carried = _scanned(found.drop("inner"))
    sizes = F.concat(F.array(F.col("ids_before") + F.col("first") - F.col("done")), "inner")
    closed = carried.where("n_seps > 0").join(found.select("file_id", "block_no", "inner"), ["file_id", "block_no"]).select("file_id", "docs_before", F.posexplode(sizes).alias("i", "n_tokens"))
    tails = carried.groupBy("file_id").agg(F.max(F.greatest("done", F.coalesce(F.col("ids_before") + F.col("last") + 1, F.lit(0)))).alias("done"), F.max(F.col("ids_before") + F.col("n")).alias("n"), F.max(F.col("docs_before") + F.col("n_seps")).alias("nth"))
    return closed.select("file_id", (F.col("docs_before") + F.col("i")).alias("nth"), "n_tokens", F.lit(True).alias("closed")).unionByName(
        tails.where("n > done").select("file_id", "nth", (F.col("n") - F.col("done")).alias("n_tokens"), F.lit(False).alias("closed"))
    )


def _scanned(short: DataFrame) -> DataFrame:
    """The blocks' short rows with ids_before, docs_before and done (ids up to and with the last separator before): a prefix
    scan in runs of blocks, then over the runs, so no task sorts all blocks of a file."""
    zero = F.lit(0).cast("long")
    runs = short.withColumn("run", F.floor(F.col("block_no") / RUN))
    within = Window.partitionBy("file_id", "run").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    inside = runs.withColumn("ids_in", F.coalesce(F.sum("n").over(within), zero)).withColumn("docs_in", F.coalesce(F.sum("n_seps").over(within), zero))
    inside = inside.withColumn("done_in", F.max(F.col("ids_in") + F.col("last") + 1).over(within))
    totals = inside.groupBy("file_id", "run").agg(F.sum("n").alias("n"), F.sum("n_seps").alias("seps"), F.max(F.col("ids_in") + F.col("last") + 1).alias("done"))
    before = Window.partitionBy("file_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("file_id", "run", F.coalesce(F.sum("n").over(before), zero).alias("ids_base"), F.coalesce(F.sum("seps").over(before), zero).alias("docs_base"), F.col("done").alias("own"))
    base = base.withColumn("done_base", F.coalesce(F.max(F.col("ids_base") + F.col("own")).over(before), zero)).drop("own")
    out = inside.join(base, ["file_id", "run"])
    done = F.coalesce(F.col("ids_base") + F.col("done_in"), F.col("done_base"))
    return out.select("file_id", "block_no", "n", "n_seps", "first", "last", (F.col("ids_base") + F.col("ids_in")).alias("ids_before"), (F.col("docs_base") + F.col("docs_in")).alias("docs_before"), done.alias("done"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: ids of every whole document, counted from the flat files."""
    blocks, manifest = write_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return count_tokens(blocks).join(manifest, ["file_id", "nth"]).select("doc_id", "n_tokens")
