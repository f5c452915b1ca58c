"""8. Packing: first-fit decreasing with a tournament tree of bin capacities, in randomised groups of documents.

Each document becomes its token ids and a closing id, cut into pieces of `length` ids and a rest. A full piece is a sequence. Documents
are dealt to groups by a seeded hash of their row; a group takes its documents' rests by falling size, and a
tournament tree over the bins' free space finds the first bin with room in logarithmic time. A document brings its group
one rest at most, so groups are bounded whatever the texts and keys are: no source, long document or group of copies makes a large
task, and groups of thousands leave little padding.

Defined results: a null or empty text is its closing id alone; repeated rows are packed each for itself; a null doc_id
stays null; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm.common import binary_array, ragged, text_slices, tidy
from lexispark.llm.tokens import bpe, default_path
from lexispark.session import ready
from lexispark.storage import staged

LENGTH = 2048
#: Documents a group on average; with their ids, so many that a group's rests take 16 MB at most.
GROUP_DOCS, GROUP_WITH_IDS = 16384, 2048
#: Full pieces number their sequences from here on, by task and place; groups number theirs below.
FULL = 1 << 62


def pieces(docs: DataFrame, tokenizer: str, eod: int, length: int = LENGTH, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, nth (a number of the piece, by task and place) and, if asked for, ids
    (little-endian unsigned 32-bit) of each piece."""

    ready(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, nth = bpe(tokenizer), TaskContext.get().partitionId() << 40
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for a, b, data, offsets in text_slices(batch.column("text")):
                ids, counts = model.encode_slice(data, offsets)
                total = counts + 1
                with_end = np.insert(ids, np.cumsum(counts), np.uint32(eod)).astype("<u4")
                per = -(-total // length)
                doc = np.repeat(np.arange(b - a), per)
                start = ragged(np.zeros(b - a, np.int64), per) * length
                size = np.minimum(length, total[doc] - start)
                at = (np.cumsum(total) - total)[doc] + start
                raw = memoryview(with_end).cast("B")
                crc = [zlib.crc32(raw[4 * i : 4 * (i + n)]) for i, n in zip(at.tolist(), size.tolist())]
                cols = [doc_ids.slice(a, b - a).take(pa.array(doc)), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(total[doc]), pa.array(np.arange(nth, nth + len(doc)))]
                nth += len(doc)
                if keep_ids:
                    cols.append(binary_array(raw, 4 * size))
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "nth", *["ids"] * keep_ids]
    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(cut), f"doc_id {key}, start long, length long, ids_crc32 long, doc_tokens long, nth long" + ", ids binary" * keep_ids)


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each piece. The tree's leaves are the bins' free space; each inner node holds the larger
    of its two, so the first bin with room is found by going down from the root, left where left has room."""
    n = len(sizes)
    leaves = 1 << max(0, n - 1).bit_length()
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-sizes, kind="stable")
    for piece, size in zip(order.tolist(), sizes[order].tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        free = tree[node]
        bins[piece], offsets[piece] = node - leaves, capacity - free
        tree[node] = free - size
        while node > 1:
            node >>= 1
            left, right = tree[2 * node], tree[2 * node + 1]
            best = left if left >= right else right
            if tree[node] == best:
                break
            tree[node] = best
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str | None = None, eod: int = 1, length: int = LENGTH, group_docs: int | None = None, seed: int = 11, keep_ids: bool = False) -> DataFrame:
    """The pieces with sequence_id and offset. With keep_ids the pieces' ids come along: sorted by sequence_id and
    offset they are the sequences."""
    group_docs = group_docs or (GROUP_WITH_IDS if keep_ids else GROUP_DOCS)
    # tokenized once, and numbered once
    cut = staged(pieces(docs, tokenizer or default_path(), eod, length, keep_ids), "pieces")
    rests = cut.where(F.col("length") < length)
    n_groups = max(1, -(-rests.count() // group_docs))
    names = [f.name for f in cut.schema if f.name != "nth"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema if f.name != "nth") + ", sequence_id long, offset long"

    def place(group: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("nth")
        bins, offsets = first_fit_decreasing(table.column("length").to_numpy(), length)
        return table.select(names).append_column("sequence_id", pa.array((group[0].as_py() << 32) + bins)).append_column("offset", pa.array(offsets))

    placed = rests.withColumn("group", F.pmod(F.xxhash64("nth", F.lit(seed)), F.lit(n_groups))).groupBy("group").applyInArrow(place, schema)
    full = cut.where(F.col("length") == length).select(*names, (F.lit(FULL) + F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: all documents, byte_bpe_50k.json, closing id 1, 2048 ids a sequence."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
