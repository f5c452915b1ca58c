"""The four files of the binary layout, byte for byte: executors write parts that are joined in order, and read ranges of bytes.

The folder must be one that the driver and all executors share, in a file system that Arrow opens. The driver copies bytes and looks
at record lengths, a buffer at a time; it holds no rows.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from lexispark.session import ready

#: Bytes that are copied or scanned at once.
BUFFER = 8 << 20
#: Bytes of records, and of postings, that a worker decodes at once.
CHUNK = 2 << 20

_WRITTEN = "part int, at string, n long"
DOC, TERM, POSTED = "<IIII", "<I", "<IQII"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a path, and the path as it names it."""
    if "://" in path and not path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(urlparse(path).path if path.startswith("file:") else path)


# ---- writing -------------------------------------------------------------------------------------------------------
def _docs(batch: pa.RecordBatch) -> bytes:
    out = []
    for doc_id, title, path, count in zip(*(batch[c].to_pylist() for c in ("doc_id", "title", "path", "token_count")), strict=True):
        title, path = (title or "").encode(), (path or "").encode()
        out += (struct.pack(DOC, doc_id, len(title), len(path), count), title, path)
    return b"".join(out)


def _terms(batch: pa.RecordBatch) -> bytes:
    out = []
    for term, n, offset in zip(*(batch[c].to_pylist() for c in ("term", "df", "postings_offset")), strict=True):
        term = term.encode()
        out += (struct.pack(TERM, len(term)), term, struct.pack(POSTED, n, offset, n, 0))
    return b"".join(out)


def _postings(batch: pa.RecordBatch) -> bytes:
    out = np.empty((batch.num_rows, 2), "<u4")
    for i, c in enumerate(("doc_id", "tf")):
        if batch[c].null_count:
            raise ValueError(f"{c} is null: the binary layout has no place for it")
        values = batch[c].to_numpy(zero_copy_only=False)
        if len(values) and (values.min() < 0 or values.max() >= 1 << 32):
            raise ValueError(f"{c} is not of 32 bits")
        out[:, i] = values
    return out.tobytes()


def _write(rows: DataFrame, order: tuple[str, ...], encode: Callable[[pa.RecordBatch], bytes], at: str) -> int:
    """Write `rows` to the file `at` in the order of `order`; their number."""
    parts = f"{at}.parts"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = opened(parts)
        part, n = TaskContext.get().partitionId(), 0
        name = f"{folder}/{part}-{uuid.uuid4().hex}"  # of this attempt
        with fs.open_output_stream(name) as out:
            for b in batches:
                out.write(encode(b))
                n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([n], pa.int64())], ["part", "at", "n"])

    fs, target = opened(at)
    _, folder = opened(parts)
    fs.create_dir(folder)
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    done = sorted(tuple(r) for r in sorted_.mapInArrow(write, _WRITTEN).collect())
    with fs.open_output_stream(target) as out:
        for _, name, _ in done:
            with fs.open_input_stream(name) as part:
                while piece := part.read(BUFFER):
                    out.write(piece)
            fs.delete_file(name)
    fs.delete_dir(folder)
    return sum(n for _, _, n in done)


def write(docs: DataFrame, vocabulary: DataFrame, postings: DataFrame, path: str, magic: bytes, version: int) -> None:
    ready(docs.sparkSession)
    fs, folder = opened(path)
    fs.create_dir(folder)
    n_docs = _write(docs.select("doc_id", "title", "path", "token_count"), ("doc_id",), _docs, f"{path}/forward.bin")
    _write(postings.select("term", "doc_id", "tf"), ("term", "doc_id"), _postings, f"{path}/postings.bin")
    n_terms = _write(vocabulary.select("term", "df", "postings_offset"), ("term",), _terms, f"{path}/vocab.bin")
    with fs.open_output_stream(f"{folder}/index_header.bin") as out:
        out.write(struct.pack("<8sIIII", magic, version, n_docs, n_terms, 0))


# ---- reading -------------------------------------------------------------------------------------------------------
def _scan(path: str, n: int, head: int, length: Callable[[bytes, int], int], tail: int = 0) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, last `tail` bytes) of n records, of which `length` tells the bytes after the `head` first ones."""
    fs, at = opened(path)
    with fs.open_input_stream(at) as stream:
        held, pos, base = b"", 0, 0
        for _ in range(n):
            while len(held) < pos + head or len(held) < (end := pos + head + length(held, pos)):
                more = stream.read(BUFFER)
                if not more:
                    raise ValueError(f"{path} ends within its records")
                held, base, pos = held[pos:] + more, base + pos, 0
            yield base + pos, base + end, held[end - tail : end]
            pos = end


def _doc_chunks(path: str, n: int) -> list[tuple[int, int]]:
    chunks, first, last = [], 0, 0
    for _, end, _ in _scan(path, n, struct.calcsize(DOC), lambda b, i: sum(struct.unpack_from(DOC, b, i)[1:3])):
        last = end
        if last - first >= CHUNK:
            chunks.append((first, last))
            first = last
    return chunks + [(first, last)] * (last > first)


def _term_chunks(path: str, n: int) -> list[tuple[int, int, int, int]]:
    """Ranges of records whose postings follow one another, each with the pieces of these postings."""
    chunks: list[tuple[int, int, int, int]] = []

    def close() -> None:
        chunks.extend((first, last, p, min(p + CHUNK, to)) for p in range(begin, to, CHUNK))

    first = last = begin = to = 0
    for start, end, tail in _scan(path, n, struct.calcsize(TERM), lambda b, i: struct.unpack_from(TERM, b, i)[0] + struct.calcsize(POSTED), struct.calcsize(POSTED)):
        _, offset, count, _ = struct.unpack(POSTED, tail)
        if offset != to or last - first >= CHUNK or to - begin >= CHUNK:
            close()
            first, begin = start, offset
        last, to = end, offset + 8 * count
    close()
    return chunks


def _bytes(source, start: int, end: int) -> bytes:
    found = source.read_at(end - start, start)
    if len(found) < end - start:
        raise ValueError("a file of the index ends before its records do")
    return found


def _read(spark: SparkSession, chunks: list[tuple], columns: str, decode: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    sc = spark.sparkContext
    return spark.createDataFrame(sc.parallelize(chunks, max(1, min(len(chunks), 4 * sc.defaultParallelism))), columns).mapInArrow(decode, schema)


def read_docs(spark: SparkSession, path: str, n: int) -> DataFrame:
    ready(spark)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = opened(f"{path}/forward.bin")
        with fs.open_input_file(at) as forward:
            for b in batches:
                for first, last in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    held, pos, rows = _bytes(forward, first, last), 0, []
                    while pos < len(held):
                        doc_id, title, file, count = struct.unpack_from(DOC, held, pos)
                        pos += struct.calcsize(DOC)
                        rows.append((doc_id, held[pos : pos + title].decode(), held[pos + title : pos + title + file].decode(), count))
                        pos += title + file
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.int64()))], ["doc_id", "title", "path", "token_count"])

    return _read(spark, _doc_chunks(f"{path}/forward.bin", n), "first long, last long", decode, "doc_id long, title string, path string, token_count long")


def read_postings(spark: SparkSession, path: str, n: int) -> DataFrame:
    ready(spark)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (fs, vocab_at), (_, posts_at) = opened(f"{path}/vocab.bin"), opened(f"{path}/postings.bin")
        with fs.open_input_file(vocab_at) as vocab, fs.open_input_file(posts_at) as posts:
            for b in batches:
                for first, last, begin, to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    held, pos, terms, ends = _bytes(vocab, first, last), 0, [], []
                    while pos < len(held):
                        (size,) = struct.unpack_from(TERM, held, pos)
                        pos += struct.calcsize(TERM)
                        _, offset, count, _ = struct.unpack_from(POSTED, held, pos + size)
                        if offset + 8 * count > begin and offset < to and count:
                            terms.append(held[pos : pos + size].decode())
                            ends.append(min(offset + 8 * count, to) - begin)
                        pos += size + struct.calcsize(POSTED)
                    pairs = np.frombuffer(_bytes(posts, begin, to), "<u4").reshape(-1, 2).astype(np.int64)
                    each = np.repeat(np.arange(len(terms), dtype=np.int32), np.diff(np.array(ends) // 8, prepend=0))
                    named = pa.DictionaryArray.from_arrays(pa.array(each), pa.array(terms, pa.string())).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([named, pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], ["term", "doc_id", "tf"])

    return _read(spark, _term_chunks(f"{path}/vocab.bin", n), "first long, last long, begin long, to long", decode, "term string, doc_id long, tf long")
