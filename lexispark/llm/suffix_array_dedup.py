"""3. Suffix-array dedup, by range-partitioned suffixes, a local multikey quicksort and LCPs, over the bytes of texts.

Suffixes start at sampled bytes, the anchors that every repeat of `length` bytes has at one place (see repeats.py). They are
partitioned in byte order by their leading bytes: `k` of them, or more where more than `hot` suffixes share those: the windows
in question then take longer anchors (repeats.Unit.longer: 304 bytes, 376, ..., at last `length`). The splitters are sampled by Spark's range partitioning. Each bucket sorts its suffixes by a multikey quicksort
whose characters are eight bytes, and takes the longest common prefixes (LCP) of neighbours; likewise for the texts before
the anchors, read backwards. Two windows are equal if their suffixes' LCP and that of the texts before them together
span `length` bytes. Suffixes that agree in all their leading bytes are in one bucket, so no window has equals beyond its boundaries.

Defined results: a null text is empty; texts shorter than `length` keep all their bytes; all places of a repeated string
lose it, the first included; rows that repeat a doc_id, equal or not, are documents of their own; of equal texts of
`length` bytes all lose everything; an empty table gives an empty table; other columns travel along in `dedup`, where the
remaining bytes replace the text of documents that lose some (as binary, since cuts may fall inside a character).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm.common import text_slices, tidy
from lexispark.llm.repeats import HOT, Unit, removed, spans, text_id

LENGTH, K = 400, 16


def multikey_quicksort(rows: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order of rows of bytes within their groups; of rows that are equal so far, by the next eight bytes."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    keys = wide.view(">u8")
    order, part, alive = np.arange(len(rows)), group, np.arange(len(rows))
    for i in range(keys.shape[1] + 1):
        many = np.bincount(part, minlength=1)[part] > 1
        alive, part = alive[many], part[many]
        if not len(alive):
            break
        here = order[alive]
        # a text that ends before is least; zeros follow the end
        key = keys[here, i].astype(np.uint64) if i < keys.shape[1] else size[here].astype(np.uint64)
        by = np.lexsort((key, part))
        order[alive] = here[by]
        part, key = part[by], key[by]
        part = np.cumsum(np.r_[True, (part[1:] != part[:-1]) | (key[1:] != key[:-1])]) - 1
    return order


def _elsewhere(table: pa.Table):
    """Marks the members of a class of several."""

    def chosen(who: np.ndarray, label: np.ndarray) -> np.ndarray:
        order = np.argsort(label, kind="stable")
        same = label[order][1:] == label[order][:-1]
        out = np.empty(len(who), bool)
        out[order] = np.append(False, same) | np.append(same, False)
        return out

    return chosen


def repeats(docs: DataFrame, length: int = LENGTH, k: int = K, hot: int = HOT) -> DataFrame:
    """id, least_id, copies, spans of repeated windows; see repeats.spans."""

    def buckets(suffixes: DataFrame, k: int) -> DataFrame:
        """In ranges of the leading bytes. Splitters go through the driver, so of many bytes the rest is a digest: equal ones still meet."""
        leading = F.substring("around", F.col("back").cast("int") + 1, F.lit(k))
        key = F.concat(F.substring(leading, 1, K), F.unhex(F.md5(leading))) if k > 2 * K else leading
        return suffixes.withColumn("key", key).repartitionByRange("key")

    return spans(docs, Unit(False, length, min(k, length)), buckets, multikey_quicksort, _elsewhere, False, hot)


def dedup(docs: DataFrame, length: int = LENGTH, k: int = K, hot: int = HOT, digests: bool = False) -> DataFrame:
    """`docs` with n_bytes, n_removed, n_spans (runs of removed bytes) and the remaining bytes as text; with `digests`,
    kept_sha256 in place of the text."""
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept_sha256", "_spans", "_copy", "_id", "_copies")
    found = repeats(docs, length, k, hot).select(F.col("id").alias("_id"), F.col("copies").alias("_copies"), F.col("spans").alias("_spans"))
    joined = docs.withColumn("_id", text_id()).join(found, "_id", "left")
    joined = joined.withColumn("_copy", F.coalesce(F.col("_copies") > 1, F.lit(False))).drop("_id", "_copies")
    rest = [c for c in docs.columns if c != "text"]
    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    last = "kept_sha256 string" if digests else "text binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column("text")):
                size = np.diff(offsets)
                gone = removed(batch.column("_spans"), slice(a, b), offsets, length)
                copy = batch.column("_copy").slice(a, b - a).to_numpy(zero_copy_only=False) & (size >= length)
                gone |= np.repeat(copy, size)
                lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[offsets])
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                edge = offsets[:-1][size > 0]
                begins[edge] = gone[edge]
                runs = np.diff(np.concatenate([[0], np.cumsum(begins)])[offsets])
                kept = [data[p:q].tobytes() if not n else data[p:q][~gone[p:q]].tobytes() for p, q, n in zip(offsets[:-1].tolist(), offsets[1:].tolist(), lost.tolist())]
                out = pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()) if digests else pa.array(kept, pa.binary())
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in rest], pa.array(size, pa.int64()), pa.array(lost, pa.int64()), pa.array(runs, pa.int64()), out], [*rest, "n_bytes", "n_removed", "n_spans", last.split()[0]])

    schema = ", ".join([f"`{c}` {fields[c]}" for c in rest] + ["n_bytes long, n_removed long, n_spans long", last])
    return joined.mapInArrow(tidy(cut), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: strings of 400 bytes over all documents."""
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), digests=True)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: Windows of 400 bytes as hexadecimal digits; runs of windows that overlap or touch are one span.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, i, md5_number(substring(h, (2 * i + 1)::BIGINT, 800)) AS m FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 399)) AS i FROM d WHERE len(h) >= 800)
), r AS (
  SELECT doc_id, i FROM w JOIN (SELECT m FROM w GROUP BY m HAVING count(*) > 1) USING (m)
), s AS (
  SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 1 ELSE 0 END AS cut FROM r
), g AS (
  SELECT doc_id, i, sum(cut) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM s
), u AS (
  SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY doc_id, g
), v AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM u
), k AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substring(h, (2 * p + 1)::BIGINT, (2 * (a - p))::BIGINT), '' ORDER BY a) || substring(any_value(h), (2 * max(b) + 1)::BIGINT) AS h
  FROM v JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT d.doc_id, (len(d.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
