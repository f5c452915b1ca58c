"""2. Substring dedup, by prefix-partitioned suffix trees, over words.

Suffixes start at sampled words, the anchors that every repeat of `length` words has at one place (see repeats.py). They are
split into groups by their first `k` words, and where more than `hot` share those, by the first 16, 32 or `length` words, so
that each group fits a task's memory. A group's suffixes are made into a tree, from the root down: the suffixes of a node are
parted by their next word, those left alone are leaves, and the tree is kept as its leaves in order and the depths of
the inner nodes between neighbours. So are the texts before the anchors, read backwards. Suffixes below an inner node at depth
d whose texts before also share `length` - d words or more have a repeat in common; of the documents under such
a node all but the one with the least doc_id lose the repeat's words. Nodes above a group's prefix are shared by several
groups: windows that end there are counted by name.

Defined results: a null text has no words; a text of fewer than `length` words keeps all; rows that repeat a doc_id aren't
smaller than each other; of equal texts the least doc_id stays as it is and the others lose every word (if there are
`length`); a null doc_id is never smaller and has none smaller; an empty table gives an empty table; other columns travel
along in `dedup`, where the kept words, joined by one space, replace the text of documents that lose words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm.common import Words, text_slices, tidy
from lexispark.llm.repeats import HOT, Unit, removed, spans, text_id

LENGTH, K = 50, 8
OURS = ("n_words", "n_removed", "kept_sha256", "_spans", "_copy", "_id", "_least")
#: Lengths of prefixes beyond the first k words.
PREFIXES = (16, 32)


def tree(rows: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The leaves of each group's tree in order: top down, the suffixes of a node are parted by their next word."""
    order, node = np.arange(len(rows)), group
    alive = np.arange(len(rows))  # places of the order whose suffixes aren't alone in their node
    for depth in range(rows.shape[1] + 1):
        counts = np.bincount(node, minlength=1)
        many = counts[node] > 1
        alive, node = alive[many], node[many]
        if not len(alive):
            break
        here = order[alive]
        word = rows[here, depth] if depth < rows.shape[1] else size[here]
        by = np.lexsort((size[here], word, node))
        order[alive] = here[by]
        node, word = node[by], word[by]
        node = np.cumsum(np.r_[True, (node[1:] != node[:-1]) | (word[1:] != word[:-1])]) - 1
    return order


def _smaller_elsewhere(table: pa.Table):
    """Marks the members of a class whose doc_id isn't its least."""
    ids = table.column("doc_id").combine_chunks()
    rank = pc.rank(ids, "ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)
    known = ids.is_valid().to_numpy(zero_copy_only=False)

    def chosen(who: np.ndarray, label: np.ndarray) -> np.ndarray:
        order = np.argsort(label, kind="stable")
        new = np.flatnonzero(np.r_[True, label[order][1:] != label[order][:-1]])
        least = np.empty(len(who), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(rank[who][order], new), np.diff(np.append(new, len(who))))
        return (rank[who] > least) & known[who]

    return chosen


def _groups(suffixes: DataFrame, k: int | None = None) -> DataFrame:
    return suffixes.repartition("key")


def repeats(docs: DataFrame, length: int = LENGTH, k: int = K, hot: int = HOT) -> DataFrame:
    """id, least_id, copies, spans of repeated windows; see repeats.spans."""
    k = min(k, length)
    unit = Unit(True, length, k, tuple(n for n in PREFIXES if k < n < length) + (length,))
    return spans(docs, unit, _groups, tree, _smaller_elsewhere, True, hot)


def dedup(docs: DataFrame, length: int = LENGTH, k: int = K, hot: int = HOT, digests: bool = False) -> DataFrame:
    """`docs` with n_words, n_removed and, of documents that lose words, the text without them; with `digests`,
    kept_sha256 (of the kept words joined by one space) in place of the text."""
    docs = docs.drop(*OURS)
    found = repeats(docs, length, k, hot).select(F.col("id").alias("_id"), F.col("least_id").alias("_least"), F.col("spans").alias("_spans"))
    joined = docs.withColumn("_id", text_id()).join(found, "_id", "left")
    joined = joined.withColumn("_copy", F.coalesce(F.col("doc_id") > F.col("_least"), F.lit(False))).drop("_id", "_least")
    rest = [c for c in docs.columns if c != "text"]
    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    last = "kept_sha256" if digests else "text"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column("text")):
                w = Words(data, offsets)
                count = w.counts()
                gone = removed(batch.column("_spans"), slice(a, b), w.bounds, length)
                copy = batch.column("_copy").slice(a, b - a).to_numpy(zero_copy_only=False) & (count >= length)
                gone |= np.repeat(copy, count)
                lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.bounds])
                if digests:
                    out = pa.array([hashlib.sha256(x).hexdigest() for x in w.joined(~gone)], pa.string())
                else:
                    texts = batch.column("text").slice(a, b - a).to_pylist()
                    if lost.any():
                        kept = w.joined(~gone)
                        texts = [kept[i].decode() if lost[i] else t for i, t in enumerate(texts)]
                    out = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in rest], pa.array(count, pa.int64()), pa.array(lost, pa.int64()), out], [*rest, "n_words", "n_removed", last])

    schema = ", ".join([f"`{c}` {fields[c]}" for c in rest] + ["n_words long, n_removed long", f"{last} string"])
    return joined.mapInArrow(tidy(cut), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: windows of 50 words over all documents."""
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), digests=True)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), p AS (
  SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM w WHERE len(w) >= 50
), h AS (
  SELECT doc_id, i, md5_number(array_to_string(w[i:i + 49], ' ')) AS h FROM p
), m AS (
  SELECT h, min(doc_id) AS least FROM h GROUP BY h HAVING min(doc_id) < max(doc_id)
), s AS (
  SELECT doc_id, i FROM h JOIN m USING (h) WHERE doc_id > least
), g AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM s
), c AS (SELECT doc_id, list(j) AS gone FROM g GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE
         list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: NOT list_contains(gone, z[2])), lambda z: z[1]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN c USING (doc_id)
"""
