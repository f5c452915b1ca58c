"""1. Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

Fitting takes a bounded sample of labelled rows (`per_label` of each label, by a hash of doc_id, so always the same
rows). A text's terms are its hashed byte trigrams, its trigrams of character classes (so that shape counts beside
vocabulary), and bands of its length and of its shares of words that repeat the last one or any earlier one. Weighted by
log frequency and inverse document frequency they are reduced by a truncated singular value decomposition; the reduced
vectors and their labels are broadcast (2 * per_label vectors of `dims` numbers: half a megabyte, whatever the size of the corpus).

Scoring reads every whole text: blocks of documents are projected and multiplied with all labelled vectors, exactly; the
k nearest vote with the power `sharpness` of their cosine, and labels are weighted back to their share among all
labelled training rows. Scores depend on the text alone.

Defined results: null and empty texts, and texts without a word, score 0.0; with labelled
rows of one label only every score is that label's; with none at all every score is 0.5; null and unknown labels and
null doc_ids are not learnt from; of a doc_id with several texts the least one is learnt, and one with both labels counts for both;
equal texts get equal scores; an empty table gives an empty table; other columns
travel along and columns named like ours are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm.common import Words, slices, text_buffers, tidy
from lexispark.session import ready

#: Places of hashed trigrams, of trigrams of classes, and of bands.
TRIGRAMS, SHAPES, BANDS = 4096, 1024, 40
FEATURES = TRIGRAMS + SHAPES + BANDS
#: How much each of the three counts in a vector.
WEIGHTS = (0.5, 1.0, 1.0)
BLOCK_DOCS = 256
OURS = ("held_out", "score", "predicted")


def _blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of documents, bytes, offsets) of blocks that are small in both."""
    data, offsets = text_buffers(column)
    for a, b in slices(offsets):
        for c in range(a, b, BLOCK_DOCS):
            d = min(b, c + BLOCK_DOCS)
            yield d - c, data[offsets[c] : offsets[d]], offsets[c : d + 1] - offsets[c]


def _classes() -> np.ndarray:
    """Letters, capitals and digits as one each, white space as two; other bytes stand for themselves."""
    c = np.arange(256, dtype=np.uint32)
    c[[*range(97, 123), *range(0x80, 0x100)]] = 97
    c[65:91] = 65
    c[48:58] = 48
    return c


_CLASS = _classes()


def _hashed(x: np.ndarray, bits: int) -> np.ndarray:
    h = ((x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))) * np.uint32(0x27D4EB2F)
    return (h >> np.uint32(32 - bits)).astype(np.int64)


def _band(x: np.ndarray, most: float, n: int) -> np.ndarray:
    """x (0 to `most`) as soft membership in n bands."""
    at = np.clip(x / most, 0, 1) * (n - 1)
    return np.maximum(0, 1 - np.abs(at[:, None] - np.arange(n)))


def term_counts(n: int, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """n x FEATURES counts of each document's terms; all zero for a document without a word."""
    out = np.zeros((n, FEATURES), np.float32)
    if not len(data):
        return out
    doc = np.repeat(np.arange(n), np.diff(offsets))
    whole = doc[:-2] == doc[2:]
    for first, size, x in ((0, TRIGRAMS, data.astype(np.uint32)), (TRIGRAMS, SHAPES, _CLASS[data])):
        if len(data) >= 3:
            place = (doc[:-2] * size + _hashed(x, size.bit_length() - 1))[whole]
            out[:, first : first + size] = np.bincount(place, minlength=n * size).reshape(n, size)
    w = Words(data, offsets)
    count = w.counts()
    of = np.repeat(np.arange(n), count)
    h = w.hashes()
    last = np.zeros(len(h), bool)
    last[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((h, of))
    again = np.zeros(len(h), bool)
    again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
    total = np.maximum(count, 1)
    share = lambda flag: np.bincount(of[flag], minlength=n) / total
    bands = np.hstack([_band(share(last), 1, 12), _band(share(again), 1, 12), _band(np.log2(total), 15, 16)])
    out[:, TRIGRAMS + SHAPES :] = np.round(100 * bands)
    out[count == 0] = 0
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x, a, b = np.log1p(counts) * idf, TRIGRAMS, TRIGRAMS + SHAPES
    return np.hstack([w * _unit(part) for w, part in zip(WEIGHTS, (x[:, :a], x[:, a:b], x[:, b:]))]).astype(np.float32)


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weight: tuple[float, float]
    k: int
    sharpness: float

    def reduce(self, counts: np.ndarray) -> np.ndarray:
        return _unit(_weighted(counts, self.idf) @ self.axes)

    def score(self, counts: np.ndarray) -> np.ndarray:
        near = self.reduce(counts) @ self.vectors.T
        k = min(self.k, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(near, top, 1), 1e-6).astype(np.float64) ** self.sharpness
        y = self.labels[top]
        good, bad = self.weight[1] * (w * y).sum(1), self.weight[0] * (w * (1 - y)).sum(1)
        return np.where(counts.any(axis=1), good / (good + bad), 0.0)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 1024, dims: int = 64, k: int = 32, sharpness: float = 8.0, seed: int = 3) -> Model | None:
    """A model of `labels` (doc_id, quality) on the texts of `docs`, held-out rows left out; None without labelled rows."""
    ready(docs.sparkSession)
    rows = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out())
    shares = {r["quality"]: r["count"] for r in rows.groupBy("quality").count().collect()}
    if not shares:
        return None
    order = F.xxhash64("doc_id", F.lit(seed))
    sample = None
    for y in sorted(shares):
        part = rows.where(F.col("quality") == y).dropDuplicates(["doc_id"]).orderBy(order, "doc_id").limit(per_label)
        sample = part if sample is None else sample.unionByName(part)
    picked = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [term_counts(*b).clip(0, 65535).astype("<u2") for b in _blocks(batch.column("text"))]
            if parts:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array([r.tobytes() for p in parts for r in p], pa.binary())], ["doc_id", "quality", "counts"])

    got = picked.mapInArrow(tidy(count), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality int, counts binary").orderBy("doc_id", "quality").toArrow()
    if not len(got):
        return None
    labels_ = got.column("quality").to_numpy().astype(np.float64)
    counts = np.empty((len(got), FEATURES), np.uint16)
    for i, raw in enumerate(got.column("counts")):
        counts[i] = np.frombuffer(raw.as_buffer(), "<u2")
    del got
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
    x = np.empty(counts.shape, np.float32)
    for i in range(0, len(x), 256):
        x[i : i + 256] = _weighted(counts[i : i + 256].astype(np.float32), idf)
    axes = _truncated_svd(x, min(dims, len(x), FEATURES), seed)
    model = Model(idf, axes, _unit(x @ axes), labels_, (1.0, 1.0), k, sharpness)
    total = sum(shares.values())
    model.weight = tuple(shares.get(y, 0) / total / max(1, (labels_ == y).sum()) for y in (0, 1))
    return model


def _truncated_svd(x: np.ndarray, dims: int, seed: int) -> np.ndarray:
    """The leading right singular vectors, by random projection and power iterations."""
    q = np.random.default_rng(seed).standard_normal((x.shape[1], dims + 16)).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :dims].astype(np.float32)


def classify(docs: DataFrame, model: Model | None, cutoff: float = 0.3) -> DataFrame:
    """`docs` without text, and held_out, score and predicted."""
    spark = docs.sparkSession
    ready(spark)
    docs = docs.drop(*OURS)
    rest = [c for c in docs.columns if c != "text"]
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            parts = [m.score(term_counts(*b)) if m else np.full(b[0], 0.5) for b in _blocks(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())], [*rest, "score"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"] + ["score double"])
    return docs.mapInArrow(tidy(score), schema).withColumns({"held_out": held_out(), "predicted": (F.col("score") >= cutoff).cast("int")})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every whole text of documents, as labels.quality marks it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classify(docs, model).select("doc_id", "held_out", "score", "predicted")
