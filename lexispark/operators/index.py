"""The inverted index: documents, postings and vocabulary as tables clustered by term."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexispark.functions import counting
from lexispark.functions import text as T
from lexispark.session import ready
from lexispark.storage import summed_before

#: Bytes of a posting in the binary layout: document and frequency.
POSTING = 8


@dataclass
class Index:
    """docs(doc_id, title, path, token_count), postings(term, doc_id, tf), the vocabulary where it is stored, and the blocks(term, doc_ids,
    tfs) that the postings come from, if they do."""

    docs: DataFrame
    postings: DataFrame
    stored: DataFrame | None = None
    blocks: DataFrame | None = None

    @property
    def vocabulary(self) -> DataFrame:
        return placed(self.frequencies) if self.stored is None else self.stored

    @property
    def frequencies(self) -> DataFrame:
        """term, df."""
        if self.stored is not None:
            return self.stored.select("term", "df")
        return frequencies(as_blocks(self.postings) if self.blocks is None else self.blocks)


def tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, position (from 0), term."""
    return docs.select("doc_id", F.posexplode(T.tokenize(F.col(text))).alias("position", "term"))


def token_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, token_count: documents without tokens included."""
    return docs.select("doc_id", T.token_count(F.col(text)).alias("token_count"))


def blocks(docs: DataFrame, text: str = "text", stem: bool = False) -> DataFrame:
    """term, doc_ids, tfs: postings of many documents each, every posting in one block. Documents are counted by themselves, without a
    shuffle; only if rows repeat a doc_id, which is looked for first, their counts are summed."""
    ready(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", F.col(text).alias("text")).mapInArrow(counting.counter(stem), f"term string, doc_ids array<{kind}>, tfs array<long>")
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return found
    return as_blocks(exploded(found).groupBy("term", "doc_id").agg(F.sum("tf").alias("tf")))


def exploded(blocks: DataFrame) -> DataFrame:
    """term, doc_id, tf of blocks."""
    return blocks.select("term", F.inline(F.arrays_zip("doc_ids", "tfs")).alias("doc_id", "tf"))


def as_blocks(post: DataFrame) -> DataFrame:
    """Each posting as a block of its own."""
    return post.select("term", F.array("doc_id").alias("doc_ids"), F.array("tf").alias("tfs"))


def frequencies(blocks: DataFrame) -> DataFrame:
    """term, df."""
    return blocks.groupBy("term").agg(F.sum(F.size("doc_ids")).alias("df"))


def postings(docs: DataFrame, text: str = "text", stem: bool = False) -> DataFrame:
    """term, doc_id, tf."""
    return exploded(blocks(docs, text, stem))


def build(docs: DataFrame, text: str = "text", path: str | None = None, stem: bool = False) -> Index:
    meta = docs.select("doc_id", T.extract_title(F.col(text)).alias("title"), (F.col(path) if path else T.file_name(F.col("doc_id"))).alias("path"), T.token_count(F.col(text)).alias("token_count"))
    found = blocks(docs, text, stem)
    return Index(meta, exploded(found), blocks=found)


def lists(blocks: DataFrame) -> DataFrame:
    """term, df, postings (by document), for layouts that hold a term's postings in one line: the most frequent term must fit a row.
    Search and vocabulary don't use them."""
    pairs = F.arrays_zip(F.col("doc_ids").alias("doc_id"), F.col("tfs").alias("tf"))
    grouped = blocks.groupBy("term").agg(F.array_sort(F.flatten(F.collect_list(pairs))).alias("postings"))
    return grouped.select("term", F.size("postings").cast("long").alias("df"), "postings")


def vocabulary(post: DataFrame) -> DataFrame:
    """The vocabulary of postings."""
    return placed(frequencies(as_blocks(post)))


def placed(df: DataFrame) -> DataFrame:
    """term, df, postings_offset, postings_count in byte order of terms. The running offset is taken within sampled ranges of terms
    and over the ranges' totals, so no task holds the whole vocabulary."""
    rows = summed_before(df, "term", value="df", name="before")
    return rows.select("term", "df", (POSTING * F.col("before")).alias("postings_offset"), F.col("df").alias("postings_count"))


def header_stats(index: Index) -> DataFrame:
    """One row: docs, terms, postings, avg_term_length (over distinct terms), and the sizes of the binary files."""
    d = index.docs.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"))
    v = index.frequencies.agg(F.count(F.lit(1)).alias("terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("postings"), F.coalesce(F.avg(F.length("term")), F.lit(0.0)).alias("avg_term_length"), F.coalesce(F.sum(24 + F.length("term")), F.lit(0)).alias("vocab_bytes"))
    return d.crossJoin(v).select("docs", "tokens", "terms", "postings", "avg_term_length", "vocab_bytes", (POSTING * F.col("postings")).alias("postings_bytes"))


def dump_docs(index: Index, n: int = 5) -> DataFrame:
    return index.docs.orderBy("doc_id").limit(n)


def dump_terms(index: Index, n: int = 5) -> DataFrame:
    """The first n terms, each with its first n postings."""
    first = index.vocabulary.select("term", "df").orderBy("term").limit(n)
    rows = index.postings.join(F.broadcast(first), "term").withColumn("nth", F.row_number().over(Window.partitionBy("term").orderBy("doc_id"))).where(F.col("nth") <= n)
    return rows.select("term", "df", "nth", "doc_id", "tf")


def term_totals(post: DataFrame) -> DataFrame:
    """term, freq in the whole collection."""
    return post.groupBy("term").agg(F.sum("tf").alias("freq"))


def term_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """term, freq in the whole collection, straight from the texts: one shuffle of a row a term and task."""
    return docs.select(F.explode(T.tokenize(F.col(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("freq"))
