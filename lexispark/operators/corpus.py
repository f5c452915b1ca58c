"""Extraction of a corpus from paper rows, and statistics of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions import text as T
from lexispark.storage import numbered, release, staged

FIELDS = ("title", "abstract", "full_text", "acl_id", "year", "author", "url")
MIN_WORDS, MAX_DOCS = 3000, 40000


def with_dense_id(df: DataFrame, order: str, name: str = "doc_id") -> DataFrame:
    """`name` counts from 0 in the order of `order`; of ties, in the order of a hash of the whole row."""
    return numbered(df, order, name=name)


def _among_first(rows: DataFrame, order: str, most: int) -> Column:
    """Whether a row is among the first `most` of `rows` in the order of `order`, or equal to the last of them. Only `order` is sorted, in
    ranges, and never in one task; the rows stay where they are."""
    if most < 1:
        return F.lit(False)
    keys = staged(rows.select(F.col(order).alias("at")), "keys")
    last = numbered(keys, "at", name="n").where(F.col("n") == most - 1).select("at").first()
    release(keys)
    if last is None:
        return F.lit(True)
    null = F.col(order).isNull()
    return null if last["at"] is None else null | (F.col(order) <= F.lit(last["at"]).cast(rows.schema[order].dataType))


def cleaned(papers: DataFrame) -> DataFrame:
    """Paper rows with all fields cleaned, and their word counts."""
    out = papers.withColumns({c: T.clean_text(F.col(c)) for c in FIELDS if c in papers.columns})
    return out.withColumn("word_count", T.word_count(F.col("full_text")))


def filter_report(papers: DataFrame, order: str, min_words: int = MIN_WORDS, max_docs: int = MAX_DOCS) -> DataFrame:
    """One row: saved, skipped_empty, skipped_short. Rows are taken in the order of `order` (unique) until max_docs are saved; those
    after the last saved one aren't looked at."""
    rows = cleaned(papers).select(F.col(order).alias("at"), (F.col("full_text") == "").alias("empty"), (F.col("word_count") >= min_words).alias("long"))
    last = rows.where(~F.col("empty") & F.col("long")).orderBy("at").limit(max_docs).agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last"))
    seen = rows.crossJoin(F.broadcast(last)).where((F.col("n") < max_docs) | (F.col("at") <= F.col("last")))
    return seen.agg(F.count_if(~F.col("empty") & F.col("long")).alias("saved"), F.count_if("empty").alias("skipped_empty"), F.count_if(~F.col("empty") & ~F.col("long")).alias("skipped_short"))


def extract(papers: DataFrame, order: str, min_words: int = MIN_WORDS, max_docs: int = MAX_DOCS) -> DataFrame:
    """Cleaned papers of at least min_words words, numbered in the order of `order`, max_docs at most: all their fields,
    doc_id, file, doc_text, word_count and text_length."""
    enough = lambda df: cleaned(df).where((F.col("full_text") != "") & (F.col("word_count") >= min_words))
    first = _among_first(enough(papers), order, max_docs)
    # asked before texts are cleaned, unless it is a cleaned column itself; written, since ranges are sampled in a pass of its own
    kept = staged(enough(papers).where(first) if order in FIELDS else enough(papers.where(first)), "kept")
    numbers = with_dense_id(kept, order).where(F.col("doc_id") < max_docs)
    release(kept)
    text = T.document_text(*[F.col(c) for c in ("title", "abstract", "full_text")])
    return numbers.withColumns({"file": T.file_name(F.col("doc_id")), "doc_text": text, "text_length": F.length(text).cast("long")})


def metadata(extracted: DataFrame) -> DataFrame:
    return extracted.select("doc_id", "file", "acl_id", "title", "author", "year", "url", "word_count", "text_length")


def raw_size(spark: SparkSession, path: str) -> int:
    """Bytes of the files of a source table, as they lie there."""
    files = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("n")).distinct()
    return files.agg(F.sum("n")).first()[0] or 0


def corpus_stats(docs: DataFrame, raw_bytes: int, text: str = "text") -> DataFrame:
    """One row of totals and averages; averages of nothing are 0. `raw_bytes` is the source's `raw_size`."""
    t = F.coalesce(F.col(text), F.lit(""))
    totals = docs.select(F.octet_length(t).cast("long").alias("b"), F.char_length(t).cast("long").alias("c"), T.word_count(T.clean_text(t)).alias("w"))
    totals = totals.agg(F.count(F.lit(1)).alias("docs"), *[F.coalesce(F.sum(x), F.lit(0)).alias(n) for x, n in (("b", "bytes"), ("c", "chars"), ("w", "words"))])
    average = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("docs")), F.lit(0.0)).alias(f"avg_{c}")
    return totals.select(F.lit(raw_bytes).cast("long").alias("raw_bytes"), "docs", "bytes", "chars", "words", average("bytes"), average("chars"), average("words"))


def token_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: files, tokens, avg_token_length, bytes, kilobytes."""
    t = F.coalesce(F.col(text), F.lit(""))
    each = docs.select(F.octet_length(t).cast("long").alias("b"), T.tokenize(t).alias("tokens"))
    each = each.select("b", F.size("tokens").cast("long").alias("n"), F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("l"))
    totals = each.agg(F.count(F.lit(1)).alias("files"), *[F.coalesce(F.sum(x), F.lit(0)).alias(n) for x, n in (("n", "tokens"), ("l", "letters"), ("b", "bytes"))])
    return totals.select("files", "tokens", F.coalesce(F.try_divide("letters", "tokens"), F.lit(0.0)).alias("avg_token_length"), "bytes", (F.col("bytes") / 1024).alias("kilobytes"))
