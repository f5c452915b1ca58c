"""Ranked search: the sum of frequencies of the query's tokens, each as often as it is asked for."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexispark.functions.stemmer import stem
from lexispark.functions.text import TOKEN
from lexispark.operators.index import Index

TOP = 10


def query_tokens(query: str) -> list[str]:
    return [t.lower() for t in re.findall(TOKEN, query)]


def query_terms(query: str, stemmed: bool = False) -> Counter:
    return Counter(stem(t) if stemmed and re.fullmatch("[a-z]{3,}", t) else t for t in query_tokens(query))


def _terms(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def ranked(index: Index, query: str, k: int = TOP, stem_query: bool = False) -> DataFrame:
    """rank, doc_id, score, path: best first, equal scores by doc_id. The terms reach the postings as a pushed-down
    filter, so of files clustered by term only the row groups with these terms are read."""
    asked = query_terms(query, stem_query)
    some = index.postings.where(F.col("term").isin(list(asked)))
    weight = F.lit(0)
    for t, n in asked.items():
        weight = F.when(F.col("term") == t, n).otherwise(weight)
    top = some.groupBy("doc_id").agg(F.sum(F.col("tf") * weight).cast("double").alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)
    placed = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).cast("long"))
    return index.docs.select("doc_id", "path").join(F.broadcast(placed), "doc_id").select("rank", "doc_id", "score", "path")


def ranked_batch(index: Index, queries: dict[str, str], k: int = TOP, stem_query: bool = False) -> DataFrame:
    """query_id, rank, doc_id, score of many queries in one pass over the postings. Queries are broadcast: they come as a
    dictionary from the driver, so their size is what the caller holds anyway."""
    rows = [(q, t, n) for q, text in queries.items() for t, n in query_terms(text, stem_query).items()]
    asked = _terms(index.postings.sparkSession, rows, "query_id string, term string, n long")
    scored = index.postings.join(F.broadcast(asked), "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("tf") * F.col("n")).cast("double").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
