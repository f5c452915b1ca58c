"""From raw documents to training sequences: quality rules, near-dedup, substring dedup, decontamination, packing.

Each stage works on what the one before it kept and is written as Parquet before the next one reads it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm import decontamination, near_dup, packing, quality_rules, substring_dedup
from lexispark.storage import release, staged


def _apart(docs: DataFrame, ours: Iterable[str], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `stage` makes of `docs`, with the columns of `docs`; those named like the operator's own, or with dots and the like, are
    out of its way."""
    names = {c.lower() for c in ours}
    hidden = {c: f"__own{i}" for i, c in enumerate(docs.columns) if c.lower() in names or not c.isidentifier()}
    out = stage(docs.withColumnsRenamed(hidden))
    return out.select(*[F.col(f"`{hidden.get(c, c)}`").alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that the rules reject go. Null and empty texts fail the base rules and go; rows with a null doc_id,
    lang or source are judged like others; repeated rows get equal verdicts; an empty table stays empty; other columns stay."""
    ours = (*quality_rules.STATS, *quality_rules.MORE, *quality_rules.VERDICT, *quality_rules.X, *quality_rules.ROUNDING, "e", "e1", "e2", "e3", "level", "_level", "_lang", "_source")
    return _apart(docs, ours, lambda d: quality_rules.judge(d, keep_text=True).where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4 on five-word shingles from 0.8: the least doc_id of each component stays. Of its rows, those with equal
    texts stay once, and different texts all stay. Rows with a null doc_id are linked with nothing and all stay; so do null, empty and
    wordless texts, each row of a doc_id with equal ones once; an empty table stays empty; other columns stay (of equal rows, one row's)."""
    known = docs.where(F.col("doc_id").isNotNull())
    kept = near_dup.near_duplicates(known, k=5, num=80, den=100).where("kept").select(F.col("doc_id").alias("__kept")).distinct()
    stay = known.join(kept, F.col("doc_id") == F.col("__kept"), "left_semi")
    once = stay.withColumn("__digest", F.sha2("text", 256)).dropDuplicates(["doc_id", "__digest"])
    return once.select(*[F.col(f"`{c}`") for c in docs.columns]).unionAll(docs.where(F.col("doc_id").isNull()))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2 on windows of 50 words: the words that an earlier document has go; a document with none left goes too. Null, empty
    and short texts stay as they are; rows with a null doc_id lose nothing and cost others nothing; rows that repeat a doc_id aren't
    earlier than each other; an empty table stays empty; n_chars is counted again where words went, other columns stay."""

    def stage(d: DataFrame) -> DataFrame:
        out = substring_dedup.dedup(d).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
        chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long"))
        return out.withColumns({c: F.coalesce(chars, F.col(c)).cast(d.schema[c].dataType) for c in ("n_chars",) if c in d.columns})

    return _apart(docs, substring_dedup.OURS, stage)


def decontamination_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that hold a benchmark item go. Null and empty texts hold none; each row is judged by its text alone, so
    null and repeated doc_ids don't matter; an empty table stays empty; other columns stay."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: pieces with their ids, sequence and offset. A null or empty text is its closing id alone; repeated rows are packed
    each for itself; a null doc_id stays null; an empty table gives no pieces; other columns are left behind."""
    return packing.pack(docs, keep_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("near_dup", near_duplicates),
    ("substring_dedup", substrings),
    ("decontamination", decontamination_),
    ("packing", pack),
]

#: Estimates, hashing, edit distances and token ids are beyond SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(*last)
        last = [docs]
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
