"""Where tables come from: papers, text folders, text and binary indexes, configurations."""

from __future__ import annotations

import json
import re
import struct
from dataclasses import fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.operators.corpus import FIELDS, with_dense_id
from lexispark.operators.crawl import Config
from lexispark.operators.index import Index, exploded
from lexispark.sources import binary

MAGIC, VERSION = b"LEXISPK1", 1
#: Of the Parquet index; 2 has postings in blocks.
LAYOUT = 2


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """The seven columns of paper rows; no other column is read."""
    return spark.read.parquet(path).select(*FIELDS)


def read_text_folder(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (in order of file paths, from 0), path, text of the .txt files in a folder; unreadable files are left out."""
    files = spark.read.option("ignoreCorruptFiles", "true").text(path, wholetext=True, pathGlobFilter="*.txt")
    return with_dense_id(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")), "path").select("doc_id", "path", "text")


def read_docs_tsv(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, path; lines without a tab are left out."""
    line = F.split("value", "\t", 2)
    return spark.read.text(path).where(F.col("value").contains("\t")).select(line[0].try_cast("long").alias("doc_id"), line[1].alias("path")).where("doc_id is not null")


def read_postings_tsv(spark: SparkSession, path: str) -> DataFrame:
    """term, doc_id, tf of lines `term id:tf id:tf ...`; items without a colon are left out; of lines that repeat a term
    the last one in the file counts."""
    lines = spark.read.text(path).select(F.split("value", "\t").alias("p"), F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()).alias("at"))
    last = lines.select(F.col("p")[0].alias("term"), F.expr("slice(p, 2, greatest(size(p) - 1, 0))").alias("items"), "at").groupBy("term").agg(F.max_by("items", "at").alias("items"))
    item = F.split("item", ":", 2)
    return last.select("term", F.explode("items").alias("item")).where(F.col("item").contains(":")).select("term", item[0].try_cast("long").alias("doc_id"), item[1].try_cast("long").alias("tf")).where("doc_id is not null and tf is not null")


def read_index(spark: SparkSession, path: str) -> Index:
    """An index as written by writers.write_index; its version is checked."""
    version = spark.read.parquet(f"{path}/meta").first()["version"]
    if version != LAYOUT:
        raise ValueError(f"index version {version}, expected {LAYOUT}")
    docs, blocks, vocabulary = (spark.read.parquet(f"{path}/{part}") for part in ("docs", "postings", "vocabulary"))
    return Index(docs, exploded(blocks), vocabulary, blocks)


def read_binary_index(spark: SparkSession, path: str) -> Index:
    """The four-file binary layout, for interchange; executors read ranges of its files, which must lie where all of them can."""
    fs, folder = binary.opened(path)
    with fs.open_input_stream(f"{folder}/index_header.bin") as header:
        magic, version, n_docs, n_terms, _ = struct.unpack("<8sIIII", header.read(24))
    if magic != MAGIC or version != VERSION:
        raise ValueError("not an index of this version")
    return Index(binary.read_docs(spark, path, n_docs), binary.read_postings(spark, path, n_terms))


def read_config(path: str) -> Config:
    """A crawl configuration: JSON, or `key: value` lines with `- item` lists, in sections or not. An unknown key is an error."""
    text = Path(path).read_text(encoding="utf-8")
    if text.lstrip().startswith("{"):
        found = {}
        for key, value in json.loads(text).items():
            found |= {_KEYS.get((key, k), k): v for k, v in value.items()} if isinstance(value, dict) else {key: value}
    else:
        found, section, key = {}, "", ""
        for line in text.splitlines():
            line = re.sub(r"(^|\s)#.*", "", line).rstrip()
            if line.lstrip().startswith("- "):
                found.setdefault(key, []).append(_scalar(line.lstrip()[2:]))
            elif ":" in line:
                name, value = (x.strip() for x in line.split(":", 1))
                section = section if line[0] == " " else name
                key = _KEYS.get((section, name), name)
                if value:
                    found[key] = _scalar(value)
    unknown = set(found) - {f.name for f in fields(Config)}
    if unknown:
        raise ValueError(f"unknown keys in {path}: {', '.join(sorted(unknown))}")
    return Config(**found)


#: Names of keys that only a section makes clear.
_KEYS = {("db", "path"): "db_path"}


def _scalar(value: str) -> int | str:
    value = value.strip()
    return int(value) if re.fullmatch(r"-?\d+", value) else value.strip("\"'")
