"""What must not go through one process or one task, and that results stay whole."""

import struct
from itertools import groupby

import pytest

from lexispark.functions import counting
from lexispark.operators import corpus, index
from lexispark.sources import binary, readers, writers


def test_binary_index_is_not_held_by_the_driver(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{i % k}" for k in range(1, 9)) + " a a\nTitle: é") for i in range(300)], "doc_id long, text string")
    ix = index.build(docs)
    want = sorted(tuple(r) for r in ix.postings.collect())

    def never(*_, **__):
        raise AssertionError("rows went to the driver")

    monkeypatch.setattr(type(docs), "toLocalIterator", never)
    monkeypatch.setattr(binary, "CHUNK", 64)
    monkeypatch.setattr(binary, "BUFFER", 50)
    at = tmp_path / "bin"
    writers.write_binary_index(ix, str(at))
    assert sorted(f.name for f in at.iterdir()) == ["forward.bin", "index_header.bin", "postings.bin", "vocab.bin"]
    assert (at / "postings.bin").read_bytes() == b"".join(struct.pack("<II", d, tf) for _, d, tf in want)
    vocab, offset = b"", 0
    for term, rows in groupby(want, key=lambda r: r[0]):
        n = len(list(rows))
        vocab += struct.pack("<I", len(term)) + term.encode() + struct.pack("<IQII", n, offset, n, 0)
        offset += 8 * n
    assert (at / "vocab.bin").read_bytes() == vocab
    again = readers.read_binary_index(spark, f"file://{at}")
    assert sorted(tuple(r) for r in again.postings.collect()) == want
    assert sorted(again.docs.collect()) == sorted(ix.docs.collect())


def test_documents_are_counted_without_a_shuffle(spark, monkeypatch):
    rows = [(1, "The the a-b 1.5 x.y K İx"), (2, None), (3, ""), (4, "the running runs run's"), (-5, "the")]
    once, stems = ({("the", 1): 2, ("a-b", 1): 1, ("1.5", 1): 1, ("x", 1): 2, ("y", 1): 1, ("the", 4): 1, ("running", 4): 1, ("runs", 4): 1, ("run's", 4): 1, ("the", -5): 1} for _ in "ab")
    stems[("run", 4)] = stems.pop(("running", 4)) + stems.pop(("runs", 4))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(counting, "POSTINGS", 3)
    for stem, want in ((False, once), (True, stems)):
        post = index.postings(docs, stem=stem)
        assert "Exchange" not in post._jdf.queryExecution().executedPlan().toString()
        assert sorted(tuple(r) for r in post.collect()) == sorted((*k, n) for k, n in want.items())
    again = index.postings(docs.unionAll(docs).unionAll(spark.createDataFrame([(None, "n"), (None, "n")], docs.schema)))
    assert {(r.term, r.doc_id): r.tf for r in again.collect()} == {k: 2 * n for k, n in once.items()} | {("n", None): 2}


def test_stored_blocks_keep_every_posting(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"the w{i % 7} w{i}") for i in range(50)], "doc_id long, text string").repartition(3)
    ix = index.build(docs)
    writers.write_index(ix, str(tmp_path / "ix"))
    stored = readers.read_index(spark, str(tmp_path / "ix"))
    assert stored.blocks.count() < stored.postings.count()
    assert sorted(stored.postings.collect()) == sorted(ix.postings.collect())
    lines = {r.value for r in writers.postings_lines(stored.blocks).collect()}
    assert "\t".join(["the", *(f"{i}:1" for i in range(50))]) in lines


def test_extraction_sorts_no_texts_in_one_task(spark, monkeypatch):
    rows = [(k, f"t{i}", "", f"{'w ' * (3 + i % 5)}{i}", "", "", "", "") for i, k in enumerate([None, *range(40, 0, -1), 7, 7])]
    papers = spark.createDataFrame(rows, "row_id long, title string, abstract string, full_text string, acl_id string, year string, author string, url string").repartition(5)
    # whole rows that are sorted and cut would all meet in one task
    limit = type(papers).limit
    monkeypatch.setattr(type(papers), "limit", lambda df, n: limit(df, n) if n < 2 else pytest.fail("rows are cut in one task"))
    for most in (0, 1, 5, 1000):
        got = corpus.extract(papers, "row_id", 5, most)
        found = sorted((r.doc_id, r.row_id) for r in got.collect())
        keys = sorted((k for k, *_, in ((r[0], r[3]) for r in rows if len(r[3].split()) >= 5)), key=lambda k: (k is not None, k))
        assert found == list(enumerate(keys[:most])), most
