import math
import random

import pytest
from pyspark.sql import functions as F

from lexispark.operators import boolean, index, search, zipf
from lexispark.sources import readers, writers

CORPUS = [(0, "a b"), (1, "a c"), (2, "b c"), (3, "d")]

SYMBOLS = {
    "a b": [0], "a && b": [0], "a || b": [0, 1, 2], "!a": [2, 3], "(a || b) !c": [0], "!(a || b)": [3], "!a !b": [3], "a||b&&c": [0, 1, 2],
    "a AND b": [], "!!a": [], "a ||": [], "a !": [], "!": [], "(a": [], "a)": [0, 1], "a () b": [], "()": [], "a & b": [0], "a|b": [0], "a,b": [0],
    "zzz": [], "a zzz": [], "a-b": [], "!zzz": [0, 1, 2, 3], "": [],
}
KEYWORDS = {
    "a and b": [0], "A AND NOT B": [1], "a or b and c": [0, 1, 2], "(a or b) and c": [1, 2], "not a": [2, 3], "a b": [0, 2], "b a": [0, 1],
    "not not a": [], "a or": [], "(a": [], "()": [], "zzz": [], "a)": [0, 1], "a && b": [0, 2], "a !b": [0, 2], "a and b,c": [2], "c and a,b": [0], "not zzz": [0, 1, 2, 3],
}


@pytest.fixture(scope="module")
def small(spark):
    return index.build(spark.createDataFrame(CORPUS, "doc_id long, text string").cache())


def sets(query, dialect):
    """The same program on plain sets."""
    docs = {i: set(t.split()) for i, t in CORPUS}
    program = boolean.postfix(boolean.DIALECTS[dialect](query))
    return sorted(boolean.evaluate(program, lambda t: {i for i, w in docs.items() if t in w}, set(), lambda a, b: a & b, lambda a, b: a | b, lambda a: set(docs) - a))


@pytest.mark.parametrize(("dialect", "vectors"), [("symbol", SYMBOLS), ("keyword", KEYWORDS)])
def test_boolean_vectors(small, dialect, vectors):
    for query, want in vectors.items():
        assert sets(query, dialect) == want, query
    for query in random.Random(1).sample(list(vectors), 9):
        assert sorted(r.doc_id for r in boolean.matches(small, query, dialect).collect()) == vectors[query], query


def test_de_morgan(small):
    one = boolean.matches(small, "!(a || b)").collect()
    two = boolean.matches(small, "!a && !b").collect()
    assert sorted(one) == sorted(two)


def test_page(spark):
    many = index.build(spark.range(120).select(F.col("id").alias("doc_id"), F.lit("w").alias("text")))
    rows, total, more = boolean.search_page(many, "w", "2")
    assert sorted(r.doc_id for r in rows.collect()) == list(range(50, 100)) and total == 120 and more
    assert [boolean.page_number(p) for p in ("x", None, "-3", "0", 4)] == [1, 1, 1, 1, 4]
    assert not boolean.search_page(many, "w", 3)[2]


@pytest.mark.parametrize(("query", "want"), [("a", [(0, 1), (1, 1)]), ("a b", [(0, 2), (1, 1), (2, 1)]), ("a a b", [(0, 3), (1, 2), (2, 1)]), ("zzz", [])])
def test_ranked(small, query, want):
    got = search.ranked(small, query).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in got] == want
    assert [r.rank for r in got] == list(range(1, len(want) + 1))


def test_batch_is_one_by_one(small):
    got = search.ranked_batch(small, {"x": "a b", "y": "zzz", "z": "c"}).collect()
    assert sorted((r.doc_id, r.score) for r in got if r.query_id == "x") == [(0, 2), (1, 1), (2, 1)]
    assert not [r for r in got if r.query_id == "y"]


def test_stemmed(spark):
    docs = spark.createDataFrame([(0, "learning learned"), (1, "learn x")], "doc_id long, text string")
    both = search.ranked(index.build(docs, stem=True), "learns", stem_query=True).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in both] == [(0, 2), (1, 1)]
    assert [r.doc_id for r in search.ranked(index.build(docs), "learning", stem_query=True).collect()] == [1]


def test_index_invariants(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(rng.choices(["x", "y", "z", "b-1", "q"], k=rng.randint(0, 30)))) for i in range(50)], "doc_id long, text string")
    ix = index.build(docs)
    assert ix.postings.agg(F.sum("tf")).first()[0] == ix.docs.agg(F.sum("token_count")).first()[0]
    vocab = ix.vocabulary.orderBy("term").collect()
    offset = 0
    for r in vocab:
        assert r.postings_offset == offset and r.df == r.postings_count
        offset += 8 * r.df


def test_persisted(spark, small, tmp_path):
    writers.write_index(small, str(tmp_path / "ix"))
    again = readers.read_index(spark, str(tmp_path / "ix"))
    assert [r.doc_id for r in search.ranked(again, "a b").orderBy("rank").collect()] == [0, 1, 2]
    assert sorted(again.vocabulary.collect()) == sorted(small.vocabulary.collect())
    plan = search.ranked(again, "a b")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [In(term, [a,b])]" in plan
    writers.write_binary_index(small, str(tmp_path / "bin"))
    binary = readers.read_binary_index(spark, str(tmp_path / "bin"))
    assert sorted(binary.postings.collect()) == sorted(small.postings.collect())
    writers.write_text_index(small, str(tmp_path / "txt"))
    assert sorted(readers.read_postings_tsv(spark, str(tmp_path / "txt/postings")).collect()) == sorted(small.postings.collect())
    assert readers.read_docs_tsv(spark, str(tmp_path / "txt/docs")).count() == 4


def test_postings_file_oddities(spark, tmp_path):
    (tmp_path / "p.txt").write_text("a\t1:2\tbad\t2:1\nb\t1:1\na\t9:9\n")
    got = sorted(tuple(r) for r in readers.read_postings_tsv(spark, str(tmp_path / "p.txt")).collect())
    assert got == [("a", 9, 9), ("b", 1, 1)]


def test_text_folder(spark, tmp_path):
    for name, text in (("b.txt", "two"), ("a.txt", "one\nline"), ("c.md", "no")):
        (tmp_path / name).write_text(text)
    assert [(r.doc_id, r.text) for r in readers.read_text_folder(spark, str(tmp_path)).orderBy("doc_id").collect()] == [(0, "one\nline"), (1, "two")]


def test_corpus_folder(spark, tmp_path):
    rows = [(i, f"doc_{i:06d}.txt", f"Title: t{i}\n\nx\n\n{'y' * i}\n") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, file string, doc_text string")
    for part in (df, df.limit(3)):  # a folder is emptied first
        writers.write_corpus(part, str(tmp_path / "c"))
        n = part.count()
        assert sorted(f.name for f in (tmp_path / "c").glob("*.txt")) == [r[1] for r in rows[:n]]
        assert {(r.doc_id, r.text) for r in readers.read_text_folder(spark, str(tmp_path / "c")).collect()} == {(r[0], r[2]) for r in rows[:n]}


def test_ranks_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(zipf, "CHUNK", 7)
    totals = spark.range(100).selectExpr("cast(id as string) as term", "if(id < 5, 3L, 1L) as freq")
    assert [tuple(r) for r in zipf.ranks(totals).orderBy("rank").collect()] == [(i + 1, 3 if i < 5 else 1) for i in range(100)]


def test_zipf(spark):
    post = spark.createDataFrame([("a", 10), ("b", 5), ("c", 5), ("d", 1)], "term string, freq long")
    rows = zipf.table(post).orderBy("rank").collect()
    assert [(r.rank, r.real_freq) for r in rows] == [(1, 10), (2, 5), (3, 5), (4, 1)]
    x, y = [math.log(i) for i in (1, 2, 3, 4)], [math.log(f) for f in (10, 5, 5, 1)]
    mx, my = sum(x) / 4, sum(y) / 4
    s = -sum((a - mx) * (b - my) for a, b in zip(x, y)) / sum((a - mx) ** 2 for a in x)
    got = zipf.fit(post).first()
    assert math.isclose(got.s, s) and got.c == 10 and math.isclose(rows[1].zipf_ideal, 5)
    assert math.isnan(zipf.fit(post.where("term = 'a'")).first().s)
    assert zipf.fit(post.where("term = 'none'")).count() == 0
    assert "logscale" in writers.plot_script("x.csv")
