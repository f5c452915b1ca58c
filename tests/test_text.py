import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexispark.functions import text as T
from lexispark.functions.stemmer import stem, stem_terms
from lexispark.operators import corpus, index
from lexispark.operators.search import query_tokens

TOKENS = [
    ("c++ C++11", ["c", "c", "11"]),
    ("state-of-the-art don't", ["state-of-the-art", "don't"]),
    ("3.14 1.2.3. a.b", ["3.14", "1.2.3", "a", "b"]),
    ("x- 'q' gpt-4.0", ["x", "q", "gpt-4.0"]),
    ("a--b", ["a", "b"]),
    ("café naïve", ["caf", "na", "ve"]),
    ("K", []),
    ("", []),
    ("?! --", []),
    (None, []),
]


def automaton(text):
    """A plain left-to-right model of the tokenizer."""
    ok = lambda c: c.isascii() and c.isalnum()
    out, now = [], ""
    for i, c in enumerate(text):
        after = text[i + 1] if i + 1 < len(text) else " "
        joins = now and ((c in "-'" and ok(after)) or (c == "." and now[-1].isdigit() and after.isascii() and after.isdigit()))
        if ok(c) or joins:
            now += c
        elif now:
            out.append(now.rstrip("-'.+").lower())
            now = ""
    return out + ([now.rstrip("-'.+").lower()] if now else [])


def test_tokens(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TOKENS)], "i int, t string")
    got = {r.i: r.k for r in df.select("i", T.tokenize(F.col("t")).alias("k")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(TOKENS)}


def test_long_token(spark):
    df = spark.range(1).select(F.repeat(F.lit("a-"), 200_000).alias("t"))
    assert df.select(F.size(T.tokenize(F.col("t")))).first()[0] == 1


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1.-'+ é", max_size=30))
def test_pattern_is_the_automaton(text):
    assert query_tokens(text) == automaton(text)


@pytest.mark.parametrize(("text", "want"), [("Title: Foo bar\n\nAbstract: x", "Foo bar"), ("Title: \n\nAbstract: x", "Abstract: x"), ("intro Title:Y", "Y"), ("none", ""), (None, "")])
def test_title(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(T.extract_title(F.col("t"))).first()[0] == want


def test_clean(spark):
    rows = [("  a\r\nb\t c\x1d d ", "a b c d", 4), ("", "", 0), (None, "", 0), ("   ", "", 0)]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, t string").withColumn("c", T.clean_text(F.col("t")))
    assert [(r.c, r.n) for r in df.select("i", "c", T.word_count(F.col("c")).alias("n")).orderBy("i").collect()] == [r[1:] for r in rows]


def test_not_a_number(spark):
    df = spark.createDataFrame([(float("nan"), "NaN"), (1.5, " x ")], "d double, t string")
    assert [tuple(r) for r in df.select(T.clean_text(F.col("d")), T.clean_text(F.col("t"))).collect()] == [("", "NaN"), ("1.5", "x")]


def test_raw_size(spark, tmp_path):
    spark.range(100).repartition(3).write.parquet(str(tmp_path / "t"))
    size = sum(f.stat().st_size for f in (tmp_path / "t").glob("part-*"))
    assert corpus.raw_size(spark, str(tmp_path / "t")) == size
    assert corpus.corpus_stats(spark.createDataFrame([(1, "a")], "doc_id long, text string"), size).first().raw_bytes == size


def test_file_name(spark):
    df = spark.createDataFrame([(7,), (1234567,)], "i long")
    assert [r[0] for r in df.orderBy("i").select(T.file_name(F.col("i"))).collect()] == ["doc_000007.txt", "doc_1234567.txt"]


# Published vectors.
PORTER = """caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing
conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file
happy happi sky sky relational relat conditional condit rational ration digitizer digit operator oper feudalism feudal decisiveness
decis hopefulness hope triplicate triplic formalize formal electrical electr goodness good revival reviv adjustable adjust replacement
replac adoption adopt probate probat rate rate cease ceas roll roll generalizations gener oscillators oscil translation translat
recognition recognit learning learn by by is is gpt-4 gpt-4 don't don't b2b b2b""".split()


def test_porter(spark):
    pairs = dict(zip(PORTER[::2], PORTER[1::2]))
    assert {w: stem(w) for w in pairs} == pairs
    df = spark.createDataFrame([(w, w) for w in pairs], "term string, word string")
    assert {r.word: r.term for r in stem_terms(df).collect()} == pairs


def test_dense_ids(spark):
    df = spark.createDataFrame([(f"k{i % 977:04d}-{i:05d}",) for i in range(3000)], "k string")
    got = corpus.with_dense_id(df, "k").orderBy("k").collect()
    assert [r.doc_id for r in got] == list(range(3000))
    ties = spark.createDataFrame([("a", i) for i in range(50)], "k string, v int")
    one, two = ({(r.doc_id, r.v) for r in corpus.with_dense_id(t, "k").collect()} for t in (ties, ties.repartition(7)))
    assert one == two and len(one) == 50


def test_extract(spark):
    rows = [(i, f"t{i}", "a", "w " * n, f"A{i}", "2020", "x", "u") for i, n in enumerate([5, 0, 2, 7, 9])]
    papers = spark.createDataFrame(rows, "row_id int, title string, abstract string, full_text string, acl_id string, year string, author string, url string")
    assert corpus.filter_report(papers, "row_id", 4).first().asDict() == {"saved": 3, "skipped_empty": 1, "skipped_short": 1}
    assert corpus.filter_report(papers, "row_id", 4, 1).first().asDict() == {"saved": 1, "skipped_empty": 0, "skipped_short": 0}
    assert corpus.filter_report(papers, "row_id", 4, 2).first().asDict() == {"saved": 2, "skipped_empty": 1, "skipped_short": 1}
    got = corpus.extract(papers, "row_id", 4, 2).orderBy("doc_id").collect()
    assert [(r.doc_id, r.acl_id, r.file, r.word_count) for r in got] == [(0, "A0", "doc_000000.txt", 5), (1, "A3", "doc_000001.txt", 7)]
    assert got[0].text_length == len(got[0].doc_text)
    assert got[0].doc_text == "Title: t0\n\nAbstract: a\n\nFull text:\nw w w w w\n"


def test_empty_corpus(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert corpus.corpus_stats(none, 0).first().avg_words == 0
    assert corpus.token_stats(none).first().tokens == 0
    assert index.header_stats(index.build(none)).first().terms == 0
