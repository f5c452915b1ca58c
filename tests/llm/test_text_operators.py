"""Operators 2 to 4 against brute force, and their odd cases."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexispark.llm import common, near_dup, repeats, substring_dedup, suffix_array_dedup

ODD = [(40, None), (41, ""), (42, "a" * 300), (43, "ab " * 50), (44, " \n\t "), (45, "é" * 30 + " " + "é" * 30)]


def corpus(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab c\n") for _ in range(60)) for _ in range(6)]
    return [(i, "".join(rng.choice(base)[rng.randint(0, 30) :] for _ in range(rng.randint(0, 4)))) for i in range(40)] + ODD


def frame(spark, docs):
    """With columns that clash with the operators' own."""
    rows = [(i, t, "x", 1, 2) for i, t in docs]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, copies int, n_words int").repartition(3)


def brute_bytes(docs, length):
    seen = {}
    for _, t in docs:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]] = seen.get(b[p : p + length], 0) + 1
    out = {}
    for i, t in docs:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        runs = sum(x and not y for x, y in zip(gone, [False, *gone]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, y in zip(b, gone) if not y)).hexdigest())
    return out


def brute_words(docs, length):
    least = {}
    for i, t in docs:
        w = (t or "").encode().split()
        for p in range(len(w) - length + 1):
            key = tuple(w[p : p + length])
            least[key] = min(least.get(key, i), i)
    out = {}
    for i, t in docs:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - length + 1):
            if least[tuple(w[p : p + length])] < i:
                gone[p : p + length] = [True] * length
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, y in zip(w, gone) if not y)).hexdigest())
    return out


@pytest.mark.parametrize(("seed", "hot"), [(5, 2048), (6, 3)])
def test_substrings(spark, seed, hot):
    docs = corpus(seed)
    got = substring_dedup.dedup(frame(spark, docs), 6, 2, hot, True).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_words(docs, 6)


@pytest.mark.parametrize(("seed", "hot"), [(5, 2048), (6, 3)])
def test_bytes(spark, seed, hot):
    docs = corpus(seed)
    got = suffix_array_dedup.dedup(frame(spark, docs), 20, 6, hot, True).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_bytes(docs, 20)


@pytest.mark.parametrize("hot", [3, 2048])
def test_said_over_and_over(spark, hot):
    """Texts of little but one line or pair of words, which share most of their surroundings with themselves."""
    docs = [(i, f"{'ab cd ' * (9 + i)}x{i} {'one line\nagain\n' * (i % 3)}{'cd ab ' * (5 * (i % 2))}") for i in range(12)]
    got = substring_dedup.dedup(frame(spark, docs), 6, 2, hot, True).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_words(docs, 6)
    got = suffix_array_dedup.dedup(frame(spark, docs), 20, 6, hot, True).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_bytes(docs, 20)
    around = repeats.surroundings(_marked(spark, docs), repeats.Unit(True, 6, 2, (6,))).collect()
    assert len(around) < sum(len(r.places) for r in around) / 2


def rows_made(spark, since):
    """The rows that each step in Python has made in the executions from `since` on."""
    store, out = spark._jsparkSession.sharedState().statusStore(), []
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    of = store.executionsList()
    for e in (of.apply(i) for i in range(since, of.size())):
        values, nodes = store.executionMetrics(e.executionId()), store.planGraph(e.executionId()).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for m in (node.metrics().apply(i) for i in range(node.metrics().size())) if "InArrow" in node.name() else ():
                if m.name() == "number of output rows" and (value := values.get(m.accumulatorId())).isDefined():
                    out.append(int(value.get().replace(",", "")))
    return out


def test_bytes_of_crowded_anchors(spark):
    """A passage in many different surroundings is judged whole, and without a row for each of its windows."""
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passages = [letters(450), letters(300)]
    docs = [(i, f"{letters(500)}{passages[i % 2]}{letters(500)}") for i in range(240)] + [(999, f"{letters(100)}{passages[1]}{docs_end}") for docs_end in [letters(120)] for _ in range(2)]
    docs = [(n, t) for n, (_, t) in enumerate(docs)]
    since = spark._jsparkSession.sharedState().statusStore().executionsList().size()
    got = suffix_array_dedup.dedup(frame(spark, docs), hot=60, digests=True).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_bytes(docs, 400)
    assert sum(r.n_removed > 0 for r in got) >= 120
    made = rows_made(spark, since)
    assert len(made) > 5 and max(made) < 40 * len(docs)


def _marked(spark, docs):
    unit, rows = repeats.Unit(True, 6, 2, (6,)), []
    for i, t in docs:
        data = np.frombuffer(t.encode(), np.uint8)
        values, bounds, _ = unit.values(data, np.array([0, len(data)]))
        keys = np.unique(common.signed(unit.runs(values, bounds)[0])).tolist()
        rows.append((bytes([i]), i, t, keys, [True] * len(keys)))
    return spark.createDataFrame(rows, "id binary, doc_id long, text string, keys array<long>, hots array<boolean>")


@pytest.mark.parametrize("hot", [3, 2048])
def test_unnumbered_rows(spark, hot):
    """A null doc_id has none smaller and is never the smaller one, also where its text is that of many others."""
    shared = " ".join(f"s{i}" for i in range(20))
    docs = [(i, f"a{i} {shared} b{i}") for i in range(8)] + [(None, f"{shared} c")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substring_dedup.dedup(df, 6, 2, hot).collect()}
    assert got == {0: 0, None: 0} | dict.fromkeys(range(1, 8), 20)


def test_doc_ids_of_other_kinds(spark):
    """Beyond what a double holds, and texts."""
    shared = " ".join(f"s{i}" for i in range(20))
    for ids, kind in (((1 << 53, (1 << 53) + 1, None), "long"), (("a", "b", None), "string")):
        df = spark.createDataFrame([(i, f"{n} {shared}") for n, i in enumerate(ids)], f"doc_id {kind}, text string")
        assert {r.doc_id: r.n_removed for r in substring_dedup.dedup(df, 6, 2).collect()} == dict(zip(ids, (0, 20, 0)))


def thue_morse(n):
    """Two words of 2**n letters that sums of powers modulo 2**64 can't tell apart, whatever the base."""
    bits = [i.bit_count() % 2 for i in range(1 << n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_structured_words_differ(spark):
    x, y = thue_morse(10)
    data = np.frombuffer((x + y).encode(), np.uint8)
    assert len(set(common.span_hash(data, np.array([0, 1024, 0]), np.array([1024, 2048, 1023])).tolist())) == 3
    values = np.array([7, 9], np.uint64)[data % 2]
    assert common.fold(values, np.array([0, 1024]), 1024).tolist() != common.fold(values, np.array([0]), 1024).tolist() * 2
    tail = " ".join(f"t{i}" for i in range(9))
    df = spark.createDataFrame([(1, f"{x} {tail}"), (2, f"{y} {tail}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.dedup(df, 6, 2).collect()} == {1: 0, 2: 9}
    assert {r.component_id for r in near_dup.near_duplicates(df.withColumn("text", F.substring("text", 1, 1024)), 1).collect()} == {1, 2}


def test_texts_stay_or_shrink(spark):
    shared = " ".join(f"s{i}" for i in range(60))
    docs = [(1, f"one  {shared}\nmore"), (2, f"two {shared} else"), (3, "left \n as it is"), (4, "left \n as it is")]
    got = {r.doc_id: r for r in substring_dedup.dedup(frame(spark, docs)).collect()}
    assert got[1].text == docs[0][1] and got[2].text == "two else" and got[3].text == got[4].text == docs[2][1]
    assert got[1].id == "x" and got[2].n_removed == 60


def test_empty_tables(spark):
    none = frame(spark, [])
    assert substring_dedup.dedup(none).count() == suffix_array_dedup.dedup(none).count() == near_dup.near_duplicates(none).count() == 0


def test_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(70))
    docs = [(1, text), (1, text), (2, text), (2, None), (None, text), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup.dedup(df).collect())
    assert got == [(0, 0, 0), (0, 70, 0), (1, 70, 0), (1, 70, 0), (2, 0, 0), (2, 70, 70)]
    assert sorted(r.n_removed for r in suffix_array_dedup.dedup(df, 40, 8).collect()) == [0, 0] + [len(text)] * 4
    near = [(r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(df).collect()]
    assert sorted(near, key=str) == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (2, 2, True), (None, None, True), (None, None, True)], key=str)


def test_very_long_text(spark):
    rng = random.Random(1)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(150_000))
    docs = [(1, long), (2, "x " + long[200_000:400_000] + " y")]
    got = {r.doc_id: r.n_removed for r in substring_dedup.dedup(frame(spark, docs)).collect()}
    assert got[1] == 0 and got[2] > 20_000
    assert {r.doc_id: r.n_removed > 190_000 for r in suffix_array_dedup.dedup(frame(spark, docs)).collect()} == {1: True, 2: True}


def brute_near(docs, k, num, den):
    sets = {}
    for i, t in docs:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
        sets[i] = {tuple(w[p : p + k]) for p in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def families(seed):
    """Originals, copies with more and more edits (also of copies), and short texts."""
    rng = random.Random(seed)
    word = lambda: f"{rng.choice('abcdefgh')}{rng.randrange(300)}"
    docs = []
    for _ in range(5):
        family = [[word() for _ in range(rng.randint(40, 120))]]
        for _ in range(rng.randint(3, 14)):
            w = list(rng.choice(family[:3]))
            for _ in range(rng.randint(0, 9)):
                w[rng.randrange(len(w))] = rng.choice(["ein", "zwei", word()])
            family.append(w)
        docs += [" ".join(w) for w in family]
    docs += ["a", "A", "a b", "A B", "a b c", "", None, "  "]
    rng.shuffle(docs)
    return [(i, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize(("seed", "k", "num"), [(1, 3, 85), (2, 5, 80)])
def test_near(spark, seed, k, num):
    docs = families(seed)
    got = near_dup.near_duplicates(frame(spark, docs), k, num, 100).collect()
    want = brute_near(docs, k, num, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want
    assert sum(not kept for _, _, kept in want.values()) > 5


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)]
    edges = [(a, b) for a, b in edges if a != b]
    got = {r.node: r.component for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_bands():
    assert 1 - (1 - 0.85**6) ** near_dup.bands_for(0.85, 6, 1e-6) >= 1 - 1e-6


def test_minimizers_agree_and_cover():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 4, 400).astype(np.uint8)
    data[200:300] = data[50:150]
    keys = common.byte_gram_hash(data, 5)
    at, first, n = common.minimizers(keys, np.array([0, 180, 400]), 20, 5)
    windows = {int(w): int(a) for a, f, m in zip(at, first, n) for w in range(f, f + m)}
    assert sorted(windows) == [*range(0, 161), *range(180, 381)]
    for w in range(50, 131):
        assert windows[w] - w == windows[w + 150] - (w + 150)
    parts = common._minimizers_long(keys, np.array([0, 180, 400]), 20, 5)
    assert {int(w): int(a) for a, f, m in zip(*parts) for w in range(f, f + m)} == windows


def test_words():
    texts = ["a  b\n", "", "c", " d", "e f", None, "\x0bg\x1ch "]
    found = []
    for a, b, data, offsets in common.text_slices(pa.array(texts), 4):
        w = common.Words(data, offsets)
        found += [x.decode() for x in w.joined(np.ones(len(w.starts), bool))]
        assert (w.counts() == [len((t or "").encode().split()) if t is None or "\x1c" not in t else 1 for t in texts[a:b]]).all()
    assert found[:6] == ["a b", "", "c", "d", "e f", ""]
