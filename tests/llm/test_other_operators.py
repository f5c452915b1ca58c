"""Operators 1 and 5 to 10, and the pipeline."""

import collections
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexispark.llm import chat, decontamination, packing, quality_classifier, quality_rules, registry, sharding, token_counts
from lexispark.llm.common import text_slices
from lexispark.llm.tokens import BPE, default_path

DATA = "/root/testdata/sf0.001"
ODD = ["", None, "  a  b\n\n c \t", "don't we'll 'tis!'s", "x×y÷ z", "日本 語 ab c", "a\x1cb 12 3a!?! ??a", "  ", "\n", " \n a", "a \nb", "a  ", " ́e", "<|endoftext|> hi", "é è\r\n\r\nx", "  a", "x" * 5000]


#: Two words that sums of powers modulo 2**64 can't tell apart.
PAIR = ["".join(two[i.bit_count() % 2] for i in range(1024)) for two in ("ab", "ba")]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


# ---- 1 -------------------------------------------------------------------------------------------------------------
def test_classifier(spark):
    docs, labels = documents(spark), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = quality_classifier.fit(docs, labels)
    got = quality_classifier.classify(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 50 and np.mean([r.predicted == r.quality for r in got]) > 0.95
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in got)


def test_votes_against_brute_force(spark):
    """Scores from the cosine of every document with every labelled vector, one by one."""
    docs, labels = documents(spark).select("doc_id", "text"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality_classifier.fit(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in quality_classifier.classify(docs, model).collect():
        raw = np.frombuffer(texts[r.doc_id].encode(), np.uint8)
        counts = quality_classifier.term_counts(1, raw, np.array([0, len(raw)]))
        if not counts.any():
            assert r.score == 0
            continue
        x = model.reduce(counts)[0]
        near = sorted(((float(sum(a * b for a, b in zip(x.tolist(), v.tolist()))), int(y)) for v, y in zip(model.vectors, model.labels)), reverse=True)[: model.k]
        votes = [0.0, 0.0]
        for cosine, y in near:
            votes[y] += model.weight[y] * max(cosine, 1e-6) ** model.sharpness
        assert abs(votes[1] / sum(votes) - r.score) < 1e-3 and r.predicted == (r.score >= 0.3)


def test_classifier_odd_cases(spark):
    schema = "doc_id long, text string, score string"
    docs = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, "a", "s"), (4, "b c d" * 30, "s"), (4, "b c d" * 30, "s"), (None, "b c d" * 30, "s")], schema)
    labels = spark.createDataFrame([(4, 1), (4, 1), (1, 0), (9, None), (None, 1), (3, 7)], "doc_id long, quality int")
    none = quality_classifier.fit(docs, labels.limit(0))
    assert none is None and {r.score for r in quality_classifier.classify(docs, none).collect()} == {0.5}
    got = quality_classifier.classify(docs, quality_classifier.fit(docs, labels)).collect()
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.score)
        assert 0 <= r.score <= 1
    assert by[1] == by[2] == {0.0} and by[4] == by[None] and len(got) == 6
    assert quality_classifier.classify(docs.limit(0), none).count() == 0


# ---- tokens, 5, 8 --------------------------------------------------------------------------------------------------
def test_ids_are_the_librarys(library):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab é1 2!$ \n\t  ñß.,") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    model = BPE(default_path())
    assert model.encode(texts) == [library(t) for t in texts]
    assert model.encode(PAIR) == [library(t) for t in PAIR]
    model.KEEP = 10
    assert model.encode(texts[::-1]) == [library(t) for t in texts[::-1]]


@pytest.mark.parametrize("block", [7, 1 << 19])
def test_token_counts(spark, library, block):
    rows = list(enumerate(ODD)) + [(3, ODD[3]), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    blocks, manifest = token_counts.write_files(docs, block=block)
    got = token_counts.count_tokens(blocks).join(manifest, ["file_id", "nth"]).collect()
    assert collections.Counter((r.doc_id, r.n_tokens) for r in got) == collections.Counter((i, len(library(t))) for i, t in rows)
    assert all(r.closed for r in got)
    empty, none = token_counts.write_files(docs.limit(0))
    assert token_counts.count_tokens(empty).count() == 0 and none.count() == 0


def test_plain_files(spark, tmp_path):
    ids = [5, 6, 9, 9, 1, 2, 3, 4, 5, 9, 7]
    (tmp_path / "a.bin").write_bytes(np.array(ids, "<u2").tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    blocks = token_counts.read_files(spark, str(tmp_path), block=2)
    got = sorted((r.nth, r.n_tokens, r.closed) for r in token_counts.count_tokens(blocks, 9).collect())
    assert got == [(0, 2, True), (1, 0, True), (2, 5, True), (3, 1, False)]


@pytest.mark.parametrize("keep_ids", [False, True])
def test_packing(spark, library, keep_ids):
    rng = random.Random(4)
    rows = list(enumerate(ODD)) + [(50 + i, "ab " * rng.randint(0, 400)) for i in range(40)] + [(50, "twice"), (None, "null id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = packing.pack(docs.withColumn("length", F.lit(1)).withColumn("nth", F.lit(1)), length=256, group_docs=20, keep_ids=keep_ids).collect()
    want = collections.Counter()
    for i, t in rows:
        ids = [*library(t), 1]
        for s in range(0, len(ids), 256):
            part = np.array(ids[s : s + 256], "<u4").tobytes()
            want[i, s, len(part) // 4, zlib.crc32(part), len(ids)] += 1
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        assert not keep_ids or zlib.crc32(r.ids) == r.ids_crc32
    for parts in sequences.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 256
    assert packing.pack(docs.limit(0), keep_ids=keep_ids).count() == 0


def test_first_fit():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 100, 500)
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    free, want = [], {}
    for i in np.argsort(-sizes, kind="stable"):
        b = next((j for j, f in enumerate(free) if f >= sizes[i]), len(free))
        if b == len(free):
            free.append(100)
        want[i] = (b, 100 - free[b])
        free[b] -= sizes[i]
    assert all((bins[i], offsets[i]) == want[i] for i in want)


def test_packing_groups_of_long_documents(spark):
    """Full pieces are sequences; a group holds one rest a document at most, however long documents are."""
    docs = spark.createDataFrame([(i, f"word{i} " * (300 + i)) for i in range(200)] + [(7, "x")] * 300, "doc_id long, text string")
    rows = packing.pack(docs, length=16, group_docs=50, keep_ids=True).collect()
    full = [r for r in rows if r.length == 16]
    assert len(full) > 10 * 200 and len({r.sequence_id for r in full}) == len(full) and all(r.offset == 0 for r in full)
    groups = collections.Counter(r.sequence_id >> 32 for r in rows if r.length < 16)
    assert len(groups) == -(-sum(groups.values()) // 50) and max(groups.values()) <= 2 * 50


# ---- 6 -------------------------------------------------------------------------------------------------------------
def brute_stats(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, again = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    marked = {i + j for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), again, len(marked)


def test_statistics():
    rng = random.Random(5)
    texts = ODD + ["\n", "a\n\na\nb\na", "\n\na\n", "a b c a b c a b c", " ".join(x for _ in range(2) for x in PAIR), "\n".join(PAIR)] + ["".join(rng.choice("ab \n\n#é") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    for a, b, data, offsets in text_slices(pa.array(texts), 200):
        got = quality_rules.slice_stats(data, offsets)
        assert [tuple(int(got[c][i]) for c in quality_rules.STATS) for i in range(b - a)] == [brute_stats(t) for t in texts[a:b]]


def test_rules_keep_clean_and_reject_poor(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality_rules.judge(docs).join(labels, "doc_id").where("not base_failed").collect()
    assert np.mean([r.kept for r in got if r.quality == 1]) > 0.99 and np.mean([not r.kept for r in got if r.quality == 0]) > 0.95


def test_rules_odd_cases(spark):
    rows = [(i, "word " * 60 if i % 2 else " ".join(f"w{j}" for j in range(60 + i)), None if i < 3 else "en", "s" if i < 8 else None, "x") for i in range(20)] + [(30, None, "en", "s", "x"), (30, "", None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string")
    got = quality_rules.judge(docs, keep_text=True).collect()
    assert len(got) == 22 and all(r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) for r in got)
    assert all(r.kept is not None for r in got) and not [r for r in got if r.text in (None, "") and r.kept]
    assert quality_rules.judge(docs.limit(0)).count() == 0


def plain_text(rng, n=400):
    return "\n".join(" ".join("".join(rng.choices("abcdefghijklm", k=rng.randint(2, 9))) for _ in range(20)) + "." for _ in range(n // 20))


def test_rules_reject_by_estimated_scatter(spark):
    rng = random.Random(8)
    texts = [plain_text(rng) for _ in range(300)]
    texts[0] = "".join(rng.choice("0123456789") if c.isalpha() and rng.random() < 0.3 else c for c in texts[0])
    texts[1] = re.sub(r"(\w+) (\w+)", r"\1\2", plain_text(rng, 800))
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality_rules.judge(docs).collect()}
    assert not kept[0] and not kept[1] and sum(kept.values()) >= 296


def test_rules_small_source_has_its_estimate(spark):
    rng = random.Random(9)
    long_words = lambda: re.sub(r"(\w+) (\w+)", r"\1\2", plain_text(rng, 800))
    rows = [(i, plain_text(rng), "en", "big") for i in range(600)] + [(1000 + i, long_words(), "en", "small") for i in range(150)]
    kept = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(k for i, k in kept.items() if i >= 1000) >= 147 and sum(k for i, k in kept.items() if i < 1000) >= 590


X_SCHEMA = "k string, x0 double, x1 double, x2 double, x3 double, x4 double"


def brute_mcd(x, tries=60):
    """The least log determinant over many random starts of concentration steps, in memory."""
    rng, h, best = np.random.default_rng(0), len(x) // 2 + 1, None
    for _ in range(tries):
        at = rng.choice(len(x), 6, replace=False)
        for _ in range(30):
            mu, cov = x[at].mean(0), np.cov(x[at].T, bias=True) + 1e-9 * np.eye(5)
            new = np.argsort(np.einsum("ij,jk,ik->i", x - mu, np.linalg.inv(cov), x - mu))[:h]
            if set(new) == set(at):
                break
            at = new
        det = np.linalg.slogdet(cov)[1]
        if best is None or det < best[0]:
            best = det, mu, cov
    return best


def test_mcd_against_brute_force(spark):
    """Correlated groups, with few, many and far outliers: the raw estimate's determinant is as small as any start finds, and the
    reweighted one is the scatter of the good rows."""
    rng, rows, groups = np.random.default_rng(1), [], {}
    mix = rng.normal(0, 1, (5, 5)) + 2 * np.eye(5)
    for name, n, bad, where in (("few", 900, 50, 40), ("many", 700, 300, 12), ("near", 800, 150, 6)):
        good = rng.normal(0, 1, (n, 5)) @ mix + [3, 0, 1, 2, 5]
        groups[name] = (good, np.vstack([good, rng.normal(where, 1, (bad, 5)) @ mix]))
        rows += [(name, *map(float, r)) for r in groups[name][1]]
    df = spark.createDataFrame(rows, X_SCHEMA)
    est = quality_rules._starts(df, ["k"], "t")
    for _ in range(6):
        est = quality_rules._step(df, est, ["k"], ["k", "start"], 0.5, "t")
    dets = collections.defaultdict(list)
    for r in est.collect():
        dets[r.k].append(r.det)
    final = {r.k: r for r in quality_rules.mcd(df, ["k"]).collect()}
    for name, (good, x) in groups.items():
        assert len(dets[name]) == 3 and min(dets[name]) <= brute_mcd(x)[0] + 0.1
        mu, cov = np.array(final[name]["mu"]), np.array(final[name]["cov"]).reshape(5, 5)
        assert final[name]["n"] == len(x)
        away = np.einsum("ij,jk,ik->i", good - mu, np.linalg.inv(cov), good - mu)
        # distances of the good rows are chi-square's
        assert abs(np.median(away) / quality_rules.chi2_quantile(0.5, 5) - 1) < 0.15
        assert np.mean(away > quality_rules.chi2_quantile(0.9999, 5)) < 0.005


def test_chi_square():
    for dims, p, q in ((5, 0.9999, 25.745), (5, 0.975, 12.833), (2, 0.5, 1.386), (1, 0.975, 5.024)):
        assert abs(quality_rules.chi2_quantile(p, dims) - q) < 2e-3


def test_verdict_against_brute_force(spark):
    """Distance, cutoff and verdict of each document, computed again from its group's estimate."""
    rng = random.Random(14)
    rows = [(i, plain_text(rng, 200) + (" #$% 12345" * 30 if i % 9 == 0 else ""), "en", "s") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    stats = quality_rules.statistics(docs).withColumn("base_failed", quality_rules.base_failed())
    x = {r.doc_id: r for r in stats.collect()}
    fit = stats.where("not base_failed").withColumn("g", F.lit(1))
    est = quality_rules.mcd(fit, ["g"]).first()
    mu, cov = np.array(est["mu"]), np.array(est["cov"]).reshape(5, 5)
    # one language and one source: leaning on an equal estimate changes nothing
    for r in quality_rules.judge(docs).collect():
        v, least = (np.array([x[r.doc_id][c] for c in names]) for names in (quality_rules.X, quality_rules.ROUNDING))
        var = cov + np.diag(least**2)
        off = v - mu
        assert abs(off @ np.linalg.solve(var, off) - r.distance) < 1e-6 * max(1, r.distance)
        assert r.kept == (not r.base_failed and r.distance <= quality_rules.CUTOFF)
    one, two = ({r.doc_id: (r.n_words, round(r.distance, 6), r.kept) for r in quality_rules.judge(docs, keep_text=k).collect()} for k in (False, True))
    assert one == two


# ---- 7 -------------------------------------------------------------------------------------------------------------
def edited(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        p = rng.randrange(len(w))
        w[p : p + rng.randint(0, 1)] = [f"zq{rng.randrange(99)}"] * rng.randint(0, 1)
    return w


def values_of(texts):
    """Words of each text, as the operator sees them."""
    out = []
    for _, _, data, offsets in text_slices(pa.array(texts)):
        v, bounds = decontamination.word_values(data, offsets)
        out += [v[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    return out


def test_decontamination(spark):
    """Against the exact edit distance of every item and document, with passages up to all the edits allowed."""
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    items += [(-3, items[0][1].upper()), (-4, "zzshort item"), (-5, "zzword")]
    rng = random.Random(3)
    clean = [r.text for r in documents(spark).collect() if r.text and not any(t in r.text for _, t in items)]
    rows = []
    for n in range(400):
        w = rng.choice(items)[1].split()
        base = rng.choice(clean).split()[:150]
        p = rng.randint(0, len(base))
        rows.append((n, " ".join(base[:p] + edited(rng, w, len(w) // 5 if n % 2 else rng.randint(0, len(w) // 5)) + base[p:])))
    rows += [(1000, None), (1001, ""), (1002, "x" * 100_000), (1003, "a zzshort, ITEM"), (1004, "zzshort"), (1005, "zzword"), (1003, "a zzshort, ITEM"), (None, "zzword!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([*items, (-1, None), (-2, " !? ")], "item_id long, text string")
    got = decontamination.contaminated(docs, bench).collect()
    of_items = values_of([t for _, t in items])
    most = decontamination.edits(np.array([len(w) for w in of_items]), decontamination.SHARE)
    want = {}
    for d, (n, v) in enumerate(zip([i for i, _ in rows], values_of([t for _, t in rows]))):
        for (i, _), w, k in zip(items, of_items, most):
            # fewer words in common than the edits leave rule a match out
            if np.isin(w, v).sum() >= len(w) - k and (c := decontamination.closest(w, v)[0]) <= k:
                want.setdefault((n, i), []).append(c)
    found = collections.defaultdict(list)
    for r in got:
        found[r.doc_id, r.item_id].append(r.distance)
    assert all(k in want and len(want[k]) == len(d) and min(d) >= min(want[k]) for k, d in found.items())
    assert len(found) >= decontamination.RECALL * len(want) and len(want) > 380
    assert found[1003, -4] == [0, 0] and found[1005, -5] == found[None, -5] == [0] and (1004, -4) not in found
    assert sorted(map(str, decontamination.contaminated(docs, bench, block=70).collect())) == sorted(map(str, got))
    left = decontamination.decontaminated(docs.withColumn("item_id", F.lit("clash")).withColumn("_text", F.lit(1)), bench, block=70)
    assert collections.Counter(r.doc_id for r in left.collect()) == collections.Counter(i for i, _ in rows if i not in {d for d, _ in found})
    assert left.columns == ["doc_id", "text", "item_id", "_text"]
    assert decontamination.contaminated(docs, bench.limit(0)).count() == decontamination.contaminated(docs.limit(0), bench).count() == 0


def test_windows_lose_no_item():
    """The test by pairs of words passes every window within the edits, of each size and class of sizes."""
    rng = random.Random(12)
    words = [[f"w{rng.randrange(50)}" for _ in range(n)] for n in [*range(1, 20), 40, 59] * 3]
    items = decontamination.Items(list(range(len(words))), [" ".join(w) for w in words], decontamination.SHARE)
    classes = decontamination.Windows(items.windows.known, decontamination.size_classes(items.n), decontamination.SHARE)
    for w in words:
        k = len(w) // 5
        text = edited(rng, w[:1] + w[1:], k)
        v = values_of([" ".join(["out"] * 3 + text + ["out"] * 3)])[0]
        start = decontamination.closest(values_of([" ".join(w)])[0], v)[1]
        for windows in (items.windows, classes):
            assert any(a <= len(w) <= b and start in at for a, b, at in windows.starts(v, np.array([0, len(v)])))


def test_lookups_of_keys():
    """Keys are looked up in the sorted table only if their first bits are some item's, and none of the table's is lost."""
    rng = random.Random(13)
    items = decontamination.Items(list(range(200)), [" ".join(f"w{rng.randrange(300)}" for _ in range(15 + i % 40)) for i in range(200)], decontamination.SHARE)
    others = np.random.default_rng(5).integers(0, 1 << 64, 100_000, np.uint64)
    keys = np.concatenate([others, items.table[::3], others[:5]])
    at, item = items.lookup(keys)
    want = sorted((n, i) for n, k in enumerate(keys.tolist()) if n >= len(others) for i in items.table_item[items.table == np.uint64(k)].tolist())
    assert sorted(zip(at.tolist(), item.tolist())) == want and len(want) >= len(items.table) // 3
    assert items.flags[items._first_bits(others)].mean() < 0.05


def test_edit_distance():
    rng = random.Random(7)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(1, 8))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert decontamination.closest(np.array(a, np.uint64), np.array(b, np.uint64))[0] == min(row)


# ---- 9 -------------------------------------------------------------------------------------------------------------
def test_sharding(spark, tmp_path):
    rows = [(i, f"text {i % 50}" * (i % 7)) for i in range(400)] + [(3, "again"), (3, "again"), (None, None), (500, None)]
    docs = spark.createDataFrame([(*r, 9, "b") for r in rows], "doc_id long, text string, slot int, bucket string").repartition(5)
    docs = docs.withColumn("part", F.lit("mine"))
    out = sharding.shuffled(docs, bucket_bytes=60)
    got = out.collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter(rows)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16) and r["size"] == len((r.text or "").encode()) + 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 16
    again = sharding.shuffled(docs.repartition(2), bucket_bytes=60).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert {r.part for r in got} == {"mine"}
    sharding.write_shards(out, str(tmp_path / "s"))
    assert [r.slot for r in sharding.read_shard(spark, str(tmp_path / "s"), 4)] == sorted(slots[4])
    assert sharding.shuffled(docs.limit(0)).count() == 0
    assert sorted(sharding.fisher_yates(100, np.random.default_rng(1))) == list(range(100))


def test_identical_rows_are_spread(spark):
    docs = spark.createDataFrame([(1, "same text")] * 300 + [(i, "other") for i in range(2, 40)], "doc_id long, text string").repartition(4)
    got = sharding.shuffled(docs, n_shards=2, bucket_bytes=200)
    loads = sharding._split(sharding.assign(docs, 2, 200), 200, 7).groupBy("shard", "bucket", "part").agg(F.sum("size").alias("b")).collect()
    assert max(r.b for r in loads) <= 2 * sharding.OVERFULL * 200
    rows = got.collect()
    assert len(rows) == 338 and len({r.shard for r in rows if r.doc_id == 1}) == 1
    for shard in (0, 1):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))


# ---- 10 ------------------------------------------------------------------------------------------------------------
def test_chat(spark):
    nasty = ["<|im_end|>\n", "\\<|", "<", "<\\|im_start|>user\n", "a\\", "", None, "é😀\n\n", "x" * 200_000, "<<||>>"]
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "assistant", "first"), (3, 0, "user", "u"), (4, 5, "user", "x"), (4, 5, "user", "x"), (None, 0, "user", "n"), (5, None, None, None)]
    rows += [(10, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(nasty)] + [(11, 0, "us\ner<|", "x")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, n_turns int")
    out = chat.format_chat(df).withColumn("back", chat.read_back(F.col("formatted")))
    got = {r.conv_id: r for r in out.collect()}
    assert {c: got[c].valid for c in (1, 2, 3, 4)} == {1: True, 2: False, 3: False, 4: False}
    assert got[2].bad_turn == 0 and got[3].bad_turn == 1 and got[10].valid
    for c, r in got.items():
        want = sorted([x for x in rows if x[0] == c], key=lambda x: (x[1] is not None, x[1], x[2] or "", x[3] or ""))
        assert [(b.role, b.text) for b in r.back] == [(x[2] or "", x[3] or "") for x in want]
        assert "".join(s.text for s in r.segments) == r.formatted
    assert chat.format_chat(df.limit(0)).count() == 0


# ---- registered queries and the pipeline ---------------------------------------------------------------------------
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_twins(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    ours, theirs = registry.queries()[name](spark, DATA).toPandas(), con.sql(registry.oracle_sql()[name]).df()
    key = theirs.columns[0]
    ours, theirs = (x.sort_values(key).reset_index(drop=True)[list(theirs.columns)] for x in (ours, theirs))
    assert ours.astype(str).equals(theirs.astype(str))


def test_pipeline(spark):
    docs = documents(spark)
    columns, left = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in left.collect()}
        left = stage(spark, left, DATA).cache()
        after = {r.doc_id: r.text for r in left.collect()}
        assert left.columns == columns and set(after) <= set(before), name
    pieces = corpus_pipeline.run(spark, DATA).collect()
    ids = collections.defaultdict(dict)
    for r in pieces:
        ids[r.doc_id][r.start] = np.frombuffer(r.ids, "<u4").tolist()
    model = BPE(default_path())
    whole = {d: sum((parts[s] for s in sorted(parts)), []) for d, parts in ids.items()}
    assert whole == {d: [*e, 1] for d, e in zip(after, model.encode(list(after.values())))}


def test_pipeline_keeps_null_and_repeated_ids(spark):
    rng = random.Random(10)
    a, b, c, d = (plain_text(rng, 100) for _ in range(4))
    rows = [(None, a), (None, a), (None, b), (None, None), (1, c), (1, c), (1, d), (2, c), (3, None), (3, None)]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    got = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, None).collect())
    assert got == collections.Counter({(None, a): 2, (None, b): 1, (None, None): 1, (1, c): 1, (1, d): 1, (3, None): 1})


def test_pipeline_stages_on_odd_tables(spark):
    """Null, empty, short, repeated and tied rows, and columns named like the operators' own, through each stage; expected by brute force."""
    rng = random.Random(21)
    passage = " ".join(f"p{i}" for i in range(60))
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").first().text
    texts = [plain_text(rng, 200) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100, f"{texts[0]} end"), (101, f"{texts[1]} {passage}"), (102, f"{passage} {texts[2]}"), (103, passage), (104, f"{item} {' '.join(texts[3].split()[:60])}")]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "word " * 80), (None, texts[4]), (None, texts[4]), (None, None), (5, texts[5]), (5, texts[6]), (205, "#$% " * 400 + texts[7])]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, N_Words string, e string, level string, distance string, _id string, _spans string, _text string, row string, `a.b` string"
    clash = ["k", "w", "e", "l", "d", "i", "s", "t", "r", "ab"]
    docs = spark.createDataFrame([(i, t, "en" if i != 7 else None, "s", len(t or ""), *clash) for i, t in rows], schema)
    stages = dict(corpus_pipeline.STAGES)
    got = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
        kept = out.collect()
        assert all(list(r)[5:] == clash and r.n_chars == len(r.text or "") for r in kept), name
        got[name] = collections.Counter((r.doc_id, r.text) for r in kept)
        assert stage(spark, docs.limit(0), DATA).count() == 0, name
    # quality: nulls, empty texts, short ones and repetitions fail, and so does the text full of symbols
    judged = collections.Counter((i, t) for i, t in rows if brute_stats(t)[0] >= 50 and 2 * brute_stats(t)[4] <= brute_stats(t)[0])
    assert got["quality_rules"] <= judged and (205, rows[-1][1]) not in got["quality_rules"] and sum(got["quality_rules"].values()) >= sum(judged.values()) - 5
    # near duplicates: 0 and 100, 5 and 6, 7 and 205 are one; equal rows of one doc_id stay once, null ids as they are
    near = collections.Counter(r for r in rows if r[0] not in (6, 100, 205))
    near[5, texts[5]] = 1
    assert got["near_dup"] == near
    # substrings: each window stays with its least doc_id
    least = {}
    for i, t in rows:
        w = (t or "").split()
        for p in range(len(w) - 49):
            if i is not None:
                least[tuple(w[p : p + 50])] = min(least.get(tuple(w[p : p + 50]), i), i)
    want = []
    for i, t in rows:
        w = (t or "").split()
        gone = {p + j for p in range(len(w) - 49) if i is not None and least[tuple(w[p : p + 50])] < i for j in range(50)}
        if not gone or len(gone) < len(w):
            want.append((i, " ".join(x for p, x in enumerate(w) if p not in gone) if gone else t))
    assert got["substring_dedup"] == collections.Counter(want) and (103, passage) not in got["substring_dedup"]
    assert got["decontamination"] == collections.Counter(r for r in rows if r[0] != 104)
    pieces = stages["packing"](spark, docs, DATA).collect()
    model = BPE(default_path())
    assert sum(r.length for r in pieces) == sum(len(x) + 1 for x in model.encode([t for _, t in rows]))
    assert stages["packing"](spark, docs.limit(0), DATA).count() == 0
