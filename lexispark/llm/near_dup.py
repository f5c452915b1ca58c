"""4. MinHash near-dedup: min-max hashing, banding, exact verification and connected components.

A document's set is its distinct shingles of k words. Under each permutation both the least and the greatest value are
kept, so a signature of 2n values takes n hash evaluations a shingle, and each kind is an unbiased estimate. Bands of
`rows` values (half minima, half maxima) make candidates; the number of bands follows from the threshold and `miss`, the
largest chance that a pair at the threshold shares no band. Every link is confirmed on the full sets.

Groups of copies never make all their pairs. Equal sets are one class, made by an aggregation. Within a band's bucket
all classes are first compared with its least one. In buckets that still hold several components, all are compared with
the class of the most usual shingles, the bucket's pivot (the original, in a group of edited copies). What classes differ
in from their pivot then tells, exactly, which other pairs of different components can be linked at all (`_leading`). Of those
with a difference in common, all are first compared with the least, so that a second family in a bucket becomes one component;
what is still in different components is compared one by one, so no link that could join two components is left out.

Defined results: null, empty and wordless texts have no shingles and are linked with nothing; with fewer than k words the
whole sequence is the one shingle; repeated rows of a doc_id are one node and each get a row; a null doc_id is linked
with nothing and is its own (null) component, kept; an empty table gives an empty table; other columns are ignored by
`near_duplicates`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexispark.llm.common import LOWER, Words, binary_array, fold, gram_hash, mix, signed, text_slices, tidy
from lexispark.session import ready
from lexispark.storage import release, staged

_U = np.uint64


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all documents one after another, bounds of each document's)."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, _U), np.zeros(n + 1, np.int64)
    w = Words(LOWER[data], offsets)
    count = w.counts()
    words = w.hashes()
    per = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    doc = np.repeat(np.arange(n), per)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per) + w.bounds[:-1][doc]
    x, grams, short = np.zeros(len(doc), _U), gram_hash(words, k), count[doc] < k
    x[~short] = grams[start[~short]]
    for size in range(1, k):
        these = short & (count[doc] == size)
        x[these] = fold(words, start[these], size)
    order = np.lexsort((x, doc))
    x, doc = x[order], doc[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])
    return x[new], np.searchsorted(doc[new], np.arange(n + 1))


def bands_for(threshold: float, rows: int, miss: float) -> int:
    return math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))


def signatures(docs: DataFrame, k: int, bands: int, rows: int, seed: int = 5) -> DataFrame:
    """doc_id, n_shingles, set_lo, set_hi (a 128-bit name of the set) and bands (their hashes)."""
    ready(docs.sparkSession)
    half = rows // 2
    rng = np.random.default_rng(seed)
    a, b = (rng.integers(0, 1 << 64, bands * half, dtype=_U) for _ in range(2))
    a |= _U(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, q, data, offsets in text_slices(batch.column("text")):
                x, bounds = shingle_sets(data, offsets, k)
                n, size = q - p, np.diff(bounds)
                full = np.flatnonzero(size)
                first = bounds[:-1][full]
                names = np.zeros((2, n), _U)
                out = np.zeros((n, bands), _U)
                if len(full):
                    names[0][full], names[1][full] = np.add.reduceat(mix(x), first), np.add.reduceat(mix(x ^ _U(0xA5A5A5A5A5A5A5A5)), first)
                    for band in range(bands):
                        h = np.full(len(full), band + 1, _U)
                        for i in range(band * half, (band + 1) * half):
                            y = x * a[i] + b[i]
                            h = mix(h ^ np.minimum.reduceat(y, first)) + _U(0x9E3779B97F4A7C15)
                            h = mix(h ^ np.maximum.reduceat(y, first)) + _U(0x9E3779B97F4A7C15)
                        out[full, band] = h
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(size > 0, bands, 0))]), pa.int32()), pa.array(signed(out[full].ravel())))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(p, n), pa.array(size), pa.array(signed(names[0])), pa.array(signed(names[1])), lists], ["doc_id", "n_shingles", "set_lo", "set_hi", "bands"])

    return docs.select("doc_id", "text").mapInArrow(tidy(sign), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, set_lo long, set_hi long, bands array<long>")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, q, data, offsets in text_slices(batch.column("text")):
                x, bounds = shingle_sets(data, offsets, k)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(p, q - p), binary_array(x.view(np.uint8), 8 * np.diff(bounds))], ["doc_id", "s"])

    return docs.mapInArrow(tidy(make), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, s binary")


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, offs, data = column.buffers()
    bounds = np.frombuffer(offs, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw.tobytes() and np.frombuffer(raw.tobytes(), _U), (bounds - bounds[0]) // 8


def compared(pairs: DataFrame, sets: DataFrame, differences: bool = False) -> DataFrame:
    """`pairs` (a, b) with the sizes of their full sets, na and nb, and of the intersection, common; if asked for, also
    `diff`: the shingles that only one of them has, those of a inverted."""
    kind = pairs.schema["a"].dataType.simpleString()
    names = ["a", "b", "na", "nb", "common"] + ["diff"] * differences

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = 512
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                (x, bx), (y, by) = _values(part.column("sa")), _values(part.column("sb"))
                n = part.num_rows
                both = np.concatenate([x, y])
                pair = np.concatenate([np.repeat(np.arange(n), np.diff(bx)), np.repeat(np.arange(n), np.diff(by))])
                order = np.lexsort((both, pair))
                both, pair = both[order], pair[order]
                same = (both[1:] == both[:-1]) & (pair[1:] == pair[:-1])
                common = np.bincount(pair[1:][same], minlength=n)
                cols = [part.column("a"), part.column("b"), pa.array(np.diff(bx)), pa.array(np.diff(by)), pa.array(common, pa.int64())]
                if differences:
                    alone = np.ones(len(both), bool)
                    alone[1:] &= ~same
                    alone[:-1] &= ~same
                    value = np.where(order[alone] < len(x), ~both[alone], both[alone])
                    bounds = np.concatenate([[0], np.cumsum(np.bincount(pair[alone], minlength=n))])
                    cols.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(signed(value))))
                yield pa.RecordBatch.from_arrays(cols, names)

    with_a = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a")
    with_b = with_a.join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
    return with_b.select("a", "b", "sa", "sb").mapInArrow(tidy(check), f"a {kind}, b {kind}, na long, nb long, common long" + ", diff array<long>" * differences)


def _links(pairs: DataFrame, num: int, den: int) -> DataFrame:
    return pairs.where(den * F.col("common") >= num * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every end of an edge: the least node that it reaches. Labels move along edges and then
    jump to their label's label, so a chain halves with each round."""
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    last = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), name)
    while True:
        labels = last.select("node", "component")
        # least label of the neighbours
        seen = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        moved = staged(labels.join(seen, "node", "left").select("node", F.least("component", "near").alias("to"), F.col("component").alias("old")), name)
        jump = moved.select(F.col("node").alias("to"), F.col("to").alias("far"))
        new = staged(moved.join(jump, "to", "left").select("node", F.least("to", "far").alias("component"), "old"), name)
        release(last, moved)
        if new.where(F.col("component") != F.col("old")).isEmpty():
            release(both)
            return new.select("node", "component")
        last = new


def _stars(at: DataFrame) -> DataFrame:
    """Edges that make the components found so far."""
    return at.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a <> b")


def _mixed(edges: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(components so far, the members of buckets that hold more than one, with their component)."""
    at = components(edges)
    m = members.join(at.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = m.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    return at, staged(m.join(mixed, "bucket"), "mixed")


def _usual(mixed: DataFrame, sets: DataFrame) -> DataFrame:
    """(rep, usual): in how many of the classes in question a class's shingles occur on average."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                x, bounds = _values(part.column("s"))
                row = pa.array(np.repeat(np.arange(part.num_rows), np.diff(bounds)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(row), pa.array(signed(x) if len(x) else np.zeros(0, np.int64))], ["rep", "shingle"])

    kind = mixed.schema["rep"].dataType.simpleString()
    asked = mixed.select(F.col("rep").alias("doc_id")).distinct()
    rows = sets.join(asked, "doc_id", "left_semi").mapInArrow(tidy(explode), f"rep {kind}, shingle long")
    times = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("times"))
    return staged(rows.join(times, "shingle").groupBy("rep").agg(F.avg("times").alias("usual")), "usual")


def _leading(against: DataFrame, still: DataFrame, num: int, den: int) -> DataFrame:
    """pivot, shingle, rep, n, d and place: the first shingles of each class's differences from the bucket's pivot, which tell
    exactly which classes can be linked.

    The symmetric difference of two classes is that of their differences D from a common pivot, and two linked classes
    differ by at most t = (den-num)/(den+num) of the sum of their sizes. If |D| + |D'| <= t both are linked with the
    pivot and so in one component. Otherwise they share at least (|D| + |D'| - t) / 2 of D and D', so with each D in order
    of rarity, the first shared shingle is among the first t + 1 of both, and leaves enough behind it in both. Edited
    copies of one original differ from it by rare shingles, so few pairs pass."""
    at = still.select("pivot", "rep").distinct()
    d = against.select(F.col("a").alias("pivot"), F.col("b").alias("rep"), F.col("nb").alias("n"), "diff").join(at, ["pivot", "rep"])
    rows = d.select("pivot", "rep", "n", F.size("diff").alias("d"), F.explode("diff").alias("shingle"))
    times = rows.groupBy("pivot", "shingle").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    # shingles that are there once come first in the order; they are in no other difference, only their number counts
    shared = rows.join(times, ["pivot", "shingle"])
    ranked = shared.withColumn("place", F.row_number().over(Window.partitionBy("pivot", "rep").orderBy("times", "shingle")))
    ranked = ranked.withColumn("place", F.col("place") + F.col("d") - F.count(F.lit(1)).over(Window.partitionBy("pivot", "rep")))
    # the other's size is at most den / num of this one's
    first = ranked.where((den + num) * num * (F.col("place") - 1) <= (den - num) * (num + den) * F.col("n"))
    return staged(first.select("pivot", "shingle", "rep", "n", "d", "place"), "first")


def _enough(num: int, den: int) -> Column:
    left = F.least(F.col("d") - F.col("place"), F.col("d2") - F.col("place2")) + 1
    return (den + num) * (F.col("d") + F.col("d2") - 2 * left) <= (den - num) * (F.col("n") + F.col("n2"))


def _candidates(first: DataFrame, at: DataFrame, num: int, den: int, leaders: bool) -> DataFrame:
    """(a, b): classes in different components that may be linked, by their `_leading` shingles. With `leaders`, only pairs with the
    least class of each shingle: a family that shares its differences from the pivot becomes one component so, and isn't
    compared pair by pair."""
    known = first.join(at.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    cols = ("rep", "component", "n", "d", "place")
    if leaders:
        best = known.groupBy("pivot", "shingle").agg(F.min(F.struct(*cols)).alias("x"))
        other = best.select("pivot", "shingle", *[F.col(f"x.{c}").alias(f"{c}2") for c in cols])
        pairs = known.join(other, ["pivot", "shingle"]).where("rep2 < rep")
    else:
        # only shingles of several components
        several = known.groupBy("pivot", "shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("pivot", "shingle")
        known = known.join(several, ["pivot", "shingle"])
        other = known.select("pivot", "shingle", *[F.col(c).alias(f"{c}2") for c in cols])
        pairs = known.join(other, ["pivot", "shingle"]).where("rep2 < rep")
    return pairs.where("component <> component2").where(_enough(num, den)).select(F.col("rep2").alias("a"), F.col("rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, rows: int = 6, miss: float = 1e-6) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable), kept (the component's least doc_id), n_component."""
    bands = bands_for(num / den, rows, miss)
    docs = docs.select("doc_id", "text")
    signed_ = staged(signatures(docs, k, bands, rows), "signatures")
    name = ["set_lo", "set_hi", "n_shingles"]
    usable = signed_.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = staged(usable.groupBy(*name).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes")
    placed = classes.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.min("rep").alias("leader")).where("m > 1").drop("m")
    members = staged(placed.join(shared, "bucket"), "members")
    # a doc_id with several texts is one node: its sets are linked by the id alone
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = staged(_sets(docs.join(wanted, "doc_id", "left_semi"), k).distinct(), "sets", "none")

    fits = lambda x, y: den * F.least(x, y) >= num * F.greatest(x, y)
    sizes = members.select("rep", "n").distinct()
    first = members.where(F.col("rep") != F.col("leader")).select(F.col("leader").alias("a"), F.col("rep").alias("b"), F.col("n").alias("nb")).distinct()
    first = first.join(sizes.select(F.col("rep").alias("a"), F.col("n").alias("na")), "a").where(fits(F.col("na"), F.col("nb"))).select("a", "b").distinct()
    edges = staged(_links(compared(first, sets), num, den), "edges")
    at, mixed = _mixed(edges, members)

    # the second star: each bucket's pivot is the class of the most usual shingles, the original of edited copies
    mixed = mixed.join(_usual(mixed, sets), "rep", "left")
    pivots = mixed.groupBy("bucket").agg(F.max(F.struct(F.coalesce("usual", F.lit(0.0)), "rep")).alias("x"))
    mixed = staged(mixed.join(pivots.select("bucket", F.col("x.rep").alias("pivot")), "bucket"), "mixed")
    again = mixed.where(F.col("rep") != F.col("pivot")).select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    against = staged(compared(again, sets, True), "second")
    at, still = _mixed(_stars(at).unionByName(_links(against, num, den)), mixed.drop("component"))

    # what is left: first with the least class of each shingle, then pair by pair what is still apart
    done = first.unionByName(again).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    leading = _leading(against, still, num, den)
    for leaders in (True, False):
        rest = staged(_candidates(leading, at, num, den, leaders).join(done, ["a", "b"], "left_anti"), "rest")
        found = staged(_links(compared(rest, sets), num, den), "edges")
        if not found.isEmpty():
            at = components(_stars(at).unionByName(found))
        done = done.unionByName(rest)
    release(sets, members, leading)

    of_class = classes.select(*name, "rep").join(at.select(F.col("node").alias("rep"), "component"), "rep", "left").select(*name, F.coalesce("component", "rep").alias("component"))
    out = signed_.select("doc_id", *name).join(of_class, name, "left")
    ours = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", ours.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: three-word shingles, linked from 85 %."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, num=85, den=100)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w
), e AS (SELECT doc_id, unnest(s) AS g FROM s), n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
f AS (SELECT g FROM e GROUP BY g HAVING count(*) > 1),
i AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN f USING (g) JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), r AS (
  SELECT doc_id AS node, doc_id AS to_id FROM n UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.to_id
)
SELECT n.doc_id, n.n AS n_shingles, min(r.to_id) AS component_id, min(r.to_id) = n.doc_id AS kept
FROM n JOIN r ON r.node = n.doc_id GROUP BY n.doc_id, n.n
"""
