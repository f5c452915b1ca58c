"""What the two substring operators share: sampled suffixes, repeated prefixes, and the text around them.

All suffixes of a corpus are far more than a cluster can shuffle, so suffixes are sampled: a window of `length` values
(words or bytes) takes the least of its hashed k-grams as its anchor, and only suffixes that start at anchors are used.
The anchor depends on the window alone, so equal windows have equal anchors at equal places, and a window whose anchor
occurs once only can't be repeated. A text of n values has about 2n / (length - k) anchors, and only the text around
repeated ones is ever shuffled. None of this loses a repeat, and hashes choose anchors only: what is equal is decided by
comparing words or bytes.

Two windows that have their anchor at offset o are equal where the suffixes from their anchors share length - o values and
the texts before the anchors, read backwards, share o. Suffixes are grouped by their first values (their prefix, or leading
tokens); in a group they are ordered once forwards and once backwards, with the depths that neighbours share. Between two
depths at which either order parts a group anew, all offsets have the same classes of equal windows, so `classes` needs a step
for each part and not one for each window.

Groups fit a task: a group has `hot` suffixes at most. Suffixes whose first k values are more frequent are handled so: a
document's equal surroundings become one row with a list of places, equal surroundings become one context by an aggregation with
partial sums in each task. What is left of an anchor with more than `hot` contexts is judged in one of two ways:

* Words: contexts are grouped by longer prefixes, each by the shortest of `prefixes` that at most `hot` of them share. Windows that
  end inside that prefix may have equals in other groups; they are compared across groups by an aggregation of their 128-bit
  names, again with partial sums. That is a row for each such window.
* Bytes: the contexts are texts, whose windows take new and longer anchors, and all of the above is done again with those. Equal windows
  have equal anchors at each length, so their contexts go on together. A longer anchor that lies within a common passage occurs in
  equal surroundings mostly, which are one context, and one that reaches beyond it is rare. A context has a few longer anchors, never
  a row for each window; the last anchors are whole windows, each of which has but one context.

Texts that are equal as a whole are one class, made by an aggregation over their digests: only the class's first document
goes on, with the number of its copies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import Words, binary_array, byte_gram_hash, codes_of, covered, fold, gram_hash, minimizers, mix, ragged, signed, slices, span_hash, spans_array, text_buffers, text_slices, tidy
from lexispark.session import ready
from lexispark.storage import release, staged

#: Suffixes of a group at most.
HOT = 1024
#: Bytes of text that a task judges at once, or one group if that is more.
TABLE_BYTES = 1 << 21

_U = np.uint64


@dataclass(frozen=True)
class Unit:
    """Windows of `length` words or bytes, with anchors of k of them; `prefixes` are the longer prefixes, the last one of
    `length` values, or none if windows of crowded anchors take longer anchors."""

    words: bool
    length: int
    k: int
    prefixes: tuple[int, ...] = ()

    def longer(self) -> Unit:
        """With anchors that leave a quarter of the places to choose from, in the end none."""
        return replace(self, k=self.length - (self.length - self.k) // 4)

    def values(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, Words | None]:
        """(a hash of each word, or the bytes, bounds of each document's, the words)."""
        if not self.words:
            return data, offsets, None
        w = Words(data, offsets)
        return w.hashes(), w.bounds, w

    def symbols(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a number above 0 for each word or byte, equal exactly where they are, bounds of each text's)."""
        if not self.words:
            return data, offsets
        w = Words(data, offsets)
        return w.codes() + np.int32(1), w.bounds

    def runs(self, values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(key of the anchor, its place, first window, number of windows) of each run of windows with one anchor."""
        keys = gram_hash(values, self.k) if self.words else byte_gram_hash(values, self.k)
        at, first, n = minimizers(keys, bounds, self.length, self.k)
        return keys[at], at, first, n


def text_id(text: str = "text") -> Column:
    """128 bits of a digest of the whole text; a null text is empty. Equal texts have equal ids."""
    return F.unhex(F.substring(F.sha2(F.coalesce(F.col(text), F.lit("")), 256), 1, 32))


def one_of_each(docs: DataFrame) -> DataFrame:
    """id, doc_id (the least), copies and text of each different text."""
    return docs.select(text_id().alias("id"), "doc_id", "text").groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"))


def anchors(docs: DataFrame, unit: Unit) -> DataFrame:
    """key, id, doc_id, places (how many runs of the document have that anchor)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("id")
            for a, _, data, offsets in text_slices(batch.column("text")):
                values, bounds, _ = unit.values(data, offsets)
                key, at, _, _ = unit.runs(values, bounds)
                doc = np.searchsorted(bounds, at, "right") - 1
                order = np.lexsort((at, key, doc))
                key, at, doc = key[order], at[order], doc[order]
                place = np.ones(len(key), bool)
                place[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])
                key, doc = key[place], doc[place]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                first = np.flatnonzero(new)
                of = pa.array(doc[first] + a)
                yield pa.RecordBatch.from_arrays([pa.array(signed(key[first])), texts.take(of), ids.take(of), pa.array(np.diff(np.append(first, len(key))), pa.int64())], ["key", "id", "doc_id", "places"])

    return docs.select("id", "doc_id", "text").mapInArrow(tidy(find), f"key long, id binary, doc_id {kind}, places long")


def repeated(found: DataFrame, across: bool, hot: int = HOT) -> DataFrame:
    """id, doc_id, keys, hots: each text's anchors that occur again (in another document, if `across`), and whether they
    are hot."""
    seen = found.groupBy("key").agg(F.sum("places").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    seen = seen.where("lo < hi" if across else "n > 1").select("key", (F.col("n") > hot).alias("hot"))
    return found.select("key", "id", "doc_id").join(seen, "key").groupBy("id", "doc_id").agg(F.collect_list("key").alias("keys"), F.collect_list("hot").alias("hots"))


def surroundings(docs: DataFrame, unit: Unit) -> DataFrame:
    """Of docs (id, doc_id, text, keys, hots): key, id, doc_id, first, n, back (how many values lie before the anchor) and the
    text (`around`) of the n windows from `first` whose anchor is a repeated one, and whether it is hot. Runs around a hot
    anchor with the same text in one document are one row; `places` has the first window of each."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["key", "id", "doc_id", "first", "n", "back", "around", "hot", "places"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("id")
            for a, b, data, offsets in text_slices(batch.column("text")):
                keys, at_key = _flat(batch.column("keys").slice(a, b - a))
                hots, _ = _flat(batch.column("hots").slice(a, b - a))
                values, bounds, w = unit.values(data, offsets)
                key, at, first, n = unit.runs(values, bounds)
                doc = np.searchsorted(bounds, first, "right") - 1
                mine = _find(keys.view(_U), np.repeat(np.arange(b - a), np.diff(at_key)), key, doc, at_key)
                keep = mine >= 0
                if not keep.any():
                    continue
                key, at, first, n, doc, hot = key[keep], at[keep], first[keep], n[keep], doc[keep], hots[mine[keep]].astype(bool)
                last = first + n + unit.length - 1
                lo, hi = (w.starts[first], w.ends[last - 1]) if unit.words else (first, last)
                name = np.arange(len(key), dtype=_U)
                if hot.any():
                    name[hot] = span_hash(data, lo[hot], hi[hot])
                back = at - first
                order = np.lexsort((first, back, name, key, doc))
                of_same = [c[order] for c in (back, name, key, doc)]
                begin = np.flatnonzero(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in of_same])])
                places, at_place = (first - bounds[doc])[order], np.append(begin, len(order))
                key, n, back, doc, hot, lo, hi = (c[order[begin]] for c in (key, n, back, doc, hot, lo, hi))
                for x, y in slices(np.concatenate([[0], np.cumsum(hi - lo)]), 1 << 21):
                    of = pa.array(doc[x:y] + a)
                    p, q = at_place[x], at_place[y]
                    listed = pa.ListArray.from_arrays(pa.array(at_place[x : y + 1] - p, pa.int32()), pa.array(places[p:q]))
                    yield pa.RecordBatch.from_arrays([pa.array(signed(key[x:y])), texts.take(of), ids.take(of), pa.array(places[at_place[x:y]]), pa.array(n[x:y]), pa.array(back[x:y]), spans_array(data, lo[x:y], hi[x:y]), pa.array(hot[x:y]), listed], names)

    return docs.mapInArrow(tidy(cut), f"key long, id binary, doc_id {kind}, first long, n long, back long, around binary, hot boolean, places array<long>")


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = lists.offsets.to_numpy()
    values = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_numpy(zero_copy_only=False)
    return values, (offsets - offsets[0]).astype(np.int64)


def _find(wanted: np.ndarray, wanted_doc: np.ndarray, key: np.ndarray, doc: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The place of each (doc, key) among `wanted` (sorted within each document), -1 if it isn't there."""
    # one sorted list: a mixed name for (document, key) pairs
    salt = mix(np.arange(len(bounds), dtype=_U) + _U(1))
    names = mix(wanted ^ salt[wanted_doc]) if len(wanted) else np.zeros(0, _U)
    order = np.argsort(names)
    ask = mix(key ^ salt[doc]) if len(key) else np.zeros(0, _U)
    at = np.searchsorted(names[order], ask)
    at = np.minimum(at, max(0, len(names) - 1))
    if not len(names):
        return np.full(len(ask), -1)
    return np.where(names[order][at] == ask, order[at], -1)


def whole_keys(batches: Iterator[pa.RecordBatch], most: int = TABLE_BYTES) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by key as tables of whole keys, of about `most` bytes of text, and each row's number of its key."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            held.append(part)
            size += int(pc.sum(pc.binary_length(part.column("around"))).as_py() or 0)
            if size >= most:
                table = pa.Table.from_batches(held)
                key, n = codes_of(table.column("key").combine_chunks())
                cut = int(np.searchsorted(key, n - 1))
                if cut:
                    yield table.slice(0, cut), key[:cut]
                    held = table.slice(cut).combine_chunks().to_batches()
                    size = sum(int(pc.sum(pc.binary_length(b.column("around"))).as_py() or 0) for b in held)
    if held:
        table = pa.Table.from_batches(held)
        yield table, codes_of(table.column("key").combine_chunks())[0]


def rows_of(symbols: np.ndarray, first: np.ndarray, size: np.ndarray, width: int, step: int) -> np.ndarray:
    """A row of `width` symbols for each place `first`, `size` of them there and zeros after, forwards or (step -1) backwards."""
    at = np.arange(width, dtype=np.int32)
    place = first.astype(np.int32)[:, None] + step * at
    out = symbols[np.clip(place, 0, max(0, len(symbols) - 1))]
    out[at >= size[:, None]] = 0
    return out


def shared_depth(rows: np.ndarray, size: np.ndarray, order: np.ndarray, group: np.ndarray) -> np.ndarray:
    """How many symbols each row of the order shares with the one before; -1 for the first of a group."""
    out = np.full(len(order), -1, np.int64)
    if len(order) > 1:
        a, b = order[:-1], order[1:]
        differ = rows[a] != rows[b]
        depth = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        out[1:] = np.where(group[a] == group[b], np.minimum(depth, np.minimum(size[a], size[b])), -1)
    return out


def classes(group: np.ndarray, forth: np.ndarray, depth: np.ndarray, back: np.ndarray, behind: np.ndarray, length: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(suffixes, class, from, to): the classes of suffixes whose windows at offsets from `from` to before `to` are equal. `forth` and
    `back` are the orders of suffixes and of the texts before them, in each group; `depth` and `behind` what neighbours share.
    Offsets are below `most`."""
    n = int(group.max()) + 1 if len(group) else 0
    deepest, longest = np.full(n, -1), np.full(n, -1)
    np.maximum.at(deepest, group[forth], depth)
    np.maximum.at(longest, group[back], behind)
    inner, outer = depth >= 0, behind >= 0
    g = np.concatenate([np.arange(n), group[forth][inner], group[back][outer]])
    o = np.concatenate([np.zeros(n, np.int64), length - depth[inner], behind[outer] + 1])
    part = np.unique(g * (most + 1) + np.clip(o, 0, most))
    g, o = part // (most + 1), part % (most + 1)
    end = np.append(o[1:], most)
    end[np.append(g[1:] != g[:-1], True)] = most
    use = (o < most) & (length - o <= deepest[g]) & (o <= longest[g])
    g, o, end = g[use], o[use], end[use]
    if not len(g):
        return
    first = np.searchsorted(g, np.arange(n))
    many = np.searchsorted(g, np.arange(n), "right") - first
    label, size = np.zeros(len(group), np.int64), len(group) + 1
    f, d, b, e = forth, depth, back, behind
    for s in range(int(many.max())):
        alive_f, alive_b = many[group[f]] > s, many[group[b]] > s
        f, d, b, e = f[alive_f], d[alive_f], b[alive_b], e[alive_b]
        at = np.minimum(first + s, len(o) - 1)
        begin, stop = o[at], end[at]
        label[f] = np.cumsum(d < length - begin[group[f]]) * size
        label[b] += np.cumsum(e < begin[group[b]])
        yield f, label[f], begin[group[f]], stop[group[f]]


def judged(suffixes: DataFrame, unit: Unit, ordered: Callable, marks: Callable) -> DataFrame:
    """id, first, n of the windows that `marks` chooses; `suffixes` are sorted into groups by `key`, whole groups in a task.
    `ordered` gives an order of rows of symbols within their groups; `marks` gets the rows of whole groups and, class by class, who is in it."""
    most = unit.length - unit.k + 1

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_keys(batches):
            data, offsets = text_buffers(table.column("around").combine_chunks())
            data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
            symbols, bounds = unit.symbols(data, offsets)
            before = table.column("back").to_numpy()
            at = bounds[:-1] + before
            ahead = bounds[1:] - at
            forwards = rows_of(symbols, at, ahead, unit.length, 1)
            forth = ordered(forwards, ahead, group)
            depth = shared_depth(forwards, ahead, forth, group)
            del forwards
            backwards = rows_of(symbols, at - 1, before, most, -1)
            back = ordered(backwards, before, group)
            behind = shared_depth(backwards, before, back, group)
            del backwards
            change = np.zeros((len(at), most + 1), np.int16)
            chosen = marks(table)
            for who, label, begin, end in classes(group, forth, depth, back, behind, unit.length, most):
                yes = chosen(who, label)
                who, begin, end = who[yes], begin[yes], end[yes]
                change[who, begin] += 1
                change[who, end] -= 1
            marked = np.cumsum(change, axis=1, dtype=np.int16) > 0
            marked[:, most] = False
            flat = marked.ravel().view(np.int8)
            edge = np.flatnonzero(np.diff(flat, prepend=0))
            row, begin, end = edge[::2] // (most + 1), edge[::2] % (most + 1), edge[1::2] % (most + 1)
            first = table.column("first").to_numpy()[row] + before[row] - end + 1
            yield pa.RecordBatch.from_arrays([table.column("id").combine_chunks().take(pa.array(row)), pa.array(first, pa.int64()), pa.array(end - begin, pa.int64())], ["id", "first", "n"])

    return suffixes.select("key", "id", "doc_id", "first", "back", "around").sortWithinPartitions("key").mapInArrow(tidy(judge), "id binary, first long, n long")


def prefixed(contexts: DataFrame, unit: Unit) -> DataFrame:
    """`contexts` (cid, around, back and others) with `leads`: a name, a 128-bit hash, of each of the unit's prefixes of the suffix, of
    those that the text is long enough for."""
    rest = [f for f in contexts.schema if f.name != "leads"]

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column("around")):
                values, bounds, w = unit.values(data, offsets)
                at = bounds[:-1] + batch.column("back").slice(a, b - a).to_numpy()
                found, sizes = [], []
                for n in unit.prefixes:
                    there = bounds[1:] - at >= n
                    raw = np.zeros((b - a, 2), _U)
                    raw[there, 0], raw[there, 1] = fold(values, at[there], n), fold(w.hashes(1), at[there], n, 1)
                    found.append(binary_array(raw.view(np.uint8).ravel(), np.full(b - a, 16)))
                    sizes.append(there)
                p, m = len(unit.prefixes), b - a
                flat = pa.concat_arrays(found).take(pa.array((np.arange(p) * m + np.arange(m)[:, None])[np.array(sizes).T]))
                count = np.array(sizes).sum(axis=0)
                leads = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([*[batch.column(f.name).slice(a, b - a) for f in rest], leads], [*[f.name for f in rest], "leads"])

    return contexts.mapInArrow(tidy(lead), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest) + ", leads array<binary>")


def named(contexts: DataFrame, unit: Unit) -> DataFrame:
    """name1, name2, id, doc_id, first: a row for each window that ends inside the first `depth` values after the anchor."""
    kind = contexts.schema["doc_id"].dataType.simpleString()

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column("around"), 1 << 17):
                values, bounds, w = unit.values(data, offsets)
                back, n, depth = (batch.column(c).slice(a, b - a).to_numpy() for c in ("back", "n", "depth"))
                # windows have offsets from back - n + 1 to back; those in question end inside the prefix
                least = np.maximum(back - n + 1, unit.length - depth)
                many = np.maximum(0, back - least + 1)
                first = ragged(np.zeros(b - a, np.int64), many)
                row = np.repeat(np.arange(b - a), many)
                place = bounds[:-1][row] + first
                names = [fold(values, place, unit.length), fold(w.hashes(1), place, unit.length, 1)]
                of = pa.array(row + a)
                yield pa.RecordBatch.from_arrays([*[pa.array(signed(x)) for x in names], batch.column("id").take(of), batch.column("doc_id").take(of), pa.array(first)], ["name1", "name2", "id", "doc_id", "first"])

    return contexts.select("id", "doc_id", "n", "back", "depth", "around").mapInArrow(tidy(name), f"name1 long, name2 long, id binary, doc_id {kind}, first long")


def hot_judged(members: DataFrame, unit: Unit, deal: Callable, judge: Callable, deeper: Callable, across: bool, hot: int) -> tuple[DataFrame, list[DataFrame]]:
    """(id, spans (array<struct<first, n>>) of repeated windows around hot anchors, by contexts; see above; and the staged tables that
    it reads). `deeper` judges texts by longer anchors."""
    members = members.withColumn("cid", F.unhex(F.md5(F.concat("around", F.concat_ws(",", "key", "back").cast("binary")))))
    contexts = staged(members.groupBy("key", "cid").agg(F.min("doc_id").alias("doc_id"), F.sum(F.size("places")).alias("times"), F.first("n").alias("n"), F.first("back").alias("back"), F.first("around").alias("around")), "contexts")
    crowded = contexts.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > hot).select("key")
    tables = [contexts]
    base = contexts.withColumn("id", F.col("cid")).withColumn("first", F.lit(0).cast("long"))
    runs = judge(deal(base.join(crowded, "key", "left_anti"), unit.k))
    many = not crowded.isEmpty()
    if many and not unit.prefixes:
        deep = staged(base.join(crowded, "key", "left_semi").select("id", "doc_id", F.col("around").alias("text")), "crowded")
        found, read = deeper(deep)
        found = staged(found, "again")
        release(deep, *read)
        tables.append(found)
        runs = runs.unionByName(found.select("id", F.explode("spans").alias("s")).select("id", "s.first", "s.n"))
    elif many:
        deep = staged(prefixed(base.join(crowded, "key", "left_semi"), unit), "prefixes")
        levels = deep.select("id", F.posexplode("leads").alias("level", "lead"))
        fits = levels.groupBy("lead").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") <= hot).select("lead")
        chosen = levels.join(fits, "lead").groupBy("id").agg(F.min("level").alias("level"))
        depths = F.array(*[F.lit(n).cast("long") for n in unit.prefixes])
        placed = staged(deep.join(chosen, "id", "left").withColumn("depth", F.coalesce(F.get(depths, F.col("level")), F.lit(unit.length).cast("long"))), "placed")
        tables += [deep, placed]
        # a context with no prefix that few share has all its windows compared by name
        grouped = placed.where("level is not null").withColumn("key", F.get("leads", F.col("level")))
        names = named(placed, unit)
        seen = names.groupBy("name1", "name2").agg(F.count(F.lit(1)).alias("m"), F.min("doc_id").alias("least")).where("m > 1").drop("m")
        again = names.join(seen, ["name1", "name2"])
        trunk = (again.where("doc_id > least") if across else again).select("id", "first", F.lit(1).cast("long").alias("n"))
        runs = runs.unionByName(judge(deal(grouped))).unionByName(trunk)
    runs = runs.groupBy(F.col("id").alias("cid")).agg(F.collect_list(F.struct("first", "n")).alias("runs"))
    placed = members.select("cid", "id", "doc_id", "places", "n").join(contexts.select("cid", "times", F.col("doc_id").alias("least")), "cid")
    whole = (F.col("doc_id") > F.col("least")) if across else (F.col("times") > 1)
    whole = F.coalesce(whole, F.lit(False))
    span = lambda first, n: F.struct(first.alias("first"), n.alias("n"))
    all_of = F.transform("places", lambda p: span(p, F.col("n")))
    some_of = F.flatten(F.transform("places", lambda p: F.transform("runs", lambda r: span(p + r["first"], r["n"]))))
    # a null doc_id has none smaller
    rest = placed.where(~whole & (F.col("doc_id").isNotNull() if across else F.lit(True)))
    return placed.where(whole).select("id", all_of.alias("spans")).unionByName(rest.join(runs, "cid").select("id", some_of.alias("spans"))), tables


def windows(texts: DataFrame, with_texts: Callable, unit: Unit, deal: Callable, ordered: Callable, marks: Callable, across: bool, hot: int) -> tuple[DataFrame, list[DataFrame]]:
    """(id, spans (array<struct<first, n>>): rows of repeated windows of different texts (id, doc_id, text), several to a text; the
    staged tables that it reads). `with_texts` gives rows of id and doc_id their texts."""
    found = staged(anchors(texts, unit), "anchors")
    again = staged(repeated(found, across, hot), "repeated")
    release(found)
    around = staged(surroundings(with_texts(again).select("id", "doc_id", "text", "keys", "hots"), unit), "around")
    release(again)
    judge = lambda rows: judged(rows, unit, ordered, marks)
    deeper = lambda own: windows(own, lambda rows: rows.join(own.select("id", "text"), "id"), unit.longer(), deal, ordered, marks, across, hot)
    runs = judge(deal(around.where("not hot"), unit.k))
    hots, tables = hot_judged(around.where("hot"), unit, deal, judge, deeper, across, hot)
    return runs.select("id", F.array(F.struct("first", "n")).alias("spans")).unionByName(hots), [around, *tables]


def spans(docs: DataFrame, unit: Unit, deal: Callable, ordered: Callable, marks: Callable, across: bool, hot: int = HOT) -> DataFrame:
    """id, least_id, copies, spans: of each text that is there more than once or has repeated windows, its least doc_id,
    the number of its copies, and array<struct<first, n>> of the repeated windows. `deal` partitions suffixes into groups, by their
    first k values or, without k, by the key that they have."""
    ready(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    least = lambda rows: docs.withColumn("id", text_id()).withColumnRenamed("doc_id", "own").join(rows, "id").where(F.col("own").eqNullSafe(F.col("doc_id")))
    marked, tables = windows(one_of_each(docs), least, unit, deal, ordered, marks, across, hot)
    marked = marked.groupBy("id").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    copies = docs.select(text_id().alias("id"), "doc_id").groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    out = copies.join(marked, "id", "left").where("copies > 1 or spans is not null")
    out = staged(out.withColumnRenamed("doc_id", "least_id"), "repeats")
    release(*tables)
    return out


def removed(column: pa.Array, part: slice, bounds: np.ndarray, length: int) -> np.ndarray:
    """Which values the documents' repeated windows cover; `column` holds spans, null for none."""
    out = np.zeros(int(bounds[-1]), bool)
    for d, found in enumerate(column.slice(part.start, part.stop - part.start).to_pylist()):
        if found:
            a, b = int(bounds[d]), int(bounds[d + 1])
            first = np.array([x["first"] for x in found])
            out[a:b] = covered(b - a, first, first + np.array([x["n"] for x in found]) + length - 1)
    return out
