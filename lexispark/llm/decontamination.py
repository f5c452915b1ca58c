"""7. Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts are sequences of lower-cased words (runs of letters, digits and non-ASCII bytes, so punctuation doesn't hide a
passage). A document is contaminated by an item of n words if some stretch of it is within K = floor(`share` * n) word edits
of the whole item; items of fewer than 1 / `share` words must occur as they are.

Windows of each item's size are embedded by the random walk of Chakraborty, Goldenberg and Koucky: it goes over the window's
words, staying or going on as a random bit of the step and word says, and writes the word at each step, so that small edit
distances become small Hamming distances. A walk depends on the text from its start on, so one serves all sizes. Sampled places
of the embedding are the keys of hash tables that hold the items' keys. The tables alone say which item a window may match;
`WALKS` independent embeddings with `SAMPLES` tables each make a miss as unlikely as `RECALL` says (a test measures it at all of the
edits allowed). Candidates are verified by exact edit distance against the text around the window.

Not every window is worth a walk. A stretch within K edits of an item holds n - 1 - 2K of its pairs of neighbouring words at least
(the q-gram lemma), so only windows with that many pairs that occur anywhere in the benchmark are embedded. This loses nothing
and names no item. One pass over the documents cuts out those stretches, with a table of PAIR_BITS bits of the benchmark's pairs as
the only broadcast, of the same size for every benchmark. Blocks of `block` items are then broadcast one after another, each
against the stretches alone.

Defined results: null and empty texts match nothing; items without words (and null ones) are ignored; repeated items match each
for itself; repeated documents get rows each; an empty benchmark gives no matches; other columns travel along in
`decontaminated`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm.common import LOWER, Words, binary_array, gram_hash, mix, ragged, text_slices, tidy
from lexispark.session import ready
from lexispark.storage import release, staged

_U = np.uint64
SHARE = 0.2
WALKS, SAMPLES, PLACES = 8, 6, 3
#: Of a pair within the edits allowed.
RECALL = 0.99
#: Size of the table of the benchmark's pairs of words: 2 MB.
PAIR_BITS = 1 << 24
#: What the symbols of a key are multiplied by.
FACTORS = [mix(np.array([i + 1], _U))[0] | _U(1) for i in range(PLACES)]

SEPARATOR = np.ones(256, bool)
SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = False


def word_values(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each lower-cased word, bounds of each document's)."""
    if not len(data):
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    w = Words(LOWER[data], offsets, SEPARATOR)
    return w.hashes(), w.bounds


def edits(n: np.ndarray, share: float) -> np.ndarray:
    """Word edits that an item of n words allows."""
    return (n * share + 1e-9).astype(np.int64)


def pairs(values: np.ndarray) -> np.ndarray:
    """A hash of each word and the next; of the last word alone."""
    return np.append(gram_hash(values, 2), mix(values[-1:] ^ _U(0x5851F42D4C957F2D)))


def single(values: np.ndarray) -> np.ndarray:
    return mix(values ^ _U(0x5851F42D4C957F2D))


def _place(h: np.ndarray, bits: int) -> np.ndarray:
    return (h & _U(bits - 1)).astype(np.int64)


class Windows:
    """Which windows can match an item at all, by the pairs of the benchmark."""

    def __init__(self, known: np.ndarray, sizes: np.ndarray, share: float):
        """`known` flags hashed pairs (and items of one word); `sizes` are the items' different sizes, or the bounds of classes
        of sizes as rows (least, most)."""
        self.known = known
        self.sizes = sizes if sizes.ndim == 2 else np.stack([sizes, sizes], 1)
        self.share = share

    def starts(self, values: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(least size, most, starts of windows that may match) for each size or class."""
        n, bits = len(values), len(self.known)
        doc_end = np.repeat(bounds[1:], np.diff(bounds))
        hit = np.zeros(n + 1, np.int32)
        hit[:n] = self.known[_place(pairs(values), bits)]
        hit[bounds[1:][bounds[1:] > 0] - 1] = 0  # no pair across documents
        upto = np.concatenate([[0], np.cumsum(hit)])
        place = np.arange(n)
        for least, most in self.sizes.tolist():
            if least == 1:
                yield least, most, np.flatnonzero(self.known[_place(single(values), bits)])
                if most == 1:
                    continue
                least = 2
            size = np.arange(least, most + 1)
            need = int((size - 1 - 2 * edits(size, self.share)).min())
            stop = np.minimum(place + most + int(edits(np.array(most), self.share)), doc_end)
            yield least, most, np.flatnonzero(upto[stop - 1] - upto[:n] >= need)


def size_classes(sizes: np.ndarray) -> np.ndarray:
    """Rows (least, most) of classes of sizes, the most a quarter above the least."""
    out: list[list[int]] = []
    for n in sorted(set(sizes.tolist())):
        if out and n <= out[-1][0] * 1.25:
            out[-1][1] = n
        else:
            out.append([n, n])
    return np.array(out, np.int64).reshape(-1, 2)


def walked(values: np.ndarray, at: np.ndarray, end: np.ndarray, steps: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """The embeddings of the texts from `at` to `end`: the word at each step (0 beyond the end), and how far the walk is."""
    symbols, far = np.zeros((steps, len(at)), _U), np.zeros((steps, len(at)), np.int32)
    here = at.copy()
    wide = np.append(values, _U(0))
    salts = mix(np.arange(steps, dtype=_U) + _U((salt * 0x9E3779B97F4A7C15) & (2**64 - 1)))
    for j in range(steps):
        x = np.where(here < end, wide[np.minimum(here, len(values))], _U(0))
        symbols[j], far[j] = x, here - at
        here += (mix(x ^ salts[j]) >> _U(63)).astype(np.int64)
    return symbols, far


class Items:
    """A block of benchmark items, and their keys in every hash table."""

    def __init__(self, ids: list, texts: list[str], share: float, seed: int = 9):
        data, offsets = _buffer(texts)
        values, bounds = word_values(data, offsets)
        found: dict[bytes, list] = {}
        for i, a, b in zip(ids, bounds[:-1].tolist(), bounds[1:].tolist()):
            if b > a:
                found.setdefault(values[a:b].tobytes(), []).append(i)
        #: items with equal words are one, with several ids
        self.ids = list(found.values())
        self.words = [np.frombuffer(w, _U) for w in found]
        self.n = np.array([len(w) for w in self.words], np.int64)
        self.most = edits(self.n, share)
        self.seed = seed
        if not len(self.n):
            return
        known = np.zeros(1 << 20, bool)
        for w in self.words:
            known[_place(single(w) if len(w) == 1 else gram_hash(w, 2), len(known))] = True
        self.windows = Windows(known, np.unique(self.n), share)
        #: places are shares of an embedding's length, so that every size of item has its own
        self.places = np.random.default_rng(seed).random((WALKS, SAMPLES, PLACES))
        flat, start = np.concatenate(self.words), np.cumsum(self.n) - self.n
        keys, item = [], []
        for size in np.unique(self.n).tolist():
            these = np.flatnonzero(self.n == size)
            for walk in range(WALKS):
                symbols, far = walked(flat, start[these], start[these] + size, 2 * size, seed + walk)
                for key in self.keys(symbols, far, np.arange(len(these)), size, walk):
                    keys.append(key)
                    item.append(these)
        keys, item = np.concatenate(keys), np.concatenate(item)
        order = np.argsort(keys, kind="stable")
        self.table, self.table_item = keys[order], item[order]
        # most keys of texts are none of the table's, as their first bits tell
        self.bits = min(24, 6 + int(len(keys)).bit_length())
        self.flags = np.zeros(1 << self.bits, bool)
        self.flags[self._first_bits(self.table)] = True

    def _first_bits(self, key: np.ndarray) -> np.ndarray:
        return (key >> _U(64 - self.bits)).view(np.int64)

    def lookup(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in `key`, item) of the keys that are in the table."""
        at = np.flatnonzero(self.flags[self._first_bits(key)])
        lo, hi = np.searchsorted(self.table, key[at], "left"), np.searchsorted(self.table, key[at], "right")
        return np.repeat(at, hi - lo), self.table_item[ragged(lo, hi - lo)]

    def keys(self, symbols: np.ndarray, far: np.ndarray, rows: np.ndarray, size: int, walk: int) -> Iterator[np.ndarray]:
        """The keys of a walk's tables for windows of `size` words: the size and the sampled symbols; beyond the window's end there are none."""
        for t, salt in enumerate(mix(np.arange(SAMPLES, dtype=_U) + _U(size * 1009 + walk * SAMPLES))):
            key = np.full(len(rows), salt, _U)
            for factor, j in zip(FACTORS, (self.places[walk, t] * 2 * size).astype(np.int64).tolist()):
                # symbols are mixed; a key that others share by chance costs a verification
                key += symbols[j][rows] * (far[j][rows] < size) * factor
            yield key

    def candidates(self, values: np.ndarray, bounds: np.ndarray, chunk: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(start, item) of windows that share a key with an item."""
        by_size = [(size, at) for size, _, at in self.windows.starts(values, bounds) if len(at)]
        if not by_size:
            return
        starts = np.unique(np.concatenate([at for _, at in by_size]))
        end = bounds[1:][np.searchsorted(bounds, starts, "right") - 1]
        for a in range(0, len(starts), chunk):
            part = starts[a : a + chunk]
            here = [(size, np.searchsorted(part, at[np.searchsorted(at, part[0]) : np.searchsorted(at, part[-1], "right")])) for size, at in by_size]
            here = [(size, rows) for size, rows in here if len(rows)]
            steps = 2 * max(size for size, _ in here)
            for walk in range(WALKS):
                symbols, far = walked(values, part, end[a : a + chunk], steps, self.seed + walk)
                for size, rows in here:
                    for key in self.keys(symbols, far, rows, size, walk):
                        at, item = self.lookup(key)
                        if len(at):
                            right = self.n[item] == size
                            yield part[rows][at[right]], item[right]

    def matches(self, values: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start, words, distance): the closest stretch for each item that matches a text."""
        if not len(self.n) or not len(values):
            return []
        asked: set[tuple[int, int, int]] = set()
        for start, item in self.candidates(values, bounds):
            doc = np.searchsorted(bounds, start, "right") - 1
            asked.update(zip(doc.tolist(), item.tolist(), (start // np.maximum(1, self.most[item])).tolist()))
        # neighbouring starts are verified together, overlapping places as one
        places: list[list[int]] = []
        for d, i, near in sorted(asked):
            k, n = int(self.most[i]), int(self.n[i])
            a = max(int(bounds[d]), near * max(1, k) - 2 * k)
            b = min(int(bounds[d + 1]), near * max(1, k) + max(1, k) + n + 2 * k)
            if places and places[-1][:2] == [d, i] and a <= places[-1][3]:
                places[-1][3] = b
            else:
                places.append([d, i, a, b])
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        d, i, a, b = np.array(places, np.int64).reshape(-1, 4).T
        order = np.lexsort((b - a, self.n[i]))
        cuts = np.flatnonzero(np.diff(self.n[i][order])) + 1
        for same in np.split(order, cuts):
            for part in (same[x : x + 256] for x in range(0, len(same), 256)):
                for at, distance, s, e in zip(part.tolist(), *closest_of([self.words[x] for x in i[part]], [values[x:y] for x, y in zip(a[part], b[part])])):
                    doc, item, first = int(d[at]), int(i[at]), int(a[at])
                    if distance <= self.most[item]:
                        got = (distance, first + s - int(bounds[doc]), e - s)
                        best[doc, item] = min(best.get((doc, item), got), got)
        return [(x, y, s, n, distance) for (x, y), (distance, s, n) in sorted(best.items())]


def closest_of(items: list[np.ndarray], texts: list[np.ndarray]) -> tuple[list[int], list[int], list[int]]:
    """(edit distances, starts, ends) of the stretch of each text that is nearest to its item; all items have one size. Cost and start
    are one number, and a row of the table is made for all pairs at once."""
    big, size = 1 << 32, np.array([len(t) for t in texts])
    wide = np.zeros((len(texts), int(size.max(initial=0))), _U)
    for r, t in enumerate(texts):
        wide[r, : len(t)] = t
    place = np.arange(wide.shape[1] + 1, dtype=np.int64)
    row = np.repeat(place[None], len(texts), axis=0)  # nothing of the item used: cost 0, from any start
    for w in np.array(items).T if len(items) else ():
        step = row + big
        step[:, 1:] = np.minimum(step[:, 1:], row[:, :-1] + np.where(wide == w[:, None], 0, big))
        row = np.minimum.accumulate(step - place * big, axis=1) + place * big
    row[place > size[:, None]] = 1 << 62  # beyond the text's end
    end = row.argmin(axis=1)
    found = row[np.arange(len(row)), end]
    return (found // big).tolist(), (found % big).tolist(), end.tolist()


def closest(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edit distance, start, end) of the stretch of `text` that is nearest to `item`."""
    return tuple(x[0] for x in closest_of([item], [text]))


def _buffer(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def _known_pairs(benchmark: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(flags of the benchmark's hashed pairs, different sizes of items), by aggregations."""

    def list_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column("text")):
                values, bounds = word_values(data, offsets)
                if not len(values):
                    continue
                n = np.diff(bounds)
                whole = pairs(values)
                alone = np.repeat(n == 1, n)
                whole[alone] = single(values)[alone]
                last = np.zeros(len(values), bool)
                last[bounds[1:][n > 1] - 1] = True
                size = np.repeat(n, n)[~last]
                # places from 1, as the bitmap functions count
                yield pa.RecordBatch.from_arrays([pa.array(_place(whole[~last], PAIR_BITS) + 1), pa.array(size)], ["place", "size"])

    found = staged(benchmark.select("text").mapInArrow(tidy(list_pairs), "place long, size long"), "pairs")
    maps = found.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).collect()
    flags = np.zeros(PAIR_BITS, bool)
    for r in maps:
        bits = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")
        flags[(r["bucket"] - 1) * len(bits) : r["bucket"] * len(bits)] = bits
    sizes = np.array(sorted(r["size"] for r in found.select("size").distinct().collect()), np.int64)
    release(found)
    return flags, sizes


def stretches(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """row (a number of the document's row), doc_id, id (of its text), start and words (64-bit hashes) of the stretches that may
    match an item: windows that hold enough of the benchmark's pairs, with K words around, merged."""
    spark = docs.sparkSession
    ready(spark)
    known, sizes = _known_pairs(benchmark)
    shared = spark.sparkContext.broadcast((np.packbits(known), size_classes(sizes)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["row", "doc_id", "start", "words"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, of_sizes = shared.value
        windows = Windows(np.unpackbits(packed).astype(bool), of_sizes, share)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column("text")):
                values, bounds = word_values(data, offsets)
                change = np.zeros(len(values) + 1, np.int64)
                begin_of, end_of = (np.repeat(x, np.diff(bounds)) for x in (bounds[:-1], bounds[1:]))
                for _, most, at in windows.starts(values, bounds) if len(values) else ():
                    room = int(edits(np.array(most), share))
                    np.add.at(change, np.maximum(begin_of[at], at - 2 * room), 1)
                    np.add.at(change, np.minimum(end_of[at], at + most + 3 * room + 1), -1)
                inside = np.cumsum(change[:-1]) > 0
                if inside.any():
                    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
                    edge_at = bounds[1:-1]
                    lo, hi = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
                    cuts = edge_at[(edge_at > 0) & (edge_at < len(inside))]
                    cuts = np.unique(cuts[inside[cuts] & inside[cuts - 1]])
                    lo, hi = np.sort(np.concatenate([lo, cuts])), np.sort(np.concatenate([hi, cuts]))
                    doc = np.searchsorted(bounds, lo, "right") - 1
                    words = binary_array(values[ragged(lo, hi - lo)].view(np.uint8), 8 * (hi - lo))
                    yield pa.RecordBatch.from_arrays([pa.array(row + doc), batch.column("doc_id").take(pa.array(doc + a)), pa.array(lo - bounds[doc]), words], names)
                row += b - a

    return staged(docs.select("doc_id", "text").mapInArrow(tidy(cut), f"row long, doc_id {kind}, start long, words binary"), "stretches")


def _found(docs: DataFrame, benchmark: DataFrame, share: float, block: int) -> DataFrame:
    """row, doc_id, item_id, start, words and distance of each stretch's matches."""
    spark = docs.sparkSession
    parts = stretches(docs, benchmark, share)
    kinds = [docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()]
    schema = f"row long, doc_id {kinds[0]}, item_id {kinds[1]}, start long, words long, distance long"
    out = None
    for ids, texts in _blocks(benchmark, block):
        shared = spark.sparkContext.broadcast((ids, texts))

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items(*shared.value, share)
            for batch in batches:
                for a, b, data, offsets in text_slices(batch.column("words")):
                    got = items.matches(np.frombuffer(data.tobytes(), _U), offsets // 8)
                    got = [(d, one, s, n, k) for d, i, s, n, k in got for one in items.ids[i]]
                    if got:
                        d, i, s, n, k = zip(*got)
                        of = pa.array([x + a for x in d])
                        first = batch.column("start").take(of).to_numpy() + np.array(s)
                        yield pa.RecordBatch.from_arrays([batch.column("row").take(of), batch.column("doc_id").take(of), pa.array(i), pa.array(first), pa.array(n, pa.int64()), pa.array(k, pa.int64())], ["row", "doc_id", "item_id", "start", "words", "distance"])

        found = staged(parts.mapInArrow(tidy(find), schema), "matches")
        shared.destroy()
        out = found if out is None else out.unionByName(found)
    release(parts)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, block: int = 5000) -> DataFrame:
    """doc_id, item_id, start and words of the closest stretch (in words), distance (in word edits)."""
    best = _found(docs, benchmark, share, block).groupBy("row", "doc_id", "item_id").agg(F.min(F.struct("distance", "start", "words")).alias("x"))
    return best.select("doc_id", "item_id", "x.start", "x.words", "x.distance")


def _blocks(benchmark: DataFrame, block: int) -> Iterator[tuple[list, list]]:
    """`block` items at a time, one block at least."""
    rows = benchmark.select("item_id", "text").where("text is not null").toLocalIterator()
    first = True
    while True:
        part = list(islice(rows, block))
        if not part and not first:
            return
        first = False
        yield [r["item_id"] for r in part], [r["text"] for r in part]


def decontaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, block: int = 5000) -> DataFrame:
    """`docs` without those whose text any item contaminates."""
    name = F.unhex(F.substring(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256), 1, 32))
    texts = docs.select(name.alias("doc_id"), "text")
    bad = _found(texts, benchmark, share, block).select(F.col("doc_id").alias("_text")).distinct()
    bad = staged(bad, "contaminated")
    return docs.join(bad, name == bad["_text"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: all documents against all items."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
