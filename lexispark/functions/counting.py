"""Terms of documents counted in Arrow batches: each document by itself, then the batch's postings by term."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from lexispark.functions.stemmer import stem as stemmed
from lexispark.functions.text import TOKEN

#: Tokens are ASCII, so bytes are looked through: lowering them turns no other letter into an ASCII one.
_TOKEN = re.compile(TOKEN.encode())
#: Postings of a block table, and stems that a worker remembers.
POSTINGS, STEMS = 500_000, 200_000


def _stems(found: Counter, known: dict[bytes, bytes]) -> Counter:
    out: Counter = Counter()
    for term, n in found.items():
        to = known.get(term)
        if to is None:
            if len(known) >= STEMS:
                known.clear()
            to = known[term] = stemmed(term.decode()).encode()
        out[to] += n
    return out


def counter(stem: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From batches of doc_id and text to term, doc_ids, tfs."""

    def blocks(terms: list[bytes], tfs: list[int], ids: list[pa.Array]) -> list[pa.RecordBatch]:
        flat = pa.table([pa.array(terms, pa.binary()), pa.chunked_array(ids), pa.array(tfs, pa.int64())], ["term", "doc_ids", "tfs"])
        by_term = flat.group_by("term", use_threads=False).aggregate([("doc_ids", "list"), ("tfs", "list")])
        found = pa.table([by_term["term"].cast(pa.string()), by_term["doc_ids_list"], by_term["tfs_list"]], ["term", "doc_ids", "tfs"])
        return found.combine_chunks().to_batches(max_chunksize=50_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = {}
        terms, tfs, ids = [], [], []
        for b in batches:
            sizes = []
            for text in b.column(1).cast(pa.binary()).to_pylist():
                found = Counter(_TOKEN.findall(text.lower())) if text else Counter()
                if stem:
                    found = _stems(found, known)
                terms += found.keys()
                tfs += found.values()
                sizes.append(len(found))
            ids.append(b.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))))
            if len(terms) >= POSTINGS:
                yield from blocks(terms, tfs, ids)
                terms, tfs, ids = [], [], []
        if terms:
            yield from blocks(terms, tfs, ids)

    return count
