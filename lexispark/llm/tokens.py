"""Token ids of whole texts, as the `tokenizers` library gives them, from a byte-level BPE file, and fast.

Whole texts are cut into the tokenizer's words with byte operations over many documents at once; every distinct word, by
its bytes, is encoded once a worker, and ids are gathered by word. Texts with characters or contractions that the byte rules don't
cover go through the library itself, so the ids are the library's in every case (the tests compare them).
"""

from __future__ import annotations

import json
import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from lexispark.llm.common import ragged, text_slices

#: Of a byte: 0 letter, 1 number, 2 white space, 3 other, 4 not covered here.
_LETTER, _NUMBER, _SPACE, _OTHER, _BEYOND = range(5)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Bytes of ASCII and of U+00C0 to U+024F, which are all letters but for two signs (handled by `_beyond`)."""
    c = np.full(256, _BEYOND, np.uint8)
    c[:0x80] = _OTHER
    c[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = _LETTER
    c[0x30:0x3A] = _NUMBER
    c[[0x20, *range(0x09, 0x0E)]] = _SPACE
    c[[ord("'"), *range(0x1C, 0x20)]] = _BEYOND
    return c


def _beyond(data: np.ndarray, kind: np.ndarray) -> np.ndarray:
    bad = kind == _BEYOND
    sign = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.zeros(0, np.int64)
    bad[sign] |= (data[sign + 1] == 0x97) | (data[sign + 1] == 0xB7)
    return bad


class BPE:
    """A byte-level BPE tokenizer file with the usual pre-tokenizer; `encode` takes many texts at once."""

    #: Words whose ids a worker keeps; beyond that it starts anew.
    KEEP = 1 << 17

    def __init__(self, path: str):
        self.path = path
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        # the usual byte alphabet: printable bytes stand for themselves, the others follow from U+0100
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(plain)]
        of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        special = {t["content"] for t in model.get("added_tokens", [])}
        ranks = {bytes(of[c] for c in w): i for w, i in model["model"]["vocab"].items() if w not in special}
        self._one = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self._library = None
        self._fresh()

    def _fresh(self) -> None:
        self.at: dict[bytes, int] = {}
        self.first, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def by_library(self, text: str) -> np.ndarray:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._library.encode_special_tokens = True  # a text that holds their strings is ordinary text
        return np.array(self._library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _entries(self, words: list[bytes]) -> np.ndarray:
        """Where the ids of each word are, among those encoded so far."""
        if len(self.at) > self.KEEP:
            self._fresh()
        new = [w for w in words if w not in self.at]
        if new:
            made = [self._one(w) for w in new]
            size = np.fromiter(map(len, made), np.int64, len(made))
            ids = np.fromiter(chain.from_iterable(made), np.uint32, int(size.sum()))
            self.at.update(zip(new, range(len(self.first), len(self.first) + len(new))))
            first = len(self.ids) + np.cumsum(size) - size
            self.first, self.size, self.ids = np.concatenate([self.first, first]), np.concatenate([self.size, size]), np.concatenate([self.ids, ids])
        return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))

    def _starts(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Where the tokenizer's words start: at a change of class, but one space belongs to what follows it, and so
        white space before something gives up its last character."""
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        at = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        after_space = kind[at - 1] == _SPACE
        start = edge[:-1].copy()
        start[at[~after_space]] = True
        at = at[after_space]
        at = at[~edge[at]]
        start[at - 1] = True
        start[at[data[at - 1] != 0x20]] = True
        return np.flatnonzero(start)

    def encode_slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents one after another, number of ids of each)."""
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        kind = _classes()[data]
        first = self._starts(data, offsets, kind)
        spans = pa.py_buffer(np.append(first, len(data)).astype(np.int32))
        words = pa.Array.from_buffers(pa.binary(), len(first), [None, spans, pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        entry = self._entries(words.dictionary.to_pylist())[words.indices.to_numpy(zero_copy_only=False)]
        size = self.size[entry]
        ids = self.ids[ragged(self.first[entry], size)]
        upto = np.concatenate([[0], np.cumsum(size)])
        counts = np.diff(upto[np.searchsorted(first, offsets)])
        hard = np.flatnonzero(_beyond(data, kind))
        if len(hard):
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for d in np.unique(np.searchsorted(offsets, hard, "right") - 1):
                parts[d] = self.by_library(data[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8"))
                counts[d] = len(parts[d])
            ids = np.concatenate(parts)
        return ids, counts

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        out: list[list[int]] = []
        for _, _, data, offsets in text_slices(pa.array(texts, pa.string())):
            ids, counts = self.encode_slice(data, offsets)
            out += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        return out


@lru_cache(maxsize=2)
def bpe(path: str) -> BPE:
    """One a worker and file."""
    return BPE(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
