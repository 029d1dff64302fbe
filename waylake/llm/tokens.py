"""Fast exact encoding with a word-level BPE of the tokenizers library.

The library's pre-tokenizer cuts a text into letter runs, single digits and runs of other signs, and
encodes each of these words alone. So a batch is cut into words with array operations, every word
that this worker has not met is encoded once by the library, and ids are gathered from a cache. Texts
with characters outside the plain set below (where lower-casing, composition and classes are trivial)
go to the library as they are.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash

_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_P_INVERSE = pow(_P, -1, 1 << 64)
#: ASCII but for the apostrophe (contractions), and accented letters that have simple lower case.
_LETTERS = [*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]
_SPACE = [9, 10, 13, 32]
_DIGITS = [*range(48, 58)]
_OTHER = [c for c in range(33, 127) if c not in _LETTERS and c not in _DIGITS and c != 39]
_LOWER = bytes(c + 32 if 65 <= c <= 90 or (0xC0 <= c <= 0xDE and c != 0xD7) else c for c in range(256))
_PLAIN = bytes(_LETTERS + _SPACE + _DIGITS + _OTHER)


class Pool:
    """Id sequences of segments by 64-bit key, in one growing array; ``extra`` runs in parallel."""

    def __init__(self, limit: int = 1_000_000):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.slot: dict[int, int] = {}
        self.off = np.zeros(1024, np.int64)
        self.len = np.zeros(1024, np.int64)
        self.ids = np.zeros(4096, np.int32)
        self.extra = np.zeros(4096, np.int32)
        self.used = 0

    def add(self, keys: list[int], ids: list[Sequence[int]], extra: list[Sequence[int]] | None = None) -> None:
        n, at = len(keys), len(self.slot)
        lens = np.fromiter(map(len, ids), np.int64, n)
        total = int(lens.sum())
        while at + n > len(self.off):
            self.off = np.r_[self.off, np.zeros_like(self.off)]
            self.len = np.r_[self.len, np.zeros_like(self.len)]
        while self.used + total > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros_like(self.ids)]
            self.extra = np.r_[self.extra, np.zeros_like(self.extra)]
        self.off[at : at + n] = self.used + np.cumsum(lens) - lens
        self.len[at : at + n] = lens
        self.ids[self.used : self.used + total] = np.fromiter((i for x in ids for i in x), np.int32, total)
        if extra is not None:
            self.extra[self.used : self.used + total] = np.fromiter((i for x in extra for i in x), np.int32, total)
        self.used += total
        self.slot.update(zip(keys, range(at, at + n)))

    def gather(self, slots: np.ndarray, what: np.ndarray) -> np.ndarray:
        lens = self.len[slots]
        ends = np.cumsum(lens)
        return what[np.repeat(self.off[slots] - (ends - lens), lens) + np.arange(int(ends[-1]) if len(ends) else 0)]


class SegmentHash:
    """64-bit hashes of byte ranges of a buffer, from prefix sums; of long ranges, which can be built to collide, by xxHash."""

    LONG = 256

    def __init__(self, seed: int = 1):
        self.table = np.random.default_rng(seed).integers(1, _MASK, 256, np.uint64, endpoint=True)
        self.pow = self.inv = np.ones(1, np.uint64)

    def __call__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(buf) >= len(self.pow):
            n = max(len(buf) + 1, 1 << 20)
            self.pow = np.cumprod(np.r_[np.uint64(1), np.full(n, _P, np.uint64)])
            self.inv = np.cumprod(np.r_[np.uint64(1), np.full(n, _P_INVERSE, np.uint64)])
        sums = np.empty(len(buf) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(self.table[buf] * self.pow[: len(buf)], out=sums[1:])
        found = (sums[ends] - sums[starts]) * self.inv[starts]
        for i in np.flatnonzero(ends - starts > self.LONG).tolist():
            found[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : ends[i]])
        return found


def groups_by_size(sizes: Sequence[int], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose sizes add up to at most ``most`` (one item at least)."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


class WordBpe:
    """Encodes texts exactly as the library's encode(text, add_special_tokens=False) does."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.is_end = np.zeros(max(vocab.values()) + 1, bool)
        self.is_end[[i for piece, i in vocab.items() if piece.endswith("</w>")]] = True
        self.classes = np.zeros(256, np.uint8)
        self.classes[_LETTERS], self.classes[_DIGITS], self.classes[_OTHER] = 1, 2, 3
        self.hash, self.pool = SegmentHash(), Pool()

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        plain: list[int] = []
        coded: list[bytes] = []
        for i, t in enumerate(texts):
            if not t:
                out[i] = np.zeros(0, np.int32)
                continue
            try:
                b = t.encode("latin-1")
            except UnicodeEncodeError:
                b = None
            if b is not None and b"<|" not in b and not b.translate(None, _PLAIN):
                plain.append(i)
                coded.append(b)
            else:
                out[i] = np.array(self.library.encode(t, add_special_tokens=False).ids, np.int32)
        for s, e in groups_by_size([len(b) for b in coded]):
            for i, ids in zip(plain[s:e], self._plain(coded[s:e])):
                out[i] = ids
        return out  # type: ignore[return-value]

    def _plain(self, texts: list[bytes]) -> list[np.ndarray]:
        raw = b" ".join(texts).translate(_LOWER)
        buf = np.frombuffer(raw, np.uint8)
        cls = self.classes[buf]
        change = np.r_[True, (cls[1:] != cls[:-1]) | (cls[1:] == 2), True]
        word = cls != 0
        starts = np.flatnonzero(change[:-1] & word)
        ends = np.flatnonzero(change[1:] & word) + 1
        bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
        if not len(starts):
            return [np.zeros(0, np.int32) for _ in texts]
        codes, keys = pd.factorize(self.hash(buf, starts, ends))
        slots = self._slots(keys, codes, raw, starts, ends)[codes]
        ids = self.pool.gather(slots, self.pool.ids)
        cut = np.r_[0, np.cumsum(self.pool.len[slots])][np.searchsorted(starts, bounds)]
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:])]

    def _slots(self, keys: np.ndarray, codes: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        pool, known = self.pool, keys.tolist()
        if len(pool.slot) > pool.limit:
            pool.clear()
        new = [j for j, k in enumerate(known) if k not in pool.slot]
        if new:
            first = np.empty(len(known), np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            at = first[new]
            words = [raw[s:e].decode("latin-1") for s, e in zip(starts[at].tolist(), ends[at].tolist())]
            pool.add([known[j] for j in new], self._words(words))
        get = pool.slot.get
        return np.fromiter((get(k) for k in known), np.int64, len(known))

    def _words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word: words are encoded joined by spaces and cut at the pieces that end words."""
        out: list[np.ndarray] = []
        chunks = [words[i : i + 500] for i in range(0, len(words), 500)]
        encoded = self.library.encode_batch_fast([" ".join(c) for c in chunks], add_special_tokens=False)
        for chunk, e in zip(chunks, encoded):
            ids = np.array(e.ids, np.int32)
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) == len(chunk) and len(ids) == ends[-1]:
                out += np.split(ids, ends[:-1])
            else:
                out += [np.array(self.library.encode(w, add_special_tokens=False).ids, np.int32) for w in chunk]
        return out


_loaded: dict[str, object] = {}


def loaded(kind, content):
    """``kind(content)``, made once in each worker."""
    key = kind.__name__ + hashlib.md5(content if isinstance(content, bytes) else content.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = kind(content)
    return _loaded[key]


def read_model(path: str) -> bytes:
    """A tokenizer file of a few MB, read by the driver and sent to the workers."""
    with open(path, "rb") as f:
        return f.read()
