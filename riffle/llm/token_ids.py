"""Token ids of whole texts, with bounded caches of words.

For a tokenizer that lower-cases, drops white space and then encodes each pre-token by itself, the ids of a text are
those of its chunks between ASCII white space, and the ids of a chunk those of its pre-tokens, one after another: neither
the normalizer nor a pre-token nor a special token reaches across. Words repeat, so that a table of chunks, and below it
a cache of pre-tokens, save most of the encoding. Chunks of common Latin characters are split here, by the tokenizer's own
pattern; others go to the tokenizer as they are. The tokenizer's file is a parameter.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

#: Words in each of two generations, and chunks in the table, that a worker keeps; the longest chunk that is split here.
WORDS, CHUNKS, LONGEST = 200_000, 1_000_000, 64
#: Bytes of text looked up at a time, and slots of the table (a power of two, twice the chunks at least).
SLAB, SLOT_BITS = 1 << 20, 21
#: Between the ids of chunks while they are joined; no id has these bytes.
BETWEEN = b"\xff\xff\xff\xff"

# The letters and numerals (Unicode categories L and N) among U+0021..U+017F, and the contractions.
LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ſ"
NUMERALS = "0-9²³¹¼-¾"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"

_PRE_TOKENS = re.compile(rf"\n|{CONTRACTIONS}|[{LETTERS}]+|[{NUMERALS}]|[^\s{LETTERS}{NUMERALS}]+")
#: Other characters, for which normal forms, case or white space need the tokenizer; so may its special tokens.
_OTHER = re.compile("[^\t-\r -~¡-įı-ſ]|<\\|")

_CACHES: dict[str, IdCache] = {}


class Generations:
    """A bounded map: when the young generation is full it becomes the old one, from which entries in use come back."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.young: dict = {}
        self.old: dict = {}

    def missing(self, keys: set) -> set:
        """Makes room for `keys` and returns those that are unknown; afterwards `young` lacks only these."""
        absent = keys.difference(self.young)
        if len(self.young) + len(absent) > self.most:
            self.old, self.young = self.young, {}
            absent = keys
        again = [k for k in absent if k in self.old]
        self.young.update(zip(again, map(self.old.__getitem__, again), strict=True))
        return absent.difference(again)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MULTIPLIER, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.ones(1, dtype=np.uint64)
    while len(out) < n:
        out = np.concatenate((out, out * np.uint64(pow(base, len(out), 1 << 64))))
    return out[:n]


class IdCache:
    """Ids, as little-endian unsigned 32-bit bytes, of texts under the tokenizers file at `path`.

    Chunks are looked up all at once: by a 64-bit hash (polynomial over random byte values, then mixed) in an open table of
    arrays, which leads to their bytes and ids in pools. A hit counts only if all bytes are equal; a chunk whose hash leads
    to another's bytes is encoded by itself. When the table is full it starts anew.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words = Generations(WORDS)
        self.values = np.random.default_rng(9).integers(1, 1 << 63, 256, dtype=np.uint64)
        self.powers = _powers(_MULTIPLIER, SLAB + 1)
        self.inverses = _powers(pow(_MULTIPLIER, -1, 1 << 64), SLAB + 1)
        self.keys = np.zeros(1 << SLOT_BITS, dtype=np.uint64)
        self.at = np.zeros(1 << SLOT_BITS, dtype=np.int64)
        self.count = np.zeros(1 << SLOT_BITS, dtype=np.int64)
        self.place = np.zeros(1 << SLOT_BITS, dtype=np.int64)
        self.size = np.zeros(1 << SLOT_BITS, dtype=np.int64)
        self._start_anew()

    def _start_anew(self) -> None:
        self.keys[:] = 0
        self.pool, self.used, self.chunks = np.empty(1 << 20, dtype="<u4"), 0, 0
        self.bytes, self.held = np.zeros(1 << 20, dtype=np.uint8), 0

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new_words(self, words: list[str]) -> None:
        """Encodes pre-tokens together and tells them apart by the ids that end a word."""
        for at in range(0, len(words), 500):
            some = words[at : at + 500]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(some):
                found = self._each(some)
            else:
                raw, stops = ids.tobytes(), (4 * stops).tolist()
                found = map(raw.__getitem__, map(slice, [0, *stops[:-1]], stops))
            self.words.young.update(zip(some, found, strict=True))

    def _new_chunks(self, chunks: list[bytes]) -> list[bytes]:
        texts = [c.decode("utf-8", "replace") for c in chunks]
        odd = [i for i, t in enumerate(texts) if len(chunks[i]) > LONGEST or _OTHER.search(t)]
        out: list[bytes] = [b""] * len(chunks)
        for i, ids in zip(odd, self._each([texts[i] for i in odd]), strict=True):
            out[i] = ids
        other = set(odd)
        rest = [i for i in range(len(chunks)) if i not in other] if odd else range(len(chunks))
        if rest:
            tokens = _PRE_TOKENS.findall("\n".join([texts[i] for i in rest]).lower())
            self._new_words(list(self.words.missing(set(tokens) - {"\n"})))
            self.words.young["\n"] = BETWEEN
            for i, ids in zip(rest, b"".join(map(self.words.young.__getitem__, tokens)).split(BETWEEN), strict=True):
                out[i] = ids
        return out

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot of each hash, and whether it is there; otherwise the slot is the free one where it would go."""
        mask = (1 << SLOT_BITS) - 1
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        open_ = np.flatnonzero((self.keys[slot] != h) & (self.keys[slot] != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & mask
            k = self.keys[slot[open_]]
            open_ = open_[(k != h[open_]) & (k != 0)]
        return slot, self.keys[slot] == h

    def _pooled(self, ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Puts ids into the pool: where they begin there, and how many they are."""
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        counts = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.empty_like(self.pool)))
        self.pool[self.used : self.used + len(flat)] = flat
        places = self.used + np.cumsum(counts) - counts
        self.used += len(flat)
        return places, counts

    def _add(self, h: np.ndarray, chunks: list[bytes], ids: list[bytes]) -> None:
        """Distinct new hashes with their bytes and ids."""
        places, counts = self._pooled(ids)
        flat = np.frombuffer(b"".join(chunks), dtype=np.uint8)
        sizes = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        while self.held + len(flat) > len(self.bytes):
            self.bytes = np.concatenate((self.bytes, np.zeros_like(self.bytes)))
        self.bytes[self.held : self.held + len(flat)] = flat
        held = self.held + np.cumsum(sizes) - sizes
        self.held += len(flat)
        self.chunks += len(h)
        left = np.arange(len(h))
        while len(left):
            slot, _ = self._find(h[left])
            slots, first = np.unique(slot, return_index=True)
            won = left[first]
            self.keys[slots], self.at[slots], self.count[slots] = h[won], places[won], counts[won]
            self.place[slots], self.size[slots] = held[won], sizes[won]
            left = np.setdiff1d(left, won, assume_unique=True)

    def _others(self, letters: np.ndarray, sizes: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Chunks (their bytes one after another in `letters`) whose slot holds other bytes than theirs."""
        if not len(sizes):
            return np.zeros(0, dtype=np.int64)
        ends = np.cumsum(sizes)
        at = np.repeat(self.place[slot] - (ends - sizes), sizes) + np.arange(len(letters))
        wrong = np.add.reduceat(self.bytes[np.minimum(at, len(self.bytes) - 1)] != letters, ends - sizes, dtype=np.int64)
        return np.flatnonzero((wrong > 0) | (self.size[slot] != sizes))

    def _slab(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts of SLAB bytes in all, their separators included."""
        raw = b" ".join(texts) + b" "
        a = np.frombuffer(raw, dtype=np.uint8)
        space = _SPACE[a]
        before = np.concatenate(([True], space[:-1]))
        starts, stops = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.values[a] * self.powers[: len(a)], dtype=np.uint64)))
        h = (sums[stops] - sums[starts]) * self.inverses[starts]
        h ^= (stops - starts).astype(np.uint64) * np.uint64(_MULTIPLIER)
        h = (h ^ (h >> np.uint64(32))) * _MIX
        h = (h ^ (h >> np.uint64(29))) * _MIX
        h[h == 0] = 1
        slot, known = self._find(h)
        if not known.all():
            new, first = np.unique(h[~known], return_index=True)
            if self.chunks + len(new) > CHUNKS:
                self._start_anew()
                new, first = np.unique(h, return_index=True)
                where = first
            else:
                where = np.flatnonzero(~known)[first]
            chunks = [raw[i:j] for i, j in zip(starts[where].tolist(), stops[where].tolist(), strict=True)]
            self._add(new, chunks, self._new_chunks(chunks))
            slot, _ = self._find(h)
        at, counts = self.at[slot], self.count[slot]
        other = self._others(a[~space], stops - starts, slot)
        if len(other):  # two chunks of one hash: all but the first go without the table
            chunks = [raw[i:j] for i, j in zip(starts[other].tolist(), stops[other].tolist(), strict=True)]
            each = {c: i for i, c in enumerate(dict.fromkeys(chunks))}
            places, numbers = self._pooled(self._new_chunks(list(each)))
            of = np.array([each[c] for c in chunks])
            at[other], counts[other] = places[of], numbers[of]
        ends = np.cumsum(counts)
        ids = self.pool[np.repeat(at - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        cuts = 4 * np.concatenate(([0], ends))[np.searchsorted(starts, bounds)]
        return [ids[i:j] for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def _long(self, text: bytes) -> bytes:
        """Ids of a text longer than a slab, by runs of its chunks; a chunk that is too long itself goes to the tokenizer."""
        out, some, size = [], [], 0
        for c in text.split():
            if len(c) > SLAB // 8 or size + len(c) + 1 > SLAB:
                out.append(self._slab([b" ".join(some)])[0])
                some, size = [], 0
            if len(c) > SLAB // 8:
                out += self._each([c.decode("utf-8", "replace")])
            else:
                some.append(c)
                size += len(c) + 1
        return b"".join([*out, self._slab([b" ".join(some)])[0]])

    def ids(self, texts: list[bytes]) -> list[bytes]:
        out, some, size = [], [], 0
        for t in texts:
            if some and size + len(t) + 1 > SLAB:
                out += self._slab(some)
                some, size = [], 0
            if len(t) >= SLAB:
                out += [*(self._slab(some) if some else []), self._long(t)]
                some, size = [], 0
            else:
                some.append(t)
                size += len(t) + 1
        return out + (self._slab(some) if some else [])


def cache_for(path: str) -> IdCache:
    """One cache for each worker process and file."""
    if path not in _CACHES:
        _CACHES[path] = IdCache(path)
    return _CACHES[path]
