"""Token ids of whole texts, word by word: a word's ids come from the tokenizer once and are kept."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from tessella.llm.memo import lease
from tessella.llm.tokens import BLOCK, LONG, block_starts, pieces

#: Words, and ids, kept per Python worker; places for words of up to SHORT bytes.
KEPT, KEPT_IDS, PLACES, SHORT = 900_000, 1 << 23, 1 << 21, 15
#: A space in byte-level vocabularies.
SPACED = "Ġ"
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class WordNumbers:
    """Numbers of short words, for many words at once. A word of up to 15 bytes is two 64-bit numbers, its bytes and its
    length, so it is compared as a whole; its place is looked for from a hash on."""

    def __init__(self, places: int = PLACES):
        self.bits, self.held = places.bit_length() - 1, 0
        self.low, self.high = np.zeros(places, np.uint64), np.zeros(places, np.uint64)
        self.number = np.full(places, -1, np.int32)

    def _hash(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mixed = (low ^ (high * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The words' numbers, -1 for new ones."""
        at = self._hash(low, high)
        out = self.number[at]
        left = np.flatnonzero((out >= 0) & ((self.low[at] != low) | (self.high[at] != high)))
        at = at[left]
        while len(left):
            at = (at + 1) & (len(self.number) - 1)
            out[left] = number = self.number[at]
            more = (number >= 0) & ((self.low[at] != low[left]) | (self.high[at] != high[left]))
            left, at = left[more], at[more]
        return out

    def add(self, low: np.ndarray, high: np.ndarray, number: np.ndarray) -> None:
        """Adds different words that are new. The places are doubled before three quarters of them are taken."""
        if 4 * (self.held + len(low)) > 3 * len(self.number):
            own, low_, high_ = self.number >= 0, self.low, self.high
            kept = self.number[own]
            places = len(self.number)
            while 4 * (len(kept) + len(low)) > 3 * places:
                places *= 2
            self.__init__(places)
            self.add(low_[own], high_[own], kept)
        self.held += len(low)
        at, left = self._hash(low, high), np.arange(len(low))
        while len(left):
            free = self.number[at] < 0
            self.number[at[free]] = number[left[free]]  # of several at one place, the last one stays
            won = self.number[at] == number[left]
            self.low[at[won]], self.high[at[won]] = low[left[won]], high[left[won]]
            left, at = left[~won], (at[~won] + 1) & (len(self.number) - 1)


class Encoder:
    """ids(texts) gives each text's ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        vocab = self.tokenizer.get_vocab()
        #: Of every id, whether its token begins with a space.
        self.spaced = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.spaced[[i for t, i in vocab.items() if t.startswith(SPACED) and t not in self.special]] = True
        self._reset()

    def _reset(self) -> None:
        """Forgets all words; 0 is the empty one."""
        self.short, self.longer = WordNumbers(), {}
        #: The ids of all words in a row, and where each word's ids begin and end.
        self.told, self.ends, self.words = np.zeros(1 << 16, "<u4"), np.zeros(1 << 16, np.int64), 1

    def ids(self, texts: list[str]) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in texts]
        block: list[tuple[int, str]] = []
        size = 0
        for i, text in enumerate(texts):
            if any(s in text for s in self.special):
                # special strings take the library's own path
                out[i].append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
                continue
            for piece in pieces(text):
                block.append((i, piece))
                size += len(piece)
                if size >= BLOCK:
                    self._flush(block, out)
                    block, size = [], 0
        self._flush(block, out)
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def _flush(self, block: list[tuple[int, str]], out: list[list[bytes]]) -> None:
        if not block:
            return
        if self.words > KEPT or self.ends[self.words - 1] > KEPT_IDS:
            self._reset()
        numbers, first, kept = self._numbers([t for _, t in block])
        begin = self.ends[np.maximum(numbers - 1, 0)]
        n = self.ends[numbers] - begin
        to = np.concatenate([[0], np.cumsum(n)])
        raw = self.told[np.arange(to[-1]) + np.repeat(begin - to[:-1], n)].tobytes()
        at = (4 * to[first]).tolist()
        for (i, _), a, b in zip(block, at, at[1:], strict=False):
            out[i].append(raw[a:b])
        self.words = kept

    def _numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
        """The number of each word, where each text begins among them, and how many words are kept from now on: the
        numbers from there on are those of very long words."""
        joined, points, starts, first = block_starts(texts)
        width = np.ones(len(points) + 1, np.int64)
        width[0] = 0
        for least in (0x80, 0x800, 0x10000):
            width[1:] += points >= least
        edges = np.cumsum(width)[starts]
        size = np.diff(edges)
        size[first[:-1]] = 0  # the separators
        raw = np.frombuffer(joined.encode() + bytes(16), np.uint8)
        eight = np.lib.stride_tricks.as_strided(raw[:8].view(np.uint64), (len(raw) - 7,), (1,), writeable=False)
        numbers = np.zeros(len(size), np.int64)
        own = np.flatnonzero((size > 0) & (size <= SHORT))
        at, long = edges[own], size[own]
        low = eight[at] & _MASKS[np.minimum(long, 8)]
        high = eight[at + 8] & _MASKS[np.maximum(long - 8, 0)] | long.astype(np.uint64) << np.uint64(56)
        numbers[own] = self.short.find(low, high)
        new = np.flatnonzero(numbers[own] < 0)
        if len(new):
            order = new[np.lexsort((high[new], low[new]))]
            head = np.ones(len(order), bool)
            head[1:] = (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])
            once = order[head]
            told = self._learn([joined[a:b] for a, b in zip(starts[own[once]].tolist(), starts[own[once] + 1].tolist(), strict=True)])
            self.short.add(low[once], high[once], told)
            numbers[own[order]] = told[np.cumsum(head) - 1]
        others, kept = np.flatnonzero(size > SHORT), self.words
        if len(others):
            words = [joined[a:b] for a, b in zip(starts[others].tolist(), starts[others + 1].tolist(), strict=True)]
            fresh = {w for w in words if w not in self.longer}
            keep, once = [w for w in fresh if len(w) <= LONG], [w for w in fresh if len(w) > LONG]
            self.longer.update(zip(keep, self._learn(keep).tolist(), strict=True))
            kept = self.words
            seen = self.longer | dict(zip(once, self._learn(once).tolist(), strict=True)) if once else self.longer
            numbers[others] = list(map(seen.__getitem__, words))
        return numbers, first, kept

    def _learn(self, new: list[str]) -> np.ndarray:
        """Numbers of new words. Those of a space and something else stay words when they are put one behind the other,
        so one call encodes them all, and a word begins at each token that begins with a space; the few others are
        encoded one by one."""
        joint = [len(w) > 1 and w[0] == " " and not w[1].isspace() for w in new]
        lists: list[np.ndarray] = []
        order = np.flatnonzero(joint).tolist()
        sizes = np.zeros(0, np.int64)
        if order:
            told = np.array(self.tokenizer.encode_batch_fast(["".join([new[i] for i in order])], add_special_tokens=False)[0].ids, "<u4")
            begins = np.flatnonzero(self.spaced[told])
            if len(begins) == len(order) and begins[0] == 0:
                lists, sizes = [told], np.diff(begins, append=len(told))
            else:
                order = []
        rest = sorted(set(range(len(new))).difference(order))
        one = [e.ids for e in self.tokenizer.encode_batch_fast([new[i] for i in rest], add_special_tokens=False)]
        lists += [np.array(x, "<u4") for x in one]
        numbers = np.empty(len(new), np.int64)
        numbers[order + rest] = self.words + np.arange(len(new))
        ends = self.ends[self.words - 1] + np.cumsum(np.concatenate([sizes, np.array([len(x) for x in one], np.int64)]))
        ids = np.concatenate([np.zeros(0, "<u4"), *lists])
        self.told = _put(self.told, int(self.ends[self.words - 1]), ids)
        self.ends = _put(self.ends, self.words, ends)
        self.words += len(new)
        return numbers


def _put(into: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
    """Writes values at a place of an array, which grows by half at least when it is too small."""
    if at + len(values) > len(into):
        into = np.concatenate([into[:at], np.zeros(max(len(values), len(into) // 2 + 1), into.dtype)])
    into[at : at + len(values)] = values
    return into


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker."""
    lease("encoder", _encoder.cache_clear)
    return _encoder(path)
