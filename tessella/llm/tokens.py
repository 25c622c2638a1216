"""Token counts by a compiled finite-state transducer (operator 1).

Two deterministic transducers are composed.

* The first cuts a text into words, as the byte-level pattern of the tokenizer does. It works on character
  classes; a transition says whether a word begins at the character just read, or at the one before it.
  A batch of texts is laid out in chunks. The map of a chunk takes each state it may be entered in to the
  state it is left in; a parallel prefix scan composes the maps, which gives every chunk its entry state.
* The second reads a word byte by byte. Its state is the last token of the encoding of each prefix that
  a further token could start from, so the pair-merge encoding, which isn't left to right, becomes one
  deterministic step per byte. A transition carries the number of tokens it adds (0, or less, when a token
  grows out of others). Its states are made when first reached and kept up to a bound, like the lazy
  automata of regular-expression engines.

Why a state of last tokens is enough: an encoding is valid if and only if every two neighbouring tokens,
merged on their own, give these two tokens again; so a prefix's last token is the one that ends there and
fits the last token in front of it.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tessella.llm.memo import lease

#: Character classes and states of the word cutter.
SEP, LETTER, NUMBER, OTHER, SPACE, WHITE, APOS, C_STMD, C_R, C_V, C_L, C_E = range(12)
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, SPACE_1, WHITE_1, SPACE_N, WHITE_N, AT_APOS, APOS_R, APOS_V, APOS_L, CONTRACTED = range(13)
N_STATES, N_CLASSES = 13, 12
_LETTERS = {LETTER, C_STMD, C_R, C_V, C_L, C_E}
#: Characters per chunk; characters handled at once; words and states kept per Python worker.
CHUNK, BLOCK, KEPT_WORDS, KEPT_STATES = 512, 1 << 20, 400_000, 300_000
#: Longer words are not kept.
LONG = 256


def _open(c: int) -> int:
    if c in _LETTERS:
        return IN_LETTERS
    return {NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, APOS: AT_APOS, SPACE: SPACE_1, WHITE: WHITE_1, SEP: START}[c]


def _step(state: int, c: int) -> tuple[int, bool, bool]:
    """(next state, a word begins at this character, a word begins at the character before)."""
    late = False
    if state in (APOS_R, APOS_V, APOS_L):
        if c == (C_L if state == APOS_L else C_E):
            return CONTRACTED, False, False
        state, late = IN_LETTERS, True
    if c == SEP:
        return START, True, late
    if c in (SPACE, WHITE):
        if state in (SPACE_1, WHITE_1, SPACE_N, WHITE_N):
            return (SPACE_N if c == SPACE else WHITE_N), False, late
        return _open(c), True, late
    if state in (SPACE_1, SPACE_N):
        return (IN_OTHERS if c == APOS else _open(c)), False, state == SPACE_N
    if state in (WHITE_1, WHITE_N):
        return _open(c), True, state == WHITE_N
    if state == AT_APOS:
        follow = {C_STMD: CONTRACTED, C_R: APOS_R, C_V: APOS_V, C_L: APOS_L, OTHER: IN_OTHERS, APOS: IN_OTHERS}
        return (follow[c], False, late) if c in follow else (_open(c), True, late)
    same = {IN_LETTERS: _LETTERS, IN_NUMBERS: {NUMBER}, IN_OTHERS: {OTHER, APOS}}.get(state, set())
    if c in same:
        return state, False, late
    return _open(c), True, late


@lru_cache(1)
def _cutter() -> tuple[np.ndarray, np.ndarray]:
    """Transition table (state * classes + class) -> state, and -> outputs (1: here, 2: one before)."""
    nxt, out = np.zeros(N_STATES * N_CLASSES, np.uint8), np.zeros(N_STATES * N_CLASSES, np.uint8)
    for s in range(N_STATES):
        for c in range(N_CLASSES):
            to, here, before = _step(s, c)
            nxt[s * N_CLASSES + c], out[s * N_CLASSES + c] = to, here + 2 * before
    return nxt, out


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of every code point."""
    # White space as the tokenizer's pattern has it.
    white = [0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    table = np.full(0x110000, OTHER, np.uint8)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))[0]
        if kind == "L":
            table[i] = LETTER
        elif kind == "N":
            table[i] = NUMBER
    table[white] = WHITE
    for text, c in ((" ", SPACE), ("'", APOS), ("stmd", C_STMD), ("r", C_R), ("v", C_V), ("l", C_L), ("e", C_E)):
        table[[ord(x) for x in text]] = c
    return table


def compose_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps (n, states): row i takes a state through maps 0..i.

    Doubling: after k rounds a row stands for the last 2^k maps, so log2(n) rounds are enough.
    """
    out, gap = maps.copy(), 1
    while gap < len(out):
        out[gap:] = np.take_along_axis(out[gap:], out[:-gap].astype(np.intp), axis=1)
        gap *= 2
    return out


def cut_words(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """For a run of classes that starts with SEP: True where a word begins (and at every SEP)."""
    nxt, out = _cutter()
    n = len(classes)
    rows = -(-n // chunk)
    grid = np.full(rows * chunk, SEP, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(rows, chunk).T)
    maps = np.tile(np.arange(N_STATES, dtype=np.uint8)[:, None], (1, rows))
    apart = np.arange(rows)  # chunks whose state still depends on the one they are entered in
    one = np.zeros(rows, np.uint8)
    for step in range(chunk):
        if len(apart):
            maps[:, apart] = nxt[maps[:, apart].astype(np.intp) * N_CLASSES + grid[step, apart]]
            met = (maps[:, apart] == maps[:1, apart]).all(axis=0)
            one[apart] = maps[0, apart]
            together = apart[met]
            apart = apart[~met]
            if step == 0:
                done = np.zeros(rows, bool)
            else:
                live = np.flatnonzero(done)
                one[live] = nxt[one[live].astype(np.intp) * N_CLASSES + grid[step, live]]
            done[together] = True
        else:
            one = nxt[one.astype(np.intp) * N_CLASSES + grid[step]]
    same = np.ones(rows, bool)
    same[apart] = False
    maps[:, same] = one[same]
    through = compose_scan(np.ascontiguousarray(maps.T))
    state = np.concatenate([np.zeros(1, np.uint8), through[:-1, START]])
    marks = np.empty((chunk, rows), np.uint8)
    for step in range(chunk):
        at = state.astype(np.intp) * N_CLASSES + grid[step]
        marks[step] = out[at]
        state = nxt[at]
    flat = np.ascontiguousarray(marks.T).reshape(-1)
    begins = (flat & 1).astype(bool)
    begins[:-1] |= (flat[1:] & 2).astype(bool)
    return begins[:n]


def block_starts(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one, its code points, where the words begin in it (a separator before each text and one at the end
    are words), and where each text begins among the words (one more entry than texts)."""
    joined = "\n" + "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    classes = _classes()[points]
    at = np.concatenate([[0], np.cumsum(np.fromiter((len(t) for t in texts), np.int64, len(texts)) + 1)])
    classes[at] = SEP
    starts = np.flatnonzero(cut_words(classes))
    return joined, points, starts, np.searchsorted(starts, at)


def block_words(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The words of all texts in one list, and where each text begins in it (one more entry than texts)."""
    joined, _, starts, first = block_starts(texts)
    edges = starts.tolist()
    words = [joined[a:b] for a, b in zip(edges, edges[1:], strict=False)]
    for i in first[:-1].tolist():
        words[i] = ""  # the separators
    return words, first


class WordTransducer:
    """Counts the tokens of a word's bytes, one transition per byte."""

    def __init__(self, tokens: dict[bytes, int], merges: dict[tuple[int, int], tuple[int, int]], kept: int = KEPT_STATES):
        self.tokens, self.merges, self.kept = tokens, merges, kept
        self.prefixes = {t[:i] for t in tokens for i in range(1, len(t) + 1)}
        self.text = {i: t for t, i in tokens.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.keys: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: list[dict[int, tuple[int, int]]] = []
        self._state(b"", (-1,), (0,))

    def _state(self, tail: bytes, last: tuple, counts: tuple) -> int:
        key = (tail, last, counts)
        if (found := self.keys.get(key)) is None:
            found = self.keys[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        return found

    def merge(self, word: bytes) -> list[int]:
        """The encoding by pair merges, lowest rank first (the definition, for short inputs)."""
        ids = [self.tokens[word[i : i + 1]] for i in range(len(word))]
        while len(ids) > 1:
            best = min(((self.merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.merges), default=None)
            if best is None:
                break
            pair = (ids[best[1]], ids[best[1] + 1])
            new, i, rest = self.merges[pair][1], 0, []
            while i < len(ids):
                if i + 1 < len(ids) and (ids[i], ids[i + 1]) == pair:
                    rest.append(new)
                    i += 2
                else:
                    rest.append(ids[i])
                    i += 1
            ids = rest
        return ids

    def fit(self, a: int, b: int) -> bool:
        """Whether token b can stand right behind token a (-1: the word's start)."""
        if (known := self.fits.get((a, b))) is None:
            want = [b] if a < 0 else [a, b]
            known = self.fits[a, b] = self.merge(b"".join(self.text[x] for x in want)) == want
        return known

    def move(self, state: int, byte: int) -> tuple[int, int]:
        """Makes a transition: (next state, tokens added)."""
        tail, last, counts = self.states[state]
        grown = tail + bytes((byte,))
        for j in range(len(grown)):
            token = self.tokens.get(grown[j:])
            if token is not None and last[j] is not None and self.fit(last[j], token):
                added = counts[j] + 1
                break
        else:
            raise ValueError("the vocabulary lacks single bytes")
        k = 0
        while k < len(grown) and grown[k:] not in self.prefixes:
            k += 1
        ends, sums = [*last[k:], token], [*counts[k:], added]
        # only the starts of what can still grow into a token matter
        keep = [i == len(grown) - k or grown[k + i :] in self.prefixes for i in range(len(ends))]
        new = self._state(grown[k:], tuple(e if w else None for e, w in zip(ends, keep, strict=True)), tuple(s - added if w else 0 for s, w in zip(sums, keep, strict=True)))
        self.moves[state][byte] = new, added
        return new, added

    def count(self, word: bytes) -> int:
        """Tokens of a word."""
        if len(self.states) > self.kept:
            self.reset()
        state = total = 0
        moves = self.moves
        for byte in word:
            to = moves[state].get(byte)
            state, added = to if to is not None else self.move(state, byte)
            total += added
        return total


class _Memo(dict):
    """Counts of words met before; starts anew at a bound."""

    def __init__(self, transducer: WordTransducer, kept: int = KEPT_WORDS):
        super().__init__()
        self.transducer, self.kept = transducer, kept

    def __missing__(self, word: str) -> int:
        n = self.transducer.count(word.encode())
        if len(word) <= LONG:
            if len(self) >= self.kept:
                self.clear()
            self[word] = n
        return n


class Counter:
    """A compiled tokenizer that counts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["pre_tokenizer"]["type"] != "ByteLevel" or spec.get("normalizer") or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("only plain byte-level tokenizers can be compiled")
        byte_of = byte_alphabet()
        raw = lambda t: bytes(byte_of[x] for x in t)
        special = {t["content"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            merges[vocab[a], vocab[b]] = rank, vocab[a + b]
        self.transducer = WordTransducer({raw(t): i for t, i in vocab.items()}, merges)
        self.memo = _Memo(self.transducer)
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        total = np.zeros(len(texts), np.int64)
        block, size = [], 0
        for i, text in enumerate(texts):
            if self.special and "<" in text and (found := len(self.special.findall(text))):
                total[i] += found
                parts = self.special.split(text)
            else:
                parts = [text]
            for part in parts:
                for piece in pieces(part):
                    block.append((i, piece))
                    size += len(piece)
                    if size >= BLOCK:
                        self._add(block, total)
                        block, size = [], 0
        if block:
            self._add(block, total)
        return total

    def _add(self, block: list[tuple[int, str]], total: np.ndarray) -> None:
        words, first = block_words([t for _, t in block])
        found = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        sums = np.concatenate([[0], np.cumsum(found)])
        np.add.at(total, [i for i, _ in block], sums[first[1:]] - sums[first[:-1]])


def pieces(text: str, size: int = BLOCK) -> Iterator[str]:
    """Cuts a very long text where white space follows something else: there a word begins in every state."""
    begin = 0
    while len(text) - begin > size:
        found = None
        for found in re.finditer(r"(?<=\S)[ \n\t\r]", text[begin + size // 2 : begin + size]):  # noqa: B007
            pass
        if found is None:
            found = re.compile(r"(?<=\S)[ \n\t\r]").search(text, begin + size)
            if not found:
                break
            stop = found.start()
        else:
            stop = begin + size // 2 + found.start()
        if stop <= begin:
            break
        yield text[begin:stop]
        begin = stop
    yield text[begin:]


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 bytes stand for
    themselves, the others follow from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(1)
def _counter(path: str) -> Counter:
    return Counter(path)


def counter(path: str) -> Counter:
    """The compiled tokenizer of this Python worker."""
    lease("counter", _counter.cache_clear)
    return _counter(path)


def token_counts(docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id", limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every text; a null text counts as empty.

    Reads two columns and moves nothing between tasks. Repeated rows give repeated results; other columns,
    whatever their names, are left out; an empty table gives no rows. Very long texts are handled in
    blocks, so memory is bounded by the text itself.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = counter(path)
        for b in batches:
            texts = ["" if t is None else t for t in b["__t"]]
            n = c.counts(texts)
            size = [len(t.encode()) for t in texts]
            yield pd.DataFrame({id_col: b[id_col], "n_bytes": np.array(size, np.int64), "n_tokens": n, "over_limit": n > limit})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text).alias("__t")).mapInPandas(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
