"""Quality by weak labels: heuristic labellers, their estimated accuracies, and a hashed linear scorer (operator 6)."""

from __future__ import annotations

import operator
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tessella.llm.labelmodel import LabelModel, fit_linear
from tessella.llm.memo import lease

#: Votes: junk, between the two, good; and none, where a text is too short for a labeller.
JUNK, UNSURE, GOOD, ABSTAIN = 0, 1, 2, 3
LABELLERS = tuple("repeated words,one word,word pairs,repeated lines,noise marks,marked words,letters,plain words,shouting,exclamations,capitals,bars,word lengths,sentence marks".split(","))
#: The kinds of junk that labellers look for, by the labellers' places: repetition, noise, shouting, layout, oddity.
KINDS = ((0, 1, 2, 3), (4, 5, 6, 7), (8, 9, 10), (11,), (12, 13))
#: Hashed features: words, word shapes, and measures of the whole text in steps. The scorer is fitted on
#: about SAMPLE documents, chosen by hash; a bound on the fit alone, all else sees every document.
WORD_BITS, SHAPE_BITS, STEPS, SAMPLE = 13, 10, 10, 6000
SIZE = (1 << WORD_BITS) + (1 << SHAPE_BITS) + STEPS * len(LABELLERS)
#: Words kept per Python worker, and the longest of them.
_KEPT, _LONG = 250_000, 64
_MARKS = "%&*#$~^|"


def _high(x: float, junk: float, good: float) -> int:
    """Votes on a share that is high in junk."""
    return JUNK if x > junk else GOOD if x < good else UNSURE


def _low(x: float, junk: float, good: float) -> int:
    """Votes on a share that is low in junk."""
    return JUNK if x < junk else GOOD if x > good else UNSURE


def measures(text: str) -> tuple[float, ...]:
    """What the labellers look at, one number each: shares, signs per word, and the mean length of words."""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(LABELLERS)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    letters = ((codes | 32) - 97 < 26) | (codes >= 192)  # the subtraction wraps around below
    large = int(np.count_nonzero((codes - 65 < 26) | (codes - 192 < 31)))
    lines = [x for x in text.split("\n") if x]
    return (
        sum(map(operator.eq, words, words[1:])) / n,
        max(Counter(words).values()) / n,
        len(set(zip(words, words[1:], strict=False))) / (n - 1) if n > 1 else 1.0,
        1 - len(set(lines)) / len(lines) if len(lines) > 3 else 0.0,
        sum(text.count(c) for c in "%&*#$~^") / n,
        sum(map(_MARKS.__contains__, map(operator.itemgetter(-1), words))) / n,
        float(np.count_nonzero(letters)) / len(codes),
        sum(map(str.isalnum, words)) / n,
        sum(map(str.isupper, words)) / n,
        text.count("!") / n,
        large / max(1, int(np.count_nonzero(letters))),
        text.count("|") / n,
        (len(text) - n + 1) / n,
        (text.count(".") + text.count(",")) / n,
    )


def votes_of(m: tuple[float, ...], n: int) -> tuple[int, ...]:
    """The labellers' votes on a text of n words. Every kind of junk is seen by several of them, so that agreement tells
    how good they are."""
    repeats, most, pairs, again, marks, marked, letters, plain, shouts, bangs, large, bars, mean, stops = m
    if not n:
        return (ABSTAIN,) * len(LABELLERS)
    long = n >= 20
    return (
        _high(repeats, 0.10, 0.02),
        _high(most, 0.30, 0.15) if long else ABSTAIN,
        _low(pairs, 0.60, 0.85) if long else ABSTAIN,
        _high(again, 0.35, 0.10) if long else ABSTAIN,
        _high(marks, 0.15, 0.02),
        _high(marked, 0.30, 0.05),
        _low(letters, 0.70, 0.75) if long else ABSTAIN,
        _low(plain, 0.45, 0.60) if long else ABSTAIN,
        _high(shouts, 0.25, 0.05) if n >= 5 else ABSTAIN,
        _high(bangs, 0.10, 0.02),
        _high(large, 0.30, 0.15) if n >= 5 else ABSTAIN,
        _high(bars, 0.08, 0.01),
        JUNK if mean > 15 or mean < 2 else GOOD if 3 < mean < 10 else UNSURE,
        (JUNK if stops < 0.01 or stops > 0.5 else GOOD if 0.02 < stops < 0.45 else UNSURE) if long else ABSTAIN,
    )


@lru_cache(1)
def _memo() -> dict[str, int]:
    return {}


def _number(w: str) -> int:
    """The hash of a word, and that of its shape: runs of capitals, other letters and digits, and marks one by one."""
    shape, last = [], ""
    for ch in w:
        k = "A" if ch.isupper() else "a" if ch.isalpha() else "0" if ch.isdigit() else ch
        if k != last or not k.isalnum():
            shape.append(k)
        last = k
    return (zlib.crc32(w.lower().encode()) & ((1 << WORD_BITS) - 1)) | (zlib.crc32("".join(shape).encode()) & ((1 << SHAPE_BITS) - 1)) << 32


def _features(words: list[str]) -> np.ndarray:
    """Per word two feature numbers: the word's hash, and that of its shape (runs of letters, digits, marks)."""
    memo = _memo()
    lease("quality", _memo.cache_clear)
    if len(memo) > _KEPT:
        memo.clear()
    new = {w: _number(w) for w in set(words) if w not in memo}
    memo.update((w, x) for w, x in new.items() if len(w) <= _LONG)
    long = {w: x for w, x in new.items() if len(w) > _LONG}
    look = (lambda w: long[w] if w in long else memo[w]) if long else memo.__getitem__
    packed = np.fromiter(map(look, words), np.int64, len(words))
    return np.concatenate([packed & 0xFFFFFFFF, (packed >> 32) + (1 << WORD_BITS)])


def sparse_row(text: str, m: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values: shares of hashed words and shapes, and one step per measure."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    cols, counts = np.unique(_features(words), return_counts=True)
    scale = [1 / 20 if k == "word lengths" else 1 for k in LABELLERS]
    steps = np.array([(1 << WORD_BITS) + (1 << SHAPE_BITS) + k * STEPS + min(STEPS - 1, int((x * s) ** 0.5 * STEPS)) for k, (x, s) in enumerate(zip(m, scale, strict=True))])
    return np.concatenate([cols, steps]), np.concatenate([counts * (4 / len(words)), np.ones(len(steps))])


def _code(v: tuple[int, ...]) -> int:
    out = 0
    for x in v:
        out = out * 4 + x
    return out


def _decode(codes: np.ndarray) -> np.ndarray:
    k = len(LABELLERS)
    return np.stack([codes // 4 ** (k - 1 - i) % 4 for i in range(k)], axis=1) if len(codes) else np.zeros((0, k), np.int64)


def _vote(text: str) -> tuple[int, tuple[float, ...]]:
    m = measures(text)
    return _code(votes_of(m, len(text.split()))), m


def first_guess(votes: np.ndarray) -> np.ndarray:
    """P(kind of junk), then P(good), per pattern: good without votes for junk, else by the share of a kind's labellers."""
    share = np.stack([(votes[:, k] == JUNK).mean(axis=1) for k in map(list, KINDS)], axis=1)
    total = share.sum(axis=1, keepdims=True)
    kinds = np.where(total > 0, 0.9 * share / np.maximum(total, 1e-9), 0.1 / len(KINDS))
    return np.concatenate([kinds, 1 - kinds.sum(axis=1, keepdims=True)], axis=1)


class QualityModel:
    """Fitted labellers and scorer: plain arrays, small enough to go to every task."""

    def __init__(self, labels: LabelModel, weights: np.ndarray, bias: float):
        self.labels, self.weights, self.bias = labels, weights, bias


def fit(docs: DataFrame, text: str = "text", id_col: str = "doc_id", sample: int = SAMPLE) -> QualityModel | None:
    """Fits the label model on vote patterns counted over all documents (three values of 14 labellers, of which texts show some hundreds), then
    the scorer on the posteriors of a sample chosen by hash. None for an empty table. Expectation maximisation starts
    from the guess that a text with votes for junk is junk of the kinds that these votes look for; what it learns comes
    from the votes alone."""
    own = docs.select(F.col(id_col).alias("__i"), F.col(text).alias("__t"))

    def patterns(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"code": [_vote(t or "")[0] for t in b["__t"]]})

    counted = own.select("__t").mapInPandas(patterns, "code long").groupBy("code").count().collect()
    if not counted:
        return None
    codes = np.array([r["code"] for r in counted])
    votes, counts = _decode(codes), np.array([r["count"] for r in counted], float)
    model = LabelModel(4, abstain=ABSTAIN).fit(votes, counts, first_guess(votes))
    share = min(1.0, sample / counts.sum())

    def sparse(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b["__t"]:
                code, m = _vote(t or "")
                rows.append((code, *sparse_row(t or "", m)))
            yield pd.DataFrame(rows, columns=["code", "cols", "vals"])

    chosen = own.filter(F.pmod(F.xxhash64("__i", "__t"), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0))
    rows = chosen.select("__t").mapInPandas(sparse, "code long, cols array<long>, vals array<double>").toPandas()
    target = model.posterior(_decode(rows["code"].to_numpy())) if len(rows) else np.zeros(0)
    w, b = fit_linear([np.asarray(x, np.int64) for x in rows["cols"]], [np.asarray(x) for x in rows["vals"]], target, SIZE)
    return QualityModel(model, w, b)


def score(docs: DataFrame, model: QualityModel | None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, votes, posterior, score, kept) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, votes string, posterior double, score double, kept boolean"

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            codes, z = [], []
            for t in b["__t"]:
                t = t or ""
                code, m = _vote(t)
                cols, vals = sparse_row(t, m)
                codes.append(code)
                z.append(float((model.weights[cols] * vals).sum()) + model.bias if len(cols) else -30.0)
            v = _decode(np.array(codes, np.int64))
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pd.DataFrame({id_col: b["__i"], "votes": ["".join("-0+ "[x] for x in r) for r in v], "posterior": model.labels.posterior(v) if len(v) else [], "score": p, "kept": p >= 0.5})

    if model is None:
        return docs.sparkSession.createDataFrame([], schema)
    return docs.select(F.col(id_col).alias("__i"), F.col(text).alias("__t")).mapInPandas(run, schema)


def keep_good(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows that classify_quality keeps, whatever their ids, with all columns."""
    model = fit(docs, text, id_col)
    if model is None:
        return docs.limit(0)

    @F.pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        z = []
        for t in texts:
            t = t or ""
            cols, vals = sparse_row(t, _vote(t)[1])
            z.append(float((model.weights[cols] * vals).sum()) + model.bias if len(cols) else -30.0)
        return pd.Series(np.array(z) >= 0)

    return docs.filter(kept(text))


def classify_quality(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Votes, posterior and score of every row; kept where the score is 0.5 or more.

    A null text counts as empty; texts without a word score 0 and are not kept. Repeated rows and repeated ids
    get the same scores; other columns are left out. An empty table gives no rows.
    """
    return score(docs, fit(docs, text, id_col), text, id_col)
