"""Benchmark decontamination by latent semantic retrieval (operator 8)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Benchmark items, and their words, handled at a time: this bounds what is sent to tasks (a block's scores take at most
#: 4 * RANK bytes a word, 64 MB); further blocks scan the documents again.
ITEMS, WORDS = 4096, 1 << 16
#: Latent dimensions, and so many items (of so many words in all) at most are decomposed together: a part has a dimension
#: for each of its items, and none of an item's weight is lost. Extra columns and power iterations of the randomised
#: decomposition, whose state is at most PART * (RANK + EXTRA) numbers, 35 MB.
RANK, PART, EXTRA, POWER = 256, 1 << 14, 10, 2
#: Words in a row that are summed up as one; window lengths in such rows, carried on by halves up to the longest item; a
#: window moves by a row, or by an eighth of its length.
ROW, WINDOWS = 8, (2, 4, 6, 8)
#: A window is a candidate for an item from this cosine on, if it also holds this share of the item's weight.
COSINE, SHARE = 0.3, 0.2
#: A candidate is a leak if so much of the item is in it in order, and so much of the weight of the item's answer words:
#: the rarest of its different words, so much of them. As most of an item's different words count, a paraphrase that
#: replaces just the rarest ones still keeps enough.
LCS, RAREST, ANSWER, SHORTEST = 0.6, 2 / 3, 0.4, 5
#: Rows of words, and items, looked at together.
CHUNK, GROUP = 256, 8
_MARKS = ".,;:!?\"'()[]{}|*%&#$<>=/\\_~^`«»„“”…"


def words_of(text: str | None) -> list[str]:
    """Words in lower case, marks left out."""
    low = (text or "").lower()
    for m in _MARKS:
        if m in low:
            low = low.replace(m, " ")
    return low.split()


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a machine word of a's places per step over b."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        m = row & at.get(y, 0)
        row = ((row + m) | (row - m)) & full
    return len(a) - row.bit_count()


def window_sizes(longest: int) -> list[int]:
    """Window lengths, in rows of words, for items of so many words at most."""
    sizes = list(WINDOWS)
    while sizes[-1] * ROW < longest:
        sizes.append(sizes[-1] * 3 // 2)
    return sizes


class Vocabulary:
    """The words of a block of items, with their weights once document counts are known."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.number = {w: i for i, w in enumerate(sorted({w for _, ws in items for w in ws}))}
        self.ids = [i for i, _ in items]
        self.rows = [np.array([self.number[w] for w in ws], np.int64) for _, ws in items]

    def places(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))

    def held(self, words: list[str]) -> np.ndarray:
        """The places of the different words of the vocabulary that are among these, in any order."""
        return np.array([self.number[w] for w in self.number.keys() & set(words)], np.int64)

    def weigh(self, documents: int, df: np.ndarray) -> None:
        self.idf = np.log1p(documents / (df + 1))  # over 0 also for words that every document holds
        self.answers = []  # per item, its answer words and their shares of the weight
        for r in self.rows:
            own = np.unique(r)
            own = own[np.argsort(-self.idf[own], kind="stable")][: int(np.ceil(RAREST * len(own)))]
            self.answers.append(dict(zip(own.tolist(), (self.idf[own] / max(1e-9, self.idf[own].sum())).tolist(), strict=True)))


def document_counts(docs: DataFrame, text: str, vocabulary: Vocabulary) -> tuple[int, np.ndarray]:
    """Documents in all, and per word of the vocabulary those that hold it, over every row."""
    size = len(vocabulary.number)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(size + 1, np.int64), 0
        for b in batches:
            for t in b["__t"]:
                df[vocabulary.held(words_of(t))] += 1
            n += len(b)
        df[size] = n
        hit = np.flatnonzero(df)
        yield pd.DataFrame({"word": hit, "n": df[hit]})

    rows = docs.select(F.col(text).alias("__t")).mapInPandas(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(size + 1, np.int64)
    for r in rows:
        df[r["word"]] = r["n"]
    return int(df[size]), df[:size]


def randomized_basis(passages: DataFrame, size: int, rank: int, seed: int = 11) -> np.ndarray:
    """Right singular vectors (size, rank) of a sparse matrix of rows (cols array<long>, vals array<double>).

    Range finder with power iterations: tasks add up their rows' share of A'(A X) for a narrow X; sums per
    column meet in a partition by columns, not in a call for each. What comes back is size * (rank + 10) numbers, bounded by the block of items.
    """
    width = min(rank + EXTRA, size)
    x = np.random.default_rng(seed).standard_normal((size, width))
    for _ in range(POWER + 1):
        x, _ = np.linalg.qr(x)

        def share(batches: Iterable[pd.DataFrame], x: np.ndarray = x) -> Iterator[pd.DataFrame]:
            acc: dict[int, np.ndarray] = {}
            for b in batches:
                for cols, vals in zip(b["cols"], b["vals"], strict=True):
                    cols, vals = np.asarray(cols, np.int64), np.asarray(vals)
                    y = vals @ x[cols]
                    for c, v in zip(cols.tolist(), vals.tolist(), strict=True):
                        acc[c] = acc.get(c, 0) + v * y
            keys = sorted(acc)
            yield pd.DataFrame({"col": np.array(keys, np.int64), "v": [acc[k].tobytes() for k in keys]})

        def total(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            acc: dict[int, np.ndarray] = {}
            for b in batches:
                for c, v in zip(b["col"].tolist(), b["v"], strict=True):
                    acc[c] = acc.get(c, 0) + np.frombuffer(v)
            yield pd.DataFrame({"col": np.array(list(acc), np.int64), "v": [v.tobytes() for v in acc.values()]})

        x = np.zeros_like(x)
        for r in passages.mapInPandas(share, "col long, v binary").repartition("col").mapInPandas(total, "col long, v binary").collect():
            x[r["col"]] = np.frombuffer(r["v"])
    x, _, _ = np.linalg.svd(x, full_matrices=False)
    return x[:, : min(rank, width)]


class Index:
    """A part of a block's items in latent space.

    Folding a window in is linear: its score for an item is the sum of its words' scores, the product of the word's
    and the item's latent vectors. So the words' scores are kept, and a window costs sums only.
    """

    def __init__(self, vocabulary: Vocabulary, basis: np.ndarray):
        self.vocabulary = vocabulary
        vectors = basis * vocabulary.idf[:, None]
        items = np.stack([vectors[r].sum(axis=0) for r in vocabulary.rows])
        self.norms = np.maximum(np.linalg.norm(items, axis=1), 1e-9).astype(np.float32)
        self.sizes = window_sizes(max(map(len, vocabulary.rows)))
        #: Per item the longest window: the first that is as long as the item.
        self.reach = np.searchsorted(np.array(self.sizes) * ROW, [len(r) for r in vocabulary.rows])
        # items are looked at in groups of similar length and direction
        direction = np.argmax(np.abs(items[:, :GROUP]), axis=1)
        order = np.lexsort((items[:, 0] / self.norms, direction, self.reach))
        self.groups = [g[lo : lo + GROUP] for k in np.unique(self.reach) for g in [order[self.reach[order] == k]] for lo in range(0, len(g), GROUP)]
        #: Per item, its group.
        self.group = np.zeros(len(items), np.int64)
        for k, g in enumerate(self.groups):
            self.group[g] = k
        scores = np.maximum(vectors @ (items / self.norms[:, None] ** 2).T, 0).astype(np.float32)
        #: Per group, word and item: the share of the item's weight that the word stands for.
        self.scores = [np.ascontiguousarray(scores[:, g]) for g in self.groups]
        #: Per word and group, the largest of these: no item of the group gets more from a window.
        self.bounds = np.stack([x.max(axis=1) for x in self.scores], axis=1)
        self.mass = (vocabulary.idf**2).astype(np.float32)
        self.lists = [r.tolist() for r in vocabulary.rows]

    def candidates(self, at: np.ndarray, wanted: np.ndarray) -> dict[int, list[tuple[float, int, int]]]:
        """Per wanted item (cosine, first, end) of the windows near it; words as places, -1 for those that no item holds,
        which weigh nothing. An item is only looked at where its group's bound allows its longest window to be near."""
        out: dict[int, list[tuple[float, int, int]]] = {}
        chosen = np.unique(self.group[wanted])
        columns = [np.flatnonzero(np.isin(self.groups[g], wanted)) for g in chosen]
        rows, reach = -(-len(at) // ROW), [int(self.reach[self.groups[g][0]]) for g in chosen]
        kinds = sorted(set(reach))
        for lo in range(0, rows, CHUNK):
            hi = min(rows, lo + CHUNK + self.sizes[-1])  # windows that begin in this chunk
            part = at[lo * ROW : hi * ROW]
            hits = np.flatnonzero(part >= 0)
            if not len(hits):
                continue
            words, row = part[hits], hits // ROW
            first = np.flatnonzero(np.diff(row, prepend=-1))

            def summed(values: np.ndarray, at: np.ndarray = row[first] + 1, first: np.ndarray = first, n: int = hi - lo + 1 + self.sizes[-1]) -> np.ndarray:
                """Sums of the words' values from the chunk's start on, per row of words, and on behind its end."""
                told = np.zeros((n, *values.shape[1:]), np.float32)
                told[at] = np.add.reduceat(values, first, axis=0)
                return np.cumsum(told, axis=0, out=told)

            bound, near, n = summed(self.bounds[words][:, chosen]), [], min(hi - lo, CHUNK)
            for k in kinds:
                own = slice(*np.searchsorted(reach, [k, k + 1]).tolist())
                size = self.sizes[k]
                most = (bound[size : size + n, own] - bound[:n, own]).max(axis=0)
                near += (np.flatnonzero(most >= SHARE) + own.start).tolist()
            if not near:
                continue
            mass = summed(self.mass[words])
            for c in near:
                g, own = chosen[c], columns[c]
                share, items = summed(self.scores[g][words][:, own]), self.groups[g][own]
                for size in self.sizes[reach[c] :: -1]:  # longer windows hold more: when none is near, none that is shorter
                    hop = max(1, size // 8)
                    told = share[size : size + n : hop] - share[:n:hop]
                    k, j = np.nonzero(told >= SHARE)
                    if not len(k) and hop == 1:
                        break
                    start = k * hop
                    cosine = told[k, j] * self.norms[items[j]] / np.sqrt(np.maximum(mass[start + size] - mass[start], 1e-9))
                    for c, i, x in zip(cosine.tolist(), items[j].tolist(), start.tolist(), strict=True):
                        if c >= COSINE:
                            out.setdefault(i, []).append((c, (lo + x) * ROW, min(len(at), (lo + x + size) * ROW)))
        return out

    def search(self, at: np.ndarray, wanted: np.ndarray) -> list[tuple[int, int, float, float, float]]:
        """(item, first word, cosine, share in order, share of the answer words' weight) of every leak of the wanted items;
        words as places.

        Every window near an item by cosine is compared with it, the nearest first, with as many words as the item has
        to both sides.
        """
        out = []
        for i, found in self.candidates(at, wanted).items():
            item, n, tried = self.lists[i], len(self.lists[i]), []
            for cosine, a, b in sorted(found, reverse=True):
                a, b = max(0, min(a, b - n) - n), min(len(at), max(b, a + n) + n)
                if any(x <= a and b <= y for x, y in tried):  # a longer stretch has failed
                    continue
                text = at[a:b].tolist()
                answer = self.vocabulary.answers[i]
                told = sum(answer[w] for w in answer.keys() & set(text))
                share = lcs(item, text) / n if told >= ANSWER else 0.0
                if share >= LCS:
                    out.append((i, a, min(1.0, cosine), share, min(1.0, told)))
                    break
                tried.append((a, b))
        return out


class Block:
    """The parts of a block of items, which share one look at a document's words."""

    def __init__(self, vocabulary: Vocabulary, parts: list[Index]):
        self.vocabulary, self.parts, self.own = vocabulary, parts, []
        for p in parts:
            places = np.full(len(vocabulary.number) + 1, -1, np.int64)  # the last for unknown words
            places[vocabulary.places(list(p.vocabulary.number))] = np.arange(len(p.vocabulary.number))
            self.own.append(places)
        #: Per word, from where on it is told below of which items it is an answer word, and of what share; items are
        #: numbered over all parts, and begin with these numbers.
        self.begin = np.cumsum([0, *(len(p.vocabulary.ids) for p in parts)])
        answers = [(p, a) for p in parts for a in p.vocabulary.answers]
        names = {p: np.array(list(p.vocabulary.number), object) for p in parts}
        word = np.concatenate([vocabulary.places(names[p][list(a)].tolist()) for p, a in answers])
        order = np.argsort(word, kind="stable")
        self.item = np.repeat(np.arange(len(answers)), [len(a) for _, a in answers])[order]
        self.share = np.concatenate([list(a.values()) for _, a in answers])[order]
        self.first = np.searchsorted(word[order], np.arange(len(vocabulary.number) + 1))

    def wanted(self, words: list[str]) -> np.ndarray:
        """The items, numbered over all parts, of whose answer words the text holds enough. No other item can be a leak, as
        no stretch of the text holds more; most texts have none, and none of their windows needs a look."""
        held = self.vocabulary.held(words)
        first, n = self.first[held], self.first[held + 1] - self.first[held]
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        told = np.bincount(self.item[at], self.share[at])
        return np.flatnonzero(told >= ANSWER - 1e-9)  # sums in another order

    def search(self, words: list[str]) -> Iterator[tuple]:
        """(item's id, first word, cosine, share in order, share of the answer words' weight) of every leak."""
        wanted = self.wanted(words)
        if not len(wanted):
            return
        at = self.vocabulary.places(words)
        for p, places, lo, hi in zip(self.parts, self.own, self.begin, self.begin[1:], strict=False):
            own = wanted[(wanted >= lo) & (wanted < hi)] - lo
            if len(own):
                for i, *rest in p.search(places[at], own):
                    yield p.vocabulary.ids[i], *rest


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(doc_id, item_id, first_word, cosine, lcs, answer): the documents that hold a benchmark item.

    Items are weighted by TF-IDF, with document counts over all documents, and decomposed by a distributed
    randomised SVD; windows of the documents are folded into that space, where words that no item holds weigh
    nothing, so that scores don't change with the number of documents; every window near an item by cosine is
    compared with it by longest common subsequence and by its rarest words, its likely answer. A document that holds
    too few of an item's answer words as a whole isn't searched for that item. Items are a query
    set, sent to tasks in blocks of about 65,000 words, decomposed in parts of 256 items; documents aren't shuffled.
    first_word is where the stretch begins that was compared, an item's length before the window.

    Items of fewer than 5 words, and null items, are not searched; null or empty documents hold nothing.
    Repeated rows on either side give repeated results. Extra columns are left out; empty tables give no rows.
    """
    kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    schema = f"`{id_col}` {kinds[0]}, `{item_id}` {kinds[1]}, first_word int, cosine double, lcs double, answer double"
    out = None
    for held in _blocks(docs, benchmark, text, item_text, item_id):

        def run(batches: Iterable[pd.DataFrame], held: Block = held) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = [(d, *leak) for d, t in zip(b["__i"], b["__t"], strict=True) if t for leak in held.search(words_of(t))]
                yield pd.DataFrame(rows, columns=[id_col, item_id, "first_word", "cosine", "lcs", "answer"])

        found = docs.select(F.col(id_col).alias("__i"), F.col(text).alias("__t")).mapInPandas(run, schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The rows in which find_leaks finds nothing, whatever their ids, with all columns."""
    out = docs
    for held in _blocks(docs, benchmark, text, item_text, item_id):
        out = out.filter(_clean(held)(text))
    return out


def _clean(held: Block):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([not t or next(held.search(words_of(t)), None) is None for t in texts], dtype=bool)

    return clean


def _blocks(docs: DataFrame, benchmark: DataFrame, text: str, item_text: str, item_id: str) -> Iterator[Block]:
    own = benchmark.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).filter(F.col("t").isNotNull())
    size = own.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(F.split("t", r"\s+"))), F.lit(0)).alias("words")).first()
    blocks = max(1, -(-size["n"] // ITEMS), -(-size["words"] // WORDS))
    for block in range(blocks):
        chosen = own if blocks == 1 else own.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block)
        items = [(r["i"], ws) for r in sorted(chosen.collect(), key=lambda r: (str(r["i"]), r["t"])) if len(ws := words_of(r["t"])) >= SHORTEST]
        if items:
            yield _block(docs, text, items)


def _block(docs: DataFrame, text: str, items: list[tuple[int, list[str]]]) -> Block:
    vocabulary = Vocabulary(items)
    documents, df = document_counts(docs, text, vocabulary)
    parts, part = [], []
    for item in [*items, None]:
        if part and (item is None or len(part) == RANK or sum(len(ws) for _, ws in part) + len(item[1]) > PART):
            own = Vocabulary(part)
            own.weigh(documents, df[vocabulary.places(list(own.number))])
            parts.append(_index(docs, own))
            part = []
        part.append(item)
    return Block(vocabulary, parts)


def _index(docs: DataFrame, vocabulary: Vocabulary) -> Index:
    sparse = []
    for r in vocabulary.rows:
        cols, tf = np.unique(r, return_counts=True)
        vals = tf * vocabulary.idf[cols]
        sparse.append((cols.tolist(), (vals / max(1e-9, np.linalg.norm(vals))).tolist()))
    spark = docs.sparkSession
    passages = spark.createDataFrame(sparse, "cols array<long>, vals array<double>").repartition(min(len(sparse), 32))
    return Index(vocabulary, randomized_basis(passages, len(vocabulary.number), min(RANK, len(vocabulary.rows))))
