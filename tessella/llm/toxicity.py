"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier (operator 10)."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tessella.llm.labelmodel import LabelModel, fit_linear
from tessella.llm.shingles import mix, shingle_sets

# Lexicons of insults by what they attack.
INSULTS = {
    "persons": "idiot moron loser fool imbecile dunce".split(),
    "minds": "stupid dumb brainless clueless braindead".split(),
    "worth": "pathetic worthless disgusting useless repulsive".split(),
    "things": "trash scum clown filth garbage vermin".split(),
}
#: Voters of learnt lexicons by kind of term (whole words; prefixes of 4, 5, 6 letters), and pattern voters.
GROUPS = {"w": 4, "4": 2, "5": 2, "6": 2}
PATTERNS = ("leet", "shouting", "marks")
#: The learnt lexicons' terms and the classifier's features come from about LABELLED labelled rows, chosen by hash; the
#: bound is on the fit alone. A term counts if its log-odds are this far from 0, and the labels of the rows that hold it
#: are this unlikely by chance (the root of twice the log-likelihood ratio, like a standard normal).
LABELLED, ODDS, CHANCE = 20_000, 2.0, 5.0
_LEET = re.compile(r"\w*[a-z][013457@$]+[a-z]\w*")
MARKS = ".,;:!?\"'()[]|*%&#$"


def held_out(id_col: str) -> Column:
    """Rows whose labels are never learnt from."""
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def words_of(text: str) -> set[str]:
    """Distinct words in lower case without marks at their ends."""
    out = {w.strip(MARKS) for w in set(text.lower().split())}
    out.discard("")
    return out


def terms_of(word: str) -> list[str]:
    """A word as terms: itself, and prefixes shorter than it."""
    return ["w" + word, *(f"{k}{word[:k]}" for k in (4, 5, 6) if len(word) > k)]


class Voters(dict):
    """Lexicons of learnt terms, each split by hash into voters that see different words, and pattern voters.

    As a dict it keeps what a token means, (bits of voters, obfuscated or not, feature numbers), or None for
    the many tokens without meaning; it starts anew at a bound.
    """

    def __init__(self, terms: Iterable[str], features: dict[str, int] | None = None, kept: int = 400_000):
        super().__init__()
        self.names = [f"{g}{i}" for g, n in GROUPS.items() for i in range(n)]
        at = {name: i for i, name in enumerate(self.names)}
        self.voter = {t: at[f"{t[0]}{zlib.crc32(t.encode()) % GROUPS[t[0]]}"] for t in terms}
        self.first = len(self.names)
        self.names += [*INSULTS, *PATTERNS]
        self.insults = {w: 1 << (self.first + i) for i, words in enumerate(INSULTS.values()) for w in words}
        self.features, self.kept = features or {}, kept

    def __reduce__(self):
        return Voters, (list(self.voter), self.features, self.kept)

    def __missing__(self, token: str) -> tuple | None:
        if len(self) >= self.kept:
            self.clear()
        word = token.strip(MARKS)
        terms = terms_of(word) if word else []
        bits = sum({1 << self.voter[t] for t in terms if t in self.voter}) | self.insults.get(word, 0)
        hits = tuple(self.features[t] for t in terms if t in self.features)
        leet = bool(_LEET.fullmatch(word))
        meaning = self[token] = (bits, leet, hits) if bits or leet or hits else None
        return meaning

    def read(self, text: str) -> tuple[int, list[int]]:
        """The votes as bits, and the features that the text has."""
        parts = text.split()
        bits, obfuscated, hits = 0, 0, set()
        for meaning in filter(None, map(self.__getitem__, set(text.lower().split()))):
            bits |= meaning[0]
            obfuscated += meaning[1]
            hits.update(meaning[2])
        patterns = obfuscated > 2, sum(map(str.isupper, parts)) > 0.2 * len(parts), text.count("!") > 0.1 * len(parts)
        for k, hit in enumerate(patterns):
            bits |= hit << (self.first + len(INSULTS) + k)
        return bits, sorted(hits)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return (codes[:, None] >> np.arange(len(self.names))) & 1


class ToxicityModel:
    """What the fit leaves: voters (with the features' numbers), label model and weights."""

    def __init__(self, voters: Voters, labels: LabelModel, weights: np.ndarray, bias: float):
        self.voters, self.labels, self.weights, self.bias = voters, labels, weights, bias


def _count_terms(rows: DataFrame) -> DataFrame:
    """(term, pos, neg): in how much label-1 and label-0 weight a term occurs. rows: text, weight of label 1."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pos: Counter = Counter()
        neg: Counter = Counter()
        for b in batches:
            for t, y in zip(b["text"], b["y"], strict=True):
                found = {x for w in words_of(t or "") for x in terms_of(w)}
                for x in found:
                    pos[x] += y
                    neg[x] += 1 - y
            if len(pos) > 300_000:
                yield from tables(pos, neg)
                pos.clear()
                neg.clear()
        yield from tables(pos, neg)

    def tables(pos: Counter, neg: Counter) -> Iterator[pd.DataFrame]:
        terms = list(pos)
        for lo in range(0, len(terms), 20_000):
            part = terms[lo : lo + 20_000]
            yield pd.DataFrame({"term": pd.Series(part, dtype=object), "pos": [float(pos[x]) for x in part], "neg": [float(neg[x]) for x in part]})

    return rows.mapInPandas(run, "term string, pos double, neg double").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _once(rows: DataFrame) -> DataFrame:
    """Of copies and near copies one row each, for their words would else count as often as there are copies: of the rows
    that share the least of their hashed shingles, by one hash and then by another, the first by text stays."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = shingle_sets(list(b["text"]))
            least = [[int(mix(x ^ np.uint64(salt)).view(np.int64).min()) if len(x) else None for x in sets] for salt in (1, 2)]
            yield b.assign(a=pd.array(least[0], "Int64"), b=pd.array(least[1], "Int64"))

    keyed = rows.mapInPandas(run, "text string, y double, a long, b long")
    first = keyed.groupBy("a").agg(F.min(F.struct("text", "y", "b")).alias("r")).select("r.*")
    return first.groupBy("b").agg(F.min(F.struct("text", "y")).alias("r")).select("r.*")


def _odds(p: float, n: float) -> tuple[Column, Column]:
    """Log-odds of a term for label 1, of which there are p among n rows, and how unlikely its rows' labels are."""
    pos, neg, rate = F.col("pos"), F.col("neg"), p / n
    part = lambda x, share: F.when(x > 0, x * F.log(x / ((pos + neg) * share))).otherwise(0.0)
    ratio = part(pos, rate) + part(neg, 1 - rate)
    return F.log((pos + 0.5) / (p + 1)) - F.log((neg + 0.5) / (n - p + 1)), F.sqrt(F.greatest(2 * ratio, F.lit(0.0)))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "toxic", labelled: int = LABELLED) -> ToxicityModel | None:
    """Learns lexicons from labelled rows that aren't held out, and how far to trust all voters from the vote patterns of
    all documents. Labels choose the terms of the learnt lexicons (insults of most languages are in no list) and start the
    search; accuracies and correlations are estimated from the votes alone, and the classifier learns the posteriors.

    None without a labelled row of each kind.
    """
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(label).alias("y"))
    total = usable.count()
    share = min(1.0, labelled / max(1, total))
    picked = usable.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0))
    # about LABELLED ids are broadcast, whatever the size of the tables
    sample = docs.select(id_col, F.col(text).alias("text")).join(F.broadcast(picked), id_col).select("text", F.col("y").cast("double").alias("y"))
    sample = _once(sample).checkpoint()
    sums = sample.agg(F.sum("y").alias("p"), F.count("*").alias("n")).first()
    if not sums["n"] or not 0 < sums["p"] < sums["n"]:
        return None
    rate = sums["p"] / sums["n"]

    odds, chance = _odds(sums["p"], sums["n"])
    best = _count_terms(sample).filter((odds > ODDS) & (chance > CHANCE)).select("term").collect()  # bounded by the sample
    voters = Voters(sorted(r["term"] for r in best))

    def patterns(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"code": [voters.read(t or "")[0] for t in b["__t"]]})

    # vote patterns of all documents (2^17 at most); the label model sees votes alone, no label
    rows = docs.select(F.col(text).alias("__t")).mapInPandas(patterns, "code long").groupBy("code").count().collect()
    votes = voters.decode(np.array([r["code"] for r in rows], np.int64))
    counts = np.array([r["count"] for r in rows], float)
    model = LabelModel(2).fit(votes, counts, np.where(votes.sum(axis=1) > 1, 0.9, rate / 2))

    def soft(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            codes = np.array([voters.read(t or "")[0] for t in b["text"]], np.int64)
            p = model.posterior(voters.decode(codes)) if len(codes) else np.zeros(0)
            yield pd.DataFrame({"text": b["text"], "y": p})

    softened = sample.select("text").mapInPandas(soft, "text string, y double").checkpoint()
    mass = softened.agg(F.sum("y").alias("p"), F.count("*").alias("n")).first()
    odds, chance = _odds(mass["p"], mass["n"])
    wanted = _count_terms(softened).filter((F.abs(odds) > ODDS / 2) & (chance > CHANCE)).select("term").collect()
    features = {t: i for i, t in enumerate(sorted(r["term"] for r in wanted))}
    voters = Voters(voters.voter, features)

    def sparse(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"cols": [voters.read(t or "")[1] for t in b["text"]], "y": b["y"]})

    found = softened.mapInPandas(sparse, "cols array<long>, y double").toPandas()
    cols = [np.asarray(x, np.int64) for x in found["cols"]]
    w, bias = fit_linear(cols, [np.ones(len(c)) for c in cols], found["y"].to_numpy(), len(features), rate=0.3)
    return ToxicityModel(voters, model, w, bias)


def score(docs: DataFrame, model: ToxicityModel | None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, score, predicted, posterior, voters) of every row, from its text alone."""
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), F.col(text).alias("__t"))
    if model is None:
        return base.select(id_col, "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(0.0).alias("posterior"), F.lit("").alias("voters"))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            z, codes = [], []
            for t in b["__t"]:
                code, hits = model.voters.read(t or "")
                z.append(float(model.weights[hits].sum()) + model.bias if hits else model.bias)
                codes.append(code)
            votes = model.voters.decode(np.array(codes, np.int64))
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            names = np.array(model.voters.names)
            yield pd.DataFrame({id_col: b[id_col], "held_out": b["held_out"], "score": p, "predicted": (p >= 0.5).astype(np.int32), "posterior": model.labels.posterior(votes) if len(votes) else [], "voters": [",".join(names[v > 0]) for v in votes]})

    return base.mapInPandas(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int, posterior double, voters string")


def classify_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "toxic") -> DataFrame:
    """Fits on the labels that may be used and scores every row.

    A null text counts as empty and gets the score of a text without hits. Rows with a null id are never
    held out. Repeated labels of an id count once, as the highest. Without usable labels of both kinds every
    score is 0. Other columns, in either table, are left out; an empty table gives no rows.
    """
    return score(docs, fit(docs, labels, text, id_col, label), text, id_col)
