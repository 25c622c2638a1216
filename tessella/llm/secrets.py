"""Secrets: fixed patterns, and strings that pass a battery of randomness tests (operator 5)."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

# The base patterns.
ASSIGN = re.compile(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "random")
#: Shortest candidate of the battery; rejection level of the battery; false-discovery rate; bins of p-values.
SHORTEST, ALPHA, RATE, BINS = 20, 1e-3, 0.05, 200
#: Decoys of each candidate's length and encoding that a text gives, as far as its words last; length bands.
DECOYS, BANDS = 24, ((20, 24), (24, 32), (32, 40), (40, 64), (64, 128), (128, 256))
#: Encodings and their numbers of symbols.
ENCODINGS = {"hex": 16, "base32": 32, "base36": 36, "upper36": 36, "base64": 64}
#: Signs at which runs are cut into parts, step by step.
CUTS = ("=", "=/", "=/+_-")

_DIGIT, _UPPER, _LOWER, _SIGN, _HEX = 1, 2, 4, 8, 16


def _table() -> np.ndarray:
    t = np.zeros(128, np.uint8)
    t[48:58] |= _DIGIT | _HEX
    t[65:91] |= _UPPER
    t[97:123] |= _LOWER
    t[97:103] |= _HEX
    for c in "+/_=-":
        t[ord(c)] |= _SIGN
    return t


_CLASS = _table()


def _runs(mask: np.ndarray, least: int) -> np.ndarray:
    """(start, end) of the maximal runs of True of at least some length."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    runs = edge.reshape(-1, 2)
    return runs[runs[:, 1] - runs[:, 0] >= least]


def base_spans(text: str, classes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) by the fixed patterns, leftmost and non-overlapping per kind."""
    out = []
    low = text.lower()
    if "pass" in low or "secret" in low or "token" in low or "key" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # a greedy pattern of one class matches exactly the maximal runs
    out += [(a, 2, b) for a, b in _runs((classes & _HEX) > 0, 24).tolist()]
    return sorted(out)


def alphabet(codes: np.ndarray) -> tuple[str, np.ndarray] | None:
    """The encoding a string seems to be in, and its symbols as 0..k-1; None for a word of letters and for a number."""
    c = _CLASS[codes]
    if (c & _SIGN).any() and not ((c & _UPPER).any() and (c & _LOWER).any()) and not np.isin(codes, _OUTER).any():
        inner = codes[(c & _SIGN) == 0]  # groups of one string, as in a dashed UUID
        return alphabet(inner) if len(inner) and np.diff(np.flatnonzero(np.concatenate([[True], (c & _SIGN) > 0, [True]]))).max() <= SHORTEST else None
    digit, upper, lower, sign = (bool((c & f).any()) for f in (_DIGIT, _UPPER, _LOWER, _SIGN))
    found = None
    if upper and lower:
        found = "base64"
    elif not sign and digit and lower:
        found = "hex" if ((c & _HEX) > 0).all() else "base36"
    elif not sign and digit and upper:
        found = "hex" if (codes <= 70).all() else "base32" if ((codes >= 65) | ((codes >= 50) & (codes <= 55))).all() else "upper36"
    return (found, symbols(codes, found)) if found else None


def symbols(codes: np.ndarray, encoding: str) -> np.ndarray:
    """The characters of a string as numbers in its encoding."""
    if encoding == "base64":
        body = codes[codes != ord("=")]
        return np.select([(body >= 65) & (body < 91), body >= 97, (body >= 48) & (body < 58), (body == 43) | (body == 45)], [body - 65, body - 71, body + 4, 62], 63)
    if encoding == "base32":
        return np.where(codes < 58, codes - 24, codes - 65)
    return np.where(codes < 58, codes - 48, np.where(codes < 97, codes - 55, codes - 87))


def _kinds(encoding: str) -> np.ndarray:
    """For each symbol its kind: vowels, common and other consonants (apart by case where there are two), the rest."""
    letters = np.array([0 if x in "aeiou" else 1 if x in "tnshrdlc" else 2 for x in "abcdefghijklmnopqrstuvwxyz"])
    rest = np.full(ENCODINGS[encoding], 6)
    if encoding == "base64":
        rest[:26], rest[26:52] = letters, letters + 3
    elif encoding == "base32":
        rest[:26] = letters
    else:
        rest[10:] = letters[: ENCODINGS[encoding] - 10]
    return np.unique(rest, return_inverse=True)[1]


#: Per encoding the kind of each symbol, and the share of the symbols that are of each kind.
_KINDS = {e: (k, np.bincount(k) / len(k)) for e in ENCODINGS for k in [_kinds(e)]}
_OUTER = np.array([ord("="), ord("/")])
_WORD = re.compile("[a-z]{2,}")


def _tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi_squared(counts: np.ndarray, shares: np.ndarray) -> float:
    """Upper tail by the cube-root approximation."""
    n, free = counts.sum(), len(shares) - 1
    chi = float((counts**2 / shares).sum()) / n - n
    return 0.5 * math.erfc(((chi / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(4 / (9 * free)))


def battery(values: np.ndarray, encoding: str) -> float:
    """p-value of the hypothesis that the symbols are drawn evenly and independently.

    Four tests, combined by Bonferroni: chi-squared of the symbols' counts, and of the counts of kinds of symbols, as
    short strings have few of each symbol; runs above and below the middle; and serial correlation of neighbours.
    """
    n, k = len(values), ENCODINGS[encoding]
    kinds, shares = _KINDS[encoding]
    counts = np.bincount(values, minlength=k).astype(float)
    p = [_chi_squared(counts, np.full(k, 1 / k)), _chi_squared(np.bincount(kinds, counts, len(shares)), shares)]
    high = values >= k / 2
    up = int(high.sum())
    down = n - up
    if up and down:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 1 + 2 * up * down / n
        var = max(1e-9, (mean - 1) * (mean - 2) / (n - 1))
        p.append(_tail((runs - mean) / math.sqrt(var)))
    else:
        p.append(2.0 ** (1 - n) if n < 1000 else 0.0)
    v = values.astype(float)
    spread = v.var()
    if spread > 0:
        r = float(((v[1:] - v.mean()) * (v[:-1] - v.mean())).mean()) / spread
        p.append(_tail((r + 1 / n) * math.sqrt(n)))
    else:
        p.append(0.0)
    return min(1.0, 4 * min(p))


def _pieces(codes: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of a run and of its parts between signs, of each kind of cut, each once."""
    out = {(0, len(codes)): None}
    if (_CLASS[codes] & _SIGN).any():
        for signs in CUTS:
            out |= dict.fromkeys(map(tuple, _runs(~np.isin(codes, [ord(x) for x in signs]), SHORTEST).tolist()))
    return list(out)


def _candidates(codes: np.ndarray, classes: np.ndarray) -> list[tuple[int, int, str, float, int]]:
    """(start, end, encoding, p-value, symbols) of runs and their parts; parts lie inside their run or apart."""
    out = []
    ok = classes > 0
    for a, b in _runs(ok, SHORTEST).tolist():
        for x, y in _pieces(codes[a:b]):
            found = alphabet(codes[a + x : a + y])
            if found and len(found[1]) >= SHORTEST:
                out.append((a + x, a + y, found[0], battery(found[1], found[0]), len(found[1])))
    return out


#: How ordinary words look in an encoding: as identifiers with capitals, or with a digit behind each word.
_LOOKS = {
    "base64": str.capitalize,
    "base36": lambda w: f"{w}{len(w) % 10}",
    "upper36": lambda w: f"{w.upper()}{len(w) % 10}",
    "base32": lambda w: f"{w.upper()}{2 + len(w) % 6}",
    "hex": lambda w: f"{''.join([x for x in w if x < 'g'])}{len(w) % 10}",
}


def _decoys(text: str, wanted: list[tuple[int, str]]) -> list[tuple[int, str, float]]:
    """(length, encoding, p-value) of strings made of the text's words in order: DECOYS of the length and encoding of each
    candidate, as far as the words last, then one more, its length band and encoding by turns."""
    names, out, turn = list(_LOOKS), [], len(text)
    lo, hi = BANDS[turn % len(BANDS)]
    for kinds in (wanted * DECOYS, [(lo + turn % (hi - lo), names[turn // len(BANDS) % len(names)])]):
        words = _WORD.finditer(text)
        for n, encoding in kinds:
            look, parts, size = _LOOKS[encoding], [], 0
            for m in words:
                parts.append(look(m[0]))
                size += len(parts[-1])
                if size >= n:
                    break
            if size < n:
                break
            codes = np.frombuffer("".join(parts)[:n].encode("ascii"), np.uint8).astype(np.int64)
            out.append((n, encoding, battery(symbols(codes, encoding), encoding)))
    return out


def band_of(n: int) -> int:
    """Length bands: 20-23, 24-31, 32-39, 40-63, 64-127, 128 and more."""
    return sum(n >= x for x in (24, 32, 40, 64, 128))


def stratum(encoding: str, n: int) -> int:
    """Encodings and length bands, numbered."""
    return list(ENCODINGS).index(encoding) * len(BANDS) + band_of(n)


def _apart(found: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[bool]:
    """Which of some spans (start, end) touch none of the base spans (start, kind, end), given by start."""
    if not base:
        return [True] * len(found)
    starts, ends = np.array([a for a, _, _ in base]), np.maximum.accumulate([b for _, _, b in base])
    before = np.searchsorted(starts, [b for _, b in found])
    return [not k or ends[k - 1] <= a for k, (a, _) in zip(before.tolist(), found, strict=True)]


def scan(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """Per row: base spans, and the battery's candidates and decoys with their p-values."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b["__t"]:
                t = t or ""
                codes = np.frombuffer(t.encode("utf-32-le"), np.uint32)
                classes = _CLASS[np.where(codes < 128, codes, 0)]
                codes = codes.astype(np.int64)
                base = base_spans(t, classes)
                cand = _candidates(codes, classes)
                fake = _decoys(t, [(n, enc) for _, _, enc, _, n in cand])
                new = _apart([(a, b) for a, b, *_ in cand], base)
                rows.append(
                    (
                        [{"start": s, "kind": k, "end": e} for s, k, e in base],
                        [{"start": s, "end": e, "encoding": enc, "stratum": stratum(enc, n), "p": p, "new": ok} for (s, e, enc, p, n), ok in zip(cand, new, strict=True)],
                        [{"stratum": stratum(enc, n), "p": p} for n, enc, p in fake],
                    )
                )
            yield pd.DataFrame({"__i": b["__i"], "base": [r[0] for r in rows], "cand": [r[1] for r in rows], "decoys": [r[2] for r in rows]})

    schema = f"__i {kind}, base array<struct<start:int,kind:int,end:int>>, cand array<struct<start:int,end:int,encoding:string,stratum:int,p:double,new:boolean>>, decoys array<struct<stratum:int,p:double>>"
    return docs.select(F.col(id_col).alias("__i"), F.col(text).alias("__t")).mapInPandas(run, schema)


def thresholds(scanned: DataFrame) -> list[float]:
    """Per stratum (encoding and length band) the least p-value from which candidates count as random.

    Candidates and decoys (ordinary words in the same encoding and of the same lengths) are counted in bins of p over
    all rows. The threshold is the lowest at which the candidates that would pass if all were ordinary words (the share
    of decoys above it, one added, of all candidates) are at most RATE of the candidates above it; it is never under
    ALPHA. There are more decoys than candidates, so a single candidate can pass. Where a band's own decoys are too
    few, those of the encoding's shorter bands are added, which pass more often. Short strings thus need a higher p,
    because decoys of their length often pass. At most 30 * 201 counts of each kind come back. A stratum where no
    threshold does gets 2 (nothing passes).
    """
    bin_of = F.least(F.floor(F.sqrt(F.sqrt("x.p")) * BINS), F.lit(BINS)).cast("int").alias("bin")  # finer near 0
    parts = [scanned.select(F.explode(c).alias("x"), F.lit(w).alias("decoy")).select("x.stratum", bin_of, "decoy") for c, w in (("cand", False), ("decoys", True))]
    counted = parts[0].unionByName(parts[1]).groupBy("stratum", "bin", "decoy").count().collect()
    shape = len(ENCODINGS) * len(BANDS), BINS + 1
    real, fake = np.zeros(shape), np.zeros(shape)
    for r in counted:
        (fake if r["decoy"] else real)[r["stratum"], r["bin"]] += r["count"]
    out = []
    allowed = (np.arange(BINS + 1) / BINS) ** 4 >= ALPHA
    for k in range(shape[0]):
        above_real, least = real[k][::-1].cumsum()[::-1], 2.0
        for first in range(k, k - k % len(BANDS) - 1, -1):
            decoys = fake[first : k + 1].sum(axis=0)
            above_fake = decoys[::-1].cumsum()[::-1]
            good = np.flatnonzero(((above_fake + 1) * real[k].sum() <= RATE * above_real * decoys.sum()) & (above_real > 0) & allowed)
            if len(good):
                least = float((good[0] / BINS) ** 4)
                break
        out.append(least)
    return out


def find_secrets(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random, encodings) of every row.

    Base spans are those of the fixed patterns; the battery adds spans of kind random where no base span
    lies. A null text counts as empty: no spans, the digest of an empty string. Rows with equal ids, or
    null ids, keep their own results. An empty table gives no rows; other columns are left out. The table is
    scanned once; what it finds is written out small, and its p-values set the thresholds.
    """
    scanned = scan(docs, text, id_col).checkpoint()
    least = F.array(*map(F.lit, thresholds(scanned)))
    passed = F.filter("cand", lambda c: c["new"] & (c["p"] >= F.element_at(least, c["stratum"] + 1)))
    wider = lambda w, c: (w["start"] <= c["start"]) & (w["end"] >= c["end"]) & (w["end"] - w["start"] > c["end"] - c["start"])
    fresh = F.filter(passed, lambda c: ~F.exists(passed, lambda w: wider(w, c)))  # not the parts of what passes whole
    both = F.sort_array(F.concat("base", F.transform(fresh, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))))
    names = F.array(*map(F.lit, KINDS))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")

    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return scanned.select(
        F.col("__i").alias(id_col),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined("base"), 256).alias("base_sha256"),
        joined(both).alias("spans"),
        F.size(fresh).cast("long").alias("n_random"),
        F.array_join(F.transform(fresh, lambda c: c["encoding"]), ",").alias("encodings"),
    )


def redact_secrets(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """All rows, whatever their ids, with all columns: the spans of find_secrets replaced by their kinds. Texts are
    tested once for the thresholds and once more where they are replaced, so that rows aren't joined."""
    least = thresholds(scan(docs, text, id_col).select("cand", "decoys").checkpoint())

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([t if not t else redact(t, _spans(t, least)) for t in texts], dtype=object)

    return docs.withColumn(text, clean(text))


def _spans(text: str, least: list[float]) -> str:
    """The spans of one text, as find_secrets has them."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    classes = _CLASS[np.where(codes < 128, codes, 0)]
    base = base_spans(text, classes)
    cand = [(a, b) for a, b, enc, p, n in _candidates(codes.astype(np.int64), classes) if p >= least[stratum(enc, n)]]
    fresh, last = [], 0
    for a, neg in sorted((a, -b) for (a, b), ok in zip(cand, _apart(cand, base), strict=True) if ok):
        if -neg > last:  # parts come behind what holds them
            fresh.append((a, 3, -neg))
            last = -neg
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(base + fresh))


def redact(text: str, spans: str) -> str:
    """The text with every span (kind:start:end, comma-joined) replaced by its kind in brackets; overlapping
    spans are replaced as one, under the first one's kind."""
    merged: list[list] = []
    for part in filter(None, spans.split(",")):
        kind, a, b = part.split(":")
        if merged and int(a) < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], int(b))
        else:
            merged.append([kind, int(a), int(b)])
    out, at = [], 0
    for kind, a, b in merged:
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join(out) + text[at:]


def spans_digest(spans: list[tuple[str, int, int]]) -> str:
    """The digest of spans given in order, as base_sha256 has it."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
