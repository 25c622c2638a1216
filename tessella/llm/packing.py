"""Packing documents into sequences of fixed length (operators 2 and 3)."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from tessella.llm.encode import encoder

SEQUENCE = 2048


def cut(n: int, size: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: only a longer document is cut, its first piece may be shorter."""
    if n <= size:
        return [(0, n)]
    head = n % size
    return ([(0, head)] if head else []) + [(s, size) for s in range(head, n, size)]


class CapacityTree:
    """A segment tree over the room left in bins (0..capacity): a leaf counts the bins with that room, an
    inner node the bins below it. best(need) walks to the least room that is enough."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, n: int = 1) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += n
            i >>= 1

    def best(self, need: int) -> int:
        """The least room of at least `need` that some bin has, or -1."""
        count, i = self.count, need + self.leaves
        if count[i]:
            return need
        while i > 1:
            if not i & 1 and count[i + 1]:  # a right neighbour has bins: its leftmost leaf is wanted
                i += 1
                while i < self.leaves:
                    i *= 2
                    if not count[i]:
                        i += 1
                return i - self.leaves
            i >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], capacity: int = SEQUENCE) -> list[list[int]]:
    """Bins of item numbers: longest items first, each into the fullest bin that takes it; ties by item number."""
    tree, with_room, bins = CapacityTree(capacity), {}, []
    for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        room = tree.best(lengths[i])
        if room < 0:
            b, room = len(bins), capacity
            bins.append([])
        else:
            b = with_room[room].pop()
            tree.add(room, -1)
        bins[b].append(i)
        left = room - lengths[i]
        with_room.setdefault(left, []).append(b)
        tree.add(left)
    return bins


def pack_matrices(docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id", end_id: int = 0, size: int = SEQUENCE, window: int = 4096) -> DataFrame:
    """Packed sequences of all texts, one row each (operator 2).

    sequence_id, n_tokens, doc_ids, pieces, starts (of each segment in its document), cu_seqlens (0, then the end
    of each segment), position_resets (the places at which positions start again at 0), and ids: a matrix row of
    `size` little-endian unsigned 32-bit ids, zeros behind n_tokens.

    A task packs the documents it reads in windows of 4096 open pieces, so nothing is shuffled and memory
    doesn't grow with the table; full pieces leave at once. A window wastes less than one sequence. A null
    text counts as empty: its row is the end id alone. Repeated rows are packed as often as they come. An
    empty table gives no rows; other columns are left out. sequence_id holds the task's number and a counter,
    so a task that runs again makes the same rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"sequence_id long, n_tokens int, doc_ids array<{kind}>, pieces array<int>, starts array<long>, cu_seqlens array<int>, position_resets array<int>, ids binary"

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, task, made = encoder(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        held: list[tuple] = []

        def rows(groups: list[list[tuple]]) -> pd.DataFrame:
            nonlocal made
            out = []
            for g in groups:
                lens = [len(x[3]) // 4 for x in g]
                ends = np.cumsum([0, *lens]).tolist()
                out.append(((task << 33) + made, ends[-1], [x[0] for x in g], [x[1] for x in g], [x[2] for x in g], ends, ends[:-1], b"".join(x[3] for x in g).ljust(4 * size, b"\0")))
                made += 1
            return pd.DataFrame(out, columns=["sequence_id", "n_tokens", "doc_ids", "pieces", "starts", "cu_seqlens", "position_resets", "ids"])

        def packed(items: list[tuple]) -> list[list[tuple]]:
            return [[items[i] for i in b] for b in best_fit_decreasing([len(x[3]) // 4 for x in items], size)]

        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.iloc[lo : lo + 256]
                full = []
                for d, ids in zip(part[id_col].astype(object), enc.ids(["" if t is None else t for t in part["__t"]]), strict=True):
                    ids += end
                    for k, (s, n) in enumerate(cut(len(ids) // 4, size)):
                        (full if n == size else held).append((None if pd.isna(d) else d, k, s, ids[4 * s : 4 * (s + n)]))
                    if len(full) >= 512:
                        yield rows([[x] for x in full])
                        full = []
                if full:
                    yield rows([[x] for x in full])
                while len(held) >= window:
                    yield rows(packed(held[:window]))
                    del held[:window]
        if held:
            yield rows(packed(held))

    return docs.select(id_col, F.col(text).alias("__t")).mapInPandas(run, schema)


def unpack_matrices(packed: DataFrame) -> DataFrame:
    """(doc_id, piece, start, ids) back from packed rows."""
    seg = F.posexplode(F.arrays_zip("doc_ids", "pieces", "starts")).alias("i", "z")
    rows = packed.select("cu_seqlens", "ids", seg)
    at, to = F.element_at("cu_seqlens", F.col("i") + 1), F.element_at("cu_seqlens", F.col("i") + 2)
    return rows.select(F.col("z.doc_ids").alias("doc_id"), F.col("z.pieces").alias("piece"), F.col("z.starts").alias("start"), F.substring(F.col("ids"), at * 4 + 1, (to - at) * 4).alias("ids"))


def document_pieces(docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id", end_id: int = 0, size: int = SEQUENCE) -> DataFrame:
    """(uid, doc_id, piece, start, length, ids_crc32) of every piece; uid numbers the pieces of a task."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, uid = encoder(path), TaskContext.get().partitionId() << 33
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part, out = batch.iloc[lo : lo + 512], []
                for d, ids in zip(part[id_col].astype(object), enc.ids(["" if t is None else t for t in part["__t"]]), strict=True):
                    ids += end
                    for k, (s, n) in enumerate(cut(len(ids) // 4, size)):
                        out.append((uid, None if pd.isna(d) else d, k, s, n, zlib.crc32(memoryview(ids)[4 * s : 4 * (s + n)])))
                        uid += 1
                yield pd.DataFrame(out, columns=["uid", id_col, "piece", "start", "length", "ids_crc32"])

    return docs.select(id_col, F.col(text).alias("__t")).mapInPandas(run, f"uid long, `{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


class Grouping:
    """A grouping genetic algorithm over the bins of one block.

    A solution is the bin of each item. Crossover injects whole well-filled bins of one parent into the other,
    removes the bins that hold their items too, and best-fits the displaced items; mutation dissolves a few
    of the emptiest bins. Fitness (Falkenauer) is the mean of squared fill, which rewards full bins.
    """

    def __init__(self, lengths: list[int], capacity: int, seed: int, population: int = 4):
        self.lengths, self.capacity, self.population = lengths, capacity, population
        self.sizes = np.array(lengths, np.int64)
        self.random = np.random.default_rng(seed)

    def fill(self, b: list[int]) -> int:
        return sum([self.lengths[i] for i in b])

    def fills(self, places: np.ndarray) -> np.ndarray:
        return np.bincount(places, self.sizes).astype(np.int64)  # exact: sums are far below 2^53

    def score(self, places: np.ndarray) -> tuple[int, float]:
        fills = self.fills(places)
        return -len(fills), float(np.square(fills / self.capacity).sum()) / max(1, len(fills))

    def best_fit(self, places: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Puts items (-1 in places), longest first, each into the fullest bin that takes it; bins are numbered anew."""
        at, mine = np.flatnonzero(places >= 0), places[places >= 0]
        held = np.bincount(mine) > 0
        number = np.cumsum(held) - 1
        bins = int(held.sum())
        places = np.full(len(places), -1)
        places[at] = mine = number[mine]
        left = (self.capacity - np.bincount(mine, self.sizes[at], bins)).astype(np.int64)
        rooms: dict[int, list[int]] = {}
        mask = 0  # bit r: some bin has room r
        some = np.flatnonzero(left)  # full bins take nothing
        for k, r in zip(some.tolist(), left[some].tolist(), strict=True):
            if r in rooms:
                rooms[r].append(k)
            else:
                rooms[r] = [k]
                mask |= 1 << r
        order = items[np.argsort(-self.sizes[items], kind="stable")]
        into = []
        for n in self.sizes[order].tolist():
            above = mask >> n
            if above:
                r = n + (above & -above).bit_length() - 1
                of = rooms[r]
                k = of.pop()
                if not of:
                    del rooms[r]
                    mask ^= 1 << r
            else:
                r, k = self.capacity, bins
                bins += 1
            into.append(k)
            r -= n
            if r in rooms:
                rooms[r].append(k)
            elif r:
                rooms[r] = [k]
                mask |= 1 << r
        places[order] = into
        return places

    def crossover(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        fills = self.fills(b)
        full = np.argsort(-fills, kind="stable")[: max(1, len(fills) // 2)]
        taken = np.zeros(len(fills), bool)
        taken[full[self.random.random(len(full)) < self.random.uniform(0.1, 0.6)]] = True
        inside = taken[b]
        hit = np.zeros(int(a.max()) + 1, bool)
        hit[a[inside]] = True
        return self.open_least(np.where(inside, len(hit) + b, np.where(hit[a], -1, a)))

    def open_least(self, places: np.ndarray, share: float = 0.08) -> np.ndarray:
        """Best-fits displaced items after dissolving the emptiest bins."""
        at, mine = np.flatnonzero(places >= 0), places[places >= 0]
        fills = np.bincount(mine, self.sizes[at])
        used = np.flatnonzero(fills)
        if len(used):
            gone = np.zeros(len(fills), bool)
            gone[used[np.argsort(fills[used], kind="stable")[: max(1, int(len(used) * share))]]] = True
            places[at[gone[mine]]] = -1
        return self.best_fit(places, np.flatnonzero(places < 0))

    def run(self, patience: int, elites: list[list[list[int]]] = ()) -> list[list[int]]:
        """The best solution, from the elites and fresh solutions. The search goes on until so many generations in a row
        have brought nothing better, also when no fewer bins are possible: a better fill then gathers what room is left
        in fewer bins. Only when all bins but one are full there is nothing better."""
        n = len(self.lengths)
        if not n:
            return []
        pool = [np.array(_places(e, n), np.int64) for e in elites] or [self.best_fit(np.full(n, -1), np.arange(n))]
        while len(pool) < self.population:
            held = self.random.random(n) < 0.15  # some items wait until the others are placed
            start = self.best_fit(np.full(n, -1), np.flatnonzero(~held))
            pool.append(self.best_fit(start, np.flatnonzero(held)))
        scored = sorted(((self.score(p), p) for p in pool), key=lambda x: x[0], reverse=True)
        whole, rest = divmod(int(self.sizes.sum()), self.capacity)
        ideal = -whole - (rest > 0), (whole + (rest / self.capacity) ** 2) / (whole + (rest > 0))
        waited = 0
        while waited < patience and scored[0][0] < ideal:
            i, j = self.random.choice(len(scored), 2, replace=False).tolist()
            child = self.crossover(scored[i][1], scored[j][1])
            value = self.score(child)
            waited = 0 if value > scored[0][0] else waited + 1
            if value > scored[-1][0] and all(value != s for s, _ in scored):
                scored[-1] = (value, child)
                scored.sort(key=lambda x: x[0], reverse=True)
        return _bins(scored[0][1].tolist())


def _places(bins: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def _bins(places: Iterable[int]) -> list[list[int]]:
    out: dict[int, list[int]] = {}
    for i, k in enumerate(places):
        out.setdefault(int(k), []).append(i)
    return list(out.values())


def solve(lengths: list[int], capacity: int, seed: int, islands: int, patience: int) -> list[list[int]]:
    """The bins of a block. Each island searches until `patience` generations in a row bring nothing better; after every
    such epoch its best solution migrates to the next island of the ring. The block is settled when an epoch hasn't
    bettered the best solution, or when it has as few bins as the sum of lengths allows."""
    least, best, held, number = -(-sum(lengths) // capacity), None, [], 0
    while True:
        found = []
        for k in range(islands):
            g = Grouping(lengths, capacity, hash((seed, number, k)) & 0x7FFFFFFF)
            bins = g.run(patience, [held[k], held[k - 1]] if held else [])
            found.append((g.score(np.array(_places(bins, len(lengths)), np.int64)), bins))
        top = max(found, key=lambda x: x[0])
        if best is not None and top[0] <= best[0]:
            return best[1]
        best, held, number = top, [b for _, b in found], number + 1
        if len(best[1]) <= least:
            return best[1]


def pack_genetic(pieces: DataFrame, size: int = SEQUENCE, block: int = 6000, islands: int = 3, patience: int = 100, loose: float = 0.95, seed: int = 7) -> DataFrame:
    """Adds sequence_id and offset to pieces (operator 3).

    Pieces as long as a sequence make one each. The others are dealt by a hash of uid into blocks of about
    `block` pieces, so no source or document can make a block large. A block is one row, solved by `solve`, with no
    bound on generations. Then the loose sequences of all blocks, filled to less than `loose`, are
    dealt anew in blocks and packed once more, with the packing they had as an elite. Lengths alone are sent around.

    Columns of pieces are kept; they have to hold uid (unique) and length. An empty table gives no rows.
    """
    pieces = pieces.checkpoint()  # small rows; they are read several times and must not change in between
    columns = pieces.columns
    small = pieces.filter(F.col("length") < size)
    blocks = max(1, -(-small.count() // block))
    items = small.groupBy(F.pmod(F.xxhash64("uid"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct(*columns)).alias("items")).checkpoint()
    lengths = items.select("block", F.transform("items", lambda x: x.length).alias("lengths"))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                own = [int(x) for x in r.lengths]
                yield pd.DataFrame({"block": [r.block], "places": [_places(solve(own, size, hash((seed, r.block)) & 0x7FFFFFFF, islands, patience), len(own))]})

    # one row is a whole block: deal the rows out evenly
    best = lengths.repartition(max(1, min(blocks, 2000)), "block").mapInPandas(run, "block long, places array<int>")
    dealt = items.join(best, "block").select("block", F.explode(F.arrays_zip("items", "places")).alias("z"))
    packed = dealt.select(*(F.col(f"z.items.{c}").alias(c) for c in columns), (F.col("block") * F.lit(1 << 32) + F.col("z.places")).alias("sequence_id")).checkpoint()
    moved = _repack(packed.select("uid", "length", "sequence_id"), size, block, loose, 2 * patience, seed)
    packed = packed.join(moved, "uid", "left").withColumn("sequence_id", F.coalesce("moved_to", "sequence_id")).drop("moved_to")
    before = W.partitionBy("sequence_id").orderBy("uid").rowsBetween(W.unboundedPreceding, -1)
    packed = packed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
    full = pieces.filter(F.col("length") >= size).select(*columns, (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)


def _repack(packed: DataFrame, size: int, block: int, loose: float, patience: int, seed: int) -> DataFrame:
    """(uid, moved_to) of the pieces of loose sequences (uid, length, sequence_id). Whole sequences are dealt into blocks
    by a hash, a few to each block before; their packing is an elite, so no block takes more sequences than it had."""
    few = packed.groupBy("sequence_id").agg(F.sum("length").alias("fill")).filter(F.col("fill") < loose * size).select("sequence_id")
    pieces = packed.join(few, "sequence_id").checkpoint()
    groups = max(1, -(-pieces.count() // block))
    held = pieces.groupBy(F.pmod(F.xxhash64("sequence_id"), F.lit(groups)).alias("g")).agg(F.sort_array(F.collect_list(F.struct("uid", "length", "sequence_id"))).alias("items"))
    dealt = held.select("g", *(F.col(f"items.{c}").alias(c) for c in ("uid", "length", "sequence_id")))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                own = [int(x) for x in r.length]
                g = Grouping(own, size, hash((seed, r.g)) & 0x7FFFFFFF)
                bins = g.run(patience, [_bins(r.sequence_id), _bins(g.best_fit(np.full(len(own), -1), np.arange(len(own))))])
                yield pd.DataFrame({"uid": r.uid, "moved_to": np.array(_places(bins, len(own)), np.int64) + ((1 << 62) + (int(r.g) << 32))})

    return dealt.mapInPandas(run, "uid long, moved_to long")


def pack_documents(docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty and still has its end id. Repeated rows are packed as often as they come.
    """
    return pack_genetic(document_pieces(docs, path, text, id_col)).drop("uid")
