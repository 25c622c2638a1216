"""Near duplicates by sketches, bands and exact verification (operator 9)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from tessella.llm.components import components
from tessella.llm.names import free_name
from tessella.llm.shingles import bands, shingle_sets, sketch

#: 30 bands of 6 coordinates: two sets with similarity 0.85 share no band with probability 7e-7.
BANDS, ROWS = 30, 6
#: Up to so many candidate ids (8 bytes each) are broadcast to the second scan; beyond that it is a shuffled join.
BROADCAST_IDS = 500_000
#: Members of a centre's component that those outside it are compared with, before all members are.
EXTRA = 8
#: Members, and members outside the centre's component, that a task compares at a time.
BLOCK_MEMBERS, BLOCK_OUTSIDE = 512, 256
#: What a text needs to have a shingle: a sign that isn't white space.
WORD = r"[^\x20\x09-\x0D]"


def _keyed(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """(node, __i, __t): every row with the key that stands for its id and text. Rows of one key are repeated rows; two
    of n different rows share one with a probability of n^2 / 2^65, and would be taken for one."""
    return docs.select(F.xxhash64(F.col(id_col), F.col(text)).alias("node"), F.col(id_col).alias("__i"), F.col(text).alias("__t"))


def fingerprints(docs: DataFrame, text: str, id_col: str, width: int = 5) -> DataFrame:
    """(node, id, n_shingles, digest of the set, bands) of every row."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for s in shingle_sets(list(b["__t"]), width):
                if len(s):
                    rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), bands(sketch(s, BANDS * ROWS), ROWS).view(np.int64)))
                else:
                    rows.append((0, None, None))
            yield pd.DataFrame({"node": b["node"], "id": b["__i"], "n_shingles": [r[0] for r in rows], "digest": [r[1] for r in rows], "bands": [r[2] for r in rows]})

    kind = docs.schema[id_col].dataType.simpleString()
    return _keyed(docs, text, id_col).mapInPandas(run, f"node long, id {kind}, n_shingles long, digest binary, bands array<long>")


def _sets(keyed: DataFrame, width: int) -> DataFrame:
    """(node, items) of the rows of (node, __t), each node once."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: set[int] = set()
        for b in batches:
            fresh = b[[x not in done for x in b["node"]]].drop_duplicates("node")
            done.update(fresh["node"])
            for lo in range(0, len(fresh), 256):
                part = fresh.iloc[lo : lo + 256]
                yield pd.DataFrame({"node": part["node"], "items": [np.sort(s.view(np.int64)) for s in shingle_sets(list(part["__t"]), width)]})

    return keyed.select("node", "__t").mapInPandas(run, "node long, items array<long>").dropDuplicates(["node"])


def _block_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between a bucket's members outside its centre's component and all its members of other
    components. A bucket is cut into a grid of blocks, so neither a bucket nor its pairs meet in one place;
    a block gives out confirmed links only, and of these as many as join its components (a forest)."""
    rest = members.filter("node <> center")
    sizes = rest.groupBy("bucket").agg(F.count("*").alias("n"), F.sum((F.col("component") != F.col("main")).cast("long")).alias("o")).filter("o > 0 AND n > 1")
    blocks = lambda n, size: F.ceil(F.col(n) / size).cast("long")
    rows = rest.join(sizes.select("bucket", blocks("n", BLOCK_MEMBERS).alias("nm"), blocks("o", BLOCK_OUTSIDE).alias("no")), "bucket")
    own_m, own_o = F.pmod(F.xxhash64("node"), F.col("nm")), F.pmod(F.xxhash64("node"), F.col("no"))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    asked = rows.filter("component <> main").select("bucket", "node", "component", F.lit(True).alias("asks"), own_o.alias("o"), F.explode(every("nm")).alias("m"))
    held = rows.select("bucket", "node", "component", F.lit(False).alias("asks"), own_m.alias("m"), F.explode(every("no")).alias("o"))
    whole = asked.unionByName(held).join(sets, "node")

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        asks = g["asks"].to_numpy()
        ids, comps, items = g["node"].to_numpy()[~asks], g["component"].to_numpy()[~asks], [np.asarray(x) for x in g["items"][~asks]]
        out, joined = [], {}

        def root(x: int) -> int:
            while x in joined:
                x = joined[x]
            return x

        if items and asks.any():
            size = np.array([len(x) for x in items])
            flat, starts = np.concatenate(items), np.concatenate([[0], np.cumsum(size)[:-1]])
            for i, c, x in zip(g["node"][asks], g["component"][asks], g["items"][asks], strict=True):
                x = np.asarray(x)
                at = np.minimum(np.searchsorted(x, flat), len(x) - 1)
                common = np.add.reduceat((x[at] == flat).astype(np.int64), starts)
                near = (common * 100 >= (size + len(x) - common) * percent) & (comps != c)
                for j, other in zip(ids[near], comps[near], strict=True):
                    p, q = root(c), root(other)
                    if p != q:
                        joined[p] = q
                        out.append((i, j))
        return pd.DataFrame(out, columns=["a", "b"])

    return whole.groupBy("bucket", "m", "o").applyInPandas(compare, "a long, b long").distinct()


def _groups(docs: DataFrame, text: str, id_col: str, percent: int, width: int, nameless: bool) -> tuple[DataFrame, DataFrame]:
    """Rows (node, id, n_shingles, digest) and, for every digest of a set, its group (digest, group, id): a node that
    stands for the group, and the least id with that digest. Rows without id take part only if `nameless`."""
    prints = fingerprints(docs, text, id_col, width)
    if not nameless:
        prints = prints.withColumn("digest", F.when(F.col("id").isNotNull(), F.col("digest")))
    prints = prints.checkpoint()
    groups = prints.filter("digest IS NOT NULL").groupBy("digest").agg(F.min(F.struct("node", "n_shingles", "bands")).alias("r"), F.min("id").alias("id"))
    reps = groups.select("digest", "id", "r.node", "r.n_shingles", "r.bands")
    placed = reps.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = placed.join(shared, "bucket").checkpoint()
    weight = members.groupBy("node").agg(F.sum("n").alias("weight"))
    members = members.join(weight, "node").checkpoint()
    wanted = members.select("node").distinct().checkpoint()
    found = _keyed(docs, text, id_col).join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "node", "left_semi")
    sets = _sets(found, width).checkpoint()

    def links(pairs: DataFrame) -> DataFrame:
        near = pairs.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).select("a", "b").distinct()
        left = sets.select(F.col("node").alias("a"), F.col("items").alias("sa"))
        right = sets.select(F.col("node").alias("b"), F.col("items").alias("sb"))
        both = near.join(left, "a").join(right, "b")
        common = F.size(F.array_intersect("sa", "sb"))
        return both.filter(common * 100 >= (F.size("sa") + F.size("sb") - common) * percent).select("a", "b")

    center = members.groupBy("bucket").agg(F.max(F.struct("weight", "node", "n_shingles")).alias("c")).select("bucket", F.col("c.node").alias("a"), F.col("c.n_shingles").alias("na"))
    star = members.join(center, "bucket").select("a", "na", F.col("node").alias("b"), F.col("n_shingles").alias("nb")).filter("a <> b")
    first = links(star).checkpoint()
    labels = components(first)

    def state(found: DataFrame) -> DataFrame:
        """Members with their component, and with the bucket's centre and its component."""
        held = members.select("bucket", "node", "n_shingles").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        main = center.select("bucket", F.col("a").alias("node")).join(found, "node", "left").select("bucket", F.coalesce("component", "node").alias("main"), F.col("node").alias("center"))
        return held.join(main, "bucket")

    # members outside the centre's component meet some more of its members; each is a grouping, not a ranking
    open_ = state(labels).checkpoint()
    outside = open_.filter("component <> main").select("bucket", F.col("node").alias("b"), F.col("n_shingles").alias("nb"))
    inside = open_.filter("component = main AND node <> center")
    picks = inside.groupBy("bucket").agg(F.array(*(F.min_by(F.struct(F.col("node").alias("a"), F.col("n_shingles").alias("na")), F.xxhash64("node", F.lit(k))) for k in range(EXTRA))).alias("p"))
    more = outside.join(picks, "bucket").select("b", "nb", F.explode(F.array_distinct("p")).alias("p")).select("p.a", "p.na", "b", "nb")
    second = first.unionByName(links(more)).checkpoint()
    labels = components(second)

    # what is still outside is compared with all other members of its buckets, in blocks inside tasks
    final = second.unionByName(_block_links(state(labels).checkpoint(), sets, percent))
    of_digest = reps.select("digest", "id", "node").join(components(final), "node", "left")
    return prints.drop("bands"), of_digest.select("digest", "id", F.coalesce("component", "node").alias("group"))


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", percent: int = 85, width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Rows are linked when 100 * |intersection| >= percent * |union| of their shingle sets. Equal sets meet by
    a digest first, so copies cost one row per task. Of the other sets those in a common band are
    candidates; each bucket is a star around its best connected member. Members that the star leaves in
    another component meet eight more members of the star, and those still outside meet all other
    members, in blocks. Every link is confirmed on full sets. Work on the sets is limited to candidates.

    Ids may be of any type that can be ordered. A null or empty text, or one of white space, has no shingles and is
    linked with nothing. Rows that share an id but not a text are linked each by its own text; rows with a null id are
    linked with nothing and kept. Other columns are left out. An empty table gives no rows.
    """
    rows, groups = _groups(docs, text, id_col, percent, width, nameless=False)
    groups = groups.checkpoint()
    least = groups.groupBy("group").agg(F.min("id").alias("component_id"))
    named = groups.join(least, "group").select("digest", "component_id")
    out = rows.join(named, "digest", "left").select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", percent: int = 85, width: int = 5) -> DataFrame:
    """One row of each group of near duplicates, with all columns: that with the least id (null ids come last).

    Every row counts by its own text, whatever its id: rows of one id may fall into different groups, rows without id
    are grouped like all others, and of repeated rows one stays. Texts without words are in no group, and all stay.
    """
    rows, groups = _groups(docs, text, id_col, percent, width, nameless=True)
    # copies of one set meet before the join, one row per task
    least = rows.filter("digest IS NOT NULL").groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "node")).alias("r"))
    first = least.join(groups.select("digest", "group"), "digest").groupBy("group").agg(F.min("r").alias("r")).select("r.node")
    key, blank = free_name(docs, "node"), ~F.coalesce(F.col(text).rlike(WORD), F.lit(False))
    keyed = docs.filter(~blank).withColumn(key, F.xxhash64(F.col(id_col), F.col(text)))
    kept = keyed.join(first.withColumnRenamed("node", key), key, "left_semi").dropDuplicates([key]).drop(key)
    return kept.unionByName(docs.filter(blank))
