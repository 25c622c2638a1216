import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tessella.llm import neardup, quality, queries, toxicity
from tessella.llm.components import components
from tessella.llm.labelmodel import LabelModel, fit_linear

DIR = "/root/testdata/sf0.01"


@pytest.fixture(autouse=True)
def checkpoints(spark):
    queries._prepare(spark)


def brute_components(rows, percent=85):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent, holders = {i: i for i in sets}, {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        met = {}
        for x in s:
            for j in holders.setdefault(x, []):
                met[j] = met.get(j, 0) + 1
            holders[x].append(i)
        for j, n in met.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def same_as_brute(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_on_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    same_as_brute(spark, rows)


def test_near_duplicates_in_a_crowd(spark):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(150)]
    rows = [(i, " ".join(base)) for i in range(40)]
    for i in range(40, 240):
        t = list(base)
        for k in rng.integers(0, 150, rng.integers(1, 6)):
            t[k] = f"x{i}-{k}"
        rows.append((i, " ".join(t)))
    rows += [(300, None), (301, ""), (302, " \n"), (303, "a B"), (304, "A b"), (305, "é É"), (306, "É é")]
    same_as_brute(spark, rows)


def test_near_duplicates_edge_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    rows = neardup.near_duplicates(df.selectExpr("*", "1 AS component_id", "2 AS bucket")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in rows) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_of_any_ids(spark):
    """Ids of text; ids with different texts; a dense group away from its bucket's centre; columns with internal names."""
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    df = spark.createDataFrame([("y", a), ("x", a + " more"), ("z", b), ("x", b), (None, a), ("w", None)], "doc_id string, text string")
    rows = neardup.near_duplicates(df.selectExpr("*", "1 AS node", "2 AS digest", "3 AS __i")).collect()
    assert sorted((r.doc_id or "", r.n_shingles, r.component_id or "", r.kept) for r in rows) == [
        ("", 56, "", True), ("w", 0, "w", True), ("x", 56, "x", True), ("x", 57, "x", True), ("y", 56, "x", False), ("z", 56, "x", False)
    ]
    left = neardup.drop_near_duplicates(df.selectExpr("*", "1 AS node", "2 AS digest"))
    assert left.columns == ["doc_id", "text", "node", "digest"]
    assert sorted((r.doc_id, r.text or "") for r in left.collect()) == [("w", ""), ("x", a + " more"), ("x", b)]
    many = df.unionByName(df).unionByName(df.limit(0)).unionByName(spark.createDataFrame([(None, "c d"), (None, "c d")], df.schema))
    assert sorted((r.doc_id or "", r.text or "") for r in neardup.drop_near_duplicates(many).collect()) == [("", "c d"), ("w", ""), ("w", ""), ("x", a + " more"), ("x", b)]
    assert neardup.drop_near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(1, 7), (7, 3)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {k: 100 for k in range(100, 161)} | {1: 1, 7: 1, 3: 1}


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(4)
    y = rng.random(20000) < 0.3
    right = np.array([0.95, 0.85, 0.75, 0.65])
    votes = np.where(rng.random((20000, 4)) < right, y[:, None], ~y[:, None]).astype(int)
    votes = np.concatenate([votes, votes[:, 2:3]], axis=1)  # a voter that repeats another one
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    m = LabelModel(2).fit(patterns, counts.astype(float), patterns.mean(axis=1))
    assert m.correlation[2, 4] > 0.9 and m.weight[4] < 0.7
    assert abs(m.accuracies()[0] - 0.95) < 0.1
    assert ((m.posterior(votes) > 0.5) == y).mean() > 0.85


def test_label_model_against_brute_force():
    """Row by row, in plain Python: expectation maximisation of voters that may abstain, weights by correlation left out."""
    rng = np.random.default_rng(8)
    y = rng.random(4000) < 0.7
    right, gives = np.array([0.95, 0.9, 0.8, 0.7]), np.array([0.9, 0.6, 0.9, 0.5])
    votes = np.where(rng.random((4000, 4)) < right, y[:, None], ~y[:, None]) * 2
    votes = np.where(rng.random((4000, 4)) < gives, votes, 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    start = np.where((patterns == 0).sum(axis=1) > 0, 0.1, 0.9)
    m = LabelModel(3, rounds=30, outer=1, abstain=1)
    m._share = lambda *_: None
    m.fit(patterns, counts.astype(float), start)
    post = {tuple(p): s for p, s in zip(patterns.tolist(), start, strict=True)}
    for _ in range(31):
        chance = np.zeros((2, 4, 3))
        total = [0.0, 0.0]
        for v in votes.tolist():
            p = post[tuple(v)]
            for label, w in ((0, 1 - p), (1, p)):
                total[label] += w
                for i, x in enumerate(v):
                    if x != 1:
                        chance[label, i, x] += w
        chance[:, :, [0, 2]] += 0.5
        chance /= chance.sum(axis=2, keepdims=True)
        prior = (total[1] + 1) / (sum(total) + 2)
        for v in post:
            z = np.log(prior / (1 - prior)) + sum(np.log(chance[1, i, x] / chance[0, i, x]) for i, x in enumerate(v) if x != 1)
            post[v] = 1 / (1 + np.exp(-z))
    assert np.allclose(m.posterior(patterns), list(post.values()), atol=0.02)
    assert np.allclose(m.chance[1, :, 2], right, atol=0.06) and abs(m.prior - 0.7) < 0.03


def test_linear_fit():
    rows = [np.array([i % 2]) for i in range(100)]
    w, b = fit_linear(rows, [np.ones(1)] * 100, np.array([float(i % 2) for i in range(100)]), 2)
    assert w[1] + b > 1 and w[0] + b < -1


def labels():
    return duckdb.connect().execute(f"SELECT * FROM '{DIR}/labels.parquet'").df()


def test_quality_against_labels(spark):
    df = spark.read.parquet(f"{DIR}/documents.parquet")
    m = quality.classify_quality(df).toPandas().merge(labels(), on="doc_id")
    assert len(m) == len(labels())
    assert m[m.quality == 1].kept.mean() > 0.98 and (~m[m.quality == 0].kept).mean() > 0.95
    odd = spark.createDataFrame([(1, None, 1), (2, "", 2), (None, "hello there", 3), (2, "x" * 9000, 3)], "doc_id long, text string, score int")
    rows = quality.classify_quality(odd).collect()
    assert len(rows) == 4 and not any(r.kept for r in rows if r.doc_id == 1)
    assert quality.classify_quality(odd.limit(0)).count() == 0


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    df, lab = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.classify_toxicity(df, lab)
    m = got.join(lab, "doc_id").filter("held_out").toPandas()
    assert len(m) > 500 and (m.predicted == m.toxic).mean() > 0.97
    assert m[m.toxic == 1].score.mean() > m[m.toxic == 0].score.mean() + 0.5


def test_toxicity_does_not_look_at_held_out_labels(spark):
    df, lab = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    from pyspark.sql import functions as F

    turned = lab.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r.doc_id, round(r.score, 9)) for r in toxicity.classify_toxicity(df, x).collect()) for x in (lab, turned))
    assert a == b


def test_toxicity_edge_tables(spark):
    odd = spark.createDataFrame([(1, None, 1), (None, "idiot", 2), (2, "", 3), (2, "", 3)], "doc_id long, text string, score int")
    lab = spark.createDataFrame([(1, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.classify_toxicity(odd, lab).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.classify_toxicity(odd.limit(0), lab.limit(0)).count() == 0


def test_very_long_texts(spark):
    """A text of a million characters, with and without spaces, in the operators that score or link."""
    words, one = "river stone " * 90_000, "x" * 1_000_000
    df = spark.createDataFrame([(1, words, 1), (2, words, 2), (3, one, 3), (4, one + "y", 4)], "doc_id long, text string, kept int")
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert not any(r.kept for r in quality.classify_quality(df).collect())
    lab = spark.createDataFrame([(k, k % 2) for k in range(1, 5)], "doc_id long, toxic int")
    assert len(toxicity.classify_toxicity(df, lab).collect()) == 4


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DIR).checkpoint()
        assert docs.columns == columns
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    good, near = kept["quality"], kept["near_duplicates"]
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect() if r.doc_id in good]
    assert near == {i for i, (_, c) in brute_components(rows).items() if i == c}
    assert not docs.filter(r"text RLIKE '[0-9a-f]{24,}'").count()
    packed = corpus_pipeline.run(spark, DIR)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == kept["secrets"]


def test_stages_on_empty_tables_and_clashing_columns(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    clash = docs.limit(300).selectExpr("*", "1 AS spans", "2 AS __k", "3 AS node", "4 AS before", "5 AS __t", "6 AS __i", "7 AS uid", "8 AS block").checkpoint()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), DIR).count() == 0
        left = stage(spark, clash, DIR)
        assert left.columns == clash.columns and 0 < left.count() <= 300 and left.filter("spans <> 1 OR `__k` <> 2 OR before <> 4").count() == 0
    assert corpus_pipeline.pack(spark, docs.limit(0), DIR).count() == 0
    assert corpus_pipeline.pack(spark, clash, DIR).select("doc_id").distinct().count() == 300


def test_stages_on_null_and_repeated_ids(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    item = spark.read.parquet(f"{DIR}/benchmark.parquet").first().text
    for stage, texts, wanted in (
        (corpus_pipeline.quality, ["", ""], []),
        (corpus_pipeline.near_duplicate, ["", "one two three four five six seven"], ["", "", "one two three four five six seven"]),
        (corpus_pipeline.decontaminate, [item, "nothing here"], ["nothing here"] * 2),
        (corpus_pipeline.secrets, ["a token=abcdef1 b", "first token=abcdef2 end", "none"], ["a [assign] b", "first [assign] end", "none"] * 2),
    ):
        good = docs.limit(400) if stage is corpus_pipeline.quality else docs.limit(40)
        odd = docs.limit(1).crossJoin(spark.createDataFrame([(i, t) for i in (None, -5) for t in texts], "i long, t string"))
        rows = good.unionByName(odd.withColumn("doc_id", odd["i"]).withColumn("text", odd["t"]).drop("i", "t")).checkpoint()
        left = stage(spark, rows, DIR).filter("doc_id IS NULL OR doc_id = -5").collect()
        assert sorted(r.text for r in left) == sorted(wanted), stage
        assert stage is not corpus_pipeline.secrets or all(r.n_chars == len(r.text) for r in left if "[" in r.text)
