import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from tessella.functions import numbers as nx, text as fx
from tessella.operators import aggregates as ag, frames as fr, images, keyed as kv, kmeans as km, ranks as rk, social as so, vectors as vc, windows as wi
from tessella.sources import generators as ge, tables as ta
from tessella.streaming import queues as qu


def vec(spark, values):
    return ta.from_values(spark, values)


def listed(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_vectors(spark):
    v = vec(spark, range(10))
    assert listed(vc.copy_if(v, F.col("value") % 2 == 0, renumber=True).select("pos", "value"), "pos") == [(i, 2 * i) for i in range(5)]
    assert listed(vc.concat(v, vec(spark, range(10, 15))), "pos") == [(i, i) for i in range(15)]
    z = vc.zipped(v, vec(spark, range(10, 0, -1)))
    assert ag.reduce_all(z, F.sum(F.col("v0") + F.col("v1")).alias("s")).first().s == 100
    with pytest.raises(Exception, match="differ in size"):
        vc.zipped(v, vec(spark, range(9))).collect()
    with pytest.raises(NotImplementedError):
        vc.for_all_unsupported("set")
    assert [r.n for r in vc.parallel_ranges(spark, 0, 10, 3, lambda b, e: __import__("pandas").DataFrame({"n": [e - b]}), "n long").orderBy("n").collect()] == [2, 4, 4]


def test_index_aligned_frames(spark):
    l = spark.createDataFrame([(0, 1, 1.0), (1, 1, 2.0), (2, 2, 3.0), (3, 4, 4.0)], "pos long, idx int, a double")
    r = spark.createDataFrame([(0, 1, 10.0), (1, 2, 20.0), (2, 2, 30.0), (3, 3, 40.0)], "pos long, idx int, a double")
    assert listed(fr.index_arith(l, r, "plus").select("idx", "a"), "idx") == [(1, 11.0), (2, 23.0)]
    assert [x.a for x in fr.modify_by_idx(l, r).orderBy("pos").collect()] == [10.0, 2.0, 20.0, 4.0]
    assert fr.is_equal(l, l.orderBy(F.desc("pos"))) and not fr.is_equal(l, r)


def test_keyed(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    n = spark.createDataFrame([(2, "x"), (3, "y")], "k long, v string")
    assert listed(kv.put(t, n, "k"), "k") == [(1, "a"), (2, "x"), (3, "y")]
    assert listed(kv.try_emplace(t, n, "k"), "k") == [(1, "a"), (2, "b"), (3, "y")]
    up = spark.createDataFrame([(1, "2"), (9, "z")], "k long, d string")
    assert listed(kv.apply_on(t, up, "k", "v", F.concat("v", "d"), ""), "k") == [(1, "a2"), (2, "b"), (9, "z")]
    with pytest.raises(Exception, match="missing key"):
        kv.strict_lookup(n, t.withColumnRenamed("v", "w"), "k").collect()
    log = spark.createDataFrame([(1, 0, "p"), (1, 1, "q")], "k long, seq long, v string")
    assert kv.first_wins(log, "k", "v", ["seq"]).first().v == "p" and kv.last_wins(log, "k", "v", ["seq"]).first().v == "q"


def test_order_statistics(spark):
    v = vec(spark, [5, 3, 9, 1]).withColumnRenamed("pos", "id")
    assert [rk.find_by_order(v, n, ["value"]).select("value").collect() for n in (0, 3, 4)] == [[(1,)], [(9,)], []]
    assert listed(rk.split_median(v, ["value"]).select("value", "half"), "value") == [(1, 0), (3, 0), (5, 1), (9, 1)]
    assert rk.with_pos(v.limit(0), ["value"]).count() == 0


def test_windows(spark):
    rows = [(1, i, x) for i, x in enumerate([0.0, 4.0, 2.0, 8.0])]
    df = spark.createDataFrame(rows, "g long, i long, x double")
    want, num, den = [], 0.0, 0.0
    for _, _, x in rows:
        num, den = num * 0.5 + x, den * 0.5 + 1
        want.append(num / den)
    assert np.allclose([r.ewm for r in wi.ewm(df, "x", ["g"], ["i"]).orderBy("i").collect()], want)
    acc, want = 0.0, []
    for _, _, x in rows:
        acc = x if acc == 0 else acc * 0.9 + x * 0.1
        want.append(acc)
    assert np.allclose([r.ewma for r in wi.ewma_reset(df, "x", ["g"], ["i"]).orderBy("i").collect()], want)
    assert wi.timeline_slice(df, "g", [F.col("i")], 2, 2).count() == 0 and wi.timeline_slice(df, "g", [F.col("i")], 2, 99).count() == 2


def test_kmeans_fixed_point(spark):
    pts = spark.createDataFrame([(i, [x, y]) for i, (x, y) in enumerate([(0, 0), (1, 0), (10, 10), (11, 10)])], "id long, d array<long>")
    assert km.fit(pts, [[0, 0], [9, 9], [500, 500]]) == ([[0, 0], [10, 10], [500, 500]], 2)
    assert km._trunc(-7, 2) == -3


def test_social(spark):
    log = [(0, "follow", 0, 1), (1, "follow", 0, 2), (2, "follow", 1, 2), (3, "follow", 1, 0), (4, "follow", 2, 1), (5, "follow", 2, 0), (6, "follow", 2, 0), (7, "unfollow", 1, 0), (8, "unfollow", 1, 2), (9, "follow", 1, 0), (10, "follow", 1, 2)]
    e = so.replay(spark.createDataFrame(log, "seq long, op string, src long, dst long"))
    assert listed(so.followers(e), "user_id") == [(0, [1, 2]), (1, [0, 2]), (2, [0, 1])]
    users = ge.users(spark, 3)
    assert listed(so.login(spark.createDataFrame([("username_1", "password_1"), ("username_2", "no"), ("nobody", "x")], "username string, password string"), users).select("username", "status"), "username") == [("nobody", "NOT_REGISTERED"), ("username_1", "OK"), ("username_2", "WRONG_PASSWORD")]
    req = spark.createDataFrame([(7, 1, "username_1", "hi @username_2 see http://a.example/x and http://b.example", [5], ["png"], 0, 9)], "post_id long, user_id long, username string, text string, media_ids array<long>, media_types array<string>, post_type int, timestamp long")
    p = so.compose(req, users).first()
    assert [m.user_id for m in p.user_mentions] == [2] and len(p.urls) == 2 and p.urls[0].expanded_url == "http://a.example" and p.text == f"hi @username_2 see {p.urls[0].shortened_url}/x and {p.urls[1].shortened_url}"


def test_functions(spark):
    one = spark.range(1)
    row = one.select(
        nx.erase_at(F.array(*map(F.lit, [1, 2, 3])), 1).alias("a"),
        nx.insert_at(F.array(*map(F.lit, [1, 2])), 1, 9).alias("b"),
        nx.pop_back(F.array(*map(F.lit, [1, 2]))).alias("c"),
        nx.grow(F.array(F.lit(1)), 2, 0).alias("d"),
        nx.simple_time_text(nx.simple_time(F.lit("2020-1-02 3:4:5"))).alias("t"),
        nx.next_power_of_two(F.lit(5)).alias("p"),
        fx.unique_id(F.lit(0xABC), F.lit(1), F.lit(2)).alias("u"),
        fx.token_expired(F.lit(0), F.lit(3601)).alias("x"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.t, row.p, row.x) == ([1, 3], [1, 9, 2], [1], [1, 0, 0], "2020-1-2 3:4:5", 8, True)
    assert row.u == int("abc" + "0000000001" + "002", 16) & 0x7FFFFFFFFFFFFFFF
    token = one.select(fx.jwt_column(F.lit(1), F.lit("u"), F.lit(5), "key").alias("j")).first().j
    assert token.count(".") == 2 and token == fx.jwt({"user_id": "1", "username": "u", "timestamp": "5", "ttl": "3600"}, "key")


def test_generators(spark):
    for kind, mean, params in (("normal", 1.0, {"mean": 1.0}), ("poisson", 3.0, {"mean": 3.0}), ("exponential", 0.5, {"lambda": 2.0}), ("gamma", 6.0, {"alpha": 2.0, "beta": 3.0}), ("binomial", 5.0, {"n": 10})):
        df = ge.draw(spark, kind, 20_000, seed=1, **params)
        assert abs(df.agg(F.avg("value")).first()[0] - mean) < 0.1 * max(1, mean)
        assert df.agg(F.sum("value")).first() == ge.draw(spark, kind, 20_000, seed=1, **params).agg(F.sum("value")).first()
    assert abs(ge.symmetric_triangle(spark, 9, 2.0, True).agg(F.sum("value")).first()[0] - 1) < 1e-9
    assert ge.zipf(spark, 5000, 10, 1.2, 1).groupBy("value").count().orderBy(F.desc("count")).first().value == 0


def test_sources(spark, tmp_path):
    (tmp_path / "g.mtx").write_text("3 3 2\n1 2\n2 3\n")
    assert listed(ta.edge_list(spark, str(tmp_path / "g.mtx")), "src") == [(1, 2), (2, 3)]
    (tmp_path / "deep/er").mkdir(parents=True)
    (tmp_path / "deep/er/x.bin").write_bytes(b"abc")
    assert [bytes(r.content) for r in ta.blobs(spark, str(tmp_path / "deep")).collect()] == [b"abc"]
    px = images.prepare(np.arange(300 * 260 * 3, dtype=np.uint32).astype(np.uint8).reshape(300, 260, 3))
    assert px.shape == (224, 224, 3) and px.min() == 0 and px.max() == 1


def test_images_on_spark(spark):
    rng = np.random.default_rng(1)
    raw = [rng.integers(0, 256, (h, w, 3), dtype=np.uint8) for h, w in ((300, 260), (40, 500), (10, 10))]
    df = spark.createDataFrame([(i, x.shape[0], x.shape[1], bytearray(x.tobytes())) for i, x in enumerate(raw)], "id long, height int, width int, content binary")
    got = {r.id: np.array(r.pixels).reshape(r.height, r.width, 3) for r in images.prepare_images(df).collect()}
    for i, x in enumerate(raw):
        assert np.allclose(got[i], images.prepare(x), atol=1e-6) and got[i].shape == (min(224, x.shape[0]), min(224, x.shape[1]), 3)


def test_streams_match_batch(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("delta", T.LongType())])
    rows = [(i % 3, i // 3, i * i % 7) for i in range(60)]
    for part in (rows[:30], rows[30:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    qu.drain(qu.running_counter(qu.read_queue(spark, str(tmp_path / "in"), schema, 2), "k", "delta", 3), "counters", str(tmp_path / "c1"))
    batch = wi.running_state(spark.read.parquet(str(tmp_path / "in")), "delta", ["k"], ["seq"], 3)
    assert listed(spark.table("counters"), "key", "seq") == listed(batch.select("k", "seq", "state"), "k", "seq")
    qu.drain_to(qu.read_queue(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "c2"))
    assert kv.same_rows(spark.read.parquet(str(tmp_path / "out")), spark.read.parquet(str(tmp_path / "in")))
    path = lambda n: str(tmp_path / f"table{n}")
    qu.consume(qu.read_queue(spark, str(tmp_path / "in"), schema), str(tmp_path / "c3"), qu.merge_into(path, "k", "delta"))
    assert listed(spark.read.parquet(path(1)), "k") == [(k, max((s, d) for g, s, d in rows if g == k)[1]) for k in range(3)]
    back = spark.createDataFrame([(k, s, float(d)) for k, s, d in reversed(rows)], "k long, seq long, v double")
    back.coalesce(1).write.parquet(str(tmp_path / "in2"))
    qu.drain(qu.reorder(qu.read_queue(spark, str(tmp_path / "in2"), back.schema), "k", "v"), "ordered", str(tmp_path / "c4"))
    assert listed(spark.table("ordered"), "key", "seq") == sorted((k, s, float(d)) for k, s, d in rows)
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_kmeans_runs_until_settled(monkeypatch):
    rounds = iter(range(1, 1000))
    monkeypatch.setattr(km, "assign", lambda p, means, vector: means)
    monkeypatch.setattr(km, "update", lambda a, means, vector: [[min(next(rounds), 300)]])
    assert km.fit(None, [[0]]) == ([[300]], 301)
    turn = iter([[[1]], [[2]]] * 200)
    monkeypatch.setattr(km, "update", lambda a, means, vector: next(turn))
    with pytest.raises(RuntimeError):
        km.fit(None, [[2]])
    monkeypatch.setattr(km, "update", lambda a, means, vector: [[means[0][0] + 1]])
    with pytest.raises(RuntimeError):
        km.fit(None, [[0]], max_rounds=5)


def test_positions_of_common_prefixes_and_dominant_keys(spark):
    """Long common prefixes and one key with most of the rows: positions are whole, and no range holds most rows."""
    rows = spark.range(20_000).select(F.concat(F.lit("Customer#0000"), F.when(F.col("id") % 3 != 0, F.lit("1")).otherwise(F.col("id").cast("string"))).alias("name"), "id")
    got = rk.with_pos(rows, ["name"]).collect()
    assert [r.pos for r in sorted(got, key=lambda r: r.pos)] == list(range(20_000))
    names = [r.name for r in sorted(got, key=lambda r: r.pos)]
    assert names == sorted(names)
    down = rk.with_pos(rows, ["name", "id"], descending=True).orderBy("pos").limit(3).collect()
    assert [(r.name, r.id) for r in down] == sorted(((r.name, r.id) for r in got), reverse=True)[:3]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would else be one range
    sizes = rk.with_pos(rows, ["name"]).groupBy(F.spark_partition_id()).count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in sizes) < 10_000


def test_nth_values_against_sorting(spark):
    rng = np.random.default_rng(2)
    values = [None] * 7 + rng.normal(size=30_000).round(3).tolist() + [0.5] * 30_000
    df = spark.createDataFrame([(x,) for x in values], "v double").repartition(4)
    ordered = [None] * 7 + sorted(x for x in values if x is not None)
    for n in (0, 6, 7, 1000, 20_000, 45_000, len(values) - 1):
        (value, below), = rk.nth_values(df, "v", [n], few=500)
        assert value == ordered[n] and below == ordered.index(value), n
    assert rk.nth_values(df, "v", [len(values)]) == [] and rk.nth_values(df.limit(0), "v", [0]) == []
    assert rk.nth_values(spark.createDataFrame([("b",), ("a",), ("c",)], "v string"), "v", [1]) == [("b", 1)]
    p = ag.percentiles(df, "v", [0.25, 0.5, 0.999]).first()
    assert np.allclose(list(p), np.percentile(ordered[7:], [25, 50, 99.9]))
    assert list(ag.percentiles(df.limit(0), "v", [0.5]).first()) == [None]


def test_home_timelines_against_brute_force(spark):
    rng = np.random.default_rng(4)
    posts = [(i, int(rng.integers(0, 6)), int(rng.integers(0, 40)), rng.integers(0, 9, 2).tolist(), "t") for i in range(300)]
    edges = sorted({(int(a), int(b)) for a, b in rng.integers(0, 9, (20, 2))})
    p, e = spark.createDataFrame(posts, "post_id long, user_id long, timestamp long, mentions array<long>, text string"), spark.createDataFrame(edges, "src long, dst long")
    want = {(u, t, i) for i, a, t, ms, _ in posts for u in [s for s, d in edges if d == a] + ms}
    assert sorted(tuple(r) for r in so.fan_out(p, e).collect()) == sorted(want)
    for start, stop in ((0, 4), (2, 9), (5, 5)):
        cut = {(u, t, i) for u in range(9) for _, t, i in sorted((x for x in want if x[0] == u), key=lambda x: (-x[1], -x[2]))[start:stop]}
        assert {(r.user_id, r.timestamp, r.post_id) for r in so.read_home_timeline(p, e, start, stop).collect()} == cut
    assert so.read_home_timeline(p.limit(0), e, 0, 4).count() == 0


def test_ewma_of_a_long_key_and_none(spark):
    df = spark.range(30_000).select(F.lit(1).alias("g"), F.col("id").alias("i"), (F.col("id") % 7).cast("double").alias("x"))
    got = [r.ewma for r in wi.ewma_reset(df, "x", ["g"], ["i"]).orderBy("i").collect()]
    now, want = 0.0, []
    for i in range(30_000):
        now = i % 7 if now == 0 else now * 0.9 + (i % 7) * 0.1
        want.append(now)
    assert np.allclose(got, want) and wi.ewma_reset(df.limit(0), "x", ["g"], ["i"]).count() == 0


def test_kmeans_rounds_on_matrices(spark, monkeypatch):
    """The vectors are read once and kept as matrices; the result is that of assignment and update, also beyond 2^53."""
    rng = np.random.default_rng(8)
    for scale in (1000, 2**40):
        rows = [(i, rng.integers(-scale, scale, 6).tolist()) for i in range(300)] + [(300, None)]
        points, means = spark.createDataFrame(rows, "id long, d array<long>"), [r[1] for r in rows[:4]]
        want = means
        for _ in range(2):
            want = km.update(km.assign(points, want), want)
        one = km._rounds(points, "d", block=64)
        assert one(one(means)) == want
    monkeypatch.setattr(km, "update", None)  # not needed for integers
    assert km.fit(spark.createDataFrame([(0, [0]), (1, [3])], "id long, d array<long>"), [[0], [2]]) == ([[0], [3]], 2)


def test_queue_of_a_large_table(spark, tmp_path, monkeypatch):
    """Parts are written by several tasks, in the same number of files each, and read a part at a time."""
    from tessella.plans import interface

    monkeypatch.setattr(interface, "_FILE_ROWS", 4000)
    rows = spark.range(0, 12_000, numPartitions=4).select((F.col("id") % 40).alias("k"), F.floor(F.col("id") / 40).alias("seq"), F.col("id").cast("double").alias("value"))
    queue = interface._queue(spark, rows, "seq % 2 = 1", "seq % 2 = 0")
    sizes, out = [], str(tmp_path / "out")
    qu.consume(queue, str(tmp_path / "c1"), lambda batch, _: sizes.append((len(batch.inputFiles()), batch.count(), batch.agg(F.max(F.col("seq") % 2)).first()[0])))
    assert [s[1:] for s in sizes] == [(6000, 1), (6000, 0)]
    qu.drain_to(qu.reorder(queue, "k", "value"), out, str(tmp_path / "c2"))
    assert listed(spark.read.parquet(out), "key", "seq") == listed(rows, "k", "seq")


def test_running_counter_of_keys_cut_by_arrow_batches(spark, tmp_path):
    """A key's rows reach Python in several pieces that aren't in order; null deltas count for nothing."""
    rows = [(k if k else None, s, None if s < k or s % 9 == 8 else (s * s + k) % 7) for k in range(3) for s in range(50)]
    df = spark.createDataFrame(rows[::-1], "k long, seq long, delta long")
    for part in ("seq < 2", "seq >= 2 AND seq < 20", "seq >= 20"):
        df.filter(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    qu.drain_to(qu.running_counter(qu.read_queue(spark, str(tmp_path / "in"), df.schema), "k", "delta", 3), str(tmp_path / "out"), str(tmp_path / "c1"))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    batch = wi.running_state(df, "delta", ["k"], ["seq"], 3)
    assert listed(spark.read.parquet(str(tmp_path / "out")).select("key", "seq", "state"), "key", "seq") == listed(batch.select("k", "seq", "state"), "k", "seq")


@pytest.mark.parametrize("ids", [[*range(200)], [i // 5 * 3 - 40 for i in range(200)], [None, *range(30), None, None, 7, 7], [None] * 70, []])
def test_running_counter_of_odd_events(spark, tmp_path, ids):
    """Ids more than once (also where the queue's parts meet), negative ids, none, and no events at all."""
    import duckdb

    from tessella.plans.catalog import CATALOG
    from tests.oracle import rows_of, rows_of_sql

    rows = [(x, [1, 1, 1, 2, None][i % 5] if len(ids) > 100 else i % 2, float(i)) for i, x in enumerate(ids)]
    spark.createDataFrame(rows[::-1], "event_id long, user_id long, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    f, sql = CATALOG["stream_running_counter"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    got = rows_of(f(spark, str(tmp_path)))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == rows_of_sql(con, sql)


def test_kmeans_of_wide_and_null_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.integers(-1000, 1000, 50).tolist()) for i in range(500)] + [(500, None)]
    means = [rows[k][1] for k in range(20)]
    got = dict(km.assign(spark.createDataFrame(rows, "id long, d array<long>"), means).select("id", "cluster").collect())
    x, m = np.array([r[1] for r in rows[:500]], float), np.array(means, float)
    assert got.pop(500) is None and list(got[i] for i in range(500)) == np.square(x[:, None] - m[None]).sum(axis=2).argmin(axis=1).tolist()
    assert km.update(km.assign(spark.createDataFrame([(1, None)], "id long, d array<long>"), [[1, 2]]), [[1, 2]]) == [[1, 2]]
