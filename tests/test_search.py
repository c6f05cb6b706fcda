"""Exact, quantized and graph search against numpy, padding, filters and error paths."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import vectors as V
from lodestone.operators import evaluate
from lodestone.operators.exact import ExactIndex
from lodestone.operators.hnsw import Graph, HnswIndex, even_positions, even_sample, levels, splitmix
from lodestone.operators.pq import PqIndex, kmeans, nearest
from lodestone.operators.topk import wide
from lodestone.session import stage
from lodestone.types import FLOAT32_MAX, HnswParams, Metric, PqParams

L2, IP = Metric.L2, Metric.INNER_PRODUCT


def gauss(n, dim, seed, unit=True):
    x = np.random.default_rng(seed).standard_normal((n, dim)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True) if unit else x


def frame(spark, x, id_col="vec_id", vec_col="embedding"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{id_col} long, {vec_col} array<float>")


def asked(spark, q):
    return frame(spark, q, "query_id", "query")


def truth(x, q, k, metric, keep=None):
    keys = V.keys_matrix(q, x, metric)
    if keep is not None:
        keys[:, ~keep] = np.inf
    return np.argsort(keys, axis=1, kind="stable")[:, :k]


def ids_of(found, nq, k):
    out = np.full((nq, k), -1)
    for r in found.collect():
        out[r["query_id"], r["rank"] - 1] = r["vec_id"]
    return out


def hit_rate(found, want):
    return np.mean([len(set(a) & set(b)) / len(b) for a, b in zip(found, want)])


@pytest.fixture(scope="module")
def data(spark):
    x, q = gauss(1500, 32, 0), gauss(40, 32, 3)
    return x, q, stage(frame(spark, x)), stage(asked(spark, q))


# -- parameters -------------------------------------------------------------------


def test_metric_names():
    assert Metric.of("L2") is L2 and Metric.of("InnerProduct") is IP and Metric.of(IP) is IP
    for bad in ("cosine", None, ""):
        with pytest.raises(ValueError):
            Metric.of(bad)
    assert L2.pad_score == FLOAT32_MAX and IP.pad_score == -FLOAT32_MAX and L2.natural(4.0) == 2.0 and IP.natural(-3.0) == 3.0


@pytest.mark.parametrize("make", [
    lambda: HnswParams(m=1), lambda: HnswParams(ef_construction=0), lambda: HnswParams(ef_search=0), lambda: PqParams(m=0), lambda: PqParams(nbits=0), lambda: PqParams(nbits=9), lambda: PqParams(m=3).sub_dim(64),
    lambda: PqParams().sample_rows(255), lambda: ExactIndex(0), lambda: ExactIndex(-3), lambda: HnswIndex(8, shards=0),
])
def test_bad_parameters_raise(make):
    with pytest.raises(ValueError):
        make()


def test_pq_sample_is_clamped():
    assert PqParams(train_sample=50).sample_rows(4000) == 256 and PqParams(train_sample=0).sample_rows(999) == 999 and PqParams(train_sample=10_000).sample_rows(999) == 999
    assert HnswParams(m=12).m_max0 == 24 and HnswIndex.shards_for(0) == 1 and HnswIndex.shards_for(45_000) == 3


# -- kernels ------------------------------------------------------------------------


def test_column_kernels_match_numpy(spark):
    a, b = gauss(20, 13, 1, False), gauss(20, 13, 2, False)
    df = spark.createDataFrame([(x.tolist(), y.tolist()) for x, y in zip(a, b)], "a array<float>, b array<float>")
    rows = df.select(V.squared_l2(F.col("a"), F.col("b")), V.inner_product(F.col("a"), F.col("b")), V.norm(F.col("a")), V.normalize(F.col("a"))).collect()
    for r, x, y in zip(rows, a.astype(float), b.astype(float)):
        assert r[0] == pytest.approx(((x - y) ** 2).sum()) and r[1] == pytest.approx(x @ y) and r[2] == pytest.approx(np.linalg.norm(x))
        assert np.allclose(r[3], x / np.linalg.norm(x))


def test_kernels_reject_ragged_and_pass_null(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0])], "a array<float>, b array<float>")
    with pytest.raises(Exception, match="differ in length"):
        df.select(V.inner_product(F.col("a"), F.col("b"))).collect()
    none = spark.createDataFrame([(None, [1.0])], "a array<float>, b array<float>")
    assert none.select(V.squared_l2(F.col("a"), F.col("b"))).first()[0] is None


@given(st.lists(st.one_of(st.floats(width=32), st.just(float("nan"))), max_size=4))
@settings(max_examples=40, deadline=None)
def test_array_check_agrees_with_finiteness(v):
    ok = len(v) == 3 and np.isfinite(np.array(v, np.float32)).all()
    if ok:
        assert V.check_array(np.array([v]), 3).shape == (1, 3)
    else:
        with pytest.raises(ValueError):
            V.check_array(np.array([v], np.float32), 3)


def test_strided_arrays_are_copied(spark):
    x = gauss(20, 16, 4)
    for odd in (np.asfortranarray(x), np.repeat(x, 2, axis=1)[:, ::2]):
        i = ExactIndex(16, L2).add_array(spark, odd)
        assert ids_of(i.search(asked(spark, x[:5]), 1), 5, 1).ravel().tolist() == list(range(5))


# -- exact ---------------------------------------------------------------------------


@pytest.mark.parametrize("metric", [L2, IP])
def test_exact_equals_numpy(data, metric):
    x, q, vecs, asks = data
    i = ExactIndex(32, metric, vecs)
    want = truth(x, q, 10, metric)
    got = i.search(asks, 10)
    assert (ids_of(got, 40, 10) == want).all()
    scores = {(r["query_id"], r["rank"]): r["score"] for r in got.collect()}
    s = np.linalg.norm(x[want[0, 0]] - q[0]) if metric is L2 else x[want[0, 0]] @ q[0]
    assert scores[0, 1] == pytest.approx(float(s), abs=1e-4)
    assert (ids_of(i.search_columns(asks.where("query_id < 8"), 10), 40, 10)[:8] == want[:8]).all()
    one = i.search_one(q[3], 10).orderBy("rank").collect()
    assert [r["vec_id"] for r in one] == want[3].tolist()


@pytest.mark.parametrize("metric", [L2, IP])
def test_large_query_sets_meet_the_table_in_a_grid(data, monkeypatch, metric):
    from lodestone.operators import blocks

    x, q, vecs, asks = data
    monkeypatch.setattr(blocks, "QUERY_BLOCK", 7)
    monkeypatch.setattr(blocks, "CELL_QUERIES", 15)
    monkeypatch.setattr(blocks, "CELL_ROWS", 400)
    assert (ids_of(ExactIndex(32, metric, vecs).search(asks, 5), 40, 5) == truth(x, q, 5, metric)).all()
    assert (ids_of(ExactIndex(32, metric, vecs).search(asks, 5, where=F.col("vec_id") % 2 == 0), 40, 5) == truth(x, q, 5, metric, np.arange(len(x)) % 2 == 0)).all()
    pq = PqIndex(32, metric, PqParams(m=8, train_iters=3)).train(vecs).add(vecs)
    pq.codes = stage(pq.codes)
    grid = sorted((r["query_id"], r["rank"], round(r["score"], 9)) for r in pq.search(asks, 5).collect())
    near = ExactIndex(32, metric, vecs).within(asks, 1.1 if metric is L2 else 0.4).count()
    monkeypatch.undo()
    assert grid == sorted((r["query_id"], r["rank"], round(r["score"], 9)) for r in pq.search(asks, 5).collect())
    assert near == ExactIndex(32, metric, vecs).within(asks, 1.1 if metric is L2 else 0.4).count()
    assert ExactIndex(32, metric, vecs).search(asks.limit(0), 5).count() == 0


def test_masks_must_cover_the_table(spark, data):
    x, q, vecs, asks = data
    short = spark.createDataFrame([(i, i % 2 == 0) for i in range(1000)], "vec_id long, keep boolean")
    index = HnswIndex(32, IP, HnswParams(m=6, ef_construction=30)).add(vecs.where("vec_id < 1200")).staged()
    for i in (ExactIndex(32, IP, vecs), index):
        with pytest.raises(Exception, match="mask lacks"):
            i.search(asks, 5, mask=short).collect()
        with pytest.raises(ValueError, match="flags for"):
            i.search(asks, 5, mask=[True] * 10)
        got = i.search(asks, 5, mask=short, absent="drop")
        assert got.where("vec_id % 2 = 1 or vec_id >= 1000").count() == 0 and got.count() == 200
    flags = np.arange(len(x)) % 3 == 0
    assert (ids_of(ExactIndex(32, L2, vecs).search(asks, 5, mask=flags), 40, 5) == truth(x, q, 5, L2, flags)).all()
    with pytest.raises(ValueError):
        ExactIndex(32, L2, vecs).search(asks, 5, mask=short, absent="keep")


def test_extreme_lengths_are_ranked_exactly(spark):
    r = np.random.default_rng(3)
    for scale in (1e-12, 1.0, 1e12, 1e18):
        x, q = (scale * r.standard_normal((n, 8))).astype(np.float32) if (n := 300) else None, (scale * r.standard_normal((3, 8))).astype(np.float32)
        for metric in (L2, IP):
            assert (ids_of(ExactIndex(8, metric, frame(spark, x)).search(asked(spark, q), 4), 3, 4) == truth(x, q, 4, metric)).all()


@pytest.mark.parametrize("metric", [L2, IP])
def test_filters(spark, data, metric):
    x, q, vecs, asks = data
    keep = np.random.default_rng(1).random(len(x)) < 0.2
    mask = spark.createDataFrame([(int(i), bool(k)) for i, k in enumerate(keep)] + [(3, None), (5, bool(keep[5]))], "vec_id long, keep boolean")
    i = ExactIndex(32, metric, vecs)
    assert (ids_of(i.search(asks, 5, mask=mask), 40, 5) == truth(x, q, 5, metric, keep)).all()
    even = np.arange(len(x)) % 2 == 0
    assert (ids_of(i.search(asks, 5, where=F.col("vec_id") % 2 == 0), 40, 5) == truth(x, q, 5, metric, even)).all()
    none = i.search(asks, 5, where=F.lit(False), padded=True).collect()
    assert len(none) == 200 and {r["vec_id"] for r in none} == {-1} and {r["score"] for r in none} == {metric.pad_score}


def test_padding_zero_k_and_ties(spark):
    i = ExactIndex(4, L2, frame(spark, np.eye(3, 4, dtype=np.float32)))
    got = i.search(asked(spark, np.zeros((1, 4), np.float32)), 5, padded=True).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [0, 1, 2, -1, -1] and got[3]["score"] == FLOAT32_MAX
    assert i.search(asked(spark, np.zeros((2, 4), np.float32)), 0, padded=True).count() == 0
    with pytest.raises(ValueError):
        i.search(asked(spark, np.zeros((1, 4), np.float32)), -1)
    w = wide(i.search(asked(spark, np.zeros((1, 4), np.float32)), 2)).first()
    assert w["ids"] == [0, 1] and len(w["scores"]) == 2


def test_incremental_add_and_introspection(spark):
    x = gauss(30, 8, 5)
    i = ExactIndex(8, IP)
    assert len(i) == 0 and i.memory_bytes == 0
    with pytest.raises(ValueError):
        i.search(asked(spark, x[:1]))
    i.add_array(spark, x[:10]).add_array(spark, x[10:])
    assert len(i) == 30 and i.memory_bytes == 30 * 8 * 4
    assert ids_of(i.search(asked(spark, x), 1), 30, 1).ravel().tolist() == list(range(30))


@pytest.mark.parametrize("bad", [[1.0, 2.0], [float("nan")] * 4, [float("inf"), 0.0, 0.0, 0.0], None, [None, 1.0, 1.0, 1.0]])
def test_invalid_vectors_fail_and_are_never_dropped(spark, bad):
    df = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0]), (1, bad)], "vec_id long, embedding array<float>")
    q = asked(spark, np.eye(1, 4, dtype=np.float32))
    for run in (lambda: ExactIndex(4, L2, df).search(q).collect(), lambda: ExactIndex(4, L2, df).search_one([1, 0, 0, 0]).collect()):
        with pytest.raises(Exception):
            run()
    bad_q = df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    with pytest.raises(ValueError):
        ExactIndex(4, L2, df.where("vec_id = 0")).search(bad_q)
    assert df.where(V.is_valid(F.col("embedding"), 4)).count() == 1


def test_radius(data):
    x, q, vecs, asks = data
    d = np.sqrt(V.keys_matrix(q, x, L2))
    got = ExactIndex(32, L2, vecs).within(asks, 1.1).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in got} == {i: int(n) for i, n in enumerate((d <= 1.1).sum(1)) if n}


# -- product quantization -----------------------------------------------------------------


def test_kmeans_and_ties():
    x = np.repeat(np.array([[0.0, 0], [10, 0], [0, 10]], np.float32), 20, axis=0)
    c = kmeans(x, 3, 10, np.random.default_rng(2))
    assert len(c) == 3
    assert nearest(np.array([[1.0, 0]], np.float32), np.array([[0.0, 0], [2, 0], [1, 1]], np.float32)).tolist() == [0]
    reseeded = kmeans(np.array([[0.0], [0], [0], [5]], np.float32), 4, 5, np.random.default_rng(0))
    assert np.isfinite(reseeded).all()


def test_pq_recall_filters_and_compression(spark, data):
    x, q, vecs, asks = data
    want = truth(x, q, 10, L2)
    small, large = (PqIndex(32, L2, PqParams(m=m, train_iters=10)).train(vecs).add(vecs) for m in (4, 8))
    large.codes = stage(large.codes)
    a, b = hit_rate(ids_of(small.search(asks, 10), 40, 10), want), hit_rate(ids_of(large.search(asks, 10), 40, 10), want)
    assert b > a and b > 0.25
    assert np.mean([len(set(w) & set(f)) / 10 for w, f in zip(want, ids_of(large.search(asks, 100), 40, 100))]) > 0.6
    got = large.search(asks, 5, where=F.col("vec_id") % 5 == 0)
    assert got.where("vec_id % 5 <> 0").count() == 0 and got.count() == 200
    assert {r["vec_id"] for r in large.search(asks, 2, where=F.lit(False), padded=True).collect()} == {-1}
    assert large.memory_bytes == 1500 * 8 + 256 * 32 * 4 and large.raw_bytes == 1500 * 128 and large.compression_ratio > 1
    assert hit_rate(ids_of(large.search_reranked(asks, vecs, 10, 8), 40, 10), want) > b
    assert large.search(asks, 0).count() == 0


def test_pq_inner_product_and_small_sample(spark, data):
    x, q, vecs, asks = data
    i = PqIndex(32, IP, PqParams(m=8, train_iters=8, train_sample=300)).train(vecs).add(vecs)
    assert hit_rate(ids_of(i.search(asks, 10), 40, 10), truth(x, q, 10, IP)) > 0.2


def test_pq_state_errors(spark, data, tmp_path):
    _, _, vecs, asks = data
    i = PqIndex(32)
    for run in (lambda: i.add(vecs), lambda: i.search(asks), lambda: i.save(str(tmp_path / "p"))):
        with pytest.raises(ValueError):
            run()
    assert not i.is_trained and len(i) == 0 and i.compression_ratio == 0
    with pytest.raises(ValueError):
        i.train(vecs.limit(10))
    with pytest.raises(ValueError):
        i.use_codebooks(np.zeros((1, 2, 3)))


# -- graphs -----------------------------------------------------------------------------------


def test_levels_follow_from_numbers():
    assert (splitmix(7, 5, 3) == splitmix(7, 0, 8)[5:]).all()
    lv = levels(24301, 0, 50_000, 16)
    assert lv.min() == 0 and abs((lv >= 1).mean() - 1 / 16) < 0.005


@pytest.mark.parametrize("n,cap", [(0, 3), (5, 0), (5, 1), (5, 5), (5, 9), (10, 4), (100, 7)])
def test_even_sample(spark, n, cap):
    want = list(range(n)) if n <= cap else [] if cap == 0 else [i * (n - 1) // max(cap - 1, 1) for i in range(cap)]
    assert even_positions(n, cap) == want
    got = spark.createDataFrame([(list(range(n)),)], "a array<int>").select(even_sample(F.col("a"), cap)).first()[0]
    assert got == want


@pytest.mark.parametrize("metric", [L2, IP])
def test_graph_recall(spark, data, metric):
    x, q, vecs, asks = data
    i = HnswIndex(32, metric, HnswParams(ef_construction=100)).add(vecs).staged()
    want = truth(x, q, 10, metric)
    wide_beam = hit_rate(ids_of(i.search(asks, 10, ef=128), 40, 10), want)
    assert wide_beam > 0.95 and wide_beam >= hit_rate(ids_of(i.search(asks, 10, ef=10), 40, 10), want)
    assert {r["n"] for r in i.violations().collect()} == {0}
    keep = np.arange(len(x)) % 5 == 0
    got = i.search(asks, 10, ef=200, where=F.col("vec_id") % 5 == 0)
    assert got.where("vec_id % 5 <> 0").count() == 0 and hit_rate(ids_of(got, 40, 10), truth(x, q, 10, metric, keep)) > 0.9
    none = i.search(asks, 5, where=F.lit(False), padded=True)
    assert {r["vec_id"] for r in none.collect()} == {-1}
    assert i.size == 1500 and i.memory_bytes > 1500 * 128 and i.graph_meta().first()["size"] == 1500


def test_graph_against_brute_force_on_many_vectors(spark):
    """5,000 vectors and 200 queries: recall over 0.95, wider beams no worse, one plain walk like all in step."""
    x, q = gauss(5000, 48, 0), gauss(200, 48, 7)
    for metric in (L2, IP):
        g = Graph(48, metric, HnswParams())
        g.extend(x, levels(g.params.seed, 0, len(x), 16))
        want = truth(x, q, 10, metric)
        rates = [hit_rate(g.search(q, 10, ef)[0], want) for ef in (16, 64, 128, 200)]
        assert rates == sorted(rates) and rates[2] > 0.95
        at, hops, order = g.traced(q[0], 10, 128)
        assert [h[0] for h in hops] == list(range(g.top, 0, -1)) and len(set(at) & set(want[0])) >= 9
        assert len({v for v, _ in order}) == len(order) and order[0][0] == (hops[-1][1] if hops else g.entry)
        keep = np.random.default_rng(1).random(len(x)) < 0.2
        nodes, _ = g.search(q[:50], 10, 200, keep)
        assert keep[nodes].all() and hit_rate(nodes, truth(x, q[:50], 10, metric, keep)) > 0.85
        nodes, keys = g.search(q[:5], 10, 50, np.zeros(len(x), bool))
        assert (nodes == -1).all() and np.isinf(keys).all()
        nodes, _ = g.search(q[:5], 10, 50, np.arange(len(x)) == 77)
        assert (nodes[:, 0] == 77).all() and (nodes[:, 1:] == -1).all()


def test_search_where_few_pass_costs_no_more_than_a_scan(spark, monkeypatch):
    """Hardly any node passes, those that pass lie far from the queries, or nothing leads to them:
    the true neighbours, and no walk through the whole graph; of equals the smaller id comes first."""
    from lodestone.operators import hnsw

    monkeypatch.setattr(hnsw, "SCAN_GAIN", 1, raising=False)
    x, few = gauss(4000, 24, 3), np.arange(4000) % 200 == 7
    x[2007] = x[7]
    n, own = [0], Graph.keys
    monkeypatch.setattr(Graph, "keys", lambda g, q, nodes: (n.__setitem__(0, n[0] + len(nodes)), own(g, q, nodes))[1])
    for metric in (L2, IP):
        g = Graph(24, metric, HnswParams(m=8, ef_construction=60))
        g.extend(x, levels(1, 0, len(x), 8))
        for keep, q, ef in ((few, x[::50], 100), (x[:, 0] > 0.15, x[x[:, 0] < -0.3][:80], 100), (np.arange(4000) == 77, x[::50], 10)):
            n[0] = 0
            nodes, _ = g.search(q, 10, ef, keep)
            want = truth(x, q, min(10, int(keep.sum())), metric, keep)
            assert (nodes[:, : want.shape[1]] == want).all() and (nodes[:, want.shape[1] :] == -1).all()
            assert n[0] < len(q) * 1200
        near = x[:, 0] > -0.2  # so many pass that the filter acts inside the walk
        nodes, _ = g.search(x[:40], 10, 200, near)
        assert near[nodes].all() and hit_rate(nodes, truth(x, x[:40], 10, metric, near)) > 0.9
        g.links[0][:] = -1
        assert (g.search(x[:40], 10, 10, x[:, 0] > 0)[0] == truth(x, x[:40], 10, metric, x[:, 0] > 0)).all()
    vecs = frame(spark, x[:2200])
    i = HnswIndex(24, L2, HnswParams(m=4, ef_construction=20)).add(vecs.where("vec_id >= 2000")).staged().add(vecs.where("vec_id < 200")).staged()
    got = i.search(asked(spark, x[7:8]), 1, where=F.col("vec_id") % 200 == 7, padded=True).collect()
    assert [r["vec_id"] for r in got] == [7]


def test_links_of_a_node():
    """Chosen on the bottom layer up to 2m, spread out, both ways."""
    x = gauss(600, 16, 2)
    g = Graph(16, L2, HnswParams(m=4, ef_construction=80))
    g.extend(x, levels(g.params.seed, 0, len(x), 4))
    last = g.neighbours(599, 0)
    want, key = [], g.keys(x[599], np.arange(599))
    for v in np.argsort(key, kind="stable")[:80]:
        if len(want) < 8 and all(g.keys(x[v], np.array([u]))[0] >= key[v] for u in want):
            want.append(int(v))
    assert last.tolist() == want
    for layer in range(g.top + 1):
        for v in np.flatnonzero(g.level >= layer):
            near = g.neighbours(v, layer)
            assert v not in near and len(near) <= g.cap(layer) and (g.level[near] >= layer).all() and len(set(near.tolist())) == len(near)
    assert g.entry == int(np.flatnonzero(g.level == g.top)[0])


def test_walk_without_a_scan(monkeypatch):
    from lodestone.operators import hnsw

    monkeypatch.setattr(hnsw, "SCAN_ROWS", 200)
    x, q = gauss(2500, 24, 1), gauss(50, 24, 9)
    g = Graph(24, L2, HnswParams(m=12, ef_construction=80))
    g.extend(x, levels(1, 0, len(x), 12))
    assert hit_rate(g.search(q, 10, 128)[0], truth(x, q, 10, L2)) > 0.95


def test_graph_shards_growth_and_trace(spark, data):
    x, q, vecs, asks = data
    i = HnswIndex(32, IP, HnswParams(m=8, ef_construction=60), shards=3).add(vecs.where("vec_id < 1000")).staged().add(vecs.where("vec_id >= 1000")).staged()
    assert i.size == 1500 and hit_rate(ids_of(i.search(asks, 10, ef=100), 40, 10), truth(x, q, 10, IP)) > 0.95
    found, trace, visited = i.search_traced(asks, 5, max_trace=1, ef=100)
    assert sorted((r["query_id"], r["vec_id"]) for r in found.collect()) == sorted((r["query_id"], r["vec_id"]) for r in i.search(asks, 5, ef=100).collect())
    assert trace.where("layer = 0").count() == 40 * 3 and visited.agg(F.min("total_visited")).first()[0] > 10
    tops = {r["shard"]: r["max_level"] for r in i.graph_meta().collect()}
    hops = trace.where("layer > 0").groupBy("query_id", "shard").agg(F.count("*").alias("n"), F.max("layer").alias("top")).collect()
    assert all(r["n"] == r["top"] == tops[r["shard"]] for r in hops) and len(hops) == 40 * sum(t > 0 for t in tops.values())
    _, whole, seen = i.search_traced(asks, 5, max_trace=100_000)
    assert whole.where("layer = 0").count() == seen.agg(F.sum("total_visited")).first()[0]
    assert [d.count() for d in i.search_traced(asks, 0)] == [0, 0, 0]
    i.ef_search = 0
    assert i.search(asks, 5).count() == 200


def test_shards_by_centre_and_hot_centres(spark):
    """A third of all vectors lies at one centre, which then has several shards; few shards are visited."""
    r = np.random.default_rng(2)
    c = gauss(12, 24, 5)
    of = np.where(r.random(3000) < 0.34, 0, r.integers(0, 12, 3000))
    x = (c[of] + 0.1 * r.standard_normal((3000, 24))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x[r.choice(3000, 200, False)]
    vecs, asks = stage(frame(spark, x)), stage(asked(spark, q))
    for metric in (L2, IP):
        i = HnswIndex(24, metric, HnswParams(m=8, ef_construction=60), shard_rows=250, probes=3).add(vecs).staged()
        assert i.shards > 8 and i.parts.max() > 1 and i.graph_meta().agg(F.max("size")).first()[0] < 700
        assert hit_rate(ids_of(i.search(asks, 10, ef=64), 200, 10), truth(x, q, 10, metric)) > 0.95
        visited = i._dealt_queries(asks).select("shard").distinct().count()
        assert visited <= i.shards and i.size == 3000
    assert {r["n"] for r in i.violations().collect()} == {0}
    few = HnswIndex(24, L2, HnswParams(m=6, ef_construction=30), shard_rows=250).add(vecs.where("vec_id < 100")).staged()
    assert few.shards == 1 and few.add(vecs.where("vec_id >= 100")).staged().shards > 8 and few.size == 3000
    assert hit_rate(ids_of(few.search(asks, 10, ef=64), 200, 10), truth(x, q, 10, L2)) > 0.9


def test_filtered_search_reaches_as_many_vectors(spark):
    """Of 30 centres and more a query visits 13 or 14; the few vectors that pass a filter lie at any."""
    x = gauss(3000, 24, 6)
    i = HnswIndex(24, L2, HnswParams(m=8, ef_construction=40), shard_rows=100).add(stage(frame(spark, x))).staged()
    asks = stage(asked(spark, x[:60]))
    assert len(i.parts) > 14
    got = ids_of(i.search(asks, 10, ef=50, where=F.col("vec_id") % 60 == 7), 60, 10)
    assert (got == truth(x, x[:60], 10, L2, np.arange(3000) % 60 == 7)).all()
    assert {r["vec_id"] for r in i.search(asks, 3, where=F.lit(False), padded=True).collect()} == {-1}


def test_graph_of_few(spark):
    x = np.eye(3, 4, dtype=np.float32)
    i = HnswIndex(4, L2).add(frame(spark, x))
    got = i.search(asked(spark, np.zeros((1, 4), np.float32)), 5, padded=True).orderBy("rank").collect()
    assert sorted(r["vec_id"] for r in got) == [-1, -1, 0, 1, 2]
    with pytest.raises(ValueError):
        HnswIndex(4).search(asked(spark, x))
    empty = HnswIndex(4).add(frame(spark, x).limit(0))
    assert empty.search(asked(spark, x), 2).count() == 0 and empty.size == 0
    assert len(HnswIndex(4).add_array(spark, np.repeat(x, 40, axis=0))) == 120
    same = HnswIndex(4, L2).add_array(spark, np.repeat(x[:1], 90, axis=0)).search(asked(spark, x[:1]), 5)
    assert same.count() == 5


# -- persistence ---------------------------------------------------------------------------------


def test_save_and_load(spark, data, tmp_path):
    _, _, vecs, asks = data
    few = vecs.where("vec_id < 400")
    path = lambda n: f"file://{tmp_path}/{n}"
    exact, graph, codes = ExactIndex(32, L2, few), HnswIndex(32, IP, HnswParams(m=6, ef_search=123), 2).add(few).staged(), PqIndex(32, L2, PqParams(m=4, nbits=5, seed=9)).train(few).add(few)
    exact.save(path("e"))
    graph.save(path("g"))
    codes.save(path("c"))
    back = ExactIndex.load(spark, path("e")), HnswIndex.load(spark, path("g")), PqIndex.load(spark, path("c"))
    for a, b in zip((exact, graph, codes), back):
        assert sorted(map(tuple, a.search(asks, 7).collect())) == sorted(map(tuple, b.search(asks, 7).collect()))
    assert back[1].params == graph.params and back[1].shards == 2
    assert (back[2].params.m, back[2].params.nbits, back[2].params.seed) == (4, 5, PqParams().seed)
    with pytest.raises(OSError):
        ExactIndex.load(spark, path("missing"))
    with pytest.raises(ValueError):
        HnswIndex.load(spark, path("e"))


def test_scratch_tables_are_dropped(spark):
    import os

    from lodestone import session

    kept = stage(spark.range(3).toDF("i"), "kept")
    with session.scratch():
        gone = stage(spark.range(4).toDF("i"), "gone")
        path = session._staged[-1][1].removeprefix("file:")
        assert gone.count() == 4 and os.path.exists(path)
    assert not os.path.exists(path) and kept.count() == 3


# -- evaluation ------------------------------------------------------------------------------------


def test_two_recalls(spark):
    rows = lambda r: spark.createDataFrame(r, "query_id long, vec_id long")
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    t = rows([(1, 10), (1, 11), (2, 20), (3, -1)])
    f = rows([(1, 10), (1, 10), (1, 99), (2, 20), (2, -1), (3, -1)])
    r = evaluate.recall(f, t, q).first()
    assert r["recall"] == pytest.approx((0.5 + 1 + 0) / 3) and r["queries"] == 3
    assert evaluate.recall_at(f, t, 3, 2).first()[0] == pytest.approx(2 / 6)
    assert evaluate.recall(f.limit(0), t, q.limit(0)).first()["recall"] == 0.0


def test_percentiles_split_and_reports(spark, data, tmp_path):
    x, _, vecs, asks = data
    v = np.random.default_rng(1).random(101)
    p = evaluate.percentiles(spark.createDataFrame([(float(a),) for a in v], "v double"), "v").first()
    assert p["p50"] == pytest.approx(np.percentile(v, 50)) and p["p99"] == pytest.approx(np.percentile(v, 99)) and p["mean"] == pytest.approx(v.mean())
    base, q = evaluate.held_out(vecs, 10_000)
    assert q.count() == 1499 and base.count() == 1
    base, q = evaluate.held_out(vecs, 30, seed=4)
    got = base.select("vec_id", "old_id").orderBy("vec_id").collect()
    assert [r["vec_id"] for r in got] == list(range(1470)) and [r["old_id"] for r in got] == sorted(r["old_id"] for r in got)
    assert evaluate.builder_sample(vecs, 20).count() == 20
    ms = evaluate.latency(spark, lambda v: None, x, samples=20).first()
    assert 0 <= ms["p50"] <= ms["p99"] and evaluate.throughput(spark, lambda: None, 5, 3) > 0
    assert evaluate.latency(spark, lambda v: None, x[:0], samples=20).first()["p50"] is None
    i = ExactIndex(32, IP, vecs)
    r = evaluate.benchmark("exact", "gauss", i, asks, i.search(asks), passes=1, samples=2)
    assert r.recall == 1.0 and min(r.p50_ms, r.p99_ms, r.qps_1t, r.qps_mt) > 0
    evaluate.write_report(f"file://{tmp_path}/r.json", spark, [r])
    assert evaluate.one_task(i).vectors.rdd.getNumPartitions() == 1


def test_table_of_results():
    r = evaluate.BenchResult("exact", "d", 99_000, 384, 10, 1.0, 4.03214, 123.4, None, 1234.5, 99.99996, None, 0.1)
    head, rule, line = evaluate.text_table([r]).split("\n")
    assert head.split() == ["index", "N", "dim", "k", "recall@k", "p50(ms)", "p99(ms)", "QPS(1t)", "QPS(mt)", "mem(MB)"] and set(rule) == {"-", " "} and len(head) == len(rule) == len(line)
    assert line.split() == ["exact", "99,000", "384", "10", "1.0000", "4.0321", "123", "1,234", "100.0000", "-"]


def test_truth_of_a_cut_base(spark, data):
    x, q, vecs, asks = data
    shipped = spark.createDataFrame([(0, 1, 5), (0, 2, 6), (99, 1, 7)], "query_id long, rank int, vec_id long")
    assert [tuple(r) for r in evaluate.truth_of(vecs, asks, IP, 32, 1, shipped).collect()] == [(0, 1, 5)]
    assert (ids_of(evaluate.truth_of(vecs.where("vec_id < 700"), asks, IP, 32, 3, shipped, True), 40, 3) == truth(x[:700], q, 3, IP)).all()


def test_query_set_grows_with_the_table(spark, tmp_path):
    from lodestone.plans import queries

    x = gauss(420, 64, 12)
    frame(spark, x).withColumn("label", F.lit(0)).write.parquet(str(tmp_path / "embeddings.parquet"))
    asked_ids = np.arange(0, 420, 50)
    for name, metric in (("exact_batch_ip", IP), ("exact_batch_l2", L2)):
        found = queries.queries()[name](spark, str(tmp_path)).collect()
        want = truth(x, x[asked_ids], 10, metric)
        assert {(r["query_id"], r["rank"], r["vec_id"]) for r in found} == {(int(q), k + 1, int(v)) for q, row in zip(asked_ids, want) for k, v in enumerate(row)}
    assert queries.queries()["recall_tests"](spark, str(tmp_path)).first()["queries"] == len(asked_ids)
