from functools import partial

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sentspark.operators import (
    classifier as K, embedding as EM, graphs as G, head as H, layout as Y, linear as L, neighbours as N, skew,
)
from sentspark.plans import binding as B
from sentspark.scratch import scratch
from sentspark.session import scratch_path


def frame(spark, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>")


def brute_force(vectors, k):
    x = np.asarray(vectors, dtype="float32").astype("float64")
    gaps = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(gaps, np.inf)
    ids = np.arange(len(x))
    return {
        (i, r + 1): int(j) for i in ids for r, j in enumerate(np.lexsort((ids, gaps[i]))[:min(k, len(x) - 1)])
    }


def found(df):
    return {(r["i"], r["rank"]): r["j"] for r in df.collect()}


@pytest.mark.parametrize("pivots, block", [(None, 4096), (6, 16)])
def test_knn_is_exact(spark, pivots, block):
    rng = np.random.default_rng(1)
    clustered = np.concatenate([rng.normal(c, 0.05, (30, 4)) for c in ((0, 0, 0, 0), (3, 0, 0, 0), (0, 5, 0, 1))])
    df = frame(spark, clustered)
    assert found(N.knn_graph(df, 5, pivots=pivots, block=block)) == brute_force(clustered, 5)


def test_knn_with_a_hot_group_of_copies(spark):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(60, 3))
    points[10:30] = points[3]      # a third of all rows are copies
    points[40] = points[41]
    assert found(N.knn_graph(frame(spark, points), 4, pivots=4, block=8)) == brute_force(points, 4)


def test_knn_ties_and_few_rows(spark):
    grid = [(x, y) for x in range(5) for y in range(5)]
    assert found(N.knn_graph(frame(spark, grid), 4, pivots=3, block=4)) == brute_force(grid, 4)
    assert found(N.knn_graph(frame(spark, grid[:3]), 10)) == brute_force(grid[:3], 10)


@pytest.mark.parametrize("region, parts", [(400, 3), (1 << 23, 5)])
def test_knn_of_vectors_without_clusters_is_exact_in_regions(spark, monkeypatch, region, parts):
    monkeypatch.setattr(N, "REGION", region)        # 100 rows of 4 entries
    monkeypatch.setattr(N, "PARTS", parts)
    monkeypatch.setattr(N, "LEAST_VISITORS", 1)
    points = np.random.default_rng(4).normal(size=(350, 4))
    assert found(N.knn_graph(frame(spark, points), 6, pivots=9)) == brute_force(points, 6)


def test_cells_that_lie_together_are_one_region():
    """Rows move once a region: cells of 1,000 rows are not regions of their own."""
    centres = np.random.default_rng(5).normal(size=(100, 64))
    order = N._together(centres, np.arange(100))
    assert sorted(order) == list(range(100))
    assert {region for _, region, _ in N._regions(order, dict.fromkeys(order, 1000), N.REGION // 64)} == {0}
    plan = N._regions([0, 1, 2, 3], {0: 30, 1: 250, 2: 60, 3: 50}, 100)
    assert plan == [(0, 0, 1), (1, 1, 3), (2, 4, 1), (3, 5, 1)]


@pytest.mark.parametrize("kind", ["apart", "far from zero", "equal gaps", "huge"])
def test_products_of_single_precision_lose_no_neighbour(monkeypatch, kind):
    monkeypatch.setattr(N, "STRETCH", 64)
    monkeypatch.setattr(N, "PENDING", 500)
    rng = np.random.default_rng(6)
    points = {
        "apart": np.concatenate([c + rng.normal(size=(150, 5)) * 1e-4 for c in (0, 50, 1000)]),
        "far from zero": 1e4 + rng.normal(size=(400, 8)) * 1e-2,
        "equal gaps": np.unique(rng.integers(0, 8, size=(400, 3)), axis=0),
        "huge": rng.normal(size=(80, 4)) * 1e20,
    }[kind].astype("float32")
    table = pa.table({"id": pa.array(range(len(points))), "vec": pa.array(list(points), pa.list_(pa.float32()))})
    got = N._block_nearest(table, table, 5).to_pylist()
    rank = {i: 0 for i in range(len(points))}
    places = {}
    for r in got:
        rank[r["i"]] += 1
        places[r["i"], rank[r["i"]]] = r["j"]
    assert places == brute_force(points, 5)


def test_near_pairs_search_once(spark):
    """The neighbours are read three times; they are not searched again each time."""
    searched = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            searched.add(batch.num_rows)
            yield batch

    points = np.random.default_rng(7).normal(size=(40, 3))
    knn = N.knn_graph(frame(spark, points), 5)
    assert G.near_pairs(knn.mapInArrow(count, knn.schema), 3).count() == 120
    assert searched.value == 200


def test_no_rows_and_pairs_of_few_rows(spark):
    assert N.knn_graph(frame(spark, [(0.0, 1.0)]).where("vec_id < 0"), 3).count() == 0
    few = G.index_rows(frame(spark, np.eye(6)), "vec_id", "embedding", 1)
    pairs = G.pacmap_pairs(few, N.knn_graph(few, 3, "idx", "vec"), 6, 2)
    assert pairs.where("i = j").count() == 0 and {r["kind"] for r in pairs.collect()} == {"near", "mid", "far"}


def test_skew_join_keeps_every_row(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    want = left.join(right, "k")
    got = skew.skew_join(left, right, "k", salted_on="id").select(want.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and got.count() == 3000


def test_membership_graph(spark, tables):
    graph = G.umap_graph(N.knn_graph(B.vectors(spark, tables), 15)).persist()
    flipped = graph.select(F.col("j").alias("i"), F.col("i").alias("j"), "weight")
    assert graph.exceptAll(flipped).count() == 0
    low, high = graph.agg(F.min("weight"), F.max("weight")).first()
    assert 0 < low and high <= 1
    sums = G.membership_edges(N.knn_graph(B.vectors(spark, tables), 15)).groupBy("i").agg(F.sum("weight").alias("s"))
    assert sums.where(F.abs(F.col("s") - np.log2(15)) > 1e-3).count() == 0


def test_pair_sets(spark, tables):
    indexed = G.index_rows(B.vectors(spark, tables), "vec_id", "embedding", 42)
    n = indexed.count()
    pairs = G.pacmap_pairs(indexed, N.knn_graph(indexed, 60, "idx", "vec"), n, 10).persist()
    counts = {(r["kind"], r["count"]) for r in pairs.groupBy("i", "kind").count().collect()}
    assert counts == {("near", 10), ("mid", 5), ("far", 20)}
    assert pairs.where("i = j").count() == 0 and pairs.select("i", "j", "kind").distinct().count() == pairs.count()
    clash = pairs.where("kind = 'near'").join(pairs.where("kind = 'far'").select("i", "j"), ["i", "j"])
    assert clash.count() == 0


@pytest.mark.parametrize("n, stretch", [(3, 4096), (50, 16), (200, 16), (200, 64)])
def test_drawn_pairs_are_those_of_the_runs(spark, monkeypatch, n, stretch):
    """Mid and far pairs against the same draws in plain Python, with runs over the ends of
    stretches and of the index; vectors are not joined to draws."""
    monkeypatch.setattr(G, "STRETCH", stretch)
    x = np.random.default_rng(n).integers(0, 3, (n, 4)).astype(float)      # with equal vectors and distances
    indexed = G.index_rows(frame(spark, x), "vec_id", "embedding", 5).persist()
    vec = {r["idx"]: np.array(r["vec"]) for r in indexed.collect()}
    near = indexed.select(F.col("idx").alias("i"), ((F.col("idx") + 1) % n).cast("bigint").alias("j"))
    start = {p: {r[0]: r[1] for r in indexed.select("idx", F.pmod(F.xxhash64("idx", F.lit(5), F.lit(p)), F.lit(n))).collect()} for p in ("mid-near", "far")}
    mid, far = set(), set()
    for i in range(n):
        run = [(start["mid-near"][i] + s) % n for s in range(min(14, n))]
        for pick in (run[:7], run[7:]):
            drawn = sorted([j for j in pick if j != i][:6], key=lambda j: (((vec[i] - vec[j]) ** 2).sum(), j))
            mid |= {(i, j) for j in drawn[:2][-1:]}
        run = [(start["far"][i] + s) % n for s in range(min(3 + 1 + 1, n))]
        far |= {(i, j) for j in [j for j in run if j not in (i, (i + 1) % n)][:3]}
    got = G.mid_near_pairs(indexed, n, 2, 5)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(mid)
    assert sorted(map(tuple, G.far_pairs(indexed, near, n, 1, 3, 5).collect())) == sorted(far)


def kept_neighbours(rows, positions, k=10):
    ids = sorted(positions)
    x, y = np.array([rows[i] for i in ids], dtype="float64"), np.array([positions[i] for i in ids])

    def near(z):
        gaps = ((z[:, None] - z[None]) ** 2).sum(-1)
        np.fill_diagonal(gaps, np.inf)
        return np.argsort(gaps, axis=1)[:, :k]

    return np.mean([len(set(a) & set(b)) for a, b in zip(near(x), near(y))]) / k


def test_layouts_keep_neighbours_better_than_pca(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 10)) * 4
    points = np.concatenate([c + rng.normal(size=(15, 10)) for c in centres])
    df, rows = frame(spark, points), dict(enumerate(points))
    scores = {}
    for model, params in (("pca", {}), ("pacmap", {"n_iter": 45}), ("umap", {"n_iter": 40, "n_neighbors": 10})):
        got = Y.reduce_vectors(df, model, params, "vec_id").collect()
        assert len(got) == len(points)
        scores[model] = kept_neighbours(rows, {r[0]: (r[1], r[2]) for r in got})
    assert scores["pacmap"] > scores["pca"] and scores["umap"] > scores["pca"], scores


def test_hubs_are_dealt_to_several_blocks(spark, monkeypatch):
    """A row in a third of all pairs: no block holds all of its pairs, none is lost, every
    row has a place of its own, and it gets one position."""
    monkeypatch.setattr(Y, "HOT_SHARE", 1000)
    n = 12_000
    ring = spark.range(n).select(F.col("id").alias("i"), ((F.col("id") + 1) % n).alias("j"), F.lit(1).alias("kind"))
    hub = spark.range(1, n).select(F.col("id").alias("i"), F.lit(0).cast("bigint").alias("j"), F.lit(3).alias("kind"))
    pairs = ring.unionByName(hub)
    pairs = pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "kind"))
    indexed = spark.range(n).select(F.col("id").alias("idx"), F.array(F.sin("id").cast("float"), F.cos(F.col("id") * 3).cast("float")).alias("vec"))
    with scratch(spark, "test") as tmp:
        blocks = Y._Blocks(pairs, indexed, 4000, tmp)
        assert blocks.salted and {r["idx"] for r in blocks.hot.collect()} == {0}
        assert blocks.pairs.drop("block").exceptAll(pairs).count() == 0 and blocks.pairs.count() == pairs.count()
        at_hub = blocks.pairs.where("i = 0").groupBy("block").count().collect()
        assert len(at_hub) > 4 and max(r["count"] for r in at_hub) < n / 4
        assert blocks.places.where("own").select("idx").distinct().count() == n
        state = tmp.table(Y._start(indexed, 1.0))
        moved = blocks.round(state, partial(Y._pair_steps, first=0, last=2, n_iter=10)).collect()
        assert len(moved) == n and np.isfinite([r["y0"] for r in moved]).all()


def test_pairs_of_blocks_stay_where_they_are(spark):
    """A round moves the rows, packed by block, and not the pairs."""
    n = 200
    indexed = spark.range(n).select(F.col("id").alias("idx"), F.array(F.sin("id").cast("float"), F.cos(F.col("id") * 3).cast("float")).alias("vec"))
    ring = spark.range(n).select(F.col("id").alias("i"), ((F.col("id") + 1) % n).alias("j"), F.lit(1).alias("kind"))
    with scratch(spark, "test") as tmp:
        blocks = Y._Blocks(ring, indexed, 60, tmp)
        state = indexed.select("idx", *[F.sin(F.col("idx") * k).alias(c) for k, c in enumerate(Y._STATE, 1)])
        same = blocks.round(state, lambda pairs, points: Y._Local(pairs, points, list(Y._STATE)).table())
        plan = same._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(block") == 1, plan
        assert sorted(map(tuple, same.collect())) == sorted(map(tuple, state.collect()))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("dealt_")]


@pytest.mark.parametrize("hub", [False, True])
def test_letters_bring_what_rows_would(spark, hub):
    """Rounds by letters between blocks against rounds that send rows by their places: the
    same positions, one exchange a round and no join; each block is a task of its own."""
    n = 12_000
    ring = spark.range(n).select(F.col("id").alias("i"), ((F.col("id") + 1) % n).alias("j"), F.lit(1).alias("kind"))
    far = spark.range(1, n).select(F.col("id").alias("i"), F.lit(0).cast("bigint").alias("j") if hub else ((F.col("id") * 7 + 5) % n).alias("j"), F.lit(3).alias("kind"))
    pairs = ring.unionByName(far).where("i <> j")
    pairs = pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "kind"))
    indexed = spark.range(n).select(F.col("id").alias("idx"), F.array(F.sin("id").cast("float"), F.cos(F.col("id") * 3).cast("float")).alias("vec"))
    with scratch(spark, "test") as tmp:
        blocks = Y._Blocks(pairs, indexed, 4000, tmp)
        assert blocks.salted is hub and blocks.buckets == blocks.blocks > 8
        names = blocks.places.select("block").distinct()
        assert names.select(F.pmod(F.hash("block"), F.lit(blocks.buckets))).distinct().count() == names.count()
        post = Y._Letters(blocks)
        state = tmp.table(Y._start(indexed, 1.0))
        letters = tmp.table(post.first(state))
        for first in (0, 3):
            state = tmp.table(blocks.round(state, partial(Y._pair_steps, first=first, last=first + 3, n_iter=10)))
            moved = post.round(letters, partial(Y._descend, first=first, last=first + 3, n_iter=10))
            plan = moved._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning(block") == 1 and "Join" not in plan, plan
            letters = tmp.table(moved)
        want = {r["idx"]: (r["y0"], r["y1"]) for r in state.collect()}
        got = {r["idx"]: (r["y0"], r["y1"]) for r in post.positions(letters).collect()}
    assert len(got) == n and got.keys() == want.keys()
    assert np.allclose([got[i] for i in range(n)], [want[i] for i in range(n)], atol=1e-4)


def test_blocks_come_near_the_layout_of_one(spark, tables):
    """The loss of near pairs with eight blocks against that of one."""
    indexed = G.index_rows(B.vectors(spark, tables), "vec_id", "embedding", 42)
    pairs = G.pacmap_pairs(indexed, N.knn_graph(indexed, 60, "idx", "vec"), indexed.count()).persist()
    near = np.array([(r["i"], r["j"]) for r in pairs.where("kind = 'near'").collect()])
    losses = []
    for per_block in (10 ** 9, pairs.count() // 4):
        at = {r["idx"]: (r["y0"], r["y1"]) for r in Y.pair_layout(indexed, pairs, 90, per_block=per_block).collect()}
        y = np.array([at[i] for i in range(len(at))])
        gap = ((y[near[:, 0]] - y[near[:, 1]]) ** 2).sum(axis=1) + 1
        losses.append((gap / (10 + gap)).mean())
    assert abs(losses[1] / losses[0] - 1) < 0.15, losses


def test_curve_parameters():
    assert np.allclose(Y.curve_parameters(0.1, 1.0), (1.576943, 0.895061), atol=1e-5)
    rng = np.random.default_rng(0)
    for low, spread in ((0.0, 1.0), (0.5, 1.0), (0.25, 2.0)):
        a, b = Y.curve_parameters(low, spread)
        d = np.linspace(0, 3 * spread, 300)
        want = np.where(d < low, 1.0, np.exp(-(d - low) / spread))

        def miss(a, b):
            return ((1 / (1 + a * d ** (2 * b)) - want) ** 2).sum()

        assert all(miss(a, b) <= miss(a * x, b * y) for x, y in 1 + rng.normal(size=(200, 2)) * 0.05)
    with pytest.raises(ValueError):
        Y.curve_parameters(2.0, 1.0)


def test_unknown_names(spark):
    df = frame(spark, [(1, 2)])
    with pytest.raises(NotImplementedError):
        Y.reduce_vectors(df, "tsne", {}, "vec_id")
    with pytest.raises(NotImplementedError):
        K.make_classifier("forest")
    with pytest.raises(ValueError):
        H.HeadSettings(inputs=2, loss="hinge")
    with pytest.raises(ValueError):
        H.HeadSettings(inputs=2, gamma=-1.0)


def test_pca_equals_svd(spark):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(80, 5)) * [5, 3, 1, 1, 1] + 7).astype("float32").astype("float64")
    got = np.array([r["position"] for r in EM.pca_layout(frame(spark, x)).orderBy("vec_id").collect()])
    centred = x - x.mean(axis=0)
    axes = np.linalg.svd(centred, full_matrices=False)[2][:2]
    axes *= np.sign(axes[np.arange(2), np.abs(axes).argmax(axis=1)])[:, None]
    assert np.allclose(got, centred @ axes.T, atol=1e-6)


@pytest.mark.parametrize("rows, width, far", [(2000, 1024, 3.0), (300, 64, 0.0), (50, 200, 1e4)])
def test_axes_of_wide_vectors(spark, rows, width, far):
    rng = np.random.default_rng(width)
    x = rng.normal(size=(rows, width)) * np.r_[9, 7, 5, np.linspace(2, 1, width - 3)] + far
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").repartition(5)
    centre, axes = EM.principal_axes(df, 3)
    want = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:3]
    assert np.allclose(centre, x.mean(axis=0)) and np.allclose(np.abs((axes.T * want).sum(axis=1)), 1, atol=1e-7)


def test_embedding_hook(spark):
    class Lengths:
        def encode(self, texts):
            assert len(texts) <= 3
            return np.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([(str(i), "x" * i) for i in range(10)], "sentence_id string, sentence string")
    got = EM.embed(df, Lengths, batch_size=3).collect()
    assert all(r["embedding"] == [len(r["sentence"]), 1.0] for r in got)


def test_hashed_vectors_have_unit_length(spark, tables):
    texts = B.texts(spark, tables)
    got = EM.embed_hashed(texts, EM.hashed_encoder(texts, 64)).select("embedding").collect()
    norms = np.linalg.norm(np.array([r[0] for r in got]), axis=1)
    assert np.allclose(norms[norms > 0], 1, atol=1e-5)


def two_class(spark, tables):
    label = F.when(F.col("label") < 5, "SUBJ").otherwise("OBJ")
    return B.table(spark, tables, "embeddings").select(
        F.col("vec_id").alias("sentence_id"), "embedding", label.alias("label"), F.when(F.col("label") < 5, 0).otherwise(1).alias("label_encoded")
    )


def test_logistic_equals_newton(spark, tables):
    df = B.labelled_vectors(spark, tables)
    rows = df.collect()
    x = np.array([r["embedding"] for r in rows], dtype="float64")
    y = np.array([1.0 if r["label"] == "SUBJ" else 0.0 for r in rows])
    n, weight = len(y), np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    z, ridge = np.c_[x, np.ones(n)], np.r_[np.ones(x.shape[1]), 0.0]
    beta = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ beta))
        beta -= np.linalg.solve((z.T * (weight * p * (1 - p))) @ z + np.diag(ridge), z.T @ (weight * (p - y)) + ridge * beta)
    assert np.allclose(L.coefficients(L.fit_logistic(df)), beta, atol=1e-4)


@pytest.mark.parametrize("loss, gamma", [("cross_entropy", 2.0), ("focal", 2.0), ("focal", 0.0), ("focal", 0.5)])
def test_gradient(loss, gamma):
    settings = H.HeadSettings(inputs=5, hidden=4, loss=loss, gamma=gamma, class_weights=(1.0, 2.0))
    head, rng = H.Head.initial(settings), np.random.default_rng(0)
    x, code = rng.normal(size=(7, 5)), rng.integers(0, 2, 7)
    keep = H._dropout_mask(np.arange(7), 5, 0.3)
    exact = head.gradient(x, code, keep)[0]
    for i in range(0, len(head.flat), 3):
        step = np.zeros(len(head.flat))
        step[i] = 1e-6
        up, down = (H.Head(settings, head.flat + s).gradient(x, code, keep)[1] for s in (step, -step))
        assert abs((up - down) / 2e-6 - exact[i]) < 1e-6


def test_dropout_mask_is_repeatable_and_fair():
    a, b = (H._dropout_mask(np.arange(4000), 20, 0.1) for _ in range(2))
    assert (a == b).all() and abs((a == 0).mean() - 0.1) < 0.01 and abs(a.mean() - 1) < 0.01
    assert H._dropout_mask(np.arange(3), 4, 0.0) is None


def test_batch_gradient_equals_one_machine(spark, tables):
    df = two_class(spark, tables).select("sentence_id", F.col("embedding").alias("vector"), F.col("label_encoded").alias("code"))
    head = H.Head.initial(H.HeadSettings(inputs=64, hidden=80, dropout=0.0))
    got, loss, cells = H.batch_gradient(df.repartition(5), head, 0)
    rows = df.collect()
    x, code = np.array([r["vector"] for r in rows], dtype="float64"), np.array([r["code"] for r in rows])
    want, total, predicted = head.gradient(x, code, None)
    assert np.allclose(got, want / len(rows)) and loss == pytest.approx(total / len(rows))
    assert sum(n for (g, p), n in cells.items() if g == p) == (code == predicted).sum()


def test_training_learns_stops_and_reloads(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) for v in rng.normal(i % 2, 0.3, 4)], i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "sentence_id bigint, embedding array<float>, label_encoded int")
    seen = []
    settings = H.HeadSettings(inputs=4, hidden=8, learning_rate=0.05, epochs=6, patience=2, batch_size=60, dropout=0.1)
    head, best, logged = H.train_head(df.where("sentence_id < 150"), df.where("sentence_id >= 150"), settings, log=seen.append)
    assert best > 0.9 and seen == logged and logged[0]["epoch"] == 1 and len(logged) <= 6
    assert set(logged[0]) >= {"train/loss", "val/loss", "val/macro_f1", "learning_rate", "val/OBJ_class_f1", "val/SUBJ_class_f1"}
    tracked = []
    K.HeadClassifier({"inputs": 4}).fit(df, df, tracked.append, train_fn=lambda train, val, settings, log: (head, best, logged))
    assert tracked == [{"val/macro_f1": best}]
    path = scratch_path(spark, "head")
    H.save_head(spark, head, path)
    again = H.load_head(spark, path)
    assert again.settings == head.settings and (again.flat == head.flat).all()
    assert H.predicted(H.score(df.drop("label_encoded"), again, "embedding")).where("predicted_label is null").count() == 0


def plain_fit(rows, settings, key):
    """The sequential fit, one mini-batch after the other in the order of the epoch."""
    head, optimiser = H.Head.initial(settings), H.AdamW(len(H.Head.initial(settings).flat), settings.eps)
    for epoch in range(1, settings.epochs + 1):
        order = sorted((key[i, epoch], i) for i in rows)
        for at in range(0, len(order), settings.batch_size):
            ids = [i for _, i in order[at:at + settings.batch_size]]
            x, code = np.array([rows[i][0] for i in ids]), np.array([rows[i][1] for i in ids])
            keep = H._dropout_mask(np.array([key[i, epoch] for i in ids]), settings.inputs, settings.dropout)
            gradient = head.gradient(x, code, keep)[0] / len(ids)
            head = H.replace_weights(head, optimiser.update(head.flat, gradient, settings.learning_rate))
    return head


def clusters(spark, n=400):
    rng = np.random.default_rng(6)
    rows = {i: (rng.normal(i % 2, 0.8, 4).tolist(), i % 2) for i in range(n)}
    return rows, spark.createDataFrame([(i, *r) for i, r in rows.items()], "sentence_id bigint, embedding array<double>, label_encoded int").repartition(5)


def test_one_part_is_the_sequential_fit(spark):
    rows, df = clusters(spark)
    settings = H.HeadSettings(inputs=4, hidden=8, learning_rate=0.01, epochs=3, patience=9, batch_size=30, dropout=0.1, step_per="never")
    epochs = spark.range(1, 4).withColumnRenamed("id", "e")
    keys = df.crossJoin(epochs).select("sentence_id", "e", F.xxhash64("sentence_id", F.lit(settings.seed), F.col("e").cast("int")).alias("k")).collect()
    want = plain_fit(rows, settings, {(r["sentence_id"], r["e"]): r["k"] for r in keys})
    heads = []
    H.train_head(df, df, settings, log=lambda record: None, progress=(path := scratch_path(spark, "progress")))
    heads.append(H.load_progress(spark, path, settings).head)
    assert np.allclose(heads[0].flat, want.flat, atol=1e-9)


def test_parts_come_near_the_sequential_fit_in_as_many_jobs(spark):
    """Validation loss within 0.05 with two and with eight parts, in as many jobs."""
    _, df = clusters(spark, 1600)
    losses, jobs = [], []
    for values in (10 ** 9, 4 * 800, 4 * 200):
        settings = H.HeadSettings(inputs=4, hidden=8, learning_rate=0.02, epochs=4, patience=9, batch_size=20, dropout=0.0, part_values=values)
        group = f"fit-{values}"
        spark.sparkContext.setJobGroup(group, group)
        losses.append(H.train_head(df, df, settings)[2][-1]["val/loss"])
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert max(losses) - min(losses) < 0.05 and jobs[1] == jobs[2], (losses, jobs)


def test_an_interrupted_fit_ends_like_a_whole_one(spark):
    _, df = clusters(spark)
    settings = H.HeadSettings(inputs=4, hidden=8, learning_rate=0.01, epochs=5, patience=9, batch_size=50)
    whole = H.train_head(df, df, settings)

    def stop(record):
        if record["epoch"] == 3:
            raise KeyboardInterrupt

    path = scratch_path(spark, "progress")
    with pytest.raises(KeyboardInterrupt):
        H.train_head(df, df, settings, log=stop, progress=path)
    seen = []
    resumed = H.train_head(df, df, settings, log=seen.append, progress=path)
    assert [r["epoch"] for r in seen] == [3, 4, 5]
    assert np.allclose(resumed[0].flat, whole[0].flat, atol=1e-9) and resumed[1] == whole[1]
    assert [r["epoch"] for r in resumed[2]] == [1, 2, 3, 4, 5]
    again = H.train_head(df, df, settings, log=lambda record: pytest.fail("trained"), progress=path)
    assert np.allclose(again[0].flat, whole[0].flat, atol=1e-9)
    with pytest.raises(ValueError):
        H.train_head(df, df, H.HeadSettings(inputs=4, hidden=8, learning_rate=0.5, epochs=5, batch_size=50), progress=path)
    on = H.train_head(df, df, settings, initial=whole[0])
    assert on[2][0]["train/loss"] < whole[2][0]["train/loss"]


@pytest.mark.parametrize("kind, params", [("lr", {"max_iter": 20}), ("mlp", {"inputs": 64, "hidden": 4, "epochs": 1})])
def test_load_or_fit(spark, tables, kind, params):
    df, path = two_class(spark, tables), scratch_path(spark, kind)
    first = K.load_or_fit(kind, path, df, df, **params)
    second = K.load_or_fit(kind, path, None, None, **params)   # would fail if it trained
    a, b = (c.predict(df).select("sentence_id", "predicted_label") for c in (first, second))
    assert a.exceptAll(b).count() == 0


def test_registered_head_trains_in_mini_batches():
    from sentspark.plans import vector_queries as Q

    assert Q._head_settings().batch_size == 100 and Q._head_settings().epochs == 10
