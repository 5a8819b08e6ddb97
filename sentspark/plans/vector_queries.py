"""Queries over vectors, layouts and classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentspark.functions import losses, vectors as V
from sentspark.functions.labels import argmax_index, softmax
from sentspark.operators import (
    counts as C, embedding as EM, forest as A, graphs as G, head as H, layout as Y, linear as L, neighbours as N, sampling as S,
)
from sentspark.plans import binding as B
from sentspark.plans.registry import ctes, query
from sentspark.session import materialize, scratch_path
from sentspark.sources import sinks as W


def _round(df, *names: str, digits: int = 6):
    return df.withColumns({n: F.round(n, digits) for n in names})


# --- expressions over vectors ---------------------------------------------------

@query("argmax_class", ctes("v") + " SELECT vec_id, (list_position(e, list_max(e)) - 1)::INTEGER AS class_id FROM v")
def argmax_class(spark, d):
    return B.vectors(spark, d).select("vec_id", argmax_index(F.col("embedding")).alias("class_id"))


@query("softmax", ctes("v", "soft") + """
SELECT vec_id, round(p[1], 6) AS p_first, round(p[class_id + 1], 6) AS p_true, round(list_max(p), 6) AS p_max FROM soft""")
def softmax_query(spark, d):
    p = B.with_logits(spark, d).withColumn("p", softmax(F.col("logits")))
    return p.select(
        "vec_id", F.round(F.col("p")[0], 6).alias("p_first"), F.round(F.get("p", F.col("class_id")), 6).alias("p_true"),
        F.round(F.array_max("p"), 6).alias("p_max"),
    )


@query("loss_cross_entropy", ctes("v", "soft") + " SELECT vec_id, round(-ln(p[class_id + 1]), 6) AS loss FROM soft")
def loss_cross_entropy(spark, d):
    p = softmax(F.col("logits"))
    return B.with_logits(spark, d).select("vec_id", F.round(losses.cross_entropy(p, F.col("class_id")), 6).alias("loss"))


@query("loss_focal", ctes("v", "soft") + """,
c AS (SELECT class_id, (1 - 0.9999::DOUBLE) / (1 - pow(0.9999::DOUBLE, count(*))) AS w FROM v GROUP BY 1),
n AS (SELECT class_id, w / (SELECT sum(w) FROM c) * (SELECT count(*) FROM c) AS w FROM c)
SELECT vec_id, round(-w * pow(1 - p[class_id + 1], 2) * ln(p[class_id + 1]), 6) AS loss FROM soft JOIN n USING (class_id)""")
def loss_focal(spark, d):
    rows = B.with_logits(spark, d)
    # One row per class, so the join side is as small as the class list.
    weights = C.effective_weights(C.class_counts(rows, "class_id"), "class_id").select("class_id", "weight")
    loss = losses.focal(softmax(F.col("logits")), F.col("class_id"), F.col("weight"), 2.0)
    return rows.join(F.broadcast(weights), "class_id").select("vec_id", F.round(loss, 6).alias("loss"))


@query("mean_of_batch_means", ctes("v", "soft") + """,
l AS (SELECT (row_number() OVER (ORDER BY vec_id) - 1) // 32 AS b, -ln(p[class_id + 1]) AS loss FROM soft),
m AS (SELECT b, avg(loss) AS m FROM l GROUP BY b) SELECT round(avg(m), 6) AS mean_loss FROM m""")
def mean_of_batch_means(spark, d):
    loss = losses.cross_entropy(softmax(F.col("logits")), F.col("class_id"))
    rows = B.with_logits(spark, d).select("vec_id", loss.alias("loss"))
    return _round(S.mean_of_batch_means(S.assign_batches(rows, 32, id_column="vec_id"), "batch_id", "loss"), "mean_loss")


@query("pool_vectors", ctes("v") + """,
k AS (SELECT *, vec_id // 4 AS g, CASE WHEN class_id > 2 THEN 1 ELSE 0 END AS keep FROM v),
x AS (SELECT g, vec_id, keep, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM k),
m AS (SELECT g, i, avg(x) FILTER (keep = 1) AS m FROM x GROUP BY g, i),
first AS (SELECT g, min(vec_id) AS vec_id FROM k GROUP BY g)
SELECT f.g AS sentence_id, round(any_value(v.e[1]), 6) AS first_1, round(list_sum(any_value(v.e)), 6) AS first_sum,
  round(max(m.m) FILTER (i = 1), 6) AS mean_1, round(sum(m.m), 6) AS mean_sum
FROM first f JOIN v USING (vec_id) JOIN m ON m.g = f.g GROUP BY f.g""")
def pool_vectors(spark, d):
    """Four vectors in a row stand for the tokens of one sentence."""
    token = F.struct("vec_id", "embedding", F.when(F.col("class_id") > 2, 1).otherwise(0).alias("keep"))
    grouped = (
        B.vectors(spark, d).groupBy(F.expr("vec_id div 4").alias("sentence_id"))
        .agg(F.sort_array(F.collect_list(token)).alias("tokens"))
    )
    pooled = grouped.select(
        "sentence_id", V.pool_first(F.col("tokens.embedding")).alias("first"),
        V.pool_mean(F.col("tokens.embedding"), F.col("tokens.keep")).alias("mean"),
    )
    return pooled.select(
        "sentence_id", F.round(F.col("first")[0].cast("double"), 6).alias("first_1"), F.round(V.total(F.col("first")), 6).alias("first_sum"),
        F.round(F.col("mean")[0], 6).alias("mean_1"), F.round(V.total(F.col("mean")), 6).alias("mean_sum"),
    )


@query("vector_distance", ctes("v") + """
SELECT a.vec_id, round(sqrt(list_inner_product(a.e, a.e)), 6) AS norm, round(list_inner_product(a.e, b.e), 6) AS dot,
  round(list_distance(a.e, b.e), 6) AS distance FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""")
def vector_distance(spark, d):
    rows = B.vectors(spark, d)
    following = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    a, b = F.col("embedding"), F.col("other")
    return rows.join(following, "vec_id").select(
        "vec_id", F.round(V.norm(a), 6).alias("norm"), F.round(V.dot(a, b), 6).alias("dot"), F.round(V.euclidean(a, b), 6).alias("distance")
    )


# --- embeddings ---------------------------------------------------------------------

@query("embed_hashed")
def embed_hashed(spark, d):
    texts = B.texts(spark, d, even=True).select("sentence_id", "sentence")
    return EM.embed_hashed(texts, EM.hashed_encoder(texts)).drop("sentence")


@query("embed_cached")
def embed_cached(spark, d):
    texts = B.texts(spark, d, even=True).select("sentence_id", "sentence")
    path = W.cache_path(scratch_path(spark, "cache"), "hashed/256", 128, "documents")

    def compute():
        return EM.embed_hashed(texts, EM.hashed_encoder(texts)).drop("sentence")

    W.load_or_compute(spark, path, compute)
    return W.load_or_compute(spark, path, compute)


@query("cache_growth", """
SELECT 'labelled' AS call, count(DISTINCT text) AS known FROM documents JOIN labels USING (doc_id)
UNION ALL SELECT 'all', count(DISTINCT text) FROM documents""")
def cache_growth(spark, d):
    """Different texts with a vector after the labelled sentences, and after all: the
    second call makes those of the others only."""
    texts = B.texts(spark, d, even=True).select("sentence_id", "sentence")
    path, encoder = scratch_path(spark, "vectors"), EM.hashed_encoder(texts)
    rows = []
    for call, df in (("labelled", texts.join(B.gold(spark, d).select("sentence_id"), "sentence_id")), ("all", texts)):
        W.cached_embeddings(spark, df, path, lambda part: EM.embed_hashed(part, encoder))
        rows.append((call, spark.read.parquet(f"{path}/*").count()))
    return spark.createDataFrame(rows, "call string, known bigint")


# --- neighbours, graphs and layouts ------------------------------------------------------

_KNN = ctes("v") + """,
n AS (SELECT a.vec_id AS i, b.vec_id AS j, list_distance(a.e, b.e) AS distance FROM v a JOIN v b ON a.vec_id <> b.vec_id),
k AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY distance, j)::INTEGER AS rank, distance FROM n QUALIFY rank <= 5)
"""


@query("knn_exact", _KNN + "SELECT i, j, rank, round(distance, 6) AS distance FROM k")
def knn_exact(spark, d):
    return _round(N.knn_graph(B.vectors(spark, d), 5), "distance")


def _knn_sql(k: int) -> str:
    return _KNN.replace("rank <= 5", f"rank <= {k}")


# Up to GROUP vectors are one cell, within which all are compared: then the search is exact.
@query("knn_approx", _knn_sql(15) + "SELECT i, j, rank, round(distance, 6) AS distance FROM k")
def knn_approx(spark, d):
    return _round(A.knn_approx(B.vectors(spark, d), 15), "distance")


@query("fuzzy_union", _KNN + """, w AS (SELECT i, j, exp(-distance) AS a FROM k),
u AS (SELECT coalesce(x.i, y.j) AS i, coalesce(x.j, y.i) AS j, coalesce(x.a, 0) AS a, coalesce(y.a, 0) AS b
      FROM w x FULL JOIN w y ON x.i = y.j AND x.j = y.i)
SELECT DISTINCT i, j, round(a + b - a * b, 6) AS weight FROM u""")
def fuzzy_union(spark, d):
    knn = N.knn_graph(B.vectors(spark, d), 5)
    return _round(G.fuzzy_union(knn.select("i", "j", F.exp(-F.col("distance")).alias("weight"))), "weight")


@query("umap_graph", _knn_sql(15).replace("WITH ", "WITH RECURSIVE ", 1) + """,
lists AS (SELECT i, list(distance ORDER BY rank) AS ds, coalesce(min(distance) FILTER (distance > 0), 0) AS rho, avg(distance) AS mean, log2(greatest(count(*), 2)) AS target
  FROM k GROUP BY i),
tries AS (SELECT i, ds, rho, mean, target, 0 AS t, 0::DOUBLE AS low, 'inf'::DOUBLE AS high, 1::DOUBLE AS sigma FROM lists
  UNION ALL SELECT i, ds, rho, mean, target, t + 1, CASE WHEN over THEN low ELSE sigma END, CASE WHEN over THEN sigma ELSE high END,
    CASE WHEN over THEN (low + sigma) / 2 WHEN isinf(high) THEN sigma * 2 ELSE (sigma + high) / 2 END
  FROM (SELECT *, list_sum(list_transform(ds, lambda x: exp(-greatest(x - rho, 0) / sigma))) > target AS over FROM tries WHERE t < 64)),
w AS (SELECT k.i, k.j, exp(-greatest(distance - rho, 0) / greatest(sigma, 0.001 * mean)) AS a FROM k JOIN tries ON tries.i = k.i AND t = 64),
u AS (SELECT coalesce(x.i, y.j) AS i, coalesce(x.j, y.i) AS j, coalesce(x.a, 0) AS a, coalesce(y.a, 0) AS b
      FROM w x FULL JOIN w y ON x.i = y.j AND x.j = y.i)
SELECT DISTINCT i, j, round(a + b - a * b, 6) AS weight FROM u""")
def umap_graph(spark, d):
    return _round(G.umap_graph(N.knn_graph(B.vectors(spark, d), 15)), "weight")


@query("near_pairs", _knn_sql(15) + """,
scales AS (SELECT i AS j, greatest(coalesce(avg(distance) FILTER (rank BETWEEN 4 AND 6), avg(distance)), 1e-10) AS scale FROM k GROUP BY i),
placed AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY distance * distance / scale, j) AS place FROM k JOIN scales USING (j))
SELECT i, j FROM placed WHERE place <= 5""")
def near_pairs(spark, d):
    return G.near_pairs(N.knn_graph(B.vectors(spark, d), 15), 5)


@query("pacmap_pairs")
def pacmap_pairs(spark, d):
    indexed = G.index_rows(B.vectors(spark, d), "vec_id", "embedding", 42)
    return G.pacmap_pairs(indexed, N.knn_graph(indexed, 10 + G.EXTRA_NEIGHBOURS, "idx", "vec"), indexed.count())


@query("pca_2d")
def pca_2d(spark, d):
    return Y.reduce_vectors(B.labelled_vectors(spark, d), "pca")





@query("layout_2d")
def layout_2d(spark, d):
    rows = B.labelled_vectors(spark, d)
    return Y.layout_table(rows, Y.reduce_vectors(rows, "pacmap", {"n_neighbors": 10, "MN_ratio": 0.5, "FP_ratio": 2.0}))


@query("layout_2d_umap")
def layout_2d_umap(spark, d):
    rows = B.labelled_vectors(spark, d)
    params = {"n_neighbors": 15, "n_components": 2, "metric": "euclidean", "random_state": 42}
    return Y.layout_table(rows, Y.reduce_vectors(rows, "umap", params))


@query("layout_bins", ctes("v") + """,
q AS (SELECT class_id, list_sum(e) AS x, sqrt(list_dot_product(e, e)) AS y FROM v),
r AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM q)
SELECT least(floor((x - x0) * 8 / (x1 - x0)), 7)::INTEGER AS bx, least(floor((y - y0) * 8 / (y1 - y0)), 7)::INTEGER AS "by",
  class_id AS label, count(*) AS n FROM q, r GROUP BY ALL""")
def layout_bins(spark, d):
    entries = F.transform("embedding", lambda x: x.cast("double"))
    points = B.table(spark, d, "embeddings").select(V.total(entries).alias("x"), V.norm(entries).alias("y"), F.col("label").alias("class_id"))
    return Y.density_bins(points, "x", "y", 8, "class_id")


# --- classifiers ----------------------------------------------------------------------------

@query("lr_fit_coefficients")
def lr_fit_coefficients(spark, d):
    values = L.coefficients(L.fit_logistic(B.labelled_vectors(spark, d)))
    names = [f"w{i}" for i in range(len(values) - 1)] + ["intercept"]
    return spark.createDataFrame(list(zip(names, values)), "name string, value double")


@query("lr_predictions")
def lr_predictions(spark, d):
    """Fit on the labelled sentences, predict the unlabelled ones; ids ride along."""
    texts, gold = B.texts(spark, d, even=True), B.gold(spark, d)
    labelled, rest = texts.join(gold, "sentence_id"), texts.join(gold, "sentence_id", "left_anti")
    encoder = EM.hashed_encoder(labelled)
    # The solver reads its rows many times: they are encoded once.
    train = materialize(EM.embed_hashed(labelled.select("sentence_id", "sentence", "label"), encoder).drop("sentence"), "train")
    model = L.fit_logistic(train)
    return W.submission(L.predict_logistic(model, EM.embed_hashed(rest.select("sentence_id", "sentence"), encoder)))


def _head_settings(**changes) -> H.HeadSettings:
    return H.HeadSettings(**{"inputs": 64, "hidden": 32, "learning_rate": 0.01, "epochs": 10, "batch_size": 100, **changes})


@query("mlp_train")
def mlp_train(spark, d):
    """The logged epochs."""
    train, val = S.train_val_split(B.labelled_vectors(spark, d), 0.8, 42)
    _, _, logged = H.train_head(train, val, _head_settings())
    rows = [(r["epoch"], name, None if value is None else float(value)) for r in logged for name, value in r.items() if name != "epoch"]
    return spark.createDataFrame(rows, "epoch int, metric string, value double")


@query("score_test")
def score_test(spark, d):
    """Logits and labels of the validation part by a head fitted to the other part."""
    train, val = S.train_val_split(B.labelled_vectors(spark, d), 0.8, 42)
    head, _, _ = H.train_head(train, val, _head_settings())
    scored = H.predicted(H.score(val.drop("label", "label_encoded"), head, "embedding"))
    return scored.select("sentence_id", F.col("logits")[0].alias("logit_0"), F.col("logits")[1].alias("logit_1"), "predicted_label")
