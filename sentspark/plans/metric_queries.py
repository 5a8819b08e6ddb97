"""Queries over gold and predicted labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sentspark.functions.labels import HOLDOUT_CODES, TRAIN_CODES, argmax_index, encode, inverse, softmax
from sentspark.operators import counts as C, evaluation as E, history as H, linear as L, row_metrics as RM
from sentspark.plans import binding as B
from sentspark.plans.registry import ctes, per_class, query

_SCORES_SQL = """
SELECT round(avg(coalesce(f1, 0)), 6) AS "macro_F1", round(avg(coalesce(precision, 0)), 6) AS "macro_P",
       round(avg(coalesce(recall, 0)), 6) AS "macro_R",
       round(coalesce(max(f1) FILTER (category = 'SUBJ'), 0), 6) AS "SUBJ_F1",
       round(coalesce(max(precision) FILTER (category = 'SUBJ'), 0), 6) AS "SUBJ_P",
       round(coalesce(max(recall) FILTER (category = 'SUBJ'), 0), 6) AS "SUBJ_R",
       round(sum(tp) / sum(support), 6) AS accuracy
FROM scored"""


def _round(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return C.confusion(B.pairs(spark, d))


def _line_cells(spark: SparkSession, d: str) -> DataFrame:
    return C.confusion(B.line_pairs(spark, d))


def _vector_cells(spark: SparkSession, d: str) -> DataFrame:
    """Ten-class confusion of the vectors, predictions by argmax."""
    rows = B.with_logits(spark, d).select(F.col("class_id").alias("gold_label"), argmax_index(F.col("logits")).alias("pred_label"))
    return C.confusion(rows)


_VECTOR_CELLS = "vg AS (SELECT class_id AS gold, list_position(logits, list_max(logits)) - 1 AS pred FROM v)"


@query("evaluate_scores", ctes("g", "p", "pg") + ", " + per_class("pg") + _SCORES_SQL)
def evaluate_scores(spark, d):
    return _round(E.evaluate(B.predictions(spark, d), B.gold(spark, d)), *E.SCORES)


@query("evaluate_by_lang", ctes("g", "p", "pg") + """,
x AS (SELECT pg.*, lang FROM pg JOIN documents ON doc_id = sentence_id),
classes AS (SELECT lang, gold AS category FROM x UNION SELECT lang, pred FROM x),
prf AS (SELECT c.lang, c.category, count(*) FILTER (gold = category AND pred = category) AS tp,
          count(*) FILTER (gold = category) AS support, count(*) FILTER (pred = category) AS predicted
        FROM classes c JOIN x USING (lang) GROUP BY ALL),
scored AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted END AS precision,
          CASE WHEN support > 0 THEN tp / support END AS recall, 2.0 * tp / (support + predicted) AS f1 FROM prf)
""" + _SCORES_SQL.replace("SELECT round", "SELECT lang, round", 1) + " GROUP BY lang")
def evaluate_by_lang(spark, d):
    scores = E.evaluate_by(B.predictions(spark, d), B.sentences(spark, d).select("sentence_id", "lang", "label"), ["lang"])
    return _round(scores, *E.SCORES)


@query("score_line", ctes("g", "p", "pg") + ", " + per_class("pg") + ", e AS (" + _SCORES_SQL.replace(", 6)", ", 9)") + """)
SELECT concat_ws(chr(9) || chr(9), 'macro_F1:' || chr(9) || printf('%.2f', "macro_F1"), 'macro_P:' || chr(9) || chr(9) || printf('%.2f', "macro_P"),
 'macro_R:' || chr(9) || chr(9) || printf('%.2f', "macro_R"), 'SUBJ_F1:' || chr(9) || printf('%.2f', "SUBJ_F1"),
 'SUBJ_P:' || chr(9) || chr(9) || printf('%.2f', "SUBJ_P"), 'SUBJ_R:' || chr(9) || chr(9) || printf('%.2f', "SUBJ_R"),
 'accuracy:' || chr(9) || printf('%.2f', accuracy)) AS line FROM e""")
def score_line(spark, d):
    return E.score_line(E.evaluate(B.predictions(spark, d), B.gold(spark, d)))


@query("validate_report", ctes("g", "p") + """,
n AS (SELECT (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM g) AS ng,
        (SELECT count(*) FROM p JOIN g USING (sentence_id)) AS nj,
        (SELECT count(*) FROM p WHERE label = 'OBJ') AS n_obj, (SELECT count(*) FROM p WHERE label = 'SUBJ') AS n_subj,
        (SELECT count(DISTINCT sentence_id) FROM p ANTI JOIN g USING (sentence_id)) AS op,
        (SELECT count(DISTINCT sentence_id) FROM g ANTI JOIN p USING (sentence_id)) AS og),
c AS (SELECT 1 AS step, 'row counts' AS "check", np = ng AS ok, 'n_pred=' || np || ', n_gold=' || ng AS detail FROM n
 UNION ALL SELECT 2, 'columns', true, 'sentence_id, label'
 UNION ALL SELECT 3, 'label values', n_obj + n_subj = np AND np > 0, 'n_OBJ=' || n_obj || ', n_SUBJ=' || n_subj FROM n
 UNION ALL SELECT 4, 'ids', nj = np, 'n_joined=' || nj || ', ids_only_pred=' || op || ', ids_only_gold=' || og FROM n
 UNION ALL SELECT 5, 'gold labels', true, 'label in gold')
SELECT step, "check", ok, detail, coalesce(step = (SELECT min(step) FROM c WHERE NOT ok), false) AS first_failure FROM c""")
def validate_report(spark, d):
    return E.validate(B.predictions(spark, d), B.gold(spark, d))


@query("validate_merge", ctes("g", "p") + """
SELECT sentence_id, p.label AS pred_label, g.label AS gold_label FROM p JOIN g USING (sentence_id)""")
def validate_merge(spark, d):
    return E.validated_merge(B.predictions(spark, d), B.gold(spark, d))


@query("id_mismatch", """
SELECT doc_id AS sentence_id, 'pred only' AS side FROM labels ANTI JOIN documents USING (doc_id)
UNION ALL SELECT doc_id, 'gold only' FROM documents ANTI JOIN labels USING (doc_id)""")
def id_mismatch(spark, d):
    return E.id_mismatch(B.predictions(spark, d), B.texts(spark, d))


@query("score_join", ctes("g", "s") + """
SELECT sentence_id, s.label, l.toxic AS score FROM s JOIN labels l ON l.doc_id = sentence_id""")
def score_join(spark, d):
    scores = B.table(spark, d, "labels").select(F.col("doc_id").alias("sentence_id"), F.col("toxic").alias("score"))
    return E.join_scores(B.sentences(spark, d).select("sentence_id", "label"), scores)


@query("legend", ctes("g", "s") + " SELECT DISTINCT CASE label WHEN 'SUBJ' THEN 0 ELSE 1 END AS label_encoded, label FROM s")
def legend(spark, d):
    coded = B.sentences(spark, d).select(encode(F.col("label"), TRAIN_CODES).alias("label_encoded"), "label")
    return E.legend(coded, "label_encoded", "label")


@query("num_classes", ctes("g") + """
SELECT count(DISTINCT label) + max(CASE WHEN label IS NULL THEN 1 ELSE 0 END) AS num_classes
FROM documents LEFT JOIN g ON sentence_id = doc_id""")
def num_classes(spark, d):
    return C.num_classes(B.texts(spark, d).join(B.gold(spark, d), "sentence_id", "left"), "label")


@query("class_counts", ctes("g") + " SELECT CASE label WHEN 'SUBJ' THEN 0 ELSE 1 END AS label_encoded, count(*) AS n FROM g GROUP BY 1")
def class_counts(spark, d):
    return C.class_counts(B.gold(spark, d).withColumn("label_encoded", encode(F.col("label"))), "label_encoded")


@query("class_count_table", ctes("li") + """
SELECT c AS category, (SELECT count(*) FROM li WHERE gold = c) AS "count-labels", (SELECT count(*) FROM li WHERE pred = c)
  AS "count-predictions" FROM (SELECT DISTINCT gold AS c FROM li)
UNION ALL SELECT 'Total obs', count(*), count(*) FROM li""")
def class_count_table(spark, d):
    return C.class_count_table(_line_cells(spark, d))


@query("counts_transposed", ctes("li") + """
SELECT 'count-labels' AS side, count(*) FILTER (gold = 'OBJ') AS "OBJ", count(*) FILTER (gold = 'SUBJ') AS "SUBJ", count(*) AS "Total obs" FROM li
UNION ALL SELECT 'count-predictions', count(*) FILTER (pred = 'OBJ'), count(*) FILTER (pred = 'SUBJ'), count(*) FROM li""")
def counts_transposed(spark, d):
    return C.transposed_counts(_line_cells(spark, d), ["OBJ", "SUBJ"])


@query("accuracy", ctes("li") + " SELECT round(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END), 4) AS accuracy FROM li")
def accuracy(spark, d):
    return _round(C.accuracy(_line_cells(spark, d)), "accuracy", digits=4)


@query("confusion", ctes("v") + ", " + _VECTOR_CELLS + """
SELECT gold, pred::INTEGER AS pred, count(*) AS n FROM vg GROUP BY gold, pred""")
def confusion(spark, d):
    return _vector_cells(spark, d)


_FIXED = ctes("v") + ", " + _VECTOR_CELLS + """,
k AS (SELECT range::INTEGER AS category FROM range(12)),
cnt AS (SELECT category, (SELECT count(*) FROM vg WHERE gold = category AND pred = category) AS tp,
  (SELECT count(*) FROM vg WHERE gold = category) AS sup, (SELECT count(*) FROM vg WHERE pred = category) AS prd FROM k),
pr AS (SELECT category, CASE WHEN prd > 0 THEN tp / prd ELSE 0 END AS p, CASE WHEN sup > 0 THEN tp / sup ELSE 0 END AS r FROM cnt),
f AS (SELECT category, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM pr)
"""


@query("f1_classwise", _FIXED + "SELECT category, round(f1, 6) AS f1 FROM f")
def f1_classwise(spark, d):
    return _round(C.f1_classwise(_vector_cells(spark, d), 12), "f1")


@query("f1_macro_fixed", _FIXED + "SELECT round(avg(f1), 6) AS f1_macro FROM f")
def f1_macro_fixed(spark, d):
    return _round(C.f1_macro(_vector_cells(spark, d), 12), "f1_macro")


@query("macro_f1", ctes("v") + ", " + _VECTOR_CELLS + ", " + per_class("vg") + " SELECT round(avg(f1), 6) AS macro_f1 FROM scored")
def macro_f1(spark, d):
    return _round(C.macro_f1(_vector_cells(spark, d)), "macro_f1")


@query("prf_per_class", ctes("v") + ", " + _VECTOR_CELLS + ", " + per_class("vg") + """
SELECT category::INTEGER AS category, tp, support, predicted, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1 FROM scored""")
def prf_per_class(spark, d):
    return _round(C.precision_recall_f1(C.cell_totals(_vector_cells(spark, d))), "precision", "recall", "f1")


@query("prf_averages", ctes("v") + ", " + _VECTOR_CELLS + ", " + per_class("vg") + """
SELECT 'macro avg' AS average, round(avg(coalesce(precision, 0)), 6) AS precision, round(avg(coalesce(recall, 0)), 6) AS recall,
  round(avg(coalesce(f1, 0)), 6) AS f1, sum(support)::BIGINT AS support FROM scored
UNION ALL
SELECT 'weighted avg', round(sum(coalesce(precision, 0) * support) / sum(support), 6),
  round(sum(coalesce(recall, 0) * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM scored""")
def prf_averages(spark, d):
    scored = C.precision_recall_f1(C.cell_totals(_vector_cells(spark, d)))
    return _round(C.averages(scored, C.ZERO), "precision", "recall", "f1")


@query("prf_subj", ctes("li") + ", " + per_class("li") + """
SELECT category, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM scored WHERE category = 'SUBJ'""")
def prf_subj(spark, d):
    scored = C.precision_recall_f1(C.cell_totals(_line_cells(spark, d))).where("category = 'SUBJ'")
    return _round(scored.select("category", "precision", "recall", "f1", "support"), "precision", "recall", "f1")


def _report_sql(source: str, swapped: bool = False) -> str:
    rows = f"r AS (SELECT {'pred AS gold, gold AS pred' if swapped else 'gold, pred'} FROM {source})"
    return ctes(*(("g", "p", "pg") if source == "pg" else (source,))) + f", {rows}, " + per_class("r") + """,
acc AS (SELECT avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END) AS a FROM r)
SELECT category, round_even(precision, 4) AS precision, round_even(recall, 4) AS recall, round_even(f1, 4) AS "f1-score", support::DOUBLE AS support,
  support AS "count-labels", predicted AS "count-predictions" FROM scored
UNION ALL SELECT 'accuracy', round_even(a, 4), round_even(a, 4), round_even(a, 4), round_even(a, 4), NULL, NULL FROM acc
UNION ALL SELECT 'macro avg', round_even(avg(precision), 4), round_even(avg(recall), 4), round_even(avg(f1), 4), sum(support)::DOUBLE, NULL, NULL FROM scored
UNION ALL SELECT 'weighted avg', round_even(sum(precision * support) / sum(support), 4), round_even(sum(recall * support) / sum(support), 4),
  round_even(sum(f1 * support) / sum(support), 4), sum(support)::DOUBLE, NULL, NULL FROM scored"""


@query("class_report", _report_sql("pg"))
def class_report(spark, d):
    return C.class_report(_cells(spark, d))


@query("class_report_swapped", _report_sql("pg", swapped=True))
def class_report_swapped(spark, d):
    return C.class_report(_cells(spark, d), swap=True)


@query("holdout_report", ctes("g", "p", "pg") + ", r AS (SELECT gold, pred FROM pg), " + per_class("r") + """,
acc AS (SELECT avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END) AS a FROM r),
z AS (SELECT category, coalesce(precision, 0) AS precision, coalesce(recall, 0) AS recall, f1, support, predicted FROM scored)
SELECT category, round_even(precision, 2) AS precision, round_even(recall, 2) AS recall, round_even(f1, 2) AS "f1-score", support::DOUBLE AS support,
  support AS "count-labels", predicted AS "count-predictions" FROM z
UNION ALL SELECT 'accuracy', round_even(a, 2), round_even(a, 2), round_even(a, 2), round_even(a, 2), NULL, NULL FROM acc
UNION ALL SELECT 'macro avg', round_even(avg(precision), 2), round_even(avg(recall), 2), round_even(avg(f1), 2), sum(support)::DOUBLE, NULL, NULL FROM z
UNION ALL SELECT 'weighted avg', round_even(sum(precision * support) / sum(support), 2), round_even(sum(recall * support) / sum(support), 2),
  round_even(sum(f1 * support) / sum(support), 2), sum(support)::DOUBLE, NULL, NULL FROM z""")
def holdout_report(spark, d):
    """Report over class codes, shown by name, undefined scores 0."""
    coded = B.pairs(spark, d).withColumns({c: encode(F.col(c), HOLDOUT_CODES) for c in ("gold_label", "pred_label")})
    return C.class_report(C.confusion(coded), 2, zero_rule=C.ZERO, names=inverse(HOLDOUT_CODES))


@query("class_f1_pick", ctes("li") + ", " + per_class("li") + " SELECT round_even(f1, 4) AS \"f1-score\" FROM scored WHERE category = 'OBJ'")
def class_f1_pick(spark, d):
    return C.report_cell(C.class_report(_line_cells(spark, d)), "OBJ")


@query("class_weights_effective", ctes("v") + """,
c AS (SELECT class_id, count(*) AS n FROM v GROUP BY 1),
w AS (SELECT class_id, n, (1 - 0.9999::DOUBLE) / (1 - pow(0.9999::DOUBLE, n)) AS w FROM c)
SELECT class_id, n, round(w / (SELECT sum(w) FROM w) * (SELECT count(*) FROM w), 6) AS weight FROM w""")
def class_weights_effective(spark, d):
    counts = C.class_counts(B.vectors(spark, d), "class_id")
    return _round(C.effective_weights(counts, "class_id"), "weight")


@query("class_weights_balanced", ctes("v") + """
SELECT class_id, count(*) AS n, round((SELECT count(*) FROM v) / ((SELECT count(DISTINCT class_id) FROM v) * count(*)), 6) AS weight
FROM v GROUP BY class_id""")
def class_weights_balanced(spark, d):
    counts = C.class_counts(B.vectors(spark, d), "class_id")
    return _round(C.balanced_weights(counts, "class_id"), "weight")


@query("label_index", """
SELECT event_type, (dense_rank() OVER (ORDER BY event_type) - 1)::INTEGER AS label_encoded, count(*) AS n FROM events GROUP BY event_type""")
def label_index(spark, d):
    coded = L.label_codes(B.table(spark, d, "events").select("event_type"), "event_type")
    return coded.groupBy("event_type", "label_encoded").agg(F.count(F.lit(1)).alias("n"))


@query("history_long", ctes("li") + """,
cells AS (SELECT epoch, c AS category, count(*) FILTER (gold = c AND pred = c) AS tp, count(*) FILTER (gold = c) AS sup,
   count(*) FILTER (pred = c) AS prd FROM li, (SELECT unnest(['OBJ', 'SUBJ']) AS c) GROUP BY ALL),
f AS (SELECT epoch, category, 2.0 * tp / (sup + prd) AS f1 FROM cells WHERE sup + prd > 0)
SELECT 'lineitem' AS run_id, epoch::INTEGER AS epoch, 'val/' || category || '_class_f1' AS metric, round_even(f1, 4) AS value FROM f
UNION ALL SELECT 'lineitem', epoch::INTEGER, 'val/macro_f1', round_even(avg(f1), 4) FROM f GROUP BY epoch
UNION ALL SELECT 'lineitem', epoch::INTEGER, 'val/accuracy', round_even(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END), 4) FROM li GROUP BY epoch""")
def history_long(spark, d):
    cells = C.confusion(B.line_pairs(spark, d), by=["epoch"])
    scores = C.score_all(cells, C.METRICS, ["epoch"])
    single = C.class_f1(cells, ["epoch"]).select(
        "epoch", F.concat("category", F.lit("_class_f1")).alias("name"), F.bround("f1", 4).alias("value")
    )
    return scores.unionByName(single).select(
        F.lit("lineitem").alias("run_id"), "epoch", F.concat(F.lit("val/"), "name").alias("metric"), "value"
    )


@query("best_epoch", ctes("hist") + """
SELECT run_id, epoch AS best_epoch, score AS best_score FROM hist
QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY score DESC, epoch) = 1""")
def best_epoch(spark, d):
    return H.best_epoch(B.history(spark, d))


@query("early_stop", "WITH RECURSIVE " + ctes("hist")[5:] + """,
o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS k FROM hist),
loop AS (
  SELECT run_id, k, epoch, score, true AS improved, score AS best, 0 AS waited, 'logged' AS status FROM o WHERE k = 1
  UNION ALL
  SELECT o.run_id, o.k, o.epoch, o.score, o.score > l.best, greatest(o.score, l.best),
    CASE WHEN o.score > l.best THEN 0 ELSE l.waited + 1 END,
    CASE WHEN l.status <> 'logged' THEN 'not run' WHEN o.score <= l.best AND l.waited + 1 >= 2 THEN 'stopped' ELSE 'logged' END
  FROM loop l JOIN o ON o.run_id = l.run_id AND o.k = l.k + 1)
SELECT run_id, epoch, score, improved, waited, status FROM loop""")
def early_stop(spark, d):
    return H.early_stopping(B.history(spark, d), patience=2)


# --- scores over rows -------------------------------------------------------------------------

@query("row_scores", ctes("v", "soft") + """
SELECT class_id, round(avg(-ln(p[class_id + 1])), 6) AS log_loss,
  round(avg(list_sum(list_transform(p, lambda x, i: pow(x - CASE WHEN i = class_id + 1 THEN 1 ELSE 0 END, 2)))), 6) AS brier,
  round(corr(p[1], p[2]), 6) AS correlation FROM soft GROUP BY 1""")
def row_scores(spark, d):
    rows = B.with_logits(spark, d).withColumn("p", softmax(F.col("logits")))
    p, code = F.col("p"), F.col("class_id")
    metrics = {"log_loss": RM.log_loss(p, code), "brier": RM.brier(p, code), "correlation": RM.correlation(p[0], p[1])}
    return RM.score_rows(rows, metrics, ["class_id"]).select("class_id", *[F.round(c, 6).alias(c) for c in metrics])


@query("rank_auc", ctes("li") + """,
s AS (SELECT epoch, gold = 'SUBJ' AS positive, l_quantity AS score FROM (SELECT year(l_shipdate) AS epoch, l_quantity,
  CASE l_returnflag WHEN 'N' THEN 'OBJ' ELSE 'SUBJ' END AS gold FROM lineitem)),
c AS (SELECT epoch, score, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS n FROM s GROUP BY 1, 2),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY epoch ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
SELECT epoch, sum(p)::BIGINT AS positives, sum(n)::BIGINT AS negatives, round(sum(p * (below + n / 2.0)) / nullif(sum(p) * sum(n), 0), 6) AS auc FROM b GROUP BY 1""")
def rank_auc(spark, d):
    """How well the quantity of a line tells its flag, by year."""
    rows = B.table(spark, d, "lineitem").select(F.year("l_shipdate").alias("epoch"), "l_quantity", (F.col("l_returnflag") != "N").alias("positive"))
    scored = RM.rank_auc(rows, F.col("l_quantity"), F.col("positive"), ["epoch"])
    return scored.withColumn("auc", F.round("auc", 6))
