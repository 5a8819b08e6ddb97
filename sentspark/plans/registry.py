"""Registered queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Common table expressions shared by the SQL texts.
CTES = {
    "g": "g AS (SELECT doc_id AS sentence_id, CASE quality WHEN 0 THEN 'SUBJ' ELSE 'OBJ' END AS label FROM labels)",
    "p": "p AS (SELECT doc_id AS sentence_id, CASE toxic WHEN 1 THEN 'SUBJ' ELSE 'OBJ' END AS label FROM labels)",
    "pg": "pg AS (SELECT p.sentence_id, p.label AS pred, g.label AS gold FROM p JOIN g USING (sentence_id))",
    "li": "li AS (SELECT year(l_shipdate) AS epoch, CASE l_returnflag WHEN 'N' THEN 'OBJ' ELSE 'SUBJ' END AS gold,"
          " CASE l_linestatus WHEN 'O' THEN 'OBJ' ELSE 'SUBJ' END AS pred FROM lineitem)",
    "s": "s AS (SELECT d.doc_id AS sentence_id, d.text AS sentence, d.lang, d.source, g.label FROM documents d"
         " JOIN g ON g.sentence_id = d.doc_id)",
    "v": "v AS (WITH entries AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),"
         " averages AS (SELECT label, i, avg(x) AS m FROM entries GROUP BY 1, 2),"
         " means AS (SELECT label AS k, list(m ORDER BY i) AS mean FROM averages GROUP BY 1),"
         " products AS (SELECT vec_id, list(list_dot_product(embedding::DOUBLE[], mean) ORDER BY k) AS logits FROM embeddings, means GROUP BY 1)"
         " SELECT vec_id, label AS class_id, embedding::DOUBLE[] AS e, logits FROM embeddings JOIN products USING (vec_id))",
    "soft": "soft AS (SELECT vec_id, class_id, list_transform(logits, lambda x: exp(x) / list_sum(list_transform(logits,"
            " lambda y: exp(y)))) AS p FROM v)",
    "hist": "hist AS (SELECT event_type AS run_id, day(ts)::INTEGER AS epoch, round(avg(value), 6) AS score FROM events GROUP BY 1, 2)",
}


def ctes(*names: str) -> str:
    return "WITH " + ", ".join(CTES[n] for n in names)


def per_class(source: str) -> str:
    """Scores per class by definition, as CTEs ``classes`` and ``prf`` over (gold, pred)."""
    return f"""classes AS (SELECT gold AS category FROM {source} UNION SELECT pred FROM {source}),
    prf AS (SELECT category,
        (SELECT count(*) FROM {source} WHERE gold = category AND pred = category) AS tp,
        (SELECT count(*) FROM {source} WHERE gold = category) AS support,
        (SELECT count(*) FROM {source} WHERE pred = category) AS predicted
      FROM classes),
    scored AS (SELECT category, tp, support, predicted,
        CASE WHEN predicted > 0 THEN tp / predicted END AS precision,
        CASE WHEN support > 0 THEN tp / support END AS recall,
        2.0 * tp / (support + predicted) AS f1 FROM prf)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
