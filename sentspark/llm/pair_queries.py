"""Queries of the near-duplicate operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sentspark.llm.gray_simhash import simhash_groups
from sentspark.llm.parity_join import parity_join
from sentspark.llm.registry import query, table


def components_sql(shingle: int, num: int, den: int, source: str = "documents") -> str:
    """CTEs ``sets`` (doc_id, s) and ``comp`` (doc_id, component_id) by definition."""
    words = " || ' ' || ".join(f"w[i + {j}]" for j in range(shingle))
    return f"""RECURSIVE
    words AS (SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'),
        lambda x: x <> '') AS w FROM {source}),
    sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {shingle} THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(generate_series(1, len(w) - {shingle - 1}), lambda i: {words})) END AS s FROM words),
    grams AS (SELECT doc_id, unnest(s) AS g FROM sets),
    shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM shared JOIN sets sa ON sa.doc_id = a JOIN sets sb ON sb.doc_id = b
        WHERE {den} * n >= {num} * (len(sa.s) + len(sb.s) - n)),
    ways AS (SELECT a AS x, b AS y FROM links UNION ALL SELECT b, a FROM links),
    reach(doc_id, c) AS (SELECT doc_id, doc_id FROM sets UNION SELECT y, c FROM reach JOIN ways ON x = doc_id AND c < y),
    comp AS (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id)"""


@query("op4_parity_join", f"""WITH {components_sql(3, 90, 100)}
    SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets JOIN comp USING (doc_id)""")
def op4_parity_join(spark: SparkSession, folder: str) -> DataFrame:
    return parity_join(table(spark, folder, "documents"), shingle=3, num=90, den=100)


@query("op12_gray_simhash")
def op12_gray_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_groups(table(spark, folder, "documents"))
