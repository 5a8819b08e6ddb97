"""Queries over sources, sampling and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sentspark.functions import formatting as fmt
from sentspark.functions.labels import HOLDOUT_CODES, TRAIN_CODES, decode, inverse, threshold_label
from sentspark.operators import embedding as EM, history as H, profile as P, sampling as S, tokens as K
from sentspark.operators.encoding import encode_labels
from sentspark.plans import binding as B
from sentspark.plans.registry import ctes, query
from sentspark.session import even_out, scratch_path
from sentspark.sources import readers as R, sinks as W

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]')"


# --- sources and sinks -------------------------------------------------------

@query("scan_json", "SELECT doc_id, md5(text) AS text_md5, lang, source, n_chars FROM documents")
def scan_json(spark, d):
    documents = B.table(spark, d, "documents")
    path = scratch_path(spark, "json")
    W.write_json_arrays(documents, path)
    read = R.read_json_records(spark, path, documents.schema, whole_documents=False)
    return read.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "lang", "source", "n_chars")


@query("scan_tsv_quoted", ctes("g", "s") + " SELECT sentence_id::VARCHAR AS sentence_id, md5(sentence) AS sentence_md5, label FROM s")
def scan_tsv_quoted(spark, d):
    path = scratch_path(spark, "quoted")
    W.write_delimited(B.sentences(spark, d).select("sentence_id", "sentence", "label"), path)
    read = R.read_delimited(spark, path, separator="\t", line_breaks=True)
    return read.select("sentence_id", F.md5(F.col("sentence").cast("binary")).alias("sentence_md5"), "label")


_MISSING = ", ".join(f"'{w}'" for w in R.MISSING_WORDS)


@query("scan_tsv_raw", f"""
WITH x AS (SELECT conv_id || ':' || turn AS sentence_id, regexp_replace(text, '[\\t\\r\\n]+', ' ', 'g') AS t, role FROM conversations)
SELECT sentence_id, md5(CASE WHEN t IN ({_MISSING}) THEN NULL ELSE t END) AS sentence_md5, role AS label FROM x""")
def scan_tsv_raw(spark, d):
    rows = B.table(spark, d, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("sentence_id"),
        F.regexp_replace("text", "[\t\r\n]+", " ").alias("sentence"), F.col("role").alias("label"),
    )
    path = scratch_path(spark, "unquoted")
    W.write_unquoted(rows, path)
    read = R.read_unquoted(spark, path)
    return read.select("sentence_id", F.md5(F.col("sentence").cast("binary")).alias("sentence_md5"), "label")


@query("load_splits", ctes("g", "s") + """
SELECT CASE lang WHEN 'en' THEN 'train' ELSE 'val' END AS split, sentence_id::VARCHAR AS sentence_id, md5(sentence) AS sentence_md5, label FROM s
UNION ALL SELECT 'test', doc_id::VARCHAR, md5(text), NULL FROM documents ANTI JOIN labels USING (doc_id)""")
def load_splits(spark, d):
    labelled = B.sentences(spark, d).select("sentence_id", "sentence", "label", "lang")
    parts = {
        "train": labelled.where("lang = 'en'").drop("lang"), "val": labelled.where("lang <> 'en'").drop("lang"),
        "test": B.unlabelled(spark, d).select("sentence_id", "sentence"),
    }
    paths = {name: scratch_path(spark, name) for name in parts}
    for name, part in parts.items():
        W.write_delimited(part, paths[name])
    splits = R.union_splits(R.read_splits(spark, paths, unlabelled=("test",), line_breaks=True))
    return splits.select("split", "sentence_id", F.md5(F.col("sentence").cast("binary")).alias("sentence_md5"), "label")


@query("submission", ctes("g", "p", "s") + " SELECT s.sentence_id, p.label FROM s JOIN p USING (sentence_id)")
def submission(spark, d):
    predicted = B.predictions(spark, d).withColumnRenamed("label", "predicted_label")
    return W.submission(B.sentences(spark, d).join(predicted, "sentence_id"))


@query("run_id", """
SELECT lang, count(*) AS n, 'hashed-' || lang || '_' || '_max_length128_bs100_lr2e-05' || CASE lang WHEN 'de' THEN '_r2l' ELSE '' END
  || '_losscross_entropy' AS run_id FROM documents GROUP BY lang""")
def run_id(spark, d):
    runs = B.texts(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    name = fmt.run_name(
        F.concat(F.lit("hashed/"), "lang"), F.concat(F.lit("train_"), "lang"), F.lit(128), F.lit(100), F.lit("2e-05"),
        F.lit("cross_entropy"), F.col("lang") == "de",
    )
    return runs.select("lang", "n", name.alias("run_id"))


# --- label codes and formatting ------------------------------------------------

@query("encode_labels", ctes("g", "s") + " SELECT sentence_id, label, CASE label WHEN 'SUBJ' THEN 0 ELSE 1 END AS label_encoded FROM s")
def encode_labels_query(spark, d):
    return encode_labels(B.sentences(spark, d).select("sentence_id", "label"), TRAIN_CODES)


@query("decode_labels", """
SELECT doc_id AS sentence_id, CASE quality WHEN 0 THEN 'SUBJ' ELSE 'OBJ' END AS train_label,
  CASE toxic WHEN 0 THEN 'OBJ' ELSE 'SUBJ' END AS holdout_label FROM labels""")
def decode_labels(spark, d):
    return B.table(spark, d, "labels").select(
        F.col("doc_id").alias("sentence_id"), decode(F.col("quality"), inverse(TRAIN_CODES)).alias("train_label"),
        decode(F.col("toxic"), inverse(HOLDOUT_CODES)).alias("holdout_label"),
    )


@query("threshold_labels", ctes("v") + """
SELECT vec_id, CASE WHEN logits[1] >= 0.02 THEN 'SUBJ' ELSE 'OBJ' END AS label FROM v""")
def threshold_labels(spark, d):
    return B.with_logits(spark, d).select("vec_id", threshold_label(F.col("logits")[0], 0.02).alias("label"))


@query("len_chars", "SELECT doc_id AS sentence_id, length(text)::INTEGER AS n_chars FROM documents")
def len_chars(spark, d):
    return B.texts(spark, d).select("sentence_id", F.length("sentence").alias("n_chars"))


@query("format_time", """
WITH t AS (SELECT l_orderkey, l_linenumber, round_even(l_extendedprice * 10, 0)::BIGINT AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN s >= 86400 THEN (s // 86400) || CASE WHEN s // 86400 = 1 THEN ' day, ' ELSE ' days, ' END ELSE '' END
  || printf('%d:%02d:%02d', s % 86400 // 3600, s % 3600 // 60, s % 60) AS elapsed FROM t""")
def format_time(spark, d):
    seconds = F.col("l_extendedprice") * 10
    return even_out(B.table(spark, d, "lineitem")).select("l_orderkey", "l_linenumber", fmt.format_time(seconds).alias("elapsed"))


def _short_sql(x: str) -> str:
    text = f"CASE WHEN {x} >= 1000 THEN printf('%.0f', {x}) ELSE printf('%.4g', {x}) END"
    bare = f"regexp_replace({text}, '^(-?)0\\.', '\\1.')"
    return f"CASE WHEN {bare} LIKE '.%' THEN rpad({bare}, greatest(5, length({bare}))::INTEGER, '0') ELSE {bare} END"


@query("float_format", f"""
SELECT l_orderkey, l_linenumber, {_short_sql('l_extendedprice')} AS price, {_short_sql('(l_discount / 7)')} AS share,
  l_linenumber::VARCHAR AS line FROM lineitem""")
def float_format(spark, d):
    return even_out(B.table(spark, d, "lineitem")).select(
        "l_orderkey", "l_linenumber", fmt.short_float(F.col("l_extendedprice")).alias("price"),
        fmt.short_float(F.col("l_discount") / 7).alias("share"), fmt.short_int(F.col("l_linenumber")).alias("line"),
    )


@query("array_format", f"""
SELECT l_orderkey, l_linenumber, '[' || ({_short_sql('l_quantity')}) || ',' || ({_short_sql('l_discount')}) || ',' || ({_short_sql('l_tax')}) || ']' AS shown
FROM lineitem""")
def array_format(spark, d):
    return even_out(B.table(spark, d, "lineitem")).select(
        "l_orderkey", "l_linenumber", fmt.short_list(F.array("l_quantity", "l_discount", "l_tax")).alias("shown")
    )


# --- profiles --------------------------------------------------------------------

def _describe_sql(source: str, value: str, by: str = "") -> str:
    """Nearest-rank statistics by definition from the sorted values."""
    part, first, using = (f"PARTITION BY {by}", f"{by}, ", f"GROUP BY {by}") if by else ("", "", "")
    ranks = "".join(
        f", max(v) FILTER (k = floor((n - 1) * {q} + 0.5)) AS \"{name}\"" for name, q in P.QUANTILES.items()
    )
    return f"""
o AS (SELECT {first}{value} AS v, row_number() OVER ({part} ORDER BY {value}) - 1 AS k, count({value}) OVER ({part}) AS n FROM {source}),
w AS (SELECT {first}count(v)::DOUBLE AS "count", (count(*) - count(v))::DOUBLE AS null_count, avg(v)::DOUBLE AS mean,
  stddev_samp(v)::DOUBLE AS std, min(v)::DOUBLE AS "min", max(v)::DOUBLE AS "max"{ranks} FROM o {using})
""" + " UNION ALL ".join(f"SELECT {first}'{s}' AS statistic, round(\"{s}\"::DOUBLE, 6) AS value FROM w" for s in P.STATISTICS)


@query("describe_lengths", "WITH x AS (SELECT length(text) AS len FROM documents)," + _describe_sql("x", "len"))
def describe_lengths(spark, d):
    return P.describe_lengths(B.texts(spark, d)).withColumn("value", F.round("value", 6))


@query("describe_lengths_by_lang", "WITH x AS (SELECT lang, length(text) AS len FROM documents)," + _describe_sql("x", "len", "lang"))
def describe_lengths_by_lang(spark, d):
    return P.describe_lengths(B.texts(spark, d), by=["lang"]).withColumn("value", F.round("value", 6))


# --- sampling ----------------------------------------------------------------------

@query("train_val_split", """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || ':42')) AS k, count(*) OVER () AS n FROM documents)
SELECT doc_id AS sentence_id, CASE WHEN k <= floor(0.8 * n) THEN 'train' ELSE 'val' END AS split FROM r""")
def train_val_split(spark, d):
    train, val = S.train_val_split(B.texts(spark, d).select("sentence_id"), 0.8, 42)
    return train.withColumn("split", F.lit("train")).unionByName(val.withColumn("split", F.lit("val")))


_BATCHES = "b AS (SELECT doc_id AS sentence_id, ((row_number() OVER (ORDER BY md5(doc_id || ':42')) - 1) // 100)::BIGINT AS batch_id FROM documents)"


@query("batch_assign", f"WITH {_BATCHES} SELECT sentence_id, batch_id FROM b")
def batch_assign(spark, d):
    return S.assign_batches(B.texts(spark, d).select("sentence_id"), 100, 42).select("sentence_id", "batch_id")


@query("batch_sizes", f"WITH {_BATCHES} SELECT batch_id, count(*) AS n FROM b GROUP BY batch_id")
def batch_sizes(spark, d):
    return S.batch_sizes(S.assign_batches(B.texts(spark, d).select("sentence_id"), 100, 42))


@query("epoch_shuffle", """
SELECT doc_id AS sentence_id, e::INTEGER AS epoch,
  ((row_number() OVER (PARTITION BY e ORDER BY md5(doc_id || ':42:' || e)) - 1) // 100)::BIGINT AS batch_id
FROM documents, (SELECT unnest([1, 2, 3]) AS e)""")
def epoch_shuffle(spark, d):
    return S.epoch_batches(B.texts(spark, d).select("sentence_id"), 100, 42, 3).select("sentence_id", "epoch", "batch_id")


@query("first_predictions", ctes("p") + " SELECT sentence_id, label FROM p ORDER BY sentence_id LIMIT 10")
def first_predictions(spark, d):
    return S.first_predictions(B.predictions(spark, d))


@query("progress_steps", """
WITH b AS (SELECT (row_number() OVER (ORDER BY event_id) - 1) // 20 AS step FROM events)
SELECT step::BIGINT AS step, count(*) AS n FROM b WHERE step % 40 = 0 AND step > 0 GROUP BY step""")
def progress_steps(spark, d):
    batches = S.assign_batches(B.table(spark, d, "events").select("event_id"), 20, id_column="event_id")
    steps = S.batch_sizes(batches).withColumnRenamed("batch_id", "step")
    return S.progress_steps(steps)


@query("lr_schedule", """
WITH t AS (SELECT (10 * ceil(count(*) / 100.0) + 5)::BIGINT AS total FROM documents),
s AS (SELECT unnest(range(total + 1)) AS step, total FROM t)
SELECT step, round(CASE WHEN step < 5 THEN step / 5.0 ELSE greatest(0, (total - step) / (total - 5)) END, 6) AS factor,
  round(0.001 * CASE WHEN step < 5 THEN step / 5.0 ELSE greatest(0, (total - step) / (total - 5)) END, 9) AS learning_rate FROM s""")
def lr_schedule(spark, d):
    batches = S.num_batches(B.table(spark, d, "documents").count(), 100)
    schedule = H.learning_rate_schedule(spark, H.total_steps(10, batches, 5), 5, 0.001)
    return schedule.select("step", F.round("factor", 6).alias("factor"), F.round("learning_rate", 9).alias("learning_rate"))


# --- tokens ---------------------------------------------------------------------------

_VOCAB = f"""
t AS (SELECT unnest({_WORDS}) AS token FROM documents),
c AS (SELECT token, count(*) AS n FROM t GROUP BY token),
vocab AS (SELECT token, (row_number() OVER (ORDER BY n DESC, token) + 3)::INTEGER AS id, n FROM c ORDER BY n DESC, token LIMIT 1000)"""


@query("vocab_topk", f"WITH {_VOCAB} SELECT token, id, n FROM vocab")
def vocab_topk(spark, d):
    return K.vocabulary(B.texts(spark, d, even=True), 1000)


_IDS = f"""
w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
full_ids AS (SELECT doc_id, [2] || list_transform(ws, lambda x: coalesce(m[x], 1)) || [3] AS ids
  FROM w, (SELECT map(list(token), list(id)) AS m FROM vocab))"""

_PADDED = """
SELECT doc_id AS sentence_id, array_to_string(cut || list_transform(range({length} - len(cut)), lambda x: 0), ' ') AS input_ids,
  len(cut)::INTEGER AS n_real FROM cut"""


@query("tokenize_pad", f"WITH {_VOCAB}, {_IDS}," + """
cut AS (SELECT doc_id, CASE WHEN len(ids) <= 128 THEN ids ELSE ids[1:127] || [3] END AS cut FROM full_ids)""" + _PADDED.format(length=128))
def tokenize_pad(spark, d):
    texts = B.texts(spark, d, even=True)
    return _shown(K.tokenize(texts, K.vocabulary(texts, 1000), 128))


@query("tokenize_pad_tail", f"WITH {_VOCAB}, {_IDS}," + """
cut AS (SELECT doc_id, ids[greatest(len(ids) - 63, 1):] AS cut FROM full_ids)""" + _PADDED.format(length=64))
def tokenize_pad_tail(spark, d):
    texts = B.texts(spark, d, even=True)
    return _shown(K.tokenize(texts, K.vocabulary(texts, 1000), 64, keep="tail", token_types=True))


def _shown(tokens: DataFrame) -> DataFrame:
    return tokens.select(
        "sentence_id", F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"),
        F.aggregate("attention_mask", F.lit(0), lambda acc, x: acc + x).alias("n_real"),
    )


@query("token_stats", f"""
WITH x AS (SELECT role AS split, least(len({_WORDS}) + 2, 128) AS n FROM conversations),""" + _describe_sql("x", "n", "split"))
def token_stats(spark, d):
    turns = even_out(B.table(spark, d, "conversations")).select(F.col("role").alias("split"), F.col("text").alias("sentence"))
    stats = K.token_stats(K.tokenize(turns, K.vocabulary(turns, 1000), 128), ("split",))
    return stats.withColumn("value", F.round("value", 6))


_PIECES = r"""
WITH seg AS (SELECT doc_id, regexp_extract_all(text, '\p{Nd}+|\P{Nd}+') AS segs FROM documents),
marked AS (SELECT doc_id, array_to_string(list_transform(segs, lambda x, i:
   CASE WHEN regexp_matches(x, '^\p{Nd}') AND NOT regexp_matches(coalesce(segs[i + 1], ''), '^[\p{L}\p{M}\p{N}\p{Pc}]')
        THEN chr(1) || array_to_string(list_transform(range(((length(x) + 2) // 3)::BIGINT),
               lambda q: substr(x, (CASE WHEN q = 0 THEN 1 ELSE (length(x) - 1) % 3 + 2 + (q - 1) * 3 END)::BIGINT,
                                 (CASE WHEN q = 0 THEN (length(x) - 1) % 3 + 1 ELSE 3 END)::BIGINT)), chr(1)) || chr(1)
        ELSE x END), '') AS t FROM seg),
pieces AS (SELECT doc_id, list_filter(string_split(t, chr(1)), lambda x: x <> '') AS ps FROM marked)
SELECT doc_id AS sentence_id, len(ps)::INTEGER AS n_pieces, md5(array_to_string(ps, '|')) AS pieces_md5 FROM pieces"""


_R2L = _PIECES.rsplit("SELECT", 1)[0].replace("WITH ", "", 1) + f""",
wr AS (SELECT doc_id AS sentence_id, flatten(list_transform(ps, lambda x: {_WORDS.replace("text", "x")})) AS ws FROM pieces),
c AS (SELECT token, count(*) AS n FROM (SELECT unnest(ws) AS token FROM wr) GROUP BY token),
vocab AS (SELECT token, (row_number() OVER (ORDER BY n DESC, token) + 3)::INTEGER AS id FROM c ORDER BY n DESC, token LIMIT 1000),
cut AS (SELECT sentence_id, list_transform(ws[1:96], lambda x: coalesce(m[x], 1)) AS ids, len(ws) AS n_pieces
  FROM wr, (SELECT map(list(token), list(id)) AS m FROM vocab))
SELECT sentence_id, array_to_string(ids, ' ') AS input_ids, n_pieces::INTEGER AS n_pieces FROM cut"""


@query("tokenize_r2l", "WITH " + _R2L)
def tokenize_r2l(spark, d):
    """Digits from the right, then words; no special tokens, no padding."""
    texts, steps = B.texts(spark, d, even=True), K.settings_steps(r2l=True)
    tokens = K.tokenize(texts, K.vocabulary(texts, 1000, steps=steps), 96, steps=steps, add_special_tokens=False, padding=False)
    return tokens.select(
        "sentence_id", F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"),
        F.size(K.split_by(F.col("sentence"), steps)).alias("n_pieces"))


@query("prepared_fields", f"WITH {_VOCAB}, {_IDS}," + """
cut AS (SELECT doc_id, ids[greatest(len(ids) - 63, 1):] AS cut FROM full_ids)
SELECT doc_id AS sentence_id, array_to_string(cut || list_transform(range(64 - len(cut)), lambda x: 0), ' ') AS input_ids,
  array_to_string(list_transform(range(64), lambda x: 0), ' ') AS token_type_ids,
  array_to_string(list_transform(range(64), lambda x: CASE WHEN x < len(cut) THEN 1 ELSE 0 END), ' ') AS attention_mask,
  CASE quality WHEN 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS target FROM cut JOIN labels USING (doc_id)""")
def prepared_fields(spark, d):
    """The three token fields of the labelled sentences, and 1.0 or 0.0 to be learned."""
    texts = B.texts(spark, d, even=True)
    fields = K.tokenize(texts, K.vocabulary(texts, 1000), 64, keep="tail", token_types=True).join(B.gold(spark, d), "sentence_id")
    shown = [F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in ("input_ids", "token_type_ids", "attention_mask")]
    return fields.select("sentence_id", *shown, F.when(F.col("label") == "SUBJ", 1.0).otherwise(0.0).alias("target"))


@query("r2l_pieces", _PIECES)
def r2l_pieces(spark, d):
    pieces = K.split_digits(B.texts(spark, d, even=True))
    return pieces.select(
        "sentence_id", F.size("pieces").alias("n_pieces"), F.md5(F.array_join("pieces", "|").cast("binary")).alias("pieces_md5")
    )


@query("term_hash_counts", f"""
WITH t AS (SELECT doc_id, unnest({_WORDS}) AS token FROM documents)
SELECT doc_id AS sentence_id, (('0x' || substr(md5(token), 1, 8))::BIGINT % 64)::INTEGER AS bucket, count(*) AS n FROM t GROUP BY 1, 2""")
def term_hash_counts(spark, d):
    return EM.term_hash_counts(B.texts(spark, d, even=True), 64)
