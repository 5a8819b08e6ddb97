import datetime
import json
import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F

from sentspark.functions import formatting as fmt, labels as N, text as X
from sentspark.operators import encoding, profile as P, tokens as K
from sentspark.session import scratch_path
from sentspark.sources import readers as R, settings as Z, sinks as W

AWKWARD = [
    ("1", 'one " quote and a \\" mark', "SUBJ"), ("2", "plain", "OBJ"), ("3", 'quoted "inner" text', "OBJ"),
    ("4", 'back\\slash "mid" NA  ', "SUBJ"), ("5", None, "OBJ"), ("6", " NA", "OBJ"),
]


def one(spark, value, kind, expr):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


def test_quoted_round_trip(spark):
    path = scratch_path(spark, "q")
    rows = [*AWKWARD, ("7", "line\nbreak\ttab", "OBJ")]
    W.write_delimited(spark.createDataFrame(rows, R.SENTENCES), path)
    assert sorted(map(tuple, R.read_delimited(spark, path, separator="\t", line_breaks=True).collect())) == rows
    text = "".join(r[0] for r in spark.read.text(path).collect())
    assert '""inner""' in text and '\\"' not in text.replace('\\""', "")


def test_unquoted_round_trip(spark):
    path = scratch_path(spark, "u")
    rows = [*AWKWARD, ("7", "NA", "OBJ"), ("8", "null", "OBJ")]
    W.write_unquoted(spark.createDataFrame(rows, R.SENTENCES), path)
    assert sorted(map(tuple, R.read_unquoted(spark, path, missing_words=False).collect())) == rows
    read = {r[0]: r[1] for r in R.read_unquoted(spark, path).collect()}
    assert read["7"] is None and read["8"] is None and read["6"] == " NA"
    with pytest.raises(PySparkException, match="separator"):
        W.write_unquoted(spark.createDataFrame([("1", "a\tb", "OBJ")], R.SENTENCES), scratch_path(spark, "u"))


def test_missing_path_fails(spark):
    with pytest.raises(AnalysisException):
        R.read_delimited(spark, scratch_path(spark, "none"))


def test_json_document(spark, tmp_path):
    file = tmp_path / "a.json"
    file.write_text(json.dumps([{"sentence_id": str(i), "sentence": "s", "label": "OBJ"} for i in range(5)], indent=1))
    assert R.read_json_records(spark, str(file), R.SENTENCES).count() == 5


def test_history_and_cache(spark):
    path = scratch_path(spark, "history")
    log = W.metric_logger(spark, path, "run a")
    log({"epoch": 1, "val/loss": 0.5, "val/accuracy": None})
    log({"test/OBJ_class_f1": 0.25})
    got = {(r["epoch"], r["metric"], r["value"]) for r in W.read_history(spark, path).collect()}
    assert got == {(1, "val/loss", 0.5), (1, "val/accuracy", None), (None, "test/OBJ_class_f1", 0.25)}
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    cache = W.cache_path(scratch_path(spark, "c"), "a/b", 128, "train")
    assert W.load_or_compute(spark, cache, compute).count() == 3
    assert W.load_or_compute(spark, cache, compute).count() == 3 and len(calls) == 1
    W.load_or_compute(spark, cache, compute, force=True)
    assert len(calls) == 2


def test_submission_names(spark):
    df = spark.createDataFrame([("1", "x", "OBJ")], "sentence_id string, sentence string, predicted_label string")
    folder = scratch_path(spark, "s")
    assert W.write_submission(df, folder, True).endswith("task1_dev_mono_english.tsv")
    path = W.write_submission(df, folder, False)
    assert [tuple(r) for r in R.read_delimited(spark, path, R.PREDICTIONS, "\t").collect()] == [("1", "OBJ")]


def test_settings(tmp_path):
    raw = {"data": {"train_en": "raw/2024/t.tsv"}, "train": {"learning_rate": 2e-05}, "encoder_model": {"name": "a/b", "r2l": True}}
    file = tmp_path / "run.json"
    file.write_text(json.dumps(raw))
    got = Z.load_settings(file)
    assert got["dim_red_model"] is None and got["train"]["batch_size"] == 100
    assert Z.run_id(got) == "a-b_2024_max_length128_bs100_lr2e-05_r2l_losscross_entropy"


def test_run_name_column_agrees(spark):
    column = fmt.run_name(F.lit("a/b"), F.lit("raw/t.tsv"), F.lit(128), F.lit(100), F.lit("2e-05"), F.lit("focal"), F.lit(False))
    assert spark.range(1).select(column).first()[0] == "a-b__max_length128_bs100_lr2e-05_lossfocal"


def test_strict_mapping(spark):
    df = spark.createDataFrame([("SUBJ",), ("OBJ",), ("BAD",), (None,)], "label string")
    for bad in ("label = 'BAD'", "label is null"):
        with pytest.raises(ValueError, match="outside the mapping"):
            encoding.encode_labels(df.where(bad))
        lazy = encoding.encode_labels(df.where(bad), strict=False)
        assert lazy.count() == 1
        with pytest.raises(PySparkException):
            lazy.collect()
    good = encoding.encode_labels(df.where("label in ('SUBJ', 'OBJ')"), N.HOLDOUT_CODES)
    assert {r["label"]: r["label_encoded"] for r in good.collect()} == N.HOLDOUT_CODES
    back = encoding.decode_labels(good, N.HOLDOUT_CODES, output="again")
    assert back.where("label <> again").count() == 0


def test_float_targets(spark):
    df = spark.createDataFrame([("SUBJ",), ("OBJ",)], "label string")
    assert [r["y"] for r in encoding.encode_labels(df, N.BASELINE_TARGETS, output="y").collect()] == [1.0, 0.0]


def test_threshold_argmax_softmax(spark):
    values = [(0.5,), (0.49,), (math.nan,), (None,)]
    got = [r[0] for r in spark.createDataFrame(values, "x double").select(N.threshold_label(F.col("x"))).collect()]
    assert got == ["SUBJ", "OBJ", "OBJ", "OBJ"]
    for array, index in (([1.0, 3.0, 3.0], 1), ([1.0, math.nan], 1), ([2.0], 0)):
        assert one(spark, array, "array<double>", N.argmax_index) == index
    p = one(spark, [1000.0, 1000.0], "array<double>", N.softmax)
    assert p == [0.5, 0.5]


@pytest.mark.parametrize("seconds", [0, 59.5, 60.5, 3661, 86400, 90000, 200000.4])
def test_format_time(spark, seconds):
    want = str(datetime.timedelta(seconds=round(seconds)))
    assert one(spark, float(seconds), "double", fmt.format_time) == want


@pytest.mark.parametrize("value, shown", [
    (0.32, ".3200"), (0.5, ".5000"), (1.0, "1"), (0.0, "0"), (12345.6, "12346"), (123.456, "123.5"), (-0.25, "-.25"),
    (math.nan, ""), (None, ""), (0.123456, ".1235"), (123.35, "123.3"), (1e-05, "1e-05"),
])
def test_short_float(spark, value, shown):
    assert one(spark, value, "double", fmt.short_float) == shown


def test_short_list(spark):
    assert one(spark, [0.5, 2.0, math.nan], "array<double>", fmt.short_list) == "[.5000,2,]"


PIECES = {
    "1234567": ["1", "234", "567"], "12": ["12"], "1000": ["1", "000"], "a1234b": ["a1234b"], "a1234 b": ["a", "1", "234", " b"],
    "12.5": ["12", ".", "5"], "": [], "none": ["none"], "12é": ["12é"], "\u0001x\u00021234": ["\u0001x\u0002", "1", "234"],
}


def test_digit_pieces(spark):
    df = spark.createDataFrame([(k,) for k in PIECES], "x string")
    assert {r[0]: r[1] for r in df.select("x", X.digit_pieces(F.col("x"))).collect()} == PIECES


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("0123456789 aé_.\u0001\u0002b", max_size=40), min_size=20, max_size=60))
def test_digit_pieces_are_lossless(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "x string").select("x", X.digit_pieces(F.col("x")).alias("p"))
    assert all("".join(r["p"]) == r["x"] and "" not in r["p"] for r in df.collect())


def test_padding_and_truncation(spark):
    df = spark.createDataFrame([("a b c d e f",), ("a b",), ("a b c d",), ("",), ("zz a",)], "sentence string")
    vocab = spark.createDataFrame([(w, i + 4) for i, w in enumerate("abcdef")], "token string, id int")

    def ids(**options):
        out = K.tokenize(df, vocab, 6, **options)
        assert out.where("size(input_ids) <> 6 or size(attention_mask) <> 6").count() == 0
        return {r["sentence"]: (r["input_ids"], sum(r["attention_mask"])) for r in out.collect()}

    head, tail = ids(), ids(keep="tail", token_types=True)
    assert head["a b c d e f"] == ([2, 4, 5, 6, 7, 3], 6) and tail["a b c d e f"] == ([5, 6, 7, 8, 9, 3], 6)
    assert head["a b"] == tail["a b"] == ([2, 4, 5, 3, 0, 0], 4)
    assert head["a b c d"] == tail["a b c d"] == ([2, 4, 5, 6, 7, 3], 6)
    assert head[""] == ([2, 3, 0, 0, 0, 0], 2) and head["zz a"][0][:3] == [2, 1, 4]
    bare = ids(add_special_tokens=False)
    assert bare["a b"] == ([4, 5, 0, 0, 0, 0], 2) and bare[""][1] == 0


def test_outside_tokenizer(spark):
    df = spark.createDataFrame([("ab",), ("abcdefgh",)], "sentence string")
    got = K.tokenize_with(df, lambda: lambda texts: [[ord(c) for c in t] for t in texts], 4)
    assert [r["input_ids"] for r in got.collect()] == [[97, 98, 0, 0], [97, 98, 99, 100]]


def test_describe(spark):
    df = spark.createDataFrame([(v,) for v in [5, 1, None, 3, 4, 2]], "v int")
    got = {r["statistic"]: r["value"] for r in P.describe_counts(df, "v").collect()}
    assert got == {"count": 5, "null_count": 1, "mean": 3, "std": pytest.approx(1.5811388), "min": 1, "25%": 2, "50%": 3, "75%": 4, "max": 5}
    single = {r["statistic"]: r["value"] for r in P.describe_counts(df.where("v = 3"), "v").collect()}
    assert single["std"] is None and single["50%"] == 3
    empty = {r["statistic"]: r["value"] for r in P.describe_counts(df.where("v > 9"), "v").collect()}
    assert empty["count"] == 0 and empty["null_count"] == 0 and empty["50%"] is None
    assert one(spark, "é\U0001f600", "string", F.length) == 2


def test_history_is_written_once(spark, tmp_path):
    path = str(tmp_path / "history")
    for _ in range(2):
        for epoch in (1, 2):
            W.log_metrics(spark, path, "a/b", {"epoch": epoch, "x": epoch, "y": None})
        W.log_metrics(spark, path, "a/b", {"best": 3})
        W.log_metrics(spark, path, "a/b", {"test": 4})
    W.log_metrics(spark, path, "other", {"epoch": 1, "x": 9})
    W.log_metrics(spark, path, "a/b", {"epoch": 2, "x": 7, "y": 1})
    rows = [tuple(r) for r in W.read_history(spark, path).collect()]
    assert sorted(rows, key=repr) == sorted([
        ("a/b", 1, "x", 1.0), ("a/b", 1, "y", None), ("a/b", 2, "x", 7.0), ("a/b", 2, "y", 1.0), ("a/b", None, "best", 3.0),
        ("a/b", None, "test", 4.0), ("other", 1, "x", 9.0)], key=repr)
    W.forget_run(spark, path, "a/b")
    assert [r["run_id"] for r in W.read_history(spark, path).collect()] == ["other"]


def test_cache_embeds_only_new_texts(spark, tmp_path):
    path, made = str(tmp_path / "cache"), []

    def embed(df):
        made.append(df.count())
        return df.withColumn("embedding", F.array(F.length("sentence").cast("float")))

    def run(texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "sentence_id long, sentence string")
        return {r["sentence_id"]: r["embedding"] for r in W.cached_embeddings(spark, df, path, embed).collect()}

    texts = ["a" * i for i in range(1, 101)]
    assert run([*texts, "a", None]) == {**{i: [i + 1.0] for i in range(100)}, 100: [1.0], 101: None}
    assert run([*texts[5:], *["b" * i for i in range(200, 205)]])[99] == [204.0]
    broken = tmp_path / "cache" / "added-broken"
    spark.createDataFrame([("x", [1.0])], "_key string, embedding array<float>").write.parquet(str(broken))
    (broken / "_SUCCESS").unlink()
    assert run(texts)[0] == [1.0]
    assert made == [100, 5, 0]


def test_settings_of_the_tokenizer(spark):
    df = spark.createDataFrame([(1, "I paid 1234567 now, OK"), (2, ""), (3, None), (4, "12 1000 x9999y")], "sentence_id long, sentence string")
    steps = K.settings_steps(True)
    vocab = K.vocabulary(df, 50, steps=steps)
    words = {r["id"]: r["token"] for r in vocab.collect()}
    got = {r["sentence_id"]: r for r in K.tokenize(df, vocab, 6, steps=steps, add_special_tokens=False, padding=False, truncation=False).collect()}
    assert [words[i] for i in got[1]["input_ids"]] == ["i", "paid", "1", "234", "567", "now", ",", "ok"] and got[1]["attention_mask"] == [1] * 8
    assert got[2]["input_ids"] == []
    longest = K.tokenize(df, vocab, 6, steps=steps, padding="longest", truncation=False).collect()
    assert {len(r["input_ids"]) for r in longest if r["sentence"] is not None} == {10}
    cut = K.tokenize(df, vocab, 6, steps=steps).where("sentence_id = 1").first()
    assert cut["input_ids"][0] == 2 and cut["input_ids"][-1] == 3 and len(cut["input_ids"]) == 6
    with pytest.raises(ValueError):
        K.tokenize(df, vocab, 6, padding="some")
    for r in df.select("sentence", K.split_by(F.lower("sentence"), steps).alias("pieces"), K.piece_offsets(F.col("sentence"), steps).alias("at")).where("sentence IS NOT NULL").collect():
        assert len(r["at"]) == len(r["pieces"]) and all(r["sentence"].lower()[a:a + len(p)] == p for a, p in zip(r["at"], r["pieces"])) and r["at"] == sorted(r["at"])


def test_vocabulary_cut_among_ties(spark):
    rows = [(" ".join(["top"] * 5 + ["mid"] * 3),)] + [(w,) for w in "f e d c b a".split()]
    df = spark.createDataFrame(rows, "sentence string").repartition(4)
    for size in range(9):
        got = [(r["token"], r["id"], r["n"]) for r in K.vocabulary(df, size).orderBy("id").collect()]
        want = [("top", 5), ("mid", 3), *[(w, 1) for w in "abcdef"]][:size]
        assert got == [(w, i + 4, n) for i, (w, n) in enumerate(want)]
