import hashlib

import pytest
from pyspark.sql import functions as F

from sentspark.operators import history as H, sampling as S


def ids(df):
    return sorted(r[0] for r in df.select("sentence_id").collect())


@pytest.mark.parametrize("n, ratio", [(0, 0.8), (1, 0.8), (100, 0.8), (101, 0.9), (100, 0.333), (7, 1.0)])
def test_split_is_exact(spark, n, ratio):
    df = spark.range(n).select(F.col("id").alias("sentence_id"))
    train, val = S.train_val_split(df, ratio, 42)
    order = sorted(range(n), key=lambda i: hashlib.md5(f"{i}:42".encode()).hexdigest())
    cut = int(ratio * n)
    assert ids(train) == sorted(order[:cut]) and ids(val) == sorted(order[cut:])


@pytest.mark.parametrize("ratio", [0.1, 0.45, 0.8])
def test_split_with_one_hot_id(spark, ratio):
    """40 % of the rows share an id, half of these are the same in every column."""
    hot = F.when(F.col("id") < 400, 5).otherwise(F.col("id"))
    text = F.when(F.col("id") < 200, "same").otherwise(F.col("id").cast("string"))
    df = spark.range(1000).select(hot.alias("sentence_id"), text.alias("sentence"))
    train, val = S.train_val_split(df, ratio, 1)
    assert train.count() == int(ratio * 1000) and val.count() == 1000 - int(ratio * 1000)
    both = train.unionByName(val)
    assert both.exceptAll(df).count() == 0 and df.exceptAll(both).count() == 0


@pytest.mark.parametrize("n", [1, 10, 11, 95])
def test_batches(spark, n):
    df = spark.range(n).select(F.col("id").alias("sentence_id"))
    for seed in (None, 3):
        got = S.assign_batches(df, 10, seed).collect()
        assert sorted(r["rank"] for r in got) == list(range(n))
        sizes = sorted((r["batch_id"], r["n"]) for r in S.batch_sizes(S.assign_batches(df, 10, seed)).collect())
        assert len(sizes) == S.num_batches(n, 10)
        assert all(size == 10 for _, size in sizes[:-1]) and sum(size for _, size in sizes) == n


def test_rank_does_not_depend_on_partitions(spark):
    df = spark.range(500).select(F.col("id").alias("sentence_id"))
    key = S.shuffle_key("sentence_id", 7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    for parts in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        seen.append(sorted(map(tuple, S.rank_rows(df, key).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]


def test_epochs_differ_and_are_complete(spark):
    df = spark.range(60).select(F.col("id").alias("sentence_id"))
    rows = S.epoch_batches(df, 25, 1, 2).collect()
    first, second = ([r["sentence_id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["epoch"] == e] for e in (1, 2))
    assert first != second and sorted(first) == sorted(second) == list(range(60))
    assert {r["batch_id"] for r in rows} == {0, 1, 2}


def loop(scores, patience):
    best, waited, out = -1.0, 0, []
    for i, score in enumerate(scores):
        if score > best:
            best, waited = score, 0
        else:
            waited += 1
            if waited >= patience:
                return [*out, "stopped", *["not run"] * (len(scores) - i - 1)]
        out.append("logged")
    return out


def test_early_stopping_equals_the_loop(spark):
    import random
    rng = random.Random(5)
    runs = [[rng.choice([0.1, 0.2, 0.3, 0.4]) for _ in range(rng.randint(1, 9))] for _ in range(60)]
    runs += [[0.1, 0.2, 0.3], [0.2, 0.2, 0.2], [0.3, 0.1, 0.4], [-2.0, -2.0]]
    rows = [(f"r{i}", e + 1, s) for i, run in enumerate(runs) for e, s in enumerate(run)]
    history = spark.createDataFrame(rows, "run_id string, epoch int, score double")
    for patience in (1, 2, 3):
        got = {}
        for r in H.early_stopping(history, patience).orderBy("run_id", "epoch").collect():
            got.setdefault(r["run_id"], []).append(r["status"])
        assert got == {f"r{i}": loop(run, patience) for i, run in enumerate(runs)}
