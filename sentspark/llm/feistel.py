"""Reproducible shuffle and sharding by a Feistel permutation of row numbers.

Rows are numbered 0 .. n - 1 by doc_id. A keyed Feistel network over pairs (left,
right), left < a, right < b, with a * b the least such product >= n, permutes
0 .. a * b - 1; numbers that land beyond n - 1 are sent on through it until they fall
below (cycle walking), which leaves a permutation of 0 .. n - 1. Its image gives the
shard (modulo) and the slot (quotient) of a row by arithmetic alone.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window, functions as F

from sentspark.llm.scratch import keep, scratch

ROUNDS = 4
WALKS = 64      # at most a * b - n < a numbers lie outside: a longer walk has no chance
SEED = 20240607


def _round(value: Column, number: int, seed: int) -> Column:
    """32-bit round function: leading digits of an md5."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit(number), value).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("long")


def _network(x: Column, a: int, b: int, seed: int) -> Column:
    """One pass of the network: each half is shifted by a function of the other."""
    halves = F.struct(F.floor(x / F.lit(b)).cast("long").alias("l"), (x % F.lit(b)).alias("r"))
    for i in range(ROUNDS):
        held = F.transform(F.array(halves), _left(i, a, seed) if i % 2 == 0 else _right(i, b, seed))
        halves = held[0]
    return F.transform(F.array(halves), lambda h: h["l"] * F.lit(b) + h["r"])[0]


def _left(i: int, a: int, seed: int):
    return lambda h: F.struct(((h["l"] + _round(h["r"], i, seed)) % F.lit(a)).alias("l"), h["r"].alias("r"))


def _right(i: int, b: int, seed: int):
    return lambda h: F.struct(h["l"].alias("l"), ((h["r"] + _round(h["l"], i, seed)) % F.lit(b)).alias("r"))


def permuted(number: Column, n: int, seed: int = SEED) -> Column:
    """Image of ``number`` under the keyed permutation of 0 .. n - 1."""
    a = max(1, isqrt(n))
    b = max(1, -(-n // a))
    once = _network(number, a, b, seed)
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALKS)), once,
        lambda acc, _: F.when(acc < n, acc).otherwise(_network(acc, a, b, seed)),
        # About one walk in (n ** 0.5) ** WALKS is longer; none may end outside.
        lambda acc: F.when(acc < n, acc).otherwise(F.raise_error(F.lit("a walk of the permutation is too long")).cast("long")))
    # The walk is rare: the array is only made where the first image lies outside.
    held = F.transform(F.array(once), lambda x: F.when(x < n, x).otherwise(walk))
    return held[0]


def shard_rows(docs: DataFrame, shards: int = 40, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, one row per row of
    ``docs`` (doc_id, text). The law is ``rows``: shard sizes differ by one at most,
    and slots of a shard run from 0 without gaps; grown_shard is NULL.

    Numbers follow doc_id (NULL first), then size and checksum; rows equal in all
    three are interchangeable. NULL text: size 16, checksum 0. No rows in, no rows out.
    The text itself, however long, is
    reduced to size and checksum where it is read; what is sorted are short rows, once,
    in ranges whose sizes give each its offset. No window spans the table.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("text_crc32")]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    with scratch(spark, "shards") as tmp:
        ranged = tmp.table(
            rows.repartitionByRange(*order).sortWithinPartitions(*order)
            .select("*", F.spark_partition_id().alias("part"), place.alias("place")))
        # One row per partition.
        sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
        offsets = sizes.select("part", (F.sum("rows").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("rows")).alias("before"))
        n = ranged.count()
        image = permuted(F.col("before") + F.col("place"), n, seed)
        return keep(
            ranged.join(F.broadcast(offsets), "part").withColumn("image", image)
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("image") % shards).cast("int").alias("shard"),
                    F.floor(F.col("image") / F.lit(shards)).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
