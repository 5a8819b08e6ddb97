"""Sentence vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from sentspark.functions.text import WORD_PATTERN, words


class Encoder(Protocol):
    """Any outside sentence encoder."""

    def encode(self, texts: list[str]) -> np.ndarray: ...


def embed(df: DataFrame, make_encoder: Callable[[], Encoder], text: str = "sentence",
          output: str = "embedding", batch_size: int = 20) -> DataFrame:
    """Adds one float vector per row. The encoder is made once per Python worker and
    sees ``batch_size`` texts at a time; ids and labels ride along."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for batch in batches:
            texts = batch.tolist()
            parts = [
                np.asarray(encoder.encode(texts[i:i + batch_size]), dtype="float32")
                for i in range(0, len(texts), batch_size)
            ]
            yield pd.Series([row for part in parts for row in part])

    return df.withColumn(output, encode(F.col(text)))


def hashed_encoder(df: DataFrame, dimensions: int = 256, text: str = "sentence") -> PipelineModel:
    """Built-in encoder without pretrained weights: hashed word counts, weighted by
    inverse document frequency, scaled to unit length. One pass to fit."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_words", gaps=False, pattern=WORD_PATTERN, toLowercase=True),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dimensions),
        IDF(inputCol="_counts", outputCol="_weighted"),
        Normalizer(inputCol="_weighted", outputCol="_features", p=2.0),
    ]).fit(df.select(text))


def embed_hashed(df: DataFrame, model: PipelineModel, output: str = "embedding") -> DataFrame:
    out = model.transform(df).withColumn(output, vector_to_array("_features", "float32"))
    return out.drop("_words", "_counts", "_weighted", "_features")


def term_bucket(token, buckets: int):
    """Bucket of a word from the leading hex digits of its md5."""
    return (F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("bigint") % buckets).cast("int")


def term_hash_counts(df: DataFrame, buckets: int, text: str = "sentence", id_column: str = "sentence_id") -> DataFrame:
    """(id, bucket, n): hashed word counts in long form."""
    tokens = df.select(id_column, F.explode(words(F.col(text))).alias("token"))
    # One shuffle, after counting within each task.
    return tokens.groupBy(id_column, term_bucket(F.col("token"), buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


BLOCK_WIDTH = 64        # directions carried through a pass over the vectors
SPARE_DIRECTIONS = 8
PASSES = 24             # at most
TOLERANCE = 1e-8        # of the largest eigenvalue
SLICE = 4096


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _covariance_times(vectors: DataFrame, centre: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Sum over the rows of x (x . basis), x less ``centre``. Every task adds up a table
    as large as ``basis``; the tables are added in Spark by slices."""
    shared = vectors.sparkSession.sparkContext.broadcast((centre, basis))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, basis = shared.value
        total = np.zeros_like(basis)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0)) - centre
                total += x.T @ (x @ basis)
        flat = total.ravel()
        cuts = list(range(0, len(flat), SLICE))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(cuts)), pa.int32()), pa.array([flat[i:i + SLICE] for i in cuts])], ["slice", "part"])

    parts = vectors.mapInArrow(work, "slice int, part array<double>")
    summed = parts.groupBy("slice").agg(vector_to_array(Summarizer.sum(array_to_vector("part"))).alias("part")).collect()
    shared.unpersist()
    return np.concatenate([np.asarray(r["part"]) for r in sorted(summed, key=lambda r: r["slice"])]).reshape(basis.shape)


def principal_axes(vectors: DataFrame, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the vectors (one array<double> column) and their leading principal axes,
    as columns, each turned so that its largest entry is positive.

    A random block of directions is multiplied by the covariance in one pass over the
    vectors; what is new in the result becomes the next block, until the leading axes
    within all blocks so far don't change any more or the blocks span the whole space.
    The driver holds a few such blocks, never a matrix of dimension by dimension unless
    that is what one block has.
    """
    name = vectors.columns[0]
    mean = vectors.select(Summarizer.mean(array_to_vector(F.col(name))).alias("mean")).first()["mean"]
    centre = np.zeros(0) if mean is None else mean.toArray()
    size = len(centre)
    if size < components:
        raise ValueError(f"{components} components of vectors with {size} entries")
    width = min(size, max(components + SPARE_DIRECTIONS, BLOCK_WIDTH))
    block = np.linalg.qr(np.random.default_rng(0).normal(size=(size, width)))[0]
    basis, images = np.zeros((size, 0)), np.zeros((size, 0))
    for _ in range(PASSES):
        image = _covariance_times(vectors, centre, block)
        basis, images = np.hstack([basis, block]), np.hstack([images, image])
        small = basis.T @ images
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1][:components], turns[:, ::-1][:, :components]
        axes = basis @ turns
        if basis.shape[1] >= size or np.abs(images @ turns - axes * values).max() <= TOLERANCE * max(values[0], 1e-300):
            break
        new = image
        for _ in range(2):      # twice, against rounding
            new = new - basis @ (basis.T @ new)
        left, strength, _ = np.linalg.svd(new, full_matrices=False)
        block = left[:, strength > 1e-12 * max(strength[0], 1e-300)][:, :size - basis.shape[1]]
        if block.shape[1] == 0:
            break
    return centre, axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(components)] < 0, -1.0, 1.0)


def pca_layout(df: DataFrame, vector: str = "embedding", components: int = 2, scale: float = 1.0,
               output: str = "position") -> DataFrame:
    """Adds the projection of the centred vectors on the leading principal components."""
    vectors = df.select(F.col(vector).cast("array<double>").alias("vector"))
    if vectors.isEmpty():
        return df.withColumn(output, F.lit(None).cast("array<double>"))
    shared = df.sparkSession.sparkContext.broadcast(principal_axes(vectors, components))

    @F.pandas_udf("array<double>")
    def project(column: pd.Series) -> pd.Series:
        centre, axes = shared.value
        if not len(column):
            return pd.Series([], dtype=object)
        return pd.Series(list((np.stack(column.to_numpy()).astype("float64") - centre) @ axes * scale))

    return df.withColumn(output, project(F.col(vector).cast("array<double>")))
