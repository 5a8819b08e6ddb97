"""Classifier head on frozen vectors: dropout, linear, ReLU, linear.

Training is data-parallel. An epoch is one job however many rows there are: the rows are
dealt to parts of bounded size in a new seeded order, each part takes the steps of its
own mini-batches from the common weights and moments, and the results are averaged by
rows. With one part these are the steps of a sequential fit; the more parts, the fewer
steps in a row. Without a batch size an epoch is one step with the gradient of all rows.
Sums are added in Spark, cut into slices so that the adding is spread too; the driver
gets a few vectors of the size of the model per epoch.

What a fit needs to go on (weights, moments, best head, logged epochs) can be stored
after each epoch; a stopped fit then ends as it would have without the stop.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from dataclasses import asdict, dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, functions as F

from sentspark.functions.labels import TRAIN_CODES, argmax_index, decode, inverse, softmax
from sentspark.functions.losses import cross_entropy, focal
from sentspark.operators import counts as C
from sentspark.operators.row_metrics import RowMetric, score_rows
from sentspark.operators.sampling import assign_batches, num_batches
from sentspark.scratch import scratch
from sentspark.session import is_complete

SLICE = 4096
# Moment decay rates and weight decay of the optimiser.
BETA_1, BETA_2, WEIGHT_DECAY = 0.9, 0.999, 0.01


@dataclass(frozen=True)
class HeadSettings:
    inputs: int
    hidden: int = 256
    classes: int = 2
    dropout: float = 0.1
    learning_rate: float = 2e-05
    eps: float = 1e-08
    epochs: int = 10
    patience: int = 2
    batch_size: int | None = None      # None: one batch per epoch
    warmup_steps: int = 0
    step_per: str = "epoch"            # "epoch", "batch"; anything else: constant rate
    loss: str = "cross_entropy"        # or "focal"
    gamma: float = 2.0
    class_weights: tuple[float, ...] | None = None
    digits: int = 4
    seed: int = 42
    part_values: int = 8_000_000       # vector entries of the rows of one part

    def __post_init__(self):
        if self.loss not in ("cross_entropy", "focal"):
            raise ValueError(f"loss {self.loss!r} is not supported")
        if self.gamma < 0:
            raise ValueError("gamma must not be negative")


@dataclass
class Head:
    """Weights as one flat vector; small, so it travels with the tasks."""

    settings: HeadSettings
    flat: np.ndarray

    @classmethod
    def initial(cls, settings: HeadSettings) -> "Head":
        rng = np.random.default_rng(settings.seed)
        d, h, c = settings.inputs, settings.hidden, settings.classes
        bounds = [(d * h + h, d), (h * c + c, h)]
        return cls(settings, np.concatenate([rng.uniform(-1, 1, size) / np.sqrt(fan) for size, fan in bounds]))

    def parts(self, flat: np.ndarray | None = None) -> list[np.ndarray]:
        flat = self.flat if flat is None else flat
        d, h, c = self.settings.inputs, self.settings.hidden, self.settings.classes
        w1, b1, w2, b2 = np.split(flat, np.cumsum([d * h, h, h * c]))
        return [w1.reshape(d, h), b1, w2.reshape(h, c), b2]

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.parts()
        return np.maximum(x @ w1 + b1, 0.0) @ w2 + b2

    def gradient(self, x: np.ndarray, code: np.ndarray, keep: np.ndarray | None) -> tuple[np.ndarray, float, np.ndarray]:
        """Summed gradient, summed loss and predicted codes of some rows; ``keep`` is
        the scaled dropout mask."""
        w1, b1, w2, b2 = self.parts()
        dropped = x if keep is None else x * keep
        hidden = dropped @ w1 + b1
        active = np.maximum(hidden, 0.0)
        logits = active @ w2 + b2
        shifted = logits - logits.max(axis=1, keepdims=True)
        log_p = shifted - np.log(np.exp(shifted).sum(axis=1, keepdims=True))
        p, rows = np.exp(log_p), np.arange(len(code))
        p_true, log_true = p[rows, code], log_p[rows, code]
        s = self.settings
        weight = np.ones(s.classes) if s.loss == "cross_entropy" or s.class_weights is None else np.asarray(s.class_weights)
        gamma = s.gamma if s.loss == "focal" else 0.0
        miss = 1.0 - p_true
        loss = -weight[code] * miss ** gamma * log_true
        # d loss / d p_true, times p_true
        slope = -weight[code] * miss ** gamma
        if gamma > 0:
            slope = slope + weight[code] * gamma * np.maximum(miss, 1e-12) ** (gamma - 1) * p_true * log_true
        target = np.zeros_like(p)
        target[rows, code] = 1.0
        d_logits = slope[:, None] * (target - p)
        d_hidden = (d_logits @ w2.T) * (hidden > 0)
        pieces = [dropped.T @ d_hidden, d_hidden.sum(axis=0), active.T @ d_logits, d_logits.sum(axis=0)]
        return np.concatenate([g.ravel() for g in pieces]), float(loss.sum()), logits.argmax(axis=1)


def _stack(vectors: pd.Series, width: int) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype("float64") if len(vectors) else np.empty((0, width))


def _dropout_mask(keys: np.ndarray, width: int, ratio: float) -> np.ndarray | None:
    """Mask from a hash of (row key, column): the same whichever task has the row."""
    if ratio <= 0:
        return None
    with np.errstate(over="ignore"):
        z = keys.astype("uint64")[:, None] + np.arange(1, width + 1, dtype="uint64")[None, :] * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return (z / 2.0 ** 64 >= ratio) / (1.0 - ratio)


def _slices(everything: np.ndarray) -> pd.DataFrame:
    cuts = range(0, len(everything), SLICE)
    return pd.DataFrame({"slice": list(range(len(cuts))), "part": [everything[i:i + SLICE] for i in cuts]})


def _added_up(parts: DataFrame) -> np.ndarray:
    """Sum of vectors given in slices (slice, part), put together on the driver."""
    summed = parts.groupBy("slice").agg(vector_to_array(Summarizer.sum(array_to_vector("part"))).alias("part"))
    rows = sorted(summed.collect(), key=lambda row: row["slice"])
    return np.concatenate([np.asarray(row["part"]) for row in rows])


def _counted(cells: np.ndarray, classes: int) -> dict[tuple[int, int], int]:
    return {(i // classes, i % classes): int(n) for i, n in enumerate(cells) if n}


def batch_gradient(batch: DataFrame, head: Head, step: int) -> tuple[np.ndarray, float, dict[tuple[int, int], int]]:
    """Mean gradient, mean loss and (gold, predicted) counts of one batch of rows
    (sentence_id, vector, code)."""
    s = head.settings
    shared = batch.sparkSession.sparkContext.broadcast(head)
    size, classes = len(head.flat), s.classes

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        gradient, extra = np.zeros(size), np.zeros(2 + classes * classes)
        for rows in batches:
            if rows.empty:
                continue
            x, code = _stack(rows["vector"], s.inputs), rows["code"].to_numpy()
            keep = _dropout_mask(rows["key"].to_numpy(), s.inputs, s.dropout)
            part, loss, predicted = model.gradient(x, code, keep)
            gradient += part
            extra[0] += loss
            extra[1] += len(rows)
            extra[2:] += np.bincount(code * classes + predicted, minlength=classes * classes)
        if extra[1]:
            yield _slices(np.concatenate([extra, gradient]))

    keyed = batch.select("vector", "code", F.xxhash64("sentence_id", F.lit(s.seed), F.lit(step)).alias("key"))
    everything = _added_up(keyed.mapInPandas(add_up, "slice int, part array<double>"))
    shared.unpersist()
    loss, rows, cells = everything[0], everything[1], everything[2:2 + classes * classes]
    return everything[2 + classes * classes:] / rows, loss / rows, _counted(cells, classes)


@dataclass
class AdamW:
    """Decoupled weight decay on the driver-side weights."""

    size: int
    eps: float
    m: np.ndarray = field(init=False)
    v: np.ndarray = field(init=False)
    steps: int = 0

    def __post_init__(self):
        self.m, self.v = np.zeros(self.size), np.zeros(self.size)

    def update(self, flat: np.ndarray, gradient: np.ndarray, rate: float) -> np.ndarray:
        self.steps += 1
        self.m = BETA_1 * self.m + (1 - BETA_1) * gradient
        self.v = BETA_2 * self.v + (1 - BETA_2) * gradient ** 2
        m_hat, v_hat = self.m / (1 - BETA_1 ** self.steps), self.v / (1 - BETA_2 ** self.steps)
        return flat * (1 - rate * WEIGHT_DECAY) - rate * m_hat / (np.sqrt(v_hat) + self.eps)

    @classmethod
    def at(cls, eps: float, m: np.ndarray, v: np.ndarray, steps: int) -> "AdamW":
        made = cls(len(m), eps)
        made.m, made.v, made.steps = m, v, steps
        return made


@dataclass
class Progress:
    """All that a fit needs to go on after an epoch."""

    head: Head
    optimiser: AdamW
    epoch: int = 0
    scheduled: int = 0
    best: Head | None = None
    best_score: float = -1.0
    waited: int = 0
    logged: list[dict[str, Any]] = field(default_factory=list)

    @property
    def over(self) -> bool:
        return self.epoch >= self.head.settings.epochs or self.waited >= self.head.settings.patience


def _rate(settings: HeadSettings, scheduled: int, total: int) -> float:
    if settings.step_per not in ("epoch", "batch"):
        return settings.learning_rate
    return settings.learning_rate * warmup_factor(scheduled, settings.warmup_steps, total)


def part_steps(batches: Iterator[pd.DataFrame], now: Progress, parts: int, total: int) -> Iterator[np.ndarray]:
    """For rows (part, key, vector, code) in the order of an epoch, the steps of each
    part's mini-batches from the weights and moments of ``now``. Per part: sum of the
    batch mean losses, batches, rows, confusion counts, and weights and moments times
    rows. Holds one Arrow batch and one mini-batch."""
    s, classes = now.head.settings, now.head.settings.classes
    part, held, count = None, [], 0
    head, optimiser, sums = now.head, now.optimiser, np.zeros(3 + classes * classes)

    def step(rows: pd.DataFrame) -> None:
        nonlocal head
        x, code = _stack(rows["vector"], s.inputs), rows["code"].to_numpy()
        gradient, loss, predicted = head.gradient(x, code, _dropout_mask(rows["key"].to_numpy(), s.inputs, s.dropout))
        done = int(sums[1]) * parts if s.step_per == "batch" else 0
        head = replace_weights(head, optimiser.update(head.flat, gradient / len(rows), _rate(s, now.scheduled + done, total)))
        sums[:3] += loss / len(rows), 1, len(rows)
        sums[3:] += np.bincount(code * classes + predicted, minlength=classes * classes)

    def close() -> np.ndarray:
        if held:
            step(pd.concat(held))
        return np.concatenate([sums, *(sums[2] * x for x in (head.flat, optimiser.m, optimiser.v))])

    for batch in batches:
        for name, rows in batch.groupby("part", sort=True):
            if name != part:
                if part is not None:
                    yield close()
                part, held, count = name, [], 0
                head, sums = now.head, np.zeros(3 + classes * classes)
                optimiser = AdamW.at(s.eps, now.optimiser.m, now.optimiser.v, now.optimiser.steps)
            at = 0
            while at < len(rows):
                taken = rows.iloc[at:at + s.batch_size - count]
                held.append(taken)
                at, count = at + len(taken), count + len(taken)
                if count == s.batch_size:
                    step(pd.concat(held))
                    held, count = [], 0
    if part is not None:
        yield close()


def _epoch(train: DataFrame, rows: int, now: Progress, total: int) -> tuple[float, dict[tuple[int, int], int]]:
    """Moves ``now`` on by an epoch over ``train`` (sentence_id, vector, code), in one
    job. Gives the mean of the batch mean losses and the confusion counts."""
    s, epoch = now.head.settings, now.epoch + 1
    if s.batch_size is None or s.batch_size >= rows:
        gradient, loss, cells = batch_gradient(train, now.head, epoch - 1)
        now.head = replace_weights(now.head, now.optimiser.update(now.head.flat, gradient, _rate(s, now.scheduled, total)))
        now.scheduled += s.step_per in ("epoch", "batch")
        return loss, cells
    parts = max(1, -(-rows * s.inputs // s.part_values))
    key = F.xxhash64("sentence_id", F.lit(s.seed), F.lit(epoch))
    ordered = (
        train.select(F.pmod(F.xxhash64(key, F.lit(1)), F.lit(parts)).alias("part"), key.alias("key"), "sentence_id", "vector", "code")
        .repartition(parts, "part").sortWithinPartitions("part", "key", "sentence_id").select("part", "key", "vector", "code"))
    shared = train.sparkSession.sparkContext.broadcast(now)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for everything in part_steps(batches, shared.value, parts, total):
            yield _slices(everything)

    everything = _added_up(ordered.mapInPandas(work, "slice int, part array<double>"))
    shared.unpersist()
    head = 3 + s.classes ** 2
    loss, batches, counted = everything[:3]
    flat, m, v = np.split(everything[head:] / counted, 3)
    now.head = replace_weights(now.head, flat)
    now.optimiser = AdamW.at(s.eps, m, v, now.optimiser.steps + -(-int(batches) // parts))
    now.scheduled += int(batches) if s.step_per == "batch" else s.step_per == "epoch"
    return loss / batches, _counted(everything[3:head], s.classes)


def warmup_factor(step: int, warmup: int, total: int) -> float:
    if step < warmup:
        return step / max(1, warmup)
    return max(0.0, (total - step) / max(1, total - warmup))


def score(df: DataFrame, head: Head, vector: str = "vector", output: str = "logits") -> DataFrame:
    """Adds the logits; all other columns, labels included if there are any, ride along."""
    shared = df.sparkSession.sparkContext.broadcast(head)

    @F.pandas_udf("array<double>")
    def forward(vectors: pd.Series) -> pd.Series:
        model = shared.value
        return pd.Series(list(model.logits(_stack(vectors, model.settings.inputs))))

    return df.withColumn(output, forward(F.col(vector)))


def predicted(scored: DataFrame, mapping: Mapping[str, int] = TRAIN_CODES) -> DataFrame:
    return scored.withColumn("predicted_label", decode(argmax_index(F.col("logits")), inverse(mapping)))


def _row_loss(head: Head):
    s, p = head.settings, softmax(F.col("logits"))
    if s.loss == "cross_entropy":
        return cross_entropy(p, F.col("code"))
    weights = s.class_weights or (1.0,) * s.classes
    return focal(p, F.col("code"), F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("code")), s.gamma)


def _cells_frame(spark: SparkSession, cells: Mapping[str, Mapping[tuple[int, int], int]]) -> DataFrame:
    """(split, gold, pred, n) from counts already on the driver, in one partition, so
    that the scores of so small a table need no shuffle."""
    rows = [
        F.struct(F.lit(split).alias("split"), F.lit(g).alias("gold"), F.lit(p).alias("pred"), F.lit(n).cast("bigint").alias("n"))
        for split, counted in cells.items() for (g, p), n in counted.items()
    ]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows)))


def _epoch_scores(spark: SparkSession, cells: Mapping[str, Mapping], metrics: Mapping[str, Callable],
                  names: Mapping[int, str], digits: int) -> dict[tuple[str, str], float]:
    """{(split, score): value} for the metrics and the F1 of each class, in one job."""
    frame = _cells_frame(spark, cells)
    name = decode(F.col("category"), {code: f"{label}_class_f1" for code, label in names.items()})
    single = C.class_f1(frame, ["split"]).select("split", name.alias("name"), F.bround("f1", digits).alias("value"))
    rows = C.score_all(frame, dict(metrics), ["split"], digits).unionByName(single).collect()
    return {(row["split"], row["name"]): row["value"] for row in rows}


def _validate(val: DataFrame, head: Head) -> tuple[float, dict[tuple[int, int], int]]:
    """Mean of the batch mean losses, and the confusion counts, from one pass."""
    scored = score(val, head).select("batch_id", "code", argmax_index(F.col("logits")).alias("pred"), _row_loss(head).alias("loss"))
    per_batch = scored.groupBy("batch_id").agg(
        F.avg("loss").alias("loss"),
        *[F.count_if((F.col("code") == g) & (F.col("pred") == p)).alias(f"n_{g}_{p}")
          for g in range(head.settings.classes) for p in range(head.settings.classes)],
    )
    row = per_batch.agg(F.avg("loss").alias("loss"), *[F.sum(c).alias(c) for c in per_batch.columns if c.startswith("n_")]).first()
    cells = {(g, p): row[f"n_{g}_{p}"] for g in range(head.settings.classes) for p in range(head.settings.classes)}
    return row["loss"], {cell: n for cell, n in cells.items() if n}


def train_head(train: DataFrame, val: DataFrame, settings: HeadSettings, vector: str = "embedding",
               label: str = "label_encoded", metrics: Mapping[str, Callable] | None = None,
               log: Callable[[dict[str, Any]], None] | None = None,
               mapping: Mapping[str, int] = TRAIN_CODES, initial: Head | None = None,
               progress: str | None = None, row_metrics: Mapping[str, RowMetric] | None = None) -> tuple[Head, float, list[dict[str, Any]]]:
    """Epochs until validation macro-F1 has not risen for ``patience`` epochs; gives
    back the best head, its score and the logged epochs.

    ``row_metrics`` are logged for the validation rows besides; they see the columns
    code, logits and p. ``initial`` is a head to train on from. ``progress`` names a folder for the state
    after each epoch: a fit with the same settings that finds one there goes on behind
    its last complete epoch and ends like an uninterrupted one.
    """
    spark = train.sparkSession
    metrics = dict(metrics or C.METRICS)
    columns = ["sentence_id", F.col(vector).alias("vector"), F.col(label).cast("int").alias("code")]
    with scratch(spark, "fit") as tmp:
        train = tmp.table(train.select(columns))
        val = val.select(*columns, F.lit(0).alias("batch_id")) if settings.batch_size is None else assign_batches(val.select(columns), settings.batch_size)
        val = tmp.table(val)
        rows = train.count()
        steps_per_epoch = 1 if settings.batch_size is None else num_batches(rows, settings.batch_size)
        total = settings.epochs * steps_per_epoch + settings.warmup_steps
        head = Head(settings, initial.flat) if initial else Head.initial(settings)
        now = (load_progress(spark, progress, settings) if progress else None) or Progress(head, AdamW(len(head.flat), settings.eps))
        while not now.over:
            loss, cells = _epoch(train, rows, now, total)
            now.epoch += 1
            _judge(spark, val, now, loss, cells, total, metrics, inverse(mapping), log, row_metrics or {})
            if progress:
                save_progress(spark, now, progress)
    return now.best or now.head, now.best_score, now.logged


def _judge(spark: SparkSession, val: DataFrame, now: Progress, loss: float, cells: Mapping, total: int,
           metrics: Mapping[str, Callable], names: Mapping[int, str], log: Callable[[dict], None] | None,
           row_metrics: Mapping[str, RowMetric]) -> None:
    """Scores the epoch, keeps the best head, and logs unless the fit ends here."""
    settings = now.head.settings
    val_loss, val_cells = _validate(val, now.head)
    scores = _epoch_scores(spark, {"train": cells, "val": val_cells}, metrics, names, settings.digits)
    if scores["val", "macro_f1"] > now.best_score:
        now.best, now.best_score, now.waited = now.head, scores["val", "macro_f1"], 0
    else:
        now.waited += 1
        if now.waited >= settings.patience:
            return
    record = {
        "epoch": now.epoch, "train/loss": float(loss), "val/loss": val_loss, "learning_rate": _rate(settings, now.scheduled, total),
        **{f"{split}/{name}": scores.get((split, name)) for name in ("macro_f1", "accuracy") for split in ("train", "val")},
        **{f"val/{name}_class_f1": scores.get(("val", f"{name}_class_f1")) for name in names.values()},
    }
    if row_metrics:
        rows = score(val, now.head).select("code", "logits", softmax(F.col("logits")).alias("p"))
        record |= {f"val/{name}": value for name, value in score_rows(rows, row_metrics).first().asDict().items()}
    now.logged.append(record)
    if log:
        log(record)


def replace_weights(head: Head, flat: np.ndarray) -> Head:
    return Head(head.settings, flat)


def save_head(spark: SparkSession, head: Head, path: str) -> None:
    """One row: the settings as JSON and the weights."""
    row = [(json.dumps(asdict(head.settings)), [float(x) for x in head.flat])]
    spark.createDataFrame(row, "settings string, weights array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load_head(spark: SparkSession, path: str) -> Head:
    row = spark.read.schema("settings string, weights array<double>").parquet(path).first()
    raw = json.loads(row["settings"])
    raw["class_weights"] = tuple(raw["class_weights"]) if raw["class_weights"] else None
    return Head(HeadSettings(**raw), np.asarray(row["weights"]))


_PROGRESS = ("epoch int, settings string, steps bigint, scheduled bigint, best_score double, waited int, logged string, "
             "weights array<double>, m array<double>, v array<double>, best array<double>")


def save_progress(spark: SparkSession, now: Progress, folder: str) -> None:
    """One row in a folder of its own per epoch; only a finished write leaves a marker."""
    row = (now.epoch, json.dumps(asdict(now.head.settings)), now.optimiser.steps, now.scheduled, now.best_score, now.waited, json.dumps(now.logged),
           *[x.tolist() for x in (now.head.flat, now.optimiser.m, now.optimiser.v)], None if now.best is None else now.best.flat.tolist())
    spark.createDataFrame([row], _PROGRESS).coalesce(1).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/after-{now.epoch}")


def load_progress(spark: SparkSession, folder: str, settings: HeadSettings) -> Progress | None:
    """The last complete epoch of a fit with these settings; None if there is none."""
    paths = [f"{folder.rstrip('/')}/after-{epoch}" for epoch in range(settings.epochs, 0, -1)]
    found = next((p for p in paths if is_complete(spark, p)), None)
    if found is None:
        return None
    row = spark.read.schema(_PROGRESS).parquet(found).first()
    if json.loads(row["settings"]) != json.loads(json.dumps(asdict(settings))):
        raise ValueError(f"{folder} holds the progress of a fit with other settings")
    arrays = {c: np.asarray(row[c]) for c in ("weights", "m", "v")}
    best = None if row["best"] is None else Head(settings, np.asarray(row["best"]))
    return Progress(Head(settings, arrays["weights"]), AdamW.at(settings.eps, arrays["m"], arrays["v"], row["steps"]), row["epoch"],
                    row["scheduled"], best, row["best_score"], row["waited"], json.loads(row["logged"]))
