"""Mixing to target weights with soft domain membership.

Domains come from a labelled table. A naive Bayes classifier over words and a few
shape features gives every document a posterior over the domains. Documents then
get nonnegative rates such that the expected tokens of each domain, the sum over
documents of rate * tokens * posterior, come as near the targets as they can:
projected gradient steps on the least squares, starting from rate 1. The residuals are
whitened by the Gram matrix of the posteriors (tokens as weights), which fixes the
step size at 1. A document's rate depends on its posterior and the residuals of the
steps alone, so it is an expression over literals and needs no state per document.

DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from sentspark.llm.scratch import keep, scratch

SAMPLE_DOCS = 6000      # labelled documents the classifier is fitted on, at most
FEATURES = 1000         # features kept, those with the strongest evidence first
LEAST_DOCS = 3          # documents of the sample a feature must be in
CHANCE = 3.0            # times the logarithm of the features tried: evidence that chance doesn't give one of them
LIMIT = 6.0             # bound of one feature's log odds
STEPS = 40
TOLERANCE = 1e-3        # largest residual, as a share of all target tokens
SEED = 20240607

_SPACES = r"[\x20\t\n\x0B\f\r]+"


@dataclass
class Classifier:
    domains: list[str]
    prior: list[float]                      # log shares
    features: list[int]                     # hashes of the words and shapes that count
    weights: list[list[float]]              # per domain: log odds against the first, per feature
    absent: list[list[float]]               # per domain whose features are all missing: log odds of each domain


def words_of(text: Column) -> Column:
    """Lower-cased words; NULL has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPACES), lambda w: w != "")


def _features(text: Column, words: Column) -> Column:
    """Feature numbers of a text: its distinct words by hash, and the grades of three
    measures (signs, exclamation marks, repeated words)."""
    text = F.coalesce(text, F.lit(""))
    size = F.greatest(F.lit(1), F.length(text))
    distinct = F.array_distinct(words)

    def share(characters: str) -> Column:
        return sum(size - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in characters) / size

    measures = [share("#*$%&|"), share("!"), (1 - F.size(distinct) / F.greatest(F.lit(1), F.size(words))) / 4]
    shapes = [
        F.lit(6 * i) + sum((m > edge).cast("int") for edge in (0.002, 0.01, 0.04, 0.12, 0.2))
        for i, m in enumerate(measures)
    ]
    return F.concat(F.array(*[s.cast("long") for s in shapes]), F.transform(distinct, lambda w: F.xxhash64(w)))


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Classifier:
    """Fitted on the ``sample_docs`` labelled documents that come first by a hash of
    doc_id. ``labels`` has doc_id and domain. Features are counted and judged in Spark;
    the driver gets at most FEATURES of them. Without labels there is no domain."""
    chosen = labels.where("domain IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text IS NOT NULL")
    rows = rows.select("doc_id", "domain", F.array_distinct(_features(F.col("text"), words_of(F.col("text")))).alias("features"))
    # Of near copies, which share their least hashes, one counts.
    least = F.slice(F.array_sort("features"), 1, 3)
    with scratch(docs.sparkSession, "mixing-fit") as tmp:
        rows = tmp.table(rows.groupBy("domain", least.alias("least")).agg(F.min_by("features", "doc_id").alias("features")).drop("least"))
        totals = rows.groupBy("domain").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("features")).alias("features")).orderBy("domain").collect()
        domains = [t["domain"] for t in totals]
        if not domains:
            return Classifier([], [], [], [], [])
        seen = rows.select("domain", F.explode("features").alias("feature")).groupBy("feature").agg(
            F.count(F.lit(1)).alias("n"), *[F.sum((F.col("domain") == d).cast("double")).alias(f"n{i}") for i, d in enumerate(domains)])
        sizes = [float(t["features"]) for t in totals]

        def part(n, expected):
            return F.when(n > 0, n * F.log(n / expected)).otherwise(F.lit(0.0))

        # Likelihood ratio of two rates against one, for each domain and the first.
        ratios = [F.lit(0.0)]
        for i in range(1, len(domains)):
            both = F.col("n0") + F.col(f"n{i}")
            ratios.append(2 * (part(F.col("n0"), both * (sizes[0] / (sizes[0] + sizes[i]))) + part(F.col(f"n{i}"), both * (sizes[i] / (sizes[0] + sizes[i])))))
        strong = F.array_max(F.array(*ratios))
        seen = tmp.table(seen.where(F.col("n") >= LEAST_DOCS))
        evidence = CHANCE * np.log(1 + seen.count())
        kept = (
            seen.withColumn("ratios", F.array(*ratios)).where(strong > F.lit(float(evidence)))
            .orderBy(strong.desc(), "feature").limit(FEATURES).collect()
        )
        weights = []
        for i in range(len(domains)):
            odds = [np.log((r[f"n{i}"] + 0.5) / (sizes[i] + 0.5 * max(sizes)) * (sizes[0] + 0.5 * max(sizes)) / (r["n0"] + 0.5)) for r in kept]
            weights.append([round(float(np.clip(o, -LIMIT, LIMIT)), 4) if r["ratios"][i] > evidence else 0.0 for o, r in zip(odds, kept)])
        features = [r["feature"] for r in kept]
        amounts = [float(t["docs"]) for t in totals]
        none = [_missing(F.col("features"), features, w).cast("double") for w in weights]
        counts = {r["domain"]: r for r in rows.groupBy("domain").agg(*[F.sum(x).alias(f"m{i}") for i, x in enumerate(none)]).collect()}
    shares = [[(counts[d][f"m{i}"] + 0.5) / (n + 1) for d, n in zip(domains, amounts)] for i in range(len(domains))]
    absent = [[round(float(np.log(x / of[0])), 4) for x in of] for of in shares]
    return Classifier(domains, [float(np.log(n / sum(amounts))) for n in amounts], features, weights, absent)


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values]).cast("array<long>")


def _missing(found: Column, features: list[int], weights: list[float]) -> Column:
    """Whether a text has none of the features that speak for a domain."""
    return F.size(F.array_intersect(found, _longs([f for f, w in zip(features, weights) if w > 0]))) == 0


def with_posterior(rows: DataFrame, model: Classifier) -> DataFrame:
    """Adds tokens and p, the posteriors in the order of ``model.domains``, to rows with
    a column ``body``. One column per step, so that none is worked out twice."""
    rows = rows.withColumn("words", words_of(F.col("body"))).withColumn("tokens", F.size("words").cast("long"))
    if not model.domains:
        return rows.withColumn("p", F.array().cast("array<double>")).drop("words")

    def score(prior, weights):
        pairs = [x for feature, w in zip(model.features, weights) if w for x in (F.lit(feature).cast("long"), F.lit(w))]
        if not pairs:
            return F.lit(prior)
        table = F.create_map(*pairs)
        return F.aggregate("found", F.lit(prior), lambda acc, f: acc + F.coalesce(F.element_at(table, f), F.lit(0.0)))

    # Few of a text's features count; only those are looked up one by one.
    counted = F.array_intersect(_features(F.col("body"), F.col("words")), _longs(model.features))
    scores = [score(prior, weights) for prior, weights in zip(model.prior, model.weights)]
    for odds, weights in zip(model.absent, model.weights):
        if any(w > 0 for w in weights):
            gone = _missing(F.col("found"), model.features, weights)
            scores = [s + F.when(gone, F.lit(o)).otherwise(F.lit(0.0)) for s, o in zip(scores, odds)]
    return (
        rows.withColumn("found", counted).withColumn("scores", F.array(*scores))
        .withColumn("top", F.array_max("scores")).withColumn("scores", F.transform("scores", lambda s: F.exp(s - F.col("top"))))
        .withColumn("top", F.aggregate("scores", F.lit(0.0), lambda acc, x: acc + x))
        .withColumn("p", F.transform("scores", lambda s: s / F.col("top"))).drop("words", "found", "scores", "top")
    )


def _rate(p: list[Column], steps: list[list[float]]) -> Column:
    """Rate of a document after the given gradient steps, from rate 1."""
    rate = F.lit(1.0)
    for step in steps:
        rate = F.greatest(F.lit(0.0), rate - sum(F.lit(c) * x for c, x in zip(step, p)))
    return rate


def solve(members: DataFrame, k: int, targets) -> list[list[float]]:
    """Gradient steps for ``members`` (tokens, p). ``targets`` gives the target tokens
    from the tokens of each domain at rate 1. Every step is one pass of sums: the
    residuals, and the Gram matrix of the documents whose rate can still move. The
    driver holds those k + k * k numbers."""
    p = [F.element_at("p", i + 1) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    steps: list[list[float]] = []
    best, target, before, scale = [], None, None, 1.0
    for _ in range(STEPS + 1):
        rate = members.withColumn("rate", _rate(p, steps))
        moving = F.col("tokens") * (F.col("rate") > 0).cast("double")
        sums = [v or 0.0 for v in rate.agg(
            *[F.sum(F.col("tokens") * x * F.col("rate")) for x in p], *[F.sum(moving * p[i] * p[j]) for i, j in pairs]).first()]
        now, gram = np.array(sums[:k]), np.zeros((k, k))
        for (i, j), v in zip(pairs, sums[k:]):
            gram[i, j] = gram[j, i] = v
        target = np.asarray(targets(now), float) if target is None else target
        gap = float(np.square(now - target).sum())
        if before is not None and gap >= before:     # too far: half the step
            scale /= 2
            if scale < 0.01:
                break
            steps = steps[:-1] + [[c / 2 for c in steps[-1]]]
            continue
        stalled = before is not None and gap > 0.98 * before
        best, before, scale = list(steps), gap, min(1.0, 2 * scale)
        if stalled or np.abs(now - target).max() <= TOLERANCE * max(target.sum(), 1.0):
            break
        ridge = 1e-2 * max(np.trace(gram), 1.0) * np.eye(k)
        steps = steps + [(scale * np.linalg.solve(gram + ridge, now - target)).tolist()]
    return best


def _steps(members: DataFrame, model: Classifier, weights: dict[str, float], anchor: str | None) -> list[list[float]]:
    k = len(model.domains)
    if not k:
        return []
    share = np.array([weights.get(d, 0.0) for d in model.domains])
    share = share / share.sum()

    def targets(now):
        if anchor in model.domains and share[model.domains.index(anchor)] > 0:
            at = model.domains.index(anchor)
            return share * (now[at] / share[at])
        return share * now.sum()

    return solve(members, k, targets)


def _drawn(rows: DataFrame, k: int, steps: list[list[float]]) -> DataFrame:
    rows = rows.withColumn("rate", _rate([F.element_at("p", i + 1) for i in range(k)], steps))
    return rows.withColumn("copies", F.floor(F.col("rate") + F.col("draw")).cast("int")).drop("draw")


def _draw(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "id", "body"), F.lit(1 << 30)) / float(1 << 30)


def reached_shares(mixed: DataFrame, model: Classifier) -> dict[str, float]:
    """Share of each domain in the expected tokens of rows (tokens, p, rate): what the
    rates reach, to be held against the targets. Empty without tokens."""
    sums = mixed.agg(*[F.sum(F.col("tokens") * F.col("rate") * F.element_at("p", i + 1)).alias(f"d{i}") for i in range(len(model.domains))]).first() \
        if model.domains else ()
    total = sum(x or 0.0 for x in sums)
    return {d: (x or 0.0) / total for d, x in zip(model.domains, sums)} if total else {}


def document_rates(docs: DataFrame, model: Classifier, weights: dict[str, float], anchor: str | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, tokens, p, rate and copies of each row of ``docs`` (doc_id, text), as
    ``mix_documents`` gives them, from one pass over the texts."""
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("body")).withColumn("draw", _draw(seed))
    with scratch(docs.sparkSession, "rates") as tmp:
        members = tmp.table(with_posterior(rows, model).select(F.col("id").alias("doc_id"), "tokens", "p", "draw"))
        return keep(_drawn(members, len(model.domains), _steps(members, model, weights, anchor)))


def mix_documents(docs: DataFrame, model: Classifier, weights: dict[str, float], anchor: str | None = None, seed: int = SEED) -> DataFrame:
    """``docs`` as struct ``row``, with tokens (words), p (posteriors), rate and copies.

    ``weights``: target share of each domain's tokens; domains not named get 0. The
    size of the mix is such that ``anchor`` keeps all its expected tokens, or, without
    an anchor, that of ``docs``. copies is the rate rounded up or down by a keyed hash
    of doc_id and text, so that the mean is the rate. A target that no rates >= 0 reach
    is come near in the whitened least-squares sense.

    The texts are read twice, for the solver and for the result, and don't move: what
    is stored between are tokens and posteriors.

    NULL or empty text: no tokens, prior posteriors, and the rate that follows from
    them. NULL doc_id is one value for the hash. Repeated rows get equal copies. No
    rows in, no rows out; without domains every rate is 1. Only sums leave a task.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("body"), F.col("doc_id").alias("id"))
    judged = with_posterior(packed.withColumn("draw", _draw(seed)), model)
    with scratch(docs.sparkSession, "mixing") as tmp:
        steps = _steps(tmp.table(judged.select("tokens", "p")), model, weights, anchor)
    return _drawn(judged, len(model.domains), steps).drop("body", "id")
