"""Mixing sources to target weights by soft membership.

A softmax classifier, fitted on labelled rows, gives each document its posteriors over domains.
Nonnegative document rates are then fitted by projected gradient descent, so that the tokens
expected of each domain, sum over documents of rate * tokens * posterior, meet the targets in the
sense of least squares, relative to each target.

A rate depends on its document's posteriors and on all steps so far, which are a few numbers each;
so a step is one aggregation, in which each row works out its own rate. The
rates start at 1 and stay as near to it as the targets let them, as descent moves only within the
span of the posteriors.

The classifier sees counts of hashed words and is fitted on at most SAMPLE labelled rows (those
whose ids hash lowest); all else covers all rows. Counts over FEATURES slots are its only state, so what is
broadcast is of fixed size.

Defined cases: null and empty texts have no tokens, even posteriors and rate 1; labels that are
null are ignored; a document labelled twice has its least quality and highest toxicity; without
labelled rows, or in a domain without any, posteriors are even; a target for a domain
without tokens cannot be met and is left out; a target of 0 counts by the tokens that are there;
repeated rows have a rate each; rows that share an id and a rate stay or go together.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm._shared import durable_table, fresh, masked, without

DOMAINS = ("good", "poor", "toxic")
FEATURES = 1 << 14
SAMPLE = 20_000
ROUNDS = 60
#: Tasks over the sample, however many the documents had: each sends one gradient a round.
SAMPLE_TASKS = 8
TOLERANCE = 1e-4
#: A step that lowers the sum of squares by less than this share is the last.
STANDSTILL = 1e-3
#: A target missed by more than this share is told.
MISS = 0.01
#: Tokens wanted of each domain, in units of what there is: more of all, and most of good text.
WANTED = {"good": 1.3, "poor": 1.1, "toxic": 1.1}


def domain(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, 2).when(quality == 0, 1).otherwise(0)


def _features(raw: bytes | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Slots and weights (square roots of counts, of unit length), and the number of words."""
    words = (raw or b"").lower().split()
    if not words:
        return np.empty(0, np.int64), np.empty(0), 0
    digest = xxhash.xxh32_intdigest
    slots = np.fromiter((digest(w) for w in words), np.int64, len(words)) % FEATURES
    at, n = np.unique(slots, return_counts=True)
    weight = np.sqrt(n)
    return at, weight / np.sqrt(len(words)), len(words)


def _posteriors(raw: bytes | None, weights: np.ndarray | None, bias: np.ndarray) -> tuple[np.ndarray, int]:
    at, x, n = _features(raw)
    if weights is None or not n:
        return np.full(len(bias), 1 / len(bias)), n
    z = x @ weights[at] + bias
    p = np.exp(z - z.max())
    return p / p.sum(), n


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_features(x) for x in batch.column("raw").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.float64())), batch.column("domain")],
            names=["slots", "weights", "domain"],
        )


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray | None, np.ndarray]:
    """Weights (FEATURES by domains) and biases, by gradient steps that Spark sums over the sample."""
    spark = docs.sparkSession
    even = np.zeros(len(DOMAINS))
    known = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", domain(F.col("quality"), F.col("toxic")).alias("domain"))
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("raw")).join(F.broadcast(known), "doc_id")
    rows = durable_table(texts.select("raw", "domain").mapInArrow(_sparse, "slots array<long>, weights array<double>, domain int"), "mixing-sample").coalesce(SAMPLE_TASKS)
    counts = {r.domain: r.n for r in rows.where("size(slots) > 0").groupBy("domain").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None, even
    weights, bias = np.zeros((FEATURES, len(DOMAINS))), np.zeros(len(DOMAINS))
    present = np.array([d in counts for d in range(len(DOMAINS))])
    bias[~present] = -30.0
    total = sum(counts.values())
    speed, g2 = 0.5, np.zeros((FEATURES + 1, len(DOMAINS)))

    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast((weights, bias))

        def gradient(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            w, b = shared.value
            g = np.zeros((FEATURES + 1, len(b)))
            for batch in batches:
                column = batch.column("slots")
                lengths = np.diff(column.offsets.to_numpy())
                flat, x = column.flatten().to_numpy(), batch.column("weights").flatten().to_numpy()
                row = np.repeat(np.arange(len(lengths)), lengths)
                z = np.stack([np.bincount(row, x * w[flat, d], minlength=len(lengths)) for d in range(len(b))], 1) + b
                q = np.exp(z - z.max(1, keepdims=True))
                q /= q.sum(1, keepdims=True)
                q[np.arange(len(q)), batch.column("domain").to_numpy()] -= 1
                q[lengths == 0] = 0
                for d in range(len(b)):
                    g[:-1, d] += np.bincount(flat, x * q[row, d], minlength=FEATURES)
                g[-1] += q.sum(0)
            yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()], pa.binary())], names=["g"])

        parts = rows.mapInArrow(gradient, "g binary").collect()  # a fixed size for each task of the bounded sample
        g = sum(np.frombuffer(r.g).reshape(FEATURES + 1, len(DOMAINS)) for r in parts) / total
        g[:-1] += 1e-5 * weights
        g[:, ~present] = 0
        g2 += g * g
        step = speed * g / np.sqrt(g2 + 1e-12)
        weights, bias = weights - step[:-1], bias - step[-1]
        shared.destroy()  # else the driver keeps all rounds' weights until it collects its garbage
    return weights, bias


def with_posteriors(docs: DataFrame, weights: np.ndarray | None, bias: np.ndarray) -> DataFrame:
    """``docs`` less the text, with ``tokens`` and a posterior ``p_<domain>`` for each domain."""
    names = ["tokens", *[f"p_{d}" for d in DOMAINS]]
    docs = without(docs, *names)
    own = fresh(docs, "raw")
    shared = docs.sparkSession.sparkContext.broadcast((None if weights is None else weights.astype(np.float32), bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        for batch in batches:
            found = [_posteriors(x, w, b) for x in batch.column(own).to_pylist()]
            p = np.array([f[0] for f in found]).reshape(-1, len(b))
            new = [pa.array([f[1] for f in found], pa.int64()), *[pa.array(np.ascontiguousarray(p[:, d])) for d in range(len(b))]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=[*batch.schema.names[:-1], *names])

    kept = [f for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType([*kept, T.StructField("tokens", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in names[1:]]])
    return docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col("text").cast("binary").alias(own)).mapInArrow(run, schema)


def _rate(history: list[list[float]], least: float) -> Column:
    """max(least, rate - posteriors . step) for each step so far, from rate 1."""
    steps = F.from_json(F.lit(str(history)), "array<array<double>>")
    dot = lambda e: sum((F.col(f"p_{d}") * F.get(e, F.lit(k)) for k, d in enumerate(DOMAINS)), F.lit(0.0))
    return F.aggregate(steps, F.lit(1.0), lambda r, e: F.greatest(F.lit(least), r - dot(e)))


def fit_rates(rows: DataFrame, wanted: dict[str, float] | None = None, least: float = 0.0) -> tuple[Column, dict[str, tuple[float, float]]]:
    """The rate as a column over ``with_posteriors`` rows, and (target, reached) tokens by domain.

    Each step goes down the gradient and is projected onto rates of ``least`` or more. Its length in
    each direction comes from the products of the posteriors of rows above ``least``, damped: a
    step that does not lower the sum of squares is tried again with ten times the damping, which in
    the end is a short step down the plain gradient. It ends where every target is met to TOLERANCE
    or where no step helps, as with targets that no rates can meet; then the squares are least.
    """
    wanted = wanted or WANTED
    n = len(DOMAINS)
    p = [F.col(f"p_{d}") for d in DOMAINS]

    def totals(history: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens reached by domain, and products of posteriors, by tokens, over rows that can move down (at first, all)."""
        rated = rows.where("tokens > 0").select("tokens", *p, (_rate(history, least) if history else F.lit(1.0)).alias("rate"))
        free = F.when(F.col("rate") > least, F.col("tokens")).otherwise(0) if history else F.col("tokens")
        sums = [F.sum(F.col("rate") * F.col("tokens") * x) for x in p] + [F.sum(free * p[a] * p[b]) for a in range(n) for b in range(n)]
        found = np.array([x or 0.0 for x in rated.agg(*[x.alias(f"s{k}") for k, x in enumerate(sums)]).first()])
        return found[:n], found[n:].reshape(n, n)

    have, gram = totals([])
    target = have * np.array([wanted.get(d, 1.0) for d in DOMAINS])
    weight = np.where(have > 0, 1 / np.maximum(np.maximum(target, have), 1e-9) ** 2, 0.0)
    squares = lambda reached: float(((reached - target) ** 2 * weight).sum())
    history: list[list[float]] = []
    reached, damping = have, 1e-6
    gain = 1.0
    while np.sqrt(squares(reached)) > TOLERANCE and damping < 1e4 and gain > STANDSTILL:
        scale = np.diag(weight)
        largest = max(float(np.trace(scale @ gram)), 1e-30)
        step = np.linalg.solve(scale @ gram + damping * largest * np.eye(n), scale @ (reached - target))
        tried, free = totals([*history, step.tolist()])
        if squares(tried) < squares(reached):
            history.append([float(x) for x in step])
            gain = 1 - squares(tried) / squares(reached)
            reached, gram, damping = tried, free, max(damping / 10, 1e-9)
        else:
            damping *= 10
    rate = F.when(F.col("tokens") > 0, _rate(history, least)).otherwise(1.0) if history else F.lit(1.0)
    missed = {d: (float(target[k]), float(reached[k])) for k, d in enumerate(DOMAINS) if abs(reached[k] - target[k]) > MISS * max(target[k], have[k])}
    if missed:
        warnings.warn(f"no rates of {least} or more meet these targets (wanted, reached): {missed}", stacklevel=2)
    return rate, {d: (float(target[k]), float(reached[k])) for k, d in enumerate(DOMAINS)}


def document_rates(docs: DataFrame, labels: DataFrame, wanted: dict[str, float] | None = None) -> DataFrame:
    """``docs`` less the text, with tokens, posteriors and ``rate``."""
    rows = durable_table(with_posteriors(without(docs, "rate"), *fit(docs, labels)), "mixing-posteriors")
    rate, _ = fit_rates(rows, wanted)
    return rows.withColumn("rate", rate)


def mix(docs: DataFrame, labels: DataFrame, wanted: dict[str, float] | None = None, least: float = 0.0) -> DataFrame:
    """``docs``, each row as often as its rate says: the whole part, and once more by a hash of its id.

    A rate under 1 is the chance that its document stays; at a ``least`` of 1 every row stays, and
    targets are met as nearly as repeats alone can.
    """
    hidden = masked(docs, "doc_id", "text")
    weights, bias = fit(hidden, labels)
    rows = durable_table(with_posteriors(hidden.select("doc_id", "text"), weights, bias), "mixing-posteriors")
    rate, _ = fit_rates(rows, wanted, least)
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    shared = with_posteriors(hidden.withColumn("__text", F.col("text")), weights, bias)
    copies = F.floor(F.round(rate, 6) + chance).cast("int")
    out = shared.withColumn("__copies", copies).where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return out.select(*[F.col("__text").alias("text") if c == "text" else F.col(c) for c in hidden.columns]).toDF(*docs.columns)
